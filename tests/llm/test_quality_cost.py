"""Contexts keep to their text without masks; pooling sorts its entries once."""

import numpy as np

from textguard.llm import quality_net as Q


def test_contexts_end_with_their_text():
    words = Q.Words()
    flat, starts = words.read(["a b c d", None, "e", "", "f g"])
    made = Q.contexts(flat, starts, np.arange(len(flat)), words.index)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        for i in range(a, b):
            near = flat[max(a, i - Q.REACH) : min(b, i + Q.REACH + 1)]
            assert np.array_equal(made[i], words.index[near].sum(axis=0))


def test_pooling_sorts_once(monkeypatch):
    texts, words = ["two words and two more", "", "other words"], Q.Words()
    words.read(["some that come first, other words"])
    known = np.sort(words.hashes)
    vectors = Q.unit(np.arange(len(known) * Q.DIMENSIONS, dtype=float).reshape(len(known), -1))
    fresh = Q.pooled(texts, Q.Words(), known, vectors)

    def again(*args):
        raise AssertionError("entries are sorted a second time")

    monkeypatch.setattr(Q.np, "lexsort", again)
    assert np.array_equal(fresh, Q.pooled(texts, words, known, vectors))
