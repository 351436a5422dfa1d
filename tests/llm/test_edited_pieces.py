"""Edited texts are put together from pieces that are taken apart once."""

import random

import numpy as np
import pyarrow as pa

from textguard.llm import imatch
from textguard.llm.shingles import WordHashes


def test_pieces_of_edited_texts():
    rng = random.Random(1)
    for _ in range(3000):
        texts = ["".join(rng.choice("aBΣ. \t\x85") for _ in range(rng.choice((0, 1, 2, 4, 7, 9, 16, 24)))) for _ in range(3)]
        pieces = imatch.Pieces()
        made = imatch.edited_pieces(texts, imatch.pieces_of(texts, pieces), pieces)
        names = list(pieces)
        assert [[names[i] for i in x] for x in made] == [imatch.edited(a, b).split() for a, b in zip(texts, texts[1:])]


def test_terms_are_found_once_for_a_text_and_its_edit(spark, monkeypatch):
    """The fingerprints of the texts and of the edited texts come from one set of pieces, and are those of the texts alone."""
    texts = [f"some words of ΑΣ text {i}, x_y and {i * i} more words." for i in range(30)]
    cache = WordHashes()
    terms = np.sort(np.fromiter({cache[w] for w in ("some", "words", "of", "more", "x", "y")}, np.uint64))
    calls = []
    plain = imatch.Pieces.terms
    monkeypatch.setattr(imatch.Pieces, "terms", lambda self, cache: calls.append(1) or plain(self, cache))
    monkeypatch.setattr(imatch, "lexicon", lambda docs: terms)
    made = []

    def within(docs, run, schema):  # in this process
        batch = pa.RecordBatch.from_arrays([pa.array(range(31)), pa.array([0] * 31), pa.array([False] * 30 + [True]), pa.array(texts + texts[:1])], names=["doc_id", "_range", "_tail", "text"])
        made.extend(run(iter([batch])))

    docs = spark.range(1).selectExpr("id doc_id", "'' text")
    monkeypatch.setattr(imatch, "in_order", lambda d: docs)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: within(self, run, schema))
    imatch.fingerprint_documents(docs)
    assert calls == [1]
    own = imatch.as_text(*imatch.fingerprints(texts, terms, cache))
    new = imatch.as_text(*imatch.fingerprints([imatch.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])], terms, cache))
    assert made[0].column("fingerprint").to_pylist() == own and made[0].column("edited_fingerprint").to_pylist() == new
