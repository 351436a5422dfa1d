"""Texts are read once: what is written of them stands for all passes."""

import numpy as np
import pyarrow as pa

from textguard.llm import quality_net as Q


def _batch(texts: list) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array([None, *range(1, n)], pa.int64()), pa.array([i % 2 == 0 for i in range(n)]), pa.array(texts, pa.string())], names=["doc_id", "held_out", "text"])


def test_written_words_are_those_of_the_texts():
    many = " ".join(f"w{chr(97 + i % 26)}{'x' * (i % 7)}{i}" for i in range(70_000))  # beyond 16 bits
    for texts in ([None, "", ""], ["Two words, TWO!", None, "", "other\nwords"], [many, "w a few"]):
        rows = list(Q._read(iter([_batch(texts)])))
        ids = [x for r in rows for y in r.column("doc_id").to_pylist() for x in y]
        assert ids == [None, *range(1, len(texts))]
        words = Q.Words()
        flat, starts = words.read(texts)
        found = [known[code] for r in rows for known, code, _ in Q.slices(r)]
        assert np.array_equal(np.concatenate(found), words.hashes[flat])
        assert np.array_equal(np.concatenate([np.diff(s) for r in rows for *_, s in Q.slices(r)]), np.diff(starts))
        known = np.sort(words.hashes)[::2]
        vectors = Q.unit(np.random.default_rng(0).normal(size=(len(known), Q.DIMENSIONS)))
        made = [Q.features(*x, known, vectors) for r in rows for x in Q.slices(r)]
        assert np.array_equal(np.concatenate(made), Q.pooled(texts, Q.Words(), known, vectors))


def test_texts_are_read_once(spark, monkeypatch):
    texts = [f"some words of text {i} and more" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    plain, reads = type(docs).mapInArrow, []

    def noted(self, *args, **more):
        reads.append("text" in self.columns)
        return plain(self, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    assert Q.score_documents(docs, labels).count() == 40
    # frequent words are counted and summed and documents pooled from what one reading wrote
    assert sum(reads) == 1
