"""From whole texts to semantic findings: pieces, windows, batches, the mean, the head; what fails stays one text's."""

import math
import re
import unicodedata

import numpy as np
import pytest

from tests.oracle import DATA
from textguard.operators import resolve, semantic
from textguard.plans.service import QUERIES, STAND_IN_HEAD, VOCABULARY, WIDTH, stand_in_encoder


def tokens(text):
    """(id, start, end): the longest prefix that is a piece, tried from the longest down."""
    out = []
    for m in re.finditer(r"[^\W_]+|[^\w\s]|_", text or ""):
        word = "".join(c for c in unicodedata.normalize("NFD", m[0].lower()) if unicodedata.category(c)[0] != "M")
        at, pieces = 0, []
        while at < len(word) <= 100:
            n = next((n for n in range(len(word), at, -1) if ("##" if at else "") + word[at:n] in VOCABULARY), None)
            if n is None:
                break
            pieces.append(VOCABULARY[("##" if at else "") + word[at:n]])
            at = n
        out += [(i, m.start(), m.end()) for i in (pieces if at == len(word) else [VOCABULARY["[UNK]"]])]
    return out


def expected(text):
    """Predictions of a text, one number after the other."""
    found = tokens(text)
    spans, at = [], 0
    while at < len(found):
        spans.append((at, min(len(found), at + 126)))
        if spans[-1][1] == len(found):
            break
        at += 102
    hits = []
    for a, b in spans:
        ids = [VOCABULARY["[CLS]"], *[t[0] for t in found[a:b]], VOCABULARY["[SEP]"]]
        mean = [sum(float(np.float32(i * (2 * k + 7919) % 1009 / 504.0 - 1.0)) for i in ids) / len(ids) for k in range(WIDTH)]
        norm = math.sqrt(sum(x * x for x in mean))
        for k, label in enumerate(semantic.SEMANTIC_LABELS):
            z = STAND_IN_HEAD.intercepts[k] + sum(w * x / norm for w, x in zip(STAND_IN_HEAD.coefficients[k], mean, strict=True))
            p = 1 / (1 + math.exp(-z))
            if p >= STAND_IN_HEAD.thresholds[k]:
                hits.append((label, found[a][1], found[b - 1][2], p))
    out = []
    for label, start, end, p in sorted(hits):
        if out and out[-1][0] == label and start <= out[-1][2]:
            out[-1] = (label, out[-1][1], max(end, out[-1][2]), max(p, out[-1][3]))
        else:
            out.append((label, start, end, p))
    return out


def test_pieces_of_whole_texts_against_a_loop(spark):
    assert len(VOCABULARY) > 5_000
    rows = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    for r in QUERIES["word_pieces"](spark, DATA).collect():
        found = tokens(rows[r["conv_id"], r["turn"]])
        assert [r[c] for c in ("ids", "starts", "ends")] == [" ".join(str(t[k]) for t in found) for k in range(3)]


def test_predictions_of_whole_texts_against_a_loop(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["semantic_scan"](spark, DATA).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(texts) and {r["semantic_error"] for r in rows} == {None}
    some = 0
    for i, text in texts.items():
        mine = sorted((r["label"], r["start"], r["end"], r["confidence"]) for r in found[i] if r["label"])
        assert [x[:3] for x in mine] == [x[:3] for x in expected(text)]
        assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(mine, expected(text), strict=True))
        some += len(mine)
    assert some > len(texts) / 4


def test_masked_mean_and_norm():
    hidden = np.array([[[3.0, 4.0], [1.0, 0.0], [9.0, 9.0]], [[0.0, 0.0], [0.0, 0.0], [7.0, 7.0]]])
    mean = semantic.pooled(hidden, np.array([[1, 1, 0], [1, 1, 0]]))
    assert np.allclose(mean, [[4 / math.sqrt(32), 4 / math.sqrt(32)], [0, 0]])
    assert semantic.windows(300, 126, 24) == [(0, 126), (102, 228), (204, 300)] and semantic.windows(0, 126, 24) == []


def test_a_text_that_fails_is_that_texts_alone(spark):
    def load():
        plain = stand_in_encoder()
        calls = []

        def encode(ids, mask):
            assert len(ids) <= 4 and (mask.sum(axis=1) <= 128).all()
            calls.append(1)
            if (ids == VOCABULARY["!"]).any():
                raise RuntimeError("no memory")
            return plain(ids, mask)

        return encode

    texts = [(1, "plain words " * 900), (2, "words that fail! " * 300), (3, None), (4, " \n "), (5, "other words")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in semantic.predicted(df, VOCABULARY, "failing", load, STAND_IN_HEAD).collect()}
    assert {i: r["semantic_error"] for i, r in rows.items()} == {1: None, 2: "RuntimeError", 3: None, 4: None, 5: None}
    for i, text in texts:
        found = [(p["label"], p["start"], p["end"]) for p in rows[i]["predictions"]]
        assert sorted(found) == [x[:3] for x in ([] if i == 2 else expected(text))]


def test_a_loader_that_fails_leaves_the_detectors_findings(spark):
    def load():
        raise OSError("no file")

    df = spark.createDataFrame([(1, "mail jo@firm.io")], "doc_id long, text string")
    (r,) = semantic.predicted(resolve.resolved(df), VOCABULARY, "missing", load, STAND_IN_HEAD).collect()
    assert r["semantic_error"] == "OSError" and r["predictions"] == [] and [f["detector"] for f in r["findings"]] == ["email"]


def test_a_head_of_other_dimensions_is_refused():
    with pytest.raises(ValueError, match="dimensions"):
        semantic.Head([[1.0], [1.0, 2.0]], [0.0] * 8, [0.5] * 8)


def test_a_filter_that_fails_hides_nothing(spark):
    df = spark.createDataFrame([(1, "mail jo@firm.io"), (2, "mail ann@firm.io and bo@firm.io"), (3, "nothing")], "doc_id long, text string")

    def keep(findings):
        if any(f["original_value"].startswith("jo") for f in findings):
            raise ConnectionError("store")
        return [f for f in findings if not f["original_value"].startswith("ann")]

    rows = {r["doc_id"]: r for r in semantic.kept_findings(resolve.resolved(df), keep).collect()}
    assert {i: ([f["original_value"] for f in r["findings"]], r["filter_error"]) for i, r in rows.items()} == {
        1: (["jo@firm.io"], "ConnectionError"), 2: (["bo@firm.io"], None), 3: ([], None),
    }
