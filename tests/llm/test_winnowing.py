"""Benchmark windows in documents, against loops over every place."""

import hashlib
import random
import re

import pytest
from tests.oracle import connected, difference
from textguard.llm import winnowing
from textguard.llm.oracles import ORACLES
from textguard.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items):
    out = []
    listed = [("" if i is None else str(i), words(t)) for i, t in items]
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, iw in listed:
            n = min(len(iw), 10)
            if n:
                windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
                for k in range(len(ws) - n + 1):
                    if tuple(ws[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, at string, fp int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, n_words int")
    return sorted((tuple(r) for r in winnowing.contamination(d, b).collect()), key=str)


def test_against_sql(spark):
    assert difference(spark, connected(SMALL), QUERIES["op11_winnowing"], ORACLES["op11_winnowing"], SMALL) == ""


@pytest.mark.parametrize("seed, vocabulary", [(1, 2), (2, 3), (3, 40)])
def test_random_texts_of_few_words(spark, seed, vocabulary):
    """Low-entropy texts: equal words side by side, overlapping windows, ties of hashes."""
    r = random.Random(seed)
    some = ["a", "B", "Éa", "x1", "日本", "b"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(some[:vocabulary]) for _ in range(n))
    items = [(i, text(r.choice([10, 11, 15, 40]))) for i in range(6)]
    docs = [(i, text(r.choice([0, 5, 9, 10, 12, 60]))) for i in range(30)]
    docs += [(100 + i, text(20) + ", " + t.upper().replace("É", "é") + "! " + text(20)) for i, t in items]
    assert run(spark, docs, items) == expected(docs, items)


def test_short_items_are_one_window(spark):
    items = [(1, "one"), (2, "alpha beta gamma"), (3, "a b c d e"), (4, "p q r s t u v w x"), (5, "..."), (6, None), (7, "")]
    docs = [(1, "ONE two one"), (2, "alpha, beta; gamma alpha beta"), (3, "a b c d e a b c d e"), (4, "z p q r s t u v w x z"), (5, "p q r s t u v w y"), (6, "a b c d"), (7, None), (8, "")]
    assert run(spark, docs, items) == expected(docs, items)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(20_000))
    ten = "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10"
    items = [(10, long), (9, ten), (9, "other " + ten), (None, ten), (2, " ".join(f"t{i}" for i in range(500, 530)))]
    docs = [(1, long), (1, long), (None, ten), (2, ten[:-3]), (3, "x" * 100_000), (4, "\x00" + ten + "\x00"), (5, ten.replace(" ", "İ "))]
    found = run(spark, docs, items)
    assert [r[:4] for r in found if r[0] == 1] == [(1, 20_000, 20_000, 2)] * 2
    slow = [(i, t) for i, t in items if t != long]
    rest = [(i, t) for i, t in docs if t != long]
    assert [r for r in found if r[0] != 1] == expected(rest, slow)
    assert run(spark, docs[2:], []) == expected(docs[2:], [])
    assert run(spark, [], items) == []


def test_spans_are_the_hit_words(spark):
    ten = "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10"
    d = spark.createDataFrame([(1, f"a b {ten} c {ten} {ten}")], "doc_id long, text string")
    (r,) = winnowing.decontaminate(d, spark.createDataFrame([(7, ten)], "item_id long, text string")).collect()
    assert [tuple(s) for s in r["spans"]] == [(2, 12), (13, 33)] and r["items"] == ["7"] and r["n_hit"] == 30


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = winnowing.contamination(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
