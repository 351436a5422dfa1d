"""Texts with very many findings that overlap each other."""

import random
import time

import pytest
from textguard.operators import resolve

KIND = "doc_id long, findings array<struct<severity:string, confidence:double, start:int, end:int, emission:int>>"
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def kept(findings):
    """Each finding against all that are kept."""
    out = []
    for f in sorted(findings, key=lambda f: (-RANK[f[0]], -f[1], f[2] - f[3], f[4], f[2], f)):
        if all(f[3] <= y[2] or y[3] <= f[2] for y in out):
            out.append(f)
    return sorted(out, key=lambda f: (f[2], f[3]))


def settled(spark, rows):
    return {r["doc_id"]: [tuple(f) for f in r["findings"]] for r in resolve.settled_findings(spark.createDataFrame(rows, KIND)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_many_and_few_are_settled_alike(spark, seed, monkeypatch):
    r = random.Random(seed)
    made = lambda n, width: [(r.choice(list(RANK)), r.choice([0.5, 0.9]), a := r.randrange(width), a + r.randrange(1, 12), r.randrange(3)) for _ in range(n)]
    rows = [(1, made(300, 900)), (2, made(700, 2000)), (3, made(2, 5)), (4, []), (5, made(1200, 300)), (6, None)]
    found = settled(spark, rows[:5])
    assert found == {i: kept(f) for i, f in rows[:5]}
    monkeypatch.setattr(resolve, "MANY", 5)
    assert settled(spark, rows[:5]) == found


def test_twenty_thousand_in_a_chain(spark):
    chain = [("high", 0.9, 3 * i, 3 * i + 5, 0) for i in range(20_000)]
    settled(spark, [(1, chain[:600])])
    began = time.time()
    found = settled(spark, [(1, chain), (2, chain[::-1])])
    took = time.time() - began
    assert found[1] == found[2] == chain[::2] and took < 5, took


def test_findings_keep_their_order_by_start(spark):
    apart = [("low", 0.5, 10 * i, 10 * i + 5, 0) for i in range(20_000)]
    mixed = apart[:]
    random.Random(3).shuffle(mixed)
    assert settled(spark, [(1, mixed)])[1] == apart
