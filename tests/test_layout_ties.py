"""Pieces of one order: their places and the gaps before them follow one order."""

from itertools import permutations

from textguard.operators import records

KIND = "page long, n int, str string, x double, y double, width double, eol boolean"


def _texts(spark, items):
    return {tuple(r) for r in records.laid_out(spark.createDataFrame(items, KIND), "page", "n").collect()}


def test_pieces_of_one_order_keep_their_gaps(spark):
    pieces = [(1, "zeta", 0.0, 700.0, 10.0, False), (1, "alpha", 12.0, 700.0, 10.0, False), (1, "beta", 0.0, 680.0, 10.0, False), (2, "end", 20.0, 680.0, 10.0, True)]
    items = [(page, *p) for page, order in enumerate(permutations(pieces)) for p in order]
    assert _texts(spark, items) == {(page, "zeta alpha\nbeta end\n") for page in range(24)}


def test_twins_follow_each_other(spark):
    pieces = [(1, "a", 0.0, 700.0, 5.0, False), (2, "b", 9.0, 700.0, 5.0, False), (2, "b", 9.0, 700.0, 5.0, False), (3, "c", 14.5, 700.0, 5.0, True), (3, "c", 14.5, 700.0, 5.0, True)]
    assert _texts(spark, [(7, *p) for p in pieces]) == {(7, "a bbc\nc\n")}
