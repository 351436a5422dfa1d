"""Overlaps of a key with very many intervals."""

import numpy as np
from textguard.operators import state


def test_overlaps_against_a_loop_without_gathering_a_key(spark):
    rng = np.random.default_rng(6)

    def side(n):
        start = rng.integers(0, 3000, n)
        return [(int(u), int(s), int(s + w)) for u, s, w in zip(rng.integers(0, 3, n) // 2, start, rng.integers(0, 200, n) * (rng.random(n) < 0.9), strict=True)]

    mine, others = [*side(300), (None, 1, 5)], [*side(20), (0, 64, 64), (None, 1, 5)]
    schema = "user long, start int, end int"
    out = state.overlaps(spark.createDataFrame(mine, schema), spark.createDataFrame(others, schema), "user")
    expected = [(u, s, e, not any(u is not None and u == v and s < b and e > a for v, a, b in others)) for u, s, e in mine]
    assert out.columns == ["user", "start", "end", "replacement_safe"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))
    assert len({safe for *_, safe in expected}) == 2
    assert "collect_list" not in out._jdf.queryExecution().toString()
