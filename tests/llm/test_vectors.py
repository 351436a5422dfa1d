"""Vector codes and whitening against plain loops and eigenvectors."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.oracle import connected, difference
from textguard.llm import vector_codes, whitening
from textguard.llm.oracles import ORACLES
from textguard.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, x, "clash", 0) for i, v, x in rows], "vec_id long, embedding array<float>, label int, code string, n int").repartition(partitions)


def finite(rows):
    return [(i, v, x) for i, v, x in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def lloyd(rows):
    """Every part compared with every entry, every time."""
    kept = sorted(finite(rows), key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([[math.floor(1024 * float(np.float32(c))) for c in v] for _, v, _ in kept], np.int64).reshape(len(kept), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()

    def nearest():
        d = [((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        return np.stack([m.argmin(axis=1) for m in d], axis=1), sum(m.min(axis=1) for m in d)

    for _ in range(4):
        code, _ = nearest()
        for p in range(4):
            for j in range(books.shape[1]):
                own = x[code[:, p] == j, p]
                if len(own):
                    books[p, j] = [int(s) // len(own) for s in own.sum(axis=0)]
    code, error = nearest()
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return sorted([(i, bytes(c.astype(np.uint8)).hex(), int(e), by_label[label], digest) for (i, _, label), c, e in zip(kept, code, error, strict=True)], key=str)


def coded(spark, rows):
    return sorted((tuple(r) for r in vector_codes.compress(frame(spark, rows)).collect()), key=str)


def test_codes_against_sql(spark):
    assert difference(spark, connected(SMALL), QUERIES["op12_vector_codes"], ORACLES["op12_vector_codes"], SMALL) == ""


def test_codes_against_a_loop(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()]
    assert coded(spark, rows) == lloyd(rows)


def test_codes_of_few_values_tie(spark):
    """Equal entries, ties of distances, entries without parts, copies, a label without a value."""
    r = np.random.default_rng(5)
    rows = [(i * 3, [float(c) for c in r.integers(-2, 3, 8) / 1024], None if i % 3 else i % 5) for i in range(900)]
    rows += [(9_000 + i, [0.0] * 8, 1) for i in range(400)]
    assert coded(spark, rows) == lloyd(rows)


def test_codes_of_odd_rows(spark):
    good = [(5, [0.1, -0.2, 0.3, 0.4], 1), (2, [-0.5, 0.6, -0.7, 0.8], None), (9, [0.1, -0.2, 0.3, 0.4], None)]
    bad = [(1, None, 1), (3, [], 1), (4, [0.1, None, 0.3, 0.4], 1), (6, [0.1, NAN, 0.3, 0.4], 2), (7, [INF, 0.1, 0.3, 0.4], 2), (8, [0.1, 0.2], 3)]
    assert coded(spark, good + bad) == lloyd(good)
    assert coded(spark, bad[:5]) == coded(spark, []) == []
    big = [(i, [2.5e4 * i, -3e4, 2.5, 1e-30], 0) for i in range(1, 6)] + [(0, [3e38, -3e38, 1.0, 0.0], 0)]
    assert coded(spark, big[:5]) == lloyd(big[:5]) and len(coded(spark, big)) == 6
    assert len(coded(spark, [(1, [0.1, 0.2, 0.3, 0.4, 0.5], 1)])) == 1


def test_bounds_spare_most_comparisons():
    r = np.random.default_rng(3)
    centres = r.integers(-4000, 4000, (64, 16))
    x = (centres[r.integers(0, 64, 3000)] + r.integers(-60, 60, (3000, 16))).astype(np.int64)
    books, old, scans = centres + r.integers(-30, 30, (64, 16)), None, []
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros(3000)
    for _ in range(3):
        if old is not None:
            far, others = vector_codes.moves(old, books)
            upper, lower = upper + far[code], np.maximum(lower - others[code], 0)
        scans.append(vector_codes.reassign(x, books, vector_codes.half_gaps(books), code, upper, lower))
        assert (code == vector_codes.squared(x, books).argmin(axis=1)).all()
        assert (upper >= np.sqrt(vector_codes.own_squared(x, books, code))).all()
        old, books = books, np.stack([x[code == j].sum(axis=0) // max((code == j).sum(), 1) if (code == j).any() else books[j] for j in range(64)])
    assert scans[0] > 2500 and scans[1] < 300 and scans[2] < 300


# op13


def whitened(spark, rows, partitions=3):
    return whitening.whiten(frame(spark, rows, partitions)).collect()


def check_whitened(found, rows, exact_ids=True):
    kept = finite(rows)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in kept], np.int64)
    n, d = x.shape
    s = x.sum(axis=0)
    centre = (n * x - s) / n
    e, axes = np.linalg.eigh(centre.T @ centre / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = max(r["component"] for r in found)
    assert k == min(32, d) and len(found) == n * k
    ids = [i for i, _, _ in kept]
    by_id = {(r["vec_id"], r["component"]): r for r in found}
    w = np.array([[by_id[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    plain = centre @ axes[:, :k] / np.sqrt(e[:k])
    sign = np.sign((w * plain).sum(axis=0))
    gaps = np.minimum(np.append(np.inf, -np.diff(e))[:k], np.append(-np.diff(e), np.inf)[:k]) / e[0]
    clear = gaps > 1e-6  # components of nearly equal eigenvalues may turn into each other
    assert np.abs(w * sign - plain)[:, clear].max(initial=0) < 1e-6
    assert np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-6
    for i, row in zip(ids, x, strict=True):
        r = by_id[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))
    assert all(abs(by_id[ids[0], c + 1]["explained"] / (e[c] / e.sum()) - 1) < 1e-8 for c in range(k))
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-6


def test_whitening_against_eigenvectors(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()]
    check_whitened(QUERIES["op13_whitening"](spark, SMALL).collect(), rows)


@pytest.mark.parametrize("partitions", [1, 40, 70])
def test_triangles_of_many_tasks(spark, partitions):
    r = np.random.default_rng(partitions)
    rows = [(i, [float(c) for c in r.normal(size=5) * [9, 3, 1, 0.5, 0.3]], 0) for i in range(300)]
    check_whitened(whitened(spark, rows, partitions), rows)


def test_whitening_of_odd_rows(spark):
    good = [(5, [0.1, -0.2, 0.9], 1), (2, [-0.5, 0.6, -0.7], 1), (9, [0.4, 0.1, 0.2], 1), (7, [4.0, 1.0, -2.0], 1), (8, [1.0, 2.0, 3.0], 1)]
    bad = [(1, None, 1), (3, [], 1), (4, [0.1, None, 0.3], 1), (6, [0.1, NAN, 0.3], 2), (10, [-INF, 0.1, 0.3], 2), (11, [0.1, 0.2], 3)]
    check_whitened(whitened(spark, good + bad), good)
    assert whitened(spark, bad[:5]) == whitened(spark, []) == whitened(spark, good[:1]) == whitened(spark, good[:1] * 4) == []
    flat = [(i, [float(i), 2.0 * i, 5.0], 0) for i in range(6)]
    assert {r["component"] for r in whitened(spark, flat)} == {1}
    twice = whitened(spark, good + good)
    assert len(twice) == 30 and len({(r["vec_id"], r["component"], r["whitened"]) for r in twice}) == 15
    assert len(whitened(spark, [*good, (12, [3e38, 0.0, 0.0], 0)])) == 18


def test_small_deviations_keep_their_digits():
    """Columns of very unequal lengths: the product of the data with itself would lose the small ones."""
    r = np.random.default_rng(1)
    u, _ = np.linalg.qr(r.normal(size=(200, 6)))
    v, _ = np.linalg.qr(r.normal(size=(6, 6)))
    sigma = np.array([1e6, 1e3, 1.0, 1e-2, 1e-4, 1e-5])
    found, axes = whitening.jacobi(whitening.triangle(u * sigma @ v.T))
    assert np.abs(found[:5] / sigma[:5] - 1).max() < 1e-5 and np.abs(axes.T @ axes - np.eye(6)).max() < 1e-12


def test_a_deviation_beyond_64_bits_is_null():
    out = whitening.deviations(np.array([[3, 4], [2**31, 2**31], [2**32, 0], [3_037_000_499, 0]], np.int64)).to_pylist()
    assert out == [25, None, None, 3_037_000_499**2]
