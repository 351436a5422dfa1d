"""Whitening of embeddings by one-sided Jacobi SVD.

Components become integers x = floor(64 * c) + 1,000,000. Their sums S are exact,
and rows are centred as (n * x - S) / n from integers, before anything is
multiplied: the offset of a million costs no digit.

Blockwise TSQR: every task folds its centred rows batch by batch into one upper
triangle R of at most dims rows; triangles are stacked and factored again, FAN at
a time, until one is left, so that no task and not the driver holds more than
FAN + 1 of them. R has the singular values and right singular vectors of all the
rows. Plane rotations then make R's columns orthogonal, two at a time, in sweeps
until no pair is left that isn't; their lengths are the singular values, to full
relative precision, and the accumulated rotations the components. No product of
the data with itself is formed, so that small deviations keep their digits.

A row is whitened by projection on the components over their standard deviations.
A last pass adds up the products of whitened components, as every task's sums,
for the largest difference of their covariance from the identity.

Defined cases: vectors that are null, are empty, or hold a null or a component
that is not finite are dropped, and so are those of another length than the
first kept row's; components are at most COMPONENTS and none whose deviation is
under RANK times the largest (no variance: no component), so that one row or
equal rows give an empty result, as an empty table does; rows that repeat are
rows each by itself; a deviation beyond 64 bits is null; integers beyond LARGEST
count as LARGEST; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import written
from textguard.llm.vector_codes import _matrix, finite_vectors, of_one_length

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Triangles that are factored at once.
FAN = 32
#: A component has at least this share of the largest deviation.
RANK = 1e-12
LARGEST = 2**30
#: Rows that are folded into a task's triangle at once.
BLOCK = 4096
EPS = np.finfo(np.float64).eps


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: exact integers, or doubles of Python's integers where 64 bits don't do."""
    if n * (LARGEST + OFFSET) < 2**62:
        return n * x - np.array(sums, np.int64)
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.float64)
    return (x - whole).astype(np.float64) * n - rest


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square upper triangle R of a QR decomposition, filled up with zeros."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a square matrix, largest first.

    Columns are rotated in pairs until each two are orthogonal to rounding.
    """
    a, v = r.copy(), np.eye(r.shape[1])
    d = a.shape[1]
    for _ in range(sweeps):
        turned = False
        for i in range(d - 1):
            for j in range(i + 1, d):
                alpha, beta, gamma = a[:, i] @ a[:, i], a[:, j] @ a[:, j], a[:, i] @ a[:, j]
                if gamma == 0 or abs(gamma) <= d * EPS * np.sqrt(alpha * beta):
                    continue
                turned = True
                zeta = (beta - alpha) / (2 * gamma)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                turn = np.array([[c, c * t], [-c * t, c]])
                a[:, [i, j]], v[:, [i, j]] = a[:, [i, j]] @ turn, v[:, [i, j]] @ turn
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def _rows(batch: pa.RecordBatch, n: int, sums: list[int]) -> Iterator[np.ndarray]:
    """The centred rows of a batch as doubles, a block at a time."""
    x = integers(_matrix(batch.column("embedding"), np.float64))
    for at in range(0, len(x), BLOCK):
        yield centred(x[at : at + BLOCK], n, sums) / n


def _triangles(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, len(sums)))
        for batch in batches:
            for rows in _rows(batch, n, sums):
                r = triangle(np.vstack([r, rows]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["block", "r"])

    return run


def _stack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One triangle of a group's triangles."""
    d = int(len(pdf["r"].iloc[0]) ** 0.5)
    ordered = pdf.sort_values("block")
    r = triangle(np.vstack([np.asarray(x).reshape(d, d) for x in ordered["r"]]))
    return pd.DataFrame({"block": [int(ordered["group"].iloc[0])], "r": [r.ravel()]})


def common_triangle(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows: dims * dims numbers."""
    level = written(rows.mapInArrow(_triangles(n, sums), "block long, r array<double>"), "triangles")
    most = level.agg(F.max("block")).first()[0]
    while most:  # one group of FAN less at every level, the last has one triangle
        level = level.withColumn("group", F.col("block").cast("long") - F.pmod("block", F.lit(FAN))).withColumn("group", (F.col("group") / FAN).cast("long"))
        level = level.groupBy("group").applyInPandas(_stack, "block long, r array<double>")
        most //= FAN
    r = np.array(level.first()["r"])
    d = len(sums)
    return r.reshape(d, d)


def whiten_rows(x: np.ndarray, n: int, sums: list[int], matrix: np.ndarray) -> np.ndarray:
    return (centred(x, n, sums) / n) @ matrix


def _products(n: int, sums: list[int], matrix: np.ndarray):
    """Sums of whitened components and of their products, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = matrix.shape[1]
        total, seen = np.zeros((k + 1, k)), 0
        for batch in batches:
            if batch.num_rows:
                w = whiten_rows(integers(_matrix(batch.column("embedding"), np.float64)), n, sums, matrix)
                total += np.vstack([w.T @ w, w.sum(axis=0)])
                seen += len(w)
        if seen:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    return run


def identity_error(rows: DataFrame, n: int, sums: list[int], matrix: np.ndarray) -> float:
    """The largest absolute entry of the whitened covariance less the identity."""
    k = matrix.shape[1]
    added = rows.mapInArrow(_products(n, sums, matrix), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1) * k)
    for r in added:  # (components + 1) * components rows
        total[r["i"]] = r["v"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def deviations(centre: np.ndarray) -> pa.Array:
    """The sum of squares of each row of n * x - S; null where a long doesn't hold it."""
    about = (centre.astype(np.float64) ** 2).sum(axis=1)
    fits = about < 2.0**62
    if centre.dtype == np.int64:
        exact = (np.where(fits[:, None], centre, 0) ** 2).sum(axis=1)
        for i in np.flatnonzero(~fits & (about < 2.0**63.5)):
            whole = sum(int(v) ** 2 for v in centre[i])
            if whole < 2**63:
                exact[i], fits[i] = whole, True
        return pa.array(exact, pa.int64(), mask=~fits)
    return pa.array(np.zeros(len(centre), np.int64), mask=np.ones(len(centre), bool))


def _whitened(n: int, sums: list[int], matrix: np.ndarray, explained: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = matrix.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = integers(_matrix(part.column("embedding"), np.float64))
                owner = pa.array(np.repeat(np.arange(len(x)), k))
                out = [
                    part.column("vec_id").take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                    deviations(centred(x, n, sums)).take(owner), pa.array(whiten_rows(x, n, sums, matrix).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows a task has and their integers' sums, as one row."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = integers(_matrix(batch.column("embedding"), np.float64))
            total = x.sum(axis=0) + (0 if total is None else total)
            n += len(x)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1)), pa.array([n, *total.tolist()], pa.int64())], names=["i", "v"])


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row of OUT for every kept row of (vec_id, embedding) and component."""
    slim = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows, d = of_one_length(finite_vectors(slim))
    empty = df.sparkSession.createDataFrame([], OUT)
    if not d:
        return empty
    added = {r["i"]: int(r["v"]) for r in rows.mapInArrow(_sums, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()}  # dims + 1 rows
    n, sums = added[0], [added[i + 1] for i in range(d)]
    sigma, axes = jacobi(common_triangle(rows, n, sums))
    k = min(components, int((sigma > RANK * sigma[0]).sum()) if sigma[0] else 0)
    if not k:
        return empty
    matrix = axes[:, :k] * (np.sqrt(n) / sigma[:k])
    explained = sigma[:k] ** 2 / (sigma**2).sum()
    error = identity_error(rows, n, sums, matrix)
    return rows.mapInArrow(_whitened(n, sums, matrix, explained, error), OUT)
