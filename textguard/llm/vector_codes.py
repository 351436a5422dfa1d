"""Vector compression to codes of nearest codebook entries, by Hamerly's Lloyd.

Components become integers floor(1024 * x). A vector is cut into PARTS equal
parts; the codebook of each part position starts as that part of the ENTRIES
least vec_ids and is fitted by ROUNDS rounds of Lloyd's algorithm over all
vectors, in integers, so that results do not depend on the order of sums.

Each part carries its entry, one upper bound of the distance to it and one lower
bound of the distance to any other. Entries that move loosen both. A part is
compared with all entries only if its upper bound, once made exact, is not
strictly below the lower bound and below half the way from its entry to the next
one; where it is strictly below, its entry is the only nearest one, so that ties
go to the lower index as by a full scan. Bounds are kept a little too wide, by
more than their rounding.

Each round is one pass that writes the vectors with their bounds and one
aggregation to sums of entries, combined in the tasks. What reaches the driver is
bounded by PARTS * ENTRIES * components of a part: the codebooks themselves.

Defined cases: vectors that are null, are empty, or hold a null or a component
that is not finite are dropped, and so are those of another length than the
first kept row's; a length that PARTS doesn't divide is filled up with zeros;
integers beyond LARGEST count as LARGEST, so that squared distances stay within
64 bits; under ENTRIES vectors give as many entries; rows that repeat a vec_id
are vectors each by itself, the start takes them in the order of id, vector and
label; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import discard, written
from textguard.llm.shingles import list_array

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LARGEST = 2**27
#: How much bounds are widened, far above the rounding of a root and a sum.
SLACK = 1e-9
STATE = "vec_id long, label int, x array<int>, code array<int>, upper array<double>, lower array<double>"


def finite_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is not null or empty and has finite components only."""
    v = F.col(column)
    kept = df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return kept


def of_one_length(df: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows whose vector is as long as the first one's in the order of vec_id, and that length (0: no row)."""
    least = df.agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id"), F.size(column).alias("d"))).alias("least")).first()["least"]
    d = least["d"] if least else 0
    return df.where(F.size(column) == d), d


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The squared distances of all rows to all entries, exact."""
    largest = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * largest**2 < 2**53:  # every number on the way is an integer that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def own_squared(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((x - entries[code]) ** 2).sum(axis=1)


def half_gaps(entries: np.ndarray) -> np.ndarray:
    """Half the distance from each entry to its nearest other one."""
    out = np.full(len(entries), np.inf)
    if len(entries) > 1:
        d = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries]).astype(np.float64)
        np.fill_diagonal(d, np.inf)
        out = np.sqrt(d.min(axis=1)) / 2
    return out * (1 - SLACK)


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry moved, and how far at most any other one."""
    far = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
    others = np.full(len(far), far.max(initial=0))
    if len(far):
        top = int(far.argmax())
        others[top] = np.delete(far, top).max(initial=0)
    return far, others


def reassign(x: np.ndarray, entries: np.ndarray, half: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Sets code, upper and lower of each part to its nearest entry; how many were compared with all."""
    bound = np.maximum(lower, half[code])
    at = np.flatnonzero(upper >= bound)
    if len(at):
        upper[at] = np.sqrt(own_squared(x[at], entries, code[at]).astype(np.float64)) * (1 + SLACK)
        at = at[upper[at] >= bound[at]]
    for part in np.array_split(at, max(1, len(at) // 4096)):
        if len(part):
            d = squared(x[part], entries)
            best = d.argmin(axis=1)  # the lowest index of the least
            rows = np.arange(len(part))
            code[part], upper[part] = best, np.sqrt(d[rows, best].astype(np.float64)) * (1 + SLACK)
            d[rows, best] = np.iinfo(np.int64).max
            lower[part] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK) if len(entries) > 1 else np.inf
    return len(at)


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) within LARGEST, filled up to a multiple of PARTS."""
    x = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))


def _state(vec_id: pa.Array, label: pa.Array, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    n = len(x)
    lists = [list_array(np.ascontiguousarray(v).ravel(), np.full(n, v.shape[1]), kind) for v, kind in ((x, pa.int32()), (code, pa.int32()), (upper, pa.float64()), (lower, pa.float64()))]
    return pa.RecordBatch.from_arrays([vec_id, label, *lists], names=["vec_id", "label", "x", "code", "upper", "lower"])


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The integers of all vectors, with bounds that hold of nothing yet."""
    for batch in batches:
        if batch.num_rows:
            x = integers(_matrix(batch.column("embedding"), np.float64))
            n = len(x)
            yield _state(batch.column("vec_id"), batch.column("label"), x, np.zeros((n, PARTS)), np.full((n, PARTS), np.inf), np.zeros((n, PARTS)))


def _assign(books: np.ndarray, old: np.ndarray | None):
    """Moves the bounds from the ``old`` codebooks to ``books`` and reassigns. With
    ``old`` None, no bounds are known."""
    half = [half_gaps(b) for b in books]
    moved = [moves(o, b) for o, b in zip(old, books, strict=True)] if old is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), np.int64)
            code, upper, lower = (_matrix(batch.column(c), k) for c, k in (("code", np.int64), ("upper", np.float64), ("lower", np.float64)))
            parts = x.reshape(len(x), PARTS, -1)
            for p in range(PARTS):
                c, u, w = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                if moved is not None:
                    far, others = moved[p]
                    u, w = (u + far[c]) * (1 + SLACK), np.maximum(w - others[c], 0) * (1 - SLACK)
                reassign(parts[:, p], books[p], half[p], c, u, w)
                code[:, p], upper[:, p], lower[:, p] = c, u, w
            yield _state(batch.column("vec_id"), batch.column("label"), x, code, upper, lower)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part position and entry, the count and the component sums of a task's parts."""
    total: np.ndarray | None = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"), np.int64)
            code = _matrix(batch.column("code"), np.int64) + np.arange(PARTS) * ENTRIES
            parts = x.reshape(len(x) * PARTS, -1)
            if total is None:
                total = np.zeros((PARTS * ENTRIES, parts.shape[1] + 1), np.int64)
            order = np.argsort(code.ravel(), kind="stable")
            key = code.ravel()[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total[key[at], 1:] += np.add.reduceat(parts[order], at)
            total[key[at], 0] += np.diff(np.append(at, len(key)))
    if total is not None:
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), list_array(total[used].ravel(), np.full(len(used), total.shape[1]), pa.int64())], names=["entry", "sums"])


def entry_sums(state: DataFrame, width: int) -> list:
    """The total count and sums of every used entry: PARTS * ENTRIES rows at most."""
    rows = state.select("x", "code").mapInArrow(_sums, "entry long, sums array<long>")
    return rows.groupBy("entry").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width + 1)]).alias("sums")).collect()


def fit(state: DataFrame, start: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(the vectors with their final codes, written; the final codebooks)."""
    books, old = start, None
    for k in range(ROUNDS + 1):
        new = written(state.mapInArrow(_assign(books, old), STATE), "codes")
        discard(state)
        state = new
        if k < ROUNDS:
            old, books = books, books.copy()
            for r in entry_sums(state, books.shape[2]):
                n, *sums = r["sums"]
                books[r["entry"] // ENTRIES, r["entry"] % ENTRIES] = [s // n for s in sums]
    return state, books


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = _matrix(batch.column("x"), np.int64).reshape(batch.num_rows, PARTS, -1)
                code = _matrix(batch.column("code"), np.int64)
                error = sum(own_squared(parts[:, p], books[p], code[:, p]) for p in range(PARTS))
                text = [bytes(c).hex() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compress(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of (vec_id, embedding, label)."""
    slim = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept, d = of_one_length(finite_vectors(slim))
    if not d:
        return slim.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    state = written(kept.mapInArrow(_start, STATE), "vectors")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "x", "label").limit(ENTRIES).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    state, books = fit(state, start)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = state.select("vec_id", "label", "x", "code").mapInArrow(_codes(books), "vec_id long, label int, code string, error long")
    # written, so that Spark knows the size when it chooses how to join
    labels = written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
