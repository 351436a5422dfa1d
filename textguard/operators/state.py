"""History, feedback, allowlists, counters and service checks as table operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.functions.scalars import settled_row

DAY_MS = 86_400_000


def retained(history: DataFrame, now_ms: int, days: int | None) -> DataFrame:
    """Events not older than ``days`` (the boundary stays); all if that is None."""
    return history if days is None else history.where(F.col("timestamp") >= now_ms - days * DAY_MS)


def newest_by_sequence(rows: DataFrame, sequence: str, n: int) -> DataFrame:
    """The last ``n`` rows in order of insertion: a top-n, of which each task keeps n rows."""
    return rows.orderBy(F.col(sequence).desc()).limit(n)


def session_counters(checks: DataFrame, at: str, warnings: str) -> DataFrame:
    """date, checks, warnings: one row a day."""
    w = F.greatest(F.lit(0), F.floor(F.coalesce(F.col(warnings), F.lit(0.0))))
    return checks.groupBy(F.date_format(at, "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("checks"), F.sum(w).cast("long").alias("warnings"))


def latest_by(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, by a combined aggregation."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("r"))
    return best.select(key, "r.*")


def debounced(events: DataFrame, key: str, at: str, value: str, gap_ms: int | Column) -> DataFrame:
    """A row for each burst of a key's events: its end, size and last value. Events that
    follow within ``gap_ms`` belong together; the gap may depend on the event before (a
    paste waits less than typing does). The batch twin of the streaming form. A key's
    events are one group of a window."""
    events = events.withColumn(at, F.col(at).cast("timestamp")).withColumn("_gap", gap_ms if isinstance(gap_ms, Column) else F.lit(gap_ms))
    order = W.partitionBy(key).orderBy(at, value)
    far = F.unix_micros(F.col(at)) - F.unix_micros(F.lag(at).over(order)) > F.lag("_gap").over(order) * 1000
    marked = events.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int"))
    marked = marked.withColumn("_burst", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = marked.groupBy(key, "_burst").agg(F.max(at).alias("ended"), F.count("*").alias("n_events"), F.max_by(value, F.struct(at, value)).alias("last_value"))
    return out.drop("_burst")


def changed_only(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The rows whose value differs from the same key's row before."""
    order = W.partitionBy(key).orderBy(*[F.col(c) for c in at.split(",")])
    return rows.withColumn("_was", F.lag(value).over(order)).where(~F.col(value).eqNullSafe(F.col("_was"))).drop("_was")


def current_scans(rows: DataFrame, key: str) -> DataFrame:
    """key, arrival, version, status, n_findings: the scans of a key's texts that still count.

    ``rows`` has key, arrival (its order), version, kind, text (null: empty) and n_findings.
    Every row raises the key's version. A ``result`` of an older version than one that arrived
    before is stale and dropped; one with the text of the last that counted is ``unchanged``
    and has that one's findings; a ``final`` always counts. An ``input`` only raises the version.
    """
    order = W.partitionBy(key).orderBy("arrival")
    before = F.max("version").over(order.rowsBetween(W.unboundedPreceding, -1))
    counted = rows.withColumn("_stale", (F.col("kind") == "result") & F.coalesce(F.col("version") < before, F.lit(False)))
    counted = counted.where("kind <> 'input' AND NOT _stale").withColumn("_mark", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = (F.col("kind") == "result") & F.coalesce(F.col("_mark") == F.lag("_mark").over(order), F.lit(False))
    counted = counted.withColumn("_n", F.when(~same, F.struct("n_findings"))).withColumn("status", F.when(same, "unchanged").otherwise("complete"))
    last = F.last("_n", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return counted.select(key, "arrival", "version", "status", last["n_findings"].cast("long").alias("n_findings"))


def merged_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (start, end, confidence) of a key merged where they overlap or touch."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"))
    return out.drop("_island")


def overlaps(rows: DataFrame, others: DataFrame, key: str, width: int = 64) -> DataFrame:
    """``rows`` and replacement_safe: false where one of ``others`` overlaps.

    Distinct intervals of both sides go into every bucket of ``width`` that they
    cover. In a bucket an interval overlaps another if, among those that start
    before its end, the furthest end is beyond its start. No key's intervals are
    gathered in one row, and no pairs are made.
    """
    ends = [F.col(key), F.col("start"), F.col("end")]

    def dealt(side: DataFrame, at: str, reach: Column, kind: int) -> DataFrame:
        side = side.select(*ends).distinct()
        buckets = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
        return side.select(*ends, F.explode(buckets).alias("_b"), F.col(at).alias("_at"), reach.alias("_reach"), F.lit(kind).alias("_kind"))

    both = dealt(rows, "end", F.lit(None), 0).unionByName(dealt(others, "start", F.col("end"), 1))
    order = W.partitionBy(key, "_b").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    hits = both.withColumn("_reach", F.max("_reach").over(order)).where("_kind = 0 AND _reach > start")
    hits = hits.select(*ends).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hits, [key, "start", "end"], "left").select(*[rows[c] for c in rows.columns], F.col("_hit").isNull().alias("replacement_safe"))


def token_chunks(rows: DataFrame, n: Column, size: int = 126, overlap: int = 24) -> DataFrame:
    """doc_id, chunk_idx, start, end: overlapping windows over ``n`` tokens."""
    stride = size - min(overlap, size - 1)
    counted = settled_row(rows.select("doc_id", n.cast("int").alias("_n"))).where("_n > 0")
    last = F.greatest(F.ceil((F.col("_n") - size) / F.lit(float(stride))), F.lit(0)).cast("int")
    out = counted.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    start = F.col("chunk_idx") * stride
    return out.select("doc_id", "chunk_idx", start.alias("start"), F.least(start + size, F.col("_n")).alias("end"))


def linear_head(vectors: DataFrame, labels: list[tuple[str, list[float], float, float]], vector: str = "embedding") -> DataFrame:
    """Label probabilities of unit vectors by a linear layer with a sigmoid, where
    they reach the label's threshold. The labels are a constant of the model. The
    products are divided by the norm once, not each of the vector's elements; a
    vector of norm 0 has the intercept alone."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    dot = lambda w: F.aggregate(F.zip_with(v, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    known = settled_row(vectors.select("vec_id", norm.alias("_norm"), *[dot(w).alias(f"_{i}") for i, (_, w, _, _) in enumerate(labels)]))
    z = lambda i, b: F.when(F.col("_norm") > 0, F.lit(b) + F.col(f"_{i}") / F.col("_norm")).otherwise(b)
    made = [F.struct(F.lit(n).alias("label"), F.round(1 / (1 + F.exp(-z(i, b))), 6).alias("confidence"), F.lit(t).alias("t")) for i, (n, _, b, t) in enumerate(labels)]
    rows = known.select("vec_id", F.explode(F.array(*made)).alias("l")).select("vec_id", "l.label", "l.confidence", "l.t")
    return rows.where(F.col("confidence") >= F.col("t")).drop("t")


def rate_limited(events: DataFrame, key: str, at_ms: str, limit: int = 60, window_ms: int = 60_000) -> DataFrame:
    """``events`` and accepted: at most ``limit`` accepted events of a key in any
    window; those refused don't count. Acceptance feeds back, so a key's events are
    walked in order, a batch at a time, with the last ``limit`` times as the state.
    Events of one key at one time are taken as the rest of their columns sorts. A key's
    events are one stream by nature and pass through one task, which holds no more than
    a batch and the state."""
    schema = events.withColumn("accepted", F.lit(True)).schema
    dealt = events.repartition(key).sortWithinPartitions(key, at_ms, *[c for c in events.columns if c not in (key, at_ms)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import deque

        now, log = None, deque()
        for pdf in batches:
            ok = []
            for k, t in zip(pdf[key], pdf[at_ms], strict=True):
                if k != now:
                    now, log = k, deque()
                while log and t - log[0] >= window_ms:
                    log.popleft()
                ok.append(len(log) < limit)
                if ok[-1]:
                    log.append(t)
            yield pdf.assign(accepted=ok)

    return dealt.mapInPandas(run, schema)


def payload_errors(p: DataFrame) -> DataFrame:
    """``p`` and error: the first rule that a feedback payload breaks, null if none."""
    scores_ok = F.forall(F.map_values("predicted_scores"), lambda s: (s >= 0) & (s <= 1))
    same = (F.size(F.array_except(F.map_keys("predicted_scores"), "predicted_labels")) == 0) & (
        F.size(F.array_except("predicted_labels", F.map_keys("predicted_scores"))) == 0
    )
    label_ok = F.forall("predicted_labels", lambda x: F.length(x).between(1, 80))
    error = (
        F.when(~F.length("text").between(1, 5000) | (F.trim("text") == ""), "text")
        .when(~F.size("predicted_labels").between(1, 20) | ~label_ok, "predicted_labels")
        .when(~scores_ok, "predicted_scores")
        .when(~same, "score_labels")
        .when(~F.col("feedback").isin("correct", "not_sensitive", "wrong_category"), "feedback")
    )
    return p.withColumn("error", error)
