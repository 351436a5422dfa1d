"""Operators that carry state from one micro-batch to the next.

Each has a batch twin in ``operators.state`` with the same rows for the same
events. Rows reach a key in any order within the watermark's delay: they wait in
the key's state until the watermark has passed them and are then taken in order of
their time, so that a result does not depend on how events fell into batches. What
is later than the watermark allows is dropped by Spark. State and timers are in the
checkpoint, so that a query that starts again accepts nothing twice.

State is kept in RocksDB, which keyed state with timers needs; ``stateful_session``
sets it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

AT = "_at_us"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """``spark`` with the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


class InOrder(StatefulProcessor):
    """Hands on the rows of a key in order of their time, when the watermark has passed
    them. A timer stands at the earliest row that waits and where ``step`` asks for one."""

    def __init__(self, pending: T.StructType, out: T.StructType) -> None:
        self.kind, self.row = pending, Row(*out.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.kind)

    def wake(self, at_us: int) -> None:
        self.handle.registerTimer(at_us // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[f] for f in self.kind.names) for r in rows]
        self.pending.appendList(new)
        self.wake(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.pending.get()]
        rest = [r for r in held if r[0] > now_us]
        if len(rest) < len(held):
            self.pending.put(rest) if rest else self.pending.clear()
        if rest:
            self.wake(min(r[0] for r in rest))
        yield from self.step(key, sorted((r for r in held if r[0] <= now_us), key=self.order), now_us)

    def order(self, row: tuple) -> tuple:
        """Equal times fall as the other columns sort; nulls first."""
        return tuple((x is not None, x) for x in row)

    def step(self, key: Any, rows: list[tuple], now_us: int) -> Iterator[Row]:
        """What follows from the next rows of a key; none of a time up to ``now_us`` will come."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class RateLimiter(InOrder):
    def __init__(self, pending: T.StructType, out: T.StructType, limit: int, window_ms: int) -> None:
        super().__init__(pending, out)
        self.limit, self.window_us = limit, window_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getListState("accepted", T.StructType([T.StructField("at", T.LongType())]))

    def step(self, key: Any, rows: list[tuple], now_us: int) -> Iterator[Row]:
        had = [r[0] for r in self.accepted.get()] if self.accepted.exists() else []
        log = deque(had)
        for r in rows:
            while log and r[0] - log[0] >= self.window_us:
                log.popleft()
            ok = len(log) < self.limit
            if ok:
                log.append(r[0])
            yield self.row(*key, *r, ok)
        while log and now_us - log[0] >= self.window_us:  # nothing that comes can be that old
            log.popleft()
        if log and list(log) != had:
            self.accepted.put([(t,) for t in log])
            self.wake(log[-1] + self.window_us)
        elif had and not log:
            self.accepted.clear()


class Bursts(InOrder):
    """Rows are (time, value, gap in ms)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        fields = [("ended", T.LongType()), ("gap", T.LongType()), ("n", T.LongType()), ("value", self.kind["value"].dataType)]
        self.open = handle.getValueState("open", T.StructType([T.StructField(n, t) for n, t in fields]))

    def step(self, key: Any, rows: list[tuple], now_us: int) -> Iterator[Row]:
        burst = tuple(self.open.get()) if self.open.exists() else None
        for at, value, gap in rows:
            if burst and at - burst[0] > burst[1] * 1000:
                yield self.row(*key, burst[0], burst[2], burst[3])
                burst = None
            burst = (at, gap, burst[2] + 1 if burst else 1, value)
        if burst and now_us >= burst[0] + burst[1] * 1000:  # what comes is beyond the gap
            yield self.row(*key, burst[0], burst[2], burst[3])
            burst = None
        if burst:
            self.open.update(burst)
            self.wake(burst[0] + burst[1] * 1000)
        else:
            self.open.clear()


class CurrentScans(StatefulProcessor):
    """Rows are (arrival, version, kind, mark of the text, n_findings)."""

    def __init__(self, out: T.StructType) -> None:
        self.row = Row(*out.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [("version", T.LongType()), ("mark", T.StringType()), ("n", T.LongType())]
        self.known = handle.getValueState("known", T.StructType([T.StructField(n, t) for n, t in fields]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        version, mark, n = tuple(self.known.get()) if self.known.exists() else (None, None, None)
        for r in sorted(rows, key=lambda r: r["arrival"]):
            stale = r["kind"] == "result" and version is not None and r["version"] < version
            if r["kind"] != "input" and not stale:
                same = r["kind"] == "result" and mark is not None and r["mark"] == mark
                if not same:
                    mark, n = r["mark"], r["n_findings"]
                yield self.row(*key, r["arrival"], r["version"], "unchanged" if same else "complete", n)
            version = r["version"] if version is None else max(version, r["version"])
        self.known.update((version, mark, n))

    def close(self) -> None:
        pass


def _with(df: DataFrame, names: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in names], *[T.StructField(n, t) for n, t in more]])


def rate_limited_stream(events: DataFrame, key: str, at: str, limit: int = 60, window_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """The events of a stream (``key``, a timestamp ``at``, other columns) with accepted, and
    ``at`` as _at_us: at most ``limit`` accepted events of a key in any window; those refused
    don't count. The twin of ``state.rate_limited``."""
    others = [c for c in events.columns if c not in (key, at)]
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).withColumn(AT, F.unix_micros(at))
    pending = _with(rows, [AT, *others])
    out = _with(rows, [key, AT, *others], ("accepted", T.BooleanType()))
    return rows.groupBy(key).transformWithState(RateLimiter(pending, out, limit, window_ms), out, "append", "EventTime")


def debounced_by_gap_stream(events: DataFrame, key: str, at: str, value: str, gap_ms: Column | int, late: str = "10 seconds") -> DataFrame:
    """key, ended_us, n_events, last_value: a row for each burst of a key's events, when the
    watermark has passed its end. An event's own gap replaces the one that runs: a paste
    after typing cuts the wait short. The twin of ``state.debounced``."""
    gap = gap_ms if isinstance(gap_ms, Column) else F.lit(gap_ms)
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = rows.select(key, at, F.unix_micros(at).alias(AT), F.col(value).alias("value"), gap.cast("long").alias("gap"))
    pending = _with(rows, [AT, "value", "gap"])
    out = _with(rows, [key], ("ended_us", T.LongType()), ("n_events", T.LongType()), ("last_value", rows.schema["value"].dataType))
    return rows.groupBy(key).transformWithState(Bursts(pending, out), out, "append", "EventTime")


def current_scans_stream(rows: DataFrame, key: str) -> DataFrame:
    """key, arrival, version, status, n_findings: the scans of a stream that still count.

    ``rows`` has key, arrival (a number that grows with the rows), version, kind, text and
    n_findings: see ``state.current_scans``, the twin. A key's state is one row: the texts
    themselves are not kept."""
    slim = rows.select(key, F.col("arrival").cast("long").alias("arrival"), F.col("version").cast("long").alias("version"), "kind", F.sha2(F.coalesce("text", F.lit("")), 256).alias("mark"), F.col("n_findings").cast("long").alias("n_findings"))
    out = _with(slim, [key, "arrival", "version"], ("status", T.StringType()), ("n_findings", T.LongType()))
    return slim.groupBy(key).transformWithState(CurrentScans(out), out, "append", "None")
