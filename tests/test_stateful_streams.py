"""Streams with state against their batch twins, in micro-batches of any make-up."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textguard.operators import state
from textguard.streaming import stateful

BEGIN = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def session(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield stateful.stateful_session(spark)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def events(seed, n=240):
    r = random.Random(seed)
    rows = [(i, f"u{r.randrange(4)}", BEGIN + timedelta(milliseconds=r.randrange(60_000)), r.choice(["typing", "paste"])) for i in range(n)]
    r.shuffle(rows)
    return rows


def written(spark, path, rows, batches):
    """A file a micro-batch; the last one's row moves the watermark beyond all others."""
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], KIND).coalesce(1).write.mode("append").parquet(path)
    return path


KIND = "event_id long, user string, ts timestamp, kind string"


def end(spark, path):
    rows = [(-1, "end", BEGIN + timedelta(days=1), "typing")]
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def run(spark, df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def stream(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limit_over_shuffled_batches_and_a_restart(session, tmp_path, seed):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = events(seed)
    made = lambda: stateful.rate_limited_stream(stream(session, path), "user", "ts", 3, 5_000, "2 minutes")
    written(session, path, rows[:120], 3)
    run(session, made(), out, mark)
    written(session, path, rows[120:], 3)  # the query starts again from its checkpoint
    end(session, path)
    found = run(session, made(), out, mark).where("user <> 'end'").collect()
    batch = session.createDataFrame(rows, KIND).withColumn("at_ms", F.unix_micros("ts") / 1000).select("event_id", "user", "at_ms", "kind")
    expected = {r["event_id"]: r["accepted"] for r in state.rate_limited(batch, "user", "at_ms", 3, 5_000).collect()}
    assert len(found) == len(rows) and {r["event_id"]: r["accepted"] for r in found} == expected
    assert {True, False} == set(expected.values())


def test_state_of_idle_clients_goes(session, tmp_path):
    """A client whose accepted events are older than a window starts anew."""
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = [(i, "a", BEGIN + timedelta(seconds=s), "typing") for i, s in enumerate([0, 1, 2, 3, 100, 101, 102])]
    written(session, path, rows, 7)
    end(session, path)
    found = run(session, stateful.rate_limited_stream(stream(session, path), "user", "ts", 2, 10_000, "1 second"), out, mark).where("user = 'a'")
    assert {r["event_id"]: r["accepted"] for r in found.collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


@pytest.mark.parametrize("seed", [3, 4])
def test_bursts_with_a_gap_of_each_event(session, tmp_path, seed):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    gap = F.when(F.col("kind") == "paste", 100).otherwise(1_500)
    written(session, path, events(seed), 4)
    end(session, path)
    found = run(session, stateful.debounced_by_gap_stream(stream(session, path), "user", "ts", "kind", gap, "2 minutes"), out, mark)
    batch = state.debounced(session.read.parquet(path), "user", "ts", "kind", gap).select("user", F.unix_micros("ended").alias("ended_us"), "n_events", "last_value")
    rows = lambda df: sorted(tuple(r) for r in df.where("user <> 'end'").collect())
    assert rows(found) == rows(batch) and any(r[2] > 1 for r in rows(batch))


def test_a_paste_cuts_the_wait_short(session, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    gap = F.when(F.col("kind") == "paste", 100).otherwise(1_500)
    at = lambda ms: BEGIN + timedelta(milliseconds=ms)
    written(session, path, [(0, "a", at(0), "typing"), (1, "a", at(1_000), "paste"), (2, "a", at(1_500), "typing")], 3)
    end(session, path)
    found = run(session, stateful.debounced_by_gap_stream(stream(session, path), "user", "ts", "kind", gap), out, mark).where("user = 'a'").collect()
    assert sorted((r["n_events"], r["last_value"]) for r in found) == [(1, "typing"), (2, "paste")]


SCANS = "user string, arrival long, version long, kind string, text string, n_findings long"


def test_current_scans_of_versions_out_of_order(session, tmp_path):
    r = random.Random(5)
    rows = [(f"u{r.randrange(3)}", i, max(0, i // 4 + r.randrange(-3, 3)), r.choice(["input", "result", "result", "result", "final"]), r.choice(["a", "b", None]), r.randrange(5)) for i in range(200)]
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    made = lambda: stateful.current_scans_stream(session.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(path), "user")
    for k in range(0, 200, 40):
        part = rows[k : k + 40]
        r.shuffle(part)  # within a batch, arrival tells
        session.createDataFrame(part, SCANS).coalesce(1).write.mode("append").parquet(path)
        if k == 80:
            run(session, made(), out, mark)
    found = sorted(tuple(x) for x in run(session, made(), out, mark).collect())
    assert found == sorted(tuple(x) for x in state.current_scans(session.createDataFrame(rows, SCANS), "user").collect())
    # and a plain loop
    known, expected = {}, []
    for user, arrival, version, kind, text, n in sorted(rows, key=lambda x: x[1]):
        s = known.setdefault(user, {"version": -1, "text": None, "n": None, "any": False})
        if kind == "final" or kind == "result" and version >= s["version"]:
            same = kind == "result" and s["any"] and (text or "") == s["text"]
            if not same:
                s.update(text=text or "", n=n, any=True)
            expected.append((user, arrival, version, "unchanged" if same else "complete", s["n"]))
        s["version"] = max(s["version"], version)
    assert found == sorted(expected) and {x[3] for x in found} == {"unchanged", "complete"}


def test_a_final_scan_always_counts(session):
    rows = [("a", 1, 1, "final", "same text", 2), ("a", 2, 1, "final", "same text", 3), ("a", 3, 1, "result", "same text", 9), ("a", 4, 5, "input", "x", 0), ("a", 5, 4, "result", "y", 1), ("a", 6, 3, "final", "y", 1)]
    found = state.current_scans(session.createDataFrame(rows, SCANS), "user").orderBy("arrival").collect()
    assert [(r["arrival"], r["status"], r["n_findings"]) for r in found] == [(1, "complete", 2), (2, "complete", 3), (3, "unchanged", 3), (6, "complete", 1)]
