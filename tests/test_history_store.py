"""Clean-up and deletes of stored history leave other partitions' files as they are."""

import glob
import os

from textguard.operators.state import DAY_MS
from textguard.sources import history_store as store

NOW = 1_704_067_200_000 + 5 * 3_600_000  # five hours into a day
KIND = "id string, timestamp long, site string"


def filled(spark, path):
    rows = [(f"e{i}", NOW - i * DAY_MS // 4, "site-a") for i in range(80)] + [("edge", NOW - 7 * DAY_MS, "site-b"), ("before", NOW - 7 * DAY_MS - 1, "site-b")]
    store.append(spark.createDataFrame(rows, KIND), path)
    return {r[0]: r[1] for r in rows}


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/day=*/*.parquet")}


def ids(spark, path):
    return {r["id"] for r in store.read(spark, path).collect()}


def test_retention_drops_days_and_rewrites_one(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = filled(spark, path)
    before = files(path)
    store.clean(spark, path, NOW, None)
    assert files(path) == before
    store.clean(spark, path, NOW, 7)
    assert ids(spark, path) == {i for i, at in rows.items() if at >= NOW - 7 * DAY_MS} and "edge" in ids(spark, path)
    boundary = min(store.days(spark, path))
    assert {f for f in before if f.split("/")[0] > f"day={boundary}"} == {f for f in files(path) if f.split("/")[0] > f"day={boundary}"}
    after = files(path)
    store.clean(spark, path, NOW, 7)  # nothing is old any more: no file changes
    assert files(path) == after


def test_deletes_touch_their_days_only(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = filled(spark, path)
    before = files(path)
    one_day = [i for i, at in rows.items() if at // DAY_MS == (NOW - 3 * DAY_MS) // DAY_MS]
    gone = [*one_day, "e0", "unknown"]
    store.delete(spark, path, spark.createDataFrame([(i,) for i in gone], "id string"))
    assert ids(spark, path) == set(rows) - set(gone)
    touched = {rows[i] // DAY_MS for i in gone if i in rows}
    day = lambda f: f.split("/")[0][4:]
    names = {day(f) for f in before - files(path)}
    assert len(names) == len(touched) and not any(day(f) in names for f in before & files(path))
    store.delete(spark, path, spark.createDataFrame([("unknown",)], "id string"))


def test_clear_and_no_table(spark, tmp_path):
    path = str(tmp_path / "history")
    store.clear(spark, path)
    store.clean(spark, path, NOW, 7)
    store.delete(spark, path, spark.createDataFrame([("x",)], "id string"))
    assert store.days(spark, path) == []
    filled(spark, path)
    store.clear(spark, path)
    assert store.days(spark, path) == [] and files(path) == set()
