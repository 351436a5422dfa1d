"""Golden cases of URL paths and of whole JSON objects."""

import base64

import pytest
from pyspark.sql import functions as F

from textguard.functions.urls import normal_path
from textguard.operators import detect
from textguard.operators.structured import is_json_object, is_whole_object

PATHS = [
    ("", ""), ("/", "/"), ("/app", "/app"), ("/a/./b/../c", "/a/c"), ("/..", "/"), ("/../..", "/"), ("/.", "/"), ("/a/..", "/"), ("/a/b/..", "/a/"), ("/a/.", "/a/"), ("//", "//"), ("//..", "/"),
    ("/a//../b", "/a/b"), ("/%2e%2E/x", "/x"), ("/.%2e/x", "/x"), ("/%2E/x", "/x"), ("/...", "/..."), ("/..a/.b", "/..a/.b"), ("/a%20b", "/a%20b"), ("/é", "/%C3%A9"), ("/日/😀", "/%E6%97%A5/%F0%9F%98%80"),
    ("/{x}`", "/%7Bx%7D%60"), ("/a b", "/a%20b"), ("/a|b~c[1]", "/a|b~c[1]"), ("/a;b=c,d@e:f!$&'()*+", "/a;b=c,d@e:f!$&'()*+"), ("/\x7f", "/%7F"), ("/%zz", "/%zz"), ("/a/\\../b", "/a/\\../b"),
]


def test_paths(spark):
    df = spark.createDataFrame([*PATHS, (None, None)], "path string, expected string")
    for r in df.select("*", normal_path(F.col("path")).alias("found")).collect():
        assert r["found"] == r["expected"], r["path"]


def test_paths_of_database_urls(spark):
    d = next(d for d in detect.DETECTORS if d.key == "detect_db_url")
    df = spark.createDataFrame([(1, "use postgres://svc:Zx81kkQw9@db.corp:05432/a/../b/./c%20é now"), (2, "use redis://svc:Zx81kkQw9@db.corp/x/../ now")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in detect.detect(df, d).collect()}
    assert rows[1]["replacement_value"] == "postgres://[USER]:[PASSWORD]@[HOST]:5432/b/c%20%C3%A9"
    assert rows[2]["replacement_value"] == "redis://[USER]:[PASSWORD]@[HOST]/" and not rows[2]["masked_preview"].endswith("/[DATABASE]")


OBJECTS = [
    ('{"a": 1}', True), (' {"a": [1, {"b": null}]}\n', True), ("{}", True), ('{"a": "}] {"}', True), ("", False), ("null", False), ("[{}]", False), ('"{}"', False), ("{", False),
    ('{"a": 1} x', False), ('{"a": 1}{"b": 2}', False), ('{"a": 1},{"b": 2}', False), ('{"a": 1},"b": 2', False), ('{"a": 1}] [{"b": 2}', False), ('{"a": 1}} {"b": {}', False), ("{'a': 1}", False),
    ("{a: 1}", False), ('{"a": 1,}', False), ('{"a": 01}', False), ('{"a": NaN}', False), ("x{}", False), ('{"a": 1}]', False), ('{"a": 1}}', False), ('{"a": 1}, null', False),
]


@pytest.mark.parametrize("coded", [False, True])
def test_whole_objects(spark, coded):
    rows = [(base64.urlsafe_b64encode(t.encode()).decode().rstrip("=") if coded else t, ok) for t, ok in OBJECTS]
    df = spark.createDataFrame([*rows, (None, False)], "t string, ok boolean")
    for r in df.select("*", (is_json_object if coded else is_whole_object)(F.col("t")).alias("found")).collect():
        assert r["found"] == r["ok"], r["t"]
