"""The scanner as functions of SQL.

``register(spark)`` makes a table function of the session:

    SELECT d.doc_id, f.detector, f.start, f.`end` FROM docs AS d, LATERAL scan_text(d.text) AS f

Its body is the SQL of the same column expressions that the DataFrame form uses, so that
the optimiser sees through it: texts are read once, and no row is handed to Python but for
what may hold JSON.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textguard.operators import detect, structured

_TEXT_LITERAL = re.compile(r"('(?:\\.|[^'\\])*')", re.S)
#: Operators that a column writes as functions; SQL takes such names in back quotes.
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|!=|==|[-+*/%<>=!|&]|in|and|or|not)\(")
#: A plain number with a point is a decimal in SQL and a double in a column.
_DOUBLE = re.compile(r"(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])")


def column_sql(column: Column) -> str:
    """A column expression as SQL text that means the same."""
    parts = _TEXT_LITERAL.split(column._jc.node().sql())
    parts[::2] = [_DOUBLE.sub(r"\1D", _OPERATOR.sub(r"`\1`(", p)) for p in parts[::2]]
    return "".join(parts)


def register(spark: SparkSession, off: frozenset[str] = frozenset()) -> SparkSession:
    """Makes ``scan_text(content)`` a table function of the session: a row for each finding,
    as ``detect.scan`` gives; none for null. ``off`` names the switches that are off."""
    spark.udf.register("json_leaves_of", F.pandas_udf(structured._json_leaves, structured._LEAVES))
    on = [d for d in detect.DETECTORS if detect.SWITCHES.get(d.detector, "credentials") not in off]
    credentials = "credentials" not in off
    content = F.col("content")
    found = detect.findings(F.coalesce(content, F.lit("")), F.col("leaves") if credentials else None, on, credentials)
    leaves = column_sql(F.when(structured.may_hold_json(content), content))
    rows = f"SELECT explode({column_sql(found)}) AS f FROM (SELECT content, json_leaves_of({leaves}) AS leaves)"
    # the types are those of the DataFrame form
    fields = [f for f in detect.scan(spark.createDataFrame([], "doc_id long, text string"), off).schema if f.name != "doc_id"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = ", ".join(f"f.`{f.name}`" for f in fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION scan_text(content STRING) RETURNS TABLE ({kinds}) RETURN SELECT {names} FROM ({rows})")
    return spark
