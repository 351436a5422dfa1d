"""What follows detection: overlaps, rewriting, summaries.

A row has its text and all of its findings, so everything but the allowlist is
done within the row, without a shuffle; ids may be null or repeat.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import scalars as S
from textguard.functions.scalars import let, settled_row
from textguard.operators import semantic
from textguard.operators.detect import with_findings

#: Findings that are put into a text in one piece of work.
GROUP = 128
#: Findings of one text beyond which they are settled by sorted boundaries: island by
#: island, those of a long chain would each be compared with all that are kept.
MANY = 512


def ranked(x: Column) -> Column:
    """The order in which findings are settled: of a struct start, end, f (the finding)."""
    f = x["f"]
    return F.struct((-S.severity_rank(f["severity"])).alias("a"), (-f["confidence"]).alias("b"), (x["start"] - x["end"]).alias("c"), f["emission"].alias("d"), x["start"].alias("e"), x.alias("x"))


def placed(findings: Column) -> Column:
    return F.transform(findings, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x.alias("f")))


def accepted(findings: Column) -> Column:
    """A text's findings without those that overlap one of a higher severity,
    confidence, length or earlier emission, in this order; by start.

    Findings that overlap stand in one island, and islands are settled one by one.
    An island begins at the i-th finding by start if just the i findings before it
    end there or earlier.
    """
    by_start = F.array_sort(placed(findings))
    known = F.struct(by_start.alias("all"), F.array_sort(F.transform(findings, lambda x: x["end"])).alias("ends"), F.sequence(F.lit(0), F.size(findings) - 1).alias("at"))

    def islands(z: Column) -> Column:
        first = F.filter(z["at"], lambda i: (i == 0) | (F.get(z["ends"], i - 1) <= F.get(z["all"], i)["start"]))
        return let(F.struct(z["all"].alias("all"), first.alias("first")), lambda y: F.transform(y["first"], lambda b, k: F.slice(y["all"], b + 1, F.coalesce(F.get(y["first"], k + 1), F.size(y["all"])) - b)))

    def settled(island: Column) -> Column:
        in_turn = F.transform(F.array_sort(F.transform(island, ranked)), lambda x: x["x"])
        free = lambda acc, x: ~F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        kept = F.aggregate(in_turn, F.slice(island, 1, 0), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
        return F.when(F.size(island) == 1, island).otherwise(F.array_sort(kept))

    out = F.transform(F.flatten(F.transform(let(known, islands), settled)), lambda x: x["f"])
    return F.when(F.size(findings) > 1, out).otherwise(findings)


def free_of_overlap(starts: list[int], ends: list[int]) -> list[int]:
    """Which of the intervals, in the order given, overlap none before them that does not either.

    Those that are kept are apart, so the last of them that starts before an
    interval's end is the only one that can overlap it.
    """
    begins: list[int] = []
    stops: list[int] = []
    out = []
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        k = bisect_left(begins, b)
        if k == 0 or stops[k - 1] <= a:
            begins.insert(k, a)
            stops.insert(k, b)
            out.append(i)
    return out


def _free(bounds: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        both = list(map(int, text.split(",")))
        return ",".join(map(str, free_of_overlap(both[::2], both[1::2])))

    return pd.Series([one(x) for x in bounds], dtype=object)


def settled_findings(rows: DataFrame) -> DataFrame:
    """``rows`` with those of their findings that :func:`accepted` keeps, however many they are.

    Boundaries go to Python and back as text: a batch of arrays, most of them null,
    would be walked over again for each of its rows.
    """
    inner = rows.withColumn("_ranked", F.when(F.size("findings") > MANY, F.transform(F.array_sort(F.transform(placed(F.col("findings")), ranked)), lambda x: x["x"])))
    inner = settled_row(inner)
    bounds = F.array_join(F.transform("_ranked", lambda x: F.concat_ws(",", x["start"].cast("string"), x["end"].cast("string"))), ",")
    inner = settled_row(inner.withColumn("_free", F.pandas_udf(_free, "string")(bounds)))
    kept = F.transform(F.split("_free", ","), lambda i: i.cast("int"))
    many = F.transform(F.array_sort(F.transform(kept, lambda i: F.get("_ranked", i))), lambda x: x["f"])
    return inner.withColumn("findings", F.when(F.col("_free").isNull(), accepted(F.col("findings"))).otherwise(many)).drop("_ranked", "_free")


def resolved(docs: DataFrame, off: frozenset[str] = frozenset()) -> DataFrame:
    """``docs`` (with a column text) and findings: those of each text that stand."""
    return settled_row(settled_findings(settled_row(with_findings(docs, off))))


def exploded(rows: DataFrame) -> DataFrame:
    """A row for each finding: doc_id and the finding's fields."""
    return rows.select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")


def rewritten(text: Column, findings: Column, replacement: str) -> Column:
    """The text with each of its disjoint findings (by start) replaced.

    The text is cut into stretches of a group of findings each and these at the
    findings, so that a text of any length is passed over twice.
    """

    def stretch(z: Column, g: Column) -> Column:
        own = F.slice(z["f"], g * GROUP + 1, F.lit(GROUP))
        begin = F.when(g == 0, 0).otherwise(F.get(z["f"], g * GROUP - 1)["end"])
        known = F.struct(own.alias("own"), begin.alias("begin"), F.substring(text, begin + 1, F.get(own, F.size(own) - 1)["end"] - begin).alias("part"))

        def pieces(y: Column) -> Column:
            def one(f: Column, i: Column) -> Column:
                at = F.when(i == 0, y["begin"]).otherwise(F.get(y["own"], i - 1)["end"])
                return F.concat(F.substring(y["part"], at - y["begin"] + 1, f["start"] - at), f[replacement])

            return F.array_join(F.transform(y["own"], one), "")

        return let(known, pieces)

    groups = lambda z: F.sequence(F.lit(0), F.ceil(F.size(z["f"]) / GROUP).cast("int") - 1)
    rest = lambda z: F.substring(text, F.get(z["f"], F.size(z["f"]) - 1)["end"] + 1, F.length(text))
    whole = let(F.struct(findings.alias("f")), lambda z: F.concat(F.array_join(F.transform(groups(z), lambda g: stretch(z, g)), ""), rest(z)))
    return F.when(F.size(findings) > 0, whole).otherwise(text)


def redact(rows: DataFrame, replacement: str = "replacement_value") -> DataFrame:
    """doc_id, text: every row (text, findings), its findings replaced."""
    return rows.select("doc_id", rewritten(F.col("text"), F.col("findings"), replacement).alias("text"))


def placeholder(f: Column) -> Column:
    """The neutral value that stands for a finding."""
    detector, category = f["detector"], f["category"]
    # fixed values
    return (
        F.when(detector == "databaseUrl", F.concat(F.lower(F.substring_index(f["original_value"], "://", 1)), F.lit("://dummylink")))
        .when(detector == "email", "example@example.com")
        .when(detector == "phoneNumber", "202-555-0100")
        .when(detector == "internalHostname", "example.internal")
        .when(detector == "privateKey", "Example_Private_Key")
        .when(detector.isin("bearerToken", "githubToken", "stripeKey", "slackToken"), "Example_Token")
        .when(detector.isin("awsKey", "openAiKey", "anthropicKey"), "Example_API_Key")
        .when(category == "Session cookie", "Example_Cookie")
        .when(detector == "httpHeader", "Example_API_Key")
        .when(category == "Password", "Example_Password")
        .when(category == "API key", "Example_API_Key")
        .when(category == "Access token", "Example_Token")
        .when(category == "Private key value", "Example_Private_Key")
        .when(category == "Assigned secret", "Example_Secret")
        .when(detector == "semantic", semantic.placeholder(category))
        .otherwise("Example_Sensitive_Value")
    )


def with_placeholder(findings: DataFrame) -> DataFrame:
    """``findings`` (detector, category, original_value) and placeholder."""
    return findings.withColumn("placeholder", placeholder({c: F.col(c) for c in ("detector", "category", "original_value")}))


def usable(spots: Column, n: Column) -> Column:
    """The spots (start, end, safe) that can be replaced in a text of ``n`` characters, by
    start: within the text, safe, and of those that overlap the last by start."""
    inside = F.filter(spots, lambda x: (x["start"] >= 0) & (x["end"] > x["start"]) & (x["end"] <= n) & x["safe"])
    backwards = F.array_sort(F.transform(inside, lambda x, i: F.struct((-x["start"]).alias("a"), i.alias("i"), x.alias("x"))))
    first = F.struct(F.slice(spots, 1, 0).alias("kept"), F.lit(2**31 - 1).alias("at"))

    def step(acc: Column, y: Column) -> Column:
        x = y["x"]
        taken = F.struct(F.array_append(acc["kept"], x).alias("kept"), x["start"].cast("int").alias("at"))
        return F.when(x["end"] <= acc["at"], taken).otherwise(acc)

    return F.reverse(F.aggregate(backwards, first, step, lambda acc: acc["kept"]))


def safe_replaced(docs: DataFrame, scanner: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, text: findings replaced by placeholders, then what a second scan of the
    outcome still finds. Equal values of a text get one placeholder, that of the last
    of them; the second pass keeps to it.

    ``scanner`` adds the first pass's findings to rows (doc_id, text) in place of the
    detectors; semantic ones among them are narrowed, and those that aren't safe to
    replace, overlap or leave the text are passed over.
    """
    if scanner is None:
        found, safe = resolved(docs.select("doc_id", "text")), lambda x: F.lit(True)
    else:
        found = settled_row(scanner(docs.select("doc_id", "text")).select("doc_id", "text", "findings"))
        fields = found.schema["findings"].dataType.elementType.names
        safe = (lambda x: F.coalesce(x["replacement_safe"], F.lit(True))) if "replacement_safe" in fields else (lambda x: F.lit(True))

    def spot(x: Column, start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"), placeholder(x).alias("placeholder"), safe(x).alias("safe"))

    def narrow(x: Column) -> Column:
        at = F.when(x["detector"] == "semantic", semantic.narrowed(F.col("text"), x["start"], x["end"], x["category"]))
        at = F.coalesce(at, F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
        return let(at, lambda n: spot(x, n["start"], n["end"], F.substring(F.col("text"), n["start"] + 1, n["end"] - n["start"])))

    plain = lambda x: spot(x, x["start"], x["end"], x["original_value"])
    spots = lambda f: F.transform(f, plain)
    chosen = spots(F.col("findings")) if scanner is None else usable(F.transform("findings", narrow), F.length("text"))

    def replaced() -> Column:
        same = lambda x: F.coalesce(F.element_at(F.col("_memo"), x["value"]), x["placeholder"])
        return rewritten(F.col("text"), F.transform("_spots", lambda x: x.withField("placeholder", same(x))), "placeholder")

    first = settled_row(found.select("doc_id", "text", chosen.alias("_spots")))
    safe = lambda x: F.lit(True)
    # of equal values, the last
    in_order = F.array_sort(F.transform("_spots", lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), x["placeholder"].alias("placeholder"))))
    last = let(in_order, lambda z: F.filter(z, lambda x, i: ~F.get(z, i + 1)["value"].eqNullSafe(x["value"])))
    first = settled_row(first.withColumn("_memo", F.map_from_entries(F.transform(last, lambda x: F.struct(x["value"], x["placeholder"])))))
    once = settled_row(first.select("doc_id", replaced().alias("text"), "_memo", (F.size("_spots") > 0).alias("_touched")))
    # only what was touched is scanned again
    again = resolved(once.withColumnRenamed("text", "_once").withColumn("text", F.when(F.col("_touched"), F.col("_once"))))
    again = settled_row(again.select("doc_id", F.col("_once").alias("text"), "_memo", spots(F.col("findings")).alias("_spots")))
    return again.select("doc_id", replaced().alias("text"))


def summary(rows: DataFrame) -> DataFrame:
    """A row for each row (doc_id, findings) with findings: highest severity, confidence level,
    categories in order of first appearance (20 at most, as history keeps them), count."""
    f = F.col("findings")
    rank = F.array_max(F.transform(f, lambda x: S.severity_rank(x["severity"])))
    by_place = F.array_sort(F.transform(f, lambda x: F.struct(x["start"], x["emission"].alias("emission"), x["category"].alias("category"))))
    names = F.transform(by_place, lambda x: F.substring(F.trim(x["category"]), 1, 80))
    out = rows.where(F.size(f) > 0).select("doc_id", rank.alias("rank"), F.array_max(F.transform(f, lambda x: x["confidence"])).alias("c"), names.alias("names"), F.size(f).cast("long").alias("finding_count"))
    return out.select(
        "doc_id", F.element_at(F.array(*map(F.lit, S.SEVERITIES)), F.col("rank")).alias("severity"), S.confidence_level(F.col("c")).alias("confidence"),
        F.array_join(F.slice(F.array_distinct("names"), 1, 20), ",").alias("categories"), "finding_count",
    )


def allowed(findings: DataFrame, allowlist: DataFrame, salt: str) -> DataFrame:
    """The findings whose value is not on the allowlist of fingerprints. Spark
    broadcasts the list where its size allows and shuffles both sides otherwise."""
    marked = findings.withColumn("fingerprint", S.fingerprint(F.col("original_value"), salt))
    return marked.join(allowlist.select("fingerprint").distinct(), "fingerprint", "left_anti").drop("fingerprint")
