"""Mixing sources to target weights by a time-varying curriculum.

Training runs over positions from 0 to 1. Each source has a weight schedule
that changes linearly with the position and integrates to the source's weight.
A source's integral, scaled to its target, is its cumulative token demand; a
document that ends a source's first ``c`` tokens is placed where that demand
reaches ``c``. The demand is a quadratic, so the inverse is a closed form.
Documents are range-sorted by position at the end.

Sources are dealt in the order of their documents' MD5, so reruns agree. Prefix
sums within a source go by two levels: the sums of 4,096 hash ranges first, the
documents within a range next. No task holds a source.

Defined cases: a null text has size 0; a document of size 0 takes nothing and
has no position; null is a source of its own, last in order; rows repeated with
the same id and size take the same words in all; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.llm.common import words

#: Weights of the sources in order, repeating, and how steeply each falls
#: (or, negative, rises) from start to end of the training.
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2


def cycle(rank: Column, values: tuple[float, ...]) -> Column:
    """``values`` dealt in turn to ranks 0, 1, 2, ..."""
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: _key, source_size, target, slope.

    Sources share TOTAL_SHARE of all sizes by weight; none gets more than
    MOST_REPEATS times its size, and the excess goes to the others by weight.
    That is min(level * weight, cap) with one level for all. With the sources
    in order of cap / weight, those at their cap come first; what the caps
    leave, shared by the other weights, is the level.
    """
    per = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(1))
    # one row a source from here on
    per = per.withColumn("_rank", F.row_number().over(everything.orderBy("_key")) - 1)
    per = per.select("_key", "source_size", cycle(F.col("_rank"), WEIGHTS).alias("_w"), cycle(F.col("_rank"), SLOPES).alias("slope"))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(MOST_REPEATS)))
    per = per.withColumn("_total", F.sum("source_size").over(everything) * F.lit(TOTAL_SHARE))
    by_ratio = everything.orderBy(F.col("_cap") / F.col("_w"), "_key")
    before = F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("_cap")
    onward = F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("_full", F.col("_cap") / F.col("_w") <= (F.col("_total") - before) / onward)
    left = F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    rest = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(0.0)).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * left / rest)
    return per.select("_key", "source_size", F.round(target, 6).alias("target"), "slope")


def demand_position(u: Column, slope: Column) -> Column:
    """Where a source's cumulative demand t + a t (1 - t) reaches the share u."""
    root = F.sqrt(F.greatest((1 + slope) * (1 + slope) - 4 * slope * u, F.lit(0.0)))
    return F.when(slope == 0, u).otherwise(((1 + slope) - root) / (2 * slope))


def assign(docs: DataFrame, carry: list[Column] | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position,
    again_position (where the second pass over it lies; null without one), and
    the columns of ``carry``.

    A source's target is taken in whole passes over it and a last part of a
    pass, in which the document at the edge gives as many words as are due.
    """
    sized = docs.select(
        F.col("doc_id"),
        # null sources sort after all others
        F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")).alias("_key"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string"))).cast("binary")).alias("_hash"),
        F.xxhash64("text").alias("_text"),
        *(carry or []),
    ).withColumn("_range", F.substring("_hash", 1, 3))
    slim = sized.select("_key", "size", "_range")
    ranges = slim.groupBy("_key", "_range").agg(F.sum("size").alias("_sum"))
    ranges = ranges.withColumn("_before", F.sum("_sum").over(W.partitionBy("_key").orderBy("_range")) - F.col("_sum"))
    offsets = ranges.join(source_targets(slim), "_key")
    within = W.partitionBy("_key", "_range").orderBy("_hash", "doc_id", "size", "_text").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.withColumn("_upto", F.sum("size").over(within)).join(offsets.drop("_sum"), ["_key", "_range"])
    start = F.col("_before") + F.col("_upto") - F.col("size")
    due = F.round("target").cast("long")
    passes = F.least(F.floor(due / F.greatest(F.col("source_size"), F.lit(1))), F.lit(MOST_REPEATS)).cast("long")
    part = F.least(F.greatest(due - passes * F.col("source_size") - start, F.lit(0)), F.col("size"))
    placed = placed.withColumn("taken", (passes * F.col("size") + part).cast("long"))
    middle = start + F.col("size") / 2.0
    share = lambda done: F.least((done * F.col("source_size") + middle) / F.col("target"), F.lit(1.0))
    return placed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, F.round(demand_position(share(0), F.col("slope")), 9)).alias("position"),
        F.when(F.col("taken") > F.col("size"), F.round(demand_position(share(1), F.col("slope")), 9)).alias("again_position"),
        *[F.col(c) for c in placed.columns if c.startswith("_carry")],
    )


def mix(docs: DataFrame) -> DataFrame:
    """The assignment of all documents, range-sorted by training position."""
    return assign(docs).orderBy(F.col("position").asc_nulls_last())


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in training order: a row for each pass over a document
    that the mix takes, with the documents' own columns. A pass that takes only
    a document's first words holds the text up to the last of them."""
    out = assign(docs, [F.struct(*docs.columns).alias("_carry")])
    first = F.struct(F.col("position").alias("at"), F.least("taken", "size").alias("n"))
    second = F.struct(F.col("again_position").alias("at"), (F.col("taken") - F.col("size")).alias("n"))
    passes = out.withColumn("_pass", F.explode(F.array(first, second))).where("_pass.n > 0")
    passes = passes.orderBy("_pass.at", "doc_id", F.xxhash64("_carry.text"))
    whole = F.col("_pass.n") >= F.col("size")
    # pieces end where a word ends, so that joining some of them gives a prefix
    pieces = F.split("_carry.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(whole, F.col("_carry.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("_pass.n").cast("int")), ""))
    own = {c: F.col(f"_carry.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in own:
        own["n_chars"] = F.when(whole, F.col("_carry.n_chars")).otherwise(F.length(text)).cast("long")
    return passes.select(*[c.alias(name) for name, c in own.items()])
