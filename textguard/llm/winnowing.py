"""Benchmark decontamination by winnowing.

Texts are words of digits, letters and all beyond ASCII, A-Z lower-cased. Every
run of GRAM words has a 64-bit hash; of each SPREAD neighbouring hashes a text
keeps the least as fingerprints. Two texts that share WINDOW = GRAM + SPREAD - 1
words keep an equal fingerprint there, so none of an item's windows is missed.

Documents' fingerprints are joined with the items'. Around each that is equal,
the words themselves are compared, up to WINDOW - 1 on either side: fingerprints
of a shared stretch are at most SPREAD apart, so what they extend to covers all
of it, however long, and each costs the same few comparisons. A stretch of WINDOW
words or more is hit.

An item of under WINDOW words is one window. Its first GRAM words, or its first
word, are its fingerprint, and documents keep all theirs: this reading of the
texts is made only where the benchmark has such items.

Everything is DataFrame expressions. The documents' fingerprints are written
once, two of seven words' hashes; texts are read again for documents with an
equal fingerprint alone. Equal surroundings in many items are compared once.

Defined cases: a null or empty text has no word, as a document (no hit) and as
an item (no window); repeated documents are judged each by itself; rows of one
item_id are one item; a null item_id counts as the empty string; no item gives
documents without hits; an empty table of documents gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import written
from textguard.llm.shingles import with_row_id

GRAM = 5
SPREAD = 6
WINDOW = GRAM + SPREAD - 1
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """The words of a text as an array."""
    t = F.coalesce(text, F.lit(""))
    # ASCII alone: the same, faster
    lowered = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def with_grams(df: DataFrame) -> DataFrame:
    """``df``, which has _words, with _grams: the hash of the words from each on."""
    df = df.withColumn("_ids", F.transform("_words", lambda w: F.xxhash64(w)))
    rest = ", ".join(f"get(_ids, i + {k})" for k in range(1, GRAM))
    return df.withColumn("_grams", F.expr(f"slice(transform(_ids, (x, i) -> xxhash64(x, {rest})), 1, greatest(size(_ids) - {GRAM - 1}, 0))")).drop("_ids")


def with_fingerprints(df: DataFrame) -> DataFrame:
    """``df``, which has _grams, with _prints: (fp, at) of all hashes that are the
    least of some SPREAD neighbours.

    A hash is one of them if it equals the greatest of the least values of the
    neighbourhoods that it is in.
    """
    least = ", ".join(f"_grams[i + {k}]" for k in range(SPREAD))
    df = df.withColumn("_least", F.expr(f"CASE WHEN size(_grams) < {SPREAD} THEN array() ELSE transform(sequence(0, size(_grams) - {SPREAD}), i -> least({least})) END"))
    around = ", ".join(f"get(_least, i - {k})" for k in range(SPREAD))
    chosen = f"CASE WHEN x = greatest({around}) THEN named_struct('fp', x, 'at', i) END"
    return df.withColumn("_prints", F.expr(f"CASE WHEN size(_least) = 0 THEN array() ELSE filter(transform(_grams, (x, i) -> {chosen}), y -> y IS NOT NULL) END")).drop("_least")


def surroundings(at: str) -> tuple[Column, Column]:
    """The WINDOW - 1 words before a place, nearest first, and those from it on."""
    before = F.expr(f"reverse(slice(_words, greatest({at} - {WINDOW - 2}, 1), least({at}, {WINDOW - 1})))")
    after = F.expr(f"slice(_words, {at} + 1, {GRAM + WINDOW - 1})")
    return before, after


def item_prints(items: DataFrame) -> DataFrame:
    """(kind, fp, need, before, after, ids): the places that the items' windows are found
    by, and the items that have just these words there."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(F.col("text")).alias("_words")).where("size(_words) > 0")
    rows = with_fingerprints(with_grams(rows)).withColumn("_n", F.size("_words"))
    short = f"""CASE WHEN _n >= {GRAM} THEN array(named_struct('kind', {GRAM}, 'fp', _grams[0], 'at', 0))
                ELSE array(named_struct('kind', 1, 'fp', xxhash64(_words[0]), 'at', 0)) END"""
    places = F.expr(f"CASE WHEN _n >= {WINDOW} THEN transform(_prints, x -> named_struct('kind', 0, 'fp', x.fp, 'at', x.at)) ELSE {short} END")
    rows = rows.withColumn("_place", F.explode(places)).select("item", "_words", F.least("_n", F.lit(WINDOW)).alias("need"), "_place.*")
    before, after = surroundings("at")
    return rows.groupBy("kind", "fp", "need", before.alias("before"), after.alias("after")).agg(F.collect_set("item").alias("ids"))


def equal_run(a: str, b: str) -> str:
    """SQL for how many words two arrays have in common from the start."""
    same = f"zip_with({a}, {b}, (x, y) -> x <=> y AND x IS NOT NULL)"
    return f"coalesce(nullif(array_position({same}, false), 0) - 1, least(size({a}), size({b})))"


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The hits: _rid, start and stop (words, stop excluded) and ids (the items),
    for ``docs`` with _rid and text, with _hits and counts of all documents: see
    :func:`decontaminate`."""
    return _hits(docs, items)[1]


def _hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = docs.select("_rid", "doc_id", "text")
    split = rows.select("_rid", "doc_id", item_words(F.col("text")).alias("_words"))
    counted = with_fingerprints(with_grams(split)).select("_rid", "doc_id", F.size("_words").cast("long").alias("n_words"), "_prints")
    counted = written(counted, "fingerprints")
    known = written(item_prints(items), "item-fingerprints")
    kinds = {r["kind"] for r in known.select("kind").distinct().collect()}  # three at most

    places = counted.select("_rid", F.explode("_prints").alias("x")).select("_rid", F.lit(0).alias("kind"), "x.fp", "x.at")
    if kinds & {1, GRAM}:
        again = with_grams(split)
        if GRAM in kinds:
            places = places.union(again.select("_rid", F.posexplode("_grams").alias("at", "fp")).select("_rid", F.lit(GRAM), "fp", "at"))
        if 1 in kinds:
            ids = F.transform("_words", lambda w: F.xxhash64(w))
            places = places.union(split.select("_rid", F.posexplode(ids).alias("at", "fp")).select("_rid", F.lit(1), "fp", "at"))
    shared = places.join(known.select("kind", "fp").distinct(), ["kind", "fp"], "left_semi")
    shared = written(shared.groupBy("_rid").agg(F.collect_list(F.struct("kind", "fp", "at")).alias("_places")), "shared-fingerprints")

    texts = rows.select("_rid", "text").join(shared, "_rid").select("_rid", item_words(F.col("text")).alias("_words"), "_places")
    around = f"""transform(_places, p -> named_struct('kind', p.kind, 'fp', p.fp, 'at', p.at,
        'mine_before', reverse(slice(_words, greatest(p.at - {WINDOW - 2}, 1), least(p.at, {WINDOW - 1}))),
        'mine_after', slice(_words, p.at + 1, {GRAM + WINDOW - 1})))"""
    found = texts.select("_rid", F.explode(F.expr(around)).alias("x")).select("_rid", "x.*").join(known, ["kind", "fp"])
    found = found.withColumn("_l", F.expr(equal_run("mine_before", "before"))).withColumn("_r", F.expr(equal_run("mine_after", "after")))
    found = found.where("_l + _r >= need").select("_rid", (F.col("at") - F.col("_l")).cast("int").alias("start"), (F.col("at") + F.col("_r")).cast("int").alias("stop"), "ids")
    return counted.select("_rid", "doc_id", "n_words"), found


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted ids),
    contaminated, spans (the merged stretches of hit words: start, stop)."""
    counted, found = _hits(with_row_id(docs.select("doc_id", "text")), items)
    # stretches of one document, each one once, merged in order
    spans = F.expr("""aggregate(array_sort(collect_set(struct(start, stop))), cast(array() AS array<struct<start: int, stop: int>>),
        (s, x) -> CASE WHEN size(s) > 0 AND x.start <= element_at(s, -1).stop
                       THEN concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).start AS start, greatest(x.stop, element_at(s, -1).stop) AS stop)))
                       ELSE concat(s, array(x)) END)""")
    by_doc = found.groupBy("_rid").agg(spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    out = counted.join(by_doc, "_rid", "left")
    no_spans = F.expr("cast(array() AS array<struct<start: int, stop: int>>)")
    out = out.withColumn("spans", F.coalesce("spans", no_spans)).withColumn("items", F.coalesce("items", F.expr("cast(array() AS array<string>)")))
    n_hit = F.expr("aggregate(spans, 0L, (s, x) -> s + x.stop - x.start)")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (n_hit > 0).alias("contaminated"), "spans")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of :func:`decontaminate`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = decontaminate(docs, items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
