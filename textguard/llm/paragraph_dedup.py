"""Passages that repeat across documents, by MinHash banding of paragraphs.

Passages are pasted into the middle of lines as well, so the unit compared is
not the line but the sentence: units end at sentence ends and line ends, and
long stretches without either at words chosen by their hash. Neighbouring
sentences of under MIN_NEAR words are one unit, up to an end chosen by its
word's hash. Where a unit ends depends on nearby words only, so a passage is
cut alike wherever it stands.
Equal units of any length are one class from the start.

MinHash over five-word shingles gives each distinct unit of MIN_NEAR words or
more a few bands; the number of bands is tuned for the recall asked. Units that
share a band are linked to its most central unit and then, where that leaves
them apart, to each other. Links are verified by exact Jaccard similarity, and
linked units form classes by connected components. A class that occurs in more
than one document is a repeat. Repeats are acted on where consecutive units of
at least MIN_RUN words in all are repeats: a single common sentence is left
alone, a passage of many short sentences is not.

Of each class, the occurrence in the document of the least doc_id is kept and
the others are removed; units of under MIN_NEAR words, which recur by chance,
go or stay with the longer ones around them.

Defined cases: a null text has no unit; repeats within one document alone are
left; repeated rows are different documents; passages under MIN_RUN words are
left; an empty table gives an empty result; other columns pass through
``remove_repeats`` untouched, and a document that loses its last word goes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.llm.common import WORD, discard, written
from textguard.llm.graph import connected_components
from textguard.llm.near_dedup import all_links
from textguard.llm.shingles import SIZE, WordHashes, chunks, list_array, mix, shingle_hashes, with_row_id, words_of

THRESHOLD = 0.8
RECALL = 0.98
MOST_BANDS = 5
#: Words of a unit that is compared with units unlike it; shorter ones are compared for equality.
MIN_NEAR = 8
#: Words of a passage.
MIN_RUN = 24
#: Words of a unit that is cut, and how far apart its cuts are on average.
LONG_UNIT = 32
CUT_GAP = 10
_WORD = re.compile(WORD)
#: One end mark after a letter or digit: in shouted text, every word ends in several.
_SENTENCE_END = re.compile(r"""\w[.!?…]["')\]»”’]*$""")


def tune_bands(threshold: float, recall: float, most_bands: int) -> tuple[int, int]:
    """(bands, rows): as many rows a band as find a pair at the threshold with
    the recall asked in no more than ``most_bands`` bands."""
    for rows in range(8, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands <= most_bands:
            return bands, rows
    return most_bands, 1


BANDS, ROWS = tune_bands(THRESHOLD, RECALL, MOST_BANDS)
BAND_COLUMNS = [f"b{i}" for i in range(BANDS)]


class UnitHashes(WordHashes):
    """Word hashes whose lowest bit tells that the word ends a sentence."""

    MOST = 60_000

    def __missing__(self, word: str) -> int:
        out = super().__missing__(word) & ~1
        self[word] = out = out | bool(_SENTENCE_END.search(word))
        return out


def units(texts: list, cache: UnitHashes) -> tuple[np.ndarray, ...]:
    """(hashes of all words, unit starts and the end, the text of each unit, where in its text it starts)."""
    lists, text_of_line = [], []
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if ws := _WORD.findall(line):
                lists.append(ws)
                text_of_line.append(i)
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((cache[w] for x in lists for w in x), np.uint64, int(lengths.sum()))
    if not len(flat):
        empty = np.zeros(0, np.int64)
        return flat, np.zeros(1, np.int64), empty, empty
    word_text = np.repeat(np.array(text_of_line), lengths)
    ends = (flat & np.uint64(1)).astype(bool)
    ends[np.cumsum(lengths) - 1] = True
    # short sentences and lines stand together, up to an end chosen by its word's hash
    at = np.flatnonzero(ends)
    long = np.diff(np.concatenate([[-1], at])) >= MIN_NEAR
    last = np.append(word_text[1:] != word_text[:-1], True)[at]
    ends[at] = long | np.append(long[1:], True) | last | ((flat[at] >> np.uint64(17)) % np.uint64(3) == 0)
    # a long sentence is cut; a piece too short for a shingle goes with its neighbour in the sentence
    size = np.diff(np.concatenate([[-1], np.flatnonzero(ends)]))
    cuts = ~ends & (np.repeat(size, size) > LONG_UNIT) & ((flat >> np.uint64(9)) % np.uint64(CUT_GAP) == 0)
    at = np.flatnonzero(ends | cuts)
    inner, short = cuts[at], np.diff(np.concatenate([[-1], at])) < SIZE
    joined = inner & (short | np.append(short[1:] & ~inner[1:], False))
    ends[at] = ~joined
    starts = np.concatenate([[0], np.flatnonzero(ends) + 1])
    owner = word_text[starts[:-1]]
    text_start = np.searchsorted(word_text, np.arange(len(texts)))
    return flat, starts, owner, starts[:-1] - text_start[owner]


def unit_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each unit's words in order."""
    n = np.diff(starts)
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(starts[:-1], n).astype(np.uint64)
    total = np.add.reduceat(mix(flat + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), starts[:-1])
    return mix(total + n.astype(np.uint64)).astype(np.int64)


def min_hashes(owner: np.ndarray, items: np.ndarray, m: int) -> np.ndarray:
    """For each owner in order (all have items), the least of its items under ``m`` permutations."""
    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.stack([np.minimum.reduceat(mix(items ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), at) for k in range(m)], axis=1)


def unit_bands(flat: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The keys of the bands of the chosen units (all have shingles), a row for each."""
    owner, items = shingle_hashes(flat, starts)
    mine = chosen[owner]
    low = min_hashes(owner[mine], items[mine], BANDS * ROWS).reshape(-1, BANDS, ROWS)
    bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), low.shape[:2])
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
    return bands.astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of each text; of each key's first in a slice of texts, the bands as well."""
    cache = UnitHashes()
    for batch in batches:
        for rows, texts in chunks(batch, most_chars=1_000_000):
            flat, starts, owner, start = units(texts, cache)
            if not len(flat):
                continue
            n, key = np.diff(starts), unit_keys(flat, starts)
            seq = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(texts)))[owner]
            own = rows.select(["_rid", "doc_id"]).take(pa.array(owner))  # not the texts
            chosen = np.zeros(len(n), bool)
            chosen[np.unique(key, return_index=True)[1]] = True
            chosen &= n >= MIN_NEAR
            bands = np.zeros((len(n), BANDS), np.int64)
            if chosen.any():
                bands[chosen] = unit_bands(flat, starts, chosen)
            yield pa.RecordBatch.from_arrays(
                [own.column("_rid"), own.column("doc_id"), *(pa.array(x.astype(np.int32)) for x in (seq, start, n)), pa.array(key), *(pa.array(np.ascontiguousarray(b), mask=~chosen) for b in bands.T)],
                names=["_rid", "doc_id", "seq", "start", "n", "k", *BAND_COLUMNS],
            )


def _span_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for rows, texts in chunks(batch):
            keys, counts, items = [], [], []
            for text, spans in zip(texts, rows.column("spans").to_pylist(), strict=True):
                ws = words_of(text)
                for s in spans:
                    flat = np.fromiter((cache[w] for w in ws[s["start"] : s["start"] + s["n"]]), np.uint64)
                    found = np.unique(shingle_hashes(flat, np.array([0, len(flat)]))[1])
                    keys.append(s["k"])
                    counts.append(len(found))
                    items.append(found)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), list_array(np.concatenate(items).astype(np.int64), counts, pa.int64())], names=["node", "items"])


def repeats(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each occurrence of a repeated unit: _rid, doc_id, seq (its place
    among the document's units), start_word, n_words, class_id, kept_doc_id,
    removed. ``docs`` has _rid."""
    slim = docs.select("_rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = ", ".join(f"{c} long" for c in BAND_COLUMNS)
    places = units_table = written(slim.mapInArrow(_places, f"_rid long, doc_id long, seq int, start int, n int, k long, {kinds}"), "units")
    # of each unit that is compared, its bands and one occurrence
    banded = places.where("b0 IS NOT NULL").groupBy("k").agg(*[F.first(c).alias(c) for c in (*BAND_COLUMNS, "_rid", "start", "n")])
    banded = written(banded, "unit-bands")
    members = banded.select(F.col("k").alias("node"), F.explode(F.array(*BAND_COLUMNS)).alias("band"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = banded.join(nodes.withColumnRenamed("node", "k"), "k", "left_semi")
        spans = wanted.groupBy("_rid").agg(F.collect_list(F.struct("start", "n", "k")).alias("spans"))
        return docs.select("_rid", "text").join(spans, "_rid").mapInArrow(_span_sets, "node long, items array<long>")

    links = all_links(members, sets_of, threshold)
    components = connected_components(links, "node", "rep").select(F.col("node").alias("k"), "component")
    # units that stand in several rows or are like others
    spread = places.groupBy("k").agg(F.min("_rid").alias("lo"), F.max("_rid").alias("hi"))
    spread = spread.join(components, "k", "left").where("lo <> hi OR component IS NOT NULL")
    spread = written(spread.select("k", F.coalesce("component", "k").alias("class_id"), "lo", "hi"), "unit-spread")
    several = spread.groupBy("class_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    classed = written(spread.select("k", "class_id").join(several.select("class_id"), "class_id", "left_semi"), "unit-classes")
    found = written(places.select("_rid", "doc_id", "seq", "start", "n", "k").join(classed, "k").drop("k"), "unit-repeats")
    discard(units_table, banded, spread, classed)
    # of each class, its first occurrence
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_rid", "seq"))
    firsts = written(found.groupBy("class_id").agg(first.alias("first")), "unit-firsts")
    found = found.join(firsts, "class_id")
    # repeats that stand together
    in_order = W.partitionBy("_rid").orderBy("seq")
    found = found.withColumn("_run", F.col("seq") - F.row_number().over(in_order))
    found = found.withColumn("_run_words", F.sum("n").over(W.partitionBy("_rid", "_run"))).where(F.col("_run_words") >= MIN_RUN)
    own = ~((F.col("first._rid") == F.col("_rid")) & (F.col("first.seq") == F.col("seq")))
    found = found.withColumn("_own", own).withColumn("_long", F.when(F.col("n") >= MIN_NEAR, F.col("_own")))
    # a short unit occurs by chance as well: it goes with the longer ones around it
    run = W.partitionBy("_rid", "_run").orderBy("seq")
    before = F.last("_long", ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("_long", ignorenulls=True).over(run.rowsBetween(1, W.unboundedFollowing))
    found = found.withColumn("_before", before).withColumn("_after", after)
    inside = F.when(F.col("_before") & F.col("_after"), True).when(F.coalesce("_before", "_after").isNull(), F.col("_own"))
    short = inside.otherwise(F.col("_own") & F.coalesce("_before", F.lit(True)) & F.coalesce("_after", F.lit(True)))
    return found.select(
        "_rid", "doc_id", "seq", F.col("start").alias("start_word"), F.col("n").alias("n_words"), "class_id",
        F.col("first.doc_id").alias("kept_doc_id"), F.coalesce("_long", short).alias("removed"),
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """The occurrences of repeated units: doc_id, start_word, n_words, class_id, kept_doc_id, removed."""
    return repeats(with_row_id(docs)).drop("_rid", "seq")


def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text without the words of the spans (seq, start, n)."""
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    merged: list[list[int]] = []
    for seq, start, n in sorted(spans):
        if merged and merged[-1][2] == seq - 1:
            merged[-1][1:] = [start + n, seq]
        else:
            merged.append([start, start + n, seq])
    out, at = [], 0
    for a, b, _ in merged:
        out.append(text[at : places[a]])
        at = places[b]
    return "".join(out) + text[at:]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        spans = batch.column("spans").to_pylist()
        edited = [cut(t, [(s["seq"], s["start_word"], s["n_words"]) for s in x]) if x else t for t, x in zip(texts, spans, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(edited, pa.string()), pa.array([bool(x) for x in spans])], names=["_row", "text", "edited"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without the repeats to remove, with their own columns."""
    rows = with_row_id(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "doc_id", "text"))
    spans = repeats(rows).where("removed").groupBy("_rid").agg(F.collect_list(F.struct("seq", "start_word", "n_words")).alias("spans"))
    joined = rows.select("_rid", "_row", "text").join(written(spans, "spans"), "_rid", "left")
    kind = joined.schema["_row"].dataType.simpleString()
    out = joined.mapInArrow(_cut, f"_row {kind}, text string, edited boolean")
    out = out.where(~F.col("edited") | F.col("text").rlike(WORD))
    own = {c: F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("edited"), F.length("text")).otherwise(F.col("_row.n_chars")).cast("long")
    return out.select(*[c.alias(name) for name, c in own.items()])
