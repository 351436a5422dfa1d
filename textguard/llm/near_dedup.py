"""Near-duplicate documents by ProbMinHash.

A document is the weighted set of its five-word shingles, a shingle that
occurs n times weighing 1 + ln n. Every shingle sends arrivals of a Poisson
process whose rate is its weight, each to a random one of the signature's
components; a component keeps the shingle that arrives first. A shingle stops
as soon as its next arrival is later than the last filled component's, so most
shingles send one. Two documents agree in a component with the probability
Jaccard similarity of their sets.

Signatures are cut into bands; documents that agree in a band are candidates.
Candidates are linked to the band's most central document first; what this leaves
in different components is linked to one partner each, and every pair that is
then still apart is compared as well, block by block, by sketches that rule out most pairs and no similar one.
Links are verified by the exact Jaccard similarity of the distinct shingles.
Exact copies count as one text until the end, so a group of copies of any size
costs as much as one of them.

Defined cases: a null text and one without a word are near nothing and form a
class each; texts under five words are one shingle; repeated rows are copies;
a class is named by its least doc_id (null if all its ids are null), and the
row of that id that comes first is the one to keep; an empty table gives an
empty result; other columns pass through ``drop_near_duplicates`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import discard, small, written
from textguard.llm.graph import connected_components
from textguard.llm.shingles import WordHashes, chunks, hashed, list_array, mix, shingle_hashes, with_row_id

THRESHOLD = 0.8
#: 25 bands of 4: two texts of similarity 0.8 miss each other once in 500,000 times.
BANDS, ROWS = 25, 4
#: Bits of the sketches that tell apart most sets that are unlike.
SKETCH_BITS = 4096
#: Members of a group that are paired in one piece of work.
BLOCK = 256


def prob_signatures(owner: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """The ProbMinHash signatures of ``n`` weighted sets, an item in each of ``m`` components."""
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    at = np.zeros(len(item))
    r = 0
    while len(item):
        seed = item + np.uint64(0x632BE59BD9B4E019 * (2 * r + 1) % 2**64)
        uniform = (mix(seed) >> np.uint64(11)) / 2.0**53
        at = at - np.log1p(-uniform) / weight
        slot = owner * m + (mix(seed + np.uint64(0xD1B54A32D192ED03)) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(at < first[slot])
        better = better[np.argsort(-at[better], kind="stable")]  # the earliest is assigned last
        first[slot[better]] = at[better]
        who[slot[better]] = item[better]
        active = at < first.reshape(n, m).max(axis=1)[owner]
        owner, item, weight, at = owner[active], item[active], weight[active], at[active]
        r += 1
    return who.reshape(n, m)


def weighted_shingles(owner: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, item) and their weights; fewer than 2**16 owners, items cut to 48 bits."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (item >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.diff(np.concatenate([new, [len(key)]]))
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64(2**48 - 1), 1 + np.log(count)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    n = len(signatures)
    parts = signatures.reshape(n, bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for rows, texts in chunks(batch):
            flat, starts = hashed(texts, cache)
            owner, item, weight = weighted_shingles(*shingle_hashes(flat, starts))
            n = len(texts)
            keys = band_keys(prob_signatures(owner, item, weight, n, BANDS * ROWS), BANDS, ROWS)
            some = np.diff(starts) > 0
            bands = list_array(keys[some].astype(np.int64).ravel(), np.where(some, BANDS, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in ("_rid", "doc_id", "k1", "k2")] + [bands], names=["_rid", "doc_id", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for rows, texts in chunks(batch):
            owner, item = shingle_hashes(*hashed(texts, cache))
            order = np.lexsort((item, owner))
            owner, item = owner[order], item[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])]) if len(owner) else np.zeros(0, bool)
            counts = np.bincount(owner[new], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([rows.column("_rid"), list_array(item[new].astype(np.int64), counts, pa.int64())], names=["node", "items"])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, items): the distinct shingles of each row of (_rid, text)."""
    return texts.select("_rid", "text").mapInArrow(_sets, "node long, items array<long>")


def similar(links: DataFrame, sets: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """The links whose ends have an exact Jaccard similarity of the threshold at least.

    ``links`` is a written table. ``b`` may be the same node in very many links. It is
    joined last, when a row holds the other end's items, so that rows of a hot node are
    many bytes and Spark splits them.
    """
    x = small(links).join(sets.select(F.col("node").alias(a), F.col("items").alias("_a")), a)
    x = x.join(sets.select(F.col("node").alias(b), F.col("items").alias("_b")), b)
    x = x.withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    return x.where(F.col("_both") >= threshold * (F.size("_a") + F.size("_b") - F.col("_both"))).select(a, b)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column("items")
        counts = np.diff(items.offsets.to_numpy())
        bits = (mix(items.flatten().to_numpy().astype(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        parts = np.split(bits, np.cumsum(counts)[:-1])
        sketches = [np.packbits((np.bincount(x, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes() for x in parts]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(counts.astype(np.int32)), pa.array(sketches, pa.binary())], names=["node", "_w", "_s"])


def _close(node: np.ndarray, c: np.ndarray, w: np.ndarray, s: np.ndarray, one: np.ndarray, two: np.ndarray | None, threshold: float, once: bool) -> Iterator[np.ndarray]:
    """Pairs of ``one`` and ``two`` (or among ``one``) in different components whose sets may be similar.

    Loses none: every bit in which two sketches differ is an item at least that one
    set has and the other has not. With ``once``, a member is given one partner only.
    """
    most = (1 - threshold) / (1 + threshold)
    has = np.zeros(len(node), bool)
    for k, x in enumerate(one):
        if once and two is None and has[x]:
            continue
        y = one[k + 1 :] if two is None else two
        y = y[~has[y]] if once else y
        y = y[(c[y] != c[x]) & (w[y] * threshold <= w[x] + 1e-6) & (w[x] * threshold <= w[y] + 1e-6)]
        if len(y):
            y = y[np.bitwise_count(s[y] ^ s[x]).sum(axis=1, dtype=np.int64) <= (w[y] + w[x]) * most + 1e-6]
            has[y] = once
            yield np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1)


def _compare_blocks(threshold: float, once: bool):
    """For batches sorted by (band, _lo, _hi): the close pairs of each two blocks of a group."""

    def pairs(held: pa.RecordBatch | None, batch: pa.RecordBatch | None) -> tuple[list[np.ndarray], pa.RecordBatch | None]:
        both = [x for x in (held, batch) if x is not None and x.num_rows]
        if not both:
            return [], None
        rows = pa.Table.from_batches(both).combine_chunks().to_batches()[0]
        band, lo, hi, i, node, c, w = (rows.column(x).to_numpy() for x in ("band", "_lo", "_hi", "_i", "node", "c", "_w"))
        starts = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        ends = np.concatenate([starts[1:], [len(band)]])
        if batch is not None:  # the last group may go on
            held, starts, ends = rows.slice(starts[-1]), starts[:-1], ends[:-1]
        s = np.frombuffer(b"".join(rows.column("_s").to_pylist()), np.uint64).reshape(len(band), -1)
        out: list[np.ndarray] = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                at = np.arange(a, b)
                first, second = (at, None) if lo[a] == hi[a] else (at[i[a:b] == lo[a]], at[i[a:b] == hi[a]])
                out += _close(node, c, w, s, first, second, threshold, once)
        return out, held

    def made(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if out:
            found = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["node", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out, held = pairs(held, batch)
            yield from made(out)
        yield from made(pairs(held, None)[0])

    return run


def open_pairs(rest: DataFrame, threshold: float, once: bool = False) -> DataFrame:
    """Distinct pairs (node, rep), node < rep, of members of one group that are in
    different components and whose sketches allow the similarity asked.

    ``rest`` has node, band, c (the component), _n (the size of the group), _w (the
    size of the set) and _s (its sketch). A group is dealt into blocks; each two
    blocks are compared as one piece of work, and only pairs that may be similar
    leave it: a large group is the work of many tasks and never a table of pairs.
    With ``once``, a member gets one partner at most of two blocks.
    """
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    dealt = rest.withColumn("_i", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"), "_i", "node", "c", "_w", "_s")
    keys = ["band", "_lo", "_hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare_blocks(threshold, once), "node long, rep long").distinct()


def all_links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Links (node, rep) that join all similar members of each group: every two
    members of a group are verified or are in one component.

    ``members`` has (node, band); ``sets_of`` gives (node, items) for a table of
    nodes. First all members are verified with the most central of their group,
    whose own groups are the largest: that is the text of which others are edits,
    since the edits of one text agree with it more than with each other. Groups
    are counted by a combined aggregation and joined again, which Spark can split.
    What is then not yet in one component is verified pair by pair.
    """
    groups = members.groupBy("band").agg(F.count("*").alias("_n")).where("_n > 1")
    grouped = written(members.join(groups, "band").select("node", "band", "_n"), "grouped")
    central = grouped.groupBy("node").agg(F.sum("_n").alias("_c"))
    members = written(grouped.join(central, "node"), "members")
    nodes = written(members.select("node").distinct(), "nodes")
    sets = written(sets_of(small(nodes)), "sets")
    discard(grouped, nodes)
    reps = members.groupBy("band").agg(F.max(F.struct("_c", "node")).alias("_r")).select("band", F.col("_r.node").alias("rep"))
    stars = written(members.join(reps, "band").where("node <> rep").select("node", "rep").distinct(), "stars")
    links = written(similar(stars, sets, "node", "rep", threshold), "star-links")
    tried = stars.select(F.least("node", "rep").alias("node"), F.greatest("node", "rep").alias("rep"))
    # what is apart is joined by one partner each first, so that a cluster of like texts is
    # in one component when all that is still apart is compared
    for once in (True, False):
        labels = connected_components(links, "node", "rep")
        now = members.join(labels, "node", "left").select("node", "band", "_n", F.coalesce("component", "node").alias("c"))
        now = written(now, "labelled")
        several = now.groupBy("band").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo < _hi").select("band")
        rest = written(now.join(several, "band", "left_semi"), "rest")
        sketches = sets.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(_sketch, "node long, _w int, _s binary")
        pairs = open_pairs(rest.join(written(sketches, "sketches"), "node"), threshold, once).join(tried, ["node", "rep"], "left_anti")
        pairs = written(pairs, "close-pairs")
        links = written(links.union(similar(pairs, sets, "node", "rep", threshold)), "all-links")
        tried = tried.union(pairs)
        discard(now, rest)
    discard(members, sets, stars)
    return links


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(_rid, doc_id, class_id, class_size, kept) for every row of ``docs``, which has _rid."""
    slim = docs.select("_rid", "doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    signed = written(slim.mapInArrow(_sign, "_rid long, doc_id long, k1 long, k2 long, bands array<long>"), "signed")
    filled = signed.where("size(bands) > 0")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid")))
    copies = written(filled.groupBy("k1", "k2").agg(F.min("_rid").alias("node"), first_row.alias("first"), F.count("*").alias("n")), "copies")
    banded = filled.join(copies.select(F.col("node").alias("_rid")), "_rid", "left_semi")
    members = banded.select(F.col("_rid").alias("node"), F.explode("bands").alias("band"))
    texts = docs.select("_rid", "text")
    links = all_links(members, lambda nodes: shingle_sets(texts.join(nodes.withColumnRenamed("node", "_rid"), "_rid", "left_semi")), threshold)
    components = connected_components(links, "node", "rep")
    # what a class has in common is added up and joined over distinct texts first
    named = written(copies.join(components, "node", "left").select("k1", "k2", "first", "n", F.coalesce("component", "node").alias("_class")), "named")
    classes = written(named.groupBy("_class").agg(F.min("first").alias("_first"), F.sum("n").alias("class_size")), "classes")
    classed = written(named.join(classes, "_class").select("k1", "k2", "_first", "class_size"), "classed")
    rows = filled.select("_rid", "doc_id", "k1", "k2").join(classed, ["k1", "k2"]).select("_rid", "doc_id", "_first", "class_size")
    alone = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid"))
    rows = rows.union(signed.where("size(bands) = 0").select("_rid", "doc_id", alone, F.lit(1).cast("long")))
    return rows.select("_rid", "doc_id", F.col("_first.id").alias("class_id"), "class_size", (F.col("_rid") == F.col("_first.rid")).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept (one row of each class)."""
    return near_classes(with_row_id(docs)).drop("_rid")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns."""
    rows = with_row_id(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    gone = near_classes(rows).where("NOT kept").select("_rid")
    return rows.join(written(gone, "gone"), "_rid", "left_anti").select("_row.*")
