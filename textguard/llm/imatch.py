"""I-Match fingerprints over randomised lexicons.

Terms are runs of letters and digits in lower case. Document frequencies of all
terms are counted over all documents. The lexicon holds the terms within an
inverse-document-frequency band; its rare end, a share of the documents, bounds
the lexicon's size by the mean number of a document's distinct terms over that
share, whatever the number of documents. Should it hold over MOST_TERMS terms
all the same, the band begins at the next frequency at which it does not.

The randomised lexicons are fixed: each of SUBSETS of each rate keeps a term by
the term's own hash, whatever the document. A fingerprint has the hash of all
of a document's lexicon terms, sorted, and of those that each subset keeps,
sorted as well. Rates are powers of four apart: a subset that keeps most terms
tells near copies, one that keeps a few of a document's terms survives edits.
Likeness is the share of equal subset hashes, from the sparsest rate on at
which at least half of the subsets hold a term of either text.

Defined cases: a null text is empty; a text without a lexicon term uses all its
words instead; texts without a word have one empty fingerprint; equal texts
have equal fingerprints and a likeness of 1; the document after the last is
the first; a single document is followed by itself; null ids come last; rows
that repeat an id are ordered by their text's hash; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.shingles import WordHashes, chunks, mix

#: The band, as shares of all documents: a term in over half of them is no
#: mark, and one in fewer than 1 of 4,096 is left out.
MOST_SHARE = 1 / 2
LEAST_SHARE = 1 / 4096
MOST_TERMS = 2_000_000
#: How many randomised lexicons there are of each rate; a rate keeps a term with the probability 2**-rate.
SUBSETS = 16
RATES = (2, 4, 6, 8, 10)
_TERM = re.compile(r"[^\W_]+")
_LAST = 2**63 - 1
_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64))


def distinct_terms(texts: list, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for the distinct terms of each text, sorted by both; terms are 64-bit hashes."""
    lists = [_TERM.findall(t.lower()) if t else [] for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((cache[w] for x in lists for w in x), np.uint64, int(n.sum()))
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((flat, owner))
    owner, flat = owner[order], flat[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (flat[1:] != flat[:-1])]) if len(flat) else np.zeros(0, bool)
    return owner[new], flat[new]


class Pieces(dict):
    """Numbers for the pieces between white space of some texts, each of them lowered and taken
    apart into terms once; no term holds white space, and lowering looks at no other piece."""

    def __missing__(self, piece: str) -> int:
        self[piece] = out = len(self)
        return out

    def terms(self, cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, places, starts): the sorted terms of all pieces, and those of each piece as places
        among them, with where each piece's begin (and the end of the last)."""
        lists = [_TERM.findall(p.lower()) for p in self]  # in the order of their numbers
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        flat = np.fromiter((cache[w] for x in lists for w in x), np.uint64, int(starts[-1]))
        terms, places = np.unique(flat, return_inverse=True)
        return terms, places, starts


def distinct_places(lists: list[np.ndarray], width: int, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) for the distinct terms of texts given by their pieces, sorted by both."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    piece = np.concatenate([np.zeros(0, np.int64), *lists])
    n = np.diff(starts)[piece]
    at = np.repeat(starts[piece] - np.cumsum(n) + n, n) + np.arange(n.sum())
    key = np.sort(np.repeat(np.repeat(np.arange(len(lists)), sizes), n) * max(width, 1) + places[at])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    owner = key // max(width, 1)
    return owner, key - owner * width


def pieces_of(texts: list, pieces: Pieces) -> list[np.ndarray]:
    """The pieces of each text, in order."""
    number = pieces.__getitem__
    return [np.array([*map(number, t.split())] if t else [], np.int64) for t in texts]


def edited_pieces(texts: list[str], lists: list[np.ndarray], pieces: Pieces) -> list[np.ndarray]:
    """The pieces of each text but the last, once :func:`edited` by the one that follows: those of
    the two texts, but where a piece is cut."""
    out = []
    for i in range(len(texts) - 1):
        k = len(texts[i]) // 4
        head, tail = texts[i][: len(texts[i]) - k], texts[i + 1][:k]
        a, b = head.split(), tail.split()
        whole = max(len(b) - 1, 0)
        if a and b and not (head[-1].isspace() or tail[0].isspace()):  # the last piece and the first are one
            middle, own, rest = [a[-1] + b[0]], lists[i + 1][1:whole], b[1:][-1:]
        else:
            middle, own, rest = a[-1:], lists[i + 1][:whole], b[-1:]
        cut = [np.array([pieces[p] for p in x], np.int64) for x in (middle, rest)]
        out.append(np.concatenate([lists[i][: max(len(a) - 1, 0)], cut[0], own, cut[1]]))
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        term, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return term, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

    def out(term: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(term), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(term[i : i + 100_000].astype(np.int64)), pa.array(n[i : i + 100_000])], names=["term", "n"])

    for batch in batches:
        for _, texts in chunks(batch):
            term, n = np.unique(distinct_terms(texts, cache)[1], return_counts=True)
            held.append((term, n))
            size += len(term)
            if size > 4_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:  # mostly new words: hand them on
                    yield from out(*held[0])
                    held, size = [], 0
    if held:
        yield from out(*merged())


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, most_terms: int = MOST_TERMS) -> np.ndarray:
    """The sorted hashes of the terms within the band."""
    n = docs.count()
    counts = docs.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where((F.col("n") >= n * least) & (F.col("n") <= n * most))
    found = band.orderBy(F.col("n").desc()).limit(most_terms + 1).toPandas()
    if len(found) > most_terms:  # all terms of a frequency or none
        found = found[found["n"] > found["n"].iloc[-1]]
    return np.sort(found["term"].to_numpy(np.int64).astype(np.uint64))


def set_hashes(owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """A hash of each owner's sorted terms in order, 0 without a term; rows are sorted by both."""
    out = np.zeros(n, np.uint64)
    if len(owner):
        new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rank = (np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))).astype(np.uint64)
        out[owner[new]] = mix(np.add.reduceat(mix(term + rank * np.uint64(0x9E3779B97F4A7C15)), new)) | np.uint64(1)
    return out


def fingerprints(texts: list, lexicon: np.ndarray, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of all terms, hashes[text, rate, subset]) of each text; 0 where no term is kept."""
    pieces = Pieces()
    lists = pieces_of(texts, pieces)
    return piece_fingerprints(lists, *pieces.terms(cache), lexicon)


def piece_fingerprints(lists: list[np.ndarray], terms: np.ndarray, places: np.ndarray, starts: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fingerprints` of texts given by their pieces."""
    owner, place = distinct_places(lists, len(terms), places, starts)
    n = len(lists)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        known = (lexicon[at] == terms)[place]
        use = known | (np.bincount(owner[known], minlength=n) == 0)[owner]
        owner, place = owner[use], place[use]
    term = terms[place]
    out = np.zeros((n, len(RATES), SUBSETS), np.uint32)
    for k in range(SUBSETS):
        # drawn once for a term, not for each text that holds it
        draw = mix(terms ^ _SEEDS[k])
        rates = sum((draw <= np.uint64(2**64 - 1) >> np.uint64(rate)).astype(np.uint8) for rate in RATES)[place]
        some, left = owner, term
        for j in range(len(RATES)):
            kept = np.flatnonzero(rates > j)
            rates, some, left = rates[kept], some[kept], left[kept]
            found = set_hashes(some, left, n)
            out[:, j, k] = np.where(found != 0, found >> np.uint64(32) | np.uint64(1), found)
    return set_hashes(owner, term, n), out


def likeness(a: tuple, b: tuple) -> np.ndarray:
    """The likeness of the fingerprints of two equally long lists of texts."""
    (wa, x), (wb, y) = a, b
    either, agree = ((x != 0) | (y != 0)).sum(axis=2), ((x != 0) & (x == y)).sum(axis=2)
    filled = 2 * either >= SUBSETS
    first = np.where(filled.any(axis=1), len(RATES) - 1 - filled[:, ::-1].argmax(axis=1), 0)
    counted = np.arange(len(RATES)) >= first[:, None]
    return np.where(wa == wb, 1.0, (agree * counted).sum(axis=1) / np.maximum((either * counted).sum(axis=1), 1))


def as_text(whole: np.ndarray, hashes: np.ndarray) -> list[str]:
    """Sixteen hexadecimal digits for all terms, then eight for each subset ('' without a term)."""
    raw = hashes.astype(">u4").tobytes()
    step = len(RATES) * SUBSETS * 4
    return [f"{w:016x}{raw[i * step : (i + 1) * step].hex()}" if w else "" for i, w in enumerate(whole.tolist())]


def edited(text: str, following: str) -> str:
    """The text, its last quarter replaced by the beginning of the one that follows."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """The rows (doc_id, text) dealt into ranges of ids, sorted in each, with
    _range and _tail. A tail is a copy of the row that begins the next range.

    Ranges begin at quantiles of the ids, a few for each shuffle partition; the
    texts are shuffled once and no task sees more than some ranges.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces or 4 * n
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(_LAST)).cast("long").alias("_key"))
    shares = [k / pieces for k in range(1, pieces)]
    row = keyed.agg(F.min("_key").alias("lo"), F.percentile_approx("_key", shares, 10 * pieces).alias("cuts")).first()
    begins = np.unique(np.array([row["lo"] or 0, *(row["cuts"] or [])], np.int64))

    @F.pandas_udf("array<int>")
    def ranges(key):
        at = np.searchsorted(begins, key.to_numpy(), side="right") - 1
        before = np.where(begins[at] == key.to_numpy(), (at - 1) % len(begins), -1)
        import pandas as pd

        return pd.Series([[a] if b < 0 else [a, -1 - b] for a, b in zip(at.tolist(), before.tolist(), strict=True)])

    dealt = keyed.withColumn("_to", F.explode(ranges("_key")))
    dealt = dealt.withColumn("_tail", F.col("_to") < 0).withColumn("_range", F.when(F.col("_tail"), -1 - F.col("_to")).otherwise(F.col("_to")))
    dealt = dealt.drop("_to").withColumn("_hash", F.xxhash64("text"))
    return dealt.repartition(n, "_range").sortWithinPartitions("_range", "_tail", "_key", "_hash").drop("_key", "_hash")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    terms = lexicon(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def report(ids: list, texts: list[str], cache: WordHashes) -> pa.RecordBatch:
        """Of all texts but the last, each followed by the one after it; None in ids ends a range."""
        now = [i for i in range(len(texts) - 1) if ids[i] is not None]
        made = [edited(texts[i], texts[i + 1]) for i in now]
        pieces = Pieces()
        lists = pieces_of(texts, pieces)
        after_edit = edited_pieces(texts, lists, pieces)
        known = pieces.terms(cache)
        base = piece_fingerprints(lists, *known, terms)
        new = piece_fingerprints([after_edit[i] for i in now], *known, terms)
        own, after = (tuple(x[np.array(now, np.int64) + k] for x in base) for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i][0] for i in now], pa.int64()), pa.array([len(texts[i]) for i in now], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in made], pa.string()),
                pa.array(as_text(*own), pa.string()), pa.array(as_text(*new), pa.string()),
                pa.array(np.round(likeness(own, new), 6)), pa.array(np.round(likeness(own, after), 6)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        ids: list = []
        texts: list[str] = []
        ended = -1  # the range whose tail has been seen
        for batch in batches:
            for rows, found in chunks(batch, most_chars=2_000_000):
                for doc_id, at, tail, text in zip(rows.column("doc_id").to_pylist(), rows.column("_range").to_pylist(), rows.column("_tail").to_pylist(), found, strict=True):
                    if tail and at == ended:  # the next range begins with several rows of one id
                        continue
                    ended = at if tail else ended
                    ids.append(None if tail else (doc_id,))
                    texts.append(text)
                if len(texts) > 1:
                    yield report(ids, texts, cache)
                    ids, texts = ids[-1:], texts[-1:]

    return in_order(docs.select("doc_id", "text")).mapInArrow(run, schema)
