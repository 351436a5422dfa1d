"""Language identification by a linear-chain conditional random field.

Words are the chain, languages its labels. A word's features are its affixes
(one to three characters), its character bigrams and trigrams and its entry in
the lexicon (the whole word), hashed into a fixed table of weights; transitions
between languages are learned with them. Forward-backward gives every word its
probability of each language, so a text may switch languages. A text's language
is the one that has most of its words, the score its share of them.

Training takes a bounded sample: at most SAMPLE_DOCS documents in all, dealt
evenly over the languages, and of each a window of WINDOW words. Windows are
chained at random, so that transitions see both staying and switching. The
model is some megabytes whatever the input's size. Prediction reads every word
of every text and shuffles nothing.

The forward-backward pass is exact and works on blocks of words: products of
transfer matrices over all blocks at once, then a scan over each text's
blocks, then messages inside all blocks at once. A text of any length costs
time in proportion to its words.

Defined cases: a null text or one without a letter is ``und`` with score 0;
ties go to the language that is first by name; without any labelled row every
text is ``und``; repeated rows get equal results; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import bucket_of, words
from textguard.llm.shingles import chunks

UNKNOWN = "und"
SAMPLE_DOCS = 2400
WINDOW = 60
BUCKETS = 1 << 17
BLOCK = 64
#: Letters, and letters around an apostrophe. Longer runs are several elements of the
#: chain, 24 letters each, so that scripts without spaces are read to their last letter.
_LETTERS = re.compile(r"[^\W\d_]{1,24}(?:['’][^\W\d_]{1,24})?")
_MOST = 49


def word_features(ws: list[str]) -> np.ndarray:
    """The feature buckets of each word; absent features point at the table's last, zero, row."""
    n = len(ws)
    cut = [w.lower()[:_MOST] for w in ws]  # lower case can be longer by a letter
    size = np.fromiter(map(len, cut), np.int64, n)
    m = np.zeros((n, _MOST + 2), np.uint64)
    m[:, 0] = 2
    if n:
        m[:, 1:-1] = np.array(cut, dtype=f"<U{_MOST}").view(np.uint32).reshape(n, _MOST)
    rows = np.arange(n)
    m[rows, size + 1] = 3

    def fold(columns: list[np.ndarray], kind: int) -> np.ndarray:
        h = np.full(n, kind, np.uint64)
        for c in columns:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(BUCKETS)).astype(np.int32)

    out = []
    absent = np.int32(BUCKETS)
    for k in (1, 2, 3):
        prefix = fold([m[:, j] for j in range(1, k + 1)], 10 + k)
        suffix = fold([m[rows, np.maximum(size - j, 0)] for j in range(k)], 20 + k)
        out += [np.where(size >= k, prefix, absent), np.where(size >= k, suffix, absent)]
    for k in (2, 3):
        for at in range(_MOST + 3 - k):
            if not (size + 2 >= at + k).any():
                break
            out.append(np.where(size + 2 >= at + k, fold([m[:, at + j] for j in range(k)], 30 + k), absent))
    out.append(fold([m[:, j] for j in range(1, int(size.max(initial=0)) + 2)], 40))  # the word itself
    return np.stack(out, axis=1) if n else np.zeros((0, 1), np.int32)


def unaries(ws: list[str], weights: np.ndarray) -> np.ndarray:
    """The score of each word for each label."""
    out = np.zeros((len(ws), weights.shape[1]), np.float32)
    for begin in range(0, len(ws), 20_000):
        part = ws[begin : begin + 20_000]
        for column in word_features(part).T:
            out[begin : begin + len(part)] += weights[column]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def messages(score: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, emission, beta) of every word of the chains that begin at
    ``starts`` (with the end of the last). Each chain has a word at least."""
    labels = score.shape[1]
    move = np.exp(transitions)
    length = np.diff(starts)
    blocks = -(-length // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    chain = np.repeat(np.arange(len(length)), blocks)
    begin = starts[:-1][chain] + (np.arange(first_block[-1]) - first_block[:-1][chain]) * BLOCK
    size = np.minimum(starts[1:][chain] - begin, BLOCK)
    at = np.minimum(begin[:, None] + np.arange(BLOCK), len(score) - 1)
    inside = np.arange(BLOCK) < size[:, None]
    emission = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float64)
    e = emission[at]
    # the transfer matrix of each block
    product = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
    steps = int(size.max(initial=0))
    for t in range(steps):
        new = (product.reshape(-1, labels) @ move).reshape(product.shape) * e[:, t, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        product = np.where(inside[:, t, None, None], new, product)
    # messages that enter each block from the left and from the right
    left = np.empty((len(begin), labels))
    right = np.empty((len(begin), labels))
    order = np.argsort(-blocks, kind="stable")
    ahead = np.full((len(length), labels), 1.0 / labels)
    back = np.full((len(length), labels), 1.0 / labels)
    for k in range(int(blocks.max(initial=0))):
        some = order[: np.searchsorted(-blocks[order], -k, side="left")]  # chains with more than k blocks
        b = first_block[some] + k
        left[b] = ahead[some]
        ahead[some] = _unit(np.einsum("ni,nij->nj", ahead[some], product[b]))
        b = first_block[some] + blocks[some] - 1 - k
        right[b] = back[some]
        back[some] = _unit(np.einsum("nij,nj->ni", product[b], back[some]))
    alpha = np.empty_like(emission)
    beta = np.empty_like(emission)
    for t in range(steps):
        left = np.where(inside[:, t, None], _unit((left @ move) * e[:, t]), left)
        alpha[at[:, t][inside[:, t]]] = left[inside[:, t]]
    for t in range(steps - 1, -1, -1):
        beta[at[:, t][inside[:, t]]] = right[inside[:, t]]
        right = np.where(inside[:, t, None], _unit((right * e[:, t]) @ move.T), right)
    return alpha, emission, beta


def marginals(score: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    alpha, _, beta = messages(score, starts, transitions)
    return _unit(alpha * beta)


def train(windows: list[tuple[list[str], int]], labels: int, epochs: int = 5, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) from windows of words with their label, by AdaGrad."""
    rng = np.random.default_rng(seed)
    index = {w: i for i, w in enumerate(dict.fromkeys(w for ws, _ in windows for w in ws))}
    features = word_features(list(index))
    weights = np.zeros((BUCKETS + 1, labels), np.float32)
    squares = np.full_like(weights, 1e-2)
    transitions = np.zeros((labels, labels))
    t_squares = np.full_like(transitions, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        # chains of one to three windows
        cuts = np.cumsum(rng.integers(1, 4, len(windows)))
        cuts = cuts[cuts < len(windows)]
        for batch in np.array_split(np.arange(len(cuts) + 1), max(1, len(cuts) // 60)):
            bounds = np.concatenate([[0], cuts, [len(windows)]])
            ids, gold, starts = [], [], [0]
            for c in batch:
                for w in order[bounds[c] : bounds[c + 1]]:
                    ids += [index[x] for x in windows[w][0]]
                    gold += [windows[w][1]] * len(windows[w][0])
                if len(ids) > starts[-1]:
                    starts.append(len(ids))
            if len(starts) < 2:
                continue
            own, local = np.unique(np.array(ids), return_inverse=True)
            columns = features[own].T
            score = np.zeros((len(own), labels), np.float32)
            for c in columns:
                score += weights[c]
            alpha, emission, beta = messages(score[local], np.array(starts), transitions)
            slope = _unit(alpha * beta)
            slope[np.arange(len(gold)), gold] -= 1
            per_word = np.stack([np.bincount(local, slope[:, j], len(own)) for j in range(labels)], axis=1)
            gradient = np.zeros_like(weights, dtype=np.float64)
            for j in range(labels):
                gradient[:, j] = np.bincount(columns.ravel(), np.tile(per_word[:, j], len(columns)), BUCKETS + 1)
            gradient[BUCKETS] = 0
            gradient = gradient / len(starts) + decay * weights
            squares += gradient**2
            weights -= (rate * gradient / np.sqrt(squares)).astype(np.float32)
            inner = np.ones(len(gold), bool)
            inner[np.array(starts[:-1])] = False
            here = np.flatnonzero(inner)
            pair = alpha[here - 1][:, :, None] * np.exp(transitions) * (emission[here] * beta[here])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            t_gradient = pair.sum(axis=0)
            np.add.at(t_gradient, (np.array(gold)[here - 1], np.array(gold)[here]), -1)
            t_gradient = t_gradient / len(starts) + 1e-3 * transitions
            t_squares += t_gradient**2
            transitions -= rate * t_gradient / np.sqrt(t_squares)
    return weights, transitions


def sample(docs: DataFrame, learn: Column, most: int = SAMPLE_DOCS) -> list[tuple[str, list[str]]]:
    """At most about ``most`` labelled windows of words, evenly over the languages."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.2 * most / len(counts) / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1_000_000)) / 1e6
    chosen = labelled.where(draw < share[F.col("lang")])
    ws = words("text")
    begin = (1 + F.pmod(F.xxhash64("text"), F.greatest(F.size(ws) - WINDOW + 1, F.lit(1)))).cast("int")
    cut = F.transform(F.slice(ws, begin, F.lit(WINDOW)), lambda w: F.substring(w, 1, 200))
    rows = chosen.select("lang", F.col("doc_id"), F.array_join(cut, " ").alias("w"))
    rows = rows.orderBy(F.xxhash64("w"), "w").limit(2 * most).collect()
    return [(r["lang"], found) for r in rows if (found := [w for w in _LETTERS.findall(r["w"]) if _lettered(w)])]


def _lettered(w: str) -> bool:
    return any(map(str.isalpha, w))


class _Words(dict):
    """Numbers of words, and those that are new."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.fresh.append(w)
        return n


def predict(docs: DataFrame, langs: list[str], weights: np.ndarray, transitions: np.ndarray) -> DataFrame:
    """``docs`` with columns doc_id, text, held_out: doc_id, held_out, lang_pred, score, n_words."""
    most = 150_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, table, real = _Words(), np.zeros((0, len(langs)), np.float32), np.zeros(0, bool)
        for batch in batches:
            for rows, texts in chunks(batch, most_chars=500_000):
                if len(numbers) > most:
                    numbers, table, real = _Words(), table[:0], real[:0]
                lists = [_LETTERS.findall(t) if t else [] for t in texts]
                n = np.fromiter(map(len, lists), np.int64, len(lists))
                starts = np.concatenate([[0], np.cumsum(n)])
                flat = np.fromiter((numbers[w] for ws in lists for w in ws), np.int64, int(starts[-1]))
                if fresh := numbers.fresh:
                    table = np.concatenate([table, unaries(fresh, weights)])
                    real = np.concatenate([real, np.fromiter(map(_lettered, fresh), bool, len(fresh))])
                    numbers.fresh = []
                some = np.flatnonzero(n)
                share = np.zeros((len(texts), len(langs)))
                counted = np.zeros(len(texts), np.int64)
                if len(some):
                    at = starts[:-1][some]
                    p = marginals(table[flat], np.append(at, starts[-1]), transitions)
                    share[some] = np.add.reduceat(p * real[flat][:, None], at)
                    counted[some] = np.add.reduceat(real[flat].astype(np.int64), at)
                best = share.argmax(axis=1)
                score = np.where(counted > 0, share.max(axis=1) / np.maximum(counted, 1), 0.0)
                names = [langs[b] if c else UNKNOWN for b, c in zip(best, counted, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(names, pa.string()), pa.array(np.round(np.clip(score, 0, 1), 6)), pa.array(counted)],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_words"],
                )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The language of every document, learned from those whose fold is not held out."""
    held_out = bucket_of(F.col("doc_id"), folds) == held
    found = sample(docs, ~held_out)
    langs = sorted({lang for lang, _ in found})
    slim = docs.select("doc_id", "text", held_out.alias("held_out"))
    if not langs:
        return slim.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"))
    number = {x: i for i, x in enumerate(langs)}
    weights, transitions = train([(ws, number[x]) for x, ws in found], len(langs))
    return predict(slim, langs, weights, transitions)
