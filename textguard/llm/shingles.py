"""Word and shingle hashes of many texts at once, for use inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import WORD, written

SIZE = 5
_WORD = re.compile(WORD)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    MOST = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def shingle_hashes(hashes: np.ndarray, starts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of runs of word hashes: (the run of each shingle, its hash).

    ``starts`` holds where each run begins, and the end of the last. A run of
    fewer than ``size`` words is one shingle; an empty run has none.
    """
    lengths = np.diff(starts)
    count = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(lengths)), count)
    first = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    out = np.zeros(len(owner), np.uint64)
    short = lengths[owner] < size
    for k in range(size):
        inside = ~short | (k < lengths[owner])
        at = np.minimum(first + k, max(len(hashes) - 1, 0))
        out = out * _MULTIPLIER + np.where(inside, hashes[at] if len(hashes) else 0, np.uint64(0))
    return owner, mix(out)


def chunks(batch: pa.RecordBatch, text: str = "text", most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch whose texts have about ``most_chars`` characters at most,
    with their texts. A longer text is a slice of its own."""
    texts = batch.column(text).to_pylist()
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and (size + n > most_chars or i - begin >= 60_000):
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def hashed(texts: list, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes, and where each text's begin (with the end of the last)."""
    lists = [words_of(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = np.fromiter((cache[w] for x in lists for w in x), np.uint64, int(starts[-1]))
    return flat, starts


def with_row_id(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``_rid`` that tells rows apart, repeated ones too.

    The number follows from a row's place in its table, so a table must read the
    same each time. What comes out of a shuffle does not, and is written first.
    """
    plan = docs._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "ShuffleQueryStage" in plan:
        docs = written(docs, "rows")
    return docs.withColumn("_rid", F.monotonically_increasing_id())


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
