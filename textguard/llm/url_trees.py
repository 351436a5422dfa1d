"""URL filtering by rules and gradient-boosted trees on lexical features.

Rules name a host and the beginning of a path; the longest that fits decides.
The URLs that rules decide are the labelled ones: boosted trees learn from them
and judge the rest by lexical features alone: lengths, depth, digits, entropy,
parameters, and statistics of the host's suffix and of the path's first
directory (their frequency in the corpus and the smoothed blocked share of
their labelled URLs).

Features are DataFrame expressions and suffix statistics cover all pages. Trees
are fitted on at most SAMPLE_ROWS labelled URLs. Suffix statistics of the
MOST_SUFFIXES most frequent are broadcast, any others joined by a shuffle. The
pages are read once; what follows reads a table of their features.

Defined cases: a null URL and one without ``://`` have an empty host and path,
fit no rule and are judged by their features; a host may be empty; without
labelled URLs all are allowed, with one kind only all get that verdict;
repeated rows get equal verdicts; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import discard, drawn, written

#: host and path prefix, verdict
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SAMPLE_ROWS = 20_000
MOST_SUFFIXES = 50_000
BINS = 32
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "host_dots", "longest_part", "has_fragment", "has_extension", "suffix_log_count", "suffix_blocked", "head_log_count", "head_blocked")


def parts(df: DataFrame) -> DataFrame:
    """``df`` (with url) and host, path, _query."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = df.withColumn("host", lower).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
    return df.withColumn("_query", F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)).drop("_rest")


def fits(host: str, path: str) -> Column:
    """Whether a rule's host is the URL's or above it, and the path begins as the rule's."""
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def with_rule(df: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``df`` and rule (the longest that fits, else null) and _verdict (its own)."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, v in reversed(longest):
        rule = F.when(fits(host, path), host + path).otherwise(rule)
        verdict = F.when(fits(host, path), v).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("_verdict", verdict)


def lexical(df: DataFrame) -> DataFrame:
    """``df`` (with url, host, path, _query) and the lexical features but for the suffix's, and _suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    # the URL's characters in order: runs of one character give the counts
    df = df.withColumn("_url", url).withColumn("_kinds", F.array_distinct(F.split(url, "")))
    entropy = F.expr("""aggregate(transform(_kinds, c -> (length(_url) - length(replace(_url, c, ''))) / greatest(length(_url), 1)),
        0D, (s, p) -> s + if(p > 0, -p * log2(p), 0D))""")
    last = F.regexp_extract("path", r"[^/]*$", 0)
    df = df.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n,
            "entropy": entropy,
            "parameters": F.when(F.col("_query") == "", 0.0).otherwise(F.size(F.split("_query", "[&;]")).cast("double")),
            "hyphens": (F.length(url) - F.length(F.translate(url, "-_", ""))).cast("double"),
            "host_dots": (F.length("host") - F.length(F.translate("host", ".", ""))).cast("double"),
            "longest_part": F.coalesce(F.array_max(F.transform(F.split("host", r"\."), F.length)), F.lit(0)).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "has_extension": last.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
            "_suffix": F.substring_index("host", ".", -1),
            # a directory, such as that of a language; a path's only part is no directory
            "_head": F.regexp_extract(F.lower("path"), r"^/([^/]+)/", 1),
        }
    )
    return df.drop("_url", "_kinds")


def joined(df: DataFrame, per: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """``df`` with the row of ``per`` of its key. The ``most`` keys that ``size`` counts most rows of are
    broadcast; what is left, of keys that none has many rows of, is joined by a shuffle."""
    per = written(per, "url-statistics")
    if per.count() <= most:
        return df.join(F.broadcast(per.drop(size)), key)
    hot = per.orderBy(F.col(size).desc(), key).limit(most)
    cold = per.join(F.broadcast(hot.select(key)), key, "left_anti")
    met = df.join(F.broadcast(hot.withColumnRenamed(size, "_met")), key, "left")
    rest = met.where("_met IS NULL").select(*df.columns).join(cold.drop(size), key)
    return met.where("_met IS NOT NULL").drop("_met").unionByName(rest)


def with_suffix_statistics(df: DataFrame, most: int = MOST_SUFFIXES) -> DataFrame:
    """``df`` (a written table) and, of the host's suffix and of the path's first part, how
    many URLs share it and how often labelled ones are blocked."""
    out = df
    for key, name in (("_suffix", "suffix"), ("_head", "head")):
        per = df.groupBy(key).agg(F.count("*").alias("_n"), F.count("_verdict").alias("_labelled"), F.count(F.when(F.col("_verdict") == "block", 1)).alias("_blocked"))
        # ten pseudo-labels keep a rare suffix, and so a URL's own label, near one half
        per = per.select(key, "_n", F.log1p("_n").alias(f"{name}_log_count"), ((F.col("_blocked") + 5.0) / (F.col("_labelled") + 10.0)).alias(f"{name}_blocked"))
        out = joined(out, per, key, "_n", most)
    return out


class Trees:
    """Gradient boosting for the log loss over binned features, in numpy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, least: int = 10, ridge: float = 1.0):
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rate, self.depth = rate, depth
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.0
        self.base = float(np.log(share / (1 - share))) if len(y) else -1.0
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
        if not len(y) or y.min() == y.max():
            return
        binned = self.binned(x)
        margin = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            feature, cut, leaf, at = self.grow(binned, p - y, p * (1 - p), least, ridge)
            self.trees.append((feature, cut, leaf))
            margin += rate * leaf[at]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def grow(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, least: int, ridge: float):
        """A complete tree: each level splits all its nodes; one that gains nothing sends all rows left."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, BINS)
        node = np.zeros(len(gradient), int)
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            here = node - first
            for f in range(binned.shape[1]):
                key = here * (BINS + 1) + binned[:, f]
                g, h, c = (np.cumsum(np.bincount(key, w, n * (BINS + 1)).reshape(n, -1), axis=1) for w in (gradient, weight, None))
                ga, ha, ca = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (ga - g) ** 2 / (ha - h + ridge) - ga**2 / (ha + ridge)
                gain = np.where((c >= least) & (ca - c >= least), gain, 0)
                at = gain.argmax(axis=1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + n][better] = f
                cut[first : first + n][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        node -= inner
        leaves = 2**self.depth
        leaf = -np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + ridge)
        return feature, cut, leaf, node

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of a block."""
        margin = np.full(len(x), self.base)
        binned = self.binned(x)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            margin += self.rate * leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-margin))


def featured(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, _verdict and the features of every page, as a written table."""
    slim = lexical(with_rule(parts(pages.select("page_id", "url")), rules))
    own = written(slim.drop("url", "_query"), "url-features")
    df = with_suffix_statistics(own).select("page_id", "host", "path", "rule", "_verdict", F.array(*FEATURES).alias("_x"))
    out = written(df, "url-vectors")
    discard(own)
    return out


def judge_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (of a block)."""
    df = featured(pages, rules)
    labelled = df.where("_verdict IS NOT NULL").count()
    # drawn by a hash of the row: no task hands on more than its part of the sample
    some = df.where("_verdict IS NOT NULL").where(drawn(SAMPLE_ROWS, labelled, F.col("page_id").cast("string"), F.col("host"), F.col("path"), F.col("_x")))
    rows = some.select("_x", (F.col("_verdict") == "block").cast("double").alias("y"))
    # repeated rows could exceed the bound; the first by hash are taken, whatever the run
    rows = rows.orderBy(F.xxhash64("_x", "y"), "_x", "y").limit(2 * SAMPLE_ROWS).toPandas()
    x = np.stack(rows["_x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    trees = Trees(x, rows["y"].to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = np.round(trees.scores(x), 6)
            own = batch.column("_verdict").to_pylist()
            verdict = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(own, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("page_id", "host", "path", "rule")] + [pa.array(verdict, pa.string()), pa.array(score)],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return df.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
