"""Quality rules combined by weak supervision.

Each rule votes *bad*, *good* or abstains on a document. Expectation
maximisation over the vote patterns estimates how often every rule is right on
bad and on good documents, and a document is judged by its posterior
probability of being good. No rule can veto on its own: a rule that the others
contradict loses its weight.

Everything runs as DataFrame expressions. The only thing that reaches the
driver is the count of each vote pattern, at most ``3 ** len(RULES)`` rows
whatever the input's size.

Defined cases: a null text has no words and fails the base rules, as does an
empty one; ties and repeated rows are judged alike; an empty table gives an
empty result; extra columns pass through ``filter_quality`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import SPACES, count_chars, words, written

WINDOW = 8
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"

#: name, the measure as SQL over the features, above which it votes bad and
#: below which good (or the other way round where bad < good). Between, or without a
#: word: abstains.
RULES = (
    ("symbols", "n_symbols / nullif(n_words, 0)", 0.1, 0.03),
    ("letters", "n_letters / nullif(word_chars, 0)", 0.75, 0.88),
    ("plain_words", "n_plain / nullif(n_words, 0)", 0.75, 0.9),
    ("repeats", "n_repeat_words / nullif(n_words, 0)", 0.25, 0.1),
    ("stutter", "n_stutter / nullif(n_words, 0)", 0.25, 0.05),
    ("capitals", "n_capitals / nullif(word_chars, 0)", 0.5, 0.2),
    ("exclaims", "n_exclaims / nullif(n_words, 0)", 0.3, 0.1),
    ("dup_lines", "n_dup_lines / nullif(n_lines, 0)", 0.5, 0.1),
    ("variety", "n_distinct / nullif(sqrt(n_words), 0)", 1.5, 3.0),
    ("word_length", "abs(word_chars / nullif(n_words, 0) - 6)", 6.0, 3.0),
)
N_PATTERNS = 3 ** len(RULES)

FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_stutter", "n_capitals", "n_exclaims", "n_lines", "n_distinct", "n_letters", "n_plain",
)


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of FEATURES, all long and never null.

    Windows of eight words are compared by their 64-bit hashes. Hashes are
    sorted only in the documents where one occurs twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words(F.col(text)))
    df = df.withColumn("_n", F.size("_words"))
    df = df.withColumn("_ids", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_windows",
        F.when(
            F.col("_n") >= WINDOW,
            F.expr(f"transform(sequence(1, _n - {WINDOW - 1}), i -> xxhash64(slice(_ids, i, {WINDOW})))"),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.expr("zip_with(_windows, sequence(0, size(_windows) - 1), (h, p) -> named_struct('h', h, 'p', p))")),
        ),
    )
    df = df.withColumn(
        "_starts",
        F.expr("""sort_array(filter(transform(sequence(1, size(_sorted)), k ->
            CASE WHEN (k > 1 AND _sorted[k - 2].h = _sorted[k - 1].h)
                   OR (k < size(_sorted) AND _sorted[k].h = _sorted[k - 1].h)
                 THEN _sorted[k - 1].p END), p -> p IS NOT NULL))"""),
    )
    covered = F.expr(f"""coalesce(aggregate(zip_with(_starts, slice(_starts, 2, size(_starts)),
        (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (s, x) -> s + x), 0L)""")
    stutter = F.expr("size(filter(zip_with(_ids, slice(_ids, 2, greatest(_n, 1)), (a, b) -> a = b), x -> x))")
    df = df.withColumn(
        "_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    )
    return df.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "word_chars": (F.length(t) - count_chars(t, SPACES)).cast("long"),
            "n_symbols": count_chars(t, SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered,
            "n_stutter": stutter.cast("long"),
            "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
            "n_exclaims": count_chars(t, "!"),
            "n_lines": F.size("_lines").cast("long"),
            "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")).cast("long"),
            # a letter, and at the end at most one other character
            "n_plain": F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}.?$"))).cast("long"),
            "n_distinct": F.size(F.array_distinct("_ids")).cast("long"),
        }
    ).drop("_words", "_n", "_ids", "_windows", "_sorted", "_starts", "_lines")


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def pattern() -> Column:
    """All votes in one number: a base-3 digit for each rule, 0 bad, 1 abstains, 2 good."""
    out = F.lit(0)
    for _, measure, bad, good in RULES:
        m = F.expr(measure)
        is_bad, is_good = (m > bad, m < good) if bad > good else (m < bad, m > good)
        out = out * 3 + F.when(is_bad, 0).when(is_good, 2).otherwise(1)
    return out.cast("int")


def votes_of(p: int) -> list[int]:
    """The digits of a pattern less one: -1 bad, 0 abstains, 1 good."""
    out = []
    for _ in RULES:
        out.append(p % 3 - 1)
        p //= 3
    return out[::-1]


def posteriors(counts: dict[int, int], rounds: int = 100, strength: float = 2.0, trust: float = 0.1) -> dict[int, float]:
    """Each pattern's probability of good, by expectation maximisation.

    ``counts`` holds the documents of each vote pattern. Rules are taken as
    independent given the class; an abstention is no evidence. The start calls
    a document bad that any rule calls bad; ``strength`` pseudo-votes keep
    every estimate off 0 and 1. A rule is written so as seldom to accuse a good
    document: the prior says once in 100, and weighs as ``trust`` times all
    documents. Without it, a kind of junk that few rules see would be taken for
    another kind of good documents.
    """
    votes = {p: votes_of(p) for p in counts}
    good = {p: 0.1 if -1 in v else 0.9 for p, v in votes.items()}
    for _ in range(rounds):
        total = sum(counts.values())
        share = (sum(n * good[p] for p, n in counts.items()) + strength) / (total + 2 * strength)
        right = []
        for j in range(len(RULES)):
            on_bad, all_bad = strength, 2 * strength
            on_good, all_good = strength + 0.99 * trust * total, 2 * strength + trust * total
            for p, n in counts.items():
                if v := votes[p][j]:
                    all_good += n * good[p]
                    all_bad += n * (1 - good[p])
                    on_good += n * good[p] * (v > 0)
                    on_bad += n * (1 - good[p]) * (v < 0)
            right.append((on_good / all_good, on_bad / all_bad))
        new = {}
        for p, v in votes.items():
            log_odds = math.log(share / (1 - share))
            for (g, b), x in zip(right, v, strict=True):
                if x > 0:
                    log_odds += math.log(g / (1 - b))
                elif x < 0:
                    log_odds += math.log((1 - g) / b)
            new[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds))))
        done = max((abs(new[p] - good[p]) for p in new), default=0) < 1e-9
        good = new
        if done:
            break
    return good


def judge(featured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, posterior and kept to a written table of features.

    The rules' accuracies are estimated on all documents with a word.
    """
    votes = featured.withColumn("_pattern", pattern())
    counted = votes.where("n_words > 0").groupBy("_pattern").count()
    counts = {r["_pattern"]: r["count"] for r in counted.collect()}  # at most N_PATTERNS rows
    good = posteriors(counts)
    # one constant, read at the pattern's place: a map would be searched for each row
    lookup = F.split(F.lit(",".join(repr(good.get(p, 0.0)) for p in range(max(good, default=0) + 1))), ",").cast("array<double>")
    posterior = F.coalesce(F.get(lookup, F.col("_pattern")), F.lit(0.0))
    return (
        votes.withColumn("base_failed", base_failed())
        .withColumn("posterior", posterior)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .drop("_pattern")
    )


def score_quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the features, base_failed, kept, posterior."""
    featured = written(features(docs.select("doc_id", "text")).drop("text"), "quality")
    return judge(featured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior",
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns.

    The rows travel as one struct, so that no column of the input can clash
    with a feature; they are written once beside their features and never
    shuffled.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("text"))
    featured = written(features(rows).drop("text"), "quality-rows")
    return judge(featured).where("kept").select("_row.*")
