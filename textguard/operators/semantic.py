"""What surrounds a semantic model: tokens, findings from its predictions, narrowing, merging.

The model itself is a function that is given; nothing here depends on one.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.scalars import B, let, running
from textguard.operators import state

#: Label (in the model's order), category, example, placeholder, words of its context.
LABELS = (
    ("confidential_business", "Business-sensitive information", "Replace this passage with a public, non-sensitive business summary.", "Example_Business_Detail", "strategy|acquisition|pricing|partnership|pipeline|deal|plan|board"),
    ("customer_confidential", "Customer-specific information", "Replace this passage with a fictional, non-identifying customer example.", "Example_Customer", "customer|client|account|tenant|contract|renewal|deployment"),
    ("employee_sensitive", "Employee-sensitive information", "Replace this passage with a generic, non-identifying employee example.", "Example_Employee", "employee|staff|salary|performance|candidate|leave|medical|termination"),
    ("financial_internal", "Non-public financial information", "Replace this passage with public or fictional financial figures.", "Example_Amount", "revenue|forecast|margin|budget|amount|cash|cost|earnings|financial"),
    ("unreleased_product", "Unreleased product information", "Replace this passage with information about an already public feature.", "Example_Product", "product|launch|feature|roadmap|release|project|codename"),
    ("internal_security", "Security-sensitive information", "Replace this passage with a general security best-practice example.", "Example_Security_Detail", "security|vulnerability|incident|access|control|exploit|credential"),
    ("legal_confidential", "Legal-sensitive information", "Replace this passage with a public, generic legal example.", "Example_Legal_Detail", "legal|contract|litigation|settlement|counsel|terms"),
    ("proprietary_technical", "Proprietary technical information", "Replace this passage with a public, generic technical example.", "Example_Technical_Detail", "architecture|algorithm|source|implementation|design|code|technical"),
)
SEMANTIC_LABELS = tuple(x[0] for x in LABELS)
#: What a segment ends with, and the smallest value of a category (in its first group, at the end of the match).
SEGMENT = r"[\s\S]+?(?:[!?;]+|\.(?=\s|\z)|\r?\n|\z)"
_AMOUNT = r"(?:%|percent|million|billion|thousand|[KMB])"
VALUES = {
    "Customer-specific information": (rf"{B}(?:[Cc]ustomer|[Cc]lient|[Aa]ccount|[Tt]enant)\s+(?:named\s+)?([A-Z][\w&.-]*(?:\s+[A-Z][\w&.-]*){{0,2}})",),
    "Employee-sensitive information": (rf"{B}(?:[Ee]mployee|[Ss]taff member|[Cc]andidate)\s+(?:named\s+)?([A-Z][\w'.-]*(?:\s+[A-Z][\w'.-]*){{0,2}})",),
    "Non-public financial information": (rf"(?i)([$€£]\s*\d[\d,]*(?:\.\d+)?\s*{_AMOUNT}?)", rf"(?i)(?:^|[^\w])((?:\d[\d,]*(?:\.\d+)?)\s*{_AMOUNT})(?=\z|[^\w])"),
    "Unreleased product information": (rf"{B}(?:[Pp]roject|[Pp]roduct|[Ff]eature|[Cc]odename)\s+([A-Z][\w.-]*(?:\s+[A-Z][\w.-]*){{0,2}})",),
}
_MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DATE = rf"(?i){B}((?:20\d{{2}}|19\d{{2}})[-/]\d{{1,2}}[-/]\d{{1,2}}|(?:{_MONTH})\s+\d{{1,2}}(?:,\s*(?:19|20)\d{{2}})?){B}"


def _by_category(category: Column, makes: dict[str, Column], other: Column) -> Column:
    for name, made in makes.items():
        other = F.when(category == name, made).otherwise(other)
    return other


def placeholder(category: Column) -> Column:
    """The neutral value of a category."""
    return _by_category(category, {name: F.lit(x) for _, name, _, x, _ in LABELS}, F.lit("Example_Sensitive_Detail"))


def context_score(segment: Column, category: Column) -> Column:
    """How many words of the category's context a segment has; null for an unknown category."""
    makes = {name: F.size(F.regexp_extract_all(segment, F.lit(f"(?i){B}(?:{words}){B}"), F.lit(0))) for _, name, _, _, words in LABELS}
    return _by_category(category, makes, F.lit(None).cast("int"))


def smallest_value(value: Column, category: Column) -> Column:
    """struct<at, n> of the category's smallest value in a text; null without one."""

    def place(pattern: str) -> Column:
        match, group = F.regexp_extract(value, pattern, 0), F.regexp_extract(value, pattern, 1)
        # what a match is found after: the text before it
        before = F.length(F.get(F.split(value, pattern, 2), F.lit(0)))
        return F.when(group != "", F.struct((before + F.length(match) - F.length(group)).alias("at"), F.length(group).alias("n")))

    makes = {name: F.coalesce(*map(place, patterns)) for name, patterns in VALUES.items()}
    return _by_category(category, makes, place(DATE))


def narrowed(text: Column, start: Column, end: Column, category: Column) -> Column:
    """struct<start, end>: the part of a passage that a semantic finding is about. The
    segment with the most words of its context, without white space and end marks, or its
    smallest value; the finding as it is given where no segment stands out, even if it
    reaches beyond the text."""
    same = lambda z: F.struct(z["start"].alias("start"), z["end"].alias("end"))
    given = lambda z: (z["start"].alias("start"), z["end"].alias("end"))
    passage = F.struct(
        start.alias("start"), end.alias("end"), F.greatest(start, F.lit(0)).alias("a"), F.least(end, F.length(text)).alias("b"), category.alias("c"),
    )

    def of_segments(z: Column) -> Column:
        segments = F.regexp_extract_all(z["text"], F.lit(SEGMENT), F.lit(0))
        known = F.struct(*given(z), z["a"].alias("a"), z["c"].alias("c"), segments.alias("s"), running(F.transform(segments, F.length)).alias("at"))
        return let(known, chosen)

    def chosen(z: Column) -> Column:
        ranked = F.array_sort(F.transform(z["s"], lambda x, i: F.struct((-context_score(x, z["c"])).alias("score"), i.alias("i"))))
        best = F.when(F.size(z["s"]) == 1, 0).when(F.get(ranked, F.lit(0))["score"] < 0, F.get(ranked, F.lit(0))["i"])
        found = F.struct(*given(z), z["a"].alias("a"), z["c"].alias("c"), F.get(z["s"], best).alias("raw"), F.get(z["at"], best).alias("at"))
        return let(found, cut)

    def cut(z: Column) -> Column:
        lead = F.length(z["raw"]) - F.length(F.regexp_replace(z["raw"], r"^\s+", ""))
        content = F.regexp_replace(F.regexp_replace(z["raw"], r"^\s+", ""), r"[\s.!?;]+\z", "")
        begin = z["a"] + z["at"] + lead
        known = F.struct(*given(z), begin.alias("begin"), content.alias("content"), smallest_value(content, z["c"]).alias("v"))
        return let(known, lambda y: F.when(y["content"].isNull() | (y["content"] == ""), same(y)).otherwise(
            F.struct((y["begin"] + F.coalesce(y["v"]["at"], F.lit(0))).alias("start"), (y["begin"] + F.coalesce(y["v"]["at"], F.lit(0)) + F.coalesce(y["v"]["n"], F.length(y["content"]))).alias("end"))))

    def whole(z: Column) -> Column:
        inner = F.struct(*given(z), z["a"].alias("a"), z["c"].alias("c"), F.substring(text, z["a"] + 1, z["b"] - z["a"]).alias("text"))
        return F.when(z["b"] <= z["a"], same(z)).otherwise(let(inner, of_segments))

    return let(passage, whole)


def semantic_findings(docs: DataFrame, predictions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The findings of predictions (key, label, start, end, confidence), merged by label where
    they overlap or touch, in their texts (key, text; keys are unique)."""
    merged = state.merged_intervals(predictions, [key, "label"])
    table = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("label", "category", "safe"), row, strict=False)]) for row in LABELS])
    details = F.get(F.filter(table, lambda x: x["label"] == F.col("label")), F.lit(0))
    rows = docs.select(key, "text").join(merged, key).withColumn("_d", details).withColumn("original_value", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    n = F.length("original_value")
    return rows.select(
        key, F.lit("semantic").alias("detector"), F.col("_d.category").alias("category"), F.lit("medium").alias("severity"), "confidence", "start", "end", "original_value",
        F.concat(F.lit("[Masked passage, "), n.cast("string"), F.lit(" characters]")).alias("masked_preview"),
        F.concat(F.lit("[REDACTED "), F.upper("_d.category"), F.lit("]")).alias("replacement_value"), F.col("_d.safe").alias("safe_example_value"), F.lit("semantic").alias("source"),
        F.when(n < 32, "short").when(n < 128, "medium").when(n < 512, "long").otherwise("very-long").alias("length_bucket"), F.lit("medium").alias("entropy_bucket"),
        F.concat(F.lit("semantic:"), "label", F.lit(",overlapping-token-chunk")).alias("structures"),
    )


def merged_findings(found: DataFrame, semantic: DataFrame, key: str = "doc_id") -> DataFrame:
    """All findings of the detectors and the semantic ones, which are not safe to replace
    where they overlap one of the detectors'."""
    flagged = state.overlaps(semantic, found, key)
    return found.withColumn("replacement_safe", F.lit(True)).unionByName(flagged, allowMissingColumns=True)


def with_semantic(found: DataFrame, docs: DataFrame, scanner: Callable[[DataFrame], DataFrame], enabled: bool = True) -> DataFrame:
    """The detectors' findings with those of a semantic scanner (docs -> findings); without
    them if that is off or can't be planned. Blank texts are not shown to the scanner."""
    if enabled:
        try:
            return merged_findings(found, scanner(docs.where(F.col("text").rlike(r"\S"))))
        except Exception as e:  # whatever a plugged-in model raises
            warnings.warn(f"semantic scan unavailable: {type(e).__name__}", stacklevel=2)
    return found.withColumn("replacement_safe", F.lit(True))


def checked_head(labels: list[str], coefficients: list[list[float]], intercepts: list[float], thresholds: list[float], width: int = 384) -> None:
    """Raises unless a linear head has all labels in order and fitting dimensions."""
    n = len(SEMANTIC_LABELS)
    if tuple(labels) != SEMANTIC_LABELS or len(coefficients) != n or any(len(row) != width for row in coefficients) or len(intercepts) != n or len(thresholds) != n:
        raise ValueError("the classifier's dimensions or labels do not fit")


_IDEOGRAPHS = r"\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf\uf900-\ufaff"
#: An ideograph, a run of other letters and digits, or a mark; control characters are spaces.
_SEGMENT = regex.compile(rf"[{_IDEOGRAPHS}]|[[\p{{L}}\p{{N}}]--[{_IDEOGRAPHS}]]+|[^\s\p{{L}}\p{{N}}\p{{Cc}}\p{{Cf}}]", regex.V1)
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_ASCII_SEGMENT = re.compile(r"[A-Za-z0-9]+|[!-/:-@\[-`{-~]")


@cache
def _plane_segment() -> re.Pattern:
    """_SEGMENT for texts of the first plane, with its classes as ranges, which are read off
    _SEGMENT itself: the standard library's engine finds words several times faster."""
    first = "".join(map(chr, range(0x10000)))
    runs = [m[0] for m in _SEGMENT.finditer(first)]
    # an ideograph or a mark stands by itself, and so may a letter or digit between two others
    word = regex.compile(rf"[[\p{{L}}\p{{N}}]--[{_IDEOGRAPHS}]]", regex.V1)
    kinds: tuple[list[str], list[str]] = ([], [])
    for run in runs:
        kinds[0 if word.match(run) else 1].append(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}")
    return re.compile(f"[{''.join(kinds[0])}]+|[{''.join(kinds[1])}]")


def segment_pattern(text: str) -> re.Pattern | regex.Pattern:
    """What finds the segments of this text as _SEGMENT does, as fast as can be."""
    if text.isascii():
        return _ASCII_SEGMENT
    return _SEGMENT if _BEYOND.search(text) else _plane_segment()


class WordPieces:
    """The longest pieces of a vocabulary from left to right in each word, looked up among the
    pieces that begin a word and those that go on. A word is cut once however often it
    occurs; what is remembered has a bound."""

    MOST = 100_000

    def __init__(self, vocabulary: dict[str, int], unknown: str = "[UNK]", prefix: str = "##", longest: int = 100) -> None:
        self.unknown, self.longest, self.known = vocabulary[unknown], longest, {}
        self.first = vocabulary
        self.later = {piece[len(prefix) :]: number for piece, number in vocabulary.items() if piece.startswith(prefix)}
        self.reach = max(map(len, self.first)), max(map(len, self.later), default=0)

    def cut(self, word: str) -> list[int]:
        plain = word.lower()
        if not plain.isascii():
            plain = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.category(c).startswith("M"))
        n = len(plain)
        if n > self.longest:
            return [self.unknown]
        out, at, pieces, reach = [], 0, self.first, self.reach[0]
        while at < n:
            for k in range(min(n, at + reach), at, -1):
                if (number := pieces.get(plain[at:k])) is not None:
                    break
            else:
                return [self.unknown]
            out.append(number)
            at, pieces, reach = k, self.later, self.reach[1]
        return out

    def arrays(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, ends) of a text; offsets are the words'."""
        text = text or ""
        spans = [m.span() for m in segment_pattern(text).finditer(text)]
        found = [self.known.get(text[a:b]) for a, b in spans]
        for i, (a, b) in enumerate(spans) if None in found else ():
            if found[i] is None:
                if len(self.known) >= self.MOST:
                    self.known.clear()
                found[i] = self.known[text[a:b]] = self.cut(text[a:b])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        places = np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)
        return ids, np.repeat(places[:, 0], sizes), np.repeat(places[:, 1], sizes)

    def __call__(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """The same as lists."""
        ids, starts, ends = self.arrays(text)
        return ids.tolist(), starts.tolist(), ends.tolist()


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def word_pieces(texts: DataFrame, vocabulary: dict[str, int], unknown: str = "[UNK]", prefix: str = "##", longest: int = 100) -> DataFrame:
    """``texts`` (with a column text) and ids, starts, ends: the longest pieces of the
    vocabulary from left to right in each word, lower-cased and without accents. A word
    that pieces can't make, or of over ``longest`` characters, is unknown. Offsets are the
    word's, in code points. The vocabulary is a model's constant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordPieces(vocabulary, unknown, prefix, longest)
        for batch in batches:
            columns = zip(*map(pieces, batch.column("text").to_pylist()), strict=True) if batch.num_rows else ([], [], [])
            made = [pa.array(list(x), pa.list_(pa.int32())) for x in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "ids", "starts", "ends"])

    return texts.mapInArrow(run, _fields(texts) + ", ids array<int>, starts array<int>, ends array<int>")


@dataclass(frozen=True)
class Head:
    """A linear layer with a sigmoid over unit vectors: a row of coefficients, an intercept
    and a threshold for each label, in the order of SEMANTIC_LABELS."""

    coefficients: list[list[float]]
    intercepts: list[float]
    thresholds: list[float]

    def __post_init__(self) -> None:
        checked_head(list(SEMANTIC_LABELS), self.coefficients, self.intercepts, self.thresholds, len(self.coefficients[0]) if self.coefficients else 0)


#: What a model's loader gives: hidden states (texts, tokens, width) of ids and their mask.
Encode = Callable[[np.ndarray, np.ndarray], np.ndarray]
_LOADED: dict[str, Encode] = {}


def loaded(name: str, load: Callable[[], Encode]) -> Encode:
    """The encoder of that name, loaded once in the life of a worker."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean over the tokens that the mask keeps, as a vector of length 1 (or 0)."""
    shown = np.where(mask[:, :, None] > 0, hidden, 0.0).astype(np.float64)
    mean = shown.sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
    norm = np.sqrt((mean * mean).sum(axis=1, keepdims=True))
    return mean / np.where(norm > 0, norm, 1.0)


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """The windows over ``n`` tokens of which each holds ``size`` and shares ``overlap`` with the next."""
    step = size - max(0, min(overlap, size - 1))
    out, at = [], 0
    while at < n:
        out.append((at, min(n, at + size)))
        if out[-1][1] == n:
            break
        at += step
    return out


def text_vectors(tokens: tuple[Sequence[int], Sequence[int], Sequence[int]], encode: Encode, ends: tuple[int, int], tokens_most: int, overlap: int, batch: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The vectors of a text's windows and where they stand in it."""
    ids, starts, stops = tokens
    spans = windows(len(ids), tokens_most - 2, overlap)
    chunks = [np.concatenate([[ends[0]], ids[a:b], [ends[1]]]) for a, b in spans]
    out = []
    for k in range(0, len(chunks), batch):
        some = chunks[k : k + batch]
        length = max(map(len, some))
        padded, mask = np.zeros((len(some), length), np.int64), np.zeros((len(some), length), np.int64)
        for row, chunk in enumerate(some):
            padded[row, : len(chunk)], mask[row, : len(chunk)] = chunk, 1
        hidden = np.asarray(encode(padded, mask))
        if hidden.ndim != 3 or hidden.shape[:2] != padded.shape:
            raise ValueError("the encoder's output has unexpected dimensions")
        out.append(pooled(hidden, mask))
    return np.concatenate(out), [(starts[a], stops[b - 1]) for a, b in spans]


def predicted(
    texts: DataFrame, vocabulary: dict[str, int], name: str, load: Callable[[], Encode], head: Head, tokens_most: int = 128, overlap: int = 24, batch: int = 4,
) -> DataFrame:
    """``texts`` (with a column text) and predictions (label, start, end, confidence: what
    reaches its label's threshold in any window, merged by label where windows overlap or
    touch) and semantic_error, the kind of failure of a text's inference, null without one.

    ``load`` gives the encoder and is called once in a worker. A text that is blank is not
    shown to it. A failure while loading or in a text is that text's alone: its predictions
    are empty, the others and the job go on.
    """
    fields = "array<struct<label:string,start:int,end:int,confidence:double>>"
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
    weights, intercepts, thresholds = np.array(head.coefficients), np.array(head.intercepts), np.array(head.thresholds)

    def of_text(text: str, pieces: WordPieces) -> list[dict]:
        tokens = pieces.arrays(text)
        if not len(tokens[0]):
            return []
        vectors, spans = text_vectors(tokens, loaded(name, load), (vocabulary["[CLS]"], vocabulary["[SEP]"]), tokens_most, overlap, batch)
        score = 1 / (1 + np.exp(-(vectors @ weights.T + intercepts)))
        out: list[dict] = []
        for k, label in enumerate(SEMANTIC_LABELS):
            before = None
            for w in np.flatnonzero(score[:, k] >= thresholds[k]):  # by start
                start, end = map(int, spans[w])
                if before and start <= before["end"]:
                    before.update(end=max(before["end"], end), confidence=max(before["confidence"], float(score[w, k])))
                else:
                    before = {"label": label, "start": start, "end": end, "confidence": float(score[w, k])}
                    out.append(before)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordPieces(vocabulary)
        for part in batches:
            found, errors = [], []
            for text in part.column("text").to_pylist():
                try:
                    found.append(of_text(text, pieces) if text and text.strip() else [])
                    errors.append(None)
                except Exception as e:  # whatever a plugged-in model raises
                    found.append([])
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind), pa.array(errors, pa.string())], names=[*part.schema.names, "predictions", "semantic_error"])

    return texts.mapInArrow(run, f"{_fields(texts)}, predictions {fields}, semantic_error string")


def kept_findings(rows: DataFrame, keep: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """``rows`` (with a column findings) and filter_error: their findings as a given filter
    leaves them. Where the filter fails, a text keeps all of its findings: a store that can't
    be reached never hides one."""
    kind = _fields(rows) + ", filter_error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = part.schema.get_field_index("findings")
            found, errors = [], []
            for findings in part.column(at).to_pylist():
                error = None
                if findings:
                    try:
                        findings = keep(findings)
                    except Exception as e:  # whatever the filter raises
                        error = type(e).__name__
                found.append(findings)
                errors.append(error)
            columns = [pa.array(found, part.schema.field(at).type) if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], names=[*part.schema.names, "filter_error"])

    return rows.mapInArrow(run, kind)
