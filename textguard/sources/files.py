"""File names, formats and limits; files' bytes to text, findings and sanitised copies."""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.scalars import settled_row

#: Extensions that are read as text.
TEXT_EXTENSIONS = (
    ".txt", ".md", ".csv", ".json", ".yaml", ".yml", ".xml", ".env", ".log", ".py", ".js", ".ts", ".tsx",
    ".jsx", ".java", ".go", ".rs", ".php", ".rb", ".cs", ".cpp", ".c", ".h", ".sh", ".ps1", ".sql",
)
MOST_BYTES = 10 * 1024 * 1024
MOST_CHARS = 2_000_000
MOST_FILES = 10
MOST_TOTAL = 25 * 1024 * 1024


def positive_limit(value: float | None, fallback: int) -> int:
    """A limit as given, rounded down; the fallback for what is no finite number above 0."""
    return math.floor(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value > 0 else fallback


@dataclass(frozen=True)
class Limits:
    """What a scan of files takes on: bytes of a file, characters that are read of it."""

    bytes: float | None = None
    chars: float | None = None

    @property
    def most_bytes(self) -> int:
        return positive_limit(self.bytes, MOST_BYTES)

    @property
    def most_chars(self) -> int:
        return positive_limit(self.chars, MOST_CHARS)


USUAL = Limits()


def base_name(name: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(name)), r"[^\\/]*\z", 0)


def file_extension(name: Column) -> Column:
    """The lower-case extension with its dot; null without one."""
    base = base_name(name)
    found = F.regexp_extract(base, r"^.+(\.[^.]+)\z", 1)
    return F.when(base.rlike(r"^\.env(\.[a-z0-9_-]+)?\z"), ".env").when(found != "", found)


def file_format(name: Column, mime: Column) -> Column:
    """text, pdf or docx; the media type counts only without an extension."""
    e, m = file_extension(name), F.lower(mime)
    # fixed values: media types
    return (
        F.when(e.isin(*TEXT_EXTENSIONS), "text").when(e == ".pdf", "pdf").when(e == ".docx", "docx")
        .when(e.isNull() & (m == "application/pdf"), "pdf")
        .when(e.isNull() & (m == "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), "docx")
    )


def sanitized_name(name: Column) -> Column:
    """The name of a file's sanitised copy."""
    e = file_extension(name)
    return (
        F.when(e == ".env", F.concat(name, F.lit(".sanitized.env")))
        .when(e.isNull(), F.concat(name, F.lit(".sanitized.txt")))
        .otherwise(F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(e)), F.lit(".sanitized"), F.substring(name, F.length(name) - F.length(e) + 1, F.length(e))))
    )


def format_bytes(n: Column) -> Column:
    mb = 1024 * 1024
    return (
        F.when((n >= mb) & (n % mb == 0), F.concat((n / mb).cast("long").cast("string"), F.lit(" MB")))
        .when((n >= 1024) & (n % 1024 == 0), F.concat((n / 1024).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    )


def is_binary_text(text: Column) -> Column:
    """Whether a decoded text is not text: a NUL, or over 1 % control characters."""
    controls = F.length(F.regexp_replace(text, r"[^\x01-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.contains(text, F.char(F.lit(0))) | (controls > 0.01 * F.length(text))


def selection_limits(files: DataFrame, batch: str) -> DataFrame:
    """batch, n_files, total_bytes, within: whether a selection may be scanned."""
    out = files.groupBy(batch).agg(F.count("*").alias("n_files"), F.sum(F.greatest(F.lit(0), F.col("length"))).alias("total_bytes"))
    return out.withColumn("within", (F.col("n_files") <= MOST_FILES) & (F.col("total_bytes") <= MOST_TOTAL))


#: Reasons why a file was not scanned, and what is said about them.
MESSAGES = (
    ("unsupported-type", "This file type is not supported. File contents could not be scanned."),
    ("file-too-large", "This file exceeds the {limit} scanning limit."),
    ("encrypted-document", "Encrypted documents cannot be scanned."),
    ("unknown-binary", "File contents could not be scanned because the file is not readable text."),
    ("no-extractable-text", "No extractable text was found. Image-only documents require OCR and could not be scanned."),
    ("extraction-limit-exceeded", "The document expands to too much text to scan safely."),
    ("extraction-failed", "This file could not be scanned."),
    ("sanitization-unavailable", "A sanitized copy cannot be created safely for this document format."),
)


def message(reason: Column, most_bytes: int = MOST_BYTES) -> Column:
    """What is said about a reason; null without one."""
    out = F.lit(None).cast("string")
    for name, text in MESSAGES:
        before, at, after = text.partition("{limit}")
        said = F.concat(F.lit(before), format_bytes(F.lit(most_bytes)), F.lit(after)) if at else F.lit(text)
        out = F.when(reason == name, said).otherwise(out)
    return out


def starts_with(content: Column, *signatures: str) -> Column:
    """Whether bytes begin with one of some signatures (hexadecimal)."""
    out = F.lit(False)
    for s in signatures:
        out = out | (F.hex(F.substring(content, 1, len(s) // 2)) == s)
    return out


def sniffed(content: Column) -> Column:
    """pdf, zip or ole by a file's first bytes; null for others."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    zipped = starts_with(content, "504B0304", "504B0506", "504B0708")
    return F.when(F.contains(head, F.lit("%PDF-")), "pdf").when(zipped, "zip").when(starts_with(content, "D0CF11E0A1B11AE1"), "ole")


def decoded(content: Column) -> Column:
    """The text of bytes in UTF-8, without a mark of their order; null where they are not."""
    return F.when(F.is_valid_utf8(content), F.regexp_replace(F.decode(content, "UTF-8"), "^\ufeff", ""))


_PART = re.compile(r"^/*word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$", re.I)
_MAIN = re.compile(r"^/*word/document\.xml$", re.I)


def _xml_text(data: bytes) -> str:
    out: list[str] = []
    stack: list[tuple[str, ElementTree.Element | None]] = [("", ElementTree.fromstring(data))]
    while stack:
        ending, node = stack.pop()
        if node is None:
            out.append(ending)
            continue
        name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        if name in ("t", "instrText", "delText"):
            out.append("".join(node.itertext()))
        elif name in ("tab", "br", "cr"):
            out.append("\t" if name == "tab" else "\n")
        else:
            stack.append(({"tc": "\t", "p": "\n", "tr": "\n"}.get(name, ""), None))
            stack.extend(("", child) for child in reversed(node))
    return "".join(out)


def docx_text(data: bytes, most_chars: int = MOST_CHARS) -> tuple[str | None, str | None]:
    """(text, reason) of a word-processing document: its main part, then the others by name."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            found = [x for x in archive.infolist() if _PART.match(x.filename)]
            if any(x.flag_bits & 1 for x in found):
                return None, "encrypted-document"
            if sum(x.file_size for x in found) > max(4 * most_chars, 1_000_000):
                return None, "extraction-limit-exceeded"
            if not any(_MAIN.match(x.filename) for x in found):
                return None, "extraction-failed"
            found.sort(key=lambda x: (not _MAIN.match(x.filename), x.filename))
            text = ""
            for x in found:
                part = _xml_text(archive.read(x))
                if len(text) + len(part) > most_chars:
                    return None, "extraction-limit-exceeded"
                text += part + "\n"
            return text.strip(), None
    except (zipfile.LargeZipFile, zipfile.BadZipFile, ElementTree.ParseError, UnicodeDecodeError, NotImplementedError, EOFError, OSError, RuntimeError):
        return None, "extraction-failed"


def _unpacked(contents: pd.Series, most_chars: int) -> pd.DataFrame:
    """Text and reason of word-processing documents and of UTF-16 text."""

    def one(data: bytes | None) -> tuple[str | None, str | None]:
        if data is None:
            return None, None
        if data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            return docx_text(bytes(data), most_chars)
        try:
            return bytes(data[2:]).decode("utf-16-le" if data[:1] == b"\xff" else "utf-16-be"), None
        except UnicodeDecodeError:
            return None, "unknown-binary"

    return pd.DataFrame([one(x) for x in contents], columns=["text", "reason"])


def extracted(files: DataFrame, limits: Limits = USUAL) -> DataFrame:
    """``files`` (name, mime, content) and format, text, reason: what can be read of each, or
    why not. Word-processing documents and UTF-16 text leave the JVM, all others are null
    there; PDF has no reader here."""
    content, kind, sniff = F.col("content"), F.col("format"), F.col("_sniffed")
    rows = files.withColumn("format", file_format(F.col("name"), F.col("mime"))).withColumn("_sniffed", sniffed(content)).withColumn("_large", F.length(content) > limits.most_bytes)
    plain, docx = (kind == "text") & sniff.isNull() & ~F.col("_large"), (kind == "docx") & (sniff == "zip") & ~F.col("_large")
    wide = starts_with(content, "FFFE", "FEFF")
    most = limits.most_chars

    @F.pandas_udf("text string, reason string")
    def unpack(contents: pd.Series) -> pd.DataFrame:
        return _unpacked(contents, most)

    rows = rows.withColumn("_unpacked", unpack(F.when(docx | plain & wide, content)))
    rows = rows.withColumn("_text", F.coalesce(F.col("_unpacked.text"), F.when(plain & ~wide, decoded(content))))
    text = F.col("_text")
    reason = (
        F.when(kind.isNull(), "unsupported-type").when(F.col("_large"), "file-too-large")
        .when((kind == "docx") & (sniff == "ole"), "encrypted-document").when((kind == "docx") & ~F.coalesce(sniff == "zip", F.lit(False)), "extraction-failed")
        .when(kind == "pdf", "extraction-failed").when(F.col("_unpacked.reason").isNotNull(), F.col("_unpacked.reason"))
        .when((kind == "text") & (text.isNull() | is_binary_text(text)), "unknown-binary")
        .when(F.length(text) > most, "extraction-limit-exceeded").when((kind == "docx") & ~text.rlike(r"\S"), "no-extractable-text")
    )
    out = settled_row(rows.select(*files.columns, "format", text.alias("text"), reason.alias("reason")))
    return out.withColumn("text", F.when(F.col("reason").isNull(), F.col("text")))


def scanned_files(files: DataFrame, scanner: Callable[[DataFrame], DataFrame], limits: Limits = USUAL) -> DataFrame:
    """``files`` (name, mime, content) without the content, and extension, format, status,
    reason, message, n_chars, findings, can_sanitize. ``scanner`` adds findings to rows with a text."""
    rows = scanner(extracted(files, limits))
    read = F.col("reason").isNull()
    return rows.select(
        *[c for c in files.columns if c != "content"], file_extension(F.col("name")).alias("extension"), "format", F.when(read, "scanned").otherwise("unscannable").alias("status"),
        "reason", message(F.col("reason"), limits.most_bytes).alias("message"), F.length("text").alias("n_chars"), "findings", (read & (F.col("format") == "text")).alias("can_sanitize"),
    )


def sanitized_files(files: DataFrame, scanner: Callable[[DataFrame], DataFrame], rewrite: Callable[[Column, Column], Column]) -> DataFrame:
    """A sanitised copy of each text file: its name, text and reason (null, or why there is none)."""
    rows = scanner(extracted(files))
    reason = F.when(F.col("format").isin("pdf", "docx"), "sanitization-unavailable").otherwise(F.col("reason"))
    made = F.when(reason.isNull(), rewrite(F.col("text"), F.col("findings")))
    return rows.select(*[c for c in files.columns if c != "content"], F.when(reason.isNull(), sanitized_name(F.col("name"))).alias("copy_name"), made.alias("copy_text"), reason.alias("copy_reason"))


def file_summary(scanned: DataFrame, batch: str) -> DataFrame:
    """For each selection of files: files, warnings (one for a file that can't be scanned, else
    its findings)."""
    warnings = F.when(F.col("status") == "unscannable", 1).otherwise(F.size("findings"))
    return scanned.groupBy(batch).agg(F.count("*").alias("n_files"), F.sum(warnings).cast("long").alias("warnings"))


def category_list(findings: Column) -> Column:
    """The categories of a file's findings, each once, in order."""
    return F.array_join(F.array_distinct(F.transform(findings, lambda f: f["category"])), ", ")


def text_files(spark: SparkSession, path: str, limits: Limits = USUAL) -> DataFrame:
    """path, status, reason, text of the files below a path. Sizes are compared
    before contents are read, as the source pushes ``length`` down."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > limits.most_bytes).select("path", F.lit("file-too-large").alias("reason"), F.lit(None).cast("string").alias("text"))
    small = files.where(F.col("length") <= limits.most_bytes).select("path", F.col("path").alias("name"), F.lit("").alias("mime"), "content")
    out = large.unionByName(extracted(small, limits).select("path", "reason", "text"))
    return out.select("path", F.when(F.col("reason").isNull(), "scanned").otherwise("unscannable").alias("status"), "reason", "text")
