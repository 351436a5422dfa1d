"""Registered queries of files, records and the semantic stage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import scalars as S
from textguard.functions import urls
from textguard.operators import records, resolve, semantic, state, structured
from textguard.plans.prompts import inputs
from textguard.sources import files

SALT = "textguard"
SITES = ("site-a", "site-b", "site-c")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


#: Ends of the names of generated files.
NAMES = ("notes.txt", "a.md", "main.py", "scan.pdf", "tool.exe", "letter.docx", ".env.local", "data.json", "LOG.Log")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document and prompt: its bytes in several encodings, some of them damaged."""
    k = F.abs("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    utf8 = F.encode(text, "UTF-8")
    content = (
        F.when(k % 11 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(k % 11 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .when(k % 11 == 3, F.concat(F.encode(F.lit("%PDF-1.7 "), "UTF-8"), utf8)).when(k % 11 == 4, F.concat(F.unhex(F.lit("504B0304")), utf8))
        .when(k % 11 == 5, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), utf8)).when(k % 11 == 6, F.concat(utf8, F.unhex(F.lit("FF")))).when(k % 11 == 7, F.concat(utf8, F.unhex(F.lit("00"))))
        .when(k % 11 == 8, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(utf8)
    )
    return inputs(spark, sf_dir).select("doc_id", F.concat(F.lit("f"), k.cast("string"), F.lit("/"), _of(NAMES, k)).alias("name"), F.lit("").alias("mime"), content.alias("content"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scanned_files(_files(spark, sf_dir), resolve.resolved)


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scanned(spark, sf_dir)
    n = F.when(F.col("status") == "scanned", F.size("findings"))
    return rows.select("doc_id", "extension", "format", "status", "reason", "message", "n_chars", n.cast("long").alias("n_findings"), files.category_list(F.col("findings")).alias("categories"))


def file_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_summary(_scanned(spark, sf_dir).withColumn("batch", F.abs("doc_id") % 97), "batch")


def file_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.sanitized_files(_files(spark, sf_dir), resolve.resolved, lambda text, found: resolve.rewritten(text, found, "replacement_value"))
    return rows.select("doc_id", "copy_name", F.sha2("copy_text", 256).alias("copy_hash"), "copy_reason")


def _events_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.when(k % 5 == 0, F.array(F.lit(" "), F.lit(""))).when(k % 5 == 1, F.array(F.lit("Email address"), F.lit(" Email address ")))
    names = names.when(k % 5 == 2, F.array(F.repeat(F.lit("x"), 100), F.lit("API key"))).otherwise(F.array(F.lit("Password"), F.lit("API key")))
    count = F.when(k % 3 == 1, 0.5).when(k % 3 == 2, 3.7).when(k % 7 == 3, 2.0)
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000
    return _read(spark, sf_dir, "orders").select(
        k.alias("key"), at.cast("long").alias("timestamp"), _of((*SITES, "elsewhere"), k).alias("site"), names.alias("categories"), _of((*S.SEVERITIES, "none"), k % 13).alias("severity"),
        _of(records.CONFIDENCES, k).alias("confidence"), _of((*records.ACTIONS, "other"), k % 17).alias("action"), count.alias("finding_count"),
    )


def history_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.recorded(_events_of_orders(spark, sf_dir), SITES)
    return rows.withColumn("categories", F.array_join("categories", "|"))


def history_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.valid_history(_events_of_orders(spark, sf_dir).withColumn("id", F.concat(F.lit("e"), F.col("key").cast("string"))), SITES)
    rows = records.history_filtered(rows, "site-b", "redacted")
    return rows.select("id", "timestamp", F.array_join("categories", "|").alias("categories"), "severity", "finding_count")


def _marks(spark: SparkSession, sf_dir: str, n: int, shift: int) -> DataFrame:
    k = F.col("c_custkey")
    mark = F.sha2(((k * 7 + shift) % n).cast("string"), 256)
    return _read(spark, sf_dir, "customer").select(mark.alias("fingerprint"), F.col("c_mktsegment").alias("category"), (k * 1000).cast("double").alias("created_at"), (k + 1_000_000_000 * shift).alias("seq"))


def allowlist_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.allowlist_upserted(_marks(spark, sf_dir, 400, 0), _marks(spark, sf_dir, 90, 1))


def allowlist_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mark = F.when(k % 6 == 0, "not-a-mark").otherwise(F.sha2(k.cast("string"), 256))
    rows = _read(spark, sf_dir, "customer").select(
        "c_nationkey", F.when((k % 2 == 0) & (F.col("c_nationkey") % 3 != 0), mark).alias("raw"), F.when(k % 2 == 1, mark).alias("fingerprint"),
        F.when(k % 5 != 0, F.repeat("c_mktsegment", 12)).alias("category"), F.when(k % 7 != 0, k.cast("double")).alias("created_at"),
    )
    out = records.allowlist_migrated(rows, "c_nationkey")
    return out.withColumn("prefix", records.fingerprint_prefix(F.col("fingerprint")))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accepted findings and what a user said of each."""
    rows = resolve.exploded(resolve.resolved(inputs(spark, sf_dir)))
    k = F.abs(F.col("doc_id")) + F.col("start")
    mark = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("emission").cast("string"), F.col("start").cast("string"))
    corrected = F.when(k % 2 == 0, F.array(_of(semantic.SEMANTIC_LABELS, k)))
    return rows.withColumns({"finding_id": mark, "feedback_label": _of(("correct", "not-sensitive", "wrong-category"), k), "timestamp": k * 1000, "corrected_labels": corrected})


def feedback_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.feedback_records(_reviewed(spark, sf_dir), SALT)
    return rows.select("id", "detector", "category", "severity", "confidence", "feedback_label", "timestamp", "value_fingerprint")


def contribution_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.contributions(_reviewed(spark, sf_dir), True, True)
    scores = F.array_join(F.transform(F.map_entries("predicted_scores"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.3f", e["value"]))), ",")
    return rows.select("finding_id", "text", F.array_join("predicted_labels", ",").alias("labels"), scores.alias("scores"), "feedback", F.array_join("corrected_labels", ",").alias("corrected"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    labels = F.when(k % 19 == 0, F.array().cast("array<string>")).when(k % 19 == 1, F.array_repeat(F.lit("a"), 21)).when(k % 19 == 2, F.array(F.lit(""))).otherwise(F.array(F.lit("a"), F.lit("b")))
    scores = F.create_map(F.lit("a"), (k % 23 / 20.0), F.when(k % 17 == 0, "c").otherwise("b"), F.lit(0.5))
    given = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("public"))).when(k % 4 == 2, F.array(F.lit("legal_confidential"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    at = F.when(k % 29 == 0, "2024-01-05T10:00:00").when(k % 29 == 1, "today").when(k % 2 == 0, "2024-01-05T10:00:00Z").otherwise("2024-01-05 10:00:00.5+02:00")
    return _read(spark, sf_dir, "documents").select(
        "doc_id", "text", labels.alias("predicted_labels"), scores.alias("predicted_scores"), _of(("correct", "not_sensitive", "wrong_category", "correct", "other"), k).alias("feedback"),
        given.alias("corrected_labels"), F.repeat(F.lit("m"), (k % 102).cast("int")).alias("model_version"), F.repeat(F.lit("v"), (k % 42).cast("int")).alias("extension_version"), at.alias("created_at"),
    )


def payload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.payload_faults(_payloads(spark, sf_dir)).select("doc_id", "fault")


def payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir)
    return rows.select("doc_id", records.payload_id(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("id"))


#: Texts of settings; each customer has one.
SETTINGS_TEXTS = (
    "{}", "not json", '{"protectionEnabled": false, "semanticDetection": "no"}', '{"masterProtection": false}', '{"protectionEnabled": null, "masterProtection": false}',
    '{"protectionEnabled": "x", "masterProtection": false}', '{"feedbackContributionEnabled": true}', '{"feedbackContributionEnabled": true, "feedbackContributionConsent": true}',
    '{"detectors": {"emails": false, "credentials": 0}, "history": {"enabled": false, "retentionDays": 90}}', '{"detectors": [1], "history": {"retentionDays": null}}',
    '{"history": {"retentionDays": 14}}', '{"history": {"retentionDays": "7"}}', '{"history": {"retentionDays": 7}}', "[1]",
)


def settings_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", _of(SETTINGS_TEXTS, F.col("c_custkey")).alias("j"))
    return records.normalized_settings(rows, "j").drop("j")


#: Kind, SQLSTATE, message, host, user, port of errors; each order has one.
ERRORS = (
    ("runtime", None, "no url", None, None, None), ("operational", "28P01", "x", "h", "u", 5432), ("programming", "42501", "x", "h", "u", 5432), ("operational", "08006", "x", "h", "u", 5432),
    ("operational", None, "Tenant or user not found", "h", "u", 5432), ("operational", None, "FATAL: password authentication failed for user", "h", "u", 1), ("operational", None, "Max client connections reached", "h", "u", 1),
    ("operational", None, "SSL error: certificate verify failed", "h", "u", 1), ("operational", None, "could not translate host name", "h", "u", 1), ("operational", None, "odd", "x.pooler.supabase.com", "user", 5432),
    ("operational", None, "odd", "x.pooler.supabase.com", "user.ref", 1234), ("operational", None, "odd", "X.pooler.supabase.com", "user.ref", 5432), ("operational", None, "odd", "x.pooler.supabase.com", "user.ref", 6543),
    ("operational", None, "odd", "db.x.supabase.co", "u", 5432), ("operational", None, "odd", "h", "u", 5432), ("programming", None, "odd", "h", "u", 5432), ("interface", None, "odd", "h", "u", 5432), ("other", None, None, "h", "u", 5432),
)


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    fields = {n: _of(tuple(r[i] for r in ERRORS), k) for i, n in enumerate(("kind", "state", "message", "host", "user", "port"))}
    return _read(spark, sf_dir, "orders").select("o_orderkey", records.error_code(*fields.values()).alias("code"))


def origin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    letters = F.translate(F.substring(F.sha2(k.cast("string"), 256), 1, 32), "0123456789abcdef", "abcdefghijklmnop")
    text = F.concat(F.lit(" chrome-extension://"), letters, F.lit(", https://example.org,chrome-extension://"), F.upper(letters), F.lit(" ,chrome-extension://"), F.substring(letters, 2, 30))
    return _read(spark, sf_dir, "customer").select("c_custkey", F.array_join(records.allowed_origins(text), ",").alias("origins"))


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.resolved(inputs(spark, sf_dir)).withColumn("findings", F.slice("findings", 1, 100))
    return resolve.exploded(rows).select("doc_id", "start", "end", "detector")


def session_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.exploded(resolve.resolved(inputs(spark, sf_dir)))
    allowed = _read(spark, sf_dir, "customer").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@corp"), (F.col("c_custkey") % 7).cast("string"), F.lit(".com")).alias("original_value"))
    return records.without_values(rows, allowed).select("doc_id", "start", "original_value")


def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accepted findings but those whose fingerprint a stored list has."""
    k = F.col("c_custkey").cast("string")
    known = _read(spark, sf_dir, "customer").select(S.fingerprint(F.concat(F.lit("node"), k, F.lit(".corp")), SALT).alias("fingerprint"))
    known = known.union(_read(spark, sf_dir, "customer").select(S.fingerprint(F.concat(F.lit("user"), k, F.lit("@corp"), (F.col("c_custkey") % 7).cast("string"), F.lit(".com")), SALT)))
    return resolve.allowed(resolve.exploded(resolve.resolved(inputs(spark, sf_dir))), known, SALT).select("doc_id", "start", "detector", "original_value")


def overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any event of another kind overlaps a click, at any confidence."""
    start = (F.col("event_id") * 7919 % 100_000).cast("int")
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + 20 + F.col("event_id") % 30).cast("int").alias("end"))
    return state.overlaps(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "user_id").select("event_id", "replacement_safe")


def site_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site of each page by its whole host; hosts of three pages or more are sites."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]+)", 1))
    pages = _read(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    sites = pages.groupBy("host").agg(F.count("*").alias("n")).where("n >= 3").select("host", F.concat(F.lit("site-"), "host").alias("site"))
    return pages.join(sites, "host").select("page_id", "site")


def layout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    items = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when((k + n) % 13 != 0, F.concat(F.lit("t"), n.cast("string"))).alias("str"), F.when((k + n) % 11 != 0, (n * 10 + k % 3).cast("double")).alias("x"),
        F.when((k + n) % 7 != 0, 700 - F.floor(n / 3) * 12.0).alias("y"), (F.lit(7.0) + (k + n) % 5).alias("width"), ((k + n) % 6 == 0).alias("eol"),
    )
    return records.laid_out(items, "l_orderkey", "l_linenumber")


def paste_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    gap = F.when(F.col("event_type") == "click", 60_000).otherwise(900_000)
    out = state.debounced(e, "user_id", "ts", "event_type", gap)
    return out.select("user_id", F.unix_micros("ended").alias("ended_us"), "n_events", "last_value")


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    k, n = F.col("doc_id"), F.length("text")
    at = F.explode(F.sequence(F.lit(0), F.floor(n / 200).cast("int")))
    rows = docs.select("doc_id", n.alias("n"), at.alias("i")).select("doc_id", "n", _of(semantic.SEMANTIC_LABELS, k + F.floor(F.col("i") / 3)).alias("label"), (F.col("i") * 150).alias("start"), (F.col("i") * 7 % 50 / 100 + 0.5).alias("confidence"))
    rows = rows.select("doc_id", "label", F.least(F.col("start"), F.col("n")).cast("int").alias("start"), F.least(F.col("start") + 100 + k % 90, F.col("n")).cast("int").alias("end"), "confidence")
    return docs, rows.where("start < end")


def semantic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = semantic.semantic_findings(*_predictions(spark, sf_dir))
    return out.select("doc_id", "category", F.round("confidence", 6).alias("confidence"), "start", "end", "masked_preview", "replacement_value", "length_bucket", "structures")


def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, predictions = _predictions(spark, sf_dir)
    found = resolve.exploded(resolve.resolved(docs))
    out = semantic.with_semantic(found, docs, lambda d: semantic.semantic_findings(d, predictions))
    return out.select("doc_id", "detector", "category", "start", "end", "replacement_safe")


def semantic_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, predictions = _predictions(spark, sf_dir)
    rows = docs.join(semantic.semantic_findings(docs, predictions).select("doc_id", "category", "start", "end"), "doc_id")
    return rows.select("doc_id", "category", "start", "end", semantic.narrowed(F.col("text"), F.col("start"), F.col("end"), F.col("category")).alias("n")).select("doc_id", "category", "start", "end", F.col("n.start").alias("narrow_start"), F.col("n.end").alias("narrow_end"))


def _vocabulary() -> dict[str, int]:
    """Pieces by rule: the marks of a model, single characters, two letters, and a vowel
    between two consonants; all of them at the beginning of a word and inside it."""
    letters, vowels = "abcdefghijklmnopqrstuvwxyz", "aeiou"
    others = [c for c in letters if c not in vowels]
    inner = [*letters, *"0123456789", *(a + b for a in letters for b in letters), *(a + v + b for a in others for v in vowels for b in others)]
    return {p: i for i, p in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *".,;:!?-()", *inner, *(f"##{p}" for p in inner)])}


VOCABULARY = _vocabulary()
WIDTH = 12
#: A stand-in for a model's head: fixed coefficients, thresholds that some windows reach.
STAND_IN_HEAD = semantic.Head(
    [[((5 * i + 3 * k) % 13 - 6) / 2 for i in range(WIDTH)] for k in range(len(semantic.SEMANTIC_LABELS))],
    [-0.1 * k for k in range(len(semantic.SEMANTIC_LABELS))], [0.75] * len(semantic.SEMANTIC_LABELS),
)


def stand_in_encoder() -> semantic.Encode:
    """A stand-in for a model: each token's hidden state follows from its id alone."""

    def encode(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return ((ids[:, :, None] * (2 * np.arange(WIDTH) + 7919) % 1009) / 504.0 - 1.0).astype(np.float32)

    return encode


def semantic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through pieces, windows, the stand-in encoder and the head."""
    rows = semantic.predicted(_read(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, "stand-in", stand_in_encoder, STAND_IN_HEAD)
    return rows.select("doc_id", F.explode_outer("predictions").alias("p"), "semantic_error").select("doc_id", "p.label", "p.start", "p.end", F.round("p.confidence", 6).alias("confidence"), "semantic_error")


def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = semantic.word_pieces(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), VOCABULARY)
    return rows.select("conv_id", "turn", F.array_join("ids", " ").alias("ids"), F.array_join("starts", " ").alias("starts"), F.array_join("ends", " ").alias("ends"))


def sensitive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of all keys that are assigned or stand in JSON, and whether their values stand for secrets."""
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_.-]{1,63})[=:]"), F.lit(1))
    rows = inputs(spark, sf_dir).select(F.explode(found).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return rows.select("key", "n", S.normalized_key(F.col("key")).alias("normalized"), S.key_kind(F.col("key")).alias("kind"))


def stand_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all words beside a colon or an equals sign, those that only stand for a secret."""
    found = F.regexp_extract_all("text", F.lit(r"[=:] ?([^\s,;]+)"), F.lit(1))
    rows = inputs(spark, sf_dir).select(F.explode(found).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return rows.where(S.is_placeholder(F.col("value")))


def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), at.cast("long").alias("timestamp"))
    last = rows.agg(F.max("timestamp").alias("now")).first()["now"]
    return state.retained(rows, last or 0, 90)


CHOICES = ("redact", "redact-copy", "replace-safe", "replace-safe-copy", "send-anyway", "upload-original", "cancel", "later", None)


def history_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("priority"), records.history_action(_of(CHOICES, F.col("o_orderkey"))).alias("action"))
    return rows.where("action IS NOT NULL").groupBy("priority", "action").agg(F.count("*").alias("n"))


def feedback_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback of all accepted findings, some of it damaged, as it is read back."""
    k = F.abs(F.col("doc_id")) + F.col("start")
    rows = _reviewed(spark, sf_dir)
    at = F.when(k % 11 == 0, float("nan")).when(k % 11 == 1, float("inf")).when(k % 11 != 2, F.col("timestamp").cast("double"))
    mark = F.sha2("finding_id", 256)
    rows = rows.select(
        F.when(k % 13 != 0, F.col("finding_id")).alias("id"), "detector", F.when(k % 17 != 0, F.repeat("category", 8)).alias("category"), "severity", _of(("low", "high", "certain"), k).alias("confidence"),
        "feedback_label", at.alias("timestamp"), F.when(k % 7 == 3, F.substring(mark, 1, 63)).otherwise(F.upper(mark)).alias("value_fingerprint"), "source", "length_bucket", "entropy_bucket",
        F.when(k % 19 != 0, k % 2 == 0).alias("placeholder_like"), F.array_repeat(F.repeat(F.lit("s"), (k % 120).cast("int")), (k % 30).cast("int")).alias("structures"),
    )
    rows = rows.withColumn("feedback_label", F.when(F.col("feedback_label") == "wrong_category", "wrong-category").otherwise(F.col("feedback_label")))
    out = records.valid_feedback(rows, ("email", "secretAssignment", "phoneNumber", "internalHostname"))
    return out.select("id", "detector", "category", "confidence", "feedback_label", "timestamp", F.array_join("structures", ",").alias("structures"))


def feedback_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last records of all feedback, as a store of bounded size keeps them."""
    rows = feedback_record(spark, sf_dir).select("id", "detector", "timestamp").withColumn("seq", F.concat_ws("/", F.lpad(F.col("timestamp").cast("string"), 20, "0"), "id"))
    return state.newest_by_sequence(rows, "seq", records.MOST_FEEDBACK).drop("seq")


def health_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    at = F.when(k % 7 == 0, float("nan")).when(k % 7 == 1, float("-inf")).when(k % 7 != 2, F.unix_millis(F.col("ts").cast("timestamp")).cast("double"))
    rows = _read(spark, sf_dir, "events").select(
        "event_id", _of((*SITES, "elsewhere", None), k).alias("site"), F.when(F.col("event_type") == "error", "unavailable").when(F.col("event_type") == "view", "unknown").otherwise("protected").alias("protection"),
        _of(("ready", "unavailable", "ready", None, "busy", "ready"), F.floor(k / 3)).alias("scanner"), at.alias("updated_at"),
    )
    return records.valid_health(rows, SITES)


#: Texts of settings, with the site's name to be put in.
SITE_TEXTS = ('{"sites": {"@": false}}', '{"sites": {"@": true}}', '{"sites": {"@": "no"}}', '{"sites": {"@": null}}', '{"sites": []}', "{}", "not json", '{"sites": {"other": false}}')


def site_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.replace(_of(SITE_TEXTS, F.floor(k / 3)), F.lit("@"), _of(SITES, k))
    rows = records.site_switches(_read(spark, sf_dir, "customer").select("c_custkey", text.alias("j")), "j", SITES)
    return rows.select("c_custkey", *[F.get(F.map_values("switches"), F.lit(i)).alias(s.replace("-", "_")) for i, s in enumerate(SITES)])


#: Ends of paths that a normal form changes.
PATH_ENDS = ("/./a/../b", "/../../x", "/a/b/..", "/%2e/%2E%2e/c", "/one two", "/caf\u00e9/\u65e5?", "", "/", "//x/.", "/.hidden/..a", "/{k}/`t`^", "/a/.")


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of each page's path, with an end that has dots, spaces or letters beyond ASCII."""
    path = F.concat(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), _of(PATH_ENDS, F.col("page_id")))
    return _read(spark, sf_dir, "pages").select("page_id", urls.normal_path(path).alias("path"))


#: What stands before and after the JSON text of an event.
AROUND = (("", ""), (" ", "\n"), ("", " x"), ("", "{}"), ("[", "]"), ("", "]"), ("", "}"), ("'", "'"), ("", ","), ('"', '"'), ("\t", ""), ("null ", ""))


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event's properties, with something around some of them, are one JSON object."""
    k = F.col("event_id")
    before, after = (_of(tuple(x[i] for x in AROUND), k) for i in (0, 1))
    text = F.concat(before, F.when(k % 7 == 5, F.translate("props", '"', "'")).otherwise(F.col("props")), after)
    return _read(spark, sf_dir, "events").select("event_id", structured.is_whole_object(text).alias("is_object"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        file_scan, file_warnings, file_copies, history_record, history_validate, history_recent, allowlist_upsert, allowlist_migrate, feedback_record, contribution_payload, payload_rules, payload_ids,
        settings_normalize, error_codes, origin_filter, top_findings, session_allowlist, allowlist_filter, overlap_all, site_exact, layout_join, paste_debounce, semantic_findings, semantic_merge, semantic_narrow, semantic_scan, word_pieces, sensitive_keys, stand_ins, url_paths, json_objects, history_actions, feedback_validate, feedback_tail, health_validate, site_switches,
    )
}
