"""The registered queries of the scanner, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions import scalars as S
from textguard.functions import sql
from textguard.operators import detect, resolve, state
from textguard.plans.prompts import inputs
from textguard.sources import files

SALT = "textguard"
NOW_MS = 1_704_067_200_000
#: A small model: label, weights (one for each of 64 dimensions), intercept, threshold.
HEAD = [(name, [round(((7 * i + 3 * k) % 11 - 5) / 5, 1) for i in range(64)], 0.1 * k - 0.2, 0.5) for k, name in enumerate(("business", "customer", "employee", "financial"))]
#: Host, site.
SITES = (("example.com", "site-a"), ("www.example.net", "site-b"), ("example.org", "site-c"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _detector(d: detect.Detector) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: detect.detect(inputs(spark, sf_dir), d)


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(inputs(spark, sf_dir))


def scan_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scan(inputs(spark, sf_dir), frozenset({"credentials", "emails"}))


def scan_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all texts in plain SQL."""
    return sql.register(spark).sql("SELECT d.doc_id, f.* FROM {docs} AS d, LATERAL scan_text(d.text) AS f", docs=inputs(spark, sf_dir))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved(inputs(spark, sf_dir))


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.exploded(_resolved(spark, sf_dir)).select("doc_id", "detector", "category", "severity", "confidence", "start", "end", "original_value")


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.summary(_resolved(spark, sf_dir))


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.redact(_resolved(spark, sf_dir))


def safe_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.with_placeholder(resolve.exploded(_resolved(spark, sf_dir)))
    return rows.groupBy("detector", "category", "placeholder").agg(F.count("*").alias("n"))


def safe_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.safe_replaced(inputs(spark, sf_dir))


def allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_assignment(inputs(spark, sf_dir)).select("doc_id", "start", "original_value")
    listed = found.where("doc_id % 3 = 0").select(S.fingerprint(F.col("original_value"), SALT).alias("fingerprint"))
    return resolve.allowed(found, listed, SALT)


def email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = next(d for d in detect.DETECTORS if d.key == "detect_email")
    docs = _read(spark, sf_dir, "documents")
    return detect.regex_spans(docs, d.pattern, F.contains("text", F.lit("@"))).select("doc_id", "start", F.col("match").alias("value"))


def scalar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_name")
    return _read(spark, sf_dir, "customer").select(
        "c_custkey", F.round(S.entropy(v), 6).alias("entropy"), S.length_bucket(v).alias("length_bucket"), S.entropy_bucket(v).alias("entropy_bucket"),
        S.mask(v).alias("masked"), S.fingerprint(v, SALT).alias("fingerprint"),
    )


def classify_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*map(F.lit, ("dbPassword", "API_KEY", "apiKey", "access-token", "tokenCount", "client.secret", "secret_message", "rsaPrivateKey", "max_token", "aws_secret_access_key", "name")))
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.explode(keys).alias("key"))
    return rows.select("n_nationkey", "key", S.normalized_key(F.col("key")).alias("normalized"), S.key_kind(F.col("key")).alias("kind"))


def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*map(F.lit, ("<your-token>", "xxxxxx", "****", "changeme", "[sample]", "real-Value-91", "ghp_xxxxxxxxxx", "insert key here", "not-a-real-key", "``dummy``", "your_api_key", "hunter22")))
    rows = _read(spark, sf_dir, "region").select("r_regionkey", F.explode(values).alias("value"))
    return rows.where(~S.is_placeholder(F.col("value")))


def char_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select(F.explode(F.split("c_name", "")).alias("ch"))
    return rows.groupBy("ch").agg(F.count("*").alias("n"))


def bounded_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    short = F.concat(F.substring(t, 1, 1180), F.lit("\n...\n"), F.substring(t, F.length(t) - 1179, F.lit(1180)))
    return _read(spark, sf_dir, "documents").select("doc_id", F.when(F.length(t) > 2400, short).otherwise(t).alias("preview"))


def basic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n_segments"), F.array_join(found, " ").alias("segments"))


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.token_chunks(_read(spark, sf_dir, "documents"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))


def linear_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.linear_head(_read(spark, sf_dir, "embeddings"), HEAD)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    start = (F.col("event_id") * 7919 % 1000).cast("int")
    return e.select(F.col("user_id"), F.col("event_type").alias("label"), start.alias("start"), (start + 20 + F.col("event_id") % 30).cast("int").alias("end"), F.round(F.col("event_id") % 100 / 100, 2).alias("confidence"))


def merge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.merged_intervals(_intervals(spark, sf_dir), ["user_id", "label"])


def overlap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _intervals(spark, sf_dir)
    left, right = rows.where("label = 'click'"), rows.where("label <> 'click' AND confidence > 0.9")
    return state.overlaps(left, right, "user_id").select("user_id", "start", "end", "replacement_safe")


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.debounced(_events(spark, sf_dir), "user_id", "ts", "event_type", 90_000)
    return out.select("user_id", F.unix_micros("ended").alias("ended_us"), "n_events", "last_value")


def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.changed_only(_events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type"), "user_id", "ts,event_id", "event_type")
    return out.select("event_id", "user_id", "event_type")


def current_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a scan of its user's text, in order of arrival, of versions that fall back at times."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "final").when(F.col("event_type") == "signup", "input").otherwise("result")
    version = F.floor(i / 16) - F.when(i % 7 == 3, i % 40).otherwise(0)
    rows = _events(spark, sf_dir).select("user_id", i.alias("arrival"), version.alias("version"), kind.alias("kind"), F.substring("event_type", 1, 1).alias("text"), (i % 5).alias("n_findings"))
    return state.current_scans(rows, "user_id")


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.session_counters(_events(spark, sf_dir), "ts", "value")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000
    return o.select(F.col("o_orderkey").alias("id"), at.cast("long").alias("timestamp"), F.col("o_orderpriority").alias("action"))


def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.retained(_history(spark, sf_dir), NOW_MS, 365 * 5)


def history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.newest_by_sequence(_history(spark, sf_dir), "id", 1000)


def latest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.unix_micros("ts").alias("at_us"), "event_id", "event_type")
    return state.latest_by(rows, "user_id", "at_us", "event_id")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", F.sha2(F.col("user_id").cast("string"), 256).alias("client"), F.unix_millis("ts").alias("at_ms"))
    return state.rate_limited(rows, "client", "at_ms", 3, 3_600_000)


def feedback_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a sink adds which already holds the benchmark's texts: each text once."""
    docs = _read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("id"), F.length("text").alias("n_chars"))
    known = _read(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("id"))
    return docs.dropDuplicates(["id"]).join(known, "id", "left_anti")


def payload_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    labels = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    scores = F.create_map(F.lit("a"), (k % 13 / 10.0), F.when(k % 7 == 0, "c").otherwise("b"), F.lit(0.5))
    feedback = F.element_at(F.array(*map(F.lit, ("correct", "not_sensitive", "wrong_category", "other"))), (k % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text", labels.alias("predicted_labels"), scores.alias("predicted_scores"), feedback.alias("feedback"))
    return state.payload_errors(rows).select("doc_id", "error")


def site_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = spark.createDataFrame(list(SITES), "host string, site string")
    pages = _read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?[^./]+\.([^/?#:]+)", 1)).alias("host"))
    return pages.join(F.broadcast(sites), "host").select("page_id", "site")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    ends = ("Notes.TXT", "a/b/.env.local", "archive.tar.gz", "report.PDF", "no_extension", "trailing.", ".hidden", "dir.x/letter.docx", "script.py", "image.png")
    return p.select(k.alias("id"), F.concat(F.lit("f"), k.cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, ends)), (k % 10 + 1).cast("int"))).alias("name"), F.when(k % 3 == 0, "application/pdf").otherwise("").alias("mime"), (k * 4096 * (k % 2000)).alias("length"))


def file_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _names(spark, sf_dir).select("id", files.file_extension(name).alias("extension"), files.file_format(name, F.col("mime")).alias("format"), files.sanitized_name(name).alias("sanitized"), files.format_bytes(F.col("length")).alias("size"))


def selection_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.selection_limits(_names(spark, sf_dir).withColumn("batch", F.expr("id % 190")), "batch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {d.key: _detector(d) for d in detect.DETECTORS}
QUERIES["detect_assignment"] = lambda spark, sf_dir: detect.detect_assignment(inputs(spark, sf_dir))
QUERIES["detect_json_secret"] = lambda spark, sf_dir: detect.detect_json_secret(inputs(spark, sf_dir))
QUERIES |= {
    f.__name__: f
    for f in (
        scan_all, scan_sql, scan_toggled, resolve_overlaps, history_summary, redact, safe_placeholder, safe_replace, allowlist_anti, email_candidates,
        scalar_features, classify_key, placeholder_filter, char_freq, bounded_preview, basic_segments, token_chunks, linear_head,
        merge_predictions, overlap_flag, debounce_sessions, dedupe_consecutive, current_scans, session_stats, history_retention, history_tail,
        latest_health, rate_limit, feedback_dedupe, payload_validate, site_lookup, file_format, selection_limit,
    )
}
