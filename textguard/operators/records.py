"""Records of the service as table operators: history, feedback, allowlists, settings, errors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import scalars as S
from textguard.operators.semantic import SEMANTIC_LABELS

#: What a history event may say.
ACTIONS = ("redacted", "safe-example", "sent-anyway", "cancelled")
CONFIDENCES = ("low", "medium", "high")
MOST_CATEGORIES = 20
MOST_ALLOWED = 200
MOST_TEXT = 5000
FINGERPRINT = r"^[0-9A-Fa-f]{64}\z"


def stripped(value: Column) -> Column:
    """The value without white space at its ends."""
    return F.regexp_replace(value, r"^\s+|\s+\z", "")


#: What a user chose at a warning and what history says of it.
CHOICES = (
    (("redact", "redact-copy"), "redacted"), (("replace-safe", "replace-safe-copy"), "safe-example"), (("send-anyway", "upload-original"), "sent-anyway"), (("cancel",), "cancelled"),
)


def history_action(choice: Column) -> Column:
    """The name in history of a choice; null for any other, which history leaves out."""
    out = F.lit(None).cast("string")
    for choices, name in CHOICES:
        out = F.when(choice.isin(*choices), name).otherwise(out)
    return out


def finite(value: Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    x = value.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


#: What feedback records may say.
FEEDBACK_LABELS = ("correct", "not-sensitive", "wrong-category")
SOURCES = ("signature", "structured", "contextual", "semantic")
LENGTHS = ("short", "medium", "long", "very-long")
ENTROPIES = ("low", "medium", "high")
MOST_FEEDBACK = 500


def valid_feedback(rows: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """The feedback records that can be read back: known values, a finite time, a whole
    fingerprint, features (source, length_bucket, entropy_bucket, placeholder_like,
    structures); ids of 200 characters at most, categories and structures of 80, 20 structures."""
    known = [
        F.col("id").isNotNull(), F.col("detector").isin(*detectors), F.col("category").isNotNull(), F.col("severity").isin(*S.SEVERITIES), F.col("confidence").isin(*CONFIDENCES),
        F.col("feedback_label").isin(*FEEDBACK_LABELS), finite(F.col("timestamp")), F.col("value_fingerprint").rlike(FINGERPRINT), F.col("source").isin(*SOURCES),
        F.col("length_bucket").isin(*LENGTHS), F.col("entropy_bucket").isin(*ENTROPIES), F.col("placeholder_like").isNotNull(), F.col("structures").isNotNull(),
    ]
    ok = F.lit(True)
    for x in known:
        ok = ok & F.coalesce(x, F.lit(False))
    structures = F.slice(F.transform(F.filter("structures", lambda x: x.isNotNull()), lambda x: F.substring(x, 1, 80)), 1, MOST_CATEGORIES)
    return rows.where(ok).withColumns({"id": F.substring("id", 1, 200), "category": F.substring("category", 1, 80), "structures": structures})


def valid_health(rows: DataFrame, sites: Sequence[str]) -> DataFrame:
    """The health rows that can be read back: a known site, protection and scanner states that
    there are, a finite time."""
    ok = F.col("site").isin(*sites) & F.col("protection").isin("protected", "unavailable") & F.col("scanner").isin("ready", "unavailable") & finite(F.col("updated_at"))
    return rows.where(F.coalesce(ok, F.lit(False)))


def clean_categories(categories: Column) -> Column:
    """Trimmed, non-empty, 80 characters at most, each once, the first twenty."""
    names = F.filter(F.transform(F.filter(categories, lambda x: x.isNotNull()), stripped), lambda x: x != "")
    return F.slice(F.array_distinct(F.transform(names, lambda x: F.substring(x, 1, 80))), 1, MOST_CATEGORIES)


def _known(sites: Sequence[str]) -> Column:
    at = F.col("timestamp")
    return (
        F.col("site").isin(*sites) & F.col("action").isin(*ACTIONS) & F.col("severity").isin(*S.SEVERITIES) & F.col("confidence").isin(*CONFIDENCES)
        & at.isNotNull() & ~F.isnan(at.cast("double")) & (F.abs(at.cast("double")) < float("inf"))
    )


def recorded(events: DataFrame, sites: Sequence[str], enabled: bool = True) -> DataFrame:
    """History rows of new events (key, timestamp, site, categories, severity, confidence,
    action, finding_count): those that are valid, in the columns that history has. A count
    is rounded down, one at least; without it, that of the categories stands."""
    rows = events.where(_known(sites) & F.lit(enabled)).withColumn("categories", clean_categories(F.col("categories"))).where("size(categories) > 0")
    n = F.col("finding_count").cast("double")
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    count = F.when(finite, F.greatest(F.lit(1), F.floor(n))).otherwise(F.size("categories")).cast("long")
    event_id = F.concat(F.lit("history-"), F.col("timestamp").cast("string"), F.lit("-"), F.col("key").cast("string"))
    return rows.select(event_id.alias("id"), "timestamp", "site", "categories", "severity", "confidence", "action", count.alias("finding_count"))


def valid_history(rows: DataFrame, sites: Sequence[str]) -> DataFrame:
    """The rows of a history that can be read back: known values, a whole positive count,
    a category at least; ids of 200 characters at most."""
    n = F.col("finding_count").cast("double")
    ok = _known(sites) & F.col("id").isNotNull() & F.coalesce((n > 0) & (n == F.floor(n)), F.lit(False))
    ok = ok & F.coalesce(F.forall("categories", lambda x: x.isNotNull()), F.lit(False))
    out = rows.where(ok).withColumn("categories", clean_categories(F.col("categories"))).where("size(categories) > 0")
    return out.withColumn("id", F.substring("id", 1, 200)).withColumn("finding_count", n.cast("long"))


def history_filtered(rows: DataFrame, site: str | None = None, action: str | None = None) -> DataFrame:
    """History of a site and of an action, where they are asked for, newest first."""
    for column, value in (("site", site), ("action", action)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.orderBy(F.col("timestamp").desc())


def allowlist_upserted(entries: DataFrame, added: DataFrame, most: int = MOST_ALLOWED) -> DataFrame:
    """An allowlist after additions, applied as one change (both: fingerprint, category,
    created_at, seq in order of insertion). A fingerprint keeps its first entry's values and
    the place of its last; the last ``most`` stay. Entries are combined by fingerprint."""
    values = F.struct("category", "created_at")
    rows = entries.unionByName(added).groupBy("fingerprint").agg(F.min_by(values, "seq").alias("v"), F.max("seq").alias("seq"))
    return rows.orderBy(F.col("seq").desc(), "fingerprint").limit(most).select("fingerprint", "v.category", "v.created_at", "seq")


def fingerprint_prefix(fingerprint: Column, length: int = 10) -> Column:
    return F.substring(fingerprint, 1, max(4, min(length, 64)))


def allowlist_migrated(entries: DataFrame, owner: str) -> DataFrame:
    """Entries of old lists in today's shape: owner, id, fingerprint, category, created_at.

    An old entry is a plain string (column raw) or has fields; a list is old if an
    entry of it is a string, and other lists give nothing here.
    """
    old = entries.where(F.col("raw").isNotNull()).select(owner).distinct()
    text, fields = F.col("raw").rlike(FINGERPRINT), F.col("raw").isNull() & F.col("fingerprint").rlike(FINGERPRINT)
    at = F.col("created_at").cast("double")
    fields = fields & F.col("category").isNotNull() & at.isNotNull() & ~F.isnan(at) & (F.abs(at) < float("inf"))
    mark = F.coalesce("raw", "fingerprint")
    category = F.when(F.col("raw").isNotNull(), "Previously allowlisted value").otherwise(F.substring("category", 1, 80))
    rows = entries.join(old, owner, "left_semi").where(F.coalesce(text, F.lit(False)) | F.coalesce(fields, F.lit(False)))
    return rows.select(owner, mark.alias("id"), mark.alias("fingerprint"), category.alias("category"), F.when(F.col("raw").isNotNull(), 0.0).otherwise(at).alias("created_at"))


def without_values(findings: DataFrame, values: DataFrame) -> DataFrame:
    """The findings whose value was not allowed in this session (a table with original_value)."""
    return findings.join(values.select("original_value").distinct(), "original_value", "left_anti")


def predicted_label(structures: Column, category: Column) -> Column:
    """The label of a finding: the semantic stage's, or its category as a slug."""
    semantic = F.get(F.filter(F.split(structures, ","), lambda x: x.startswith("semantic:")), F.lit(0))
    slug = F.regexp_replace(F.lower(category), "[^a-z0-9]+", "_")
    return F.coalesce(F.substring(semantic, len("semantic:") + 1, 1000), F.regexp_replace(slug, "^_|_$", ""))


def feedback_records(findings: DataFrame, salt: str) -> DataFrame:
    """Feedback rows of findings with finding_id, feedback_label and timestamp: no value, its fingerprint instead."""
    record_id = F.concat_ws("-", F.col("timestamp").cast("string"), "finding_id", "feedback_label")
    return findings.select(
        record_id.alias("id"), "detector", "category", "severity", S.confidence_level(F.col("confidence")).alias("confidence"), "feedback_label", "timestamp",
        S.fingerprint(F.col("original_value"), salt).alias("value_fingerprint"), "length_bucket", "entropy_bucket", "structures",
    )


def contributions(findings: DataFrame, enabled: bool, consent: bool) -> DataFrame:
    """What is contributed of findings with finding_id, feedback_label and corrected_labels
    where the user agreed: a wrong category needs a correction, no sensitivity says public,
    and a right label stands."""
    label = predicted_label(F.col("structures"), F.col("category"))
    given = F.coalesce(F.col("corrected_labels"), F.array().cast("array<string>"))
    corrected = F.when(F.col("feedback_label") == "not-sensitive", F.array(F.lit("public"))).when(F.col("feedback_label") == "wrong-category", given).otherwise(F.array(label))
    rows = findings.where(F.lit(enabled and consent)).select(
        "finding_id", F.substring("original_value", 1, MOST_TEXT).alias("text"), F.array(label).alias("predicted_labels"), F.create_map(label, "confidence").alias("predicted_scores"),
        F.replace("feedback_label", F.lit("-"), F.lit("_")).alias("feedback"), corrected.alias("corrected_labels"),
    )
    return rows.where("size(corrected_labels) > 0")


def payload_faults(p: DataFrame) -> DataFrame:
    """``p`` and fault: the first rule that a payload breaks, null if none. Columns: text,
    predicted_labels, predicted_scores, feedback, corrected_labels, model_version,
    extension_version, created_at (text with its zone)."""
    labels_ok = lambda c, least: F.size(c).between(least, 20) & F.forall(c, lambda x: F.coalesce(F.length(x).between(1, 80), F.lit(False)))
    names, scores = F.map_keys("predicted_scores"), F.map_values("predicted_scores")
    scores_ok = (F.size(names) <= 20) & F.forall(names, lambda x: F.length(x).between(1, 80)) & F.forall(scores, lambda s: F.coalesce((s >= 0) & (s <= 1), F.lit(False)))
    same = F.array_sort(F.array_distinct(names)) == F.array_sort(F.array_distinct("predicted_labels"))
    corrected = F.col("corrected_labels")
    right = F.when(F.col("feedback") == "correct", (F.size(corrected) == 0) | (corrected == F.col("predicted_labels")))
    right = right.when(F.col("feedback") == "not_sensitive", corrected == F.array(F.lit("public")))
    right = right.otherwise((F.size(corrected) > 0) & F.forall(corrected, lambda x: x.isin(*SEMANTIC_LABELS)))
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    fault = (
        F.when(no(F.length("text").between(1, MOST_TEXT)) | (stripped(F.col("text")) == ""), "text")
        .when(no(labels_ok(F.col("predicted_labels"), 1)), "predicted_labels").when(no(scores_ok), "predicted_scores")
        .when(no(F.col("feedback").isin("correct", "not_sensitive", "wrong_category")), "feedback").when(no(labels_ok(corrected, 0)), "corrected_labels")
        .when(no(F.length("model_version").between(1, 100)), "model_version").when(no(F.length("extension_version").between(1, 40)), "extension_version")
        .when(no(F.col("created_at").rlike(r"(?i)^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?\s*(Z|[+-]\d\d:?\d\d)\z")), "created_at")
        .when(no(same), "score_labels").when(no(right), "correction")
    )
    return p.withColumn("fault", fault)


def payload_id(payload: Column) -> Column:
    """The hash of a payload (a struct) as JSON: sorted keys, no spaces, ASCII."""

    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")).encode()).hexdigest())

    return F.pandas_udf(ids, "string")(F.to_json(payload))


#: Settings, their places in JSON and defaults.
SETTINGS = (
    ("protection_enabled", "$.protectionEnabled", True), ("semantic_detection", "$.semanticDetection", True), ("contribution_enabled", "$.feedbackContributionEnabled", False),
    ("contribution_consent", "$.feedbackContributionConsent", False), ("credentials", "$.detectors.credentials", True), ("private_keys", "$.detectors.privateKeys", True),
    ("database_credentials", "$.detectors.databaseCredentials", True), ("emails", "$.detectors.emails", True), ("phone_numbers", "$.detectors.phoneNumbers", True),
    ("internal_hosts", "$.detectors.internalHosts", True), ("history_enabled", "$.history.enabled", True),
)
RETENTIONS = (7, 30, 90)


def normalized_settings(rows: DataFrame, settings: str) -> DataFrame:
    """``rows`` and the settings that their JSON text stands for: booleans or their defaults,
    contribution only with consent, a retention of 7, 30 or 90 days or none (null), else 30."""
    v = F.try_parse_json(settings)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    flag = lambda path: F.when(kind(path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
    out = {name: F.coalesce(flag(path), F.lit(default)) for name, path, default in SETTINGS}
    # the old name counts where the new one is absent or null
    absent = F.coalesce(kind("$.protectionEnabled") == "VOID", F.lit(True))
    out["protection_enabled"] = F.coalesce(F.when(absent, flag("$.masterProtection")).otherwise(flag("$.protectionEnabled")), F.lit(True))
    out["contribution_enabled"] = out["contribution_consent"] & out["contribution_enabled"]
    days = F.when(kind("$.history.retentionDays").isin("BIGINT"), F.try_variant_get(v, "$.history.retentionDays", "int"))
    out["retention_days"] = F.when(kind("$.history.retentionDays") == "VOID", None).when(days.isin(*RETENTIONS), days).otherwise(30)
    return rows.select("*", *[c.alias(name) for name, c in out.items()])


def site_switches(rows: DataFrame, settings: str, sites: Sequence[str]) -> DataFrame:
    """``rows`` and switches: for each site, whether the settings' JSON text leaves it on (what
    is no boolean counts as on)."""
    v = F.try_parse_json(settings)

    def on(site: str) -> Column:
        path = f"$.sites['{site}']"
        given = F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
        return F.coalesce(given, F.lit(True))

    return rows.withColumn("switches", F.create_map(*[x for site in sites for x in (F.lit(site), on(site))]))


#: Parts of messages (any of them) and the code that they mean, in order.
ERROR_MESSAGES = (
    (("password authentication failed", "authentication failed", "invalid authorization specification"), "database_authentication_failed"),
    (("max client connections reached", "max clients reached"), "database_capacity_reached"),
    (("ssl", "tls", "certificate"), "database_tls_failed"),
    (
        (
            "could not translate host name", "name or service not known", "temporary failure in name resolution", "no such host is known", "nodename nor servname provided",
            "getaddrinfo failed", "network is unreachable", "cannot assign requested address", "no route to host", "unreachable", "connection refused", "timeout expired",
            "connection timed out", "server closed the connection unexpectedly", "connection reset by peer",
        ),
        "database_connection_failed",
    ),
)


def error_code(kind: Column, state: Column, message: Column, host: Column, user: Column, port: Column) -> Column:
    """The code of a database error by its kind (runtime, operational, programming, interface),
    SQLSTATE, message and, of operational ones, the host, user and port of the connection."""
    text, holds = F.lower(F.coalesce(message, F.lit(""))), lambda x: F.contains(F.lower(F.coalesce(message, F.lit(""))), F.lit(x))
    missing = F.coalesce((kind == "runtime") & (F.coalesce(host, F.lit("")) == ""), F.lit(False))
    out = F.when(missing, "database_configuration_missing").when(state.startswith("28"), "database_authentication_failed")
    out = out.when(state == "42501", "database_permission_denied").when(state.startswith("08"), "database_connection_failed")
    nobody = holds("tenant") & holds("user") & holds("not") & holds("found")
    out = out.when(nobody | F.contains(text, F.lit("not associated with any cluster")), "database_pooler_identity_failed")
    for parts, code in ERROR_MESSAGES:
        found = holds(parts[0])
        for x in parts[1:]:
            found = found | holds(x)
        out = out.when(found, code)
    h = F.lower(F.coalesce(host, F.lit("")))
    by_host = (
        F.when(h.endswith(".pooler.supabase.com"), F.when(~F.coalesce(F.contains(user, F.lit(".")), F.lit(False)), "database_pooler_username_invalid")
            .when(~F.coalesce(port.isin(5432, 6543), F.lit(False)), "database_pooler_port_invalid")
            .when(port == 5432, "database_session_pooler_connection_failed").otherwise("database_transaction_pooler_connection_failed"))
        .when(h.startswith("db.") & h.endswith(".supabase.co"), "database_direct_connection_failed").otherwise("database_operational_error")
    )
    return out.when(kind == "operational", by_host).when(kind == "programming", "database_programming_error").when(kind == "interface", "database_interface_error").otherwise("database_unavailable")


def allowed_origins(origins: Column) -> Column:
    """The origins of a comma-separated list that are extensions' ids."""
    return F.filter(F.transform(F.split(origins, ","), stripped), lambda x: x.rlike(r"^chrome-extension://[a-p]{32}\z"))


def laid_out(items: DataFrame, page: str, order: str) -> DataFrame:
    """page and text: positioned pieces of text (str, x, y, width, eol) put together. A
    change of height above 1 begins a line, a gap above 1 is a space, eol ends a line.
    Pieces of equal order go from the top down, then from the left. A page's items are
    one group."""
    from pyspark.sql import Window as W

    rows = items.where(F.col("str").isNotNull()).withColumn("eol", F.coalesce("eol", F.lit(False))).withColumn("_end", F.col("x") + F.coalesce("width", F.lit(0.0)))
    # no ties are left, so that a piece's neighbour and its place are of one order
    w = W.partitionBy(page).orderBy(order, F.desc("y"), "x", "str", "_end", "eol")
    lag = lambda c: F.lag(c).over(w)
    rows = rows.select(page, "str", "x", "y", "eol", lag("y").alias("_y"), lag("_end").alias("_e"), lag("eol").alias("_was"), F.row_number().over(w).alias("_place"))
    goes_on = ~F.coalesce("_was", F.lit(True))
    gap = F.when(goes_on & (F.abs(F.col("_y") - F.col("y")) > 1), "\n").when(goes_on & (F.col("x") - F.col("_e") > 1), " ").otherwise("")
    piece = F.concat(gap, "str", F.when(F.col("eol"), "\n").otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct(F.col("_place").alias("o"), piece.alias("s"))))
    return rows.groupBy(page).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"))
