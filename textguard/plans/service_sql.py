"""DuckDB SQL for the queries of :mod:`textguard.plans.service`."""

from __future__ import annotations

from textguard.operators import records, semantic
from textguard.plans.oracles import _KIND, _NORMALIZED, EXPLODED, _list, placeholder, q
from textguard.plans.prompts import inputs_sql
from textguard.plans.service import AROUND, CHOICES, ERRORS, NAMES, PATH_ENDS, SALT, SETTINGS_TEXTS, SITE_TEXTS, SITES
from textguard.sources.files import MESSAGES, TEXT_EXTENSIONS


def _of(values, k: str) -> str:
    shown = ["NULL" if v is None else q(v) if isinstance(v, str) else str(v) for v in values]
    return f"([{', '.join(shown)}])[({k}) % {len(values)} + 1]"


_EXT = {n: ".env" if n.startswith(".env") else "." + n.lower().rpartition(".")[2] for n in NAMES}
_FORMAT = {n: "text" if e in TEXT_EXTENSIONS else e[1:] if e in (".pdf", ".docx") else None for n, e in _EXT.items()}
_MESSAGE = "CASE reason " + " ".join(f"WHEN {q(a)} THEN {q(b.replace('{limit}', '10 MB'))}" for a, b in MESSAGES) + " END"
_CONTROLS = r"length(regexp_replace(text, '[^\x01-\x08\x0b\x0e-\x1f]', '', 'g')) > 0.01 * length(text)"
#: doc_id, text as read, format, extension, reason of each generated file
_FILES = f"""SELECT doc_id, format, extension, name, text, CASE WHEN format IS NULL THEN 'unsupported-type' WHEN format = 'docx' AND v = 5 THEN 'encrypted-document' WHEN format IN ('docx', 'pdf') THEN 'extraction-failed'
    WHEN v IN (3, 4, 5, 6, 7) OR contains(text, chr(0)) OR ({_CONTROLS}) THEN 'unknown-binary' WHEN length(text) > 2000000 THEN 'extraction-limit-exceeded' END AS reason
  FROM (SELECT doc_id, abs(doc_id) % 11 AS v, coalesce(text, '') AS text, 'f' || abs(doc_id) || '/' || {_of(NAMES, 'abs(doc_id)')} AS name, {_of([_FORMAT[n] for n in NAMES], 'abs(doc_id)')} AS format, {_of([_EXT[n] for n in NAMES], 'abs(doc_id)')} AS extension FROM ({inputs_sql("duckdb")}) AS i0) AS i1"""
_PER_DOC = f"SELECT doc_id, count(*) AS n, string_agg(category, ', ' ORDER BY p) FILTER (WHERE r = 1) AS cats FROM (SELECT doc_id, category, start * 100 + emission AS p, row_number() OVER (PARTITION BY doc_id, category ORDER BY start, emission) AS r FROM ({EXPLODED}) AS e0) AS e1 GROUP BY doc_id"
_FILE_ROWS = f"SELECT f.*, coalesce(d.n, 0) AS n, coalesce(d.cats, '') AS cats FROM ({_FILES}) AS f LEFT JOIN ({_PER_DOC}) AS d ON d.doc_id = f.doc_id"
_REDACTED = f"""WITH e AS (SELECT doc_id, start, "end", replacement_value, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM ({EXPLODED}) AS e0), f AS ({_FILES}),
  p AS (SELECT f.doc_id, string_agg(substr(text, before + 1, start - before) || replacement_value, '' ORDER BY start) AS front, max("end") AS last FROM f JOIN e ON e.doc_id = f.doc_id GROUP BY f.doc_id)"""

_ORDER_EVENTS = f"""SELECT o_orderkey AS key, epoch_ms(o_orderdate) AS timestamp, {_of((*SITES, 'elsewhere'), 'o_orderkey')} AS site,
    CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'Email address' WHEN o_orderkey % 5 = 2 THEN repeat('x', 80) || '|API key' ELSE 'Password|API key' END AS categories,
    {_of(('low', 'medium', 'high', 'critical', 'none'), 'o_orderkey % 13')} AS severity, {_of(records.CONFIDENCES, 'o_orderkey')} AS confidence, {_of((*records.ACTIONS, 'other'), 'o_orderkey % 17')} AS action,
    CASE WHEN o_orderkey % 3 = 1 THEN 0.5 WHEN o_orderkey % 3 = 2 THEN 3.7 WHEN o_orderkey % 7 = 3 THEN 2.0 END AS finding_count FROM orders"""
_VALID = "site <> 'elsewhere' AND severity <> 'none' AND action <> 'other' AND categories <> ''"

_MARKS = "SELECT sha256(((c_custkey * 7 + {s}) % {n})::VARCHAR) AS fingerprint, c_mktsegment AS category, (c_custkey * 1000)::DOUBLE AS created_at, c_custkey + 1000000000 * {s} AS seq FROM customer"
_MIGRATED = """SELECT *, CASE WHEN c_custkey % 6 = 0 THEN 'not-a-mark' ELSE sha256(c_custkey::VARCHAR) END AS mark, c_custkey % 2 = 0 AND c_nationkey % 3 <> 0 AS is_text FROM customer"""

_REVIEWED = f"SELECT *, doc_id || ':' || emission || ':' || start AS finding_id, {_of(('correct', 'not-sensitive', 'wrong-category'), 'abs(doc_id) + start')} AS feedback_label, (abs(doc_id) + start) AS k FROM ({EXPLODED}) AS e0"
_LABEL = "regexp_replace(regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g'), '^_|_$', '')"

_KINDS = "CASE WHEN doc_id % 19 = 0 THEN 'none' WHEN doc_id % 19 = 1 THEN 'many' WHEN doc_id % 19 = 2 THEN 'blank' ELSE 'ab' END"
_FAULT = f"""SELECT doc_id, CASE WHEN length(text) NOT BETWEEN 1 AND 5000 OR regexp_full_match(text, '\\s*') THEN 'text' WHEN l <> 'ab' THEN 'predicted_labels' WHEN doc_id % 23 > 20 THEN 'predicted_scores' WHEN f = 'other' THEN 'feedback'
    WHEN doc_id % 102 NOT BETWEEN 1 AND 100 THEN 'model_version' WHEN doc_id % 42 NOT BETWEEN 1 AND 40 THEN 'extension_version' WHEN doc_id % 29 IN (0, 1) THEN 'created_at' WHEN doc_id % 17 = 0 THEN 'score_labels'
    WHEN f = 'correct' AND doc_id % 4 NOT IN (0, 3) OR f = 'not_sensitive' AND doc_id % 4 <> 1 OR f = 'wrong_category' AND doc_id % 4 <> 2 THEN 'correction' END AS fault
  FROM (SELECT *, {_KINDS} AS l, {_of(('correct', 'not_sensitive', 'wrong_category', 'correct', 'other'), 'doc_id')} AS f FROM documents) AS d"""


def _flag(path: str, default: bool) -> str:
    return f"CASE WHEN json_type(j, '{path}') = 'BOOLEAN' THEN (j->>'{path}')::BOOLEAN ELSE {str(default).lower()} END"


_FLAGS = {name: _flag(path, default) for name, path, default in records.SETTINGS}
_FLAGS["protection_enabled"] = f"CASE WHEN coalesce(json_type(j, '$.protectionEnabled'), 'NULL') = 'NULL' THEN {_flag('$.masterProtection', True)} ELSE {_FLAGS['protection_enabled']} END"
_FLAGS["contribution_enabled"] = f"({_FLAGS['contribution_consent']}) AND ({_FLAGS['contribution_enabled']})"
_DAYS = "CASE WHEN json_type(j, '$.history.retentionDays') = 'NULL' THEN NULL WHEN json_type(j, '$.history.retentionDays') IN ('UBIGINT', 'BIGINT') AND (j->>'$.history.retentionDays')::INTEGER IN (7, 30, 90) THEN (j->>'$.history.retentionDays')::INTEGER ELSE 30 END"
#: The code of each of ERRORS, in order.
CODES = (
    "database_configuration_missing", "database_authentication_failed", "database_permission_denied", "database_connection_failed", "database_pooler_identity_failed", "database_authentication_failed",
    "database_capacity_reached", "database_tls_failed", "database_connection_failed", "database_pooler_username_invalid", "database_pooler_port_invalid", "database_session_pooler_connection_failed",
    "database_transaction_pooler_connection_failed", "database_direct_connection_failed", "database_operational_error", "database_programming_error", "database_interface_error", "database_unavailable",
)
assert len(CODES) == len(ERRORS)
_LETTERS = "translate(substr(sha256(c_custkey::VARCHAR), 1, 32), '0123456789abcdef', 'abcdefghijklmnop')"

_PREDICTED = f"""SELECT doc_id, label, least(i * 150, n)::INTEGER AS start, least(i * 150 + 100 + doc_id % 90, n)::INTEGER AS "end", confidence FROM (
    SELECT doc_id, n, i, {_of(semantic.SEMANTIC_LABELS, 'doc_id + i // 3')} AS label, (i * 7 % 50) / 100.0::DOUBLE + 0.5 AS confidence FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text) // 200 + 1)) AS i FROM documents) AS p0) AS p1
  WHERE least(i * 150, n) < least(i * 150 + 100 + doc_id % 90, n)"""
_MERGED = f"""SELECT doc_id, label, min(start) AS start, max("end") AS "end", max(confidence) AS confidence FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id, label ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY doc_id, label ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM ({_PREDICTED}) AS m0) AS m1) AS m2 GROUP BY doc_id, label, g"""
_CATEGORY = "CASE label " + " ".join(f"WHEN {q(x[0])} THEN {q(x[1])}" for x in semantic.LABELS) + " END"
_DOC_FINDINGS = f"SELECT * FROM ({EXPLODED}) AS e0 WHERE doc_id >= 0"
_INPUT_MATCHES = "SELECT unnest(regexp_extract_all(text, {p}, 1)) AS {n} FROM ({i}) AS i0"

_CHOSEN = "CASE " + _of(CHOICES, "o_orderkey") + " " + " ".join(f"WHEN {q(c)} THEN {q(name)}" for choices, name in records.CHOICES for c in choices) + " END"
_SWITCH = ", ".join(
    f"""coalesce(CASE WHEN json_type(j, '$.sites."{s}"') = 'BOOLEAN' THEN (j->>'$.sites."{s}"')::BOOLEAN END, true) AS {s.replace("-", "_")}""" for s in SITES
)
_AROUND = [f"[{', '.join(q(x[i]) for x in AROUND)}][event_id % {len(AROUND)} + 1]" for i in (0, 1)]

ORACLES = {
    "history_actions": f"SELECT priority, action, count(*) AS n FROM (SELECT substr(o_orderpriority, 1, 1) AS priority, {_CHOSEN} AS action FROM orders) AS o WHERE action IS NOT NULL GROUP BY priority, action",
    "feedback_validate": f"""SELECT finding_id AS id, detector, substr(repeat(category, 8), 1, 80) AS category, {_of(('low', 'high', 'certain'), 'k')} AS confidence, feedback_label, (k * 1000)::DOUBLE AS timestamp,
        array_to_string(list_transform(range(least(k % 30, 20)), lambda i: repeat('s', least(k % 120, 80))), ',') AS structures FROM ({_REVIEWED}) AS r
      WHERE k % 13 <> 0 AND k % 17 <> 0 AND k % 3 <> 2 AND k % 11 > 2 AND k % 7 <> 3 AND k % 19 <> 0 AND detector IN ('email', 'secretAssignment', 'phoneNumber', 'internalHostname')""",
    "feedback_tail": f"""SELECT id, detector, timestamp FROM (SELECT (k * 1000) || '-' || finding_id || '-' || feedback_label AS id, detector, k * 1000 AS timestamp FROM ({_REVIEWED}) AS r) AS f
      ORDER BY lpad(timestamp::VARCHAR, 20, '0') || '/' || id DESC LIMIT 500""",
    "health_validate": f"""SELECT * FROM (SELECT event_id, {_of((*SITES, 'elsewhere', None), 'event_id')} AS site, CASE event_type WHEN 'error' THEN 'unavailable' WHEN 'view' THEN 'unknown' ELSE 'protected' END AS protection,
        {_of(('ready', 'unavailable', 'ready', None, 'busy', 'ready'), 'event_id // 3')} AS scanner, CASE WHEN event_id % 7 > 2 THEN epoch_ms(ts)::DOUBLE END AS updated_at FROM events) AS h
      WHERE site IN ({_list(SITES)}) AND protection <> 'unknown' AND scanner IN ('ready', 'unavailable') AND updated_at IS NOT NULL""",
    "site_switches": f"SELECT c_custkey, {_SWITCH} FROM (SELECT c_custkey, try_cast(replace({_of(SITE_TEXTS, 'c_custkey // 3')}, '@', {_of(SITES, 'c_custkey')}) AS JSON) AS j FROM customer) AS s",
    "json_objects": f"""SELECT event_id, CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END AS is_object FROM (
        SELECT event_id, {_AROUND[0]} || CASE WHEN event_id % 7 = 5 THEN replace(props, '"', '\'\'') ELSE props END || {_AROUND[1]} AS t FROM events) AS e0""",
    "url_paths": rf"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || {_of(PATH_ENDS, "page_id")} AS path FROM pages),
        s AS (SELECT page_id, path, string_split(substr(path, 2), '/') AS seg FROM p),
        x AS (SELECT page_id, path, list_prepend([]::VARCHAR[], list_transform(range(1, len(seg) + 1), lambda i: [seg[i], CASE WHEN i = len(seg) THEN 'last' ELSE '' END])) AS xs FROM s),
        r AS (SELECT page_id, path, list_reduce(xs, lambda acc, y: CASE
            WHEN regexp_full_match(y[1], '(?i)(\.|%2e)(\.|%2e)') THEN CASE WHEN y[2] = 'last' THEN list_append(acc[1:greatest(len(acc) - 1, 0)], '') ELSE acc[1:greatest(len(acc) - 1, 0)] END
            WHEN regexp_full_match(y[1], '(?i)(\.|%2e)') THEN CASE WHEN y[2] = 'last' THEN list_append(acc, '') ELSE acc END
            ELSE list_append(acc, y[1]) END) AS stack FROM x)
      SELECT page_id, CASE WHEN path = '' THEN path ELSE '/' || list_aggregate(list_transform(string_split(array_to_string(stack, '/'), ''), lambda c:
        CASE WHEN regexp_matches(c, '[^\x21\x24-;=\x40-\x5D\x5F\x61-z|~]') THEN regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') ELSE c END), 'string_agg', '') END AS path FROM r""",
    "file_scan": f"SELECT doc_id, extension, format, CASE WHEN reason IS NULL THEN 'scanned' ELSE 'unscannable' END AS status, reason, {_MESSAGE} AS message, CASE WHEN reason IS NULL THEN length(text) END AS n_chars, CASE WHEN reason IS NULL THEN n END AS n_findings, CASE WHEN reason IS NULL THEN cats ELSE '' END AS categories FROM ({_FILE_ROWS}) AS r",
    "file_warnings": f"SELECT abs(doc_id) % 97 AS batch, count(*) AS n_files, sum(CASE WHEN reason IS NULL THEN n ELSE 1 END)::BIGINT AS warnings FROM ({_FILE_ROWS}) AS r GROUP BY 1",
    "file_copies": f"""{_REDACTED} SELECT f.doc_id, CASE WHEN r IS NULL THEN CASE WHEN f.extension = '.env' THEN f.name || '.sanitized.env' ELSE substr(f.name, 1, length(f.name) - length(f.extension)) || '.sanitized' || substr(f.name, length(f.name) - length(f.extension) + 1) END END AS copy_name,
      CASE WHEN r IS NULL THEN sha256(CASE WHEN p.doc_id IS NULL THEN text ELSE front || substr(text, last + 1) END) END AS copy_hash, r AS copy_reason
      FROM (SELECT *, CASE WHEN format IN ('pdf', 'docx') THEN 'sanitization-unavailable' ELSE reason END AS r FROM f) AS f LEFT JOIN p ON p.doc_id = f.doc_id""",
    "history_record": f"SELECT 'history-' || timestamp || '-' || key AS id, timestamp, site, categories, severity, confidence, action, CASE WHEN finding_count IS NULL THEN len(string_split(categories, '|')) ELSE greatest(1, floor(finding_count)) END::BIGINT AS finding_count FROM ({_ORDER_EVENTS}) AS e WHERE {_VALID}",
    "history_validate": f"SELECT 'e' || key AS id, timestamp, categories, severity, finding_count::BIGINT AS finding_count FROM ({_ORDER_EVENTS}) AS e WHERE {_VALID} AND finding_count > 0 AND finding_count = floor(finding_count) AND site = 'site-b' AND action = 'redacted'",
    "history_recent": "SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS timestamp FROM orders WHERE epoch_ms(o_orderdate) >= (SELECT max(epoch_ms(o_orderdate)) FROM orders) - 90 * 86400000::BIGINT",
    "allowlist_upsert": f"""WITH a AS ({_MARKS.format(s=0, n=400)} UNION ALL {_MARKS.format(s=1, n=90)}), b AS (SELECT fingerprint, arg_min(category, seq) AS category, arg_min(created_at, seq) AS created_at, max(seq) AS seq FROM a GROUP BY 1) SELECT * FROM b ORDER BY seq DESC, fingerprint LIMIT 200""",
    "allowlist_migrate": f"""SELECT c_nationkey, mark AS id, mark AS fingerprint, CASE WHEN is_text THEN 'Previously allowlisted value' ELSE substr(repeat(c_mktsegment, 12), 1, 80) END AS category, CASE WHEN is_text THEN 0.0 ELSE c_custkey END::DOUBLE AS created_at, substr(mark, 1, 10) AS prefix
      FROM ({_MIGRATED}) AS m WHERE c_nationkey IN (SELECT c_nationkey FROM ({_MIGRATED}) AS t WHERE is_text) AND mark <> 'not-a-mark' AND (is_text OR c_custkey % 2 = 1 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0)""",
    "feedback_record": f"SELECT (k * 1000) || '-' || finding_id || '-' || feedback_label AS id, detector, category, severity, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, feedback_label, k * 1000 AS timestamp, sha256('{SALT}' || chr(0) || original_value) AS value_fingerprint FROM ({_REVIEWED}) AS r",
    "contribution_payload": f"""SELECT * FROM (SELECT finding_id, substr(original_value, 1, 5000) AS text, {_LABEL} AS labels, {_LABEL} || '=' || printf('%.3f', confidence) AS scores, replace(feedback_label, '-', '_') AS feedback,
      CASE WHEN feedback_label = 'not-sensitive' THEN 'public' WHEN feedback_label = 'correct' THEN {_LABEL} WHEN k % 2 = 0 THEN {_of(semantic.SEMANTIC_LABELS, 'k')} END AS corrected FROM ({_REVIEWED}) AS r) AS c WHERE corrected IS NOT NULL""",
    "payload_rules": _FAULT,
    "settings_normalize": f"SELECT c_custkey, {', '.join(f'{sql} AS {name}' for name, sql in _FLAGS.items())}, {_DAYS} AS retention_days FROM (SELECT c_custkey, try_cast({_of(SETTINGS_TEXTS, 'c_custkey')} AS JSON) AS j FROM customer) AS s",
    "error_codes": f"SELECT o_orderkey, {_of(CODES, 'o_orderkey')} AS code FROM orders",
    "origin_filter": f"SELECT c_custkey, 'chrome-extension://' || {_LETTERS} AS origins FROM customer",
    "top_findings": f"""SELECT doc_id, start, "end", detector FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n FROM ({EXPLODED}) AS e0) AS e1 WHERE n <= 100""",
    "session_allowlist": f"SELECT doc_id, start, original_value FROM ({EXPLODED}) AS e0 WHERE original_value NOT IN (SELECT 'user' || c_custkey || '@corp' || (c_custkey % 7) || '.com' FROM customer)",
    "allowlist_filter": f"""SELECT doc_id, start, detector, original_value FROM ({EXPLODED}) AS e0 WHERE original_value NOT IN (SELECT 'node' || c_custkey || '.corp' FROM customer UNION ALL SELECT 'user' || c_custkey || '@corp' || (c_custkey % 7) || '.com' FROM customer)""",
    "overlap_all": """WITH e AS (SELECT event_id, user_id, event_type, (event_id * 7919 % 100000)::INTEGER AS start, (event_id * 7919 % 100000 + 20 + event_id % 30)::INTEGER AS "end" FROM events)
      SELECT event_id, NOT EXISTS (SELECT 1 FROM e AS o WHERE o.user_id = x.user_id AND o.event_type <> 'click' AND x.start < o."end" AND x."end" > o.start) AS replacement_safe FROM e AS x WHERE event_type = 'click'""",
    "site_exact": r"WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages) SELECT page_id, 'site-' || host AS site FROM p WHERE host IN (SELECT host FROM p GROUP BY host HAVING count(*) >= 3)",
    "layout_join": """WITH i AS (SELECT l_orderkey AS p, l_linenumber AS n, 't' || l_linenumber AS s, CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN l_linenumber * 10 + l_orderkey % 3 END AS x, CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN 700 - floor(l_linenumber / 3) * 12 END AS y,
        7 + (l_orderkey + l_linenumber) % 5 AS w, (l_orderkey + l_linenumber) % 6 = 0 AS eol FROM lineitem WHERE (l_orderkey + l_linenumber) % 13 <> 0),
      j AS (SELECT *, lag(y) OVER o AS py, lag(x + w) OVER o AS pe, coalesce(lag(eol) OVER o, true) AS cut FROM i WINDOW o AS (PARTITION BY p ORDER BY n))
      SELECT p AS l_orderkey, string_agg(CASE WHEN NOT cut AND abs(py - y) > 1 THEN chr(10) WHEN NOT cut AND x - pe > 1 THEN ' ' ELSE '' END || s || CASE WHEN eol THEN chr(10) ELSE '' END, '' ORDER BY n) AS text FROM j GROUP BY p""",
    "paste_debounce": """WITH e AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > CASE WHEN lag(event_type) OVER w = 'click' THEN 60000000 ELSE 900000000 END, true)::INT AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
      g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS b FROM e)
      SELECT user_id, epoch_us(max(ts)) AS ended_us, count(*) AS n_events, last(event_type ORDER BY ts, event_type) AS last_value FROM g GROUP BY user_id, b""",
    "semantic_findings": f"""SELECT doc_id, category, confidence, start, "end", '[Masked passage, ' || n || ' characters]' AS masked_preview, '[REDACTED ' || upper(category) || ']' AS replacement_value, CASE WHEN n < 32 THEN 'short' WHEN n < 128 THEN 'medium' WHEN n < 512 THEN 'long' ELSE 'very-long' END AS length_bucket,
      'semantic:' || label || ',overlapping-token-chunk' AS structures FROM (SELECT *, {_CATEGORY} AS category, "end" - start AS n FROM (SELECT doc_id, label, start, "end", round(confidence, 6) AS confidence FROM ({_MERGED}) AS m) AS a) AS b""",
    "semantic_merge": f"""SELECT doc_id, detector, category, start, "end", true AS replacement_safe FROM ({_DOC_FINDINGS}) AS d UNION ALL SELECT doc_id, 'semantic', {_CATEGORY}, start, "end", NOT EXISTS (SELECT 1 FROM ({_DOC_FINDINGS}) AS o WHERE o.doc_id = m.doc_id AND m.start < o."end" AND m."end" > o.start) FROM (
      SELECT m0.* FROM ({_MERGED}) AS m0 JOIN documents AS t ON t.doc_id = m0.doc_id WHERE regexp_matches(t.text, '\\S')) AS m""",
    "sensitive_keys": f"SELECT k AS key, n0 AS n, n AS normalized, {_KIND} AS kind FROM (SELECT *, {_NORMALIZED} AS n FROM (SELECT k, count(*) AS n0 FROM ({_INPUT_MATCHES.format(p=q('([A-Za-z_][A-Za-z0-9_.-]{1,63})[=:]'), n='k', i=inputs_sql('duckdb'))}) AS m GROUP BY k) AS a) AS b",
    "stand_ins": f"SELECT v AS value, n FROM (SELECT v, count(*) AS n FROM ({_INPUT_MATCHES.format(p=q(r'[=:] ?([^\s,;]+)'), n='v', i=inputs_sql('duckdb'))}) AS m GROUP BY v) AS a WHERE {placeholder('v', q(''))}",
}
