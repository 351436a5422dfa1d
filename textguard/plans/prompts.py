"""Prompts that hold one of each kind of finding, made from the customer table.

The same text is made by Spark and by the SQL of the tests' oracle: the CASE
below is written in what both dialects share, with the hash function filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HASH = {"spark": "sha2(CAST(c_custkey AS STRING), 256)", "duckdb": "sha256(CAST(c_custkey AS VARCHAR))"}
_CASE = """CASE k % 20
  WHEN 0 THEN 'key ' || 'AKIA' || upper(substr(h, 1, 16)) || ' in use'
  WHEN 1 THEN 'clone with ghp_' || substr(h, 1, 36) || ' now'
  WHEN 2 THEN 'pay sk_live_' || substr(h, 1, 24)
  WHEN 3 THEN CASE WHEN k % 40 < 20 THEN 'post xoxb-' || substr(h, 1, 24) ELSE 'app xapp-1-' || substr(h, 1, 24) END
  WHEN 4 THEN CASE WHEN k % 40 < 20 THEN 'use sk-' || substr(h, 1, 40) ELSE 'use sk-ant-api03-' || substr(h, 1, 40) END
  WHEN 5 THEN CASE WHEN k % 40 < 20 THEN 'reach db' || k || '.corp:5432' ELSE 'PostgreSQL://svc' || k || ':' || substr(h, 1, 12) || '@db' || k || '.corp:5432/app, or redis://u:' || substr(h, 1, 6) || '@cache.' END
  WHEN 6 THEN CASE WHEN k % 40 < 20 THEN 'see db' || k || '.example.corp' WHEN k % 80 < 40 THEN 'mysql://app:' || substr(h, 1, 4 + CAST(k % 7 AS INT)) || '@' ELSE 'mysql://app:' || substr(h, 1, 9) || '@[broken and mysql://db/x' END
  WHEN 7 THEN 'password: "' || substr(h, 1, 8) || '"'
  WHEN 8 THEN 'PASSWORD=Aa1' || chr(33) || substr(h, 1, 8)
  WHEN 9 THEN 'API_KEY=your-api-key'
  WHEN 10 THEN 'Authorization: Bearer ' || substr(h, 1, 32)
  WHEN 11 THEN 'X-API-Key: ' || substr(h, 1, 24)
  WHEN 12 THEN CASE WHEN k % 40 < 20 THEN 'Cookie: session=' || substr(h, 1, 24) ELSE 'Cookie: theme=dark' END
  WHEN 13 THEN CASE WHEN k % 40 < 20 THEN 'send eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.' || substr(h, 1, 43) WHEN k % 80 < 40 THEN 'the JWT ' || substr(h, 1, 12) || '.eyJzdWIiOiIxIn0.' || substr(h, 13, 20) ELSE '' END || 'token = ' || substr(h, 1, 40) || ', client_secret: ' || substr(h, 41, 12)
  WHEN 14 THEN CASE WHEN k % 40 < 20 THEN '{{"user": "u' || k || '", "dbPassword": "' || substr(h, 1, 14) || '", "max_token": "' || substr(h, 15, 20) || '", "api_key": "your-api-key"}}' ELSE 'MAX_TOKEN_COUNT=4000 and api_key = ''' || substr(h, 1, 20) || '''' END
  WHEN 15 THEN '-----BEGIN PRIVATE KEY-----' || chr(10) || substr(h, 1, 60) || CASE k % 80 WHEN 15 THEN chr(10) || '----END PRIVATE KEY-----' WHEN 35 THEN chr(10) || '-----END RSA PRIVATE KEY-----' WHEN 55 THEN chr(10) || substr(h, 1, 60) ELSE chr(10) || '-----END PRIVATE KEY-----' END
  WHEN 16 THEN 'Contact user' || k || '@corp' || (k % 7) || '.com'
  WHEN 17 THEN 'Phone: (4' || lpad(CAST(k % 100 AS {string}), 2, '0') || ') 867-' || lpad(CAST(k % 10000 AS {string}), 4, '0')
  WHEN 18 THEN 'Connect to node' || k || '.corp or example.lan'
  ELSE 'MAX_TOKEN_COUNT=4000 commit ' || substr(h, 1, 40) || ' and user@example.com' END"""


def prompts_sql(dialect: str) -> str:
    """SELECT doc_id, text; ids are below zero, so that they differ from documents'."""
    case = _CASE.format(string="STRING" if dialect == "spark" else "VARCHAR")
    return f"SELECT -1 - k AS doc_id, {case} AS text FROM (SELECT c_custkey AS k, {_HASH[dialect]} AS h FROM customer) AS t"


def inputs_sql(dialect: str) -> str:
    return f"SELECT doc_id, text FROM documents UNION ALL {prompts_sql(dialect)}"


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: all documents and all prompts.

    A file's size and row groups say nothing of the work: a key of four bytes becomes a
    text that is scanned at length, and a row group of documents, however large, is one
    task. So keys and documents are dealt out first, to a fixed number of tasks, which
    AQE doesn't merge. Documents go by id and text, since ids may be null or repeat."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "customer")}
    documents = tables["documents"].select("doc_id", "text").repartition(n, "doc_id", "text")
    keys = tables["customer"].select("c_custkey").repartition(n, "c_custkey")
    sql = prompts_sql("spark").replace("{", "{{").replace("}", "}}")
    prompts = spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=keys)
    return documents.unionByName(prompts)
