"""What a scan works out once for a value, not once for each use."""

from pyspark.sql import functions as F

from textguard.functions import scalars as S


def _plan(spark, column) -> str:
    df = spark.range(1).select(F.col("id").cast("string").alias("k")).select(column.alias("x"))
    return df._jdf.queryExecution().analyzed().toString()


def test_keys_and_wrappings_are_cleaned_once(spark):
    assert _plan(spark, S.key_kind(F.col("k"))).count("regexp_replace(") == 3
    assert _plan(spark, S.unwrapped(F.col("k"))).count("regexp_replace(") == 1


def test_bounds_go_to_python_as_text(spark):
    from textguard.operators import resolve

    docs = spark.createDataFrame([(1, "mail a@corp.com and b@corp.com")], "doc_id long, text string")
    plan = resolve.resolved(docs)._jdf.queryExecution().analyzed().toString()
    assert "_free(array_join(" in plan


def test_prompts_of_one_file_are_scanned_by_many_tasks(spark):
    from textguard.plans.prompts import inputs

    rows = inputs(spark, "/root/testdata/sf0.001").where("doc_id < 0")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < sum(sizes) / 2


def test_documents_of_one_row_group_are_scanned_by_many_tasks(spark):
    from textguard.plans.prompts import inputs

    rows = inputs(spark, "/root/testdata/sf0.001").where("doc_id >= 0")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < sum(sizes) / 2


def test_rows_of_null_or_equal_ids_are_dealt_out_and_kept(spark, tmp_path):
    from textguard.plans.prompts import inputs

    spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(400)] + [(7, None), (7, "text 0")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(0).select(F.col("id").cast("int").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    rows = inputs(spark, str(tmp_path))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 402 and max(sizes) < 201


def test_runs_are_looked_for_only_behind_a_mark(spark):
    from textguard.operators import detect

    held = [any(x in m for x in detect.RUN_MARKS) for d in detect.DETECTORS if d.detector in detect.RUNS for m in d.marks]
    assert held and all(held)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = detect.with_findings(docs)._jdf.queryExecution().analyzed().toString()
    before = plan[: plan.index(f"RLIKE {detect.LONG_RUN}") if f"RLIKE {detect.LONG_RUN}" in plan else plan.index(f", {detect.LONG_RUN}")]
    assert all(f", {m})" in before for m in detect.RUN_MARKS)


def test_every_token_of_github_is_found(spark):
    from textguard.operators import detect

    texts = [f"a {head}{'a1B2' * 9} b" for head in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")] + ["github_pat_" + "a1B2_" * 9, "ghx_" + "a1B2" * 9, "Authorization Bearer none"]
    found = detect.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found if r["detector"] == "githubToken"} == set(range(6))
