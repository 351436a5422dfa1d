"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textguard.llm import mixing, near_dedup, paragraph_dedup, pieces, quality_rules
from textguard.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return paragraph_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and position, the row's number in the training order from 0 on.

    The mix is written in that order, so a row's part file and its place in it tell where
    it stands; the rows of the files before it are added up, one number a file. It does
    not depend on the files' names or bounds. Rows that come from no file are numbered as
    they come."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("position"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    # the names begin with the number of the part
    before = F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(files, "_file").select("doc_id", "text", (F.col("_before") + F.col("_row")).alias("position"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as ids, with their position in the training order."""
    return pieces.encode_documents(in_order(docs), carry=("position",))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeats),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: The stages train models and hash texts in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
