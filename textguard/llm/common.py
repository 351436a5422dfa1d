"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a folder of
    this machine where the session names none and runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textguard-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks it ran, not the plan
    behind the table.
    """
    path = f"{shared_dir(df.sparkSession)}/textguard/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that :func:`written` made and nothing reads any more. Those that a
    result is read from stay until the shared folder is cleared."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers each, up to which a counted table goes to every executor.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A written table of slim rows, to be broadcast if it is counted to have MOST_BROADCAST rows at
    most; a larger one is joined as Spark sees fit, by a shuffle."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def trimmed(text: Column) -> Column:
    """The text (null: empty) without white space at its ends."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text as an array, by JVM expressions."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def drawn(most: int, n: int, *keys: Column) -> Column:
    """Whether a row belongs to a sample of about ``most`` of ``n`` rows, by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(5)), F.lit(1_000_000_000)) < int(1e9 * min(1.0, most / max(n, 1)))


def bucket_of(column: Column, n: int) -> Column:
    """``crc32`` of the column as text, modulo ``n`` (null: 0)."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))
