"""What several of these operators share: reading, materialising, A-Z lower-casing, word splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.session import cut_lineage, scratch_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the space and the five ASCII controls that separate.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def n_words(text) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def materialised(df: DataFrame) -> DataFrame:
    """Small intermediate rows, cut from their lineage by a reliable checkpoint."""
    return cut_lineage(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Larger intermediate rows as a compressed table in the shared checkpoint folder."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between the JVM and a worker; both hold several copies of one for each running task.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a batch of long texts takes, unless the session asks for less already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def width(spark: SparkSession) -> int:
    """How many partitions the session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
