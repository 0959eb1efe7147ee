"""The corpus pipeline: documents to encoded training text, stage by stage.

A stage takes (spark, docs, sf_dir) and returns what goes on; each is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.llm import bpe, lines, minhash, mixing, quality
from noticegrid.llm.common import read, small_batches
from noticegrid.llm.queries import scores, vocabulary_path
from noticegrid.session import scratch_folder, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut. Rows repeating an id share the least score of its texts."""
    ship_package(spark)
    small_batches(spark)
    scored = scores(docs, read(spark, sf_dir, "labels"))
    bad = scored.filter(F.col("score") < quality.CUT).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that its source repeats in other texts; n_chars follows the text."""
    kept = lines.without_boilerplate(docs, copies=False, long=lines.LONG)
    return kept.withColumn("n_chars", F.when(F.col("bp_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by five-word shingles, the one with the least id."""
    ship_package(spark)
    small_batches(spark)
    judged = minhash.near_duplicates(docs, n=SHINGLE, percent=PERCENT)
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the whole text and the text they decode to."""
    ship_package(spark)
    small_batches(spark)
    vocabulary = bpe.load(spark, vocabulary_path())
    return bpe.round_trip(docs, vocabulary)


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Neither the classifier nor BPE can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
