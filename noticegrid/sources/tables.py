"""The given tables read as notices, units, states and payloads.

Each view is a plain projection over a whole table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.functions.text import filled
from noticegrid.session import spread

ORDERS_RUN_DATE = date(1998, 6, 15)
DOCUMENTS_RUN_DATE = date(2026, 6, 15)
#: Tasks for each split of a table whose rows get much work each.
TASKS_PER_SPLIT = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows get much work each."""
    return spread(table(spark, sf_dir, name))


def in_parts(joined: DataFrame, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows with much work each, dealt to several tasks per split of the table they come from.

    After a join the engine makes tasks of as many bytes as suit plain rows, about one per core; here each row
    takes a parse or more, so that task would last as long as the query.
    """
    splits = table(spark, sf_dir, name).rdd.getNumPartitions()
    return joined.repartition(max(spark.sparkContext.defaultParallelism, TASKS_PER_SPLIT * splits))


def every(key: str, n: int):
    return F.col(key) % n == 0


def notices_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices; fields go missing on fixed key patterns, no row is left out."""
    placed = heavy(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = placed.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("o_orderkey")
    due = F.col("o_orderdate").cast("date")
    return joined.select(
        key.cast("string").alias("id"),
        F.concat_ws(" ", "c_name", "n_name").alias("title"),
        F.col("o_orderpriority").alias("portal"),
        F.when(~every("o_orderkey", 9), F.concat(F.lit("https://notices.example/"), key.cast("string"))).alias("url"),
        F.when(~every("o_orderkey", 11), F.date_sub(due, (key % 200).cast("int"))).alias("posted_date"),
        F.when(~every("o_orderkey", 7), due).alias("closing_date"),
        F.when(every("o_orderkey", 97), F.col("o_totalprice") * 1e6)
        .when(~every("o_orderkey", 5), F.col("o_totalprice")).alias("estimated_value_usd"),
        F.col("c_mktsegment").alias("sector"),
        F.lit(None).cast("string").alias("description"),
        F.when(every("o_orderkey", 13), S.FLAG_RESTRICTED).alias("eligibility"),
        F.col("c_name").alias("contact"),
        F.col("o_orderstatus").alias("notice_type"),
        F.when(every("o_orderkey", 17), "ar").otherwise("en").alias("language"),
        key.cast("string").alias("reference"),
    )


def first_line(c):
    """The opening sentence or line of a text: everything before the first stop."""
    return F.trim(F.regexp_extract(c, r"^[^.\n]*", 0))


def notices_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notices: opening sentence as title, whole text as description."""
    docs = heavy(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        first_line(F.col("text")).alias("title"),
        F.col("source").alias("portal"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.date_add(F.lit(date(2026, 5, 1)), (F.col("doc_id") % 40).cast("int")).alias("posted_date"),
        F.lit(None).cast("date").alias("closing_date"),
        F.lit(None).cast("double").alias("estimated_value_usd"),
        F.lit(S.UNCLASSIFIED).alias("sector"),
        F.col("text").alias("description"),
        F.when(F.col("toxic") == 1, S.FLAG_RESTRICTED).alias("eligibility"),
        F.lit(None).cast("string").alias("contact"),
        F.when(F.col("quality") == 1, "Contract Notice").when(F.col("quality") == 0, "Contract Award").alias("notice_type"),
        F.col("lang").alias("language"),
        F.col("doc_id").cast("string").alias("reference"),
    )


def seen_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state an earlier run left: all finished orders were reported then."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    moment = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("portal"),
        F.col("o_orderkey").cast("string").alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.col("o_orderdate").cast("date").alias("closing_date"),
        moment.alias("first_seen"),
        moment.alias("last_seen"),
    )


def units_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an inventory of units: brand is the project, type the unit type."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    faces = F.array(*[F.lit(x) for x in ("north", "east", "south", "west")])
    status = F.array(*[F.lit(x) for x in S.UNIT_STATUS])
    return part.select(
        F.concat_ws("-", "p_brand", key.cast("string")).alias("id"),
        F.col("p_brand").alias("project_id"),
        F.concat(F.lit("d"), (F.substring("p_brand", 7, 9).cast("int") % 4).cast("string")).alias("district"),
        key.cast("string").alias("code"),
        (F.col("p_size") % 5).alias("floor"),
        F.struct(
            F.concat(F.lit("طابق "), (F.col("p_size") % 5).cast("string")).alias("ar"),
            F.concat(F.lit("Floor "), (F.col("p_size") % 5).cast("string")).alias("en"),
        ).alias("floor_label"),
        F.element_at(faces, (key % 4 + 1).cast("int")).alias("orientation"),
        F.col("p_size").cast("double").alias("area"),
        F.when(every("p_partkey", 6), 12.0).otherwise(0.0).alias("outdoor"),
        (key % 4 + 1).cast("int").alias("beds"),
        (key % 3 + 1).cast("int").alias("baths"),
        F.col("p_type").alias("type"),
        F.when(~every("p_partkey", 10), F.concat_ws("-", F.lit("plan"), F.col("p_size").cast("string"))).alias("plan"),
        F.when(~every("p_partkey", 4), F.col("p_retailprice")).alias("price"),
        F.element_at(status, (key % 3 + 1).cast("int")).alias("status"),
        key.alias("ordinal"),
    )


def projects_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand with its declared sales status."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(
        F.min("p_partkey").alias("ordinal")
    )
    number = F.substring("id", 7, 9).cast("int")
    states = F.array(*[F.lit(x) for x in ("selling", "delivered", "upcoming", "planned")])
    return brands.withColumns({
        "district": F.concat(F.lit("d"), (number % 4).cast("string")),
        "status": F.element_at(states, number % 4 + 1),
        "image": filled(F.when(number % 7 != 0, F.concat(F.lit("img-"), number.cast("string")))),
    })


def health_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sources: the event mix decides whether a source answered."""
    events = table(spark, sf_dir, "events")
    per_source = events.groupBy(F.col("user_id").alias("source_no")).agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("count"),
    )
    share = F.col("errors") / F.col("scanned")
    reason = (
        F.when(F.col("source_no") % 29 == 0, "not configured - no key")
        .when(F.col("source_no") % 31 == 0, "no listing published - nothing to read")
        .when(share > 0.25, "transport error - no content returned")
    )
    return per_source.select(
        F.concat(F.lit("s"), F.col("source_no").cast("string")).alias("key"),
        F.col("source_no").alias("rank"), "scanned", "count", reason.alias("reason"),
    )
