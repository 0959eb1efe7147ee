"""Streaming queries over the events table, run until all landed data is processed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from noticegrid.operators.state import StateTables
from noticegrid.plans.registry import query
from noticegrid.session import scratch_folder
from noticegrid.sources import tables as T
from noticegrid.streaming import operators as W


def events_stream(spark, sf_dir):
    """The events file as a stream with a time-zoned event time."""
    schema = T.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: A slice of time lands per run; some events of the first slice land with the last one, too late to count.
SLICES, LATE = 3, 50
_IN_TIME = f"""in_time AS (SELECT * FROM events, (SELECT min(ts) AS low, max(ts) AS high FROM events)
  WHERE NOT (event_id % {LATE} = 0 AND ts < low + (high - low) / {SLICES}))"""


def in_slices(spark, sf_dir, name, build):
    """The result of a stream that is started anew each time a slice of the events has landed."""
    folder = scratch_folder(spark, name)
    events = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    first, late = F.col("ts") < F.lit(low + (high - low) / SLICES), F.col("event_id") % LATE == 0
    place = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * SLICES / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)))), F.lit(SLICES - 1))
    landed = events.withColumn("slice", F.when(first & late, SLICES - 1).when(first, 0).otherwise(F.greatest(place, F.lit(1))))
    out = None
    for k in range(SLICES):
        landed.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        out = W.run_to_files(build(stream), f"{folder}/run")
    return out


@query("stream_once", """
SELECT user_id || '-' || event_type AS id, count(*) OVER () AS delivered, first_event
FROM (SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY 1, 2)""")
def stream_once(spark, sf_dir):
    folder = scratch_folder(spark, "once")
    none = F.lit(None)
    notices = events_stream(spark, sf_dir).select(
        F.concat_ws("-", "user_id", "event_type").alias("id"), F.col("event_type").alias("portal"),
        F.concat_ws(" ", "event_type", "event_id").alias("title"), none.cast("string").alias("url"),
        none.cast("date").alias("closing_date"), "event_id",
    )

    def deliver(fresh, number):
        fresh.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    W.report_once(
        notices, StateTables(spark, f"{folder}/state"), deliver, datetime(2024, 2, 1),
        f"{folder}/checkpoint", order=("event_id",),
    ).awaitTermination()
    delivered = spark.read.parquet(f"{folder}/out")
    total = spark.read.parquet(f"{folder}/out").agg(F.count("*")).scalar()
    return delivered.select("id", total.alias("delivered"), F.col("event_id").alias("first_event"))


@query("stream_health", f"""WITH {_IN_TIME}
SELECT strftime(day, '%Y-%m-%d') AS window_start, 's' || user_id AS key, count(*) AS scanned,
       count(*) FILTER (WHERE event_type = 'error') AS broken
FROM (SELECT *, date_trunc('day', ts) AS day, max(ts) OVER () AS latest FROM in_time)
WHERE day + INTERVAL 1 DAY <= latest - INTERVAL 1 DAY GROUP BY 1, 2""")
def stream_health(spark, sf_dir):
    def health(events):
        return W.health_by_window(events.select(
            "ts", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("key"),
            F.when(F.col("event_type") == "error", "transport error").alias("reason")))

    result = in_slices(spark, sf_dir, "health", health)
    return result.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "key", "scanned", "broken")


@query("stream_expiry", f"""
WITH {_IN_TIME},
     e AS (SELECT user_id, ts, high, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
           FROM in_time WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT 'u' || user_id AS id, strftime(date_trunc('second', max(ts) + INTERVAL 6 HOUR), '%Y-%m-%d %H:%M:%S') AS closing
FROM s GROUP BY user_id, session, high HAVING max(ts) + INTERVAL 6 HOUR <= high - INTERVAL 1 HOUR""")
def stream_expiry(spark, sf_dir):
    """Each event keeps its user's notice open for six more hours."""
    def notices(events):
        return W.expiry(events.select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
            (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("closing"), "ts"))

    result = in_slices(spark, sf_dir, "expiry", notices)
    return result.select("id", F.date_format("closing", "yyyy-MM-dd HH:mm:ss").alias("closing"))


@query("stream_silence", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
     s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT 's' || user_id AS key, count(*) AS n, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last_event
FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_silence(spark, sf_dir):
    events = events_stream(spark, sf_dir).select(
        "ts", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("key")
    )
    result = W.run_to_files(W.silence(events), scratch_folder(spark, "silence"))
    return result.select("key", "n", F.date_format("last_event", "yyyy-MM-dd HH:mm:ss").alias("last_event"))
