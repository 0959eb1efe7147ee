"""Incremental forms: report once, windowed health, deadline expiry, silent sources.

Streams need a ``timestamp`` event time; sinks are files, so results never pass through
the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticegrid.operators.health import is_broken, status
from noticegrid.operators import state
from noticegrid.operators.state import StateTables


def report_once(
    notices: DataFrame, tables: StateTables, deliver: Callable[[DataFrame, int], None],
    run_at: datetime, checkpoint: str, order: tuple[str, ...] = ("posted_date",), **trigger,
) -> StreamingQuery:
    """Deliver each id once over the life of the state.

    State follows delivery. The version comes from the batch number, so a
    replayed batch reads the state before itself and writes the same delta again;
    ``deliver`` must overwrite by batch number in the same way.
    """
    def one_batch(batch: DataFrame, number: int) -> None:
        state.report_once(tables, batch, lambda fresh: deliver(fresh, number), run_at, version=number + 1, order=order).unpersist()

    return notices.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def distinct_within(notices: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Keyed alternative: each id once within the watermark delay, without snapshots."""
    return notices.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["id"])


def health_by_window(outcomes: DataFrame, event_time: str = "ts", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Per source and window: rows scanned and how many outcomes were broken.

    ``outcomes`` has ``key``, ``reason`` and the event time. Counts combine before the
    shuffle, so a busy source is one partial row per task and window.
    """
    broken = is_broken(status(F.col("reason")))
    return outcomes.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), "key").agg(
        F.count("*").alias("scanned"), F.count_if(broken).alias("broken")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "scanned", "broken")


def expiry(notices: DataFrame, event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Emit a notice when the stream's time passes its (latest) deadline.

    ``notices`` has ``id``, ``closing`` (timestamp) and the event time; rows without a deadline never expire. A
    notice is a session from each event to the deadline that the event names, so a later event within it
    prolongs it and the session's end is the timer. State is one row per open notice and goes away when
    it closes; an event after that opens the notice again. A deadline already past is due at once.
    """
    left = F.greatest(F.unix_micros("closing") - F.unix_micros(event_time), F.lit(1))
    gap = F.concat(left.cast("string"), F.lit(" microseconds"))
    dated = notices.withWatermark(event_time, delay).where(F.col("closing").isNotNull())
    return dated.groupBy(F.session_window(event_time, gap).alias("s"), "id").agg(F.max("closing").alias("closing")).select("id", "closing")


def silence(events: DataFrame, event_time: str = "ts", gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Emit a source each time it has been quiet for ``gap``: when its session closes."""
    return events.withWatermark(event_time, delay).groupBy(
        F.session_window(event_time, gap).alias("s"), "key"
    ).agg(F.count("*").alias("n"), F.max(event_time).alias("last_event")).select(
        "key", F.col("s.start").alias("active_from"), "last_event", F.col("s.end").alias("silent_at"), "n"
    )


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Process everything available into a file sink and read the result back; called again it goes on from there."""
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/data").option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")
