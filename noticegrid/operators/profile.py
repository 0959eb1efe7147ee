"""Profiles of raw data: fields, duplicate titles, tallies and read completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions.text import clean, text_or_empty

URL_LIKE = r"(?i)url|link|href|uri"


def field_anatomy(items: DataFrame, fields: str, row_no: str, limit: int | None = 40) -> DataFrame:
    """Per key of a ``map<string,string>``: fill count, first sample, link-likeness.

    Empty strings, lists and objects do not count as filled.
    """
    pairs = items.select(row_no, F.explode(fields).alias("key", "value")).where(
        F.col("value").isNotNull() & ~F.trim("value").isin("", "[]", "{}", "null")
    )
    per_key = pairs.groupBy("key").agg(
        F.count("*").alias("filled"), F.min_by("value", row_no).alias("sample")
    )
    anatomy = per_key.select(
        "key", "filled", clean(F.col("sample")).alias("sample"),
    ).withColumn("url_like", F.col("key").rlike(URL_LIKE) | F.col("sample").startswith("http"))
    return anatomy if limit is None else anatomy.orderBy(F.desc("filled"), "key").limit(limit)


IGNORED = ("id", "url", "reference", "layer", "quality")


def duplicate_titles(notices: DataFrame) -> DataFrame:
    """Titles used more than once and the columns that differ among their rows.

    Minimum and maximum of the text form tell whether a column varies, so a title shared
    by most rows still reduces to one small partial row per task.
    """
    columns = [c for c in notices.columns if c not in IGNORED + ("title",)]
    title = F.lower(F.trim("title"))
    as_text = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns}
    groups = notices.where(text_or_empty(title) != "").groupBy(title.alias("title")).agg(
        F.count("*").alias("n"),
        F.count_distinct("title").alias("spellings"),
        *[F.min(as_text[c]).alias(f"lo_{c}") for c in columns],
        *[F.max(as_text[c]).alias(f"hi_{c}") for c in columns],
    ).where(F.col("n") > 1)
    differing = F.array_sort(F.array_compact(F.array(
        F.when(F.col("spellings") > 1, "title"),
        *[F.when(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(c)) for c in columns],
    )))
    return groups.select("title", "n", differing.alias("differing"))


def tally(rows: DataFrame, column: str, limit: int = 15) -> DataFrame:
    """The most frequent values of a column; blanks count as a value."""
    value = F.coalesce(F.trim(F.col(column)), F.lit(""))
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "value"
    ).limit(limit)


def read_completeness(items: DataFrame, totals: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows read per source against the total the source reports.

    A read is truncated when it holds less than the reported total, or exactly a capped
    amount where no total is known.
    """
    read = items.groupBy("portal").agg(
        F.count("*").alias("read"), F.count_if(F.col("url").isNull()).alias("unlinked")
    )
    joined = totals.join(read, "portal", "left").withColumns({
        "read": F.coalesce("read", F.lit(0)), "unlinked": F.coalesce("unlinked", F.lit(0)),
    })
    capped = F.lit(False) if cap is None else F.col("read") == cap
    short = F.when(F.col("reported_total").isNotNull(), F.col("read") < F.col("reported_total")).otherwise(capped)
    return joined.withColumn("truncated", short)


def largest_responses(requests: DataFrame, limit: int = 12) -> DataFrame:
    """Requests of a landed log by response size."""
    return requests.orderBy(F.desc("bytes"), "url").limit(limit)


def reported_total(payload: Column) -> Column:
    """What a payload says its full result set holds."""
    names = ("total", "totalResults", "numFound", "count")
    found = [F.trim(F.get_json_object(payload, f"$.{n}")).try_cast("bigint") for n in names]
    return F.coalesce(*found)
