"""RSS and Atom, as files through the built-in XML reader or as landed texts, one row per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.functions.text import clean, filled

RSS = "title string, link string, guid string, pubDate string, description string"
ATOM = (
    "title string, link struct<_href: string>, id string, published string, updated string, "
    "summary string, content string"
)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed RSS as candidate rows; entries without a title are left out."""
    return _rss(spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed Atom as candidate rows."""
    return _atom(spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path))


def landed_rss(landed: DataFrame) -> DataFrame:
    """The entries of RSS texts, one whole feed per row in ``payload``; a feed that cannot be read gives none."""
    feed = F.from_xml("payload", f"channel struct<item array<struct<{_typed(RSS)}>>>")
    return _rss(landed.select(F.inline(feed["channel"]["item"])))


def landed_atom(landed: DataFrame) -> DataFrame:
    """The entries of Atom texts, likewise."""
    feed = F.from_xml("payload", f"entry array<struct<{_typed(ATOM)}>>")
    return _atom(landed.select(F.inline(feed["entry"])))


def _typed(fields: str) -> str:
    return ", ".join(": ".join(f.split(" ", 1)) for f in fields.split(", "))


def _rss(items: DataFrame) -> DataFrame:
    guid = F.when(F.col("guid").startswith("http"), F.col("guid"))
    return _rows(items, F.coalesce(filled(F.col("link")), guid), F.col("pubDate"), F.col("description"))


def _atom(items: DataFrame) -> DataFrame:
    identity = F.when(F.col("id").startswith("http"), F.col("id"))
    return _rows(
        items, F.coalesce(filled(F.col("link._href")), identity),
        F.coalesce("published", "updated"), F.coalesce("summary", "content"),
    )


def _rows(items: DataFrame, url, posted, description) -> DataFrame:
    return items.where(filled(F.col("title")).isNotNull()).select(
        clean(F.col("title")).alias("title"), F.trim(url).alias("url"), filled(clean(posted)).alias("posted"),
        filled(clean(description)).alias("description"),
    )
