"""Connected components by star contraction, every step a join or a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.common import materialised


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least of its neighbours and itself."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("m").alias("a"), "b")
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``edges`` (a, b) that is not itself the least."""
    now = materialised(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while not _stars(now):
        now = materialised(_small_star(_large_star(now)))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger node has one smaller neighbour, and none is a smaller neighbour itself."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("a").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 and down > 0").limit(1).count()
