"""Mixing sources to target weights (operator 8).

Sizes are counted per source, targets follow from the weights, and a source's repetition
rate is its target over its size. Each document is taken floor(rate) times plus one copy with
probability rate - floor(rate), drawn from a hash of its id. A hash gives ``DRAWS``
independent draws; each source uses the one whose total falls nearest to its target (ties: the
first), which is one sum per draw in the same aggregate and makes reruns agree.

Null text has size 0; a null source is a source of its own, last in order. Repeated rows
are each taken alike. A source without words has target 0 and its rows are taken 0 times. Extra
columns are carried along; those named mix_... like the ones added are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.llm.common import materialised, n_words, width

WEIGHTS = (5, 2, 1)
MOST = 3
DRAWS = 8
_SIZE, _RATE, _TAKES = "mix_size", "mix_rate", "mix_takes"


def _draws():
    """``DRAWS`` numbers from 0 to 1, from 32 bits each of one digest of the id."""
    digest = F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") / 2.0**32 for k in range(DRAWS)]


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target, from one row per source.

    The level is raised until the parts that the full sources leave are shared by weight:
    each round is one aggregate over the sources, and a source that is full stays full.
    Names are ranked by range: a rank is the rank in its range and what lies in earlier ranges.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialised(sizes.repartitionByRange(width(sizes.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    before, seen = [], 0
    for part, n in sorted(ranged.groupBy("part").count().collect()):
        before += [F.when(F.col("part") == part, seen)]
        seen += n
    rank = F.coalesce(*before, F.lit(0)) + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    choice = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = materialised(ranged.select("source", "source_size", choice.alias("weight")))
    cap, share = most * F.col("source_size"), F.col("weight").cast("double")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full_before = 0.0, -1
    while True:
        full = cap <= F.lit(level) * share
        n, capped, rest = ranked.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == full_before or not rest:
            break
        full_before, level = n, float(total - (capped or 0)) / float(rest)
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * share).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Every row of ``docs`` with mix_size, mix_source_size, mix_target and mix_takes (copies to take)."""
    docs = docs.drop("mix_source", "mix_source_size", "mix_target", "mix_draw", _RATE, _TAKES)
    sized = docs.withColumn(_SIZE, n_words(F.col("text")))
    # Code-point order is the order of UTF-8 bytes, Spark's order of strings.
    sums = materialised(sized.groupBy("source").agg(F.sum(_SIZE).alias("source_size")))
    aims = targets(sums, weights, most)
    aims = materialised(aims.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    part = F.col("rate") - F.floor("rate")
    seen = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    keyed = seen.join(aims.select(F.col("source").alias("s"), "rate", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    over = keyed.groupBy("s", "rate", "source_size", "target").agg(
        *[F.sum(F.when(draw < part, F.col("size")).otherwise(F.lit(0))).alias(f"d{k}") for k, draw in enumerate(_draws())]
    )
    missed = [F.abs(F.floor("rate") * F.col("source_size") + F.col(f"d{k}") - F.col("target")) for k in range(DRAWS)]
    chosen = F.array_position(F.array(*missed), F.array_min(F.array(*missed))) - 1
    settled = materialised(over.select(
        F.col("s").alias("mix_source"), F.col("rate").alias(_RATE), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), chosen.cast("int").alias("mix_draw")))
    draw = F.element_at(F.array(*_draws()), F.col("mix_draw") + 1)
    extra = F.when(draw < F.col(_RATE) - F.floor(_RATE), 1).otherwise(0)
    return (sized.join(settled, F.col("source").eqNullSafe(F.col("mix_source")))
            .withColumn(_TAKES, (F.floor(_RATE) + extra).cast("int"))
            .drop("mix_source", _RATE, "mix_draw"))


def emit(planned: DataFrame) -> DataFrame:
    """The mix: each planned row as often as it is taken."""
    copies = F.explode(F.sequence(F.lit(1), F.col(_TAKES)))
    return (planned.filter(F.col(_TAKES) > 0).withColumn("mix_copy", copies)
            .drop(_SIZE, "mix_source_size", "mix_target", _TAKES))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix, with the columns of ``docs`` only."""
    return emit(plan(docs, weights, most)).select(*docs.columns)
