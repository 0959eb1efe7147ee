"""Report sinks. Every format writes the same decorated result in parallel."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.operators.health import registry_rank
from noticegrid.operators.report import export_layout

log = logging.getLogger(__name__)


def public_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def write_csv(df: DataFrame, path: str) -> None:
    """The labelled export with missing values as empty cells, without a byte-order mark."""
    export_layout(df).write.mode("overwrite").option("header", True).option("nullValue", "").option(
        "emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, health: DataFrame | None = None, generated_at: str | None = None) -> None:
    """Notices as JSON lines, next to one envelope line with the run's counts and sources.

    The notices stay distributed; only the source list, one row per registered source and with its
    ``key``, is nested into the envelope, in the order of the registry.
    """
    public_columns(df).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/tenders")
    counts = df.agg(F.count("*").alias("tender_count")).withColumn("generated_at", F.lit(generated_at))
    if health is not None:
        ranked = F.struct(registry_rank(F.col("key")).alias("rank"), F.struct(*health.columns).alias("source"))
        sources = health.agg(F.transform(F.sort_array(F.collect_list(ranked)), lambda r: r["source"]).alias("portals"))
        counts = counts.withColumn("portals", sources.scalar())
    counts.write.mode("overwrite").json(f"{path}/envelope")


def write_parquet(df: DataFrame, path: str) -> None:
    public_columns(df).write.mode("overwrite").parquet(path)


FORMATS: dict[str, Callable[[DataFrame, str], None]] = {
    "csv": write_csv, "json": write_json, "parquet": write_parquet,
}


def run_folder(root: str, stamp: str, slug: str | None) -> str:
    """Output folder that states the run's health in its name."""
    return f"{root.rstrip('/')}/run={stamp}" + (f"_{slug}" if slug else "")


def write_outputs(df: DataFrame, folder: str, formats=("csv", "json")) -> dict[str, str]:
    """Write each format; one failing format does not lose the others."""
    written = {}
    kept = df.persist()
    try:
        for name in formats:
            if name not in FORMATS:
                continue
            try:
                FORMATS[name](kept, f"{folder}/{name}")
                written[name] = f"{folder}/{name}"
            except Exception as error:  # noqa: BLE001
                log.error("could not write %s output: %s", name, error)
    finally:
        kept.unpersist()
    return written
