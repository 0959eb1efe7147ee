"""Where the named queries register themselves."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from noticegrid.session import ship_package

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a builder under ``name``, with equivalent SQL where there is one."""
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(build)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf_dir)

        QUERIES[name] = Query(name, shipped, sql)
        return build

    return register


def load_all() -> dict[str, Query]:
    from noticegrid.plans import inventory, listings, normal, notices, operations, streams, texts  # noqa: F401

    return QUERIES
