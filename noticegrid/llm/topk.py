"""Exact top-k search by inner product (operator 10).

Vectors are packed into tiles, a few rows each holding a block of ids and a block matrix. Every
query tile meets every candidate tile once through an equi-join on the candidate shard; the
pair is one matrix product, and per query only the best k of the tile go on. Both sides go by key: the
query tiles are repeated for every shard, and the engine, which does not count that, would collect them for a
broadcast. Blocks hold the least integer type that has room for their components. The lists of a
query are merged as a tree over the shards, ``FAN_IN`` at a time, so no task sees more than
``FAN_IN`` x k rows of a query at once.

Components are floor(1024 * x). Products use float64 while every partial sum stays below 2^53,
which is exact, else int64. A query is every row whose id is divisible by ``every``;
candidates are all rows with another id. Ties go to the smaller id. Rows without an id, null
vectors, vectors with null, NaN or infinite components, and empty vectors take no part; vectors
of another length than the query's are not its candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.session import keyed

SCALE = 1024
TILE = 4096
QUERY_TILE = 512
FAN_IN = 16
PACKED = "tile int, dim int, ids binary, block binary"
LISTS = "query_id long, shard long, vec_id long, score long"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer components of the vectors that take part."""
    sound = (F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return vectors.filter(F.coalesce(sound, F.lit(False))).select("vec_id", scaled.alias("vector"))


def _narrow(block: np.ndarray) -> np.ndarray:
    low, high = block.min(initial=0), block.max(initial=0)
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.ascontiguousarray(block, kind)


def _wide(block: bytes, rows: int, dim: int) -> np.ndarray:
    """The int64 components of a block, whatever type it holds."""
    return np.frombuffer(block, f"i{len(block) // (rows * dim)}").reshape(rows, dim).astype(np.int64)


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    ids = table["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    flat = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([flat.shape[1]], pa.int32()),
                     "ids": pa.array([ids[order].tobytes()], pa.binary()),
                     "block": pa.array([_narrow(flat[order]).tobytes()], pa.binary())})


def tiles(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Blocks of about ``size`` vectors; ``n`` is how many rows there are."""
    count = max(1, -(-n // size))
    keyed = rows.select(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(count)).cast("int").alias("tile"),
                        F.size("vector").alias("dim"), "vec_id", "vector")
    return keyed.groupBy("tile", "dim").applyInArrow(_pack, PACKED)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of one row; of equal scores the first columns."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _tile_lists(k: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, c = _wide(row["q_block"], len(q_ids), row["dim"]), _wide(row["block"], len(c_ids), row["dim"])
                scores = _product(q, c)
                out = [[], [], []]
                for i, own in enumerate(q_ids):
                    foreign = np.flatnonzero(c_ids != own) if (c_ids == own).any() else None
                    line, ids = (scores[i], c_ids) if foreign is None else (scores[i][foreign], c_ids[foreign])
                    top = best(line, k)
                    for kept, values in zip(out, (np.full(len(top), own), ids[top], line[top]), strict=True):
                        kept.append(values)
                cols = [np.concatenate(x).astype(np.int64) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(np.full(len(cols[0]), row["tile"], np.int64)), pa.array(cols[1]), pa.array(cols[2])],
                    names=["query_id", "shard", "vec_id", "score"])

    return lists


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, tile: int = TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates (all, if fewer)."""
    rows = integers(vectors)
    queries = rows.filter(F.col("vec_id") % every == 0)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards = max(1, -(-n // tile))
    candidates = tiles(rows, tile, n)
    asked = tiles(queries.dropDuplicates(["vec_id", "vector"]), query_tile, n_queries).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("tile"), "dim",
        F.col("ids").alias("q_ids"), F.col("block").alias("q_block"))
    pairs = keyed(candidates).join(keyed(asked), ["tile", "dim"])
    lists = pairs.mapInArrow(_tile_lists(k), LISTS)
    while True:
        by = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN)).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        shards = -(-shards // FAN_IN)
        if shards <= 1:
            return lists.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        lists = lists.drop("rank")
