"""Exact deduplication against a minimal perfect hash of the digests seen before (operator 6).

A *history* of distinct digests is kept as an index table: one row per shard, holding the
level bitmaps of a minimal perfect hash and, slot by slot, the full 32-byte digest, the
winner's locator (its id) and how many rows carry it. A shard is chosen by the digest's first
bytes, so shards are even however many copies a text has. A new batch is reduced to one row per
digest before the shuffle, then looked up shard by shard: the perfect hash names one slot
and the digest stored there is compared byte by byte. Members are merged with the slot's
winner; digests that are not members group among themselves.

Null text counts as empty. A null id never wins while another row of its text has an id; if
all are null, ``keep_id`` is null and every such row is kept. Rows repeating an id and a text
are all kept rows of the winner (``doc_id = keep_id``). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.common import lower_ascii, materialised, whole, width

DIGEST = 32
#: Bits a level spends per key, and digests a shard is meant to hold.
GAMMA, SHARD_KEYS = 2.0, 50_000

INDEX = "shard int, n long, levels array<binary>, digests binary, winners binary, counts binary"
MERGED = "digest binary, keep_id long, group_size long, member boolean"
NO_ID = np.iinfo(np.int64).min


def _bits(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A position below ``size`` for each digest, from another mix of its words per level."""
    step = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64)
    h = words[:, 0] ^ (words[:, 1] + step) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29)) ^ words[:, level % 2 + 2]) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.reshape(-1, DIGEST).view("<u8")


def perfect_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Level bitmaps, and the slot of each digest (0 to n-1, none twice).

    A level keeps the keys that are alone on their bit; the others go on to the next. Digests
    must be distinct.
    """
    words, left = _words(digests), np.arange(len(digests))
    levels, slots, before = [], np.zeros(len(digests), np.int64), 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _bits(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        rank = np.cumsum(alone) - 1
        slots[left[placed]] = before + rank[at[placed]]
        before += int(placed.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, slots


def slots_of(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot each digest would have; -1 where no level has it. A foreign digest may get any slot."""
    words, found, before = _words(digests), np.full(len(digests), -1, np.int64), 0
    left = np.arange(len(digests))
    for k, alone in enumerate(levels):
        at = _bits(words[left], k, len(alone))
        here = alone[at]
        found[left[here]] = before + (np.cumsum(alone) - 1)[at[here]]
        before += int(alone.sum())
        left = left[~here]
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, DIGEST)


def _longs(column) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy().astype(np.int64)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    digests = _matrix(table["digest"])
    levels, slots = perfect_hash(digests)
    order = np.argsort(slots)
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()),
        "n": pa.array([len(digests)], pa.int64()),
        "levels": pa.array([[len(a).to_bytes(8, "little") + np.packbits(a).tobytes() for a in levels]],
                           pa.list_(pa.binary())),
        "digests": pa.array([digests[order].tobytes()], pa.binary()),
        "winners": pa.array([_longs(table["winner"])[order].tobytes()], pa.binary()),
        "counts": pa.array([_longs(table["n"])[order].tobytes()], pa.binary()),
    })


def _unpacked(level: bytes) -> np.ndarray:
    size = int.from_bytes(level[:8], "little")
    return np.unpackbits(np.frombuffer(level, np.uint8, offset=8), count=size).astype(bool)


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def _lookup(key: tuple, index: pa.Table, batch: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
    """Merge a shard's slots with the batch's digests; every digest of either comes out once."""
    fresh, winner, n = _matrix(batch["digest"]), _longs(batch["winner"]), _longs(batch["n"])
    if index.num_rows:
        row = index.to_pylist()[0]
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, DIGEST)
        winners, counts = (np.frombuffer(row[k], np.int64).copy() for k in ("winners", "counts"))
        slot = slots_of([_unpacked(x) for x in row["levels"]], fresh)
    else:
        digests, winners, counts = np.zeros((0, DIGEST), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.full(len(fresh), -1)
    member = slot >= 0
    member[member] = (digests[slot[member]] == fresh[member]).all(axis=1)
    at = slot[member]
    winners[at] = np.maximum(winners[at], winner[member])
    counts[at] += n[member]
    out = np.concatenate([digests, fresh[~member]])
    return pa.table({
        "digest": pa.array([x.tobytes() for x in out], pa.binary()),
        "keep_id": _ids(np.concatenate([winners, winner[~member]])),
        "group_size": pa.array(np.concatenate([counts, n[~member]]), pa.int64()),
        "member": pa.array(np.concatenate([np.ones(len(digests), bool), np.zeros(int((~member).sum()), bool)])),
    })


def digested(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each text, A-Z lower-cased."""
    return docs.select("doc_id", F.unhex(F.sha2(lower_ascii(whole(F.col("text"))).cast("binary"), 256)).alias("digest"))


def distinct(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest: the largest id, how many rows, the shard. Copies meet before the shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")).withColumn(
        "shard", F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    )


def build_index(history: DataFrame) -> DataFrame:
    """The index table over ``distinct`` rows of a history."""
    return history.groupBy("shard").applyInArrow(_build, INDEX)


def look_up(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Every digest of the index or of ``distinct`` batch rows: winner, rows, whether it was known."""
    return index.groupBy("shard").cogroup(batch.groupBy("shard")).applyInArrow(_lookup, MERGED)


def deduplicate(history: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """Decide on the rows of both: doc_id, digest, keep_id, group_size, known.

    ``known``: the text occurs in the history.
    """
    index = build_index(distinct(history, shards))
    merged = look_up(index, distinct(batch, shards))
    return history.unionByName(batch).join(merged, "digest").select(
        "doc_id", "digest", "keep_id", "group_size", F.col("member").alias("known")
    )


def deduplicate_table(docs: DataFrame) -> DataFrame:
    """A whole table at once: ids up to the middle of the id span are the history, the rest is new."""
    spark = docs.sparkSession
    rows = materialised(digested(docs))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = F.lit(0 if low is None else (low + high) // 2).cast("long")
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    shards = max(4 * width(spark), -(-n // SHARD_KEYS))
    return deduplicate(rows.filter(old), rows.filter(~old), shards)
