"""Substring deduplication by content-defined chunks (operator 4).

A gear hash rolls over the bytes of a text; its last ``WINDOW`` bytes decide. A chunk ends where
the hash is the least within ``REACH`` bytes to either side (the first of equals), so a cut depends
on nearby bytes only, chunks are longer than REACH, and an insertion moves no cut beyond its
neighbourhood. Chunks are compared by a 128-bit digest, held as two numbers. A chunk that also occurs in a document
with a smaller id is a repeat; adjoining repeats of ``LEAST`` bytes or more together are removed,
shorter ones stay, so that chance repeats of short chunks leave clean text alone.

Digests meet as single rows: the least and largest id per digest are aggregated before the shuffle,
and the join back is one the engine can split, so a chunk that every document has is no
hot task. Nothing longer than a document is ever held in one place.

Null text counts as empty; a row with null id is left as it is and counts for nobody; rows repeating
an id are one document, and repeats within a document stay. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.common import whole

WINDOW, REACH, LEAST, SEED, BLOCK = 16, 24, 80, 991, 1 << 20
HALVES = ("high", "low")
_GEAR = np.random.default_rng(SEED).integers(0, 2**64, 256, dtype=np.uint64)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of gear[b] shifted by a byte's age, over WINDOW bytes."""
    h, span = _GEAR[data] >> np.uint64(WINDOW), 1
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint64(span)
        h, span = h + older, span * 2
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Where chunks end, the end of the data last."""
    n = len(data)
    if n <= 2 * REACH:
        return np.array([n] if n else [], int)
    # Windows of other lengths than a power of two are two overlapping ones.
    low, span = gear(data), 1
    own = low
    width = 2 * REACH + 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    least = np.minimum(low[: n - width + 1], low[width - span: n - span + 1])
    at = np.flatnonzero(own[REACH: n - REACH] == least) + REACH
    if len(at) > 1:
        # Of equal minima only the first within reach counts; runs of one byte have no cut inside.
        at = at[np.concatenate([[True], (at[1:] - at[:-1] > REACH) | (own[at[1:]] != own[at[:-1]])])]
    return np.concatenate([at + 1, [n]]) if not len(at) or at[-1] + 1 < n else at + 1


def chunked(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Ends and digests of the chunks of a text."""
    ends = _ends(raw)
    starts = [0, *ends][: len(ends)]
    digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)]
    return ends, digests


def _ends(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    if len(data) <= BLOCK:
        return cuts(data)
    # Blocks overlap by what a cut looks at; cuts near the edge of a block are taken from the other one.
    edge, out = WINDOW + 2 * REACH, []
    for at in range(0, len(data), BLOCK):
        a, b = max(0, at - edge), min(len(data), at + BLOCK + edge)
        found = cuts(data[a:b]) + a
        out.append(found[(found > at) & (found <= min(len(data), at + BLOCK)) & ((found < b) | (b == len(data)))])
    return np.concatenate(out)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the digest's halves of each distinct chunk of a document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [sorted(set(chunked(t.encode())[1])) for t in part.column("text").to_pylist()]
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(s) for s in sets])
                halves = np.frombuffer(b"".join(x for s in sets for x in s), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(h)) for h in halves.T)], names=["doc_id", *HALVES])

    return docs.mapInArrow(rows, "doc_id long, high long, low long")


def _digests(repeats: pa.ListArray) -> Iterator[set[bytes]]:
    """The digests listed in each row."""
    halves = np.stack([repeats.values.field(n).to_numpy(zero_copy_only=False) for n in HALVES], axis=1).astype("<i8")
    at = repeats.offsets.to_numpy()
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield {x.tobytes() for x in halves[a:b]}


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = [removed(t.encode(), d) for t, d in zip(part.column("text").to_pylist(), _digests(part.column("repeats")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())))],
                names=["doc_id", "n_bytes", "n_chunks", "n_repeated", "spans", "kept"])


def removed(raw: bytes, known: set[bytes]) -> tuple[int, int, int, list[list[int]], bytes]:
    """Bytes, chunks, chunks that go, removed spans and what is left of a text.

    Repeated chunks go where they make up ``LEAST`` bytes in a row or the whole text; a shorter stretch is repeated by chance.
    """
    ends, digests = chunked(raw)
    runs: list[list[int]] = []
    for a, b, d in zip([0, *ends][: len(ends)], ends, digests, strict=True):
        if d in known:
            if runs and runs[-1][1] == a:
                runs[-1][1:] = [int(b), runs[-1][2] + 1]
            else:
                runs.append([int(a), int(b), 1])
    gone = [r for r in runs if r[1] - r[0] >= min(LEAST, len(raw))]
    kept, at = [], 0
    for a, b, _ in gone:
        kept.append(raw[at:a])
        at = b
    return len(raw), len(digests), sum(n for *_, n in gone), [r[:2] for r in gone], b"".join([*kept, raw[at:]])


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated, spans (removed, in bytes) and kept (bytes), a row per row of ``docs``."""
    texts = docs.select("doc_id", whole(F.col("text")).alias("text"))
    rows = chunk_rows(texts.filter(F.col("doc_id").isNotNull()))
    owners = rows.groupBy(*HALVES).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    repeats = rows.join(owners.select(*HALVES, "first"), list(HALVES)).filter(F.col("doc_id") > F.col("first"))
    per_doc = repeats.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct(*HALVES)).alias("repeats"))
    joined = texts.join(per_doc, F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "repeats")
    return joined.mapInArrow(_cleaned, "doc_id long, n_bytes long, n_chunks long, n_repeated long, spans array<array<long>>, kept binary")
