"""What each of several filters removes in every order they could be applied in (operator 13).

A document is judged once: a mask with a bit per filter that it fails. Documents with one part and one
mask are one weighted row, so all orders together read a few rows per part. With a mask matrix (0 where the
filter fails, else infinite) and the matrix of the filters' places in each order (the inverse
permutations), the step at which an order removes a mask is their min-plus product: the least place of a
failing filter. Weights are scattered to (order, step), sums of them give what is kept, redundant and
each filter's share over all orders.

The repeat filter (E) depends on the whole table: a text fails if a row with a smaller id has it too.
Rows are counted by text, label and part before texts meet, so a text repeated a million times is a
few rows by then; texts meet by their digest.

Null text counts as empty, a null part as the empty string. A null id is neither smaller nor larger than
another: it passes E and its text is no one's original. Rows repeating an id pass or fail together.
Of several label rows of an id one mark suffices; null marks are 0. An empty table gives no rows. Very long
texts are judged whole, one at a time. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SHORT, VARIED, CAPITALS = 100, 80, 10
REPEAT = 1 << FILTERS.index("E")
_SIGN = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))

FACTS = "doc_id long, part string, digest binary, mask int"
TABLE = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def mask_of(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()
    return (
        (len(words) < SHORT) | (100 * len(set(words)) < VARIED * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > CAPITALS * len(text)) << 2
        | (_SIGN.search(raw) is not None) << 3
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        yield pa.record_batch([
            batch.column(0), batch.column(1), pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()),
            pa.array([mask_of(t) for t in texts], pa.int32())], names=["doc_id", "part", "digest", "mask"])


def facts(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, the text's digest and the bits of A to D."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(_judged, FACTS)


def weighted(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (E included), n, good, toxic: how many documents, and how many of them are so marked."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id have no label; their digest keeps them from meeting in one task.
    spare = F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(F.lit(b""))
    marked = judged.withColumn("spare", spare).join(
        marks.withColumn("l_spare", F.lit(b"")), (F.col("doc_id") == F.col("l_id")) & (F.col("spare") == F.col("l_spare")), "left")
    kind = ["digest", "mask", "part", "good", "toxic"]
    rows = marked.select("doc_id", "digest", "mask", "part", *[F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")])
    by_id = rows.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"))
    each = by_kind.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    passing = F.col("without") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = each.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + REPEAT).alias("mask"), (F.col("n") - passing).alias("n")))).alias("s")).filter("s.n > 0")
    return split.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("good")).alias("good"), F.sum(F.col("s.n") * F.col("toxic")).alias("toxic"))


def removal_steps(masks: np.ndarray, filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All orders, each filter's place in them, and at which step (from 0) each order removes each mask; ``filters`` if never."""
    orders = np.array(list(permutations(range(filters))))
    place = np.argsort(orders, axis=1).T
    never = np.where(masks[:, None] >> np.arange(filters) & 1, 0, filters)
    return orders, place, np.minimum((never[:, :, None] + place[None]).min(axis=1), filters)


def tallies(masks: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int = len(FILTERS)) -> dict[str, np.ndarray]:
    """The counts per order and step, each a matrix, and the orders."""
    orders, place, step = removal_steps(masks, filters)
    at = np.arange(len(orders))[None].repeat(len(masks), 0)

    def scattered(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), filters + 1), np.int64)
        np.add.at(out, (at, step), weight[:, None].repeat(len(orders), 1))
        return out[:, :filters]

    removed = scattered(n)
    fails = (masks[:, None, None] >> orders[None] & 1).astype(bool)
    gone = step[:, :, None] < np.arange(filters)
    alone = np.array([n[masks == 1 << f].sum() for f in range(filters)], np.int64)
    shares = np.array([removed[np.arange(len(orders)), place[f]].sum() for f in range(filters)], np.int64)
    return {"orders": orders, "kept": n.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": ((fails & gone) * n[:, None, None]).sum(axis=0),
            "unique_fails": alone[orders], "good_lost": scattered(good), "toxic_lost": scattered(toxic), "shapley": shares[orders]}


def _part(key: tuple, table: pa.Table) -> pa.Table:
    got = tallies(*(table[c].to_numpy().astype(np.int64) for c in ("mask", "n", "good", "toxic")))
    orders = got.pop("orders")
    names = ["".join(FILTERS[f] for f in o) for o in orders]
    size, steps = orders.size, orders.shape[1]
    return pa.table({
        "part": pa.array([key[0].as_py()] * size, pa.string()), "filter_order": pa.array(np.repeat(names, steps).tolist(), pa.string()),
        "step": pa.array(np.tile(np.arange(1, steps + 1), len(orders)), pa.int32()), **{k: pa.array(v.ravel(), pa.int64()) for k, v in got.items()}})


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row per part, order and step, zeros included."""
    return weighted(facts(docs, part), labels).groupBy("part").applyInArrow(_part, TABLE)
