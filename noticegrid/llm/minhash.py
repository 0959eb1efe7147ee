"""MinHash near-duplicates with tensored banding (operator 7).

Two collections of ``GROUPS`` hashes each are made, every one of them from ``ROWS`` minima. The key of
table (i, j) combines hash i of the first collection with hash j of the second, so
2 x GROUPS x ROWS minima serve GROUPS squared tables of 2 x ROWS minima. Two sets of similarity s
share a table with probability (1 - (1 - s^ROWS)^GROUPS)^2, 0.9996 at 0.8. A hash held by one document
makes no shared key, so such hashes are left out before keys are combined.

Documents with equal sets are one node. Within a table key nobody is paired with everybody: members
are compared with the least member of the key, and links that the full sets confirm are contracted to
components. Only keys whose other members still lie in different components stay open. Their members
go into a second round, grouped by the hashes of the first collection alone, as each table key holds
one; there a member is met with members of other components only, so that the largest component of a
group is met by what is outside of it, not by itself. Shingles that only one open document has bound
what two sets can have in common: of either set no more than what others share, counted in
``BUCKETS`` buckets by hash. Pairs that cannot reach the threshold are never formed, and a member that
could not reach it with any set of its group leaves the group. A group is dealt to cells of ``BLOCK``
by ``BLOCK`` members, so that no task holds a large group. Every pair that shares a key is thus
either confirmed, refuted or already connected.

Words are runs of other than space and \\t to \\r, after lower-casing A-Z; fewer words than a shingle
has are one shingle; without words a document is linked with nothing. A row with null id is its
own, with null component, and kept. Rows repeating an id belong to the component of their own text;
the least id of a component counts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm import graph
from noticegrid.llm.common import materialised, stored, whole
from noticegrid.llm.shingles import mixed, shingle_set, words

GROUPS, ROWS, SEED = 12, 3, 4242
#: Buckets of a shingle profile, a power of two.
BUCKETS = 32
#: Members of a group in one side of a cell.
BLOCK = 512
#: Pairs whose texts a worker holds as strings at once.
PAIRS = 128
SIGNED = "doc_id long, n_shingles long, digest binary, first array<long>, second array<long>"


def _sets(texts: list[bytes], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, several in words(texts):
        yield at, [shingle_set(h, n) for h in several]


def _collections(sets: list[np.ndarray]) -> np.ndarray:
    """2 x GROUPS hashes for each set (not empty): row per set."""
    odd = np.random.default_rng(SEED).integers(1, 2**63, 2 * GROUPS * ROWS, dtype=np.uint64) | np.uint64(1)
    flat, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), 2 * GROUPS), np.uint64)
    for g in range(2 * GROUPS):
        total = np.full(len(sets), g, np.uint64)
        for a in odd[g * ROWS:(g + 1) * ROWS]:
            x = flat * a
            x ^= x >> np.uint64(32)
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, at))
        out[:, g] = total
    return out


def _lower(texts: list) -> list[bytes]:
    return [(t or "").encode().lower() for t in texts]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size of the shingle set, its digest, and the two collections."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(_lower(batch.column("text").to_pylist()), n):
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = np.zeros((len(sets), 2 * GROUPS), np.int64)
                if full:
                    rows[full] = _collections([sets[i] for i in full]).view(np.int64)
                split = lambda part: pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1, dtype=np.int32) * GROUPS), pa.array(np.ascontiguousarray(part).reshape(-1)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    split(rows[:, :GROUPS]), split(rows[:, GROUPS:])], names=["doc_id", "n_shingles", "digest", "first", "second"])

    return docs.select("doc_id", "text").mapInArrow(signed, SIGNED)


def table_keys(nodes: DataFrame) -> DataFrame:
    """key, node and the least node of the key (pivot) of every table key that more than one node has."""
    sides = []
    for side in ("first", "second"):
        hashes = nodes.select("node", F.posexplode(side).alias("at", "hash"))
        shared = hashes.groupBy("at", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("at", "hash")
        held = hashes.join(shared, ["at", "hash"]).groupBy("node").agg(F.collect_list(F.struct("at", "hash")).alias(side))
        sides.append(held)
    pairs = sides[0].join(sides[1], "node").select("node", F.explode("first").alias("x"), "second").select("node", "x", F.explode("second").alias("y"))
    keys = pairs.select(F.xxhash64("x.at", "x.hash", "y.at", "y.hash").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("key", "pivot")
    return keys.join(shared, "key")


def _confirmed(n: int, percent: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part, keep = batch.slice(at, PAIRS), []
                for left, right in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                    if left != last:
                        last, held = left, _one_set(left, n)
                    other = _one_set(right, n)
                    shared = len(np.intersect1d(held, other, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(held) + len(other) - shared))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])

    return links


def _one_set(text: str, n: int) -> np.ndarray:
    return next(_sets(_lower([text]), n))[1][0]


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the given nodes; every text of an id that has several."""
    return docs.join(nodes.withColumnRenamed("node", "wanted"), F.col("doc_id") == F.col("wanted")).groupBy(
        F.col("doc_id").alias("node"), F.xxhash64("text").alias("version")).agg(F.first("text").alias("text")).select("node", "text")


def confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    return two.select("a", "b", "left", "right").mapInArrow(_confirmed(n, percent), "a long, b long").distinct()


def shared_profiles(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, profile and n_common: how many of its shingles other ones of ``nodes`` have, by bucket and in all."""
    def sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        node = batch.column("node").to_numpy()
        for at, several in _sets(_lower(batch.column("text").to_pylist()), n):
            yield node[at:at + len(several)], several

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, several in sets(batch):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(node, [len(s) for s in several])), pa.array(np.concatenate(several).view(np.int64))], names=["node", "shingle"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, several in sets(batch):
                counts = np.concatenate([np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) for s in several])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(node, BUCKETS)), pa.array(np.tile(np.arange(BUCKETS), len(several))), pa.array(counts)], names=["node", "bucket", "n"])

    held = texts.join(nodes, "node", "left_semi").select("node", "text")
    alone = held.mapInArrow(rows, "node long, shingle long").groupBy("shingle").agg(
        F.min("node").alias("node"), F.max("node").alias("last")).filter("node = last")
    # BUCKETS is a power of two, so that the sign of the hash does not matter.
    less = alone.select("node", F.col("shingle").bitwiseAND(BUCKETS - 1).alias("bucket"), F.lit(-1).cast("long").alias("n"))
    both = held.mapInArrow(sizes, "node long, bucket long, n long").unionByName(less)
    of_bucket = both.groupBy("node", "bucket").agg(F.sum("n").cast("int").alias("n"))
    return of_bucket.groupBy("node").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("profile"), F.sum("n").alias("n_common"))


def _open(members: DataFrame) -> DataFrame:
    """Members of keys that hold more than one component."""
    split = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return members.join(split, "key", "left_semi")


def _able(members: DataFrame, percent: int) -> DataFrame:
    """Members that could reach the threshold with a set as small as the least of their key."""
    least = members.groupBy("key").agg(F.min("n_shingles").alias("least"))
    union = F.col("n_shingles") + F.greatest("least", "n_common") - F.col("n_common")
    return members.join(least, "key").filter(100 * F.col("n_common") >= percent * union).drop("least")


def _enough(common, one, other, percent: int):
    """Whether sets of these sizes with so much in common are similar."""
    return 100 * common >= percent * (F.col(one) + F.col(other) - common)


def first_pairs(keys: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a key's least node and another one whose sizes allow a link."""
    # An id with several texts has several sizes.
    sizes = nodes.groupBy("node").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    pairs = keys.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("least").alias(f"least_{side}"), F.col("most").alias(f"most_{side}")), side)
    return pairs.filter(_enough(F.least("most_a", "most_b"), "least_a", "least_b", percent)).select("a", "b")


def open_members(keys: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Nodes whose pairs are not all settled, in groups by the hashes of the first collection."""
    named = keys.filter("node <> pivot").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    unsettled = materialised(_open(named).select("node", "component").distinct())
    # Of an id with several texts no collection is kept: its pairs are formed in every group.
    held = nodes.join(unsettled, "node")
    own = held.groupBy("node", "component").agg(
        F.min("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).withColumn(
        "first", F.when(F.col("texts") == 1, F.col("first")).otherwise(F.array().cast("array<long>"))).drop("texts")
    groups = held.select("node", F.posexplode("first").alias("at", "hash")).select(F.xxhash64("at", "hash").alias("key"), "node", "at").distinct()
    return materialised(_open(groups.join(own, "node")))


def later_pairs(members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of a group that lie in different components and may be linked."""
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"), F.count(F.lit(1)).alias("parts")
    ).filter("parts > 1").select(
        F.col("key").alias("k"), "main", F.ceil(F.col("n") / BLOCK).alias("columns"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).alias("rows"))
    dealt = members.join(main, F.col("key") == F.col("k")).drop("k")

    def cells(side: DataFrame, own: str, other: str, name: str) -> DataFrame:
        """Members in their row or column of cells, once for each cell of it."""
        place = F.pmod(F.xxhash64("node"), F.col(own)).alias(own)
        return side.select(
            F.struct("node", "component", "n_shingles", "n_common", "at", "first", "profile", "main").alias(name), "key", place,
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other))

    outside = cells(dealt.filter("component <> main"), "rows", "columns", "p")
    every = cells(dealt, "columns", "rows", "q")
    # Two members outside of the main component meet both ways: one of them counts.
    apart = (F.col("p.component") != F.col("q.component")) & ((F.col("q.component") == F.col("q.main")) | (F.col("p.node") < F.col("q.node")))
    # Two sets have no more in common than what others have of either, bucket by bucket.
    may_link = _enough(F.least("p.n_common", "q.n_common"), "p.n_shingles", "q.n_shingles", percent)
    # A pair is formed in the first of the groups that both are in.
    before = F.zip_with(F.slice("p.first", 1, F.col("q.at")), F.slice("q.first", 1, F.col("q.at")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    buckets = F.aggregate(F.zip_with("p.profile", "q.profile", lambda a, b: F.least(a, b)), F.lit(0), lambda total, x: total + x)
    met = outside.join(every, ["key", "rows", "columns"]).filter(
        apart & may_link & ~F.exists(before, lambda same: same) & _enough(buckets, "p.n_shingles", "q.n_shingles", percent))
    return met.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def link_nodes(nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """node and component for every node that is linked with a smaller one."""
    keys = stored(table_keys(nodes), "table-keys")
    # The only pass over all documents: texts of nodes that share a key, for both rounds.
    texts = stored(_texts(docs, keys.select("node").distinct()), "key-texts")
    links = materialised(confirm(first_pairs(keys, nodes, percent), texts, n, percent))
    comps = graph.components(links)
    still = open_members(keys, nodes, comps)
    if not still.limit(1).count():
        return comps
    shared = shared_profiles(texts, still.select("node").distinct(), n)
    members = materialised(_able(still.join(shared, "node"), percent))
    more = materialised(confirm(later_pairs(members, percent), texts, n, percent))
    if not more.limit(1).count():
        return comps
    return graph.components(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, n: int, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, digest, component_id and kept, a row for each row of ``docs``."""
    texts = docs.select("doc_id", whole(F.col("text")).alias("text"))
    signed = stored(signatures(texts, n), "signatures")
    known = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = materialised(known.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.min("n_shingles").alias("n_shingles"), F.min("first").alias("first"), F.min("second").alias("second")))
    comps = link_nodes(nodes, texts, n, percent)
    of_digest = nodes.select("digest", "node").join(comps, "node", "left").select(
        F.col("digest").alias("d"), F.coalesce("component", "node").alias("c"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = signed.select("doc_id", "n_shingles", "digest").join(of_digest, linked & (F.col("digest") == F.col("d")), "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", "digest", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
