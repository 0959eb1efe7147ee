"""Web archives compressed record by record with a shared dictionary (operator 11).

``write`` makes one WARC 1.1 record per page and gives every archive the same layout: a skippable frame
(magic 0x184D2A5D) with a Zstandard dictionary, then one Zstandard frame per record, each followed by an
empty skippable frame. The dictionary is trained on records of this very archive: a hash of the whole
row chooses ``SAMPLES`` rows on average, of which at most ``SAMPLE_BYTES`` bytes each are looked at. It
only serves compression, so the bound changes sizes and never what is read back.

The archives are written by Spark's own text sink, one row per frame, whose line separator is the eight
ASCII bytes of the empty skippable frame. So they go to any file system that Spark knows, and a lost
task is written again and committed once.

Of records with equal payloads (by SHA-256) of ``least`` bytes or more the one with the largest page id
is a response, the others are revisits that refer to it and carry its length and digest, but no payload.
Payloads are moved only where they may have to be: keys held by one page alone never leave the scan.
The ``HOT`` most frequent payloads (so many rows at most, by the limit) are broadcast with their winner, so a page that
is repeated a million times over becomes revisits in the scan as well. Of all other repeated keys a bit
map of ``BITS`` bits is broadcast; pages whose bit is set meet by key. A full bit map sends more pages
there and decides nothing.

Null html counts as empty, a null url leaves the target out, blanks and control characters of a url are
percent-encoded. A null page id is below every id. Rows repeating an id and a payload are records of their
own, one of them the response. Very long pages are one record in one task's memory. An empty table gives an empty folder. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticegrid.llm.common import stored, whole

LEAST = 1000
#: Rows that the dictionary is trained on, bytes taken of each, and bytes of the dictionary.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 1 << 15, 1 << 16
#: Payloads whose winner is broadcast; bits of the map of all other repeated payloads, and bits per row of it.
HOT, BITS, BLOCK_BITS = 1000, 1 << 26, 1 << 15
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

DICTIONARY_MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: An empty skippable frame (magic 0x184D2A50, length 0); all of its bytes are ASCII.
SEPARATOR = "P*M\x18\0\0\0\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, BATCH_BYTES = 1 << 16, 1 << 24

RECORD = ("record_id string, record_type string, page_id long, target_uri string, refers_to_id string, refers_to long, "
          "payload_bytes long, payload_digest string, payload binary")


def _name(page_id: int | None, digest: str, copy: str = "") -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}{copy}>"


def _page_of(name: str | None) -> int | None:
    number = name.split(":")[2] if name else "null"
    return None if number == "null" else int(number)


def record(kind: str, name: str, payload: bytes, n_bytes: int, digest: str, url: str | None = None, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record; ``digest`` and ``n_bytes`` are those of the whole payload, also where it is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))))
    if refers_to is not None:
        fields |= {"WARC-Refers-To": refers_to, "WARC-Profile": PROFILE}
    fields |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
               "Content-Type": "application/http;msgtype=response", "Content-Length": len(http) + len(payload)}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if line)


def parse(raw: bytes) -> tuple:
    """A record's row of ``RECORD``; damage is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    n_bytes = int(_fields(http)["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, name, other = fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To")
    if rest[len(body):] != b"\r\n\r\n" or kind == "response" and (len(payload) != n_bytes or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {name}")
    return (name, kind, _page_of(name), fields.get("WARC-Target-URI"), other, _page_of(other), n_bytes, digest, payload if kind == "response" else None)


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like these; of too few for training, their own bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _compressed(dictionary: bytes, date: str):
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        lead = DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, kind, large, target, n_bytes, digest, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # The response that others refer to is named by its page and payload alone; any other record by its place too.
                name = _name(page_id, digest, "" if large and kind == "response" else f":{part}-{n}")
                raw = record(kind, name, payload or b"", n_bytes, digest, url, _name(target, digest) if kind == "revisit" else None, date)
                out.append((b"" if n else lead) + press.compress(raw))
                n += 1
            yield pa.record_batch({"frame": pa.array(out, pa.binary())})

    return frames


def _bit(key) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long") % BITS


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Each page as it is to be recorded: page_id, url, kind, large, target, n_bytes, digest, payload (null in a revisit)."""
    raw = pages.select("page_id", "url", whole(F.col("html")).cast("binary").alias("payload"))
    large = F.octet_length("payload") >= least
    rows = raw.withColumn("key", F.when(large, F.unhex(F.sha2("payload", 256))))
    counted = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
    repeated = stored(counted.filter("n > 1"), "warc-repeated")
    hot = repeated.orderBy(F.desc("n"), "key").limit(HOT).select(F.col("key").alias("hot_key"), "best")
    bit = _bit(F.col("key"))
    marks = repeated.groupBy((_bit(F.col("key")) / BLOCK_BITS).cast("long").alias("block")).agg(
        F.bitmap_construct_agg(_bit(F.col("key")) % BLOCK_BITS).alias("marks"))
    known = rows.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").join(
        F.broadcast(marks), (bit / BLOCK_BITS).cast("long") == F.col("block"), "left")
    byte = F.conv(F.hex(F.substring("marks", ((bit % BLOCK_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("getbit", byte, (bit % 8).cast("int")) == 1
    is_hot = F.col("hot_key").isNotNull()
    meets = F.coalesce(F.when(is_hot, F.col("page_id").eqNullSafe(F.col("best"))).otherwise(marked), F.lit(False))

    def row(df: DataFrame, first: Column, target) -> DataFrame:
        kind = F.when(first, "response").otherwise("revisit")
        return df.select("page_id", "url", kind.alias("kind"), F.col("key").isNotNull().alias("large"), F.when(~first, target).alias("target"),
                         F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("digest"), F.when(first, F.col("payload")).alias("payload"))

    group = Window.partitionBy("key").orderBy(F.desc_nulls_last("page_id"), "url")
    met = known.filter(meets).select("page_id", "url", "payload", "key").withColumns(
        {"place": F.row_number().over(group), "best": F.first("page_id").over(group)})
    return row(known.filter(~meets), ~is_hot, F.col("best")).unionByName(row(met, F.col("place") == 1, F.col("best")))


def write(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE) -> None:
    """Write the ``page_id``, ``url`` and ``html`` of ``pages`` as archives to a new folder, one archive per task."""
    share = F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 30)) / (1 << 30)
    chosen = pages.filter(share * max(1, pages.count()) < SAMPLES).select(
        "page_id", "url", F.substring(whole(F.col("html")).cast("binary"), 1, SAMPLE_BYTES).alias("html")).limit(2 * SAMPLES).collect()
    samples = []
    for r in sorted(chosen, key=lambda r: (r["page_id"] is None, r["page_id"], r["url"] or "", bytes(r["html"]))):
        digest = hashlib.sha1(r["html"]).hexdigest()
        samples.append(record("response", _name(r["page_id"], digest), bytes(r["html"]), len(r["html"]), digest, r["url"], date=date))
    frames = decided(pages, least).mapInArrow(_compressed(train(samples), date), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(folder)


def unpacked(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, whatever skippable frames stand between them."""
    import zstandard

    view, at, unpack = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at:at + 4])
        if magic[0] & 0xF0 == 0x50 and magic[1:] == DICTIONARY_MAGIC[1:]:
            size = int.from_bytes(view[at + 4:at + 8], "little")
            if at == 0 and magic == DICTIONARY_MAGIC and size:
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8:8 + size])))
            at += 8 + size
            continue
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            step = view[at:at + CHUNK]
            parts.append(frame.decompress(step))
            at += len(step)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def _parsed(payloads: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORD.split(", ")])
        if not payloads:
            schema = pa.schema(list(schema)[:-1])
        for batch in batches:
            out, size = [], 0
            for content in batch.column(0):
                for raw in unpacked(content.as_buffer()):
                    out.append(parse(raw))
                    size += len(raw)
                    if size > BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=False)], schema=schema)
                        out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=False)], schema=schema)

    return rows


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder as rows of ``RECORD``; every response is checked against its digest.

    Without ``payloads`` that column is left out, after the check.
    """
    schema = RECORD if payloads else RECORD.removesuffix(", payload binary")
    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(_parsed(payloads), schema)
