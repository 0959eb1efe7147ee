"""Archives written and read back: layout, revisits, edges."""

import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from noticegrid.llm import queries as Q
from noticegrid.llm import warc
from noticegrid.session import scratch_folder, ship_package

BODY = "<p>" + "long page " * 200
PAGES = [(1, "http://a/x y\n", BODY), (5, None, BODY), (3, "http://a/3", BODY), (5, "http://a/5", BODY), (None, "http://a/n", BODY),
         (7, "http://b/7", "short"), (8, "http://b/8", "short"), (9, "http://b/9", None), (10, "", ""), (11, "http://b/é", "é" * 500),
         (12, "http://c", "x" * 300_000), (None, None, None), (None, None, "y" * 2000), (None, "http://d", "y" * 2000)]


@pytest.fixture(scope="module")
def pages(spark):
    ship_package(spark)
    clash = {c: F.lit(7) for c in ("key", "payload", "best", "n", "kind", "block", "place", "digest")}
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns(clash)


def archived(spark, pages, **how):
    folder = scratch_folder(spark, "warc")
    warc.write(pages, folder, **how)
    return folder


def test_records(spark, pages):
    got = warc.read(spark, archived(spark, pages)).collect()
    assert len(got) == len(PAGES) == len({r["record_id"] for r in got})
    whole = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in PAGES}
    assert all(r["payload_bytes"] == len(whole[r["payload_digest"]]) for r in got)
    assert all(r["payload"] == whole[r["payload_digest"]] for r in got if r["record_type"] == "response")
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == hashlib.sha1(BODY.encode()).hexdigest())
    assert kinds == [("1", "revisit", 5), ("3", "revisit", 5), ("5", "response", None), ("5", "revisit", 5), ("None", "revisit", 5)]
    names = {r["record_id"]: r["payload_digest"] for r in got if r["record_type"] == "response"}
    assert all(names[r["refers_to_id"]] == r["payload_digest"] and r["payload"] is None for r in got if r["record_type"] == "revisit")
    assert sorted(r["record_type"] for r in got if r["payload_bytes"] == 2000) == ["response", "revisit"]
    assert {r["record_type"] for r in got if r["payload_bytes"] < 1000} == {"response"}
    assert {r["target_uri"] for r in got if r["page_id"] in (1, 11)} == {"http://a/x%20y%0A", "http://b/%C3%A9"}


def test_every_repeated_payload_by_key_or_broadcast(spark, pages, monkeypatch):
    look = lambda: sorted(map(str, warc.read(spark, archived(spark, pages), payloads=False).select("page_id", "record_type", "refers_to", "payload_digest").collect()))
    want = look()
    monkeypatch.setattr(warc, "HOT", 1)
    monkeypatch.setattr(warc, "BITS", 1 << 15)
    assert look() == want


def test_layout_of_an_archive(spark, pages):
    zstandard = pytest.importorskip("zstandard")
    many = pages.unionByName(spark.range(100, 400).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<html><body>page "), F.sha2(F.col("id").cast("string"), 512)).alias("html"),
        *[F.lit(7).alias(c) for c in pages.columns[3:]]))
    folder = archived(spark, many.coalesce(2), date="2026-01-02T03:04:05Z")
    for name in glob.glob(folder.removeprefix("file:") + "/part-*"):
        raw = open(name, "rb").read()
        assert raw[:4] == warc.DICTIONARY_MAGIC and raw.endswith(warc.SEPARATOR.encode())
        size = int.from_bytes(raw[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(raw[8:8 + size])
        with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw[8 + size:], read_across_frames=True) as stream:
            text = stream.read()
        records = list(warc.unpacked(raw))
        assert b"".join(records) == text and all(r.startswith(b"WARC/1.1\r\n") for r in records)
        assert all(b"\r\nWARC-Date: 2026-01-02T03:04:05Z\r\n" in r for r in records)


def test_damage_is_seen():
    raw = warc.record("response", "<urn:x-page:1:0>", b"abc", 3, hashlib.sha1(b"abc").hexdigest())
    assert warc.parse(raw)[2] == 1
    for bad in (raw.replace(b"abc", b"abd"), raw[:-1]):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.unpacked(__import__("zstandard").compress(raw)[:-3]))


def test_no_pages(spark, pages):
    assert warc.read(spark, archived(spark, pages.limit(0))).collect() == []


def test_query_reads_back_every_page(spark):
    sf = "/root/testdata/sf0.001"
    assert Q.queries()["op11_warc"](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
