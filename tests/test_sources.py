"""Payload shapes, the registry and stream state."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.operators import normalise, relevance, state
from noticegrid.sources import feeds, payloads, registry
from noticegrid.streaming import operators as W

RUN = date(2026, 6, 15)


def landed(spark, *bodies):
    return spark.createDataFrame([(json.dumps(b, ensure_ascii=False),) for b in bodies], "payload string")


def test_worldbank_shapes_and_verdicts(spark):
    item = {"id": "OP00190487", "bid_description": "Lab equipment", "project_name": "Education", "noticedate": "01-Jun-2026",
            "submission_deadline_date": "2026-07-01T00:00:00Z", "contract_value": "250,000 USD",
            "project_ctry_name": "Jordan", "notice_text": "<p>Supply&nbsp;of labs</p>"}
    other = item | {"id": "P17", "project_ctry_name": "Malawi", "notice_text": "experience in Jordan helps"}
    silent = {"id": "OP00190488", "title": "Audit in Amman", "notice_url": "https://w.example/1"}
    nothing = {"id": "x", "title": "Audit in Cairo"}
    raw = payloads.worldbank(landed(spark, {"procnotices": [item, other], "total": "4"}, {"notices": {"a": silent, "n": "x"}}, [nothing]))
    assert raw.count() == 4
    built = normalise.build_records(raw, RUN, keep=("verdict",))
    got = {r["title"]: r for r in relevance.relevant(built, S.CountryTerms(), "verdict", cleaned=True).collect()}
    assert set(got) == {"Lab equipment (Education)", "Audit in Amman"}
    lab = got["Lab equipment (Education)"]
    assert lab["url"].endswith("procurement-detail/OP00190487") and lab["description"] == "Supply of labs"
    assert (lab["posted_date"], lab["closing_date"], lab["estimated_value_usd"]) == (date(2026, 6, 1), date(2026, 7, 1), 250_000.0)
    assert got["Audit in Amman"]["url"] == "https://w.example/1"


def test_ted(spark):
    a = {"publication-number": "12-2026", "notice-title": {"fra": ["Étude"], "eng": ["Study", "one"]}, "publication-date": "2026-06-10+02:00",
         "deadline-receipt-tender-date-lot": ["2026-07-10+02:00"], "total-value": {"eng": ["500000"]}, "buyer-name": {"eng": ["Buyer"]},
         "buyer-country": ["JOR"], "links": {"html": {"ENG": "https://t.example/12"}}}
    b = {"publication-number": "13-2026", "notice-title": {"eng": "Austria – Licences for Jordan"}}
    got = {r["title"]: r for r in payloads.ted(landed(spark, {"notices": [a, b]})).collect()}
    assert got["Study one"]["verdict"] is True and got["Study one"]["url"] == "https://t.example/12"
    assert got["Study one"]["contact"] == "Buyer" and got["Study one"]["closing"] == "2026-07-10+02:00"
    assert got["Austria – Licences for Jordan"]["verdict"] is False
    assert got["Austria – Licences for Jordan"]["url"].endswith("/detail/13-2026")


def test_samgov_and_fcdo(spark):
    one = {"noticeId": "s1", "title": "Works", "award": {"amount": "2500000"}, "placeOfPerformance": {"country": {"name": "JORDAN"}},
           "pointOfContact": [{"fullName": "A B", "email": "a@b.c"}], "responseDeadLine": "2026-07-01"}
    got = payloads.samgov(landed(spark, {"opportunitiesData": [one]}, {"opportunitiesData": []})).collect()
    assert [(r["contact"], r["description"], r["value_text"]) for r in got] == [("A B a@b.c", "JORDAN", "2500000")]
    release = {"ocid": "ocds-1", "date": "2026-06-01", "tag": ["tender"], "tender": {"title": "T", "value": {"amount": 120000, "currency": "GBP"},
               "tenderPeriod": {"endDate": "2026-08-01T12:00:00Z"}, "documents": [{"x": 1}, {"url": "https://d.example"}]},
               "parties": [{"name": "S", "roles": ["supplier"]}, {"name": "B", "roles": ["buyer", "x"]}]}
    bare = {"ocid": "ocds-2", "tender": {"title": "U", "mainProcurementCategory": "works"}, "tag": [], "buyer": {"name": "C"}}
    got = {r["title"]: r for r in payloads.fcdo(landed(spark, {"releases": [release, bare]})).collect()}
    assert (got["T"]["url"], got["T"]["contact"], got["T"]["notice_type"], got["T"]["value_text"]) == ("https://d.example", "B", "tender", "GBP 120000")
    assert (got["U"]["url"].rsplit("/", 1)[1], got["U"]["contact"], got["U"]["notice_type"], got["U"]["value_text"]) == ("ocds-2", "C", "works", None)


def test_registry(spark):
    sources = registry.source_table(spark, disabled=("ted",)).collect()
    assert len(sources) == 12 and [r["tier"] for r in sources] == sorted(r["tier"] for r in sources)
    assert registry.spec_table(spark).count() == 9


def test_read_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"releases": [{"title": "x", "tender": {}}]}, indent=2), encoding="utf-8")
    assert payloads.fcdo(payloads.read_payloads(spark, str(tmp_path))).count() == 1


def test_stream_reports_each_id_once(spark, tmp_path):
    schema = "id string, portal string, title string, url string, posted_date date, closing_date date"
    folder = tmp_path / "in"
    parts = [["a", "b", "a"], ["b", "c"], ["c", "d"]]
    for number, ids in enumerate(parts):
        rows = [(i, "p", f"t{number}", None, RUN, None) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part={number}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part=*"))
    tables = state.StateTables(spark, str(tmp_path / "state"))
    out = str(tmp_path / "out")
    W.report_once(
        stream, tables, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"),
        datetime(2026, 6, 15), str(tmp_path / "checkpoint"),
    ).awaitTermination()
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert got == ["a", "b", "c", "d"] and tables.seen().count() == 4
    # A replayed batch sees the state before itself and rewrites its own snapshot.
    version = tables.latest()
    batch = spark.createDataFrame([("d", "p", "t", None, RUN, None)], schema)
    assert state.report_once(tables, batch, lambda df: None, datetime(2026, 6, 15), version=version).count() in (0, 1)
    assert tables.latest() == version


def test_first_per_identity(spark):
    df = spark.createDataFrame([("p", "1", 2, "late"), ("p", "1", 1, "early"), ("q", "1", 3, "other")], "portal string, id string, n int, t string")
    got = {(r["portal"], r["t"]) for r in normalise.first_per_identity(df, "n").collect()}
    assert got == {("p", "early"), ("q", "other")}


def test_distinct_within_plan(spark):
    stream = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.col("value").cast("string").alias("id"))
    assert W.distinct_within(stream, "ts", "1 hour").isStreaming


def test_feed_files(spark, tmp_path):
    (tmp_path / "rss.xml").write_text(
        "<rss><channel><item><title>Water audit</title><link>https://f.example/1</link><pubDate>Tue, 01 Sep 2026</pubDate></item>"
        "<item><title>By guid</title><guid>https://f.example/2</guid></item><item><link>x</link></item></channel></rss>", encoding="utf-8")
    (tmp_path / "atom.xml").write_text(
        '<feed><entry><title>Atom one</title><link href="https://f.example/3"/><updated>2026-09-01</updated><summary>s</summary></entry></feed>',
        encoding="utf-8")
    rss = {r["title"]: r for r in feeds.read_rss(spark, str(tmp_path / "rss.xml")).collect()}
    assert {t: r["url"] for t, r in rss.items()} == {"Water audit": "https://f.example/1", "By guid": "https://f.example/2"}
    atom = feeds.read_atom(spark, str(tmp_path / "atom.xml")).first()
    assert (atom["url"], atom["posted"], atom["description"]) == ("https://f.example/3", "2026-09-01", "s")
