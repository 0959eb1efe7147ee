"""Filter, score, state and report behaviour on small tables."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from noticegrid import settings as S
from noticegrid.operators import filters, health, profile, report, score, state
from noticegrid.schemas import NOTICE
from noticegrid.sources import sinks

RUN = date(2026, 6, 15)
NAMES = [f.split()[0] for f in NOTICE.replace("\n", " ").split(",")]


def notices(spark, **rows):
    """Rows by id; a field left out takes a usual value."""
    usual = {"title": "Advisory study", "portal": "ted", "url": "u", "posted_date": RUN - timedelta(days=5),
             "closing_date": RUN + timedelta(days=30), "estimated_value_usd": 500_000.0, "language": "en"}
    data = [tuple(({"id": i} | usual | r).get(n) for n in NAMES) for i, r in rows.items()]
    return spark.createDataFrame(data, NOTICE)


def judge(spark, policy=S.FilterPolicy(), **rows):
    return {r["id"]: r for r in filters.judge(notices(spark, **rows), policy, RUN).collect()}


def test_filter_reasons(spark):
    ago = lambda n: RUN - timedelta(days=n)
    got = judge(
        spark, today={"closing_date": RUN}, closed={"closing_date": ago(1)}, small={"estimated_value_usd": 40_000.0},
        stale={"closing_date": None, "posted_date": ago(400)}, fresh={"closing_date": None, "posted_date": ago(10)},
        old_dated={"posted_date": ago(400)}, dateless={"closing_date": None, "posted_date": None},
        odd={"estimated_value_usd": 1.0}, huge={"estimated_value_usd": 9e12}, edge={"estimated_value_usd": 1000.0},
        arabic={"language": "ar", "eligibility": "local only"}, no_value={"estimated_value_usd": None},
    )
    reasons = {k: r["drop_reason"] for k, r in got.items()}
    assert reasons == {
        "today": None, "closed": "closed", "small": "below minimum value",
        "stale": "undated and published over 90 days ago", "fresh": None, "old_dated": None,
        "dateless": None, "odd": None, "huge": None, "edge": "below minimum value", "arabic": None, "no_value": None,
    }
    assert got["odd"]["estimated_value_usd"] is None and len(got["odd"]["flags"]) == 1
    assert "USD 1 is not credible" in got["odd"]["flags"][0]
    assert got["fresh"]["flags"] == [S.FLAG_NO_DEADLINE]
    assert got["no_value"]["flags"] == [S.FLAG_NO_VALUE]
    assert got["arabic"]["flags"] == [S.FLAG_ARABIC, "local only"]


def test_reasons_add_up(spark):
    judged = filters.judge(notices(spark, a={}, b={"closing_date": date(2020, 1, 1)}), S.FilterPolicy(), RUN)
    counts = {r["reason"]: r["n"] for r in filters.reason_counts(judged).collect()}
    assert counts == {"kept": 1, "closed": 1}
    assert filters.survivors(judged).count() == 1


def test_weights_and_scores(spark):
    weights = S.ScorePolicy().active_weights(S.FilterPolicy())
    assert {k: round(v, 2) for k, v in weights.items()} == {"keyword": 57.14, "value": 21.43, "urgency": 21.43}
    assert S.ScorePolicy(ranking_terms=()).active_weights(
        S.FilterPolicy(min_value=None, keep_unknown_value=False)) == {"urgency": 100.0}
    df = score.score(notices(
        spark, none={"title": "zzz"}, hit={}, limited={"eligibility": "x"}, goods={"title": "Supply of study furniture"},
    ).withColumn("flags", F.array().cast("array<string>")), S.FilterPolicy(), S.ScorePolicy(), RUN)
    got = {r["id"]: r for r in df.collect()}
    assert got["none"]["components"]["keyword"] == 0.0
    assert got["hit"]["keyword_hits"] == ["advisory", "study"]
    assert round(got["hit"]["score"] - got["limited"]["score"], 1) == 25.0
    assert got["goods"]["components"]["keyword"] < 0.55 * 0.7
    assert all(0 <= r["score"] <= 100 for r in got.values())


def test_sections_move_rows(spark):
    df = notices(spark, **{f"n{i:02d}": {"estimated_value_usd": 1e5 + i * 1e4} for i in range(12)})
    scored = score.score(df.withColumn("flags", F.array().cast("array<string>")), S.FilterPolicy(), S.ScorePolicy(), RUN)
    got = report.sections(scored, inline=5).collect()
    assert len(got) == 12 and sorted(r["position"] for r in got if r["section"] == "inline") == [1, 2, 3, 4, 5]


def test_state_lifecycle(spark, tmp_path):
    tables = state.StateTables(spark, str(tmp_path))
    df = notices(spark, a={"title": "x" * 600}, b={})
    out = []
    deliver = lambda fresh: out.append(fresh.count())
    assert tables.is_first_run()
    state.report_once(tables, df, deliver, datetime(2026, 6, 1), dry_run=True)
    state.report_once(tables, df, deliver, datetime(2026, 6, 1))
    state.report_once(tables, df, deliver, datetime(2026, 6, 2))
    assert out == [2, 2, 0] and not tables.is_first_run()
    seen = {r["id"]: r for r in tables.seen().collect()}
    assert len(seen["a"]["title"]) == 600 and seen["a"]["last_seen"] == datetime(2026, 6, 1)
    tables.record(df, datetime(2026, 6, 3))
    kept = tables.seen().where("id = 'b'").first()
    assert (kept["first_seen"], kept["last_seen"]) == (datetime(2026, 6, 1), datetime(2026, 6, 3))
    assert tables.reset() == 2 and tables.is_first_run()
    state.report_once(tables, df, deliver, datetime(2026, 6, 4))
    assert out[-1] == 2
    tables.log_run(datetime(2026, 6, 4), 10, 2, 3, 4)
    assert tables.run_log().first()["reported"] == 2


def test_sections_keep_each_row_once(spark):
    rows = [("a", 9.0, "x"), ("a", 9.0, "y"), ("a", 9.0, "y"), ("a", 9.0, "y"), ("b", 1.0, "z")]
    df = spark.createDataFrame(rows, "id string, score double, title string").withColumn("closing_date", F.lit(None).cast("date"))
    for inline in range(6):
        got = report.sections(df, inline).collect()
        assert sorted((r["id"], r["score"], r["title"]) for r in got) == sorted(rows)
        assert sorted(r["position"] for r in got if r["section"] == "inline") == list(range(1, min(inline, 5) + 1))


def test_state_log(spark, tmp_path):
    tables = state.StateTables(spark, str(tmp_path), compact_every=3)
    names = [f"n{i}" for i in range(30)]
    sizes, delivered = [], {}
    for day in range(1, 12):
        ids = names[day: day + 9]
        df = notices(spark, **{i: {} for i in ids}).unionByName(notices(spark, **{ids[0]: {}}))
        out = []
        state.report_once(tables, df, lambda fresh: out.extend(r["id"] for r in fresh.collect()), datetime(2026, 6, day), version=day)  # noqa: B023
        assert len(out) == len(set(out))
        delivered |= {i: day for i in out if i not in delivered}
        if day % 4 == 0:  # a replay of the last batch delivers and writes the same
            again = []
            state.report_once(tables, df, lambda fresh: again.extend(r["id"] for r in fresh.collect()), datetime(2026, 6, day), version=day)  # noqa: B023
            assert sorted(again) == sorted(out)
        sizes.append(len(tables._versions("delta")))
    assert delivered == {i: 1 if k <= 9 else k - 8 for k, i in enumerate(names[:20]) if k}
    seen = {r["id"]: (r["first_seen"].day, r["last_seen"].day) for r in tables.seen().collect()}
    assert seen == {i: (d, d) for i, d in delivered.items()}
    assert max(sizes) <= 6 and len(tables._versions("base")) == 2
    members = notices(spark, zz={}, n5={})
    state.report_once(tables, notices(spark, z={}), lambda fresh: None, datetime(2026, 7, 1), members=lambda fresh: fresh.unionByName(members.select(fresh.columns)))
    assert {r["id"]: r["first_seen"].month for r in tables.seen().where("id in ('z', 'zz', 'n5')").collect()} == {"z": 7, "zz": 7, "n5": 6}


def test_health_and_status(spark):
    rows = [("a", None, 10), ("b", "bot wall", None), ("c", "not configured - key", None), ("d", "no listing published - x", None)]
    outcomes = spark.createDataFrame(rows, "key string, reason string, scanned bigint")
    kept = spark.createDataFrame([("a", "1", "table", 0.9)], "portal string, id string, layer string, quality double")
    h = health.source_health(outcomes, kept)
    got = {r["key"]: (r["status"], r["count"], r["not_relevant"]) for r in h.collect()}
    assert got == {"a": ("ok", 1, 9), "b": ("unavailable", 0, None), "c": ("unconfigured", 0, None), "d": ("no listing", 0, None)}

    def status(df, n, **kw):
        return health.run_status(df, spark.createDataFrame([(n,)], "reported bigint"), **kw).first()

    assert status(h, 1)["slug"] == "1-opportunity-1-of-2-portals-unavailable"
    assert status(h, 1)["alert_reason"] is None
    assert status(h.where("key <> 'a'"), 0)["state"] == "ACTION NEEDED"
    assert status(h.where("key <> 'a'"), 0)["alert_reason"] == "all 1 portals unreachable"
    assert status(h.where("key <> 'b'"), 0)["subject"] == "Notices - no new opportunities (1/1 portals OK)"
    assert status(h.where("key <> 'b'"), 2, first_run=True)["subject"].endswith("(first run - full pipeline)")
    assert [r["key"] for r in health.alert_table(h).collect()] == ["b"]


def test_duplicate_titles_and_anatomy(spark):
    df = notices(spark, a={"notice_type": "Award"}, b={"notice_type": "REOI"}, c={"title": "Other"})
    got = profile.duplicate_titles(df).collect()
    assert [(r["n"], r["differing"]) for r in got] == [(2, ["notice_type"])]
    items = spark.createDataFrame([(1, {"u": "http://x", "e": "[]"}), (2, {"u": "http://y", "k": "v"})], "n int, f map<string,string>")
    got = {r["key"]: (r["filled"], r["sample"], r["url_like"]) for r in profile.field_anatomy(items, "f", "n").collect()}
    assert got == {"u": (2, "http://x", True), "k": (1, "v", False)}


def test_sinks(spark, tmp_path):
    df = notices(spark, a={"title": "عطاء"}, b={"closing_date": None}).withColumns({
        "flags": F.array(F.lit("f1"), F.lit("f2")), "score": F.lit(50.0), "_private": F.lit(1)})
    decorated = report.decorate(df, RUN)
    sinks.FORMATS["broken"] = lambda d, p: 1 / 0
    try:
        written = sinks.write_outputs(decorated, str(tmp_path), ("csv", "broken", "json", "unknown"))
    finally:
        del sinks.FORMATS["broken"]
    assert sorted(written) == ["csv", "json"]
    table = spark.read.option("header", True).csv(written["csv"])
    assert table.columns == [label for _, label in S.REPORT_COLUMNS]
    assert {r["Title"] for r in table.collect()} == {"عطاء", "Advisory study"}
    back = spark.read.json(written["json"] + "/tenders")
    assert "_private" not in back.columns and back.count() == 2
    assert spark.read.json(written["json"] + "/envelope").first()["tender_count"] == 2
