"""Specs found by address, counts taken while writing, bilingual values at any depth."""

import json

from pyspark.sql import functions as F

from noticegrid.operators import harvest, quality, run
from noticegrid.sources import feeds, registry


def test_longest_prefix_decides(spark):
    specs = spark.createDataFrame(
        [("a", ["https://www.x.example/en/list"], "EUR"), ("b", ["https://www.x.example/en/list/special.html", "http://y.example"], "USD")],
        "key string, urls array<string>, currency string")
    urls = {
        "https://WWW.x.example/en/list?page=2": "a", "https://www.x.example/en/list/special.html/7#top": "b", "http://y.example/any/path/below": "b",
        "https://www.x.example/en/other": None, "https://www.x.example/EN/list": None, "https://nobody.example/en/list": None, "": None, None: None,
        "https://y.example.org/": None, "https://y.example/" + "deep/" * 500: "b",
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["url"]: r["key"] for r in registry.with_specs(pages, specs).collect()}
    assert got == urls
    assert registry.with_specs(pages, specs.limit(0)).where("key IS NOT NULL").count() == 0


def test_pages_of_a_source_are_one_listing(spark):
    table = "<table><tr><th>Title</th><th>Deadline</th><th>Value</th></tr>{}</table>"
    row = "<tr><td><a href='/n/{0}'>Water works {0} in {1}</a></td><td>01.09.2026</td><td>250000</td></tr>"
    pages = [
        (1, "https://www.eib.org/en/about/procurement/all/index.htm", table.format(row.format(1, "Jordan") + row.format(2, "Malawi"))),
        (2, "https://www.eib.org/en/about/procurement/all/index.htm?page=2", table.format(row.format(1, "Jordan") + row.format(3, "Jordan"))),
        (3, "https://www.jica.go.jp/jordan/english/office/others/procurement.html", table.format(row.format(4, "Malawi"))),
        (4, "https://nobody.example/", table.format(row.format(5, "Jordan"))),
    ]
    from datetime import date

    landed = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = harvest.harvest(landed, registry.spec_table(spark), date(2026, 6, 15)).collect()
    assert sorted((r["portal"], r["url"].rsplit("/", 1)[1], r["estimated_value_usd"]) for r in got) == [
        ("eib", "1", 272_500.0), ("eib", "3", 272_500.0), ("jica", "4", 1_600.0)]


def test_counts_are_taken_while_writing(spark, tmp_path):
    df = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    back, taken = run.counted_write(df, str(tmp_path / "a"), {"all": F.count(F.lit(1)), "odd": F.count_if("odd")}, lambda d: d.where("odd"))
    assert back.count() == 50 and taken == {"all": 100, "odd": 50}
    _, none = run.counted_write(df.limit(0), str(tmp_path / "b"), {"all": F.count(F.lit(1))})
    assert none == {"all": 0}


def test_bilingual_values_at_any_depth(spark):
    deep = {"title": {"en": "only"}}
    for _ in range(12):
        deep = {"a.b": [deep]}
    content = {"projects": [{"name": {"ar": "x", "en": "\u00a0 "}}, {"name": {"ar": None, "en": "y"}}, deep, {"name": {"ar": 1, "en": ""}}],
               "company": {"name": {"ar": "x"}}, "projectsNote": 3}
    rows = [("a", json.dumps(content)), ("b", "[1]"), ("c", "{"), ("d", '{"projects": 1}'), ("e", None), ("f", '{"projects": []}')]
    df = spark.createDataFrame(rows, "entity string, body string")
    got = {(r["entity"], r["rule"], r["message"]) for r in quality.bilingual_content(df, ("projects",)).collect()}
    path = "a projects.2" + ".a.b.0" * 12 + ".title"
    assert got == {(path, "both languages", "bilingual text is missing ar"),
                   ("a projects.0.name", "both filled", "one language is filled in and the other is empty")}
    assert {r["entity"] for r in quality.bilingual_content(df).collect()} == {path, "a projects.0.name", "a company.name"}
    assert {(r["entity"], r["rule"]) for r in quality.content_rules(df).collect()} == {("b", "object"), ("c", "readable"), ("d", "projects"), ("e", "readable")}


def test_landed_feeds(spark):
    rows = [("<rss><channel><title>t</title><item><title>One</title><guid>https://f.example/1</guid></item><item><link>x</link></item></channel></rss>",),
            ("<rss><channel>",), ("",), (None,)]
    got = feeds.landed_rss(spark.createDataFrame(rows, "payload string")).collect()
    assert [(r["title"], r["url"], r["posted"]) for r in got] == [("One", "https://f.example/1", None)]


def _nested(levels):
    """A value some lists and objects down, and its path."""
    node, path = {"ar": "x"}, []
    for i in range(levels):
        node, step = ([node], "0") if i % 2 else ({"k": node}, "k")
        path.insert(0, step)
    return {"projects": node}, ".".join(["projects", *path])


def test_levels_are_gone_down_in_few_passes(spark):
    """The jobs do not grow with each level; texts deeper than one pass goes are walked to their ends."""
    shallow, path = _nested(quality.LEVELS_AT_ONCE - 4)
    df = spark.createDataFrame([("a", json.dumps(shallow))], "entity string, body string")
    spark.sparkContext.setJobGroup("levels", "levels")
    got = {tuple(r) for r in quality.bilingual_pairs(df, ("projects",)).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {("a", path, "x", None, True, False)} and jobs <= 6

    texts, paths = zip(*[_nested(n) for n in (0, 1, quality.LEVELS_AT_ONCE - 1, quality.LEVELS_AT_ONCE, 3 * quality.LEVELS_AT_ONCE + 1)])
    whole = {"ar": {"deep": {"en": "in a side"}}, "projects": {"en": "not looked into"}}
    bodies = [*map(json.dumps, texts), json.dumps(whole), '{"projects": [[], {}, null, "ar", 1, {"en": null}]}', '"text"']
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "entity string, body string")
    got = sorted(tuple(r) for r in quality.bilingual_pairs(df).collect())
    assert got == sorted([(str(i), p, "x", None, True, False) for i, p in enumerate(paths)] + [
        ("5", "", None, None, True, False), ("6", "projects.5", None, None, False, True)])
    assert {r["entity"] for r in quality.content_rules(df).collect() if r["rule"] == "projects"} == {"0", "1", "2", "3", "4", "5"} - {
        str(i) for i, t in enumerate(texts) if isinstance(t["projects"], list)}


def test_shapes_of_contents(spark):
    bodies = ["{}", '{"projects": []}', '{"projects": [1, "x", null, {}, [2]]}', '{"projects": null}', '{"projects": {}}',
              '{"projects": "[1]"}', '"{}"', "3", "null", "[{}]", "{", '{"a": 1, "a": 2}', None]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "entity string, body string")
    got = {(r["entity"], r["rule"]) for r in quality.content_rules(df).collect()}
    assert got == {(str(i), "projects") for i in (0, 3, 4, 5)} | {(str(i), "object") for i in (6, 7, 8, 9)} | {(str(i), "readable") for i in (10, 11, 12)}
