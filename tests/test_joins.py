"""Sides of joins that grow with the input go by key, whatever size the engine takes them for."""

import pytest
from pyspark.sql import functions as F

from noticegrid.llm import topk
from noticegrid.operators import dedupe, similar
from noticegrid.operators import listings as L
from noticegrid.session import cut_lineage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def small_file(spark, tmp_path):
    def make(rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t"))
        return spark.read.parquet(str(tmp_path / "t"))

    return make


def test_anatomy_of_a_small_file_collects_nothing(small_file):
    html = "<main>" + "".join(f"<div class='item'><a href='/n/{i}'>Notice {i}</a><i>{i}.1.2026</i></div>" for i in range(4)) + "</main>"
    anatomy = L.row_anatomy(cut_lineage(L.elements(small_file([(1, html), (2, html)], "page_id long, html string"))))
    assert "Broadcast" not in plan(anatomy)
    assert sorted((r.page_id, r.depth, r.label, r.own_text, r.href) for r in anatomy.collect()) == sorted(
        (p, 0, label, text, href) for p in (1, 2) for label, text, href in (("a", "Notice 0", "/n/0"), ("i", "0.1.2026", None)))


def test_dedupe_of_a_small_file_collects_nothing(spark, small_file):
    schema = ("id string, title string, portal string, url string, posted_date date, closing_date date, estimated_value_usd double, "
              "sector string, description string, eligibility string, contact string, notice_type string, language string, score double")
    rows = [(str(i), f"Supply of {w} pumps", p, f"https://{p}/{i}", None, None, None, "s", "d" * 50, None, None, None, "en", 1.0)
            for i, (w, p) in enumerate([("water", "a"), ("water", "b"), ("waters", "c"), ("heat", "a")])]
    base = small_file(rows, schema)
    result = dedupe.deduplicate(base)
    assert "Broadcast" not in plan(result.kept) + plan(result.links)
    assert sorted((r.id, r.n_members) for r in result.kept.collect()) == [("0", 3), ("3", 1)]
    live = cut_lineage(dedupe._nodes(base.withColumn("ord", F.col("id").cast("long"))))
    assert "Broadcast" not in plan(dedupe._next_assignment(live, similar.Alike(base)))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_items_are_parsed_once_whatever_is_filtered(spark):
    from noticegrid.sources import payloads

    rows = [('{"procnotices": [{"notice_title": "Works", "id": "OP123456", "url": "http://a/1"}, {"id": "OP2"}]}',), ("[]",), (None,)]
    found = payloads.worldbank(spark.createDataFrame(rows, "payload string"))
    # The response and the item, whatever number of fields is read from them.
    assert optimized(found).count("from_json(StructField") == 2
    assert [(r.title, r.reference) for r in found.collect()] == [("Works", "OP123456")]


def test_parts_are_several_to_a_split(spark, tmp_path):
    from noticegrid.sources import tables as T

    spark.range(40).repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    table = T.table(spark, str(tmp_path), "orders")
    dealt = T.in_parts(table.where("id % 2 = 0"), spark, str(tmp_path), "orders")
    assert dealt.rdd.getNumPartitions() >= T.TASKS_PER_SPLIT * table.rdd.getNumPartitions()
    assert sorted(r.id for r in dealt.collect()) == list(range(0, 40, 2))


def test_query_tiles_of_a_small_file_are_not_collected(small_file):
    rows = [(i, [i / 8, -i / 4, 70_000.0 * (i % 3)]) for i in range(12)]
    found = topk.top_k(small_file(rows, "vec_id long, embedding array<float>"), k=2, every=4, tile=3, query_tile=2)
    want = []
    for q, mine in ((q, v) for q, v in rows if q % 4 == 0):
        scores = sorted((-sum(int(x * 1024) * int(y * 1024) for x, y in zip(mine, v, strict=True)), i) for i, v in rows if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:2], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == want
    # After the run: by the sizes that the engine met the tiles would have gone by broadcast.
    assert "Broadcast" not in plan(found)
