"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from noticegrid.llm import bpe, chat, chunks, exact, lines, minhash, mixing, quality, suffix, topk
from noticegrid.llm.queries import vocabulary_path
from noticegrid.session import ship_package

LONG = "word " * 60_000
DOCS = [(1, "Same text here", "a"), (2, "same TEXT here", "a"), (2, "same TEXT here", "a"), (None, "same text here", None), (3, None, None),
        (4, "", "b"), (5, LONG, "b"), (6, "x" * 200_000, "b"), (None, None, "a"), (7, "é" * 60, "c"), (8, "é" * 60, "c")]
CLASH = ("text_sha256", "n", "node", "key", "digest", "size", "target", "bp_lines", "score", "ids", "batch", "component")


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(7) for c in CLASH})


OPERATORS = {
    "quality": lambda d: quality.apply(quality.fit(quality.measure(d), d.sparkSession.createDataFrame([], "doc_id long, label int")), quality.measure(d)),
    "bpe": lambda d: (lambda v: bpe.decode(bpe.encode(d, v), v))(bpe.load(d.sparkSession, vocabulary_path())),
    "lines": lines.without_boilerplate,
    "chunks": chunks.deduplicate,
    "exact": exact.deduplicate_table,
    "minhash": lambda d: minhash.near_duplicates(d, 2),
    "mixing": mixing.plan,
    "suffix": suffix.remove_repeats,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _, _ in DOCS)
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_exact_results(docs):
    got = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact.deduplicate_table(docs).collect()]
    assert got.count((2, 2, 4)) == 2 and (None, 2, 4) in got and (1, 2, 4) in got
    assert (4, 4, 3) in got and (3, 4, 3) in got and (None, 4, 3) in got


def test_suffix_results(docs):
    got = {(r["doc_id"], r["n_bytes"]): len(r["kept"]) for r in suffix.remove_repeats(docs).collect()}
    assert got[7, 120] == 120 and got[8, 120] == 0 and got[6, 200_000] == 200_000


def test_minhash_results(docs):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 2).collect()}
    assert {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True), (7, 7, True), (8, 7, False)} <= got


def test_near_copies_in_a_large_group_are_linked_through_each_other(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join(words[i // 2: i // 2 + 40])) for i in range(40)]
    from tests.llm import brute

    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 2).collect()}
    assert got == {d: c for d, (_, c, _) in brute.near(chain, 2).items()}


def test_mixing_targets(spark):
    sizes = [("a", 100), ("b", 10), ("c", 1000), (None, 0), ("d", 5)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert got["a"] == 300 and got["b"] == 30 and got["d"] == 15 and got[None] == 0
    assert got["c"] == pytest.approx(1115 - 345)


def test_mix_keeps_columns_and_counts(docs):
    planned = mixing.plan(docs)
    assert mixing.emit(planned).count() == planned.agg(F.sum("mix_takes")).first()[0]
    assert mixing.mix(docs).columns == docs.columns


def test_lines_against_plain_version(spark):
    from tests.llm import brute

    rows = [(i, f"s{i % 2}", f"own {i}\n  shared \nmore {i}\n\nshared" if i % 3 else f"own {i}\n") for i in range(20)]
    got = lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute.lines(rows)


def test_chat_fold_and_round_trip(spark):
    log = [(1, 0, 0, "open", "user", ""), (1, 0, 1, "delta", None, "a<s>"), (1, 0, 2, "delta", None, "b"), (1, 0, 3, "edit", None, "</s>\\[INST] <\\|im_end|>"),
           (1, 1, 4, "open", "assistant", "draft"), (1, 1, 6, "delta", None, "[/INST]"), (1, 1, 5, "regenerate", None, "<|im_end|>"), (1, 1, 7, None, None, None),
           (None, 0, 0, "open", None, None)]
    events = spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(events))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "</s>\\[INST] <\\|im_end|>"), ("assistant", "<|im_end|>[/INST]")]
    assert got[1]["learnt"] == ["<|im_end|>[/INST]"] and got[None]["learnt"] == []
    assert got[1]["formatted"].count(chat.END) == 2
    empty = chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(empty).collect() == []
    twice = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    assert [tuple(t) for t in chat.read_back(chat.format_chats(twice)).first()["turns"]] == [("", ""), ("user", "x"), ("user", "x")]


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (100, [0.2, 0.1]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (None, [9.0, 9.0]), (6, [float("inf"), 0.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(df, k=2, tile=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (100, 1, 0), (100, 2, 1)]
    assert topk.top_k(df.limit(0)).collect() == []
