"""The pipeline stage by stage, each against a plain version on its own input."""

import corpus_pipeline as P
import pytest

from noticegrid.llm import mixing, quality
from noticegrid.llm.common import read
from noticegrid.llm.queries import scores, vocabulary_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    before = docs.collect()
    stages = dict(P.STAGES)

    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == list(P.COLUMNS)
    good = {r["doc_id"] for r in scores(docs, read(spark, SF, "labels")).collect() if r["score"] >= quality.CUT}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == good and 0.7 * len(before) < len(rows) < len(before)

    lined = stages["lines"](spark, kept, SF).collect()
    assert {r["doc_id"]: r["text"] for r in lined} == brute.lines([(r["doc_id"], r["source"], r["text"]) for r in rows])

    frame = spark.createDataFrame(lined, docs.schema)
    near = stages["near_duplicates"](spark, frame, SF).collect()
    assert {r["doc_id"] for r in near} == {d for d, (_, _, k) in brute.near([(r["doc_id"], r["text"]) for r in lined], 5).items() if k}

    frame = spark.createDataFrame(near, docs.schema)
    mixed = stages["mixing"](spark, frame, SF).collect()
    takes = {r["doc_id"]: r["mix_takes"] for r in mixing.plan(frame).collect()}
    assert len(mixed) == sum(takes.values())

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in mixed}
    out = stages["bpe"](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    assert len(out) == len(mixed)
    assert all(r["ids"] == library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids for r in out)


def test_a_text_copied_to_a_third_of_a_source_keeps_its_lines(spark):
    copied = "\n".join(f"line {i} of the copied text has words of its own" for i in range(8))
    rows = [(i, copied if i % 3 == 0 else f"alone {i} has one two three\nunder every page", "en", "a") for i in range(60)]
    docs = spark.createDataFrame([(d, t, x, s, len(t)) for d, t, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lined = P.drop_lines(spark, docs, SF)
    got = {r["doc_id"]: r["text"] for r in lined.collect()}
    assert all(got[d] == (copied if d % 3 == 0 else f"alone {d} has one two three") for d in range(60))
    kept = [r["doc_id"] for r in P.drop_near_duplicates(spark, lined, SF).collect() if r["text"] == copied]
    assert kept == [0]


def test_a_long_line_on_a_twelfth_of_a_source_goes(spark):
    often, seldom = "This long line stands under many pages of the site.", "This long line stands under a few pages of the site."
    rows = [(i, f"alone {i}" + f"\n{often}\nYes." * (i % 12 == 0) + f"\n{seldom}" * (i % 40 == 1)) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in P.drop_lines(spark, docs, SF).collect()}
    assert got == {d: t.replace(f"\n{often}", "") for d, t in rows}
