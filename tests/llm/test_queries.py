"""Every query on the smallest tables, against SQL or a plain version."""

import pyarrow.parquet as pq
import pytest

from noticegrid.llm import queries as Q
from noticegrid.plans.registry import Query
from tests.llm import brute
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


def documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    result = compare(spark, database(SF), Query(name, Q.queries()[name], SQL[name]), SF)
    assert result["ok"], result["detail"]


def rows(spark, name, cols):
    return {r["doc_id"]: tuple(r[c] for c in cols.split()) for r in Q.queries()[name](spark, SF).collect()}


def test_suffix_dedup(spark):
    got = rows(spark, "op9_suffix_dedup", "n_bytes n_removed n_spans kept_sha256")
    assert got == {d: tuple(x) for d, *x in brute.repeats(documents())}


def test_minhash_dedup(spark):
    assert rows(spark, "op7_minhash_dedup", "n_shingles component_id kept") == brute.near(documents(), 2)


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(Q.vocabulary_path())
    want = {}
    for d, text in documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[d] = (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert rows(spark, "op2_bpe", "n_tokens ids_sha256 decoded_sha256") == want


def test_quality_on_held_out_rows(spark):
    quality = dict(zip(*(pq.read_table("/root/testdata/sf0.01/labels.parquet")[c].to_pylist() for c in ("doc_id", "quality")), strict=True))
    out = Q.queries()["op1_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] in quality]
    assert len(held) > 40 and sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(documents()) * 5


def test_chunk_query_against_first_owners(spark):
    from noticegrid.llm import chunks

    cut = {d: [0, *map(int, chunks._ends((t or "").encode()))] for d, t in documents()}
    pieces = {d: [((t or "").encode()[a:b], a, b) for a, b in zip(cut[d], cut[d][1:])] for d, t in documents()}
    owner = {}
    for d in sorted(pieces):
        for piece, _, _ in pieces[d]:
            owner.setdefault(piece, d)
    want = {}
    for d, t in documents():
        raw, gone = (t or "").encode(), []
        for piece, a, b in pieces[d]:
            if owner[piece] < d:
                gone = [*gone[:-1], (gone[-1][0], b, gone[-1][2] + 1)] if gone and gone[-1][1] == a else [*gone, (a, b, 1)]
        gone = [g for g in gone if g[1] - g[0] >= min(80, len(raw))]
        kept = bytes(x for i, x in enumerate(raw) if not any(a <= i < b for a, b, _ in gone))
        want[d] = (len(raw), len(pieces[d]), sum(n for *_, n in gone), len(raw) - len(kept), len(gone), brute.sha(kept))
    assert rows(spark, "op4_substring_dedup", "n_bytes n_chunks n_repeated n_removed n_spans kept_sha256") == want
    assert any(v[2] for v in want.values())


def test_chunks_catch_planted_passages_and_leave_the_rest(spark):
    import random

    from noticegrid.llm import chunks

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    docs = [(i, text(150) + (" " + passage + " " if i % 3 == 0 else " ") + text(150)) for i in range(30)]
    got = {r["doc_id"]: r for r in chunks.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert bool(got[i]["spans"]) == (i % 3 == 0 and i > 0), i
        for a, b in got[i]["spans"]:
            assert t[a:b] in passage
