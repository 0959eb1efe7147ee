"""The filter audit against a plain replay of every order."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticegrid.llm import audit
from noticegrid.session import ship_package

LONG = " ".join(f"word{i}" for i in range(120))
DOCS = [(1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (None, LONG, "en"), (3, LONG, None), (4, LONG + " #", ""), (5, "", "fr"), (6, None, "fr"), (7, "A B C", "fr"),
        (8, "same " * 150, "de"), (9, "SAME " * 150, "de"), (10, LONG.upper(), "de"), (11, "x" * 200_000, "de"), (None, "", "fr"), (12, LONG + " |", "de"), (0, LONG + " |", "en")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (7, 1, 0), (9, 0, 1), (None, 1, 1), (10, 1, 1), (3, None, 1)]


def fails(text, doc_id, least):
    words = text.split()
    return (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text), doc_id is not None and least[text] is not None and doc_id > least[text])


def replay(docs, labels):
    least = {}
    for d, t, _ in docs:
        ids = [x for x in (d, least.get(t or "")) if x is not None]
        least[t or ""] = min(ids, default=None)
    rows = [(p or "", fails(t or "", d, least), any(x == d and q == 1 for x, q, _ in labels if d is not None), any(x == d and z == 1 for x, _, z in labels if d is not None))
            for d, t, p in docs]
    out, total = {}, {}
    for part in {p for p, *_ in rows}:
        for order in permutations(range(5)):
            left = [r for r in rows if r[0] == part]
            everyone = left
            for step, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = [r for r in everyone if r[1][f]]
                key = part, "".join("ABCDE"[x] for x in order), step + 1
                out[key] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[1]) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    ship_package(spark)
    clash = {c: F.lit(7) for c in ("part", "digest", "mask", "n", "good", "spare", "least", "step", "quality", "toxic")}
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").withColumns(clash)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))


def test_against_a_replay_of_every_order(tables):
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(*tables).collect()}
    assert got == replay(DOCS, LABELS) and len(got) == 4 * 600


def test_no_documents_or_no_labels(tables):
    docs, labels = tables
    assert audit.audit(docs.limit(0), labels).collect() == []
    assert audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_steps_are_the_first_failing_place():
    orders, place, step = audit.removal_steps(np.arange(8), 3)
    for m in range(8):
        for o, order in enumerate(orders.tolist()):
            assert step[m, o] == next((k for k, f in enumerate(order) if m >> f & 1), 3) and all(place[f, o] == order.index(f) for f in range(3))
