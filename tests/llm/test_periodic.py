"""Runs, Lyndon arrays and the query against plain versions."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from noticegrid.llm import periodic
from noticegrid.llm import queries as Q
from noticegrid.session import ship_package
from tests.llm.test_queries import SF, documents


def plain_lyndon(s):
    return [next((j for j in range(i + 1, len(s)) if s[j:] <= s[i:]), len(s)) - i for i in range(len(s))]


def plain_runs(s, least=6, times=4):
    found = []
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, times * p) and not any(s[i + q:i + size] == s[i:i + size - q] for q in range(1, p)):
                found.append((i, size, p))
            i = max(j, i + 1)
    return sorted(found)


def test_arrays_and_runs():
    rng = random.Random(3)
    for _ in range(1500):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 70))]
        if s and rng.random() < 0.7:
            a, p = rng.randrange(len(s)), rng.randint(1, 9)
            s = [c if i < a else s[a + (i - a) % p] if a + p <= len(s) else c for i, c in enumerate(s)]
            s[rng.randrange(len(s))] = 9
        assert periodic.lyndon_array(s) == plain_lyndon(s), s
        for times in (3, 4):
            assert periodic.runs_of(s, 6, times) == plain_runs(s, 6, times), s
        assert periodic.find([b"%d" % c for c in s]) == plain_runs(s)


def test_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    assert periodic.lyndon_array(b) == plain_lyndon(b) and periodic.runs_of(b, 6, 3) == plain_runs(b, 6, 3)
    assert periodic.runs_of([5] * 100_000) == [(0, 100_000, 1)]


def planted(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query(spark):
    want = {}
    for d, text in documents():
        words = planted(d, text)
        codes = {w: i for i, w in enumerate(words)}
        runs = plain_runs([codes[w] for w in words])
        gone = {i for start, size, p in runs for i in range(start + p, start + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        want[d] = (len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
                   sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))
    cols = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in Q.queries()["op12_periodic_runs"](spark, SF).collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 5


def test_edges(spark):
    ship_package(spark)
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a " * 8), (4, "x y " * 5), (4, "x y " * 5), (5, "z " * 200_000), (6, "é é " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "n_words", "collapsed", "words", "n", "a")})
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 8, [(0, 8, 1)], "a"), (4, 10, [(0, 10, 2)], "x y"),
                                           (4, 10, [(0, 10, 2)], "x y"), (5, 200_000, [(0, 200_000, 1)], "z"), (6, 6, [(0, 6, 1)], "é é")], key=str)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    assert Q.with_planted_periods(docs).count() == len(rows)
