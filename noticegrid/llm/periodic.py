"""Runs of repeated words, by Lyndon roots (operator 12).

A run of ``times`` or more repetitions has a Lyndon root under one of the two orders of its words (one and
its reverse) that is the longest Lyndon word at its own place. The first phase of Baier's suffix sorter
gives the longest Lyndon word at every place, without sorting suffixes: places are grouped by the
prefix known so far, first their word; groups are taken from the highest to the lowest; each member is
appended to the nearest place before it that is in a lower group, and places that gained equally many
members of a group move to a new group just above their old one. When its turn comes, a group's prefix is
the longest Lyndon word of its members. Both orders are run; every root whose next repetition follows is
extended to both sides by longest common extensions. Roots are primitive, so the period is the smallest.

A word that occurs fewer than ``times`` times in a text is in no such run, so the text is cut there; each
stretch in between is taken whole. The result does not depend on this.

Null text counts as empty. The length of a text bounds the memory of one row, a text is not divided.
Rows repeating an id are judged each for itself; a null id is kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words a run has at least, and how often its period fits into it at least (three or more).
LEAST, TIMES = 6, 4

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_array(symbols: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place."""
    n = len(symbols)
    ranks = {c: g for g, c in enumerate(sorted(set(symbols)))}
    group = [ranks[c] for c in symbols]
    members: list[list[int]] = [[] for _ in ranks]
    for i, g in enumerate(group):
        members[g].append(i)
    size, below, above = [1] * len(ranks), list(range(-1, len(ranks) - 1)), list(range(1, len(ranks) + 1))
    above[-1:] = [-1] if ranks else []
    before = list(range(-1, n))
    longest = [0] * n
    g = len(ranks) - 1
    while g >= 0:
        length, gained = size[g], {}
        for i in members[g]:
            if group[i] != g:
                continue
            longest[i] = length
            p = before[i]
            before[i + length] = p
            if p >= 0:
                gained[p] = gained.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in gained.items():
            moved.setdefault((group[p], k), []).append(p)
        for old, k in sorted(moved, key=lambda x: -x[1]):
            new, top = len(size), above[old]
            size.append(size[old] + k * length)
            below.append(old)
            above.append(top)
            above[old] = new
            if top >= 0:
                below[top] = new
            members.append(moved[old, k])
            for p in moved[old, k]:
                group[p] = new
        members[g] = []
        g = below[g]
    return longest


def _common(s: list[int], i: int, j: int) -> int:
    """How far s from i and from j > i go on alike."""
    k, step, n = 0, 4, len(s)
    while j + k < n:
        step = min(step, n - j - k)
        if s[i + k:i + k + step] != s[j + k:j + k + step]:
            break
        k += step
        step *= 2
    else:
        return k
    while step > 1:
        step //= 2
        while s[i + k:i + k + step] == s[j + k:j + k + step] and j + k + step <= n:
            k += step
    return k


def runs_of(symbols: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``least`` symbols and ``times`` periods or more, in order."""
    if times < 3:
        raise ValueError("a root is sure to be followed by itself from three periods on")
    n, turned, found = len(symbols), symbols[::-1], set()
    top = max(symbols, default=0)
    for order in (symbols, [top - c for c in symbols]):
        reached: dict[int, int] = {}
        for i, p in enumerate(lyndon_array(order)):
            j = i + p
            if j + p > n or symbols[i] != symbols[j] or reached.get(p, 0) >= j + p:
                continue
            right = _common(symbols, i, j)
            if right < p:
                continue
            start = i - _common(turned, n - j, n - i)
            reached[p] = j + right
            length = j + right - start
            if length >= max(least, times * p):
                found.add((start, length, p))
    return sorted(found)


def find(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    codes = {w: k for k, (w, c) in enumerate(Counter(words).items()) if c >= times}
    if not codes:
        return []
    symbols = [codes.get(w, -1) for w in words]
    inside = np.concatenate([[False], np.array(symbols) >= 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return [(a + start, length, p) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= max(least, times)
            for start, length, p in runs_of(symbols[a:b], least, times)]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, p in runs:
        kept[start + p:start + length] = False
    return list(compress(words, kept.tolist()))


def _found(least: int, times: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, runs, offsets, texts = [], [], [0], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                here = find(words, least, times)
                numbers.append(len(words))
                runs += here
                offsets.append(len(runs))
                texts.append(b" ".join(collapse(words, here)))
            flat = pa.StructArray.from_arrays([pa.array([r[k] for r in runs], pa.int64()) for k in range(3)], fields=list(_RUN))
            yield pa.record_batch({
                "doc_id": batch.column(0), "n_words": pa.array(numbers, pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    return rows


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document its word count, its runs by start and period, and its words less the repetitions, joined by blanks."""
    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(_found(least, times), RUNS)
