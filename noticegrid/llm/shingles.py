"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 2**64)
_LETTERS = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + 4096)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]).cumprod() for x in (_ODD, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * up)])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at white space."""
    at = 0
    while len(raw) - at > PIECE:
        cut = _SPACE.search(raw, at + PIECE)
        stop = cut.start() if cut else len(raw)
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def words(texts: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For stretches of ``texts`` that fit a piece: the place of the first, and each text's word hashes."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < PIECE):
            size += len(texts[stop]) + 1
            stop += 1
        if stop == at + 1:
            yield at, [np.concatenate([_word_hashes(np.frombuffer(p, np.uint8))[0] for p in _pieces(texts[at])])]
        else:
            hashes, start = _word_hashes(np.frombuffer(b"\n".join(texts[at:stop]), np.uint8))
            ends = np.cumsum([len(t) + 1 for t in texts[at:stop]])
            yield at, np.split(hashes, np.searchsorted(start, ends[:-1]))
        at = stop


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles in order; a shorter text is one shingle, one without words has none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    total = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total * np.uint64(_ODD) + hashes[i: len(hashes) - k + 1 + i])
    return np.unique(total)
