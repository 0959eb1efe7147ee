"""BPE encoding and decoding with a public word-level vocabulary (operator 2).

A text is cut at special strings, normalised (NFC, white space to one space, lower case),
split into pieces (contractions, letter runs, single digits, runs of the rest), and every piece is
merged as a contiguous array: the boundaries of its parts and, beside each, the rank of the merge
with the next part. The array is scanned for the least rank (the first of equals), the boundary
between the two parts is deleted, and the ranks to its left and right are looked up again. Pieces
of one length are merged together, as the rows of one array. Pieces of more than ``SHORT``
symbols keep the same boundaries and ranks in a heap, with the same result in n log n. Results
of recent words are remembered, up to ``REMEMBERED`` per worker.

What is a letter, a number, a lower case or a composed form follows the Unicode version of the library the vocabulary
is for. Where it differs from Python's, or Python does not know a code point, the library normalises and splits
the text, and only merging is done here; the code points concerned are found once per application, by asking both about all.

Decoding joins the strings of the ids by one space, as the vocabulary defines no other decoder.
Null text counts as empty and has no ids; rows are encoded one by one, so repeated rows repeat;
extra columns are ignored. The vocabulary file's path is a parameter; its content (1.7 MB) is
sent to the workers once.
"""

from __future__ import annotations

import gc
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, cached_property, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

SHORT, REMEMBERED, SLICE = 64, 150_000, 512
#: Separators in Python that are none for the vocabulary.
CONTROLS = "\x1c\x1d\x1e\x1f"
#: Fixed values of the vocabulary's normaliser and splitter.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = rf"[{SPACES}]"
LIBRARY_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _runs(pattern: str, text: str) -> np.ndarray:
    """Which characters of a text the library's pattern of one class takes."""
    from tokenizers import Regex, pre_tokenizers

    out = np.zeros(len(text), bool)
    for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
        out[a:b] = True
    return out


@cache
def differing() -> str:
    """The code points that Python knows, but reads otherwise than the library."""
    from tokenizers import normalizers

    known = [c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) != "Cn" and c != "\n"]
    text = "".join(known)
    letters, numbers = _runs(r"[\p{L}]+", text), _runs(r"[\p{N}]+", text)
    own_letters, own_numbers = (np.fromiter((c is not None for c in map(regex.compile(p).match, known)), bool, len(known)) for p in (r"\p{L}", r"\p{N}"))
    odd = (letters != own_letters) | (numbers != own_numbers) | (letters != np.fromiter(map(str.isalpha, known), bool, len(known)))
    def unlike(normaliser, own: Callable[[str], str], probes: list[str]) -> np.ndarray:
        theirs = normaliser.normalize_str("\n".join(probes)).split("\n")
        return np.fromiter((a != own(p) for a, p in zip(theirs, probes, strict=True)), bool, len(probes))

    nfc, composed = normalizers.NFC(), partial(unicodedata.normalize, "NFC")
    odd |= unlike(normalizers.Lowercase(), str.lower, known) | unlike(nfc, composed, known)
    # Marks change places by their class, so each is also tried behind a mark of a high class and before one of a low.
    odd |= unlike(nfc, composed, ["\u0345" + c for c in known]) | unlike(nfc, composed, [c + "\u0334" for c in known])
    # What a code point is made of may be put together by one and not by the other.
    parts = [unicodedata.normalize("NFD", c) for c in known if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<")]
    apart = {c for p, u in zip(parts, unlike(nfc, composed, parts), strict=True) if u for c in p}
    return "".join(c for c, o in zip(known, odd, strict=True) if o or c in apart)


class Vocabulary:
    def __init__(self, content: bytes, odd: str | None = None):
        self.odd = frozenset(differing() if odd is None else odd)
        #: Code points that Python and the library read alike, as far as met.
        self.alike: set[str] = set()
        spec = json.loads(content)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        merges = [(self.ids[a] << 32 | self.ids[b], self.ids[a + b]) for a, b in pairs]
        #: A pair of ids as one number to the rank of their merge; what the merge of a rank makes.
        self.ranks: dict[int, int] = {pair: rank for rank, (pair, _) in enumerate(merges)}
        self.none = len(merges)
        self.made = np.array([*(m for _, m in merges), 0], np.int64)
        self.order = np.argsort(np.array([p for p, _ in merges], np.int64))
        self.pairs = np.array([p for p, _ in merges], np.int64)[self.order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = np.array([""] * (max([*self.ids.values(), *self.special.values()]) + 1), object)
        for s, i in chain(self.ids.items(), self.special.items()):
            self.strings[i] = s
        letters = byte_letters()
        #: The symbol of each byte inside a piece and at its end.
        self.inner, self.last = [self.ids.get(x) for x in letters], [self.ids.get(x + self.end) for x in letters]
        self.complete = None not in self.inner + self.last
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.white, self.pieces = regex.compile(WHITE + "+"), regex.compile(PIECES).findall
        #: Words, and ids of special strings, to their ids as 32-bit numbers, which take little room.
        self.words: dict[str | int, bytes] = {}

    def strange(self, text: str) -> bool:
        """Whether some code point is not read alike by Python and the library."""
        if text.isascii():
            return False
        fresh = set(text).difference(self.alike)
        if any(c in self.odd or unicodedata.category(c) == "Cn" for c in fresh):
            return True
        self.alike |= fresh
        return False

    @cached_property
    def library(self):
        """The library's normaliser and splitter, without its merging."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        normaliser = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        return normaliser.normalize_str, pre_tokenizers.Split(Regex(LIBRARY_PIECES), "removed", invert=True).pre_tokenize_str

    def cut_word(self, word: str) -> list[str]:
        return [p for p, _ in self.library[1](word)] if self.strange(word) else self.pieces(word)

    def stretches(self, text: str) -> list[str | int]:
        """The normalised text's stretches without space, and the ids of special strings."""
        out: list[str | int] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part and self.strange(part):
                out += [x for x in self.library[0](part).split(" ") if x]
            elif part:
                # A capital sigma is lower-cased alike everywhere here, unlike in Python.
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [x for x in self.white.split(plain) if x] if any(c in plain for c in CONTROLS) else plain.split()
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.stretches(t) for t in texts]
        words = self.words
        fresh = set(chain.from_iterable(split)).difference(words)
        if len(words) + len(fresh) > REMEMBERED:
            words.clear()
            fresh = set(chain.from_iterable(split))
        plain = [w for w in fresh if w.__class__ is str and w.isalpha() and not self.strange(w)]
        pieces = {w: self.cut_word(w) for w in fresh.difference(plain) if w.__class__ is str}
        merged = self.merge_many({*plain, *chain.from_iterable(pieces.values())})
        words.update((w, _packed([w])) for w in self.special.values())
        words.update((w, merged[w]) for w in plain)
        words.update((w, b"".join(map(merged.__getitem__, ps))) for w, ps in pieces.items())
        return [np.frombuffer(b"".join(map(words.__getitem__, one)), np.int32) for one in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode()
        found = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        return found if self.complete else [x for x in found if x is not None]

    def merge_many(self, pieces: set[str]) -> dict[str, bytes]:
        by_length: dict[int, list[str]] = {}
        symbols = {p: self.symbols(p) for p in pieces}
        for p, one in symbols.items():
            by_length.setdefault(len(one), []).append(p)
        out = {}
        for n, some in by_length.items():
            rows = [symbols[p] for p in some]
            out.update(zip(some, map(_packed, rows if n < 2 else map(self.merged_long, rows)) if n < 2 or n > SHORT else self.merged(np.array(rows)), strict=True))
        return out

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), self.none - 1)
        return np.where(self.pairs[at] == pair, self.order[at], self.none)

    def merged(self, parts: np.ndarray) -> list[bytes]:
        """Rows of symbols, all of one length, each merged to the end."""
        k, n = parts.shape
        out = [b""] * k
        which, ranks = np.arange(k), self.rank(parts[:, :-1], parts[:, 1:])
        while len(which):
            n = parts.shape[1]
            at = ranks.argmin(axis=1) if n > 1 else np.zeros(len(which), int)
            least = ranks[np.arange(len(which)), at] if n > 1 else np.full(len(which), self.none)
            ended = least == self.none
            for i, row in zip(which[ended].tolist(), parts[ended].astype(np.int32), strict=True):
                out[i] = row.tobytes()
            which, parts, ranks, at, least = (x[~ended] for x in (which, parts, ranks, at, least))
            row = np.arange(len(which))
            # Delete boundary at + 1: what lies right of it moves one place to the left.
            columns = np.arange(n - 1)
            parts = np.where(columns <= at[:, None], parts[:, :-1], parts[:, 1:])
            parts[row, at] = self.made[least]
            ranks = np.where(columns[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:]) if n > 2 else ranks[:, :0]
            some = np.flatnonzero(at < n - 2)
            ranks[some, at[some]] = self.rank(parts[some, at[some]], parts[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank(parts[some, at[some] - 1], parts[some, at[some]])
        return out

    def merged_long(self, parts: list[int]) -> list[int]:
        """The same for a long piece: boundaries as links, ranks in a heap, stale entries passed over."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int]] = []
        rank = lambda i: self.ranks.get(parts[i] << 32 | parts[after[i]]) if 0 <= i and after[i] < len(parts) else None

        def offer(i: int) -> None:
            if (r := rank(i)) is not None:
                heapq.heappush(heap, (r, i))

        for i in range(len(parts)):
            offer(i)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            parts[i], parts[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.strings[ids])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def load(spark: SparkSession, path: str) -> Callable[[], Vocabulary]:
    """A way for workers to get the vocabulary.

    It is made anew for each task, in a quarter of a second, and goes with it: kept in idle workers it and what
    it remembers took a third of an executor's memory from the stages that follow.
    """
    with open(path, "rb") as file:
        content = spark.sparkContext.broadcast((file.read(), differing()))
    return lambda: Vocabulary(*content.value)


@contextmanager
def _without_collection() -> Iterator[None]:
    """What a worker remembers is many small objects without cycles; other stages of the worker go on as before."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with _without_collection():
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield batch.slice(at, SLICE)


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))


def encode(docs: DataFrame, vocabulary: Callable[[], Vocabulary]) -> DataFrame:
    """doc_id and ids, the token ids of each whole text."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = vocabulary()
        for part in _slices(batches):
            rows = code.encode_many([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _id_lists(rows)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Callable[[], Vocabulary]) -> DataFrame:
    """doc_id, ids and decoded, the text that the ids stand for."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = vocabulary()
        for part in _slices(batches):
            ids = part.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            texts = [code.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary: Callable[[], Vocabulary]) -> DataFrame:
    """doc_id, ids and decoded: ``decode`` of ``encode`` by one worker, so the ids do not change hands."""
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = vocabulary()
        for part in _slices(batches):
            rows = code.encode_many([t or "" for t in part.column("text").to_pylist()])
            texts = pa.array(map(code.decode, rows), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _id_lists(rows), texts], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(both, "doc_id long, ids array<int>, decoded string")
