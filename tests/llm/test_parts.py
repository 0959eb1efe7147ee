"""The numpy parts of the operators, against plain versions."""

import random
import unicodedata

import numpy as np
import pytest

from noticegrid.llm import bpe, chunks, exact, minhash, quality, shingles, suffix, topk
from noticegrid.llm.queries import vocabulary_path


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(150):
        raw = "".join(rng.choice(rng.choice(["ab", "abc", "a", "abcdefgh"])) for _ in range(rng.randint(1, 150))).encode()
        t = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0)
        want = sorted(range(len(t)), key=lambda i: tuple(t[i:]))
        assert suffix.suffix_array(t, 257).tolist() == want
        assert suffix.suffix_array(t, 1000).tolist() == want
        order = want[1:]
        shared = suffix.common_prefixes(raw, np.array(order), 50)
        for a, b in zip(order, order[1:]):
            n = next((i for i in range(50) if raw[a + i:a + i + 1] != raw[b + i:b + i + 1]), 50)
            if max(a, b) + n < len(raw):
                assert shared[b] == n


def test_contexts_of_a_passage_that_repeats_a_gram_are_comparable():
    rng = random.Random(8)
    letters = lambda n: bytes(rng.choice(b"abcdefghijklmnop") for _ in range(n))
    hashed = lambda g: suffix.mixed((suffix._LETTERS[np.frombuffer(g, np.uint8)] * suffix.powers(16)[0]).sum(keepdims=True))[0]
    met = 0
    for _ in range(400):
        gram = min((letters(16) for _ in range(40)), key=hashed)  # often the least one of the passage
        passage = letters(rng.randint(0, 9)) + gram + letters(rng.randint(0, 18)) + gram + letters(rng.randint(0, 9))
        passage += letters(50 - len(passage))
        bodies, prints, of = [], [], []
        for doc in range(2):
            raw = letters(rng.randint(0, 60)) + passage + letters(rng.randint(0, 60))
            for key, first, stop, _ in zip(*suffix.contexts(raw), strict=True):
                bodies.append(raw[first:stop + suffix.LENGTH - 1])
                prints.append(key)
                of.append(doc)
        keep = suffix.comparable(bodies, np.array(prints, np.uint64))
        strings = [{b[i:i + 50] for i in range(len(b) - 49)} for b in bodies]
        shared = [any(of[j] != of[i] and strings[i] & strings[j] for j in range(len(bodies))) for i in range(len(bodies))]
        met += sum(shared)
        assert all(k for k, s in zip(keep, shared, strict=True) if s)
    assert met >= 800


def test_perfect_hash_is_minimal_and_foreign_digests_are_told_apart():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    levels, slots = exact.perfect_hash(digests)
    assert sorted(slots) == list(range(5000))
    assert (exact.slots_of(levels, digests) == slots).all()
    stored = digests[np.argsort(slots)]
    foreign = rng.integers(0, 256, (500, 32), dtype=np.uint8)
    at = exact.slots_of(levels, foreign)
    assert not any((stored[i] == f).all() for i, f in zip(at, foreign) if i >= 0)
    assert exact.perfect_hash(digests[:0])[0] == []


def test_bpe_is_the_librarys():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary_path()
    with open(path, "rb") as f:
        own = bpe.Vocabulary(f.read())
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(1)
    some = ["ab", "'s", "'LL", "<|endoftext|>", "Σ", "ΑΣ ", "İ", "é", "é", "12", "　", "\n", "<|", "!!", "日本", "​", "\x1c", "a" * 200, "xyzq" * 50, "🙂", "\x85"]
    texts = ["", *("".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(400))]
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_bpe_reads_every_code_point_as_the_library():
    """Between and before letters, before a digit, with itself, with marks of both classes, and alone."""
    tokenizers = pytest.importorskip("tokenizers")
    with open(vocabulary_path(), "rb") as f:
        own = bpe.Vocabulary(f.read())
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    strange = {c for c in points if own.strange(c)}
    for some in (sorted(strange), [c for c in points if c not in strange]):
        texts = [" ".join(f"a{c}b A{c}{c}\u0301 {c}1 o\u0345{c}\u0334 {c}" for c in some[i:i + 64]) for i in range(0, len(some), 64)]
        for i in range(0, len(texts), 256):
            want = [e.ids for e in library.encode_batch(texts[i:i + 256], add_special_tokens=False)]
            assert [x.tolist() for x in own.encode_many(texts[i:i + 256])] == want
    made = [unicodedata.normalize("NFD", c) for c in points]
    made = [m for m in made if len(m) > 1]
    assert [x.tolist() for x in own.encode_many(made)] == [library.encode(m, add_special_tokens=False).ids for m in made]


def test_cuts_resist_insertions_and_blocks():
    rng = random.Random(5)
    raw = bytes(rng.choice(b"abcdef ghij") for _ in range(9000))
    ends = chunks._ends(raw)
    assert ends[-1] == len(raw) and (np.diff(ends[:-1]) > chunks.REACH).all()
    moved = chunks._ends(raw[:300] + b"XYZ" + raw[300:])
    assert {e + 3 for e in ends.tolist() if e > 500} <= set(moved.tolist())
    block, chunks.BLOCK = chunks.BLOCK, 1024
    try:
        assert chunks._ends(raw).tolist() == ends.tolist()
    finally:
        chunks.BLOCK = block
    for n in (0, 1, 48, 49, 5000):
        found = chunks.cuts(np.full(n, 97, np.uint8))
        assert (found[-1] == n) if n else not len(found)


def test_shingles_of_long_texts_in_pieces():
    texts = [b"one two three", b"", b"alone", b"  a\tb\x0bc "]
    whole = [h for _, several in shingles.words(texts) for h in several]
    assert [len(h) for h in whole] == [3, 0, 1, 3]
    piece, shingles.PIECE = shingles.PIECE, 8
    try:
        cut = [h for _, several in shingles.words(texts) for h in several]
    finally:
        shingles.PIECE = piece
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert len(shingles.shingle_set(whole[2], 2)) == 1 and not len(shingles.shingle_set(whole[1], 2))


def test_isotonic_fit():
    got = quality.isotonic(np.arange(5), np.array([0.0, 0.6, 0.2, 0.9, 0.8]), np.array([1, 1, 1, 2, 2]))
    assert got.tolist() == pytest.approx([0, 0.4, 0.4, 0.85, 0.85])


def test_best_takes_first_of_equal_scores():
    assert sorted(topk.best(np.array([5, 7, 5, 5, 1]), 3)) == [0, 1, 2]
    big = np.array([[2**40, 3]])
    assert topk._product(big, big)[0, 0] == (big @ big.T)[0, 0]


def test_collections_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.unique(base[:3600]), np.unique(base[400:])
    got = minhash._collections([a, b])
    assert 0.25 < (got[0] == got[1]).mean() < 0.85


def test_names_are_ordered_with_long_repeats():
    """Many symbols, and stretches that come again up to the end."""
    rng = np.random.default_rng(3)
    for n, symbols, times in ((1, 300, 1), (300, 900, 1), (40, 500, 9), (7, 2, 60)):
        t = np.append(np.tile(rng.integers(1, symbols + 1, n), times), 0)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert suffix._order_names(t).tolist() == suffix.suffix_array(t, 1000).tolist() == want
