"""Plain versions of the operators over a list of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def repeats(docs, length=50):
    raws = sorted(((d, (t or "").encode()) for d, t in docs), key=lambda r: r[0])
    owner = {}
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            owner.setdefault(raw[i:i + length], d)
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if owner[raw[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def shingles(text, n):
    words = WORD.findall((text or "").encode().lower())
    k = min(n, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def near(docs, n, percent=80):
    sets = {d: shingles(t, n) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for o, k in Counter(o for x in s for o in holders[x] if o > d).items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def lines(docs, ratio=0.1, least=3):
    """docs: (doc_id, source, text); the text of each without boilerplate."""
    total, pages = Counter(s for _, s, _ in docs), Counter()
    for _, s, t in docs:
        pages.update((s, x) for x in {x.strip(" \t\r\f\v") for x in (t or "").split("\n")} if x)
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    return {d: "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r\f\v")) not in bad) if t is not None else None for d, s, t in docs}
