"""Plain single-process versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shingles(text: str | None, width: int) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def similar_groups(docs: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    pairs = Counter()
    for ids in holders.values():
        order = sorted(ids)
        for n, a in enumerate(order):
            for b in order[n + 1:]:
                pairs[a, b] += 1
    for (a, b), both in pairs.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_earlier(docs: list[tuple[int, str | None]], length: int) -> dict[int, tuple]:
    first: dict[bytes, tuple[int, int]] = {}
    bodies = {i: (t or "").encode() for i, t in sorted(docs)}
    out = {}
    for i, body in bodies.items():
        gone = bytearray(len(body))
        for at in range(len(body) - length + 1):
            key = body[at:at + length]
            if key in first:
                gone[at:at + length] = b"\1" * length
            else:
                first[key] = (i, at)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[i] = (len(body), sum(gone), runs, sha(kept))
    return out


def without_repeated(docs: list[tuple[int, str | None]], width: int) -> dict[int, tuple]:
    words = {i: WORD.findall(t or "") for i, t in docs}
    counts = Counter(tuple(w[a:a + width]) for w in words.values() for a in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if counts[tuple(w[a:a + width])] > 1:
                gone[a:a + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), sha(" ".join(kept).encode()))
    return out


def signals(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit))
