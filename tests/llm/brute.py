"""Plain versions of what the operators must give, row by row in Python."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(LOWER)


def held(doc_id, modulus):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == 2


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mix_targets(sizes, weights=(5, 2, 1)):
    """sizes: total words by source. Excess over twice a source's size is shared among the others by weight, again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, left, out = 1.5 * sum(sizes.values()), set(order), {}
    while left:
        level = total / sum(w[s] for s in left)
        over = [s for s in left if w[s] * level > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: w[s] * level for s in left}
        for s in over:
            out[s] = 2 * sizes[s]
            total -= out[s]
            left.discard(s)
    return out


ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def simhash(text):
    import xxhash

    w = words(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(prints, distance=4):
    """prints: (doc_id, fingerprint) pairs; the least doc_id reachable from each."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(prints)}


def quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    marked = {i + k for i, g in enumerate(grams) if g in many for k in range(8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked)


def jaccard(a, b):
    from collections import Counter

    a, b = Counter(words(lower(a))), Counter(words(lower(b)))
    both = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in both) / max(1, sum(max(a[k], b[k]) for k in both)) if both else 1.0
