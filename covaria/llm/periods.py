"""Runs of periodically repeated words by matching aligned blocks.

A run of period q, at least max(24, 3 q) words long, holds a block of L words that begins at a multiple of L and occurs again q
words on, still within the run: for q from L to 2 L - 1, and with L = 8 for all q below 16. So the aligned blocks of each
power of two are put into an automaton over word numbers, the document is searched for them, and an occurrence at a distance
of that scale seeds an exact extension to both sides.

What needs no search is left out beforehand. A block occurs again within less than 2 L words only if each of its words
does; and where a shorter period p <= L reaches over a block and the 2 L words after it, a longer period there is a
multiple of p, and so no smallest one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from covaria.llm.common import split_words, with_arrays

#: Least length of a run in words, and least number of its periods.
LEAST, TIMES = 24, 3
#: The smallest block; it serves all periods below twice its length.
SMALLEST = 8
#: Words of a longer block that are its key; the extension is exact whatever the key.
KEY_WORDS = 1 << 14
#: Words of different keys that one automaton holds (at least one key).
AUTOMATON_WORDS = 1 << 18
FAR = np.int64(2**62)


def _seeds(codes: np.ndarray, blocks: np.ndarray, size: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and distance of all occurrences of the given blocks (their first places) at distances low to 2 size - 1."""
    import ahocorasick

    length = min(size, KEY_WORDS)
    places: dict[tuple[int, ...], list[int]] = {}
    for s in blocks.tolist():
        places.setdefault(tuple(codes[s : s + length].tolist()), []).append(s)
    keys, found = list(places), []
    for lo in range(0, len(keys), max(1, AUTOMATON_WORDS // length)):
        some = keys[lo : lo + max(1, AUTOMATON_WORDS // length)]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, key in enumerate(some):
            automaton.add_word(key, k)
        automaton.make_automaton()
        # blocks that lie near each other are searched in one stretch
        mine = np.array(sorted(s for key in some for s in places[key]))
        cut = np.flatnonzero(np.diff(mine) > 2 * size + length)
        hits = [
            (end + a - length + 1, k)
            for a, b in zip(mine[np.append(0, cut + 1)].tolist(), (mine[np.append(cut, len(mine) - 1)] + 2 * size + length).tolist(), strict=True)
            for end, k in automaton.iter(tuple(codes[a:b].tolist()))
        ]
        at, which = np.array(hits, dtype=np.int64).reshape(-1, 2).T
        order = np.lexsort((at, which))
        at, which = at[order], which[order]
        for k, key in enumerate(some):
            here = at[np.searchsorted(which, k) : np.searchsorted(which, k, side="right")]
            s = np.array(places[key])
            a, b = np.searchsorted(here, s + low), np.searchsorted(here, s + 2 * size)
            n = b - a
            first = np.repeat(s, n)
            found.append((first, here[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)] - first))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _extend(codes: np.ndarray, s: int, q: int) -> tuple[int, int]:
    """The longest stretch about s in which words q apart are equal, by steps that double until one differs."""
    n, a, step = len(codes), s, 16
    while a > 0:
        lo = max(0, a - step)
        differ = np.flatnonzero(codes[lo:a] != codes[lo + q : a + q])
        if len(differ):
            a = lo + int(differ[-1]) + 1
            break
        a, step = lo, step * 2
    b, step = s, 16  # word b + q is the next one to compare
    while b + q < n:
        hi = min(n - q, b + step)
        differ = np.flatnonzero(codes[b:hi] != codes[b + q : hi + q])
        if len(differ):
            b += int(differ[0])
            break
        b, step = hi, step * 2
    return a, b + q


class _Known:
    """Runs found so far, by period; runs of one period overlap by less than it, so their starts and ends rise together."""

    def __init__(self) -> None:
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, q: int, found: list[tuple[int, int]]) -> None:
        if q in self.by:  # a period belongs to one scale, whose seeds are all taken together
            raise ValueError("runs of a period come at once")
        self.by[q] = tuple(np.array(sorted(found)).T)

    def within(self, p: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words from a to before b lie in a run of period p."""
        starts, ends = self.by[p]
        at = np.searchsorted(starts, a, side="right") - 1
        return (at >= 0) & (ends[at] >= b)


def runs(codes: np.ndarray) -> np.ndarray:
    """All runs (start, length, smallest period) of a sequence of numbers, by start, then period."""
    n = len(codes)
    known, out = _Known(), []
    if n < LEAST:
        return np.empty((0, 3), dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, FAR)
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    size = SMALLEST
    widest = gap[: n // size * size].reshape(-1, size).max(axis=1)  # of each block the widest gap to a word's next place
    while size * TIMES <= n or size == SMALLEST:
        low = 1 if size == SMALLEST else size
        blocks = np.flatnonzero(widest < 2 * size) * size
        for p in known.by:
            if p <= size and len(blocks):
                blocks = blocks[~known.within(p, blocks, np.minimum(blocks + 3 * size, n))]
        if len(blocks):
            s, q = _seeds(codes, blocks, size, low)
            order = np.lexsort((s, q))
            s, q = s[order], q[order]
            length = min(size, KEY_WORDS)
            for period in np.unique(q).tolist():
                mine = s[np.searchsorted(q, period) : np.searchsorted(q, period, side="right")]
                for p in [p for p in known.by if period % p == 0]:
                    mine = mine[~known.within(p, mine, mine + length + period)]
                at, found = 0, []
                while at < len(mine):
                    a, b = _extend(codes, int(mine[at]), period)
                    if b - a >= max(LEAST, TIMES * period):
                        found.append((a, b))
                    at = max(at + 1, int(np.searchsorted(mine, b - period, side="left")))
                # a stretch that a shorter period has too is that one's run
                for p in [p for p in known.by if period % p == 0]:
                    found = [(a, b) for a, b in found if not known.within(p, np.array([a]), np.array([b]))[0]]
                if found:
                    known.add(period, found)
                    out += [(a, b - a, period) for a, b in found]
        size *= 2
        widest = widest[: len(widest) // 2 * 2].reshape(-1, 2).max(axis=1)
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)


def altered(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places from which the words of a document come that is made periodic; None for one that stays as it is.

    Of a document whose crc32 of the decimal id divides by 10, words from a = g mod n on repeat with period
    1 + (n - a) // (3 + g mod 8), where g is a tenth of the crc32. A null id stays as it is.
    """
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _sha(data) -> str:
    return hashlib.sha256(data).hexdigest()


def describe(words: pa.Array, codes: np.ndarray, order: np.ndarray | None) -> tuple:
    """n_runs; start, length, period and exponent_milli of the run with most periods; digests of all runs and of the words kept."""
    if order is not None:
        codes, words = codes[order], words.take(pa.array(order))
    found = runs(codes)
    keep = np.ones(len(codes), dtype=bool)
    for a, n, q in found.tolist():
        keep[a + q : a + n] = False
    words = words if keep.all() else words.filter(pa.array(keep))
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", pa.large_string()))[0]
    best = max(found.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *top, _sha("".join(f"{a},{n},{q}\n" for a, n, q in found.tolist()).encode()), _sha(kept.as_buffer())


COLUMNS = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", alter: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Add to every document its number of runs, the run with most periods, and digests of all runs and of the words kept.

    A run is a stretch of at least max(24, 3 q) words with smallest period q that no neighbouring word extends; words of
    a run after its first q are dropped. alter: first make the documents named by `altered` periodic, which plants runs.
    Of equal numbers of periods the least start, then the least period wins. A null text has no words; a document without
    runs has nulls for its run. All rows stay, repeated ones with equal results; an empty table stays empty. Other columns
    (or those in keep) stay whatever their names, but for earlier ones of the names added. A text is one task's work
    whatever its length.
    """

    def make():
        def compute(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
            words, counts = split_words(texts, lower=False)
            coded = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            ends = np.cumsum(counts)
            rows = []
            for i, doc_id in enumerate(ids.to_pylist()):
                a, b = ends[i] - counts[i], ends[i]
                rows.append(describe(words.slice(a, b - a), coded[a:b], altered(doc_id, int(b - a)) if alter else None))
            kinds = {"long": pa.int64(), "string": pa.string()}
            return [pa.array(v, kinds[k]) for v, k in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)]

        return compute

    return with_arrays(docs, (key, text), COLUMNS, make, keep=keep)


def summary(docs: DataFrame) -> DataFrame:
    """doc_id and the columns that `detect` adds, runs planted by id."""
    return detect(docs, alter=True, keep=["doc_id"])
