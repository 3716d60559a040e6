"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch are one flat array of symbols with the place where each sequence begins. In a round every
sequence applies the pair of its lowest rank, all of them at once; the array is closed up and only the pairs beside a merged
symbol are looked up again. What survives when no pair has a rank is counted: a symbol of no piece as its bytes.

The model merges any two neighbours whose text is a piece, best score first and leftmost among equals, so a merge can make a
pair that comes before the other occurrences of its own rank. Ranks for which that can happen are known from the
vocabulary; of these a sequence applies the leftmost occurrence only, which keeps the order of the model's own merges.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from covaria.llm.common import with_arrays
from covaria.llm.pieces import SPACE, model_path

#: Rank of a pair that can't be merged.
NONE = np.int32(2**31 - 1)
#: Bytes of distinct pre-tokens that are merged at once.
MERGE_BYTES = 1 << 19
#: Symbols from which on a pre-token is merged on its own, from a heap: a round over it would cost its whole length.
LONG = 1024
#: Pre-tokens whose counts a task remembers; when full, it forgets all.
KEPT = 500_000
#: Tokens above which a document is over the limit.
LIMIT = 4096


class Merges:
    """A model's merges as arrays; counts the tokens of pre-tokens and of texts."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        if any(sp.is_unused(i) for i in ids) or sp.piece_to_id("<0x00>") == sp.unk_id():
            raise ValueError("only models with byte pieces and without unused pieces are read")
        if sp.normalize(" a  Béﬁ ") != SPACE * 2 + f"a{SPACE * 2}Béﬁ{SPACE}" or any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("only models that keep a text as it is, and whose pieces don't cross words, are read")
        # a symbol is a piece or a character that occurs in pieces; the last number stands for all other characters
        symbols = [*pieces, *sorted({c for p in pieces for c in p} - pieces.keys())]
        number = {s: i for i, s in enumerate(symbols)}
        self.many = len(symbols) + 1
        self.symbol = np.full(0x110000, self.many - 1, dtype=np.int32)
        single = [s for s in symbols if len(s) == 1]
        self.symbol[[ord(s) for s in single]] = [number[s] for s in single]
        points = np.arange(0x110000)
        self.weight = (1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)).astype(np.int8)
        self.weight[[ord(s) for s in single if s in pieces]] = 1
        # ranks are the places of scores from the best on; equal scores share one
        place = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = sorted((number[p[:k]] * self.many + number[p[k:]], place[pieces[p]], number[p]) for p in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        # two sentinels, so that a place found is always one
        self.keys = np.array([-1, *[k for k, _, _ in pairs], 2**62], dtype=np.int64)
        self.ranks = np.array([NONE, *[r for _, r, _ in pairs], NONE], dtype=np.int32)
        self.made = np.array([0, *[m for _, _, m in pairs], 0], dtype=np.int32)
        # the best rank of a pair with this symbol in it; a rank is alone if merging it can make a pair that isn't after it
        best = np.full(self.many, NONE, dtype=np.int32)
        for side in (self.keys[1:-1] // self.many, self.keys[1:-1] % self.many):
            np.minimum.at(best, side, self.ranks[1:-1])
        self.alone = np.zeros(len(place) + 1, dtype=bool)
        self.alone[self.ranks[1:-1][best[self.made[1:-1]] <= self.ranks[1:-1]]] = True
        self.counts: dict[str, int] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair."""
        key = left.astype(np.int64) * self.many + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def merge(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of code points (sizes: their lengths, one at least)."""
        sym, weight = self.symbol[points], self.weight[points]
        seq = np.repeat(np.arange(len(sizes)), sizes)
        rank, made = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
        at = np.flatnonzero(seq[1:] == seq[:-1])
        rank[at], made[at] = self.pair(sym[at], sym[at + 1])
        out = np.zeros(len(sizes), dtype=np.int64)
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            low = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(sym)))
            done = low == NONE
            if done.any():
                ended = np.repeat(done, span)
                out += np.bincount(seq[ended], weight[ended], minlength=len(out)).astype(np.int64)
                sym, weight, seq, rank, made = (x[~ended] for x in (sym, weight, seq, rank, made))
                low, span = low[~done], span[~done]
                if not len(sym):
                    break
            low = np.repeat(low, span)
            hit = np.flatnonzero(rank == low)
            new = np.concatenate(([True], seq[hit[1:]] != seq[hit[:-1]]))
            # of occurrences that overlap every second one counts, from the left
            begins = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1)))
            nth = np.arange(len(hit)) - np.repeat(begins, np.diff(np.append(begins, len(hit))))
            hit = hit[np.where(self.alone[low[hit]], new, nth % 2 == 0)]
            sym[hit], weight[hit] = made[hit], 1
            stays = np.ones(len(sym), dtype=bool)
            stays[hit + 1] = False
            moved = hit - np.arange(len(hit))  # each earlier merge has taken one place away
            sym, weight, seq, rank, made = (x[stays] for x in (sym, weight, seq, rank, made))
            beside = np.zeros(len(sym), dtype=bool)
            beside[moved] = beside[moved[moved > 0] - 1] = True
            near = np.flatnonzero(beside)
            inside = np.append(seq[1:] == seq[:-1], False)[near]
            rank[near] = NONE
            at = near[inside]
            rank[at], made[at] = self.pair(sym[at], sym[at + 1])
        return out

    def merge_long(self, points: np.ndarray) -> int:
        """Tokens of one long sequence: the same merges in the same order, from a heap of (rank, place)."""
        sym, weight = self.symbol[points].tolist(), self.weight[points].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, made = self.pair(self.symbol[points[:-1]], self.symbol[points[1:]])
        rank, target = [*ranks.tolist(), int(NONE)], [*made.tolist(), 0]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        table: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            gone = after[i]
            sym[i], weight[i], weight[gone], rank[gone] = target[i], 1, 0, int(NONE)
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j < 0:
                    continue
                rank[j] = int(NONE)
                if (k := after[j]) < n:
                    key = sym[j], sym[k]
                    if key not in table:
                        found = self.pair(np.array(key[:1]), np.array(key[1:]))
                        table[key] = int(found[0][0]), int(found[1][0])
                    rank[j], target[j] = table[key]
                    if rank[j] != NONE:
                        heapq.heappush(heap, (rank[j], j))
        return sum(weight)

    def of_words(self, words: pa.LargeStringArray) -> np.ndarray:
        """Tokens of distinct pre-tokens."""
        points = np.frombuffer(_bytes(words).tobytes().decode().replace(" ", SPACE).encode("utf-32-le"), dtype="<u4")
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        out = np.zeros(len(words), dtype=np.int64)
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self.merge_long(points[ends[i] - sizes[i] : ends[i]])
        short = sizes <= LONG
        out[short] = self.merge(points[np.repeat(short, sizes)], sizes[short])
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null or empty one has none."""
        pre, counts = pre_tokens(texts)
        coded = pre.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        names = words.to_pylist()
        known = np.fromiter((self.counts.get(w, -1) for w in names), dtype=np.int64, count=len(words))
        new = np.flatnonzero(known < 0)
        size = np.cumsum(pc.binary_length(words).to_numpy()[new])
        at = 0
        while at < len(new):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + MERGE_BYTES, side="right")))
            known[new[at:to]] = self.of_words(words.take(pa.array(new[at:to])))
            at = to
        # pre-tokens that a batch has once, or that are long, seldom come again
        again = [i for i in new[np.bincount(code, minlength=len(words))[new] > 1].tolist() if len(names[i]) < 64]
        if len(self.counts) + len(again) > KEPT:
            self.counts.clear()
        self.counts.update((names[i], int(known[i])) for i in again)
        total = np.concatenate(([0], np.cumsum(known[code])))
        ends = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(total[ends])


def _bytes(texts: pa.LargeStringArray) -> np.ndarray:
    """UTF-8 bytes of all texts, end to end."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.empty(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]


def pre_tokens(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Pre-tokens of texts in one flat array and their number in each text: a word and the spaces before it, spaces at a
    line's end, or a line break; no piece crosses these. The text's own U+2581 are spaces, and one space is put first."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    lens = pc.binary_length(texts).to_numpy()
    raw = _bytes(texts)
    first = (np.cumsum(lens) - lens)[lens > 0]
    space, line = raw == 32, raw == 10
    begins = line.copy()
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    begins[first] = True
    at = np.flatnonzero(begins)
    offsets = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
    text_of = np.searchsorted(first, at, side="right") - 1
    counts = np.zeros(len(lens), dtype=np.int64)
    counts[lens > 0] = np.bincount(text_of, minlength=len(first))
    return pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(raw)), counts


#: The merges that a worker has read, by their model's hash.
_READ: dict[int, Merges] = {}


def _merges(model: bytes) -> Merges:
    if hash(model) not in _READ:
        _READ.clear()
        _READ[hash(model)] = Merges(model)
    return _READ[hash(model)]


def count(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = LIMIT, keep: Sequence[str] | None = None) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    path: a SentencePiece BPE model with byte pieces that keeps texts as they are, read on the driver and broadcast (its size
    doesn't grow with the data). Counts are those of the library's encoding, without added tokens; strings of special tokens
    in a text are ordinary text. A null text counts as empty, with no tokens. All rows stay, repeated ones with equal counts;
    an empty table stays empty. Other columns (or those in keep) stay whatever their names, but for earlier ones of these three.
    """
    with open(model_path(path), "rb") as f:  # on the driver
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        merges = _merges(sent.value)
        merges.counts.clear()  # of an earlier task

        def compute(texts: pa.Array) -> list[pa.Array]:
            found = merges.count(texts)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            return [n_bytes, pa.array(found), pa.array(found > limit)]

        return compute

    return with_arrays(docs, (text,), {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, make, keep=keep)


def summary(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    return count(docs, path, keep=["doc_id"])
