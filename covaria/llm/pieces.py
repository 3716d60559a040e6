"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words are laid end to end and their suffixes sorted to the depth of the longest piece. A binary search
of every piece gives the range of suffixes that begin with it, so all its occurrences. These are edges from place to
place; sorted by position, they are relaxed from left to right.

The model merges pairs by score (BPE). Its encoding of a prefix ends with one certain piece, and a further piece follows
that one exactly where the two, encoded together, stay the two. So an edge relaxes its end if it may follow the piece
that ends at its start, and the path found is the encoding itself, not merely one of the highest sum.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.llm.common import mix64, quoted, unused, with_arrays

U64 = np.uint64
SPACE = "▁"
#: Characters to which suffixes are sorted; no piece is longer.
DEPTH = 16
#: Words whose encodings a task remembers (when full, it forgets all), and places for pairs of pieces.
WORDS_KEPT, PAIRS_KEPT = 300_000, 1 << 20
#: Code points of distinct words that are indexed at once.
INDEX_CHARS = 1 << 18
# A word and the spaces before it, spaces at a line's end, or a line break; no piece crosses these.
SPLIT = re.compile(r" *[^ \n]+| +|\n")


def model_path(path: str | None = None) -> str:
    """The path given, or else COVARIA_PIECES of the environment, or else the installed public model's."""
    if path or (path := os.environ.get("COVARIA_PIECES")):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _four(codes: np.ndarray) -> np.ndarray:
    """Keys of each four codes of a row, in their order."""
    shifts = U64(48), U64(32), U64(16), U64(0)
    return sum(codes[:, k::4] << s for k, s in enumerate(shifts)).astype(U64)


class Pieces:
    """A model's pieces, indexed for matching; encodes lists of words and decodes ids."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        many = sp.vocab_size()
        kinds = [(sp.is_control(i) or sp.is_unknown(i), sp.is_byte(i)) for i in range(many)]
        self.text = [sp.id_to_piece(i) for i in range(many)]
        plain = [i for i, k in enumerate(kinds) if not any(k)]
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if not all(kinds[i][1] for i in self.byte_id):
            raise ValueError("the model has no byte pieces")
        if any(sp.is_unused(i) for i in plain) or sp.normalize(" a  Béﬁ ") != SPACE * 2 + f"a{SPACE * 2}Béﬁ{SPACE}":
            raise ValueError("only models that keep a text as it is, with one space before it, are read")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces cross words")
        # code points by rank, 0 for those in no piece
        letters = sorted({c for p in self.score for c in p})
        if len(letters) >= 1 << 16:
            raise ValueError("more than 65,535 different characters in pieces")
        self.rank = np.zeros(0x110000, dtype=np.uint64)
        self.rank[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        if max(map(len, self.score)) > DEPTH:
            raise ValueError(f"pieces of more than {DEPTH} characters")
        self.ids = np.array(plain, dtype=np.int32)
        self.lens = np.array([len(self.text[i]) for i in plain])
        codes = np.zeros((len(plain), DEPTH), dtype=np.uint64)
        for row, i in enumerate(plain):
            codes[row, : self.lens[row]] = self.rank[[ord(c) for c in self.text[i]]]
        self.low = _four(codes)
        self.high = _four(np.where(np.arange(DEPTH) < self.lens[:, None], codes, U64(0xFFFF)))
        raw = [b"" if k[0] else bytes([int(t[3:5], 16)]) if k[1] else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kinds, strict=True)]
        self.raw = pa.array(raw, pa.large_binary())
        self.pair_keys = np.full(PAIRS_KEPT, -1, dtype=np.int64)
        self.pair_ok = np.zeros(PAIRS_KEPT, dtype=bool)
        self.words: dict[str, bytes] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether the text of a and b encodes to just these two; a = -1 asks it of b alone."""
        left = [] if a < 0 else list(self.text[a])
        parts = left + list(self.text[b])
        edge = len(left)  # parts before it belong to a
        while len(parts) > 1 + (a >= 0) or edge > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None or at == edge - 1:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            edge -= at < edge
        return len(parts) < 2 or parts[0] + parts[1] not in self.score

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of all pieces' occurrences; a code of no piece is an edge of its own, with id -1.

        Suffixes are sorted by 4, 8 and 16 characters, by doubling: ranks of two halves make the key of the whole.
        """
        n = len(codes)
        padded = np.concatenate((codes, np.zeros(DEPTH, dtype=U64)))
        key = _four(np.lib.stride_tricks.sliding_window_view(padded, 4))[:, 0]
        found = []
        low, high = self.low, self.high  # of each 4 characters, then of 8, then of 16
        for size in (4, 8, 16):
            order = np.argsort(key)
            ranked = key[order]
            mine = np.flatnonzero((self.lens <= size) & (self.lens > size // 2) | (self.lens <= 4) & (size == 4))
            lo, hi = np.searchsorted(ranked, low[mine, 0], "left"), np.searchsorted(ranked, high[mine, 0], "right")
            counts = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(mine)), counts)
            at = order[np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + lo[which]]
            found.append((at, self.lens[mine][which], self.ids[mine][which]))
            if size == DEPTH:
                break
            place = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
            rank = np.empty(len(key), dtype=U64)
            rank[order] = place
            distinct = ranked[np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))]
            # a half with no occurrence gets an empty range
            a, b = np.searchsorted(distinct, low, "left"), np.searchsorted(distinct, high, "right")
            empty = (b <= a)[:, ::2] | (b <= a)[:, 1::2]
            low = (a[:, ::2].astype(U64) << U64(32)) | a[:, 1::2].astype(U64)
            high = ((b[:, ::2] - 1).clip(0).astype(U64) << U64(32)) | (b[:, 1::2] - 1).clip(0).astype(U64)
            low, high = np.where(empty, U64(2**64 - 1), low), np.where(empty, U64(0), high)
            key = (rank << U64(32)) | np.concatenate((rank[size:], np.zeros(size, dtype=U64)))
        none = np.flatnonzero(codes == 0)
        found.append((none, np.ones(len(none), dtype=np.int64), np.full(len(none), -1, dtype=np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """follows() of many pairs; answers are kept in a table of fixed size, where a new pair displaces an old one."""
        key = (before.astype(np.int64) + 1) << 32 | piece.astype(np.int64)
        at = (mix64(key.view(U64)) % U64(PAIRS_KEPT)).astype(np.int64)
        ok = self.pair_ok[at]
        new = np.flatnonzero(self.pair_keys[at] != key)
        if len(new):
            asked, back = np.unique(key[new], return_inverse=True)
            told = np.fromiter((self.follows((k >> 32) - 1, k & 0xFFFFFFFF) for k in asked.tolist()), dtype=bool, count=len(asked))
            place = (mix64(asked.view(U64)) % U64(PAIRS_KEPT)).astype(np.int64)
            self.pair_keys[place], self.pair_ok[place] = asked, told
            # of several new pairs with one place the last was kept, so their answers must be the kept one's too
            lost = self.pair_keys[place] != asked
            self.pair_ok[place[~lost]] = told[~lost]
            ok[new] = told[back]
        return ok

    def _index(self, words: list[str]) -> list[bytes]:
        """Encodings (32-bit ids as bytes) of distinct words, spaces as U+2581."""
        points = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        codes = self.rank[points]
        codes[ends] = 0  # between words
        start, length, ids = self.edges(codes)
        inside = np.ones(len(points), dtype=bool)
        inside[ends] = False
        keep = inside[start]
        start, length, ids = start[keep], length[keep], ids[keep]
        # edges by their place in the word; those of one place, over all words, are relaxed together
        offset = start - starts[np.searchsorted(starts, start, side="right") - 1]
        order = np.argsort(offset, kind="stable")
        start, end, ids = start[order], (start + length)[order], ids[order]
        last, back = np.full(len(points), -2, dtype=np.int32), np.zeros(len(points), dtype=np.int64)
        last[starts] = -1
        bounds = np.searchsorted(offset[order], np.arange(offset.max(initial=-1) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, e, t = start[a:b], end[a:b], ids[a:b]
            open_ = np.flatnonzero(last[e] == -2)
            s, e, t = s[open_], e[open_], t[open_]
            ok = t < 0  # a character of no piece stands alone beside anything
            some = np.flatnonzero(~ok & (last[s] > -2))
            ok[some] = self._follow(last[s[some]], t[some])
            last[e[ok]], back[e[ok]] = t[ok], s[ok]
        # back from all ends at once
        at, who, steps = ends, np.arange(len(words)), []
        while len(at):
            s = back[at]
            steps.append((who, last[at], points[s]))
            more = s > starts[who]
            at, who = s[more], who[more]
        out: list[bytes] = [b""] * len(words)
        if steps:
            who, piece, point = (np.concatenate([x[k] for x in reversed(steps)]) for k in range(3))
            order = np.argsort(who, kind="stable")
            who, piece, point = who[order], piece[order], point[order]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(words))))).tolist()
            odd = set(who[piece < 0].tolist())
            raw = piece.astype(np.int32).tobytes()
            for i in range(len(words)):
                out[i] = raw[4 * cuts[i] : 4 * cuts[i + 1]]
            for i in odd:
                each = [[t] if t >= 0 else self.byte_id[list(chr(c).encode())].tolist() for t, c in zip(piece[cuts[i] : cuts[i + 1]].tolist(), point[cuts[i] : cuts[i + 1]].tolist(), strict=True)]
                out[i] = np.array(sum(each, []), dtype=np.int32).tobytes()
        return out

    def encode(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of each text; a null or empty text has none."""
        flat: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts.to_pylist()):
            if t:
                found = SPLIT.findall(" " + t.replace(SPACE, " "))
                counts[i] = len(found)
                flat += found
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kept = [self.words.get(w) for w in words]
        new, size = [], 0
        for i in [i for i, k in enumerate(kept) if k is None] + [-1]:
            if new and (i < 0 or size > INDEX_CHARS):
                for j, ids in zip(new, self._index([words[j].replace(" ", SPACE) for j in new]), strict=True):
                    kept[j] = ids
                new, size = [], 0
            if i >= 0:
                new.append(i)
                size += len(words[i]) + 1
        # words that a batch has once seldom come again
        again = np.flatnonzero(np.bincount(code, minlength=len(words)) > 1).tolist()
        if len(self.words) + len(again) > WORDS_KEPT:
            self.words.clear()
        self.words.update((words[i], kept[i]) for i in again)
        lens = np.fromiter(map(len, kept), dtype=np.int64, count=len(kept)) // 4
        first = np.cumsum(lens) - lens
        table = np.frombuffer(b"".join(kept), dtype=np.int32)
        each = lens[code]
        total = np.concatenate(([0], np.cumsum(each)))
        ids = table[np.arange(total[-1]) - np.repeat(total[:-1] - first[code], each)]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return pa.LargeListArray.from_arrays(pa.array(total[ends]), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Text of each list of ids, without the space that encoding puts first; bytes that are no UTF-8 become U+FFFD."""
        flat = pc.fill_null(ids.flatten(), 0)
        offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
        lists = pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), self.raw.take(flat))
        joined = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
        return pa.array([b.decode("utf-8", "replace").removeprefix(" ") for b in joined.to_pylist()], pa.large_string())


#: The model that a worker has read, by its bytes' hash.
_READ: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _READ:
        _READ.clear()
        _READ[key] = Pieces(model)
    return _READ[key]


def _load(path: str | None) -> bytes:
    with open(model_path(path), "rb") as f:  # on the driver: the model is broadcast
        return f.read()


def encode(docs: DataFrame, path: str | None = None, text: str = "text", check: bool = False) -> DataFrame:
    """Add `ids` (array of int), the model's encoding of the whole text; with check also `decoded`, the ids' text.

    path: a SentencePiece BPE model with byte pieces that keeps texts as they are, read on the driver and broadcast (its
    size doesn't grow with the data). Null and empty texts have no ids; repeated rows get equal ids. A text round-trips
    exactly unless it holds U+2581, which stands for a space. An empty table stays empty. Other columns stay whatever their
    names, but for earlier ones of these.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_load(path))
    added = {"ids": "array<int>"} | ({"decoded": "string"} if check else {})

    def make():
        model = _pieces(sent.value)
        model.words.clear()  # of an earlier task

        def compute(texts: pa.Array) -> list[pa.Array]:
            ids = model.encode(texts)
            return [ids.cast(pa.list_(pa.int32()))] + ([model.decode(ids).cast(pa.string())] if check else [])

        return compute

    return with_arrays(docs, (text,), added, make)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the text of the ids: bytes are joined, the first space goes. A null list gives an empty text.

    Repeated rows get equal texts; an empty table stays empty; other columns stay whatever their names.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(_load(path))

    def make():
        model = _pieces(sent.value)
        return lambda lists, size: [model.decode(lists).cast(pa.string())]

    # batches are cut by the bytes of the ids
    size, names = unused("_size", encoded), [c for c in encoded.columns if c.lower() != "decoded"]
    sized = encoded.withColumn(size, F.repeat(F.lit("."), F.least(F.coalesce(F.size(F.col(quoted(ids))), F.lit(0)), F.lit(1000))))
    return with_arrays(sized, (ids, size), {"decoded": "string"}, make, keep=names)


def summary(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, ids_sha256 (ids joined by commas), decoded_sha256, round_trip.

    round_trip tells whether the decoded ids are the text again (null text: the empty one).
    """
    text = F.coalesce("text", F.lit(""))
    found = encode(docs.select("doc_id", text.alias("text")), path, check=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
