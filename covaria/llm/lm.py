"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs are quantised to levels of their logarithm. A key of level q is put into the filter q
times, as (key, 1) to (key, q); probing (key, 1), (key, 2) and so on until one is missing gives the level back.

Texts are cut into chunks of some megabytes, which are written down once as numbers of words. A chunk sends its distinct
words and pairs with their counts to the parts of the filter that they belong to, once. The part sums the counts of all
chunks, fills itself, is probed for all that was sent and answers each chunk in the order of what it sent, so that neither
keys nor tokens go back. All of it is packed, which keeps what lies on disk below the size of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covaria.llm.common import hash_words, held_out, materialize, mix64, slices, split_words

U64 = np.uint64
#: Hashes of the token that ends each text, and of the context before its first word.
END, START = U64(0xE7037ED1A0B428DB), U64(0xA0761D6478BD642F)
WORD_KIND, PAIR_KIND, BACK_KIND = 1, 2, 3
#: Bases of the levels of counts and of back-off weights, bits and hashes of an item in the filter.
BASE, BACK_BASE, ITEM_BITS, HASHES = 1.5, 1.2, 12, 8
#: Bits of a block: an item's are in two 64-bit words of one block, so that a probe reads one line of memory.
BLOCK_BITS = 512
MOST_LEVELS = 100
#: What is taken off the count of a pair and left to back-off.
DISCOUNT = 0.75
#: Bits of a part of the filter.
PART_BITS = 1 << 23
#: Parts beyond which they get larger instead of more, and bits of the largest.
MANY_PARTS, MOST_PART_BITS = 1000, 1 << 28
#: Bytes of the texts of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 12 << 20
#: Contexts are hot that have more than this share of what a part would have alone: their pairs go to their second words' parts.
HOT_SHARE = 0.5
#: A chunk's row is megabytes, so a writer looks at its buffers after each.
CHUNK_OPTIONS = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
CHUNK_COLUMNS = ["doc_id", "held_out", "totals", "n_tokens", "learned_tokens", "learned_texts", "n_names", "names", "codes", "often"]
SENT_COLUMNS = ["part", "chunk", "names", "at", "name_n", "low", "context", "pair_n"]
ANSWER_COLUMNS = ["part", "chunk", "at", "exact", "word", "back", "pair", "vocabulary", "hot_n", "hot_kinds"]


def _counts_of_levels() -> np.ndarray:
    """The count that each level stands for: the mean of the whole numbers in it; level 0 is count 0."""
    out = [0.0]
    for q in range(MOST_LEVELS):
        lo, hi = BASE**q, BASE ** (q + 1)
        n = math.floor(hi - 1e-9) - math.ceil(lo - 1e-9) + 1
        out.append((math.ceil(lo - 1e-9) + math.floor(hi - 1e-9)) / 2 if n > 0 else (lo + hi) / 2)
    return np.array(out)


LEVEL_COUNT = _counts_of_levels()
BACK_WEIGHT = BACK_BASE ** -np.arange(MOST_LEVELS + 1.0)


def _level(n: np.ndarray) -> np.ndarray:
    """Level of each count; 0 for none."""
    return np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / math.log(BASE) + 1e-9) + 1, 0).astype(np.int64)


def _back_level(n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Level of the back-off weight of contexts that were seen n times with so many kinds of words after them; 0 for none.

    Each of them keeps its count less DISCOUNT, and the weight is what this leaves of the context's count.
    """
    left = np.maximum(DISCOUNT * kinds / np.maximum(n, 1), 1e-7)
    return np.where(n > 0, np.minimum(MOST_LEVELS, np.floor(-np.log(left) / math.log(BACK_BASE) + 0.5)), 0).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all lowest bytes first, then all second ones, which are alike."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), dtype=kind)


def _ascending(values: np.ndarray) -> bytes:
    """Whole numbers that mostly ascend, packed as steps."""
    return _packed(np.diff(values.astype(np.int64), prepend=0).astype(np.int32))


def _steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.int32), dtype=np.int64)


def _released() -> None:
    """Give memory back that Arrow has freed but keeps, since a task's process stays for the next task."""
    pa.default_memory_pool().release_unused()


def _first(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, dtype=np.int64)


def _distinct(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, their summed counts, and the place of each key among them."""
    order = np.argsort(key)
    sorted_keys = key[order]
    first = _first(sorted_keys)
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return sorted_keys[first], np.add.reduceat(n[order], first) if len(first) else n, place


@dataclass
class Tokens:
    """Tokens of a chunk, text after text, an end token after each: numbers of the word and of the one before, and the text.

    The last two of the `names` are the end token and the context before the first word.
    """

    names: int
    word: np.ndarray
    before: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, names: int, words: np.ndarray, totals: np.ndarray) -> Tokens:
        """From the numbers of all words without the end tokens, and each text's number of tokens."""
        ends = np.cumsum(totals) - 1
        word = np.full(int(totals.sum()), names - 2, dtype=np.int32)
        inside = np.ones(len(word), dtype=bool)
        inside[ends] = False
        word[inside] = words
        before = np.roll(word, 1)
        before[ends - totals + 1] = names - 1
        return cls(names, word, before, np.repeat(np.arange(len(totals), dtype=np.int32), totals))

    def pairs(self) -> np.ndarray:
        """Number of each pair: ascending by the first word, then by the second."""
        return self.before * np.int64(self.names) + self.word


def _pair_keys(before: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Key of each pair: its upper half is the upper half of the first word's hash."""
    return (before & U64(0xFFFFFFFF00000000)) | low


def _upper(word: np.ndarray) -> np.ndarray:
    return word >> U64(32)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (key & U64(0xFFFFFF)) % U64(parts)


def _shape(items: int, part_bits: int) -> tuple[int, int]:
    """Number of parts and bits of each."""
    bits = max(BLOCK_BITS, items * ITEM_BITS)
    while bits > MANY_PARTS * part_bits and part_bits < MOST_PART_BITS:
        part_bits *= 2
    parts = math.ceil(bits / part_bits)
    return parts, math.ceil(bits / parts / BLOCK_BITS) * BLOCK_BITS


@dataclass
class Filter:
    """Bits of all parts, one after the other; every key belongs to one part."""

    bits: int
    parts: int
    data: np.ndarray

    def _has(self, key: np.ndarray, base: np.ndarray, level: int, kind: int) -> np.ndarray:
        """Places of the keys that the filter holds at a level; the second word is looked up for those that passed the first."""
        words = self.data.view("<u8")
        at, h, base = np.arange(len(key)), _hashed(key, level, kind), base >> U64(6)
        for half in (0, 1):
            word, *places = _places(h, half, self.bits)
            mask = np.zeros(len(h), dtype=U64)
            for p in places:
                mask |= U64(1) << p
            passed = (words[(base + word).astype(np.int64)] & mask) == mask
            at, h, base = at[passed], h[passed], base[passed]
        return at

    def levels(self, key: np.ndarray, kind: int) -> np.ndarray:
        """Level of each key: probes go on until one is missing."""
        out = np.zeros(len(key), dtype=np.int64)
        at = np.arange(len(key))
        base = _part(key, self.parts) * U64(self.bits)
        for level in range(1, MOST_LEVELS + 1):
            at = at[self._has(key[at], base[at], level, kind)]
            if not len(at):
                break
            out[at] = level
        return out


def _hashed(key: np.ndarray, level: int, kind: int) -> np.ndarray:
    return mix64(key ^ U64((kind * 0x9E3779B97F4A7C15 + level * 0xD1B54A32D192ED03) & (2**64 - 1)))


def _places(h: np.ndarray, half: int, bits: int) -> list[np.ndarray]:
    """One of the two words of a part that an item lies in, and the places of its bits there."""
    block = ((h >> U64(32)) * U64(bits // BLOCK_BITS)) >> U64(32)
    word = h & U64(7)
    if half:  # another word of the block
        word = word ^ (U64(1) + ((h >> U64(3)) & U64(0xFFFF)) % U64(7))
    g = mix64(h + U64(0x8BB84B93962EACC9))
    return [block * U64(BLOCK_BITS // 64) + word, *((g >> U64(6 * (i + half * HASHES // 2))) & U64(63) for i in range(HASHES // 2))]


def _fill(data: np.ndarray, key: np.ndarray, level: np.ndarray, kind: int) -> None:
    """Set the flags of keys in a part, for each level up to their own."""
    for now in range(1, int(level.max(initial=0)) + 1):
        key, level = key[level >= now], level[level >= now]
        h = _hashed(key, now, kind)
        for word, *places in (_places(h, half, len(data)) for half in (0, 1)):
            for p in places:
                data[(word << U64(6)) + p] = True


def _dealt(keyed: DataFrame, parts: int) -> DataFrame:
    """Rows with a long `key` in the task of the part that it belongs to; every part is a task of its own."""
    return keyed.withColumn("part", (F.col("key").bitwiseAND(F.lit(0xFFFFFF)) % parts).cast("int")).repartitionById(parts, "part")


def build(entries: DataFrame, items: int, part_bits: int = PART_BITS) -> DataFrame:
    """Put the levels into a filter of ITEM_BITS bits an item: one row (part, data) for each part, filled in a task of its own."""
    parts, bits = _shape(items, part_bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, own = np.zeros(bits, dtype=bool), None
        for b in batches:
            kind, level, key = b.column("kind").to_numpy(), b.column("level").to_numpy(), b.column("key").to_numpy().view(U64)
            for k in np.unique(kind):
                mine, q = key[kind == k], level[kind == k]
                _fill(data, mine, q, int(k))
            own = b.column("part")[0].as_py() if b.num_rows else own
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(data, bitorder="little").tobytes()], pa.binary())], names=["part", "data"])

    return _dealt(entries, parts).mapInArrow(fill, "part int, data binary")


def gather(rows: DataFrame, items: int, part_bits: int = PART_BITS) -> Filter:
    """The whole filter on the driver; the caller has checked that it is within a bound."""
    parts, bits = _shape(items, part_bits)
    data = np.zeros(bits // 8 * parts, dtype=np.uint8)
    for r in rows.toLocalIterator():
        data[r["part"] * bits // 8 : (r["part"] + 1) * bits // 8] = np.frombuffer(r["data"], dtype=np.uint8)
    return Filter(bits, parts, data)


def probe(keys: DataFrame, rows: DataFrame, items: int, part_bits: int = PART_BITS) -> DataFrame:
    """Levels (kind, key, level) of distinct (kind, key), each probed in the task that holds its part of the filter."""
    parts, bits = _shape(items, part_bits)
    asked = _dealt(keys.select("kind", "key"), parts).select("part", "kind", "key", F.lit(None).cast("binary").alias("data"))
    # a part's own row comes before what is asked of it
    both = rows.select("part", F.lit(0).cast("byte").alias("kind"), F.lit(0).cast("long").alias("key"), "data").unionByName(asked)
    both = both.repartitionById(parts, "part").sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(bits, 1, np.zeros(bits // 8, dtype=np.uint8))
        for b in batches:
            kind, key = b.column("kind").to_numpy(), b.column("key").to_numpy().view(U64)
            for place in np.flatnonzero(kind == 0):
                f = Filter(bits, 1, np.frombuffer(b.column("data")[int(place)].as_py(), dtype=np.uint8))
            for k in np.unique(kind[kind > 0]):
                mine = key[kind == k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k, dtype=np.int8)), pa.array(mine.view(np.int64)), pa.array(f.levels(mine, int(k)).astype(np.int32))], names=["kind", "key", "level"])

    return both.mapInArrow(run, "kind byte, key long, level int")


def _probability(word, pair, before, back, tokens: int, vocabulary: int):
    """Discounted share of the pair in its context, and the word's own share, plus one each, by the back-off weight.

    Arguments are counts of word, pair and context and the weight, as numbers or arrays.
    """
    return (pair - DISCOUNT) / before, back * (word + 1) / (tokens + vocabulary + 1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Batches joined until they have about CHUNK_BYTES of text, and these bytes; a larger one stays as it is."""
    held, size = [], 0
    for batch in batches:
        more = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + more > CHUNK_BYTES:
            yield pa.concat_batches(held), size
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held), size


def chunks(rows: DataFrame) -> DataFrame:
    """Texts of (doc_id, held_out, text) as numbers of words, some megabytes a row: what all later steps read.

    A row has the ids and tokens of its texts, the hashes of its distinct words, each word's number among them, and how often
    the contexts of its learned pairs occur that may be hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, size in _gathered(batches):
            for part in slices(iter([batch]), limit=int(1.1 * size / math.ceil(size / CHUNK_BYTES or 1)) + 1):
                words, counts = split_words(part.column("text"))
                coded = words.dictionary_encode()
                names = np.concatenate((hash_words(coded.dictionary), [END, START]))
                codes, totals = coded.indices.to_numpy(zero_copy_only=False), counts + 1
                learned = ~pc.fill_null(part.column("held_out"), True).to_numpy(zero_copy_only=False)
                t = Tokens.of(len(names), codes, totals)
                n = np.bincount(t.before[learned[t.text]], minlength=len(names))
                often = np.flatnonzero(n * (MANY_PARTS / HOT_SHARE) > n.sum())
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(part.column("doc_id")), one(part.column("held_out")), pa.array([_packed(totals)], pa.binary()), pa.array([len(t.word)]), pa.array([int(totals[learned].sum())]), pa.array([int(learned.sum())]),
                        pa.array([len(names)]), pa.array([names.tobytes()], pa.binary()), pa.array([_packed(codes.astype(np.uint32))], pa.binary()),
                        one(pa.StructArray.from_arrays([pa.array(names[often].view(np.int64)), pa.array(n[often])], names=["key", "n"])),
                    ],
                    names=CHUNK_COLUMNS,
                )
                del words, counts, coded, names, codes, totals, t, n
                _released()

    others = "held_out array<boolean>, totals binary, n_tokens long, learned_tokens long, learned_texts long, n_names long, names binary, codes binary, often array<struct<key:bigint,n:bigint>>"
    schema = T.StructType([T.StructField("doc_id", T.ArrayType(rows.schema["doc_id"].dataType)), *T.StructType.fromDDL(others)])
    return rows.mapInArrow(run, schema)


def _order(name_part: np.ndarray, hot: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part of each distinct pair, and the order in which pairs are dealt, part by part.

    A pair is dealt with its first word, or with its second where the first is hot.
    """
    v, w = np.divmod(pairs, len(name_part))
    part = np.where(hot[v], name_part[w], name_part[v])
    return part, np.argsort(part, kind="stable")


def dealt(kept: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """What chunks send: a row for each part with distinct words, pairs and learned counts, in the task of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            names = np.frombuffer(row["names"], dtype=U64)
            t = Tokens.of(len(names), _unpacked(row["codes"], np.uint32), _unpacked(row["totals"], np.int64))
            held = np.array([h is not False for h in row["held_out"]])[t.text]
            name_n = np.bincount(t.word[~held], minlength=len(names))
            found = t.pairs()
            del t
            found <<= 1
            found += held
            found.sort()
            held = (found & 1).astype(bool)
            found >>= 1
            first = _first(found)
            pairs, pair_n = found[first], np.diff(np.append(first, len(found))) - np.add.reduceat(held, first, dtype=np.int64)
            del held, found, first
            name_part = (_upper(names) % U64(parts)).astype(np.min_scalar_type(parts))
            # all names but the last, which is no word
            by_part = np.argsort(name_part[:-1], kind="stable")
            many = np.bincount(name_part[:-1], minlength=parts)
            to = np.cumsum(many)
            place = np.zeros(len(names), dtype=np.int64)
            place[by_part] = np.arange(len(by_part)) - np.repeat(to - many, many)
            near = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
            is_hot = hot[near] == names
            part, order = _order(name_part, is_hot, pairs)
            part, pair_n = part[order], pair_n[order]
            v, w = np.divmod(pairs[order], len(names))
            del order, pairs
            context = np.where(is_hot[v], many[part] + near[v], place[v])
            with np.errstate(over="ignore"):
                low = (mix64(names[v] * U64(3) + names[w]) >> U64(32)).astype(np.uint32)
            ends = np.cumsum(np.bincount(part, minlength=parts))
            del v, w, part
            sent = []
            for p in np.flatnonzero(many):
                mine, own = by_part[to[p] - many[p] : to[p]], slice(ends[p - 1] if p else 0, ends[p])
                sent.append((p, row["chunk"], names[mine].tobytes(), _ascending(mine), _packed(name_n[mine]), low[own].tobytes(), _ascending(context[own]), _packed(pair_n[own])))
            columns = zip(*sent, strict=True)
            kinds = pa.int32(), pa.int64(), *[pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=SENT_COLUMNS)
            del sent, columns, context, low, pair_n
            _released()

    schema = "part int, chunk long, " + ", ".join(f"{c} binary" for c in SENT_COLUMNS[2:])
    return kept.select("chunk", "held_out", "totals", "names", "codes").mapInArrow(run, schema).repartitionById(parts, "part")


def answers(sent: DataFrame, hot: np.ndarray) -> DataFrame:
    """Each part counts what chunks sent, fills itself and is probed: a row for each chunk, and one without for the part.

    A chunk's row has, for its words in the order that they were sent in, exact counts, levels of counts and of back-off
    weights, and levels of its pairs. A hot context, whose pairs are in many parts, has 256 and its number instead of the
    level of its weight. The part's row has the number of its learned words, and counts and kinds of hot contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [c for b in batches for c in b.to_pylist()]
        if not cells:
            return
        names = [np.frombuffer(c["names"], dtype=U64) for c in cells]
        context = [_steps(c["context"]) for c in cells]
        before = np.concatenate([np.concatenate((n, hot))[c] for n, c in zip(names, context, strict=True)])
        key, pair_n, pair_place = _distinct(_pair_keys(before, np.concatenate([np.frombuffer(c["low"], dtype=np.uint32) for c in cells])), np.concatenate([_unpacked(c["pair_n"], np.int64) for c in cells]))
        is_hot = np.full(len(key), -1)
        is_hot[pair_place] = np.concatenate([np.maximum(-1, c - len(n)) for n, c in zip(names, context, strict=True)])
        name, name_n, name_place = _distinct(np.concatenate(names), np.concatenate([_unpacked(c["name_n"], np.int64) for c in cells]))
        # contexts: how often they were learned and with how many words after them
        own, others = (pair_n > 0) & (is_hot < 0), (pair_n > 0) & (is_hot >= 0)
        upper, n = _upper(key[own]), pair_n[own]
        first = _first(upper)
        back = _back_level(np.add.reduceat(n, first) if len(first) else n, np.diff(np.append(first, len(upper))))
        hot_kinds, hot_n = np.bincount(is_hot[others], minlength=len(hot)), np.bincount(is_hot[others], weights=pair_n[others], minlength=len(hot)).astype(np.int64)
        entries = (WORD_KIND, name, _level(name_n)), (PAIR_KIND, key, _level(pair_n)), (BACK_KIND, upper[first], back)
        bits = math.ceil(max(1, sum(int(level.sum()) for _, _, level in entries) * ITEM_BITS) / BLOCK_BITS) * BLOCK_BITS
        data = np.zeros(bits, dtype=bool)
        for kind, keys, level in entries:
            _fill(data, keys, level, kind)
        f = Filter(bits, 1, np.packbits(data, bitorder="little"))
        near = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
        backs = np.where(hot[near] == name, 256 + near, f.levels(_upper(name), BACK_KIND)).astype(np.uint16)
        words, pairs = f.levels(name, WORD_KIND).astype(np.uint8)[name_place], f.levels(key, PAIR_KIND).astype(np.uint8)[pair_place]
        exact, backs = name_n[name_place], backs[name_place]
        part = cells[0]["part"]
        out, i, j = [(part, None, None, None, None, None, None, int((name_n > 0).sum()), hot_n.tolist(), hot_kinds.tolist())], 0, 0
        for c, many, more in zip(cells, map(len, names), map(len, context), strict=True):
            w, p = slice(i, i + many), slice(j, j + more)
            out.append((part, c["chunk"], c["at"], _packed(exact[w]), _packed(words[w]), _packed(backs[w]), _packed(pairs[p]), None, None, None))
            i, j = w.stop, p.stop
        kinds = pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=ANSWER_COLUMNS)

    return sent.mapInArrow(run, "part int, chunk long, at binary, exact binary, word binary, back binary, pair binary, vocabulary long, hot_n array<long>, hot_kinds array<long>")


def score(docs: DataFrame, held: F.Column | None = None, filter_bytes: int | None = None, part_bits: int = PART_BITS) -> DataFrame:
    """Score every row of docs by a model of the rows that aren't held out: one row for each, with doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score and score.

    Tokens are words with A-Z lowered and one end token for each text; null text is empty. score sums the log10 of
    interpolated, discounted pair probabilities; all counts in them are read from the filter, but for the number of texts and
    the weights of hot contexts, which are quantised alike. base_score and n_known use exact counts. The filter's parts are
    filled and probed in tasks of their own and are never brought together, so `filter_bytes`, which once bounded a filter
    that was broadcast, changes nothing. Equal texts tie and repeated rows are scored each; null ids are learned from; an
    empty table gives no rows; with nothing learned both scores are 0 a token. Columns but doc_id and text aren't read,
    whatever their names.
    """
    held = held_out(7) if held is None else held
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    # chunks get their numbers before they are written, so that later reads agree on them; a row is megabytes
    kept = materialize(chunks(rows).withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks", CHUNK_OPTIONS)
    said = kept.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "learned_tokens", "learned_texts")]).first()
    tokens, n_docs = said[1], said[2]
    parts, _ = _shape(said[0], part_bits)
    often = kept.select(F.explode("often").alias("x")).groupBy("x.key").agg(F.sum("x.n").alias("n")).where(F.col("n") > max(1, tokens) * HOT_SHARE / parts)
    hot = np.unique(np.append(np.array([r["key"] for r in often.collect()], dtype=np.int64).view(U64), START))
    known = materialize(answers(dealt(kept, parts, hot), hot), "lm-answers")
    of_parts = known.where("chunk IS NULL")
    vocabulary = of_parts.agg(F.sum("vocabulary")).first()[0] or 0
    hot_n, hot_kinds = np.zeros(len(hot), dtype=np.int64), np.zeros(len(hot), dtype=np.int64)
    for r in of_parts.select(F.posexplode(F.arrays_zip("hot_n", "hot_kinds")).alias("at", "x")).groupBy("at").agg(F.sum("x.hot_n").alias("n"), F.sum("x.hot_kinds").alias("kinds")).collect():
        hot_n[r["at"]], hot_kinds[r["at"]] = r["n"], r["kinds"]
    # weights of all levels, then, from 256 on, those of hot contexts
    weights = np.concatenate((BACK_WEIGHT, np.ones(256 - len(BACK_WEIGHT)), BACK_WEIGHT[_back_level(hot_n, hot_kinds)]))
    start = 256 + int(np.searchsorted(hot, START))

    def run(asked: pa.Table, answered: pa.Table) -> pa.Table:
        row = asked.select(["n_names", "totals", "codes"]).to_pylist()[0]
        many, totals = row["n_names"], _unpacked(row["totals"], np.int64)
        t = Tokens.of(many, _unpacked(row["codes"], np.uint32), totals)
        parted, exact, word, back = np.zeros(many, dtype=np.min_scalar_type(answered.num_rows)), np.zeros(many), np.zeros(many), np.full(many, start)
        levels = []
        for p, a in enumerate(sorted(answered.select(["part", "at", "exact", "word", "back", "pair"]).to_pylist(), key=lambda a: a["part"])):
            at = _steps(a["at"])
            parted[at], exact[at], word[at], back[at] = p, _unpacked(a["exact"], np.int64), LEVEL_COUNT[_unpacked(a["word"], np.uint8)], _unpacked(a["back"], np.uint16)
            levels.append(_unpacked(a["pair"], np.uint8))
        _released()
        logs = np.bincount(t.text, weights=np.log10(exact + 1)[t.word], minlength=len(totals))
        seen = np.bincount(t.text, weights=(exact > 0)[t.word], minlength=len(totals)).astype(np.int64)
        pairs = t.pairs()
        by_pair = np.argsort(pairs)
        text, pairs = t.text[by_pair], pairs[by_pair]
        del t, by_pair
        first = _first(pairs)
        times, pairs = np.diff(np.append(first, len(pairs))), pairs[first]
        pair = np.zeros(len(pairs))
        pair[_order(parted, back >= 256, pairs)[1]] = LEVEL_COUNT[np.concatenate(levels)]
        word[many - 1] = max(1, n_docs)
        v, w = np.divmod(pairs, many)
        own, rest = _probability(word[w], pair, np.maximum(word[v], np.maximum(pair, 1)), weights[back[v]], tokens, vocabulary)
        log = np.log10(np.minimum(1.0, np.where(pair > 0, own, 0) + rest))
        scored = np.bincount(text, weights=np.repeat(log, times), minlength=len(totals))
        ids, held = (asked.column(c).combine_chunks().flatten() for c in ("doc_id", "held_out"))
        if pa.types.is_timestamp(ids.type) and ids.type.tz:  # they come in the session's zone and are taken back in UTC
            ids = ids.cast(pa.timestamp("us", "UTC"))
        return pa.table([ids, held, pa.array(totals), pa.array(seen), pa.array(logs), pa.array(scored)], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    # ids as they were written, where all parts of them may be null
    schema = T.StructType([T.StructField("doc_id", kept.schema["doc_id"].dataType.elementType), *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, logs double, score double")])
    asked = kept.select("chunk", "doc_id", "held_out", "n_names", "totals", "codes").groupBy("chunk")
    answered = known.where("chunk IS NOT NULL").select("chunk", "part", "at", "exact", "word", "back", "pair").groupBy("chunk")
    return asked.cogroup(answered).applyInArrow(run, schema).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(tokens + vocabulary + 1)))).alias("base_score"), "score",
    )
