"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at `2r` bits or fewer share a variant within `r` bits of each; two that share one are that close.
So all variants within half the radius are emitted, dealt out by value, and fingerprints that meet are linked.
Variants leave for a block named by their leading bits: a fingerprint is sent once to each block that its variants
reach, and the variants themselves are made there. That ships the same variants in a few dozen rows instead of 2,081.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.llm.common import broadcast_if_small, hash_words, materialize, mix64, quoted, slices, split_words, unused, with_arrays

U64 = np.uint64
BITS = 64
#: Variants of a block held in memory at once; a fuller block is split by its next bits.
BLOCK_VARIANTS = 2_000_000
#: Similar texts: short fingerprints of a text (an even number) and their bits; fingerprints after a shared one that are compared, bits by
#: which these may differ (a pair at Jaccard 0.8 differs by 14.5 of 96, 3.4 deviations less than 26), and by which a leader takes a row.
TABLES, BITS_SHORT, CHECKS, MOST_AWAY, GIVEN_AWAY = 32, 32, 3, 26, 20
#: Rounds of leaders that are taken from the middle of a key; rows that still look unlike are then led by many at once, for which
#: so many distances are told together.
ROUNDS, AT_ONCE = 16, 1 << 22
#: Sets that a task holds before it sends their fingerprints.
HELD_SETS = 200_000


def _signed(values) -> list[int]:
    return [v - (1 << 64) if v >> 63 else v for v in values]


def _fingerprint(text: str | None, n: int, digest) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = min(n, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)), dtype="<u8", count=len(starts))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add `fp` (long, the fingerprint's bits): bit b is 1 if it is set in over half of the shingles' XXH64 (seed 42).

    A text of fewer words is one shingle; null, empty or white text has fingerprint zero. Other columns (or those in keep) stay.
    """

    def make():
        import xxhash

        return lambda texts: [pa.array(_signed(_fingerprint(t, shingle, xxhash.xxh64_intdigest) for t in texts.to_pylist()), pa.int64())]

    return with_arrays(docs, (text,), {"fp": "long"}, make, keep=keep)


def _flips(bits: range, most: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)]


def _meet(fp: np.ndarray, used: np.ndarray, free: int, radius: int, out: list) -> None:
    """Link fingerprints of one block that share a variant. used: flips already made in leading bits; free: low bits left.

    Members of a shared variant are linked to the least of them, not to each other: every two of them are close enough.
    The distance of each link is verified.
    """
    counts = np.array([sum(math.comb(free, i) for i in range(radius - u + 1)) for u in range(radius + 1)], dtype=np.int64)
    if len(fp) < 2:
        return
    if counts[used].sum() > BLOCK_VARIANTS and free > 8:
        c = 4
        own = (fp >> np.uint64(free - c)) & np.uint64((1 << c) - 1)
        for block in range(1 << c):
            more = used + np.bitwise_count(own ^ np.uint64(block)).astype(np.int64)
            if (near := more <= radius).sum() > 1:
                _meet(fp[near], more[near], free - c, radius, out)
        return
    low = np.uint64((1 << free) - 1)
    made, who = [], []
    for u in range(radius + 1):
        if len(at := np.flatnonzero(used == u)):
            masks = np.array(_flips(range(free), radius - u), dtype=np.uint64)
            made.append(((fp[at] & low)[:, None] ^ masks[None, :]).ravel())
            who.append((at, len(masks)))
    keys = np.concatenate(made)
    ordered = np.sort(keys)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return
    slot = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
    hit = np.flatnonzero(shared[slot] == keys)
    owner = np.concatenate([np.repeat(at, n) for at, n in who])[hit]
    slot = slot[hit]
    least = np.full(len(shared), np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, slot, fp[owner])
    a, b = least[slot], fp[owner]
    good = (a != b) & (np.bitwise_count(a ^ b) <= 2 * radius)
    if good.any():
        out.append(np.unique(np.stack([a[good], b[good]], axis=1), axis=0))


def links(prints: DataFrame, distance: int = 4, prefix_bits: int = 10) -> DataFrame:
    """Links (a, b) that connect all pairs of distinct fingerprints `fp` at `distance` bits or fewer.

    prefix_bits: leading bits that name a block; more than that are used as the table grows, so that a block's
    variants stay within BLOCK_VARIANTS on average. Repeated links are removed within a block and over all blocks.
    """
    radius = distance // 2  # an odd distance d needs balls of (d - 1) / 2 and (d + 1) / 2; only even ones are offered
    if distance % 2:
        raise ValueError("distance must be even")
    distinct = prints.select("fp").where("fp IS NOT NULL").distinct()
    n = max(1, distinct.count())
    each = sum(math.comb(BITS, k) for k in range(radius + 1))
    bits = min(24, max(prefix_bits, math.ceil(math.log2(n * each / BLOCK_VARIANTS))))
    masks = F.array(*[F.lit(m) for m in _flips(range(bits), radius)])
    prefix = F.shiftrightunsigned("fp", BITS - bits)
    sent = distinct.select("fp", F.explode(F.transform(masks, lambda m: prefix.bitwiseXOR(m))).alias("block"))

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        used = np.bitwise_count((fp >> np.uint64(BITS - bits)) ^ np.uint64(key[0])).astype(np.int64)
        out: list = []
        _meet(fp, used, BITS - bits, radius, out)
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.uint64)
        return pd.DataFrame({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)})

    return sent.groupBy("block").applyInPandas(block, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of undirected edges (a, b) as (node, root), root being the least node.

    Alternates large-star and small-star steps over tables in the shared folder until no edge changes. Each step takes
    minima by node, in parts before the shuffle, and writes them down; edges meet them by a broadcast where their
    number was counted to be small, else by a join that AQE can split, so a node with very many neighbours is not
    gathered in one task.
    """

    def minima(rows: DataFrame, least: Column) -> DataFrame:
        return broadcast_if_small(materialize(rows.groupBy("u").agg(least.alias("m")), "minima"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        return both.join(minima(both, F.least(F.min("v"), F.col("u"))), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        moved = down.join(minima(down, F.min("v")), "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        return moved.where("a <> b").distinct()

    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    state, e = None, materialize(e, "edges")
    for _ in range(rounds):
        e = materialize(small(materialize(large(e), "stars")), "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links.

    Equal fingerprints are linked; texts without words have fingerprint zero and link like any other. Repeated rows
    stay as they are. A component whose ids are all null has a null id. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs.select(F.col(quoted(doc_id)).alias("doc_id"), "text"), shingle, keep=["doc_id"]), "prints")
    roots = components(links(prints, distance))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similar texts: the same balls over several short fingerprints, so that pairs well beyond 4 of 64 bits meet too.


def _shingles(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, text after text, and their number in each text.

    Words have A-Z lowered; a text of fewer words is one shingle, one without words has none.
    """
    words, counts = split_words(texts)
    if not len(words):
        return np.zeros(0, dtype=U64), np.zeros(len(counts), dtype=np.int64)
    coded = words.dictionary_encode()
    h = hash_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    key = np.zeros(len(h), dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            inside = slice(0, len(h) - k)
            more = mix64(key[inside] * U64(3) + h[k:] + U64(k))
            key[inside] = more if not k else np.where(left[inside] > k, more, key[inside])
    begins = (left >= shingle) | (left == counts[text])
    key, text = key[begins], text[begins]
    ends = np.cumsum(np.bincount(text, minlength=len(counts)))
    for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
        key[a:b].sort()
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
    return key[new], np.bincount(text[new], minlength=len(counts))


def _prints(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints (texts, TABLES) of 32 bits of sets of hashes that follow one another, n of each text (at least one)."""
    ends = np.cumsum(n)
    # bytes hold sums of up to 255 rows; groups of rows don't cross texts
    groups = (n + 254) // 255
    owner = np.repeat(np.arange(len(n)), groups)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(groups) - groups, groups)
    starts = (ends - n)[owner] + 255 * place
    firsts = np.cumsum(groups) - groups
    out = np.empty((len(n), TABLES // 2), dtype="<u8")
    for t in range(TABLES // 2):
        bits = np.unpackbits(mix64(keys + U64((t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))).view(np.uint8), bitorder="little").view("<u8").reshape(-1, 8)
        lanes = np.add.reduceat(bits, starts, axis=0).view(np.uint8).reshape(-1, BITS)
        ones = np.add.reduceat(lanes, firsts, axis=0, dtype=np.int64)
        out[:, t] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view("<u4")


def sets(docs: DataFrame, shingle: int, listed: bool) -> DataFrame:
    """doc_id and `set`, a hash that equal shingle sets share, with the shingles (listed) or the fingerprints `prints`.

    Both lists are empty for a text without words, whose set is 0.
    """
    name, kind = ("shingles", "bigint") if listed else ("prints", "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, n = _shingles(part.column("text"), shingle)
            ends, some = np.concatenate(([0], np.cumsum(n))), np.flatnonzero(n)
            made = np.zeros(len(n), dtype=U64)
            if len(some):
                with np.errstate(over="ignore"):
                    made[some] = mix64(np.add.reduceat(mix64(keys), ends[some]) + n[some].astype(U64))
            values = pa.array(keys.view(np.int64))
            if not listed:
                values = pa.array((_prints(keys, n[some]) if len(some) else np.zeros((0, TABLES), dtype="<u4")).ravel().view(np.int32))
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, TABLES, 0))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=["doc_id", "set", name])

    schema = docs.select("doc_id").withColumns({"set": F.lit(0).cast("long"), name: F.array().cast(f"array<{kind}>")}).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _leaders(key: np.ndarray, checks: np.ndarray, names: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
    """Pairs (leader, member, whether the member was given to it, the leader's distance from the middle) of rows with equal
    keys, and which rows weren't given away.

    The middle of a key has the bits that most of its rows have in their further fingerprints `checks`; the row closest to it
    leads (of equal ones that of the least name), since edited copies are more like their origin than like each other. Rows
    that look alike are paired with the leader, and those that differ much go on to the next one, until every key has one row
    left at most. Each round pairs a row once, so copies of one text make as many pairs as there are copies. After ROUNDS
    the rest of a key are led by the order of their names, in few rounds however many don't look alike.
    """
    order = np.argsort(key, kind="stable")
    free, pairs = np.ones(len(key), dtype=bool), []
    for _ in range(ROUNDS):
        if len(order) < 2:
            return pairs, free
        k = key[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(first, len(k)))
        bits = np.unpackbits(np.ascontiguousarray(checks[order]).view(np.uint8), axis=1, bitorder="little")
        middle = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > sizes[:, None], axis=1, bitorder="little").view("<u4")
        off = np.bitwise_count(checks[order] ^ np.repeat(middle, sizes, axis=0)).sum(axis=1, dtype=np.int64)
        best = np.lexsort((names[order], off, k))[first]
        head, far = np.repeat(order[best], sizes), np.repeat(off[best], sizes)
        member = order != head
        a, b, far = head[member], order[member], far[member]
        away = np.bitwise_count(checks[a] ^ checks[b]).sum(axis=1, dtype=np.int64)
        near, given = away <= MOST_AWAY, away <= GIVEN_AWAY
        pairs.append((a[near], b[near], given[near], far[near]))
        free[b[given]] = False
        # rows that no leader took meet once more, where two or more are left
        rest = b[~given]
        left = key[rest]
        again = np.zeros(len(left), dtype=bool)
        again[1:] = left[1:] == left[:-1]
        again[:-1] |= again[1:]
        order = rest[again]
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        _many_leaders(rows[np.argsort(names[rows], kind="stable")], checks, pairs, free)
    return pairs, free


def _many_leaders(rows: np.ndarray, checks: np.ndarray, pairs: list[tuple[np.ndarray, ...]], free: np.ndarray) -> None:
    """Pairs of rows of one key, each led by the first one that it looks like; distances to many leaders are taken at once."""
    while len(rows) > 1:
        many = max(1, min(len(rows), AT_ONCE // len(rows)))
        far = np.zeros((many, len(rows)), dtype=np.uint8)
        for k in range(checks.shape[1]):
            far += np.bitwise_count(checks[rows[:many], k][:, None] ^ checks[rows, k][None, :])
        left = np.ones(len(rows), dtype=bool)
        for i in range(many):
            if not left[i]:
                continue
            left[i] = False
            near = np.flatnonzero(left & (far[i] <= MOST_AWAY))
            if len(near):
                given = far[i, near] <= GIVEN_AWAY
                # these leaders come after those from the middle where a row was given to several
                pairs.append((np.full(len(near), rows[i]), rows[near], given, np.full(len(near), 8 * checks.itemsize * checks.shape[1], dtype=np.int64)))
                left[near[given]] = False
                free[rows[near[given]]] = False
        rows = rows[many:][left[many:]]


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a below b, of `set`s of which two of the fingerprints `prints` differ by two bits or fewer.

    Every fingerprint goes to the blocks, named by table and leading bits, that its ball of one bit reaches; there the
    variants are made and those that meet are paired by leaders. Rows of a task with equal fingerprints are paired before
    they are sent, and only their leaders are, so a group of copies crosses the shuffle in as many rows as tasks hold it.
    """
    n = max(1, nodes.count())
    bits = min(20, max(3, math.ceil(math.log2(n * (BITS_SHORT + 1) / BLOCK_VARIANTS))))
    low = np.uint32((1 << (BITS_SHORT - bits)) - 1)
    flips = np.array([0, *(1 << b for b in range(bits))], dtype=np.uint32)

    def rows(block: np.ndarray, name: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(block), 1 << 16):
            part = slice(at, at + (1 << 16))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (CHECKS + 1)), len(block[part]), [None, pa.py_buffer(np.ascontiguousarray(prints[part]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block[part]), pa.array(name[part]), data], names=["block", "set", "prints"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            names, prints = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            for t in range(TABLES):
                mine = prints[:, (t + np.arange(CHECKS + 1)) % TABLES]
                pairs, free = _leaders(mine[:, 0].astype(U64), mine[:, 1:], names)
                for a, b, *_ in pairs:
                    # a pair passes through its block: the other set stands in the place of the fingerprints
                    if len(a):
                        other = np.zeros((len(a), CHECKS + 1), dtype="<u4")
                        other[:, :2] = names[b].view("<u4").reshape(-1, 2)
                        yield from rows(-1 - (mix64(names[b].view(U64)) % U64(1 << 12)).astype(np.int32), names[a], other)
                at = np.flatnonzero(free)
                mine = mine[at]
                lead = prints[at, t] >> np.uint32(BITS_SHORT - bits)
                for f in flips:
                    yield from rows((t << bits) + (lead ^ f).astype(np.int32), names[at], mine)

        for b in batches:
            flat = b.column("prints").flatten().to_numpy().view(np.uint32)
            held.append((b.column("set").to_numpy(), flat.reshape(-1, TABLES)))
            if sum(len(x) for x, _ in held) > HELD_SETS:
                yield from flush()
        if held:
            yield from flush()

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        names = group.column("set").to_numpy()
        prints = np.frombuffer(b"".join(group.column("prints").to_pylist()), dtype="<u4").reshape(-1, CHECKS + 1)
        block, (a, b) = key[0].as_py(), (names[:0], names[:0])
        if block < 0:
            a, b = names, np.ascontiguousarray(prints[:, :2]).view("<i8")[:, 0]
        elif len(names) > 1:
            # of rows from a neighbouring block the ball's bit is spent
            came, here = (prints[:, 0] >> np.uint32(BITS_SHORT - bits)).astype(np.int64), block & ((1 << bits) - 1)
            home = came == here
            made, owner = [prints[:, 0] & low], [np.arange(len(names))]
            own = np.flatnonzero(home)
            masks = U64(1) << np.arange(BITS_SHORT - bits, dtype=U64)
            made.append(((prints[own, 0] & low).astype(U64)[:, None] ^ masks[None, :]).ravel())
            owner.append(np.repeat(own, len(masks)))
            variant, owner = np.concatenate([x.astype(U64) for x in made]), np.concatenate(owner)
            order = np.argsort(variant, kind="stable")
            same = variant[order][1:] == variant[order][:-1]
            hit = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            pairs, _ = _leaders(variant[hit], prints[owner[hit], 1:], names[owner[hit]])
            if pairs:
                x, y, given, far = (np.concatenate(c) for c in zip(*pairs, strict=True))
                # rows of one block meet elsewhere too, and those of neighbouring blocks in both: made is a pair where its member is at home
                one, other = came[owner[hit[x]]], came[owner[hit[y]]]
                once = ~given | (other == here) | (one != here) & (one != other)
                x, y, given, far = x[once], y[once], given[once], far[once]
                found = np.unique(np.stack([~given, names[owner[hit[y]]], far, names[owner[hit[x]]]], axis=1), axis=0)
                # a row has several variants here; of the leaders that it was given to, the one closest to its middle is enough
                given = found[:, 0] == 0
                again = np.zeros(len(found), dtype=bool)
                again[1:] = given[1:] & given[:-1] & (found[1:, 1] == found[:-1, 1])
                b, a = found[~again, 1], found[~again, 3]
        ok = a != b
        return pa.table({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok]})

    sent = nodes.where(F.size("prints") > 0).select("set", "prints").mapInArrow(send, "block int, set long, prints binary")
    return sent.groupBy("block").applyInArrow(meet, "a long, b long").distinct()


def similar_texts(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id, the least doc_id reachable over pairs whose shingle sets have Jaccard `least` or more.

    Equal sets are one node. Candidates share a variant in one of TABLES fingerprints; each is verified by an exact count.
    A pair at 0.8 differs in 15% of the bits, so it meets in a table with a chance of 0.12 and in none of 32 with 0.018;
    at 0.85 that is 0.0008. Texts without words are one node, linked to no other. An empty table gives no rows.
    """
    made = materialize(sets(docs, shingle, False), "sets")
    nodes = materialize(made.groupBy("set").agg(F.min("doc_id").alias("first"), F.first("prints").alias("prints")), "set-nodes")
    pairs = materialize(candidates(nodes), "pairs")
    # shingles of the sets that meet another one, made again from one document of each
    meet = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    one = nodes.join(meet, "set", "left_semi").select(F.col("first").alias("doc_id")).distinct()
    listed = sets(docs.join(one, "doc_id", "left_semi"), shingle, True).join(meet, "set", "left_semi").select("set", "shingles").dropDuplicates(["set"])
    listed = materialize(listed, "shingles")
    x, y = (listed.select(F.col("set").alias(s), F.col("shingles").alias(f"{s}_set")) for s in "ab")
    both = pairs.join(x, "a").join(y, "b").withColumn("_both", F.size(F.array_intersect("a_set", "b_set")))
    edges = both.where(F.col("_both") >= F.lit(least) * (F.size("a_set") + F.size("b_set") - F.col("_both"))).select("a", "b")
    roots = components(edges)
    rooted = materialize(nodes.join(roots, F.col("set") == F.col("node"), "left").select("set", "first", F.coalesce("root", "set").alias("root")), "rooted")
    top = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    named = rooted.join(broadcast_if_small(top), "root").select("set", "component_id")
    return made.select("doc_id", "set").join(named, "set").select("doc_id", "component_id")


def _keep_least(docs: DataFrame, named: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `named` whose doc_id is their component's least, one row of each id, and the rows of docs without one."""
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    n = unused("_n", docs)
    order = F.xxhash64("text"), F.xxhash64(*[F.col(quoted(c)).cast("string") for c in docs.columns])
    ranked = named.join(kept, "doc_id", "left_semi").withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return ranked.where(F.col(n) == 1).drop(n).unionByName(docs.where("doc_id IS NULL"))


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """Documents without near-duplicates by op4's links: of each component the row with the least doc_id.

    A repeated row of that id stays once, the one whose text has the least hash. Rows with a null doc_id cannot be
    named, take no part and stay. An empty table gives no rows; other columns, whatever their names, stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    return _keep_least(docs, named, near_duplicates(named, shingle, distance))


def keep_one_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """keep_one() by similar_texts(): of each group of texts at Jaccard `least` or more the row with the least doc_id."""
    named = docs.where("doc_id IS NOT NULL")
    return _keep_least(docs, named, similar_texts(named, shingle, least))
