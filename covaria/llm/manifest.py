"""Merkle manifest of a dataset with parent-preimage paths, in DataFrame functions.

Each row is a leaf; runs of `fan` nodes become their parent, up to a subroot for each group and a root over these. What is
stored of a parent is its preimage, the digests of its children end to end: a node that knows its place finds its siblings
by excising its own 64 characters, and folds another digest in by splicing it there.

The tree is built a block of levels at a time. A block is the `fan ** deep` leaves (4,096 with the defaults) under one node and
is a row of its own, so a group with most of the rows is many tasks, and one pass lessens the nodes 4,096 times. On the way
down a block is joined to the preimages of its own ancestors, and its leaves to those inside the block by their places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covaria.llm.common import materialize, quoted

#: Children of a node, and levels of a block.
FAN, DEEP = 2, 12
DIGEST = 64


def digest(*values: Column) -> Column:
    """SHA-256 in lowercase hex of values' canonical forms: `-` for null, else UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _numbered(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add idx (place from 0 in the tree, in the order of keys) and n (the tree's size) to rows with a tree.

    Rows are dealt out by ranges of tree and keys and written down with the number of their range; the counts of a tree's
    earlier ranges are added, so one tree is many tasks. A range holds rows of few trees, so these counts are few.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(nodes.repartitionByRange(parts, "tree", *keys).withColumn("part", F.spark_partition_id()), "leaves")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("c"))
    tree = Window.partitionBy("tree")
    earlier = F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    known = counts.select("tree", "part", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("c").over(tree).alias("n"))
    here = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*keys)) - 1
    return dealt.withColumn("here", here).join(known, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("here")).drop("part", "here", "before")


def _blocks(nodes: DataFrame, fan: int, deep: int, name: str) -> DataFrame:
    """One row for each block of nodes (tree, idx, n, item with its hash): its items by place, preimages of each level, top digest.

    A level is added while the whole tree has several nodes on it, so the last block has as many levels as the others.
    """
    size = fan**deep
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / size).cast("long").alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("items"))
    levels = sum((F.when(F.col("n") > fan**j, 1).otherwise(0) for j in range(deep)), F.lit(0))
    start = F.struct(F.transform("items", lambda x: x["item"]["hash"]).alias("row"), F.array().cast("array<array<string>>").alias("pre"))

    def level(acc: Column, _: Column) -> Column:
        row = acc["row"]
        pre = F.transform(F.sequence(F.lit(0), F.floor((F.size(row) - 1) / fan).cast("int")), lambda k: F.array_join(F.slice(row, k * fan + 1, fan), ""))
        return F.struct(F.transform(pre, lambda p: F.sha2(p, 256)).alias("row"), F.concat(acc["pre"], F.array(pre)).alias("pre"))

    built = F.aggregate(F.slice(F.array(*[F.lit(j) for j in range(deep)]), F.lit(1), levels), start, level)
    out = grouped.withColumn("built", built)
    top = F.floor((F.col("n") - 1) / size).cast("long") + 1
    return materialize(out.select("tree", "block", top.alias("n_next"), "items", F.col("built.pre").alias("pre"), F.col("built.row")[0].alias("top")), name)


def _inside(idx: Column, pre: Column, fan: int, deep: int) -> Column:
    """Path of a node in its block: for each level the parent's preimage and the node's own slot in it."""
    place = F.pmod(idx, F.lit(fan**deep))
    powers = F.array(*[F.lit(fan**j) for j in range(deep + 1)])
    return F.transform(pre, lambda row, j: F.struct(row[F.floor(place / powers[j + 1]).cast("int")].alias("pre"), F.pmod(F.floor(place / powers[j]), F.lit(fan)).cast("int").alias("slot")))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a digest leads to: it is spliced into each ancestor's preimage, whose digest goes on."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.overlay(p["pre"], h, p["slot"] * DIGEST + 1, F.lit(DIGEST)), 256))


def siblings(path: Column) -> Column:
    """Digests of a node's siblings, level by level, end to end."""
    return F.array_join(F.transform(path, lambda p: F.overlay(p["pre"], F.lit(""), p["slot"] * DIGEST + 1, F.lit(DIGEST))), "")


def _tree(nodes: DataFrame, fan: int, deep: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every pass and (tree, top) of numbered nodes; the number of passes comes from the largest tree's size."""
    passes = []
    while True:
        passes.append(_blocks(nodes, fan, deep, f"{name}-{len(passes)}"))
        most = passes[-1].agg(F.max("n_next")).first()[0]
        if most is None or most <= 1:
            return passes, passes[-1].select("tree", "top")
        nodes = passes[-1].select("tree", F.col("block").alias("idx"), F.col("n_next").alias("n"), F.struct(F.col("top").alias("hash")).alias("item"))


def _down(passes: list[DataFrame], above: DataFrame, fan: int, deep: int) -> DataFrame:
    """(tree, item, path) of the lowest nodes, from (tree, block, up) of the tops and the blocks on the way down."""
    for k, blocks in enumerate(reversed(passes)):
        joined = blocks.join(above, ["tree", "block"])
        path = lambda x: F.concat(_inside(x["idx"], F.col("pre"), fan, deep), F.col("up"))
        if k == len(passes) - 1:
            each = F.explode(F.transform("items", lambda x: F.struct(x["item"].alias("item"), path(x).alias("path"))))
            return joined.select("tree", each.alias("x")).select("tree", "x.item", "x.path")
        each = F.explode(F.transform("items", lambda x: F.struct(x["idx"].alias("block"), path(x).alias("up"))))
        above = joined.select("tree", each.alias("x")).select("tree", "x.block", "x.up")
    raise ValueError("no blocks")


def build(rows: DataFrame, values: Sequence[str], key: str, group: str, more: dict[str, Column] | None = None, fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """One row for each row: key, leaf, subroot, root, path (a parent's preimage and the own slot in it, from the leaf up) and `more`.

    A leaf is the digest of the values; leaves of a group ascend by key, groups by name (null first, by UTF-8 bytes). A null
    key comes first; rows of one key follow each other by leaf, and equal leaves are interchangeable. An empty table gives no
    rows. `more`: further columns computed from the rows, to be carried along. Other columns aren't read, whatever
    their names. Rows are read once; digests only are shuffled.
    """
    named = F.col(quoted(group)).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), named), F.lit("-"))  # "-" sorts before "="
    leaf = digest(*[F.col(quoted(v)) for v in values])
    item = F.struct(F.col(quoted(key)).alias("key"), leaf.alias("hash"), *[c.alias(name) for name, c in (more or {}).items()])
    # written down first: dealing them out by ranges looks at them twice
    leaves = materialize(rows.select(tree.alias("tree"), item.alias("item")), "digests")
    # equal rows are told apart by where they were read, so that ranges may part them
    spread = leaves.withColumn("k", F.col("item.key")).withColumn("h", F.col("item.hash")).withColumn("at", F.monotonically_increasing_id())
    numbered = _numbered(spread, ["k", "h", "at"]).drop("k", "h", "at")
    low, subroots = _tree(numbered, fan, deep, "blocks")
    subroots = materialize(subroots, "subroots")
    groups = _numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "top"), ["name"])
    high, root = _tree(groups.select("tree", "idx", "n", F.struct(F.col("top").alias("hash"), "name").alias("item")), fan, deep, "group-blocks")
    none = F.array().cast("array<struct<pre:string,slot:int>>")
    tops = _down(high, root.select("tree", F.lit(0).cast("long").alias("block"), none.alias("up")), fan, deep)
    tops = tops.join(root.select("tree", F.col("top").alias("root")), "tree")
    tops = materialize(tops.select(F.col("item.name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("path").alias("up"), F.col("item.hash").alias("subroot"), "root"), "tops")
    paths = _down(low, tops.select("tree", "block", "up"), fan, deep)
    # a group's digests are few; they meet its leaves in the end
    done = paths.join(tops.select("tree", "subroot", "root"), "tree")
    return done.select(F.col("item.key").alias(key), F.col("item.hash").alias("leaf"), "subroot", "root", "path", *[F.col(f"item.{name}").alias(name) for name in more or {}])


def verify(built: DataFrame, claimed: str, key: str) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256 (of all siblings), folded_root (from the claimed leaf) and verified."""
    folded = built.withColumn("folded_root", fold(F.col(claimed), F.col("path")))
    return folded.select(key, "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def audit(docs: DataFrame, fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """The manifest of documents by lang, with every proof checked against leaves of which some were tampered with.

    Where 7 divides the unsigned crc32 of the decimal doc_id, n_chars is one more in the checked leaf; a null n_chars or
    doc_id stays. Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = digest(*[F.when(hit, F.col(v) + 1).otherwise(F.col(v)) if v == "n_chars" else F.col(v) for v in values])
    # only tampered leaves are hashed twice
    return verify(build(docs, values, "doc_id", "lang", {"claimed": F.when(hit, changed)}, fan, deep).withColumn("claimed", F.coalesce("claimed", "leaf")), "claimed", "doc_id")
