"""Helpers that the training-data operators share: scratch tables, batch slicing and word splitting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.sources.scratch import materialize  # noqa: F401  operators take it from here

#: White space that separates words, and the words themselves, as Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python task holds as arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows up to which a table may be broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger table is left to a shuffle join that AQE splits where skewed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words of texts (nulls: none) in one flat array, and their number in each text.

    A-Z are lowered if asked for; other letters stay as they are.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    words = flat.filter(full)
    # the words are lowered and not the texts: PyArrow 23's ascii_lower reads other rows' bytes where an array is a slice
    return pc.ascii_lower(words) if lower else words, np.bincount(row[keep], minlength=len(texts)).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """XXH64 of each word, unsigned; call it on distinct words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words))


def held_out(modulus: int, remainder: int = 2, key: str = "doc_id"):
    """True where crc32 of the key as text leaves the remainder; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def quoted(name: str) -> str:
    """A column's name as Spark reads it back, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def with_arrays(docs: DataFrame, columns: tuple[str, ...], added: dict[str, str], make, limit: int = SLICE_BYTES, keep: Sequence[str] | None = None) -> DataFrame:
    """Add columns (name → type) that a function of Arrow arrays gives; columns of these names, whatever the case, go.

    make() is called once a task and returns a function from the given columns' arrays (the last one is the text, by which
    batches are cut) to a list of new arrays. The other columns (or those of them in keep) pass by under plain names, so
    theirs may hold anything; a given column that stays is sent once.
    """
    gone = {c.lower() for c in added}
    stay = [c for c in docs.columns if c.lower() not in gone and (keep is None or c in keep)]
    passed = [f"c{i}" for i in range(len(stay))]
    at = dict(zip(stay, passed, strict=True))
    used = [at.get(c, f"in{i}") for i, c in enumerate(columns)]
    more = [F.col(quoted(c)).alias(u) for c, u in zip(columns, used, strict=True) if c not in at]
    plain = docs.select(*[F.col(quoted(c)).alias(n) for c, n in at.items()], *more)
    schema = plain.select(*passed, *[F.lit(None).cast(kind).alias(f"new{i}") for i, kind in enumerate(added.values())]).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for part in slices(batches, used[-1], limit):
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in passed], *compute(*[part.column(c) for c in used])], names=names)

    return plain.mapInArrow(run, schema).toDF(*stay, *added)
