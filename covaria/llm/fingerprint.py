"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.llm.common import SLICE_BYTES, broadcast_if_small, hash_words, materialize, mix64, slices, split_words, with_arrays

SAMPLES = 128
#: Samples drawn at once, which bounds the table of draws for a slice's terms.
AT_ONCE = 16
#: Ranges of doc_id into which documents are dealt, at most; their heads come back to the driver as numbers.
MOST_RANGES = 20_000
U64 = np.uint64


def _uniforms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) of 32 bits from each hash."""
    halves = h.view(np.uint32).reshape(-1, 2)
    return (halves[:, 1] + 0.5) * 2.0**-32, (halves[:, 0] + 0.5) * 2.0**-32


def _drawn(name: np.ndarray, log_w: np.ndarray, k: int) -> np.ndarray:
    """Draws of AT_ONCE samples from k on for words of a log weight: 32 bits in the order of a, then 32 that name (term, t).

    Drawn are exponentials x, g and f: c = x + g, r = ln(c / x) + f and b = f / r have the joint distribution of two numbers
    from Gamma(2, 1) and a uniform one, and a = c / (y exp(r)) = x exp(-r t). For weight 1, t is 0 and a is x, whose
    distribution function is uniform: the order of a is kept as 1 - exp(-a), which is then the hash itself.
    """
    drawn = np.empty((AT_ONCE, len(name)), dtype=np.uint64)
    heavy = np.flatnonzero(log_w)
    for j in range(AT_ONCE):
        salt = U64((k + j + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
        for lo in range(0, len(name), 8192):
            drawn[j, lo : lo + 8192] = mix64(name[lo : lo + 8192] + salt)
        for lo in range(0, len(heavy), 8192):
            at = heavy[lo : lo + 8192]
            h = drawn[j, at]
            x = -np.log1p(-_uniforms(h)[0])
            u, v = _uniforms(mix64(h + U64(0x9E3779B97F4A7C15)))
            f = -np.log(v)
            r = np.log1p(-np.log(u) / x) + f
            t = np.floor((log_w[at] + f) / r)
            term = (h + t.astype(np.int64).view(np.uint64) * U64(0x9E3779B1)) & U64(0xFFFFFFFF)
            drawn[j, at] = ((-np.expm1(-x * np.exp(-r * t)) * 2.0**32).astype(np.uint64) << U64(32)) | term
    return np.ascontiguousarray(drawn.T)


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """Signatures (texts, samples) of 16-bit values; weighted terms are the text's words (A-Z lowered), weights their counts.

    Sample k of a term of weight w draws r and c from Gamma(2, 1) and b uniformly, all from the term and k alone;
    t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)). The term with the least a stands for the text,
    as (term, t). Two texts agree on a sample with probability sum(min) / sum(max) of their weights. A text without
    words has the empty word as its only term.
    """
    words, counts = split_words(texts)
    row = np.repeat(np.arange(len(counts)), counts)
    coded = words.dictionary_encode()
    names = hash_words(coded.dictionary)
    many = len(names) + 1
    names = np.append(names, U64(0x9AE16A3B2F90404F))
    code = coded.indices.to_numpy().astype(np.int64)
    empty = np.flatnonzero(counts == 0)
    key, tf = np.unique(np.concatenate((row * many + code, empty * many + many - 1)), return_counts=True)
    row, code = key // many, key % many
    # draws depend on (word, count) only, so each distinct one is drawn once for the slice
    top = int(tf.max(initial=1)) + 1
    kinds, at = np.unique(code * top + tf, return_inverse=True)
    name, log_w = names[kinds // top], np.log(kinds % top)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    out = np.empty((len(counts), samples), dtype=np.uint16)
    for k in range(0, samples, AT_ONCE):
        drawn = _drawn(name, log_w, k)[:, : samples - k]
        for lo in range(0, len(first), 64):
            hi = min(lo + 64, len(first))
            a, b = first[lo], first[hi] if hi < len(first) else len(at)
            out[lo:hi, k : k + AT_ONCE] = np.minimum.reduceat(drawn[at[a:b]], first[lo:hi] - a, axis=0).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _hex(s: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in s]


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Add `fingerprint`, a hex string of 4 digits for each sample, in place of a column of that name in any case.

    Null text counts as empty; equal texts agree. Every row stays; an empty table gives no rows.
    """
    return with_arrays(docs, ("text",), {"fingerprint": "string"}, lambda: lambda texts: [pa.array(_hex(signatures(texts, samples)))])


def with_next(docs: DataFrame, rows_per_range: int = 500, ranges_per_task: int = 4) -> DataFrame:
    """Deal documents out by ranges of descending doc_id, so that a task sees each document beside its next one.

    The first document of each range is sent to the range before it as well (guest = 1), and the first of all to the
    last. Cut points are quantiles of doc_id, one for about `rows_per_range` rows and MOST_RANGES at most (a range is
    sorted and read as a stream, so it may be long); `ranges_per_task` neighbours share a task. Texts are shuffled once.
    Rows of one doc_id follow each other by text. Null ids come last, dealt to ranges of their own by a hash of the text.
    Columns: range, guest, doc_id, text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total, known = ids.agg(F.count("*"), F.count("doc_id")).first()
    n, unnamed = (min(MOST_RANGES, max(1, round(x / rows_per_range))) for x in (known, total - known))
    cuts = sorted({int(c) for c in (ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else [])}, reverse=True)
    sent = docs.sparkSession.sparkContext.broadcast(np.array([-c for c in cuts], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids):
        return ids.__class__(np.searchsorted(sent.value, -ids.to_numpy(dtype=np.int64), side="left").astype(np.int32))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = range_of(F.coalesce("doc_id", F.lit(0))) if cuts else F.lit(0)
    ranged = rows.withColumn("range", F.when(F.col("doc_id").isNull(), len(cuts) + 1 + F.pmod(F.xxhash64("text"), F.lit(unnamed)).cast("int")).otherwise(named))
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))
    heads = materialize(
        ranged.join(broadcast_if_small(tops), "range").where("doc_id <=> top").groupBy("range").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("h")), "heads"
    )
    order = [r["range"] for r in heads.select("range").orderBy("range").collect()]
    before = docs.sparkSession.createDataFrame([(a, order[i - 1]) for i, a in enumerate(order)], "range int, to int")
    guests = heads.join(F.broadcast(before), "range").select(F.col("to").alias("range"), F.lit(1).alias("guest"), "h.doc_id", "h.text")
    both = ranged.select("range", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests)
    tasks = max(1, math.ceil((order[-1] + 1 if order else 1) / ranges_per_task))
    dealt = both.repartitionById(tasks, F.floor(F.col("range") / ranges_per_task).cast("int"))
    return dealt.sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")


def edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per document with the fingerprints of its text and its edited text, and the likeness of both and of the next.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as many (or all)
    of the next document's in descending doc_id; the first document follows the last. A table of one document has that
    as its own next one. Null text counts as empty; rows of one doc_id follow each other by text, rows without an id come
    last; an empty table gives no rows. Columns beside doc_id and text aren't read. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next one isn't seen yet
        for part in slices(batches, limit=SLICE_BYTES // 2):
            if held is not None:
                part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
            held = part.slice(part.num_rows - 1)
            if part.num_rows < 2:
                continue
            texts = part.column("text").to_pylist()
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
            # both at once: most words of the edited texts are in the texts too, and are drawn once
            both = signatures(pa.array(texts + edited, pa.large_string()), samples)
            own, changed = both[: len(texts)], both[len(texts) :]
            real = np.flatnonzero(part.column("guest").to_numpy()[:-1] == 0)
            n_chars = pc.utf8_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(real)), n_chars.take(pa.array(real)),
                pa.array([hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest() for i in real]),
                pa.array(_hex(own[real])), pa.array(_hex(changed[real])),
                pa.array(likeness(own[real], changed[real])), pa.array(likeness(own[real], own[real + 1])),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(run, schema)
