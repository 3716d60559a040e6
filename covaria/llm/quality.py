"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus, and plain text rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covaria.llm.common import hash_words, mix64, slices, split_words

BUCKETS = 1 << 16
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Bins of the score from which the threshold is chosen, over [-SPAN, SPAN] nats a gram.
BINS, SPAN = 4000, 4.0
#: Trusted documents from which the target is learnt, at most (about).
TRUSTED = 50_000


def _grams(words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and word pairs, and the text each belongs to; pairs don't cross texts."""
    coded = words.dictionary_encode()
    h = hash_words(coded.dictionary)[coded.indices.to_numpy()]
    text = np.repeat(np.arange(len(counts)), counts)
    same = text[1:] == text[:-1]
    pair = mix64(h[:-1] * np.uint64(3) + h[1:])[same]
    return np.concatenate(((mix64(h) % np.uint64(BUCKETS)), pair % np.uint64(BUCKETS))).astype(np.int64), np.concatenate((text, text[1:][same]))


def trusted_ids(labels: DataFrame, good: str = "quality = 1", most: int = TRUSTED) -> np.ndarray:
    """Sorted ids of documents labelled good: all of them, or where they are more than `most` about that many, chosen by hash."""
    ids = labels.where(good).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    share = most / max(1, ids.count())
    if share < 1:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return np.sort(ids.toArrow().column("doc_id").to_numpy())


def train(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """Log ratio by bucket of the trusted target's multinomial to the raw corpus's.

    docs: doc_id and text, the raw corpus, of which all rows are counted; trusted: sorted ids of the target, of bounded
    number, so that they are broadcast and no text is shuffled. Counts have one row per bucket at most, which bounds what
    comes back. Null texts count as empty, repeated rows as often as they are there, and a null id is in no target; with an
    empty table or target all buckets of that multinomial are equally likely. Other columns aren't read.
    """
    known = docs.sparkSession.sparkContext.broadcast(trusted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for part in slices(batches):
            words, counts = split_words(part.column("text"))
            if not len(words):
                continue
            bucket, text = _grams(words, counts)
            mine = np.isin(pc.fill_null(part.column("doc_id"), -(2**63)).to_numpy(), known.value)[text]
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[mine], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "raw", "target"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    n = np.zeros((2, BUCKETS))
    for r in rows:
        n[0, r["bucket"]], n[1, r["bucket"]] = r["raw"], r["target"]
    smooth = 1.0
    logs = np.log((n + smooth) / (n.sum(axis=1, keepdims=True) + smooth * BUCKETS))
    return (logs[1] - logs[0]).astype(np.float32)


def _repeats(words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Words of each text in windows of WINDOW words that its text holds twice or more."""
    out = np.zeros(len(counts), dtype=np.int64)
    if not len(words):
        return out
    code = words.dictionary_encode().indices.to_numpy().astype(np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(code) - WINDOW + 1
    if n <= 0:
        return out
    h = text[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = mix64(h + code[k : n + k] + np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    mark = np.zeros(len(code) + 1, dtype=np.int64)
    w = np.flatnonzero(twice)
    np.add.at(mark, w, 1)
    np.add.at(mark, w + WINDOW, -1)
    return np.bincount(text[np.cumsum(mark)[:-1] > 0], minlength=len(counts))


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


def measure(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and llr.

    llr is the mean log ratio over the text's words and word pairs; a text without words has 0. Null text counts as
    empty. Repeated rows get equal results; an empty table gives no rows; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part in slices(batches):
            texts = pc.fill_null(part.column("text"), "")
            plain, counts = split_words(texts, lower=False)
            row = np.repeat(np.arange(len(counts)), counts)
            chars = np.bincount(row, weights=pc.utf8_length(plain).to_numpy(zero_copy_only=False), minlength=len(counts)).astype(np.int64)
            symbols = sum(pc.count_substring(texts, s).to_numpy(zero_copy_only=False).astype(np.int64) for s in SYMBOLS)
            llr = np.zeros(len(counts))
            if len(plain):
                bucket, text = _grams(pc.ascii_lower(plain), counts)
                llr = np.bincount(text, weights=table[bucket], minlength=len(counts)) / np.maximum(1, np.bincount(text, minlength=len(counts)))
            lines = np.fromiter(map(_dup_lines, texts.to_pylist()), dtype=np.int64, count=len(counts))
            columns = [counts, chars, symbols, lines, _repeats(plain, counts), llr]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *map(pa.array, columns)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def threshold(measured: DataFrame, labels: DataFrame, keep_weight: float = 10.0) -> float:
    """Score from which a document is kept: the bin edge with the best share of poor documents below it less
    `keep_weight` times the share of good ones, over all labelled documents.

    Labelled rows are counted by label and bin, so a bounded histogram comes back. Among equal edges the lowest wins.
    Without labels of both kinds, so with an empty table too, it is -SPAN, which keeps all.
    """
    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("llr") + SPAN) / (2 * SPAN) * BINS))).cast("int")
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = measured.select("doc_id", bin_of.alias("bin")).join(known, "doc_id").groupBy("quality", "bin").count().collect()
    n = np.zeros((2, BINS))
    for r in rows:
        n[int(r["quality"] > 0), r["bin"]] += r["count"]
    if not n.sum(axis=1).all():
        return -SPAN
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(n, axis=1)), axis=1)[:, :-1] / n.sum(axis=1, keepdims=True)
    return float(np.argmax(below[0] - keep_weight * below[1]) / BINS * 2 * SPAN - SPAN)


def judge(measured: DataFrame, least: float) -> DataFrame:
    """Add base_failed (under 20 words, or over 30% of them in repeated windows) and kept (llr at least `least`).

    A text whose llr ties with the threshold is kept. Rows and other columns stay as they are; an empty table stays empty.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= F.lit(least)))
