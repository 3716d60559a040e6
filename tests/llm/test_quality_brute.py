"""Ratios, threshold and verdicts of the quality rules by plain Python."""

import math

import numpy as np
import pytest

from covaria.llm import quality
from tests.llm import brute

MASK = (1 << 64) - 1


def mix(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * by & MASK
    return x ^ (x >> 31)


def grams(text):
    import xxhash

    h = [xxhash.xxh64_intdigest(w.encode()) for w in brute.words(brute.lower(text))]
    return [mix(x) % quality.BUCKETS for x in h] + [mix(a * 3 + b & MASK) % quality.BUCKETS for a, b in zip(h, h[1:], strict=False)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)


def test_ratios_and_scores(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    trusted = np.array(sorted(r["doc_id"] for r in rows)[::3])
    n = np.zeros((2, quality.BUCKETS))
    for r in rows:
        for g in grams(r["text"]):
            n[0, g] += 1
            n[1, g] += r["doc_id"] in set(trusted.tolist())
    want = np.log((n[1] + 1) / (n[1].sum() + quality.BUCKETS)) - np.log((n[0] + 1) / (n[0].sum() + quality.BUCKETS))
    ratios = quality.train(docs, trusted)
    assert np.allclose(ratios, want, atol=1e-5)
    for r in quality.measure(docs, ratios).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        g = grams(text)
        assert math.isclose(r["llr"], want[g].mean() if g else 0.0, abs_tol=1e-5)
    assert (quality.train(docs.limit(0), trusted) == 0).all() and quality.measure(docs.limit(0), ratios).count() == 0


def test_threshold_and_verdict(spark):
    """Every edge is tried on all labelled rows; ties at the threshold are kept, base failures never."""
    rng = np.random.default_rng(0)
    good = rng.random(300) < 0.6
    llr = np.where(good, rng.normal(0.4, 0.5, 300), rng.normal(-0.6, 0.5, 300))
    words = rng.integers(10, 60, 300)
    repeats = rng.integers(0, 20, 300)
    measured = spark.createDataFrame([(i, float(llr[i]), int(words[i]), int(repeats[i])) for i in range(300)], "doc_id long, llr double, n_words long, n_repeat_words long")
    labels = spark.createDataFrame([(i, int(good[i])) for i in range(250)] + [(251, None), (999, 1)], "doc_id long, quality int")
    least = quality.threshold(measured, labels)
    width = 2 * quality.SPAN / quality.BINS
    gain = []
    for k in range(quality.BINS):
        edge = k * width - quality.SPAN
        below = np.floor((llr[:250] + quality.SPAN) / (2 * quality.SPAN) * quality.BINS) < k
        gain.append(((below & ~good[:250]).sum() / (~good[:250]).sum() - 10 * (below & good[:250]).sum() / good[:250].sum(), -edge))
    assert math.isclose(least, -max(gain)[1], abs_tol=1e-9)
    for r in quality.judge(measured.union(spark.createDataFrame([(7777, least, 50, 0)], measured.schema)), least).collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= least) and (r["doc_id"] != 7777 or r["kept"])
    assert quality.threshold(measured, labels.where("quality = 1")) == -quality.SPAN == quality.threshold(measured.limit(0), labels)
