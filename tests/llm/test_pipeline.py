"""Stages of the corpus pipeline, each judged on its own input."""

from collections import Counter

import corpus_pipeline as pipeline
from tests.llm import brute
from tests.llm.test_similar import kept_ids


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mix", "token_ids"]
    made = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        given = docs.collect()
        if name != "token_ids":
            assert out.columns == docs.columns
        if name == "language_id":
            gone = {r["doc_id"] for r in given} - {r["doc_id"] for r in rows}
            assert all(len([c for c in (r["text"] or "") if c.isalpha()]) < 40 for r in given if r["doc_id"] in gone)
        elif name == "near_dedup":
            want = kept_ids([(r["doc_id"], r["text"]) for r in given])
            assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
        elif name == "secret_scan":
            assert len(rows) == len(given) and sum("[secret]" in r["text"] for r in rows) <= len(rows) / 2
        elif name == "source_mix":
            sizes, taken = Counter(), Counter()
            for r in given:
                sizes[r["source"]] += len(brute.words(r["text"]))
            for r in rows:
                taken[r["source"]] += len(brute.words(r["text"]))
            want = brute.mix_targets(sizes)
            assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        else:
            assert len(rows) == len(given) and all(r["round_trip"] for r in rows)
        made[name] = len(rows)
        docs = out.cache() if name != "token_ids" else docs
    assert pipeline.run(spark, sf_dir).count() == made["token_ids"]
