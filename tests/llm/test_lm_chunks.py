"""Language-model scoring in chunks and parts: what it leaves on disk, and that neither cut shows in the scores."""

import math
import os

import numpy as np
from pyspark.sql import functions as F

from covaria.llm import lm
from covaria.sources import scratch
from tests.llm.test_operators import check_lm, docs, exact_scores  # noqa: F401  docs is a fixture


def written_since(many):
    """Bytes of the scratch tables written since there were so many."""
    paths = [p.removeprefix("file:") for p in scratch.WRITTEN[many:]]
    return sum(os.path.getsize(os.path.join(top, name)) for p in paths for top, _, names in os.walk(p) for name in names)


def test_less_is_written_than_there_is_text(docs):  # noqa: F811
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for options in ({}, {"filter_bytes": 0}):
        many = len(scratch.WRITTEN)
        assert len(lm.score(docs, **options).collect()) == docs.count()
        assert written_since(many) < size


def test_many_chunks_and_parts(docs):  # noqa: F811
    tokens, parts = sum(r["n_tokens"] for r in lm.score(docs).collect()), 20
    got = check_lm(docs.repartition(7, "doc_id"), part_bits=tokens * lm.ITEM_BITS // parts + 1)
    want = exact_scores(docs)
    errors = [r["score"] - want[r["doc_id"]] for r in got]
    assert abs(sum(errors)) / tokens < 0.02 and sum(map(abs, errors)) / tokens < 0.05


def test_hot_contexts(spark):
    # "the" comes before everything, so that its pairs are dealt with their second words
    made = spark.range(400).selectExpr("id AS doc_id", "concat('the w', id % 50, ' the v', id % 7, ' u', id, ' the') AS text")
    got = check_lm(made.repartition(3, "doc_id"), part_bits=1 << 11)
    want = exact_scores(made)
    assert sum(abs(r["score"] - want[r["doc_id"]]) for r in got) / sum(r["n_tokens"] for r in got) < 0.05
    kept = lm.chunks(made.select("doc_id", F.lit(False).alias("held_out"), "text")).select(F.explode("often.key")).distinct()
    the = lm.hash_words(lm.pa.array(["the"]))[0]
    assert int(the.view(np.int64)) in {r[0] for r in kept.collect()}


def test_short_texts_share_a_chunk_and_null_is_not_learned(spark):
    made = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "if(id = 5, NULL, concat('a b c', id % 10)) AS text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        kept = lm.chunks(made.select("doc_id", F.expr("if(doc_id < 10, NULL, false)").alias("held_out"), "text")).select("learned_texts", F.size("doc_id").alias("n")).collect()
        assert [tuple(r) for r in kept] == [(2990, 3000)]
        got = lm.score(made, F.expr("if(doc_id < 10, CAST(NULL AS boolean), false)")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["train_tokens"] for r in got} == {2990 * 4} and sum(r["held_out"] is None for r in got) == 10 and len(got) == 3000


def test_ids_of_any_kind(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for made in ("string(id)", "timestamp_seconds(id)", "named_struct('a', id)"):
            ids = spark.range(20).selectExpr(f"if(id = 7, NULL, {made}) AS doc_id", "concat('a b ', id) AS text")
            got = lm.score(ids, F.lit(False))
            assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in ids.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for values in (rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, 100, 1000).astype(np.uint8), np.zeros(0, dtype=np.int64)):
        assert (lm._unpacked(lm._packed(values), values.dtype) == values).all()
    places = np.array([5, 7, 7, 2, 2**30, 0])
    assert lm._steps(lm._ascending(places)).tolist() == places.tolist() and not len(lm._steps(lm._ascending(places[:0])))


def test_levels_of_counts_and_weights():
    n = np.array([0, 1, 2, 3, 10**9])
    want = [0, *(math.floor(math.log(k) / math.log(lm.BASE) + 1e-9) + 1 for k in n[1:])]
    assert lm._level(n).tolist() == want
    # 4 seen once each leave three quarters; a context that was never seen has weight 1
    back = lm._back_level(np.array([4, 0]), np.array([4, 0]))
    assert back.tolist() == [round(-math.log(0.75) / math.log(lm.BACK_BASE)), 0]
