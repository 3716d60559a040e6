"""Queries that apply each operator to its whole table, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from covaria.llm import chat, extract, fingerprint, language, lm, manifest, mixing, periods, pieces, quality, secrets, simhash, tokens
from covaria.llm.common import held_out, materialize, read
from covaria.llm.oracles import oracle_sql  # noqa: F401  the entry reads both from here


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out(4))
    found = language.identify(docs.select("doc_id", held_out(4).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(read(spark, sf_dir, "documents")))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ratios = quality.train(docs, quality.trusted_ids(labels))
    measured = materialize(quality.measure(docs, ratios), "measured")
    return quality.judge(measured, quality.threshold(measured, labels))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat.END}{chat.ROLE} ok {chat.BODY}"
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = materialize(chat.windows(given.unionByName(extra)), "windows")
    return chat.summary(formatted)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(read(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.summary(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.summary(read(spark, sf_dir, "documents"))


QUERIES = (
    op1_mix_sources, op2_language_id, op3_secret_scan, op4_simhash_dedup, op5_html_extract, op6_sentencepiece, op7_lm_score, op8_quality_rules, op9_chat_format,
    op10_fingerprints, op11_token_counts, op12_merkle_manifest, op13_periodic_runs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
