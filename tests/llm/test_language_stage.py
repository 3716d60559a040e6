"""The pipeline's language stage on texts in several languages, and without labels."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline


def test_texts_in_several_languages_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs = sorted(r["lang"] for r in docs.select("lang").where("lang IS NOT NULL").distinct().collect())
    spans = [" ".join(docs.where((F.col("lang") == x) & (F.col("n_chars") > 1500)).orderBy("doc_id").first()["text"].split()[:60]) for x in langs]
    assert len(langs) == 4
    row = docs.limit(1).select(F.lit(-1).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(" ".join(spans)).alias("text"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    junk = row.select(F.lit(-2).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit("12 34 !!").alias("text"), *[c for c in docs.columns if c not in ("doc_id", "text")])
    both = docs.unionByName(row.withColumn("lang", F.lit(None).cast("string"))).unionByName(junk.withColumn("lang", F.lit(None).cast("string")))
    out = pipeline.language_id(spark, both, sf_dir)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.where("doc_id < 0").collect()} == {-1}


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "plain words", None), (2, "日本語", None), (3, "12 34 !!", None), (4, "", None), (5, None, None)]
    out = pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted((r["doc_id"], r["lang"]) for r in out.collect()) == [(1, None), (2, None)]
