"""From documents to token ids: language ID, near-dedup, secret scans, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
result of each is written as Parquet in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.llm import language, mixing, pieces, secrets, simhash
from covaria.llm.common import held_out, materialize, quoted, read, unused

#: Mean posterior of the words in their own labelled spans below which a language is taken as unknown.
LEAST_SURE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows that aren't held out; drop documents without a letter or a recognised language.

    The predicted language becomes `lang` where that is null; a label that is there stays. A text in several languages
    is recognised where its words fit the spans that they are in; words of a script that no learned language uses fit none.
    Where nothing could be learned, texts with letters stay. Null texts go, repeated rows stay or go together, an empty
    table stays empty, and other columns stay whatever their names.
    """
    model = language.train(docs, ~held_out(4))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = tuple(unused(c, docs) for c in ("lang_pred", "score", "sure", "spans"))
    found = language.identify(docs, model, names=names)
    kept = found.where((F.col(names[0]) != "und") & (F.col(names[2]) >= LEAST_SURE))
    return kept.select(*[F.coalesce("lang", names[0]).alias("lang") if c == "lang" else F.col(quoted(c)) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group whose five-word shingles are at Jaccard 0.8 or more.

    Texts without words are one group. Rows without an id stay, a repeated row once; other columns stay.
    """
    return simhash.keep_one_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets that look live; widely copied examples and all other text stay, and so do all documents.

    A null text stays null, repeated rows are cut alike, other columns stay.
    """
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; the one in which a source's quota ends is cut at a word.

    Documents without words aren't in the mix, null sources are one source, and ties go by id and text.
    """
    return mixing.apply(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every row; decoding gives the text again. A null text counts as empty."""
    return pieces.summary(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("token_ids", token_ids)]

#: SQL can't express the stages (trained models, XXH64); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
