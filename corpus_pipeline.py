"""A corpus pipeline of five stages over `documents`: each takes the documents that its predecessor kept.

Quality rules, exact dedup, near-duplicate dedup, secret redaction, packing. Every stage's result is written as
Parquet in the shared folder and read again as the next one's input. All stages but the last return the columns of
`documents`; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import near, stored, table
from strataloom.llm.exact_dedup import exact_dedup
from strataloom.llm.minhash import near_duplicates
from strataloom.llm.packing import packed
from strataloom.llm.quality import judged, learn
from strataloom.llm.queries import vocabulary_file
from strataloom.llm.secrets import redacted


def _text_key() -> Column:
    """The text's digest, as exact_dedup gives it."""
    return F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", _text_key())


def _without(docs: DataFrame, verdicts: DataFrame, purpose: str) -> DataFrame:
    """docs without the rows that verdicts (doc_id, text_sha256, kept) reject.

    A verdict of these stages hangs on the row's id and text, so it acts on rows with both, and on rows without an id.
    """
    dropped = stored(verdicts.where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text")).distinct(), purpose)
    return docs.join(near(dropped), F.col("doc_id").eqNullSafe(F.col("_id")) & (_text_key() == F.col("_text")), "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned list rejects go."""
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged(_keyed(docs), rules, also=["text_sha256"]), "rejected")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; where none has an id, all stay."""
    return _without(docs, exact_dedup(docs), "copies")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; where none has an id, all stay."""
    return _without(docs, near_duplicates(_keyed(docs), also=["text_sha256"]), "near-copies")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows. Other documents stay as they are."""
    return redacted(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of all documents."""
    return packed(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicate_groups),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Tokenisation and learned rules are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
