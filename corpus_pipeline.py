"""Corpus pipeline over ``documents``: quality, near-duplicates, secrets, mix of sources, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written as Parquet
in the shared folder and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; the last returns token ids.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import byte_bpe, mixing, quality, secret_scan, simhash
from leafmill.llm.common import free_name, stored, table
from leafmill.llm.queries import byte_ranks, quality_model

#: Documents with a lower quality score go.
LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below ``LEAST_SCORE``; the model learns from the labels of this input."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return docs.withColumn(score, quality.score_column(docs, model)).where(F.col(score) >= LEAST_SCORE).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash near-duplicates, the one with the smallest id."""
    return simhash.one_of_each_class(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; ``n_chars`` follows the text. No document goes."""
    redacted = secret_scan.redact_documents(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: never, once or twice."""
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, token_ids`` (packed, little-endian unsigned 32-bit) and digests of ids and decoded bytes."""
    return byte_bpe.round_trip(docs.select("doc_id", "source", "text"), byte_ranks(), public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix),
    ("byte_bpe", encode),
]

#: SQL expresses neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
