"""Registered queries of the corpus operators and their SQL twins."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    byte_bpe,
    importance,
    mixing,
    quality,
    repetition,
    secret_scan,
    simhash,
    token_counts,
    toxicity,
    tree_forest,
    url_rules,
    whitening,
    wrappers,
)
from leafmill.llm.common import is_held_out, shared_folder, table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNT_TOKENIZER = "word_bpe_49k.json"
#: URL rules: sites first, patterns for the rest.
RULES = (*url_rules.SITES, *url_rules.PATTERNS)
#: Labelled documents that the toxicity model learns from, at most.
TOXICITY_SAMPLE = 12_000
#: Labelled documents that the quality model learns from, at most.
QUALITY_SAMPLE = 60_000


def byte_ranks() -> bytes:
    with open(public_tokenizers.path(BYTE_RANKS), "rb") as f:
        return f.read()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labelled rows that are not held out, with the offending sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~is_held_out())
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, "toxic", TOXICITY_SAMPLE, "doc_id", "text"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted", "offending")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes; whole texts, null as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.token_digests(docs, byte_ranks(), public_tokenizers.PATTERN).drop("text")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and guessed spans of every document; the dictionary of the guesses is learned from all of them."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call starts a cache of its own, so that it counts all contents of the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path(COUNT_TOKENIZER), encoding="utf-8") as f:
        definition = f.read()
    return token_counts.count_documents(docs, definition, shared_folder(spark, "token-cache"), 2048).drop("text")


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the length of the longest repeat, which the SQL twin, made of windows, does not know."""
    return repetition.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "longest_repeat")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each row."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.component_rows(table(spark, sf_dir, "documents"))


def op8_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the wrapper of its host."""
    pages = wrappers.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    """Learned from labelled rows that are not held out."""
    return quality.fit(quality.labelled_statistics(docs, labels.where(~is_held_out()), "quality", QUALITY_SAMPLE, "doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op10_tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector."""
    return tree_forest.link_vectors(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long, null where the exact number, also given, does not fit one."""
    white = whitening.whiten_vectors(table(spark, sf_dir, "embeddings"))
    short = F.when(F.col("deviation") <= F.lit((1 << 63) - 1), F.col("deviation")).cast("long")
    return white.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", short)


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site rules of the contract, and the patterns for all other URLs."""
    return url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the benchmark texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "benchmark").select("text")).drop("n_words")


QUERIES = {
    f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_secret_scan, op4_token_counts, op5_repetition, op6_mixing, op7_simhash, op8_html_wrappers, op9_quality, op10_tree_forest, op11_whitening, op12_url_rules, op13_importance)
}
SQL: dict[str, str] = {"op5_repetition": repetition.SQL, "op6_mixing": mixing.SQL, "op12_url_rules": url_rules.sql_twin(RULES), "op13_importance": importance.SQL}
