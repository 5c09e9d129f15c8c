"""Token counts through a cache keyed by content and tokenizer digests."""
from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import ship

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
#: Entries a worker's memo of words may hold before it starts anew.
MEMO = 100_000
#: Longer words are counted each time: few of them come again, and they would fill the memo.
MEMO_BYTES = 64


def normalised(text: Column) -> Column:
    """White-space runs become one space, none at the ends; null becomes empty.

    The tokenizer drops white space between words, so equal normalised texts have equal counts.
    """
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def tokenizer_digest(definition: str) -> str:
    """Version of a tokenizer: digest of its whole definition."""
    return hashlib.sha256(definition.encode()).hexdigest()


class WordCounts(dict):
    """Counts of the words seen lately, in two generations of at most ``MEMO`` entries each."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.old: dict[bytes, int] = {}

    def learn(self, words: list[bytes]) -> None:
        new = []
        for w in set(words):
            if w not in self:
                if w in self.old:
                    self[w] = self.old[w]
                else:
                    new.append(w)
        for i in range(0, len(new), 1024):
            some = new[i : i + 1024]
            self.update(zip(some, self.counts(some)))

    def counts(self, words: list[bytes]) -> list[int]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)
        return list(map(len, found))

    def total(self, words: list[bytes]) -> int:
        long = [w for w in words if len(w) > MEMO_BYTES]
        if long:
            words = [w for w in words if len(w) <= MEMO_BYTES]
        self.learn(words)
        n = sum(map(self.__getitem__, words)) + sum(sum(self.counts(long[i : i + 1024])) for i in range(0, len(long), 1024))
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        return n


@lru_cache(maxsize=2)
def _tokenizer(definition: str) -> WordCounts:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordCounts(Tokenizer.from_str(definition))


def count_tokens(text: str, definition: str) -> int:
    """Tokens of a text for a tokenizer that lower-cases and drops white space: the sum over its words.

    Splits at ASCII white space only; whatever else is in a word (other spaces, special
    strings) is left to the library. A-Z is lowered first, except where a special string
    could arise from it.
    """
    data = text.encode("utf-8", "surrogatepass")
    return _tokenizer(definition).total((data if b"<|" in data else data.lower()).split())


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored counts, one row per pair of digests; empty before the first append."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return rows.groupBy("content_digest", "tokenizer_digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_documents(docs: DataFrame, definition: str, cache_path: str, limit: int, text: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    ``definition`` is the JSON text of a ``tokenizers`` tokenizer that drops white space.
    Distinct contents without a stored count are encoded once and appended to the cache (a
    Parquet table, appended by one atomic commit; two runs that append the same digest store
    the same count), then every row looks its count up. Texts move once, one per distinct
    content: copies combine before the shuffle. Null texts count as empty. An added column
    replaces one of the same name.
    """
    spark = ship(docs.sparkSession)
    version = tokenizer_digest(definition)
    shipped = spark.sparkContext.broadcast(definition)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([count_tokens(t, shipped.value) for t in part], dtype="int64")

    content = normalised(F.col(text))
    distinct = (
        docs.select(content.alias("content"))
        .withColumn("content_digest", F.sha2("content", 256))
        .groupBy("content_digest")
        .agg(F.first("content").alias("content"))
    )
    stored = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    misses = distinct.join(stored.select("content_digest"), "content_digest", "left_anti")
    misses.select("content_digest", F.lit(version).alias("tokenizer_digest"), count("content").alias("n_tokens")).write.mode("append").parquet(
        cache_path
    )
    counts = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version).select(
        F.col("content_digest").alias("_digest"), F.col("n_tokens").alias("_tokens")
    )
    added = ("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in docs.columns if c.lower() not in added]
    keyed = docs.select(
        *rest, F.sha2(content, 256).alias("_digest"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("_bytes")
    )
    return keyed.join(counts, "_digest", "left").select(
        *rest,
        F.col("_bytes").alias("n_bytes"),
        F.col("_tokens").alias("n_tokens"),
        (F.col("_tokens") > limit).alias("over_limit"),
    )
