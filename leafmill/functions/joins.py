"""Substring joins without a nested loop."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    count = F.length(text) - size + 1
    return F.when(
        count > 0,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))),
    ).otherwise(F.array().cast("array<string>"))


def substring_join(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """Pairs (needle row, hay row) where ``text`` contains ``needle``, exact.

    Every needle is looked up through one of its three-letter grams (shorter
    needles: the needle itself), the one that occurs in the fewest texts; grams
    that occur nowhere rule the needle out. The candidates are then verified.
    Needles should be distinct before they come here.
    """
    known = hay.withColumn("_id", F.xxhash64(text))
    sizes = range(1, GRAM + 1)
    # a text's grams travel with its number only; texts come back for the candidates
    texts = known.select("_id", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col(text), k) for k in sizes])))).alias("_gram")).distinct()
    counts = texts.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length(needle) < GRAM, F.array(F.col(needle))).otherwise(_grams(F.col(needle), GRAM))
    keyed = needles.where(F.length(needle) > 0).withColumn("_gram", F.explode(own))
    rated = keyed.join(counts, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = rated.groupBy(*needles.columns).agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.min("_n").alias("_n"))
    candidates = rarest.where("_n > 0").drop("_n").join(texts, "_gram").drop("_gram")
    return candidates.join(known, "_id").where(F.contains(F.col(text), F.col(needle))).drop("_id")
