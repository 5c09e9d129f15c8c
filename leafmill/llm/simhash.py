"""SimHash near-duplicates through an inverted index of byte positions."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, free_name, ship, split_words, stored
from leafmill.llm.components import connected_components

BYTES = 8


def fingerprint(text: str, size: int = 4) -> int:
    """SimHash of one text: words lower-cased (A-Z) and joined by spaces in shingles of ``size``.

    A text of fewer words is one shingle, one without words has fingerprint 0. A bit is set
    if it is set in over half of the shingles' XXH64 (seed 42), repeats included.
    """
    import xxhash

    words = [w.lower() for w in split_words(text)]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    at = 0
    starts, ends = [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):  # a long text needs no more memory than a block of bits
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", size: int = 4) -> DataFrame:
    """Adds ``out``: the fingerprint as a signed 64-bit integer. Null texts have no words."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(t or "", size) for t in part], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, run.asNondeterministic()(F.col(text)))


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _mask(places: tuple[int, ...]) -> int:
    """Signed 64-bit mask of whole bytes."""
    m = sum(0xFF << (8 * p) for p in places)
    return m - (1 << 64) if m >= 1 << 63 else m


def link_fingerprints(fps: DataFrame, fp: str = "fp", distance: int = 4, heavy: int = 1024) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints that join exactly what bits within ``distance`` join.

    Two values that differ in at most ``distance`` = 4 bits differ in at most 4 of their 8
    bytes, so they share at least 4 positional bytes: the guaranteed minimum. The index
    therefore lists each value under every choice of 4 byte positions with their content (70
    postings, each as selective as 32 bits) instead of single bytes, whose postings would
    hold a 256th of all values. A pair that meets in a posting shares these 4 positions, so a
    tally of shared positions is implied and filters nothing; a pair is kept at one posting
    only, that of its first 4 shared positions, and verified on all 64 bits.

    A posting with more than ``heavy`` values (a crowd of near copies) is not paired: each
    value is listed under all points within 2 bits of it in the 32 free bits (529). Two values
    within 4 bits have such a point in common, and all values at one point (at most 529) are
    within 4 bits of each other, so each is linked to the smallest there. That is exact as
    well, and linear.
    """
    if distance != 4:
        raise ValueError("the index is laid out for 4 bits")
    least = BYTES - distance
    choices = list(combinations(range(BYTES), least))
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), F.col(fp).bitwiseAND(F.lit(_mask(c))).alias("k")) for i, c in enumerate(choices)])
    postings = fps.select(F.col(fp).alias("fp"), F.explode(keys).alias("p")).select("fp", "p.c", "p.k")
    crowds = cut(postings.groupBy("c", "k").count().where(F.col("count") > heavy).select("c", "k"))
    light = postings.join(crowds, ["c", "k"], "left_anti") if crowds.take(1) else postings

    # Spark sizes the 70 postings of a value as one row, and would send all of them through the driver
    other = light.select(F.col("c").alias("c2"), F.col("k").alias("k2"), F.col("fp").alias("fp2")).hint("merge")
    difference = F.col("fp").bitwiseXOR(F.col("fp2"))
    shared = [F.when(_byte(difference, i) == 0, 1).otherwise(0) for i in range(BYTES)]
    tally = sum(shared[1:], shared[0])
    # of the shared positions, the first 4: the posting counts only if no shared position outside it comes before its last
    last = F.element_at(F.array(*[F.lit(max(c)) for c in choices]), F.col("c") + 1)
    earlier = sum([F.when(F.lit(i) <= last, s).otherwise(0) for i, s in enumerate(shared)][1:], F.when(last >= 0, shared[0]).otherwise(0))
    pairs = light.join(
        other,
        (F.col("c") == F.col("c2")) & (F.col("k") == F.col("k2")) & (F.col("fp") < F.col("fp2"))
        & (F.bit_count(difference) <= distance) & (tally >= least) & (earlier == least),
    ).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    if light is postings:
        return pairs

    free = [[8 * p + b for p in range(BYTES) if p not in c for b in range(8)] for c in choices]

    @F.pandas_udf("array<long>")
    def around(place: pd.Series, value: pd.Series) -> pd.Series:
        balls = {}
        rows = []
        for c, v in zip(place, value):
            ball = balls.get(c)
            if ball is None:
                bits = [1 << b for b in free[c]]
                flips = [0, *bits, *[x | y for x, y in combinations(bits, 2)]]
                ball = balls[c] = np.array(flips, dtype=np.uint64).view(np.int64)
            rows.append(np.int64(v) ^ ball)
        return pd.Series(rows, dtype=object)

    crowd = postings.join(crowds, ["c", "k"], "left_semi")
    points = crowd.select("c", "k", "fp", F.explode(around("c", "fp")).alias("point"))
    hub = F.min("fp").over(Window.partitionBy("c", "k", "point"))
    return pairs.union(points.select("fp", hub.alias("b")).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents with ``fp``, written once, and ``fp, component_id`` of every distinct fingerprint.

    Without ``with_text`` the documents come back without their texts, which are then not written.

    Exact copies meet first, by an aggregate that combines before the shuffle; links are then
    sought between distinct fingerprints only. ``component_id`` is the smallest ``doc_id`` of
    all documents that links reach (null ids are never the smallest). Texts without words
    have fingerprint 0 and link like any other. An empty table gives two empty frames.
    """
    name = free_name(docs, "fp")
    known = add_fingerprints(docs, text, name)
    known = stored(known if with_text else known.drop(text), "simhash")
    own = known.groupBy(F.col(name).alias("fp")).agg(F.min(doc_id).alias("low"))
    own = cut(own)
    roots = connected_components(link_fingerprints(own), "a", "b").withColumnRenamed("node", "fp")
    rooted = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return known, cut(rooted.join(low, "root").select("fp", "component_id", "root"))


def component_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; fingerprint as 16 lowercase hex digits."""
    known, classes = near_duplicate_classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), with_text=False)
    slim = known.select("doc_id", "fp")
    return slim.join(classes.select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with one document of each class: the smallest id, of equal ids the smallest fingerprint, once.

    Columns are those of ``docs``.
    """
    name = free_name(docs, "fp")
    known, classes = near_duplicate_classes(docs, doc_id, text)
    keys = known.select(F.col(name).alias("fp"), F.col(doc_id).alias("id")).distinct().join(classes.select("fp", "root"), "fp")
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("first"))
    keep = first.select(F.col("first.id").alias("id"), F.col("first.fp").alias("fp"))
    kept = known.join(keep, known[doc_id].eqNullSafe(keep["id"]) & (known[name] == keep["fp"]), "left_semi")
    return kept.dropDuplicates([doc_id, name]).select(*docs.columns)
