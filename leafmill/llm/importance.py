"""Target-distribution importance resampling: hashed n-gram gains, noisy scores, the best by a distributed quickselect."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, ship, stored

#: Pivots of one round of the selection.
PIVOTS = 32
#: Distinct features whose bucket a task remembers.
MEMO = 1 << 18
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Bucketer:
    """Words and n-gram buckets of texts, with a bounded memo."""

    def __init__(self, ngrams: int, buckets: int):
        self.ngrams, self.buckets = ngrams, buckets
        self.memo: dict[bytes, int] = {}

    def features(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature: crc32 of its UTF-8 bytes modulo the number of buckets."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        found: list[int] = []
        if len(self.memo) > MEMO:
            self.memo.clear()
        for n in range(1, self.ngrams + 1):
            grams = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            for g in grams:
                b = self.memo.get(g)
                if b is None:
                    b = self.memo[g] = zlib.crc32(g) % self.buckets
                found.append(b)
        return len(words), np.array(found, dtype=np.int64)


def bucket_counts(texts: DataFrame, text: str, ngrams: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts; every task gives one row per bucket it met."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Bucketer(ngrams, buckets)
        total = np.zeros(buckets, dtype=np.int64)
        for part in parts:
            for t in part["text"]:
                total += np.bincount(reader.features(t)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": met.astype(np.int32), "n": total[met]})

    counted = texts.select(F.col(text).alias("text")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to source frequency of each bucket, each count plus one, rounded down."""
    b, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, ngrams: int, text: str = "text") -> Column:
    """``n_words, n_features, weight``: the floored mean gain of a text's features, 0 without any."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Bucketer(ngrams, len(gains))
        for part in parts:
            rows = []
            for t in part:
                words, found = reader.features(t)
                rows.append((words, len(found), int(gains[found].sum()) // len(found) if len(found) else 0))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype=np.int64)

    return run.asNondeterministic()(F.col(text))


def noise(doc_id: str, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of seed and id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


@dataclass(frozen=True)
class Between:
    """Exclusive bounds of the keys that are still open; None: no bound."""

    low: tuple | None
    high: tuple | None


def kth_key(keys: DataFrame, parts: list[str], k: int, pivots: int = PIVOTS, seed: int = 7) -> tuple | None:
    """The k-th smallest (from 1) of the rows' composite keys ``parts``, exact; None if there are fewer.

    Each round draws random pivot keys among the open rows, counts exactly how many rows
    lie below, at and above each, and keeps the rows between the two pivots around the
    k-th. Open rows shrink by about the number of pivots each round and are written to the
    shared folder, so all rounds together read little more than the first. ``parts`` hold no nulls.
    """
    types = [keys.schema[p].dataType for p in parts]
    key = F.struct(*parts)
    literal = lambda row: F.struct(*[F.lit(v).cast(t).alias(p) for v, t, p in zip(row, types, parts)])
    open_rows, left = keys.select(*parts), k
    if k < 1:
        return None
    while True:
        seed += 1
        drawn = open_rows.orderBy(F.xxhash64(F.lit(seed), *parts)).limit(pivots).collect()
        marks = sorted({tuple(r) for r in drawn})
        if not marks:
            return None
        all_marks = F.array(*[literal(m) for m in marks])
        place = F.size(F.filter(all_marks, lambda m: m <= key))
        equal = F.coalesce(F.get(all_marks, F.col("place") - 1) == key, F.lit(False))
        counted = open_rows.withColumn("place", place).groupBy("place", equal.alias("equal")).agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {(r["place"], r["equal"]): r["n"] for r in counted}
        for i in range(len(marks) + 1):  # rows equal to mark i - 1, then those between it and mark i
            equal = counts.get((i, True), 0)
            if left <= equal:
                return marks[i - 1]
            left -= equal
            inside = counts.get((i, False), 0)
            if left <= inside:
                break
            left -= inside
        else:
            return None
        if i > 0:
            open_rows = open_rows.where(key > literal(marks[i - 1]))
        if i < len(marks):
            open_rows = open_rows.where(key < literal(marks[i]))
        open_rows = cut(open_rows)


def ranked(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows with their place in the global order, from 1: one range sort, then the totals of the earlier ranges."""
    placed = cut(rows.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    block = F.shiftright("_at", 33)
    before = Window.partitionBy().orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.col("_at") - F.shiftleft(block, 33)
    return placed.withColumn("_block", block).join(starts, "_block").withColumn(out, F.col("_start") + inside + 1).drop("_at", "_block", "_start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    ngrams: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn.

    Features are the runs of 1 to ``ngrams`` words (digits, letters a to z after A-Z are
    lower-cased, and everything outside ASCII), hashed to ``buckets``. ``weight`` is the
    floored mean over a document's features of the log ratio of target to source frequency
    of their buckets; ``score`` adds Gumbel noise drawn from ``seed`` and the id, so the
    ``percent`` of the documents of ``least_words`` words or more (rounded down) with the
    highest scores are a draw without replacement with these weights, the same at each run.

    The score of the last drawn document is found by ``kth_key`` over slim rows; only the
    drawn rows are sorted. Ties go to the smaller id, null ids last, then to the fewer
    features; rows equal in all that are alike, and any of them is drawn. Null texts have
    no features and weight 0; an empty target counts as one without features. Other columns are not read; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text, ngrams, buckets), bucket_counts(target, text, ngrams, buckets))
    scored = docs.select(F.col(doc_id).alias("doc_id"), weigh(docs, gains, ngrams, text).alias("w")).select("doc_id", "w.*")
    scored = scored.withColumn("score", F.col("weight") + noise("doc_id", seed)).withColumn("_row", F.monotonically_increasing_id())
    scored = stored(scored, "resample")
    kind = scored.schema["doc_id"].dataType
    blank = F.lit("" if kind.typeName() in ("string", "varchar", "char") else 0).cast(kind)
    rows = scored.withColumns({"_s": -F.col("score"), "_no": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", blank)})
    order = ["_s", "_no", "_id", "n_features", "_row"]
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    k = rows.where(able).count() * percent // 100
    last = kth_key(rows.where(able), order, k)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    types = [rows.schema[p].dataType for p in order]
    end = F.struct(*[F.lit(v).cast(t).alias(p) for v, t, p in zip(last, types, order)])
    drawn = able & (F.struct(*order) <= end)
    winners = ranked(rows.where(drawn).select(*columns, "_s", "_no", "_id", "_row"), order, "rank").select(*columns, "rank")
    return winners.unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


#: ``crc32`` is built from its polynomial; feature buckets are worked out once for every distinct word.
SQL = r"""
with recursive steps(b, i, c) as (
  select b::bigint, 0, b::bigint from range(256) t(b)
  union all
  select b, i + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from steps where i < 8),
crc as (select list(c order by b) as t from steps where i = 8),
words as (
  select 'd' as side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
  union all
  select 't', null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint,
      list_transform(range(1, length(hex(w)) // 2 + 1), lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::bigint)),
    lambda c, x: xor(c // 256, t[(xor(c, x) % 256 + 1)::int])), 4294967295) % 10000 as bucket
  from (select distinct w from words), crc),
counts as (
  select bucket, (count(*) filter (side = 'd'))::double as s, (count(*) filter (side = 't'))::double as t
  from words join hashed using (w) group by bucket),
sums as (select sum(s) as s, sum(t) as t from counts),
gains as (
  select bucket, floor(1000 * ln((c.t + 1) * (sums.s + 10000) / ((c.s + 1) * (sums.t + 10000))))::bigint as gain from counts c, sums),
weights as (
  select doc_id, count(*)::bigint as n_features, floor(sum(gain)::bigint / count(*))::bigint as weight
  from words join hashed using (w) join gains using (bucket) where side = 'd' group by doc_id),
scored as (
  select d.doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint)::bigint as score
  from documents d left join weights using (doc_id)),
placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
    count(*) over (partition by n_features >= 20) as able from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= able * 10 // 100 then place end as rank from placed
"""
