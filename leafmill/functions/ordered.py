"""Ordered results over groups of any size.

A group (one user, one file, one paragraph) may hold a large share of all
rows, so nothing here gathers a whole group in one task: ranks and running
values are computed per *bucket* of the order column and shifted by the totals
of the earlier buckets; long texts come out in numbered parts.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_ROWS = 512
#: Rows of a group that one task may sort; larger groups are worked on per bucket.
WHOLE_GROUP = 100_000


def large_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the groups of more than ``WHOLE_GROUP`` rows, to be broadcast: at most one for each ``WHOLE_GROUP`` rows of the table."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(sizes.where(F.col("_n") > WHOLE_GROUP).select(*keys))


def whole_rank(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, out: str = "ord") -> DataFrame:
    """1-based position of each row in its group, for groups that one task may sort. NULL buckets are counted and left out."""
    in_group = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_bucket", bucket).withColumn(out, F.row_number().over(in_group).cast("bigint")).where(F.col("_bucket").isNotNull()).drop("_bucket")


def shifted_rank(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, out: str = "ord") -> DataFrame:
    """As ``whole_rank`` for groups of any size: ranked per bucket and shifted by the rows of the earlier buckets."""
    b = "_bucket"
    keyed = df.withColumn(b, bucket)
    local = keyed.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        keyed.groupBy(*keys, b)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return local.join(shift, [*keys, b]).withColumn(out, F.col("_shift") + F.col("_pos")).drop(b, "_pos", "_shift")


def bucketed_rank(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column, out: str = "ord", counted: DataFrame | None = None) -> DataFrame:
    """1-based position of each row in its group, exact, without one task per group.

    ``bucket`` must not decrease along ``order``; its size bounds the largest sort. Groups of
    at most ``WHOLE_GROUP`` rows are ranked whole; only larger ones, of which there are few,
    are ranked per bucket and shifted. Rows with a NULL key are left
    out, those with a NULL bucket are counted and left out.
    ``counted`` may be a plainer table with at least as many rows in each group, in which
    the large groups are looked for instead of ``df``.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    large = large_groups(df if counted is None else counted, keys)
    whole = whole_rank(df.join(large, [*keys], "left_anti"), keys, order, bucket, out)
    return whole.unionByName(shifted_rank(df.join(large, [*keys], "left_semi"), keys, order, bucket, out))


def part_of(ord_col: Column, rows: int = PART_ROWS) -> Column:
    return F.floor((ord_col - 1) / rows).cast("int")


def join_parts(
    df: DataFrame, keys: Sequence[str], order: str, text: str, sep: str, rows: int = PART_ROWS, extra: Sequence[Column] = (), part: Column | None = None
) -> DataFrame:
    """Texts of a group joined in order, ``rows`` rows per output part.

    ``order`` is a dense 1-based position. Part 0 holds positions 1..rows and so
    on; joining the parts with ``sep`` gives the whole text. A group of at most
    ``rows`` rows is a single part. ``part`` may be a column that has the part already.
    """
    gathered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys, (part_of(F.col(order), rows) if part is None else part).alias("part")).agg(
        F.array_join(F.transform(gathered, lambda s: s["t"]), sep).alias(text), *extra
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """Row with the smallest (or largest) ``order`` per group, by a combinable aggregate."""
    cols = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"k{i}") for i, o in enumerate(order)])
    pick = (F.max_by if last else F.min_by)(F.struct(*cols), rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in cols])


def trailing_count(df: DataFrame, keys: Sequence[str], micros: Column, width: int, out: str = "recent") -> DataFrame:
    """Rows of the same group within the last ``width`` microseconds, current row included.

    Time is cut into tiles of ``width``; each row counts in its own tile and is
    lent to the next one, so a group of any size is spread over its tiles.
    """
    tile = F.floor(F.col("_us") / width)
    timed = df.withColumn("_us", micros)
    spread = timed.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_tile", tile + F.col("_copy"))
    w = Window.partitionBy(*keys, "_tile").orderBy("_us").rangeBetween(-(width - 1), Window.currentRow)
    return spread.withColumn(out, F.count(F.lit(1)).over(w)).where("_copy = 0").drop("_us", "_copy", "_tile")


def bucketed_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str = "last_value"
) -> DataFrame:
    """Last non-NULL ``value`` on an earlier row of the group, exact, bucket by bucket.

    A bucket looks back inside itself and otherwise takes what the earlier
    buckets carry over; that carry is one combinable row per bucket.
    """
    b = "_bucket"
    keyed = df.withColumn(b, bucket).withColumn("_v", value)
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        keyed.groupBy(*keys, b)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(before))
        .drop("_end")
    )
    return (
        keyed.withColumn("_near", F.last("_v", ignorenulls=True).over(inside))
        .join(carry, [*keys, b])
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop(b, "_v", "_near", "_carry")
    )


def bucketed_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str = "highest"
) -> DataFrame:
    """Largest ``value`` on the earlier rows of the group, exact, bucket by bucket."""
    b = "_bucket"
    keyed = df.withColumn(b, bucket).withColumn("_v", value)
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = keyed.groupBy(*keys, b).agg(F.max("_v").alias("_top")).withColumn("_carry", F.max("_top").over(before)).drop("_top")
    near = keyed.withColumn("_near", F.max("_v").over(inside)).join(carry, [*keys, b])
    both = F.when(F.col("_near").isNull() | (F.col("_carry") > F.col("_near")), F.col("_carry")).otherwise(F.col("_near"))
    return near.withColumn(out, F.when(F.col("_carry").isNull(), F.col("_near")).otherwise(both)).drop(b, "_v", "_near", "_carry")


def join_glued(df: DataFrame, keys: Sequence[str], order: str, text: str, sep: str, glued: str, rows: int = PART_ROWS) -> DataFrame:
    """As ``join_parts``, for rows of which some follow the row before without ``sep`` (``glued``).

    A run of such rows may be of any length, so it is not kept together: a part has the
    column ``glued`` as well, true if it follows the part before without ``sep``. ``order``
    need not be dense; parts without rows do not appear.
    """
    rows_of = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(glued), F.lit(False)).alias("g"), F.col(text).alias("t"))))
    parts = df.groupBy(*keys, part_of(F.col(order), rows).alias("part")).agg(rows_of.alias("_rows"))
    between = lambda r, i: F.when((i == 0) | r["g"], F.lit("")).otherwise(F.lit(sep))
    whole = F.array_join(F.transform("_rows", lambda r, i: F.concat(between(r, i), r["t"])), "")
    return parts.select(*keys, "part", whole.alias(text), F.col("_rows")[0]["g"].alias("glued"))
