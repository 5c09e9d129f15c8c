"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import WORD, cut, free_name

#: Rows that one bucket of a source's queue should hold; only the shape of the plan depends on it.
BUCKET_ROWS = 20_000
#: Ranges into which the part of the queue that holds the end of the mix is cut at each step of the search.
STEPS = 4096
#: The search ends with a window over so few entries, or over entries of one finish time.
LAST_ROWS = 10_000
#: Equal rows that are dealt out in one piece.
DEAL_ROWS = 8192


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, share: float, weights: Sequence[int], most: int) -> DataFrame:
    """``source, source_size, rank, target`` from ``source, source_size``, one row per source.

    Sources by code point, null last, take the weights in turn. ``share`` of all sizes is dealt
    out by weight; no target exceeds ``most`` times its source's size, and what that leaves is
    dealt out again among the rest: the level is the largest that the sources which stay
    below their limit agree on. The windows run over the table of sources, never over documents.
    """
    everything = Window.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = (
        ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1))
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("ratio", F.col("limit") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    order = everything.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("w").over(after)
    levelled = weighed.withColumn("level", level).withColumn(
        "level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    )
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("limit").cast("double")))
    return levelled.select("source", "source_size", "rank", "budget", target.alias("target"))


def _same(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = None
    for x, y in pairs:
        c = a[x].eqNullSafe(b[y])
        cond = c if cond is None else cond & c
    return cond


def _entries(queued: DataFrame, most: int) -> DataFrame:
    """One row per row of ``docs`` and round: ``weight, rank, pass, key, size, nth, at``; ``nth`` numbers equal rows.

    Groups of equal rows are dealt out in pieces first, so that one of any size is spread over the tasks.
    """
    columns = ["rank", "key", "size", "before", "source_size", "target"]
    single = queued.where("rows = 1").select(*columns, F.lit(1).cast("long").alias("nth"))
    many = queued.where("rows > 1").select(*columns, "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / DEAL_ROWS))).alias("piece"))
    first = F.col("piece") * DEAL_ROWS + 1
    dealt = many.repartition(*columns, "piece").select(*columns, F.explode(F.sequence(first, F.least("rows", first + DEAL_ROWS - 1))).alias("nth"))
    rows = single.unionByName(dealt).select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    return rows.select(F.col("size").alias("weight"), "rank", "pass", "key", "size", "nth", _finish("pass", F.col("nth")).alias("at"))


def _finish(which: str | int, nth: Column) -> Column:
    """Virtual finish time of the ``nth`` of equal rows in a round."""
    done = F.col("before") + nth * F.col("size") + F.col("source_size") * (F.col(which) if isinstance(which, str) else which)
    return F.when(F.col("target") > 0, done / F.col("target"))


ORDER = ["at", "rank", "pass", "key", "size", "nth"]


def _first_out(entries: DataFrame, budget: float):
    """The first entry in order that does not fit the budget; None if all fit.

    Sums over ranges of finish time say in which range the budget ends; that range is cut
    again until few entries, or those of one finish time, are left. Entries without words
    change no sum and take no part.
    """
    open_rows, left = entries.where("weight > 0"), budget
    while True:
        seen = open_rows.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
        if not seen["n"] or seen["w"] <= left:
            return None
        if seen["n"] <= LAST_ROWS or seen["low"] == seen["high"]:
            break
        scale = F.lit(float(STEPS) / (seen["high"] - seen["low"]))
        step = F.least(F.floor((F.col("at") - F.lit(seen["low"])) * scale), F.lit(STEPS - 1)).cast("int")
        sums = open_rows.groupBy(step.alias("step")).agg(F.sum("weight").alias("n"))
        run = F.sum("n").over(Window.partitionBy().orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        edge = sums.withColumn("run", run).where(F.col("run") > F.lit(float(left))).orderBy("step").first()
        left -= edge["run"] - edge["n"]
        open_rows = cut(open_rows.where(step == edge["step"]))
    run = F.sum("weight").over(Window.partitionBy().orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    return open_rows.withColumn("run", run).where(F.col("run") > F.lit(float(left))).select(F.min(F.struct(*ORDER)).alias("cut")).first()["cut"]


def plan_mix(docs: DataFrame, share: float, weights: Sequence[int], most: int, doc_id: str, source: str, text: str) -> DataFrame:
    """``u_source, u_id, u_size, source_size, target, each, more``: one row per distinct (source, id, size).

    Every row of a group is taken ``each`` times, and ``more`` of its rows once again.
    """
    units = (
        docs.select(F.col(source).alias("source"), F.col(doc_id).alias("id"), word_count(text).alias("size"))
        .groupBy("source", "id", "size")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("weight", F.col("size") * F.col("rows"))
    )
    units = cut(units)
    buckets = max(16, -(-units.count() // BUCKET_ROWS))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    units = units.withColumn("bucket", F.floor(place * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    totals = units.groupBy("source", "bucket").agg(F.sum("weight").alias("total"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("total").alias("source_size")), share, weights, most)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    targets = targets.withColumnRenamed("source", "t_source")
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["t_source"])).drop("t_source")
    starts = starts.withColumnsRenamed({"source": "s_source", "bucket": "s_bucket"})
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = units.withColumn("run", F.sum("weight").over(inside))
    queued = queued.join(starts, _same(queued, starts, [("source", "s_source"), ("bucket", "s_bucket")]))
    before = F.col("start") + F.col("run") - F.col("weight")
    queued = cut(queued.select("source", "id", "size", "rows", "key", "rank", "source_size", "target", "budget", before.alias("before")))

    head = queued.select("budget").first()
    last = _first_out(_entries(queued, most).where("at is not null"), head["budget"] if head else 0.0)
    taken = F.lit(0).cast("long")
    for p in range(most):
        if last is None:
            count = F.when(F.col("target") > 0, F.col("rows")).otherwise(0)
        else:
            # finish times rise with nth: the number of rows in front of the cut is guessed by division and then put right
            edge = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in zip(ORDER, ("double", "int", "int", "string", "long", "long"))])

            def is_in(nth: Column, p: int = p) -> Column:
                own = F.struct(
                    _finish(p, nth).alias("at"), F.col("rank").cast("int").alias("rank"), F.lit(p).alias("pass"), "key", "size", nth.cast("long").alias("nth")
                )
                return own < edge

            spare = F.lit(last["at"]) * F.col("target") - F.col("before") - F.col("source_size") * p
            guess = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.floor(spare / F.col("size")), F.col("rows")))).otherwise(0).cast("long")
            near = [F.greatest(F.lit(0), F.least(guess + d, F.col("rows"))).cast("long") for d in (-2, -1, 0, 1, 2)]
            fits = F.greatest(*[F.when((n == 0) | is_in(n), n).otherwise(0) for n in near])
            count = F.when(F.col("target") > 0, F.when(F.col("size") > 0, fits).when(is_in(F.col("rows")), F.col("rows")).otherwise(0)).otherwise(0)
        taken = taken + count
    planned = queued.withColumn("taken", taken)
    return planned.select(
        F.col("source").alias("u_source"), F.col("id").alias("u_id"), F.col("size").alias("u_size"), "source_size", "target",
        F.floor(F.col("taken") / F.col("rows")).cast("int").alias("each"), (F.col("taken") % F.col("rows")).alias("more"),
    )


def _numbered(rows: DataFrame, keys: list[str], digest: Column) -> DataFrame:
    """Numbers the rows of each group from 1 in the order of a digest, by one range sort of all of them; no group meets in one task."""
    at, block = "_at", F.shiftright("_at", 33)
    unique = cut(rows.withColumn("_digest", digest).withColumn("_row", F.monotonically_increasing_id()))
    placed = cut(unique.orderBy(*keys, "_digest", "_row")).withColumn(at, F.monotonically_increasing_id())
    starts = placed.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))  # one row per range of the sort
    before = Window.partitionBy().orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    places = placed.withColumn("_block", block).join(starts, "_block")
    places = places.withColumn("_place", F.col("_start") + F.col(at) - F.shiftleft("_block", 33)).drop("_block", "_start", at, "_digest", "_row")
    firsts = places.groupBy(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)]).agg(F.min("_place").alias("_first"))
    joined = places.join(firsts, _same(places, firsts, [(k, f"_f{i}") for i, k in enumerate(keys)]))
    return joined.withColumn("_nth", F.col("_place") - F.col("_first") + 1).drop("_place", "_first", *[f"_f{i}" for i in range(len(keys))])


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 2,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Every row with ``size`` (words), ``source_size``, ``target`` (of its source), ``copies`` and ``taken``.

    Each source queues its rows in the order of a digest of their ids, ``most`` times
    over; an entry's virtual finish time is the source's words up to and with it, divided by
    the target. All entries are ordered by finish time (then source, round, digest) and taken
    while they fit the total budget, ``share`` of all sizes; ``copies`` says how often a row
    is in, ``taken`` is that times its size. The order is a property of the rows, so reruns agree.

    A source may hold any share of the rows: its running totals are made bucket by bucket of
    the digest and shifted by the totals of earlier buckets, and the end of the budget is
    sought by sums over ever smaller ranges of finish time. Rows equal in source, id and
    size queue one after the other; where the mix ends among them, those with the smaller
    MD5 of their text are in (of rows with equal texts any). Null texts have size 0, a null
    source is a source, null ids count as empty text in the digest. Columns of ``docs`` with
    the names of added ones are replaced; an empty table gives an empty one.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    plan = cut(plan_mix(docs, share, weights, most, doc_id, source, text))
    rest = [c for c in docs.columns if c.lower() not in added]
    sized = docs.select(*rest, word_count(text).alias("size"))
    keys = [(source, "u_source"), (doc_id, "u_id"), ("size", "u_size")]
    joined = sized.join(plan, _same(sized, plan, keys))
    columns = [*[sized[c] for c in (*rest, "size")], plan["source_size"], plan["target"]]
    result = lambda rows, copies: rows.select(*columns, copies.cast("int").alias("copies"), (copies * sized["size"]).alias("taken"))
    edge = plan.where("more > 0")  # at most one group of each source
    if edge.isEmpty():
        return result(joined, plan["each"])
    whole = result(joined.where(plan["more"] == 0), plan["each"])
    place = free_name(docs, "place")
    split = sized.join(edge, _same(sized, edge, keys))
    kept = split.select(F.struct(*[sized[c] for c in (*rest, "size")]).alias(place), *[edge[c] for c in edge.columns])
    dealt = _numbered(kept, ["u_source", "u_id", "u_size"], F.md5(F.coalesce(F.col(place)[text].cast("string"), F.lit("")).cast("binary")))
    copies = (F.col("each") + F.when(F.col("_nth") <= F.col("more"), 1).otherwise(0)).cast("int")
    parts = dealt.select(f"{place}.*", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
    return whole.unionByName(parts)


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as ``mix_sources`` takes it; columns are those of ``docs``."""
    row, copy = free_name(docs, "row"), free_name(docs, "copy")
    mixed = mix_sources(docs.select(F.struct(*docs.columns).alias(row), *docs.columns), **options).where("copies > 0")
    return mixed.select(row, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy)).select(f"{row}.*")


SQL = r"""
with sized as (
  select doc_id, source, md5(coalesce(text, '')) as digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, rank, w, source_size * 2 as "limit", source_size * 2 / w::double as ratio,
    (sum(source_size) over ())::bigint * 1.5::double as budget
  from (select *, [5, 2, 1][(rank % 3 + 1)::int] as w
        from (select *, row_number() over (order by source nulls last) - 1 as rank from totals))),
levels as (
  select *, (budget - coalesce(sum("limit") over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)::double)
    / (sum(w) over (order by ratio, rank rows between current row and unbounded following))::double as own
  from weighed),
targets as (
  select source, source_size, rank, budget,
    least("limit"::double, coalesce(max(case when own <= ratio then own end) over () * w, "limit"::double)) as target
  from levels),
queued as (
  select u.*, t.rank, t.source_size, t.target, t.budget,
    (sum(u.size) over (partition by u.source order by key, u.size, nth rows unbounded preceding))::bigint as done
  from (select *, md5(coalesce(doc_id::varchar, '')) as key, row_number() over (partition by source, doc_id, size order by digest) as nth from sized) u
  join targets t on u.source is not distinct from t.source),
entries as (
  select q.*, p.pass, (done + source_size * p.pass)::double / target as finish
  from queued q, (values (0), (1)) p(pass) where target > 0),
taken as (
  select source, doc_id, size, nth, count(*) as copies
  from (select *, sum(size) over (order by finish, rank, pass, key, size, nth rows unbounded preceding) as run from entries)
  where run <= budget group by source, doc_id, size, nth)
select q.doc_id, q.size, q.source_size, q.target, (coalesce(t.copies, 0) * q.size)::bigint as taken
from queued q
left join taken t on q.source is not distinct from t.source and q.doc_id is not distinct from t.doc_id and q.size = t.size and q.nth = t.nth
"""
