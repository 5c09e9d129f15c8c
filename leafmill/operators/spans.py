"""Spans that begin in one row of an item and end in another, without gathering the item.

The text of an item is its rows in order. What a rule on the whole text does to one row
depends on what is open where the row begins; that is found bucket by bucket.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let
from leafmill.functions.ordered import bucketed_last, bucketed_max
from leafmill.session import cut_lineage

#: Rows of one item in a bucket; only the shape of the plan depends on it.
BUCKET = 4096


def region_of(kind: str) -> str:
    """A closed region: a Start tag up to the first later End tag of its number."""
    return r"\{\{" + kind + r"_(\d+)_Start\}\}[\s\S]*?\{\{" + kind + r"_\1_End\}\}"


def collapsed(text: Column, kind: str) -> Column:
    """Each closed region of one text shrinks to its Start tag."""
    shrunk = F.regexp_replace(text, region_of(kind), "{{" + kind + r"_$1_Start}}")
    return F.when(F.contains(text, F.lit("{{" + kind + "_")), shrunk).otherwise(text)


def crossing_items(rows: DataFrame, item: str, order: str, text: str, kinds: list[str]) -> DataFrame | None:
    """Items in which a region may begin in one row and end in another; None if there are none.

    Walking a text row by row differs from walking it whole only if a Start that its own
    row leaves open has an End of its number in a later row. Such Starts are few, so they
    are gathered first as ``item, kind, number, first row``; End tags are read only in
    items that have any. Texts do not move.
    """
    seen, found = F.col(text), []
    for kind in kinds:
        tagged = F.contains(seen, F.lit("{{" + kind + "_"))
        found.append(F.struct(F.lit(kind).alias("kind"), F.when(tagged, seen).alias("t")))
        seen = collapsed(seen, kind)
    texts = rows.select(item, F.col(order).cast("bigint").alias("o"), F.inline(F.array(*found))).where("t is not null")

    def of_kind(t: Column, shape) -> Column:
        out = F.lit(None)
        for kind in kinds:
            out = F.when(F.col("kind") == kind, shape(t, kind)).otherwise(out)
        return out

    left_over = of_kind(F.col("t"), lambda t, kind: F.regexp_extract_all(F.regexp_replace(t, region_of(kind), " "), F.lit(r"\{\{" + kind + r"_(\d+)_Start\}\}"), F.lit(1)))
    ends = of_kind(F.col("t"), lambda t, kind: F.regexp_extract_all(t, F.lit(r"\{\{" + kind + r"_(\d+)_End\}\}"), F.lit(1)))
    opened = texts.select(item, "kind", "o", F.explode(F.array_distinct(left_over)).alias("n"))
    opened = cut_lineage(opened.groupBy(item, "kind", "n").agg(F.min("o").alias("from")))
    if opened.isEmpty():
        return None
    closed = texts.join(opened.select(item).distinct(), item, "left_semi").select(item, "kind", "o", F.explode(F.array_distinct(ends)).alias("n"))
    last = closed.groupBy(item, "kind", "n").agg(F.max("o").alias("to"))
    crossing = cut_lineage(opened.join(last, [item, "kind", "n"]).where(F.col("from") < F.col("to")).select(item).distinct())
    return None if crossing.isEmpty() else crossing


def chosen_regions(regions: DataFrame, item: str) -> DataFrame:
    """Non-overlapping regions as a search from the left picks them: ``item, start, end``.

    ``regions``: item, start, end (places; a place has a row ``o`` and a position ``i``). A
    region that begins after all earlier ones have ended is always picked. Among the others
    each points to the first region that begins after its own end; the regions that
    pointers reach from the picked ones are found by doubling: in round k, those 2^k steps
    on, while every pointer is replaced by the one 2^k steps further. So a chain of any
    length takes rounds in its logarithm, and no chain or cluster is gathered.
    """
    placed = regions.withColumns({"o": F.col("start.o"), "i": F.col("start.i")})
    reached = bucketed_max(placed, [item], ["o", "i"], F.floor(F.col("o") / BUCKET), F.col("end"), "reached")
    head = F.col("reached").isNull() | (F.col("reached") < F.col("start"))
    known = cut_lineage(reached.select(item, "start", "end", head.alias("head")))
    picked, rest = known.where("head"), known.where("not head")
    if rest.isEmpty():
        return picked.drop("head")
    starts = known.select(item, "start.o", "start.i", F.col("start").alias("from"), F.lit(True).alias("opens"))
    ends = known.select(item, "end.o", "end.i", F.col("start").alias("from"), F.lit(False).alias("opens"))
    walk = starts.unionByName(ends).withColumns({"_o": -F.col("o"), "_i": -F.col("i")})
    after = bucketed_last(walk, [item], ["_o", "_i"], F.floor(F.col("_o") / BUCKET), F.when(F.col("opens"), F.col("from")), "to")
    after = after.where("not opens and to is not null").select(item, "from", "to")
    # a pointer to a region that is picked anyway is at its end
    jump = cut_lineage(after.join(rest.select(item, F.col("start").alias("to")), [item, "to"], "left_semi").select(item, "from", "to"))
    found = picked.select(item, F.col("start").alias("at"))
    while True:
        further = cut_lineage(found.join(jump, (found[item] == jump[item]) & (found["at"] == jump["from"])).select(found[item], F.col("to").alias("at")))
        if further.isEmpty():
            break
        found = cut_lineage(found.unionByName(further))
        second = jump.select(F.col(item).alias("_item"), F.col("from").alias("_from"), F.col("to").alias("_to"))
        jump = cut_lineage(jump.join(second, (jump[item] == second["_item"]) & (jump["to"] == second["_from"])).select(item, "from", F.col("_to").alias("to")))
    return known.drop("head").join(found.select(item, F.col("at").alias("start")), [item, "start"], "left_semi")


def _mark_rows(rows: DataFrame, item: str, order: str, text: str, kind: str) -> DataFrame:
    """Start and End tags that bound the regions to collapse: ``item, order, marks`` (place in the row, opens or closes)."""
    tag = r"\{\{" + kind + r"_(\d+)_(Start|End)\}\}"
    tags = rows.where(F.contains(text, F.lit("{{" + kind + "_"))).select(
        item,
        F.col(order).cast("bigint").alias("o"),
        F.posexplode(F.regexp_extract_all(text, F.lit(tag), F.lit(0))).alias("i", "tag"),
    )
    events = tags.select(item, "o", "i", F.regexp_extract("tag", tag, 1).alias("n"), (F.regexp_extract("tag", tag, 2) == "Start").alias("opens"))
    events = cut_lineage(events)  # small rows, used several times by each of the steps below
    # the next End of the same number: the last one seen when walking backwards
    backwards = events.withColumn("_o", -F.col("o")).withColumn("_i", -F.col("i"))
    ended = bucketed_last(
        backwards, [item, "n"], ["_o", "_i"], F.floor(F.col("_o") / BUCKET), F.when(~F.col("opens"), F.struct("o", "i")), "end"
    )
    regions = ended.where("opens and end is not null").select(item, F.struct("o", "i").alias("start"), "end")
    taken = chosen_regions(cut_lineage(regions), item)
    ends = taken.select(
        item,
        F.explode(
            F.array(
                F.struct(F.col("start.o").alias("o"), F.col("start.i").alias("i"), F.lit(True).alias("opens")),
                F.struct(F.col("end.o").alias("o"), F.col("end.i").alias("i"), F.lit(False).alias("opens")),
            )
        ).alias("m"),
    )
    # all marks of a row stand in that row's text
    marks = ends.groupBy(item, F.col("m.o").alias(order)).agg(F.sort_array(F.collect_list(F.struct("m.i", "m.opens"))).alias("marks"))
    return cut_lineage(marks)


def collapse_regions(rows: DataFrame, item: str, order: str, text: str, kind: str, glued: str) -> DataFrame:
    """Each closed region of ``kind`` shrinks to its Start tag, also where it spans rows of an item.

    As a search over the item's whole text does: from the left, a Start with a later End of
    its number takes all up to that End. ``glued`` is set where a row's text follows the one
    before without a separator, because the separator lay in a region; rows that lie in a
    region altogether are gone. ``order`` is unique within an item.
    """
    marks = _mark_rows(rows, item, order, text, kind)
    # what is open where a row begins comes from slim rows; the texts move once, to meet it
    slim = rows.select(item, order).join(marks, [item, order], "left").withColumn("_last", F.element_at("marks", -1)["opens"])
    state = bucketed_last(slim, [item], [order], F.floor(F.col(order) / BUCKET), F.col("_last"), "_open").drop("_last")
    placed = rows.join(state, [item, order])
    open_ = F.coalesce(F.col("_open"), F.lit(False))
    tag = r"\{\{" + kind + r"_\d+_(?:Start|End)\}\}"

    def rebuilt(gaps: Column, tags: Column, found: Column, begins_open: Column) -> Column:
        def covered(upto):
            last = F.element_at(F.filter(found, lambda m: m["i"] < upto), -1)
            return F.coalesce(F.when(F.size(F.filter(found, lambda m: m["i"] < upto)) > 0, last["opens"]), begins_open)

        def at(gap, j):  # gap j, and tag j behind it
            own = F.filter(found, lambda m: m["i"] == j)
            shown = F.when(F.size(own) > 0, own[0]["opens"]).otherwise(~covered(j))
            return F.concat(
                F.when(covered(j), F.lit("")).otherwise(gap), F.when(shown, F.coalesce(F.get(tags, j), F.lit(""))).otherwise(F.lit(""))
            )

        return F.concat_ws("", F.transform(gaps, at))

    fresh = let(
        F.struct(
            F.split(text, tag, -1).alias("gaps"),
            F.regexp_extract_all(F.col(text), F.lit(tag), F.lit(0)).alias("tags"),
            F.coalesce("marks", F.array().cast("array<struct<i:int,opens:boolean>>")).alias("found"),
            open_.alias("open"),
        ),
        lambda s: rebuilt(s["gaps"], s["tags"], s["found"], s["open"]),
    )
    touched = F.col("marks").isNotNull() | open_
    return (
        placed.withColumn(text, F.when(touched, fresh).otherwise(F.col(text)))
        .withColumn(glued, F.coalesce(F.col(glued), F.lit(False)) | open_)
        .where(F.col("marks").isNotNull() | ~open_)
        .drop("marks", "_open")
    )


def state_before(rows: DataFrame, item: str, order: str, state: Column, out: str) -> DataFrame:
    """Last non-NULL ``state`` of the item's earlier rows."""
    return bucketed_last(rows, [item], [order], F.floor(F.col(order) / BUCKET), state, out)
