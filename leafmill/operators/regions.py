"""Tagged regions: ``{{Name_Start}}`` ... ``{{Name_End}}``.

All of it happens inside the document's own row: only the few tag lines are
folded, the text is sliced by position, nothing is shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let
from leafmill.functions.text import capped, grain, lines, strip
from leafmill.operators.images import count_embedded, rewrite_embedded

# Tag syntax.
START_TAG = r"(?i)\{\{\s*([A-Za-z0-9_\-]+)\s*_Start\s*\}\}"
END_TAG = r"(?i)\{\{\s*([A-Za-z0-9_\-]+)\s*_End\s*\}\}"
NUMBERED_TAG = r"\{\{(Table|Image)_(\d+)_(Start|End)\}\}"
BODY_START = r"^\{\{((?:Table|Image)_\d+)_Start\}\}$"
BODY_END = r"^\{\{((?:Table|Image)_\d+)_End\}\}$"
CLOSED_OR_TAIL = r"(?is)\{\{\s*([A-Za-z0-9_\-]+)\s*_Start\s*\}\}(?:.*?\{\{\s*\1\s*_End\s*\}\}|.*\z)"
CLOSED = r"(?is)\{\{\s*([A-Za-z0-9_\-]+)\s*_Start\s*\}\}.*?\{\{\s*\1\s*_End\s*\}\}"

_RANGES = "array<struct<name:string,first:int,last:int>>"
_OPEN = "array<struct<name:string,at:int>>"


def _tag_events(ls: Column, start_re: str, end_re: str) -> Column:
    return F.filter(
        F.transform(
            ls,
            lambda x, i: F.struct(
                i.alias("at"), F.regexp_extract(x, start_re, 1).alias("s"), F.regexp_extract(x, end_re, 1).alias("e")
            ),
        ),
        lambda t: (t["s"] != "") | (t["e"] != ""),
    )


def paired_ranges(ls: Column, tag_scope: str = "stack") -> Column:
    """Line ranges of paired tags in an array of lines.

    ``stack``: an End closes the most recent open Start of its name.
    ``single_open``: one open region at a time; a new Start discards it and an
    End of another name is ignored (range excludes the tag lines).
    """
    init = F.struct(F.array().cast(_OPEN).alias("open"), F.array().cast(_RANGES).alias("done"))

    def stacked(acc, t):
        opened = F.when(
            t["s"] != "", F.concat(acc["open"], F.array(F.struct(t["s"].alias("name"), t["at"].alias("at"))))
        ).otherwise(acc["open"])

        def close(op):
            def with_hit(hit):
                return F.struct(
                    F.when(hit.isNotNull(), F.filter(op, lambda o: ~((o["name"] == hit["name"]) & (o["at"] == hit["at"]))))
                    .otherwise(op)
                    .alias("open"),
                    F.when(
                        hit.isNotNull(),
                        F.concat(
                            acc["done"],
                            F.array(F.struct(hit["name"].alias("name"), hit["at"].alias("first"), t["at"].alias("last"))),
                        ),
                    )
                    .otherwise(acc["done"])
                    .alias("done"),
                )

            return let(F.try_element_at(F.filter(op, lambda o: o["name"] == t["e"]), F.lit(-1)), with_hit)

        return let(opened, close)

    def single(acc, t):
        current = F.get(acc["open"], F.lit(0))
        closes = (t["s"] == "") & F.coalesce(current["name"] == t["e"], F.lit(False))
        body = F.struct(t["e"].alias("name"), (current["at"] + 1).alias("first"), (t["at"] - 1).alias("last"))
        return F.struct(
            F.when(t["s"] != "", F.array(F.struct(t["s"].alias("name"), t["at"].alias("at"))))
            .when(closes, F.array().cast(_OPEN))
            .otherwise(acc["open"])
            .alias("open"),
            F.when(closes, F.concat(acc["done"], F.array(body))).otherwise(acc["done"]).alias("done"),
        )

    if tag_scope == "single_open":
        trimmed = F.transform(ls, strip)
        return F.aggregate(_tag_events(trimmed, BODY_START, BODY_END), init, single, lambda a: a["done"])
    return F.aggregate(_tag_events(ls, START_TAG, END_TAG), init, stacked, lambda a: a["done"])


def region_ranges(df: DataFrame, doc: str, text: str, tag_scope: str = "stack") -> DataFrame:
    """One row per paired region: ``name, first_line, last_line`` (0-based, inclusive)."""
    return (
        df.select(doc, F.explode(let(lines(F.col(text)), lambda ls: paired_ranges(ls, tag_scope))).alias("r"))
        .select(doc, "r.name", F.col("r.first").alias("first_line"), F.col("r.last").alias("last_line"))
    )


def carve(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Text and region segments in document order.

    ``kind``: ``region`` (closed) or ``text``; a Start that is never closed turns
    the rest of the document into one ``open`` segment.
    """
    gaps = F.split(F.col(text), CLOSED_OR_TAIL, -1)
    found = F.regexp_extract_all(F.col(text), F.lit(CLOSED_OR_TAIL), F.lit(0))

    def both(hits):
        def interleave(gs):
            return F.flatten(
                F.transform(
                    gs,
                    lambda g, i: F.array(
                        F.struct(F.lit("text").alias("kind"), g.alias("seg")),
                        F.struct(
                            F.when(F.get(hits, i).rlike(CLOSED), "region").otherwise("open").alias("kind"),
                            F.get(hits, i).alias("seg"),
                        ),
                    ),
                )
            )

        return let(gaps, interleave)

    segs = F.filter(let(found, both), lambda s: F.coalesce(s["seg"] != "", F.lit(False)))
    return df.select(doc, F.posexplode(segs).alias("seg_no", "s")).select(
        doc,
        "seg_no",
        "s.kind",
        F.when(F.col("s.kind") != "text", F.regexp_extract("s.seg", START_TAG, 1)).alias("name"),
        F.col("s.seg").alias("seg"),
    )


def numbered_regions(text: Column) -> Column:
    """Array of closed Table/Image regions with character offsets.

    Start is kept open after an End, so a second End gives a second region; a
    repeated Start moves the opening position.
    """
    gaps = F.split(text, NUMBERED_TAG, -1)
    tags = F.regexp_extract_all(text, F.lit(NUMBERED_TAG), F.lit(0))
    done = "array<struct<type:string,idx:int,name:string,start_pos:int,end_pos:int>>"
    init = F.struct(F.lit(0).alias("pos"), F.array().cast(_OPEN).alias("open"), F.array().cast(done).alias("done"))

    def merge(acc, p):
        kind = F.regexp_extract(p["tag"], NUMBERED_TAG, 1)
        number = F.regexp_extract(p["tag"], NUMBERED_TAG, 2).cast("int")
        name = F.concat_ws("_", kind, number)
        at = acc["pos"] + F.length(p["gap"])
        is_start = p["tag"].endswith("Start}}")
        others = F.filter(acc["open"], lambda o: o["name"] != name)
        started = F.try_element_at(F.filter(acc["open"], lambda o: o["name"] == name), F.lit(1))
        until = at + F.length(p["tag"])
        return F.struct(
            until.alias("pos"),
            F.when(is_start, F.concat(others, F.array(F.struct(name.alias("name"), at.alias("at")))))
            .otherwise(acc["open"])
            .alias("open"),
            F.when(
                ~is_start & started.isNotNull(),
                F.concat(
                    acc["done"],
                    F.array(
                        F.struct(
                            F.lower(kind).alias("type"),
                            number.alias("idx"),
                            name.alias("name"),
                            started["at"].alias("start_pos"),
                            until.alias("end_pos"),
                        )
                    ),
                ),
            )
            .otherwise(acc["done"])
            .alias("done"),
        )

    def fold(ts):
        pairs = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(ts)), ts, lambda g, t: F.struct(g.alias("gap"), t.alias("tag"))
        )
        return F.aggregate(pairs, init, merge, lambda a: a["done"])

    return let(tags, fold)


def scan_regions(df: DataFrame, doc: str, text: str) -> DataFrame:
    return df.select(doc, F.posexplode(numbered_regions(F.col(text))).alias("ord", "r")).select(doc, "ord", "r.*")


def extract_regions(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Region contents as rows; regions that are empty without their tags are dropped."""
    found = df.select(
        doc,
        F.posexplode(
            let(
                F.col(text),
                lambda t: F.transform(
                    numbered_regions(t),
                    lambda r: F.struct(
                        r["type"].alias("type"),
                        r["idx"].alias("idx"),
                        r["name"].alias("name"),
                        F.substring(t, r["start_pos"] + 1, r["end_pos"] - r["start_pos"]).alias("raw"),
                    ),
                ),
            )
        ).alias("ord", "r"),
    )
    bare = strip(
        F.replace(
            F.replace(F.col("r.raw"), F.concat(F.lit("{{"), F.col("r.name"), F.lit("_Start}}")), F.lit("")),
            F.concat(F.lit("{{"), F.col("r.name"), F.lit("_End}}")),
            F.lit(""),
        )
    )
    return (
        found.select(doc, "ord", "r.type", "r.idx", "r.name", bare.alias("bare"))
        .where("bare != ''")
        .select(
            doc,
            "ord",
            "type",
            "idx",
            "name",
            rewrite_embedded(F.col("bare")).alias("content"),
            count_embedded(F.col("bare")).alias("images"),
        )
        .withColumn("preview", capped(F.col("content"), 100))
    )


def region_summary(regions: DataFrame, doc: str) -> DataFrame:
    """Counts per document and over the whole collection; ``grain`` tells the two apart."""
    return regions.rollup(doc).agg(
        grain(doc, "document"),
        F.count_if(F.col("type") == "table").alias("total_tables"),
        F.count_if(F.col("type") == "image").alias("total_images"),
        F.count(F.lit(1)).alias("total_regions"),
        F.sum("images").cast("bigint").alias("total_extracted_images"),
    )
