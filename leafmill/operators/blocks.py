"""Markdown blocks and size-bounded chunks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.arrays import let
from leafmill.functions.text import blank, collapse, stem, strip
from leafmill.operators.clean import LINE_BREAKS
from leafmill.operators.regions import carve

# Block syntax and chunk sizes.
FENCE = r"^```+"
HEADING = r"^(#{1,6})\s+(.*)$"
IMAGE_LINE = r"!\[[^\]]*\]\([^\)]+\)"
SENTENCE = r"[^。！？!\?；;…]+(?:[。！？!；;…]+|$)"
MAX_CHARS = 1200
MIN_CHARS = 600


def blocks(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, ord, type, level, name, text`` in reading order.

    Regions come from the raw text first. Within text, blank lines, headings,
    images and code close what is open; a pipe line closes only the paragraph,
    so prose after a table is written before that table.
    """
    segs = carve(df, doc, text).repartition(doc)
    whole = segs.where("kind != 'text'").select(
        doc,
        "seg_no",
        F.lit(0).cast("bigint").alias("k0"),
        F.lit(0).alias("k1"),
        F.lit(0).cast("bigint").alias("k2"),
        F.lit("region").alias("type"),
        F.lit(None).cast("int").alias("level"),
        "name",
        F.when(F.col("kind") == "open", F.regexp_replace("seg", r"\r?\n\z", "")).otherwise(F.col("seg")).alias("text"),
    )
    line = F.col("line")
    ls = segs.where("kind = 'text'").select(
        doc, "seg_no", F.posexplode(F.split("seg", LINE_BREAKS, -1)).alias("ln", "line")
    )
    run = Window.partitionBy(doc, "seg_no").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_fence = line.rlike(FENCE)
    fences = F.count_if(is_fence).over(run)
    typed = (
        ls.withColumn("is_fence", is_fence)
        .withColumn("fences", fences)
        .withColumn(
            "type",
            F.when(F.col("is_fence") | (F.col("fences") % 2 == 1), "code")
            .when(blank(line), "blank")
            .when(line.rlike(HEADING), "heading")
            .when(line.contains("|"), "table")
            .when(strip(line).rlike(IMAGE_LINE), "image")
            .otherwise("paragraph"),
        )
        .withColumn("stop", F.when(F.col("type").isin("table", "paragraph"), 0).otherwise(1))
        .withColumn("k0", F.sum("stop").over(run))
    )
    inside = (
        Window.partitionBy(doc, "seg_no", "k0").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        typed.withColumn(
            "k1", F.when(F.col("type") == "table", 1).when(F.col("type") == "paragraph", 0).otherwise(-1)
        )
        .withColumn(
            "k2",
            F.when(F.col("type") == "paragraph", F.count_if(F.col("type") == "table").over(inside)).otherwise(F.lit(0)),
        )
        .where("type != 'blank'")
        # all lines of one code block share its first position
        .withColumn("code_no", F.when(F.col("type") == "code", F.floor((F.col("fences") + 1) / 2)))
    )
    grouped = placed.groupBy(
        doc,
        "seg_no",
        "type",
        F.when(F.col("type") == "code", F.lit(None)).otherwise(F.col("k0")).alias("g0"),
        "k1",
        "k2",
        "code_no",
    ).agg(
        F.min("k0").alias("k0"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda s: s["line"]), "\n"
        ).alias("raw"),
    )
    shaped = grouped.select(
        doc,
        "seg_no",
        "k0",
        "k1",
        "k2",
        "type",
        F.when(F.col("type") == "heading", F.length(F.regexp_extract("raw", HEADING, 1))).alias("level"),
        F.lit(None).cast("string").alias("name"),
        F.when(F.col("type") == "heading", strip(F.regexp_extract("raw", HEADING, 2)))
        .when(F.col("type").isin("image", "paragraph"), strip(F.col("raw")))
        .otherwise(F.col("raw"))
        .alias("text"),
    )
    order = Window.partitionBy(doc).orderBy("seg_no", "k0", "k1", "k2")
    return (
        shaped.unionByName(whole)
        .withColumn("ord", F.row_number().over(order))
        .select(doc, "ord", "type", "level", "name", "text")
    )


def pack_chunks(
    block_table: DataFrame, doc: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, merge_tail: bool = True
) -> DataFrame:
    """Greedy size-bounded chunks: ``doc, chunk_no, total, title_path, content``.

    Only block lengths and headings are folded; the texts are sliced out by
    position afterwards. A chunk takes the heading path in force when it closes.
    """
    gathered = block_table.groupBy(doc).agg(
        F.sort_array(F.collect_list(F.struct("ord", "type", "level", "text"))).alias("bs")
    )
    chunk = "struct<first:int,last:int,own:boolean,path:array<string>>"
    init = F.struct(
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
        F.lit(0).alias("len"),
        F.array().cast("array<string>").alias("path"),
        F.array().cast(f"array<{chunk}>").alias("out"),
    )

    def closed(acc):
        shown = F.filter(acc["path"], lambda t: t != "")
        return F.when(
            acc["first"] >= 0,
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        acc["first"].alias("first"), acc["last"].alias("last"), F.lit(False).alias("own"), shown.alias("path")
                    )
                ),
            ),
        ).otherwise(acc["out"])

    def state(first, last, length, path, out):
        return F.struct(
            first.cast("int").alias("first"), last.cast("int").alias("last"), length.cast("int").alias("len"), path.alias("path"), out.alias("out")
        )

    nothing, zero = F.lit(-1), F.lit(0)

    def merge(acc, b):
        size = F.length(b["text"])
        pos = b["pos"]
        level = b["level"]
        path = F.concat(
            F.slice(F.concat(acc["path"], F.array_repeat(F.lit(""), level)), F.lit(1), level - 1), F.array(b["text"])
        )
        region = state(
            nothing,
            nothing,
            zero,
            acc["path"],
            F.concat(
                closed(acc),
                F.array(
                    F.struct(
                        pos.alias("first"),
                        pos.alias("last"),
                        F.lit(True).alias("own"),
                        F.filter(acc["path"], lambda t: t != "").alias("path"),
                    )
                ),
            ),
        )
        full = (acc["len"] > 0) & (acc["len"] + size > max_chars)
        added = F.when(full, state(pos, pos, size, acc["path"], closed(acc))).otherwise(
            state(F.when(acc["first"] < 0, pos).otherwise(acc["first"]), pos, acc["len"] + size, acc["path"], acc["out"])
        )
        unit = let(
            added,
            lambda a: F.when(a["len"] >= max_chars, state(nothing, nothing, zero, a["path"], closed(a))).otherwise(a),
        )
        return (
            F.when(b["type"] == "heading", state(acc["first"], acc["last"], acc["len"], path, acc["out"]))
            .when(b["type"] == "region", region)
            .when((b["type"] == "paragraph") & blank(b["text"]), acc)
            .otherwise(unit)
        )

    def numbered(bs):
        return F.transform(
            bs,
            lambda b, i: F.struct(
                i.alias("pos"),
                b["type"].alias("type"),
                F.coalesce(b["level"], F.lit(1)).alias("level"),
                b["text"].alias("text"),
            ),
        )

    def texts(bs, spans):
        return F.transform(
            spans,
            lambda c: F.struct(
                c["path"].alias("path"),
                F.array_join(
                    F.transform(
                        F.filter(
                            F.slice(bs, c["first"] + 1, c["last"] - c["first"] + 1),
                            lambda b: (b["type"] != "heading") & ~blank(b["text"]),
                        ),
                        lambda b: b["text"],
                    ),
                    "\n\n",
                ).alias("text"),
            ),
        )

    def tail(cs):
        n = F.size(cs)
        short = (n >= 2) & (F.length(F.get(cs, n - 1)["text"]) < min_chars)
        glued = F.array(
            F.struct(
                F.get(cs, n - 2)["path"].alias("path"),
                F.concat(F.get(cs, n - 2)["text"], F.lit("\n\n"), F.get(cs, n - 1)["text"]).alias("text"),
            )
        )
        return F.when(short, F.concat(F.slice(cs, F.lit(1), n - 2), glued)).otherwise(cs)

    chunks = let(
        F.col("bs"),
        lambda bs: let(F.aggregate(numbered(bs), init, merge, closed), lambda spans: texts(bs, spans)),
    )
    if merge_tail:
        chunks = let(chunks, tail)
    packed = gathered.select(
        doc, F.inline(F.array(let(chunks, lambda c: F.struct(c.alias("cs"), F.size(c).alias("total")))))
    )
    return packed.select(doc, "total", F.posexplode("cs").alias("pos", "c")).select(
        doc, (F.col("pos") + 1).alias("chunk_no"), "total", F.col("c.path").alias("title_path"), F.col("c.text").alias("content")
    )


def flat_chunk_index(chunks: DataFrame, doc: str, file_name) -> DataFrame:
    """Flat index rows: 1-based position, total, id from the file stem, sizes."""
    return chunks.select(
        doc,
        F.col("chunk_no").alias("index"),
        "total",
        F.format_string("%s_%04d", stem(file_name), F.col("chunk_no")).alias("chunk_id"),
        "title_path",
        F.lit(0).alias("overlap_from_prev"),
        F.length("content").alias("char_len"),
        "content",
    )


def sentence_array(text: Column) -> Column:
    found = F.regexp_extract_all(collapse(text), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def with_overlap(chunks: DataFrame, doc: str, overlap: int = 1) -> DataFrame:
    """Chunks that start with the last sentences of the one before (off in the default chain).

    Only those sentences travel in the window, not the chunk texts twice.
    """
    tail = F.slice(sentence_array(F.col("content")), -overlap, overlap) if overlap > 0 else F.array().cast("array<string>")
    usable = F.when(F.size(sentence_array(F.col("content"))) >= overlap, tail).otherwise(sentence_array(F.col("content")))
    before = F.lag("_tail").over(Window.partitionBy(doc).orderBy("chunk_no"))
    carried = chunks.withColumn("_tail", usable).withColumn("_before", F.coalesce(before, F.array().cast("array<string>")))
    return carried.select(
        *[c for c in chunks.columns if c != "content"],
        F.size("_before").alias("overlap_from_prev"),
        F.when(F.size("_before") > 0, F.concat(F.array_join("_before", ""), F.lit("\n\n"), F.col("content")))
        .otherwise(F.col("content"))
        .alias("content"),
    )


def sentences(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Sentences with their closing marks, white space collapsed."""
    parts = sentence_array(F.col(text))
    return df.select(doc, F.posexplode(parts).alias("ord", "sentence"))
