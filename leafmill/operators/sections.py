"""Level-1 sections of Markdown documents, their metadata and catalogue forms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import indices, let, window_of
from leafmill.functions.text import capped, lines, strip
from leafmill.operators.regions import START_TAG, paired_ranges

# Labels and limits of the section form.
PREFACE_TITLE = "文档开头"
SUMMARY_LIMIT = 200
SUMMARY_SENTENCES = 3
SUMMARY_MIN_CHARS = 10


def _section_array(ls: Column) -> Column:
    """Sections of one array of lines as structs in order."""

    def with_ranges(ranges):
        def is_head(x, i):
            return strip(x).rlike(r"^#\s") & ~F.exists(ranges, lambda r: (i >= r["first"]) & (i <= r["last"]))

        return let(indices(ls, is_head), cut)

    def cut(heads):
        starts = F.when(F.coalesce(F.get(heads, F.lit(0)), F.lit(-1)) == 0, heads).otherwise(
            F.concat(F.array(F.lit(-1)), heads)
        )

        def one(starts):
            def build(s, k):
                first = F.greatest(s, F.lit(0))
                last = F.coalesce(F.get(starts, k + 1), F.size(ls)) - 1
                has_title = s >= 0
                title = F.when(
                    has_title, strip(F.regexp_extract(strip(F.get(ls, first)), r"^#\s+(.*)$", 1))
                ).otherwise(F.lit(PREFACE_TITLE))
                body = window_of(ls, first, last)
                tagged = F.size(F.filter(body, lambda x: x.rlike(START_TAG)))
                head_tag = F.when(has_title & F.get(ls, first).rlike(START_TAG), 1).otherwise(0)
                return F.struct(
                    F.concat(F.lit("h1_"), (k + 1).cast("string")).alias("section_id"),
                    title.alias("title"),
                    strip(F.array_join(body, "\n")).alias("content"),
                    (tagged - head_tag).alias("table_count"),
                )

            return F.transform(starts, build)

        return let(starts, one)

    return let(paired_ranges(ls), with_ranges)


def h1_sections(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per level-1 section: the document is cut inside its own row."""
    secs = let(lines(F.col(text)), _section_array)
    return df.select(doc, F.posexplode(secs).alias("ord", "s")).select(
        doc, (F.col("ord") + 1).alias("ord"), "s.section_id", "s.title", "s.content", "s.table_count"
    )


def section_table(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Sections with their metadata; totals come from the row itself, not from a window."""
    secs = let(lines(F.col(text)), _section_array)
    found = df.select(
        doc,
        F.inline(F.array(let(secs, lambda s: F.struct(s.alias("secs"), F.size(s).alias("total_sections"))))),
    )
    return found.select(doc, "total_sections", F.posexplode("secs").alias("ord", "s")).select(
        doc,
        (F.col("ord") + 1).alias("ord"),
        "s.section_id",
        "s.title",
        "s.content",
        F.length("s.content").alias("word_count"),
        (F.col("s.table_count") > 0).alias("has_tables"),
        "s.table_count",
        "total_sections",
        extractive_summary(F.col("s.content"), F.col("s.title")).alias("summary"),
    )


def extractive_summary(content: Column, title: Column) -> Column:
    """First three sentences of more than ten characters, capped, in a fixed frame."""
    bare = F.regexp_replace(F.regexp_replace(content, r"[#*`\[\]()]", ""), r"\{\{[^}]+\}\}", "")
    sentences = F.filter(
        F.transform(F.split(bare, r"[。！？.!?]", -1), strip), lambda s: F.length(s) > SUMMARY_MIN_CHARS
    )
    text = F.array_join(F.slice(sentences, 1, SUMMARY_SENTENCES), "。")
    return let(
        capped(text, SUMMARY_LIMIT),
        lambda s: F.when(s != "", F.concat(F.lit("本节主要内容："), s, F.lit("。"))).otherwise(
            F.concat(F.lit("本节为「"), title, F.lit("」相关内容。"))
        ),
    )


def summary_model_input(content: Column, limit: int | None = None) -> Column:
    """Section text as sent to a summary model, whole; ``limit`` caps it (the measured service: 50,000 characters)."""
    packed = F.regexp_replace(content, r"\n\s*\n", "\n")
    bare = strip(F.regexp_replace(packed, r"\{\{[^}]+\}\}", ""))
    return bare if limit is None else capped(bare, limit)


def finish_summary(output: Column, content: Column, title: Column) -> Column:
    """Model summary without its lead-in; the extractive one when the model gave nothing."""
    clean = strip(output)
    clean = F.when(clean.startswith("摘要："), strip(F.substring(clean, 4, 2147483647))).otherwise(clean)
    usable = F.coalesce((strip(output) != "") & ~output.startswith("[生成失败]"), F.lit(False))
    return F.when(usable, clean).otherwise(extractive_summary(content, title))


def catalogue_entry(section_id: Column, title: Column, summary: Column) -> Column:
    """Lines that present one chunk to the selection step."""
    return F.concat(
        F.lit("【分块 "),
        section_id,
        F.lit("】\n"),
        F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("标题: "), title, F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("摘要: "), summary, F.lit("\n"))).otherwise(F.lit("")),
    )


def chunk_catalogue(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Catalogue text of every document: ids, titles and summaries, never contents."""
    secs = let(lines(F.col(text)), _section_array)
    entries = F.transform(
        secs, lambda s: catalogue_entry(s["section_id"], s["title"], extractive_summary(s["content"], s["title"]))
    )
    return df.select(doc, F.array_join(entries, "\n").alias("catalogue"))
