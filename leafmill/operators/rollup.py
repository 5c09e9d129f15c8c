"""From file and sheet results to items and paragraphs."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.ordered import PART_ROWS, bucketed_rank, first_by, join_glued, join_parts
from leafmill.functions.text import blank
from leafmill.operators.spans import collapse_regions, collapsed, crossing_items

# Tags, separators and instructions added to queries.
ANY_BRACES = r"\{*((Table|Image)_\d+_(Start|End))\}*"
START_ANY_BRACES = r"\{*((Table|Image)_\d+_Start)\}*"
KINDS = ["Table", "Image"]
FILE_RULE = "\n\n---\n\n"
SHEET_RULE = "\n---\n\n"
DIRECTORY_RULE = "\n\n====\n\n"
SOURCE_RULE = "\n---\n"
WORKBOOK_RULE = "\n\n" + "=" * 70
KEEP_WORDING = "\n\n【重要】当前为原文模式，请保留原文措辞，不要改写或总结。"
KEEP_TAGS = (
    "\n\n【重要】当前为引用图表模式，请保留原文中的所有占位符标签，如 {{Table_1_Start}}、{{Table_1_End}}、"
    "{{Image_1_Start}}、{{Image_1_End}} 等。不要删除或修改这些标签，保持原样。\n"
)
DOCUMENT_FAMILIES = ["word", "pdf"]
SHEET_FAMILIES = ["excel", "rtf"]


def canonical_placeholders(text: Column) -> Column:
    """Two braces around every tag; each closed region collapses to its Start tag."""
    out = F.regexp_replace(text, ANY_BRACES, r"{{$1}}")
    for kind in KINDS:
        out = collapsed(out, kind)
    return out


def harvest_placeholders(text: Column, fallback: Column | None = None) -> Column:
    """Sorted distinct Start tags; from the fallback text when the first has none."""

    def tags(t):
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(START_ANY_BRACES), F.lit(1)))
        return F.array_sort(F.transform(found, lambda p: F.concat(F.lit("{{"), p, F.lit("}}"))))

    own = tags(F.coalesce(text, F.lit("")))
    if fallback is None:
        return own
    return F.when(F.size(own) > 0, own).otherwise(tags(F.coalesce(fallback, F.lit(""))))


def extraction_query(extract: Column, original_mode: Column, insert_original: Column) -> Column:
    q = F.when(original_mode, F.concat(extract, F.lit(KEEP_WORDING))).otherwise(extract)
    return F.when(insert_original, F.concat(q, F.lit(KEEP_TAGS))).otherwise(q)


def canonical_parts(rows: DataFrame, item: str, sep: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows (item, ord, content) joined by ``sep`` with placeholders as in ``canonical_placeholders`` of the whole text.

    Regions may span rows; the size of the parts changes nothing. Joined by ``sep``, except
    before a part that is ``glued``, the parts of an item are its text. Items in which no
    region leaves its row, nearly all as a rule, are worked on inside their rows.
    """
    braced = rows.select(item, "ord", F.regexp_replace("content", ANY_BRACES, r"{{$1}}").alias("content"))
    crossing = crossing_items(braced, item, "ord", "content", KINDS)
    inside = braced if crossing is None else braced.join(crossing, item, "left_anti")
    out = inside.select(item, "ord", canonical_placeholders(F.col("content")).alias("content"), F.lit(False).alias("_glued"))
    if crossing is not None:
        across = braced.join(crossing, item, "left_semi").withColumn("_glued", F.lit(False))
        for kind in KINDS:
            across = collapse_regions(across, item, "ord", "content", kind, "_glued")
        out = out.unionByName(across.select(item, "ord", "content", "_glued"))
    return join_glued(out, [item], "ord", "content", sep, "_glued", part_rows)


def file_results(files: DataFrame, item: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Item text from its successful files: ``item, part, content, glued`` as in ``canonical_parts``.

    ``files``: item, ord (1-based), file, status, content.
    """
    good = files.where("status = 'success' and coalesce(content, '') <> ''").withColumn(
        "content", F.concat(F.lit("## Source: "), F.col("file"), F.lit("\n\n"), F.col("content"))
    )
    return canonical_parts(good, item, FILE_RULE, part_rows)


def file_status(files: DataFrame, item: str) -> DataFrame:
    """One row per item: success when any file succeeded, section total over successes, file counts."""
    ok = F.col("status") == "success"
    return files.groupBy(item).agg(
        F.when(F.bool_or(ok), "success").otherwise("error").alias("status"),
        F.coalesce(F.sum(F.when(ok, F.col("sections"))), F.lit(0)).alias("total_sections"),
        F.count(F.lit(1)).alias("source_files"),
        F.count_if(~ok).alias("failed_files"),
    )


def file_errors(files: DataFrame, item: str) -> DataFrame:
    """Errors of items none of whose files succeeded, as rows."""
    status = file_status(files, item).where("status = 'error'").select(item)
    return files.where("status <> 'success'").join(status, item, "left_semi").select(
        item, "ord", "file", F.coalesce("error", F.lit("未知错误")).alias("error")
    )


def sheet_prompt(title: Column, content: Column, query: Column) -> Column:
    """Prompt of one sheet, its title in front; NULL when nothing is asked or the sheet is empty."""
    shown = F.concat(F.lit("# "), title, F.lit("\n\n"), content)
    return F.when(~blank(query) & ~blank(content), F.concat(query, F.lit("\n\n"), shown))


def sheet_extraction(sheets: DataFrame, outputs: DataFrame) -> DataFrame:
    """Extracted content per sheet: the model's output, or the sheet itself without a query.

    ``sheets`` has ``prompt`` from ``sheet_prompt``; an empty sheet is a failed row.
    """
    keyed = sheets.withColumn("prompt_hash", F.sha2("prompt", 256))
    empty = blank(F.col("content"))
    return (
        keyed.join(outputs, "prompt_hash", "left")
        .withColumn("status", F.when(empty, "error").otherwise("success"))
        .withColumn("error", F.when(empty, "Sheet内容为空"))
        .withColumn("extracted", F.when(empty, F.lit("")).when(F.col("prompt").isNull(), F.col("content")).otherwise(F.col("output")))
        .drop("prompt_hash", "output")
    )


def sheet_results(sheets: DataFrame, workbook: str) -> DataFrame:
    """Combined text of a workbook from its sheets in name order, in parts.

    ``sheets``: workbook, ord (1-based by file name), title, content.
    """
    good = sheets.where(~blank(F.col("content"))).withColumn(
        "content", F.concat(F.lit("### Sheet: "), F.col("title"), F.lit("\n\n"), F.col("content"), F.lit("\n"))
    )
    return join_parts(good, [workbook], "ord", "content", SHEET_RULE)


def sheet_status(sheets: DataFrame, workbook: str) -> DataFrame:
    return sheets.groupBy(workbook).agg(
        F.count(F.lit(1)).alias("total_sheets"),
        F.count_if(~blank(F.col("content"))).alias("successful_sheets"),
        F.count_if(blank(F.col("content"))).alias("failed_sheets"),
        F.lit("success").alias("status"),
    )


def workbook_results(books: DataFrame, item: str) -> DataFrame:
    """Several workbooks of one item; the long rule stands once, at the front."""
    named = books.withColumn(
        "content", F.concat(F.lit("## Excel文件: "), F.col("source"), F.lit("\n\n"), F.col("content"), F.lit("\n"))
    )
    joined = join_parts(named, [item], "ord", "content", "\n\n")
    return joined.withColumn(
        "content", F.when(F.col("part") == 0, F.concat(F.lit(WORKBOOK_RULE), F.col("content"))).otherwise(F.col("content"))
    )


def directory_label(directory: Column) -> Column:
    parts = F.split(directory, "/")
    return F.when(F.element_at(parts, -1) == "markdown", F.get(parts, F.size(parts) - 2)).otherwise(F.element_at(parts, -1))


def directory_results(files: DataFrame, item: str) -> DataFrame:
    """Sheets grouped by directory in first-seen order, in parts.

    ``files``: item, ord, directory, title, content. Every sheet carries the
    separator and header that stand before it, so the parts are plain joins and
    neither an item nor a directory has to fit in one task.
    """
    keyed = files.where(~blank(F.col("content")))
    firsts = keyed.groupBy(item, "directory").agg(F.min("ord").alias("first_ord"))
    placed = bucketed_rank(
        keyed.join(firsts, [item, "directory"]),
        [item],
        ["first_ord", "ord"],
        F.struct(F.col("first_ord").alias("a"), F.floor(F.col("ord") / PART_ROWS).alias("b")),
        "nth",
        counted=files.select(item),
    )
    opens = F.col("ord") == F.col("first_ord")
    lead = (
        F.when(F.col("nth") == 1, F.lit(""))
        .when(opens, F.lit(DIRECTORY_RULE))
        .otherwise(F.lit(SHEET_RULE))
    )
    head = F.when(opens, F.concat(F.lit("## 来源: "), directory_label(F.col("directory")), F.lit("\n\n"))).otherwise(F.lit(""))
    block = F.concat(lead, head, F.lit("### Sheet: "), F.col("title"), F.lit("\n\n"), F.col("content"), F.lit("\n"))
    return join_parts(placed.withColumn("content", block), [item], "nth", "content", "")


def source_text(files: DataFrame, item: str) -> DataFrame:
    """Text the judge compares with: every file under its stem, in parts."""
    named = files.withColumn("content", F.concat(F.lit("### "), F.col("stem"), F.lit("\n"), F.col("content"), F.lit("\n")))
    return join_parts(named, [item], "ord", "content", SOURCE_RULE)


def full_content(items: DataFrame, chunks: DataFrame, item: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Original mode without a query: all chunk contents of the item, no model, in parts.

    ``items``: item, extract, original_mode; ``chunks``: item, ord, content.
    """
    wanted = items.where(F.col("original_mode") & blank(F.col("extract"))).select(item)
    full = chunks.where("coalesce(content, '') <> ''").join(wanted, item, "left_semi")
    return canonical_parts(full, item, "\n\n", part_rows)


Handler = Callable[[DataFrame], DataFrame]


def route_items(items: DataFrame, handlers: dict[str, Handler], item: str) -> DataFrame:
    """Send items to the handler of their family and carry their attributes through.

    A handler takes its items and returns ``item, status, content[, ...]``; items
    of other families become error rows.
    """
    carried = [c for c in ("quote", "extract", "source_file", "chunks_file", "markdown_files", "insert_original") if c in items.columns]
    results = None
    for family, handle in handlers.items():
        out = handle(items.where(F.col("family") == family)).withColumn("data_type", F.lit(family))
        results = out if results is None else results.unionByName(out, allowMissingColumns=True)
    known = list(handlers)
    other = items.where(~F.coalesce(F.col("family").isin(known), F.lit(False))).select(
        item,
        F.lit("error").alias("status"),
        F.lit("").alias("content"),
        F.concat(F.lit("不支持的数据类型: "), F.coalesce("family", F.lit(""))).alias("error"),
        F.col("family").alias("data_type"),
    )
    return results.unionByName(other, allowMissingColumns=True).join(items.select(item, *carried), item)


def paragraph_rollup(items: DataFrame, paragraph: str) -> DataFrame:
    """Counts and sums per paragraph (combinable, so paragraphs may be of any size)."""
    return items.groupBy(paragraph).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("status") == "success").alias("success_items"),
        F.count_if(F.col("status") == "error").alias("error_items"),
        F.sum("chunks_loaded").alias("total_chunks_loaded"),
        F.sum("matches").alias("total_matches"),
        F.bool_or("insert_original").alias("insert_original"),
    )


def paragraph_placeholders(items: DataFrame, paragraph: str) -> DataFrame:
    """Distinct placeholders of inserting items, one row each."""
    return (
        items.where("insert_original")
        .select(paragraph, F.explode("placeholders").alias("placeholder"))
        .groupBy(paragraph, "placeholder")
        .agg(F.count(F.lit(1)).alias("items"))
    )


def first_error(items: DataFrame, paragraph: str) -> DataFrame:
    return first_by(items.where("status = 'error'").select(paragraph, "ord", "error"), [paragraph], ["ord"]).select(
        paragraph, "error"
    )
