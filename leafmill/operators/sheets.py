"""Grid operators on a long cell table.

Cells: ``workbook, sheet, row, col, text, num, is_int, number_format``; merges:
``workbook, sheet, min_row, min_col, max_row, max_col``. A sheet may hold a large
share of all cells: work is keyed by (sheet, row), never by sheet alone, except
for min/max aggregates that combine before the shuffle.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.ordered import join_parts
from leafmill.functions.text import blank, collapse, fixed_text, strip, suffix

SHEET = ["workbook", "sheet"]
# Placeholder, names, footer marks.
PLACEHOLDER = "..."
NAME_LIMIT = 31
FOOTER_MARKS = ["路径：", "路径:", "数据来源", "本表汇总", ".SAS", ".sas"]
FOOTER_DATE = r"(?i)Final\s+\d{4}-\d{2}-\d{2}"
ROW_BLOCK = 4096


def safe_sheet_name(name: Column) -> Column:
    bare = strip(F.translate(name, "[]:*?/\\", "_______"))
    return F.when(bare == "", F.lit("Sheet")).otherwise(F.substring(bare, 1, NAME_LIMIT))


def _shown_text(num: Column, text: Column) -> Column:
    return F.coalesce(text, num.cast("string"))


def filled_sheets(cells: DataFrame) -> DataFrame:
    """Sheets with at least one non-blank cell, with their file-safe names."""
    full = ~blank(_shown_text(F.col("num"), F.col("text")))
    sheets = cells.groupBy(*SHEET).agg(F.bool_or(full).alias("_full"), F.count_if(full).alias("filled_cells")).where("_full")
    # sheets of one workbook whose names are equal once made safe: the second gets ``~2`` and so on, within the limit
    same = Window.partitionBy("workbook", F.lower("safe_name")).orderBy("sheet")
    nth = F.row_number().over(same)
    tail = F.concat(F.lit("~"), F.col("_nth").cast("string"))
    apart = F.concat(F.substring("safe_name", F.lit(1), F.lit(NAME_LIMIT) - F.length(tail)), tail)
    return (
        sheets.select(*SHEET, safe_sheet_name(F.col("sheet")).alias("safe_name"), "filled_cells")
        .withColumn("_nth", nth)
        .withColumn("safe_name", F.when(F.col("_nth") > 1, apart).otherwise(F.col("safe_name")))
        .drop("_nth")
    )


def split_sheets(cells: DataFrame) -> DataFrame:
    """Cells of non-empty sheets only."""
    return cells.join(filled_sheets(cells).select(*SHEET), SHEET, "left_semi")


def _range(cells: DataFrame, full: Column) -> DataFrame:
    one = lambda f, c: f(F.when(full, F.col(c)))
    return cells.groupBy(*SHEET).agg(
        F.coalesce(one(F.min, "row"), F.lit(1)).alias("min_row"),
        F.coalesce(one(F.min, "col"), F.lit(1)).alias("min_col"),
        F.coalesce(one(F.max, "row"), F.lit(1)).alias("max_row"),
        F.coalesce(one(F.max, "col"), F.lit(1)).alias("max_col"),
    )


def used_range(cells: DataFrame) -> DataFrame:
    """Bounds of cells that are neither NULL nor empty; (1,1,1,1) for an empty sheet."""
    return _range(cells, F.coalesce(F.col("text") != "", F.col("num").isNotNull()))


def column_number(letters: Column) -> Column:
    codes = F.transform(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.aggregate(codes, F.lit(0), lambda a, c: a * 26 + c)


def a1_range(a1: Column) -> Column:
    """Struct of min/max row and column; corners may come in any order."""
    left = F.split(a1, ":")[0]
    right = F.coalesce(F.get(F.split(a1, ":"), F.lit(1)), left)
    row = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("int")
    col = lambda c: column_number(F.regexp_extract(c, r"([A-Za-z]+)", 1))
    return F.struct(
        F.least(row(left), row(right)).alias("min_row"),
        F.least(col(left), col(right)).alias("min_col"),
        F.greatest(row(left), row(right)).alias("max_row"),
        F.greatest(col(left), col(right)).alias("max_col"),
    )


def trimmed_range(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """``bounds`` without blank edge rows and columns; at least one row and column stay."""
    inside = (
        cells.join(bounds, SHEET)
        .where("row between min_row and max_row and col between min_col and max_col")
        .where(~blank(_shown_text(F.col("num"), F.col("text"))))
    )
    kept = inside.groupBy(*SHEET).agg(
        F.min("row").alias("a"), F.min("col").alias("b"), F.max("row").alias("c"), F.max("col").alias("d")
    )
    return bounds.join(kept, SHEET, "left").select(
        *SHEET,
        F.coalesce("a", "min_row").alias("min_row"),
        F.coalesce("b", "min_col").alias("min_col"),
        F.coalesce("c", "min_row").alias("max_row"),
        F.coalesce("d", "min_col").alias("max_col"),
    )


def expand_merges(cells: DataFrame, merges: DataFrame, fill_mode: str = "dots") -> DataFrame:
    """Values of every cell inside a merge: ``workbook, sheet, row, col, filled``.

    ``dots``: the top-left cell keeps its value, the others get the placeholder;
    ``copy``: all get the top-left value. Merges are laid out cell by cell, so no
    range join is needed; tall merges are dealt out in row blocks first.
    """
    corner = cells.select(
        *SHEET,
        F.col("row").alias("min_row"),
        F.col("col").alias("min_col"),
        _shown_text(F.col("num"), F.col("text")).alias("corner"),
    )
    laid = (
        merges.join(corner, [*SHEET, "min_row", "min_col"], "left")
        .withColumn("block", F.explode(F.expr(f"sequence(min_row, max_row, {ROW_BLOCK})")))
        .repartition(*SHEET, "block")
        .withColumn("row", F.explode(F.sequence("block", F.least(F.col("block") + ROW_BLOCK - 1, F.col("max_row")))))
        .withColumn("col", F.explode(F.sequence("min_col", "max_col")))
    )
    own = (F.col("row") == F.col("min_row")) & (F.col("col") == F.col("min_col"))
    value = F.col("corner") if fill_mode == "copy" else F.when(own, F.col("corner")).otherwise(F.lit(PLACEHOLDER))
    return laid.select(*SHEET, "row", "col", value.alias("filled"))


def number_text(num: Column, is_int: Column, number_format: Column, percent_dp: int = 1, enable_percent: bool = True) -> Column:
    """A number as text: percentages scaled without a sign, floats without trailing zeros."""

    def trimmed(v):
        return F.rtrim(F.rtrim(v, F.lit("0")), F.lit("."))

    percent = fixed_text(num * F.lit(100.0), percent_dp)
    percent = trimmed(percent) if percent_dp > 0 else percent
    whole = F.abs(num - F.rint(num)) < 1e-12
    is_percent = F.lit(enable_percent) & F.coalesce(F.contains(number_format, F.lit("%")), F.lit(False))
    return (
        F.when(is_percent, percent)
        .when(is_int | whole, F.rint(num).cast("decimal(38,0)").cast("string"))
        .otherwise(trimmed(fixed_text(num, 6)))
    )


def format_cell(text: Column, num: Column, is_int: Column, number_format: Column, percent_dp: int = 1, enable_percent: bool = True, tidy: Callable[[Column], Column] = lambda c: c) -> Column:
    """Cell value as text, the placeholder where it is blank; ``tidy`` is put to texts only."""
    return (
        F.when(num.isNotNull(), number_text(num, is_int, number_format, percent_dp, enable_percent))
        .when(blank(text), F.lit(PLACEHOLDER))
        .otherwise(tidy(text))
    )


def sanitize(c: Column) -> Column:
    """One line, without pipes: line breaks are white space too and become a space with it."""
    return collapse(F.replace(c, F.lit("|"), F.lit("\\|")))


def formatted(cells: DataFrame) -> DataFrame:
    """Cells as they stand in a grid. Only texts are tidied: a number has neither white space nor pipes."""
    shown = format_cell(F.col("text"), F.col("num"), F.col("is_int"), F.col("number_format"), tidy=sanitize)
    return cells.select(*SHEET, "row", "col", shown.alias("shown"))


def grid_rows(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Dense rows: ``workbook, sheet, row, min_row, cells`` with the placeholder where nothing is.

    Rows are dealt out in blocks before they are laid out one by one, so a long
    sheet is built by many tasks.
    """
    blocks = (
        bounds.withColumn("block", F.explode(F.expr(f"sequence(min_row, max_row, {ROW_BLOCK})")))
        .repartition(*SHEET, "block")
        .withColumn("row", F.explode(F.sequence("block", F.least(F.col("block") + ROW_BLOCK - 1, F.col("max_row")))))
    )
    by_row = (
        formatted(cells)
        .groupBy(*SHEET, "row")
        .agg(F.map_from_entries(F.collect_list(F.struct("col", "shown"))).alias("found"))
    )
    return blocks.join(by_row, [*SHEET, "row"], "left").select(
        *SHEET,
        "row",
        "min_row",
        F.transform(
            F.sequence("min_col", "max_col"), lambda c: F.coalesce(F.try_element_at("found", c), F.lit(PLACEHOLDER))
        ).alias("cells"),
    )


def row_kind(cells: Column) -> Column:
    """``title``, ``footer`` or ``data``: a title or footer row has one real cell, the first."""
    first = strip(F.coalesce(cells[0], F.lit("")))
    rest = F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1)))
    single = (first != "") & (first != PLACEHOLDER) & ~F.exists(
        rest, lambda c: (strip(F.coalesce(c, F.lit(""))) != "") & (strip(c) != PLACEHOLDER)
    )
    footer = first.startswith("-") | first.rlike(FOOTER_DATE)
    for mark in FOOTER_MARKS:
        footer = footer | F.contains(first, F.lit(mark))
    return F.when(single & footer, "footer").when(single, "title").otherwise("data")


def sheet_lines(rows: DataFrame, header_rows: int = 1) -> DataFrame:
    """Markdown lines of each sheet: ``workbook, sheet, line_no, line``.

    Sheet name, distinct titles, blank line, table rows with a rule after the
    header; footers are left out. One flow: every grid row becomes its line (the
    first row of a sheet also brings the sheet name and the blank line), repeated
    titles go, and line numbers are counted per tile and shifted by the tiles before.
    """
    cells = F.col("cells")
    table_line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.lit("---")), " | "), F.lit(" |"))

    def entry(phase, at, line, rule_line):
        return F.struct(
            F.lit(phase).alias("phase"), at.cast("int").alias("at"), line.alias("line"), rule_line.alias("rule")
        )

    no_rule = F.lit(None).cast("string")
    own = F.when(F.col("kind") == "title", entry(0, F.col("row"), strip(cells[0]), no_rule)).when(
        F.col("kind") == "data", entry(2, F.col("row"), table_line, rule)
    )
    name = F.when(~blank(F.col("sheet")), entry(0, F.lit(-1), strip(F.col("sheet")), no_rule))
    gap = F.when(~blank(F.col("sheet")) | (F.col("kind") == "title"), entry(1, F.lit(0), F.lit(""), no_rule))
    is_first = F.col("row") == F.col("min_row")
    entries = F.when(is_first, F.array(name, gap, own)).otherwise(F.array(own))
    flat = (
        rows.withColumn("kind", row_kind(cells))
        .select(*SHEET, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        .select(*SHEET, "e.*")
    )
    same_title = Window.partitionBy(
        *SHEET, "phase", F.when(F.col("phase") == 0, F.col("line")).otherwise(F.col("at").cast("string"))
    ).orderBy("at")
    kept = (
        flat.withColumn("_again", F.row_number().over(same_title))
        .where("_again = 1")
        .drop("_again")
        .withColumn("tile", F.floor(F.col("at") / ROW_BLOCK))
    )
    tiles = kept.groupBy(*SHEET, "phase", "tile").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*SHEET).orderBy("phase", "tile").rowsBetween(Window.unboundedPreceding, -1)
    before_in = Window.partitionBy(*SHEET, "phase").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    shifts = tiles.select(
        *SHEET,
        "phase",
        "tile",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("n").over(before_in), F.lit(0)).alias("rows_before"),
    )
    pos = F.row_number().over(Window.partitionBy(*SHEET, "phase", "tile").orderBy("at"))
    placed = kept.withColumn("pos", pos).join(shifts, [*SHEET, "phase", "tile"])
    nth = F.col("rows_before") + F.col("pos")
    line_no = F.col("lines_before") + F.col("pos")
    is_data = F.col("phase") == 2
    line = F.struct((line_no + F.when(is_data & (nth > header_rows), 1).otherwise(0)).alias("line_no"), F.col("line").alias("line"))
    under = F.struct((line_no + 1).alias("line_no"), F.col("rule").alias("line"))
    return placed.select(*SHEET, F.inline(F.when(is_data & (nth == header_rows), F.array(line, under)).otherwise(F.array(line))))


def sheet_markdown(lines: DataFrame) -> DataFrame:
    """Markdown text per sheet, in parts."""
    return join_parts(lines, SHEET, "line_no", "line", "\n")


def shape_stats(lines: DataFrame) -> DataFrame:
    """Lines that start with a pipe, and the columns of the first of them (escaped pipes count too)."""
    piped = F.col("line").startswith("|")
    return (
        lines.groupBy(*SHEET)
        .agg(
            F.count_if(piped).alias("rows"),
            F.min_by(F.when(piped, F.regexp_count("line", F.lit(r"\|")) - 1), F.when(piped, F.col("line_no"))).alias("cols"),
        )
        .withColumn("cols", F.coalesce("cols", F.lit(0)))
    )


def rtf_orientation(head: Column) -> Column:
    """Orientation from the first ten lines of an RTF text.

    Reading stops at the first ``\\landscape`` or once both sizes are known.
    """
    ls = F.slice(F.split(head, "\n", -1), 1, 10)
    num = lambda x, k: F.nullif(F.regexp_extract(x, rf"\\{k}(\d+)", 1), F.lit("")).try_cast("decimal(38,0)")
    init = F.struct(
        F.lit(None).cast("decimal(38,0)").alias("w"), F.lit(None).cast("decimal(38,0)").alias("h"), F.lit(False).alias("land"), F.lit(False).alias("stop")
    )

    def step(a, x):
        land = F.contains(x, F.lit("\\landscape"))
        w = F.coalesce(num(x, "paperw"), a["w"])
        h = F.coalesce(num(x, "paperh"), a["h"])
        return F.when(a["stop"], a).otherwise(
            F.struct(
                F.when(land, a["w"]).otherwise(w).alias("w"),
                F.when(land, a["h"]).otherwise(h).alias("h"),
                land.alias("land"),
                (land | ((w > 0) & (h > 0)).eqNullSafe(F.lit(True))).alias("stop"),
            )
        )

    return F.aggregate(
        ls,
        init,
        step,
        lambda a: F.when(a["land"], "landscape")
        .when(a["w"].isNotNull() & a["h"].isNotNull() & (a["w"] <= a["h"]), "portrait")
        .otherwise("landscape"),
    )


def orientation(files: DataFrame, sheet_sizes: DataFrame) -> DataFrame:
    """Page orientation per file. ``files``: path, exists, head; ``sheet_sizes``: path, max_row, max_col."""
    ext = suffix(F.col("path"))
    guess = (
        F.when(ext.isin("xlsx", "xls"), F.when(F.col("max_col") <= F.col("max_row"), "portrait").otherwise("landscape"))
        .when(ext == "rtf", F.coalesce(rtf_orientation(F.col("head")), F.lit("landscape")))
        .otherwise("portrait")
    )
    return files.join(sheet_sizes, "path", "left").select(
        "path", F.when(F.col("exists"), guess).otherwise("portrait").alias("orientation")
    )


def sheet_order(cells: DataFrame) -> DataFrame:
    """Position of each sheet in its workbook by name."""
    sheets = cells.select(*SHEET).distinct()
    return sheets.withColumn("sheet_no", F.row_number().over(Window.partitionBy("workbook").orderBy("sheet")))
