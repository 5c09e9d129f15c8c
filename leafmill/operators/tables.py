"""Line-state operators on Markdown: auto-tagging, grid simplification, table split.

These need the state of the lines before, so a document becomes a line table
that is shuffled once by document; every window and the final re-join use that
same partitioning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import WHITE, blank, collapse, count_text, lines, strip
from leafmill.operators.images import ANY_IMAGE

# Table syntax.
SEPARATOR_NEXT = r"^\s*\|?\s*[-:]+\s*\|"
SEPARATOR_LIKE = r"^\s*\|?\s*[-:]+"
BORDER = r"^[\+\-\|: ]+$"
NAME_LIMIT = 40


def line_table(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, ln, line`` with all lines of a document in one partition."""
    return df.select(doc, F.posexplode(lines(F.col(text))).alias("ln", "line")).repartition(doc)


def rejoin(lined: DataFrame, keys: list[str], order: list[Column | str], line: Column, out: str) -> DataFrame:
    """Lines of one document back to text; the group is the document's own lines."""
    rank = [(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
    gathered = F.sort_array(F.collect_list(F.struct(*rank, line.alias("line"))))
    return lined.groupBy(*keys).agg(F.array_join(F.transform(gathered, lambda s: s["line"]), "\n").alias(out))


def _upto(doc: str, *order: str):
    return Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def tag_tables_and_images(df: DataFrame, doc: str, text: str, out: str = "marked") -> DataFrame:
    """Wrap untagged pipe tables and image lines in numbered tags.

    A table runs from its header to the first blank or pipe-less line; that line
    is never tested as image or header. A table that reaches the end of the text
    gets no End tag.
    """
    by_line = Window.partitionBy(doc).orderBy("ln")
    has_pipe = F.col("line").contains("|")
    flagged = (
        line_table(df, doc, text)
        .withColumn("is_head", has_pipe & F.coalesce(F.lead("line").over(by_line).rlike(SEPARATOR_NEXT), F.lit(False)))
        .withColumn("goes_on", ~blank(F.col("line")) & (has_pipe | F.col("line").rlike(SEPARATOR_LIKE)))
        .withColumn("run", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(_upto(doc, "ln")))
    )
    in_run = Window.partitionBy(doc, "run").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = F.count_if(F.col("is_head") & F.col("goes_on")).over(in_run)
    state = (
        flagged.withColumn("in_table", F.col("goes_on") & (heads > 0))
        .withColumn("opens", F.col("in_table") & ~F.coalesce(F.lag("in_table").over(by_line), F.lit(False)))
        .withColumn("closes", ~F.col("in_table") & F.coalesce(F.lag("in_table").over(by_line), F.lit(False)))
        .withColumn("is_image", ~F.col("in_table") & ~F.col("closes") & F.col("line").rlike(ANY_IMAGE))
        .withColumn("table_no", F.count_if("opens").over(_upto(doc, "ln")))
        .withColumn("image_no", F.count_if("is_image").over(_upto(doc, "ln")))
    )

    def tag(kind, no, end):
        return F.concat(F.lit("{{" + kind + "_"), F.col(no).cast("string"), F.lit(f"_{end}}}}}"))

    line = F.col("line")
    marked = (
        F.when(F.col("opens"), F.concat(F.lit("\n"), tag("Table", "table_no", "Start"), F.lit("\n\n"), line))
        .when(F.col("closes"), F.concat(F.lit("\n"), tag("Table", "table_no", "End"), F.lit("\n\n"), line))
        .when(
            F.col("is_image"),
            F.concat(
                F.lit("\n"), tag("Image", "image_no", "Start"), F.lit("\n"), line, F.lit("\n"), tag("Image", "image_no", "End"), F.lit("\n")
            ),
        )
        .otherwise(line)
    )
    return rejoin(state, [doc], ["ln"], marked, out)


def _clean_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(collapse(c), r"\(\s+", "("), r"\s+\)", ")")


def simplify_grid_tables(df: DataFrame, doc: str, text: str, out: str = "simplified") -> DataFrame:
    """Grid tables to header + separator + rows.

    Rows wait until a ``+`` border or a text line; an existing ``|---|`` line is
    written at once, so it comes before the rows that wait. Other lines made of
    border characters only disappear.
    """
    line = F.col("line")
    border = line.rlike(BORDER)
    kind = (
        F.when(border & line.contains("+"), "flush")
        .when(border & line.contains("|") & line.contains("---"), "separator")
        .when(border, "gone")
        .when(line.contains("|"), "row")
        .otherwise("text")
    )
    bare = F.regexp_replace(line, r"^\|+|\|+$", "")
    cells = F.concat(F.lit("|"), F.array_join(F.transform(F.split(bare, r"\|", -1), _clean_cell), "|"), F.lit("|"))
    grouped = (
        line_table(df, doc, text)
        .withColumn("kind", kind)
        .withColumn("grp", F.count_if(F.col("kind").isin("flush", "text")).over(_upto(doc, "ln")))
        .where(F.col("kind").isin("separator", "row", "text"))
        .withColumn("shown", F.when(F.col("kind") == "row", cells).otherwise(line))
    )
    of_kind = Window.partitionBy(doc, "grp", "kind")
    rows = grouped.withColumn("rows", F.count(F.lit(1)).over(of_kind)).withColumn(
        "at", F.row_number().over(of_kind.orderBy("ln"))
    )
    columns = count_text(F.col("shown"), "|") - 1
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), columns), " | "), F.lit("|"))
    shown = F.when(
        (F.col("kind") == "row") & (F.col("rows") > 1) & (F.col("at") == 1), F.concat(F.col("shown"), F.lit("\n"), rule)
    ).otherwise(F.col("shown"))
    phase = F.when(F.col("kind") == "text", 0).when(F.col("kind") == "separator", 1).otherwise(2)
    joined = rejoin(rows, [doc], ["grp", phase, "ln"], shown, out)
    return df.select(doc).join(joined, doc, "left").select(doc, F.coalesce(out, F.lit("")).alias(out))


def split_by_tables(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One document per table: the lines since the previous table and the table itself."""
    by_line = Window.partitionBy(doc).orderBy("ln")
    s = strip(F.col("line"))
    parts = (
        line_table(df, doc, text)
        .withColumn("is_table", s.startswith("|") & s.endswith("|") & (F.length(s) >= 3))
        .withColumn(
            "turn",
            F.when(~F.col("is_table") & F.coalesce(F.lag("is_table").over(by_line), F.lit(False)), 1).otherwise(0),
        )
        .withColumn("table_no", F.sum("turn").over(_upto(doc, "ln")) + 1)
    )
    name_line = F.when(~F.col("is_table") & (s != ""), s)
    out = parts.groupBy(doc, "table_no").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n"
        ).alias("text"),
        F.count_if("is_table").alias("table_lines"),
        F.min_by(name_line, F.when(name_line.isNotNull(), F.col("ln"))).alias("first_line"),
    )
    name = F.regexp_replace(F.regexp_replace(F.col("first_line"), f"^[#*{WHITE}]+", ""), r"\*\*", "")
    name = F.substring(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"), 1, NAME_LIMIT)
    return (
        out.where("table_lines > 0")
        .withColumn("name", F.coalesce(name, F.lit("sheet")))
        .select(doc, "table_no", "name", F.concat_ws("_", "name", "table_no").alias("file_stem"), "table_lines", "text")
    )
