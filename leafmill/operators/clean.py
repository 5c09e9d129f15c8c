"""Whole-text clean-up, line roles, titles and document classes (column expressions only)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let, outside_spans
from leafmill.functions.text import blank, lines, strip

# Characters replaced or removed, line marks, labels.
SPECIAL_SPACES = "\u00a0\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad\u2028\u2029"
CHAPTER_MARK = "第"
BULLETS = ["•", "-", "*", "1.", "2.", "3.", "4.", "5."]
LABEL_BLOCK = r"##\s*标签信息\s*\(JSON\)\s*```json\s*(\{[\s\S]*?\})\s*```"
LABEL_BLOCK_CUT = r"##\s*标签信息\s*\(JSON\)[\s\S]*?```\s*"
LABEL_REST = "## 清理后的原文内容"
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
CLASS_SYNONYMS = {
    "txt": "text",
    "jpg": "images",
    "jpeg": "images",
    "png": "images",
    "image": "images",
    "img": "images",
    "list": "tables",
    "table": "tables",
    "tbl": "tables",
    "text": "text",
    "images": "images",
    "tables": "tables",
}


def table_open_after(text: Column) -> Column:
    """Whether an HTML table is open behind the text's last line with a table mark; NULL without one."""
    marks = F.filter(lines(text), lambda x: x.contains("<table>") | x.contains("</table>"))
    return F.when(F.size(marks) > 0, ~F.element_at(marks, -1).contains("</table>"))


def plain_from_markdown(text: Column, inside: Column | None = None) -> Column:
    """Drop HTML tables, lone fences, image references, heading marks and blank lines.

    ``inside`` says whether the text begins within an HTML table.
    """
    start = F.lit(False) if inside is None else F.coalesce(inside, F.lit(False))
    within = F.when(start, F.concat(F.array(F.lit("<table>")), lines(text))).otherwise(lines(text))
    kept = F.when(
        text.contains("<table>") | text.contains("</table>") | start,
        outside_spans(within, lambda x: x.contains("<table>"), lambda x: x.contains("</table>")),
    ).otherwise(lines(text))

    # each expression is tried only on lines that hold what it begins with
    def without_heading(x):
        return F.when(x.startswith("#"), F.regexp_replace(x, r"^#+\s*", "")).otherwise(x)

    def tidy(x):
        bare = F.when(x.contains("!["), F.regexp_replace(x, r"!\[.*?\]\(.*?\)", "")).otherwise(x)
        return (
            F.when(x.contains("{{Table_") & strip(x).rlike(r"^\{\{Table_\d+_(Start|End)\}\}"), x)
            .when(x.contains("```") & (strip(x) == "```"), F.lit(None))
            .otherwise(let(let(bare, without_heading), lambda b: F.when(~blank(b), b)))
        )

    return F.array_join(F.transform(kept, tidy), "\n")


def normalise_characters(text: Column, newline_mode: str = "reference") -> Column:
    """Replace special white space and control characters.

    ``reference`` turns line breaks into spaces, as the measured service does;
    ``preserve`` keeps them and folds runs of three or more to two.
    """
    if newline_mode == "reference":
        out = F.regexp_replace(F.regexp_replace(text, "\r\n", "\r"), "\n", "\r")
    else:
        out = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n")
    out = F.translate(out, SPECIAL_SPACES, " " * len(SPECIAL_SPACES))
    out = F.translate(out, INVISIBLE, "")
    out = F.regexp_replace(out, " +\n", "\n")
    out = F.regexp_replace(out, "[\u0000-\u0008\u000b-\u001f\ufffd]", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.coalesce(strip(out), F.lit(""))


def line_roles(df: DataFrame, doc: str, text: str, limit: int | None = None) -> DataFrame:
    """Role of each non-blank line; with ``limit``, of the first so many (the measured service shows 20)."""
    full = F.filter(F.transform(lines(F.col(text)), strip), lambda x: x != "")

    def role(x):
        bullet = F.exists(F.array(*[F.lit(b) for b in BULLETS]), lambda b: x.startswith(b))
        return (
            F.when(x.startswith(CHAPTER_MARK), F.concat(F.lit("章节: "), x))
            .when(bullet, F.concat(F.lit("列表项: "), x))
            .when(
                F.size(F.split(x, ":", -1)) == 2,
                F.concat(
                    F.lit("键值对: "),
                    strip(F.split(x, ":", -1)[0]),
                    F.lit(" = "),
                    strip(F.split(x, ":", -1)[1]),
                ),
            )
            .otherwise(F.concat(F.lit("段落: "), x))
        )

    shown = full if limit is None else F.slice(full, 1, limit)
    return df.select(doc, F.posexplode(F.transform(shown, role)).alias("ord", "line_role"))


def decode_text(data: Column) -> Column:
    """Bytes as UTF-8 without the bytes that do not fit (so no second encoding is ever tried)."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def pick_title(text: Column, fallback: Column) -> Column:
    """First non-blank line without leading ``#``, else the fallback."""
    full = F.filter(F.transform(F.split(text, LINE_BREAKS, -1), strip), lambda x: x != "")
    return let(
        F.try_element_at(full, F.lit(1)),
        lambda t: F.when(t.startswith("#"), strip(F.regexp_replace(t, "^#+", ""))).otherwise(F.coalesce(t, fallback)),
    )


def document_class(text_chars: Column, tables: Column, cells: Column, images: Column, wanted: Column | None = None) -> Column:
    """``tables``, ``images`` or ``text`` from counts; a known requested class wins."""
    little = text_chars < 200
    gridded = (cells >= 30) | (tables >= 2)
    guess = (
        F.when(gridded & little, "tables").when((images >= 1) & little & ~gridded, "images").otherwise("text")
    )
    if wanted is None:
        return guess
    known = F.create_map(*[F.lit(x) for pair in CLASS_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(strip(wanted))), guess)


def split_label_block(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Separate the trailing label JSON from the body text.

    As in the measured service the cut ends at the block's first fence, so the
    JSON text itself stays unless the rest marker follows it.
    """
    label = F.regexp_extract(F.col(text), LABEL_BLOCK, 1)

    def body(t):
        # remove the first block only: everything before it + everything after it
        hit = F.regexp_extract(t, LABEL_BLOCK_CUT, 0)
        pos = F.instr(t, hit)
        cut = F.concat(F.substring(t, F.lit(1), pos - 1), F.substring(t, pos + F.length(hit), F.length(t)))
        return let(
            strip(cut),
            lambda c: F.when(
                F.instr(c, LABEL_REST) > 0,
                strip(F.substring(c, F.instr(c, LABEL_REST) + len(LABEL_REST), F.length(c))),
            ).otherwise(c),
        )

    return df.select(
        doc,
        F.when(label != "", label).alias("label_json"),
        F.when(F.col(text).rlike(LABEL_BLOCK), body(F.col(text))).otherwise(F.col(text)).alias("body"),
    ).withColumn("label_ok", F.try_parse_json("label_json").isNotNull())


def placeholder_coverage(df: DataFrame, doc: str, text: str, ids: str) -> DataFrame:
    """Which of the required ids occur as ``{{id}}`` in the template text."""
    return (
        df.withColumn("_found", let(F.col(text), lambda t: F.filter(F.col(ids), lambda i: t.contains(F.concat(F.lit("{{"), i, F.lit("}}"))))))
        .select(
            doc,
            F.col("_found").alias("found"),
            F.array_except(F.col(ids), F.col("_found")).alias("missing"),
            F.size(ids).alias("total"),
        )
        .withColumn("found_count", F.size("found"))
        .withColumn("is_valid", F.size("missing") == 0)
    )
