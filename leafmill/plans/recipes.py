"""Inputs derived from the given tables, in Spark and in SQL.

Every recipe maps whole rows of a given table to the shape an operator needs,
so the work grows with the tables. ``SQL`` holds the same recipe as text for
the side-by-side check.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import lines


# Tables whose rows are whole texts: worth a task per core even when the file is one row group.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key when the scan has fewer splits than the session has cores.

    A scan of any size has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _b64(c):
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, md, source, lang``: each line of a document takes a Markdown shape by its position."""

    def shape(x, i):
        n = (i + 1).cast("string")
        k = (i + F.col("doc_id")) % 12
        size = F.length(x).cast("string")
        cell = F.replace(x, F.lit("|"), F.lit("/"))

        def text(*parts):
            return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        return (
            F.when(k == 0, text("# ", x))
            .when(k == 1, text("## ", x))
            .when(k == 2, text("{{Table_", n, "_Start}}\n| name | size |\n|---|---|\n| ", cell, " | ", size, " |\n{{Table_", n, "_End}}"))
            .when(k == 4, text("![fig ", n, "](data:image/png;base64,", _b64(x), ")"))
            .when(k == 5, text("| head a | head b |\n|---|---|\n| ", cell, " | ", size, " |"))
            .when(k == 7, text("{{Block_", n, "_Start}}\n# inner ", x, "\n{{Block_", n, "_End}}"))
            .when(k == 8, text("```\n", x, "\n```"))
            .when(k == 9, text("\n", x))
            .when(k == 10, text("{{Outer_Start}}\n{{Outer_Start}}\n# hidden\n{{Outer_End}}\n", x))
            .when(k == 11, text(x, "\n{{Outer_End}}"))
            .otherwise(x)
        )

    docs = load(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.array_join(F.transform(lines(F.col("text")), shape), "\n").alias("md"), "source", "lang"
    )


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def s_strip(x: str) -> str:
    return f"trim({x}, {WS})"


MD_SQL = """
md as (
  select doc_id, source, lang, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    case (i - 1 + doc_id) % 12
      when 0 then '# ' || x
      when 1 then '## ' || x
      when 2 then '{{Table_' || i || '_Start}}' || chr(10) || '| name | size |' || chr(10) || '|---|---|' || chr(10)
               || '| ' || replace(x, '|', '/') || ' | ' || length(x) || ' |' || chr(10) || '{{Table_' || i || '_End}}'
      when 4 then '![fig ' || i || '](data:image/png;base64,' || to_base64(encode(x)) || ')'
      when 5 then '| head a | head b |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(x, '|', '/') || ' | ' || length(x) || ' |'
      when 7 then '{{Block_' || i || '_Start}}' || chr(10) || '# inner ' || x || chr(10) || '{{Block_' || i || '_End}}'
      when 8 then '```' || chr(10) || x || chr(10) || '```'
      when 9 then chr(10) || x
      when 10 then '{{Outer_Start}}' || chr(10) || '{{Outer_Start}}' || chr(10) || '# hidden' || chr(10) || '{{Outer_End}}' || chr(10) || x
      when 11 then x || chr(10) || '{{Outer_End}}'
      else x end), chr(10)) as md
  from documents)"""

LN_SQL = MD_SQL + """,
ln as (
  select doc_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) - 1 as ln
  from md)"""
