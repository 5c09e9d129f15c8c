"""Prompt assembly as a column expression."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let, weave
from leafmill.functions.text import blank

# Variable syntax.
DOUBLE = r"\{\{\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\}\}"
SINGLE = r"\{\{|\}\}|\{[^{}!:.\[\]0-9][^{}!:.\[\]]*\}|[{}]"


def render(template: Column, variables: dict[str, Column]) -> Column:
    """Fill ``{{ name }}`` and then, if the braces allow it, ``{name}``.

    Each pass reads the text once, so inserted values are never filled again in
    the same pass. The second pass also halves doubled braces; it is dropped when
    a brace stays unmatched. Unknown names become empty.
    """
    values = F.create_map(*[x for k, v in variables.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])

    def fill(vals):
        def known(name):
            return F.coalesce(F.try_element_at(vals, name), F.lit(""))

        names = F.regexp_extract_all(template, F.lit(DOUBLE), F.lit(1))
        first = weave(F.split(template, DOUBLE, -1), F.transform(names, known))

        def braces(text):
            def piece(p):
                return (
                    F.when(p == "{{", F.lit("{"))
                    .when(p == "}}", F.lit("}"))
                    .otherwise(known(F.substring(p, F.lit(2), F.length(p) - 2)))
                )

            return let(
                F.regexp_extract_all(text, F.lit(SINGLE), F.lit(0)),
                lambda found: F.when(
                    (F.size(found) == 0) | F.exists(found, lambda p: p.isin("{", "}")), text
                ).otherwise(weave(F.split(text, SINGLE, -1), F.transform(found, piece))),
            )

        return let(first, braces)

    return let(values, fill)


def build_prompts(rows: DataFrame, templates: DataFrame, variables: list[str], project_desc: str = "") -> DataFrame:
    """Prompt of every row from the template it names; an unknown template gives an empty prompt."""
    cols = {v: F.col(v) for v in variables}
    if "project_desc" in cols:
        cols["project_desc"] = F.when(blank(F.col("project_desc")), F.lit(project_desc)).otherwise(F.col("project_desc"))
    else:
        cols["project_desc"] = F.lit(project_desc)
    joined = rows.join(templates.select("template_id", "template"), "template_id", "left")
    return joined.withColumn(
        "prompt", F.when(F.col("template").isNull(), F.lit("")).otherwise(render(F.col("template"), cols))
    ).drop("template")
