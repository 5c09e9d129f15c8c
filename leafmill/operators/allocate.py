"""Allocation of candidate files to items, compliance split and rates.

A request row carries its own candidates, so restricting and re-nesting stay
inside the row (``array_intersect`` keeps candidate order and drops repeats).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import blank, grain, none_if_blank, percent_text

GROUP = (
    "array<struct<tagId string, tag_id string, data array<struct<id string, first_match_logic string, "
    "source_full_file array<variant>>>>>"
)


def candidate_names(files: Column) -> Column:
    """Names of entries that are strings or objects with ``fileName``; blanks are skipped."""
    names = F.transform(
        files, lambda v: F.coalesce(F.try_variant_get(v, "$.fileName", "string"), F.try_variant_get(v, "$", "string"))
    )
    return F.filter(names, lambda n: ~blank(n))


def flatten_requests(df: DataFrame, key: str, json: str) -> DataFrame:
    """One row per item with its candidate array; groups that are not objects are skipped."""
    groups = df.select(key, F.posexplode(F.from_json(json, GROUP)).alias("group_no", "g")).where("g is not null")
    items = groups.select(
        key,
        "group_no",
        F.coalesce(none_if_blank(F.col("g.tagId")), none_if_blank(F.col("g.tag_id")), F.lit("unknown")).alias("tag"),
        F.posexplode("g.data").alias("item_no", "i"),
    )
    return items.select(
        key,
        "group_no",
        "tag",
        "item_no",
        F.col("i.id").alias("item_id"),
        F.col("i.first_match_logic").alias("rule"),
        F.coalesce(candidate_names(F.col("i.source_full_file")), F.array().cast("array<string>")).alias("candidates"),
    ).withColumn("needs_match", ~blank(F.col("rule")) & (F.size("candidates") > 0))


def restrict_matches(candidates: Column, compliant: Column) -> Column:
    """Compliant names that are real candidates, once each, in candidate order; nothing on failure."""
    return F.coalesce(F.array_intersect(candidates, compliant), F.array().cast("array<string>"))


def rules_and_files(spec: Column) -> tuple[Column, Column]:
    """Rules and file list of a validation spec.

    Accepted shapes: flat, the first of ``categories``, the first entry of
    ``name``. A flat file list wins; otherwise the nested shape gives the files
    and, where it has them, the rules.
    """
    v = F.try_parse_json(spec)

    def texts(base, *keys):
        return F.coalesce(*[none_if_blank(F.try_variant_get(base, f"$.{k}", "string")) for k in keys])

    def files(base, *keys):
        found = []
        for k in keys:
            entry = F.try_variant_get(base, f"$.{k}", "variant")
            many = F.try_variant_get(base, f"$.{k}", "array<string>")
            one = F.try_variant_get(base, f"$.{k}", "string")
            found.append(
                F.when(F.schema_of_variant(entry) == "STRING", F.array(one)).when(F.size(many) > 0, many)
            )
        return F.coalesce(*found)

    category = F.try_variant_get(v, "$.categories[0]", "variant")
    named = F.try_element_at(F.map_values(F.try_variant_get(v, "$.name", "map<string,variant>")), F.lit(1))
    nested = F.coalesce(category, named)
    flat_files = files(v, "files", "file")
    none = F.array().cast("array<string>")
    rules = F.when(flat_files.isNotNull(), texts(v, "rules", "Rules")).otherwise(
        F.coalesce(texts(nested, "rules", "Rules"), texts(v, "rules", "Rules"))
    )
    return F.coalesce(rules, F.lit("")), F.coalesce(flat_files, files(nested, "files", "file"), none)


def compliance_split(df: DataFrame, files: str, compliant: str, check: str, reasons: str) -> DataFrame:
    """Known files only; compliant beats check; reasons only for checked files, NULL reason empty."""
    good = F.array_intersect(F.coalesce(compliant, F.array().cast("array<string>")), F.col(files))
    rest = F.array_except(F.array_intersect(F.coalesce(check, F.array().cast("array<string>")), F.col(files)), good)
    return df.withColumn("compliant_files", good).withColumn("check_files", rest).withColumn(
        "check_reasons",
        F.transform_values(
            F.map_filter(
                F.coalesce(reasons, F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains(F.col("check_files"), k)
            ),
            lambda k, v: F.coalesce(v, F.lit("")),
        ),
    )


def match_rates(df: DataFrame, category: str, total: Column, matched: Column) -> DataFrame:
    """Totals and rates per category and overall; ``grain`` tells the two apart."""
    return (
        df.rollup(category)
        .agg(grain(category, "category"), F.sum(total).alias("total_files"), F.sum(matched).alias("matched_files"))
        .withColumn("match_rate", percent_text(F.col("matched_files"), F.col("total_files")))
    )


def pass_rates(df: DataFrame, category: str, check_files: str) -> DataFrame:
    """Share of specs with nothing to check, per category and overall; ``grain`` tells the two apart."""
    return (
        df.rollup(category)
        .agg(grain(category, "category"), F.count(F.lit(1)).alias("total"), F.count_if(F.size(check_files) == 0).alias("passed"))
        .withColumn("pass_rate", percent_text(F.col("passed"), F.col("total")))
    )
