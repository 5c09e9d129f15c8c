"""Extraction validation: verdicts, gate, best attempt, per-type strategy."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let
from leafmill.functions.ordered import first_by
from leafmill.functions.text import strip

# Verdict fields, error marks, strategies.
FIELDS = ["is_valid", "overall_score", "validation_details", "failed_reasons", "improvement_suggestions"]
ERROR_MARKS = ["[生成失败]", "[API调用失败]", "[LLM未配置", "400 Client Error", "500 Server Error"]
STRATEGIES = {
    "word": (False, False, 0),
    "pdf": (False, False, 0),
    "excel": (False, False, 0),
    "rtf": (False, False, 0),
}
DEFAULT_STRATEGY = "word"


def parse_verdict(output: Column) -> Column:
    """Verdict as JSON text or NULL.

    A directly readable verdict must have all fields; one found inside other text
    is taken as it is. Outputs with a known error mark are refused.
    """
    bad = F.lit(False)
    for mark in ERROR_MARKS:
        bad = bad | F.contains(output, F.lit(mark))
    bare = strip(
        F.regexp_replace(F.regexp_replace(strip(output), r"^```(?:json)?", ""), r"```$", "")
    )
    inner = F.try_parse_json(F.nullif(F.regexp_extract(output, r"\{[\s\S]*\}", 0), F.lit("")))

    def decide(v):
        complete = F.lit(True)
        for f in FIELDS:
            complete = complete & F.try_variant_get(v, f"$.{f}", "variant").isNotNull()
        return F.when(v.isNotNull(), F.when(complete, F.to_json(v))).otherwise(F.to_json(inner))

    return F.when(~F.coalesce(bad, F.lit(True)), let(F.try_parse_json(bare), decide))


def gate(df: DataFrame, output: str, error: str, enabled: Column) -> DataFrame:
    """Three-valued ``is_valid`` with score and whether the extraction is kept.

    Not validated counts as valid; a judge that could not be reached (error text
    with ``LLM``) keeps the result with NULL; an unreadable verdict is invalid.
    """
    unreachable = F.coalesce(F.contains(F.col(error), F.lit("LLM")), F.lit(False))
    v = F.try_parse_json("verdict")
    valid = F.coalesce(F.try_variant_get(v, "$.is_valid", "boolean"), F.lit(False))
    judged = df.withColumn("verdict", F.when(enabled & ~unreachable, parse_verdict(F.col(output))))
    return judged.withColumn(
        "is_valid", F.when(~enabled, F.lit(True)).when(unreachable, F.lit(None)).otherwise(valid)
    ).withColumn(
        "score",
        F.when(enabled & ~unreachable, F.coalesce(F.try_variant_get(v, "$.overall_score", "int"), F.lit(0))),
    ).withColumn("is_validated", enabled & ~unreachable).withColumn(
        "kept", F.coalesce(F.col("is_valid"), F.lit(True))
    )


def best_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempt with the highest score, the earliest on ties."""
    return first_by(attempts, keys, [F.col("score"), -F.col("attempt")], last=True)


def strategy(df: DataFrame, doc_type: str, changes: dict[str, tuple[bool, bool, int]] | None = None) -> DataFrame:
    """Validation strategy per document type; unknown types use the default row."""
    table = {**STRATEGIES, **(changes or {})}
    entries = F.create_map(
        *[
            x
            for k, (a, b, c) in table.items()
            for x in (F.lit(k), F.struct(F.lit(a).alias("validate"), F.lit(b).alias("retry"), F.lit(c).alias("max_retries")))
        ]
    )
    row = F.coalesce(F.try_element_at(entries, F.lower(F.col(doc_type))), entries[DEFAULT_STRATEGY])
    return df.withColumn("_s", row).select(*df.columns, "_s.validate", "_s.retry", "_s.max_retries")
