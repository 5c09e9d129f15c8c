"""Model responses to JSON: parsed rows, rejects and counts by cascade step."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let
from leafmill.functions.text import strip

# Cascade patterns.
JSON_FENCE = r"(?s)```json\s*(\{.*\})\s*```"
ANY_FENCE = r"(?s)```\s*(\{.*\})\s*```"
BARE_OBJECT = r"(?s)\{.*\}"
CONTROL = "[\u0000-\u0008\u000b\u000c\u000e-\u001f]"
CURLY_QUOTES = "“”‘’"
PLAIN_QUOTES = "\"\"''"


def _json(text: Column) -> Column:
    """Canonical JSON text, NULL when it does not parse."""
    return F.to_json(F.try_parse_json(text))


def _first_parsed(candidates: list[tuple[str, Column]]) -> Column:
    """Struct ``step, json`` of the first candidate that parses."""

    def attempt(step, candidate):
        def named(j):
            return F.when(j.isNotNull(), F.struct(F.lit(step).alias("step"), j.alias("json")))

        return let(_json(candidate), named)

    return F.coalesce(*[attempt(s, c) for s, c in candidates], F.lit(None).cast("struct<step:string,json:string>"))


def basic_cascade(text: Column) -> Column:
    """Whole text, fenced ``json`` block, any fenced block, first ``{`` to last ``}``."""

    def clean(c):
        return F.nullif(F.regexp_replace(c, "[\u0000-\u0009\u000b-\u001f]", " "), F.lit(""))

    return _first_parsed(
        [
            ("whole", text),
            ("json_fence", clean(F.regexp_extract(text, JSON_FENCE, 1))),
            ("fence", clean(F.regexp_extract(text, ANY_FENCE, 1))),
            ("object", clean(F.regexp_extract(text, BARE_OBJECT, 0))),
        ]
    )


def _without_wrapping(text: Column) -> Column:
    s = strip(F.regexp_replace(text, "^﻿+", ""))
    s = F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*\n?", ""), r"\n?```\s*$", "")
    s = F.regexp_replace(strip(s), r"(?m)(^|\s)//.*?$", "$1")
    s = F.regexp_replace(s, r"/\*[\s\S]*?\*/", "")
    return F.regexp_replace(F.translate(s, CURLY_QUOTES, PLAIN_QUOTES), CONTROL, "")


def _no_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def _from_first_bracket(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)[\[{].*", 0), F.lit(""))


def _string_state(acc, ch):
    """Shared part of the character folds: whether the next character is inside a string."""
    in_str = F.when(acc["in_str"], acc["esc"] | (ch != '"')).otherwise(ch == '"')
    esc = acc["in_str"] & ~acc["esc"] & (ch == "\\")
    return in_str, esc


def balanced_prefix(text: Column) -> Column:
    """Text up to the bracket that closes its first one, quotes respected; NULL when none does."""

    def scan(t):
        opener = F.substring(t, 1, 1)
        closer = F.translate(opener, "{[", "}]")
        init = F.struct(
            F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("in_str"), F.lit(False).alias("esc"), F.lit(0).alias("end")
        )

        def step(acc, ch):
            in_str, esc = _string_state(acc, ch)
            turn = F.when(acc["in_str"], 0).when(ch == opener, 1).when(ch == closer, -1).otherwise(0)
            depth = acc["depth"] + turn
            return F.when(acc["end"] > 0, acc).otherwise(
                F.struct(
                    (acc["i"] + 1).alias("i"),
                    depth.alias("depth"),
                    in_str.alias("in_str"),
                    esc.alias("esc"),
                    F.when((turn == -1) & (depth == 0), acc["i"] + 1).otherwise(F.lit(0)).alias("end"),
                )
            )

        end = F.aggregate(F.split(t, ""), init, step, lambda a: a["end"])
        return let(end, lambda e: F.when(e > 0, F.substring(t, F.lit(1), e)))

    return let(_from_first_bracket(text), scan)


def closed_fragment(text: Column) -> Column:
    """Text from its first bracket with open strings and brackets closed."""

    def scan(t):
        init = F.struct(F.lit(False).alias("in_str"), F.lit(False).alias("esc"), F.lit("").alias("open"))

        def step(acc, ch):
            in_str, esc = _string_state(acc, ch)
            top = F.substring(acc["open"], -1, 1)
            matches = ((top == "{") & (ch == "}")) | ((top == "[") & (ch == "]"))
            stack = (
                F.when(acc["in_str"], acc["open"])
                .when(ch.isin("{", "["), F.concat(acc["open"], ch))
                .when(matches, F.substring(acc["open"], F.lit(1), F.length(acc["open"]) - 1))
                .otherwise(acc["open"])
            )
            return F.struct(in_str.alias("in_str"), esc.alias("esc"), stack.alias("open"))

        tail = F.aggregate(
            F.split(t, ""),
            init,
            step,
            lambda a: F.concat(F.when(a["in_str"], F.lit('"')).otherwise(F.lit("")), F.translate(F.reverse(a["open"]), "{[", "}]")),
        )
        return _no_trailing_commas(F.concat(t, tail))

    return let(_from_first_bracket(text), scan)


def strong_cascade(text: Column) -> Column:
    """Unwrap, then: as is, balanced part, without trailing commas, closed, literal booleans."""

    def tries(clean):
        literal = F.regexp_replace(
            F.regexp_replace(F.regexp_replace(clean, r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null"
        )
        quoted = F.to_json(F.from_json(literal, "variant", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}))
        return F.coalesce(
            _first_parsed([("clean", clean)]),  # a readable answer is not folded character by character
            let(
                balanced_prefix(clean),
                lambda part: _first_parsed(
                    [
                        ("balanced", part),
                        ("balanced_commas", _no_trailing_commas(part)),
                        ("commas", _no_trailing_commas(clean)),
                        ("closed", closed_fragment(clean)),
                    ]
                ),
            ),
            F.when(
                quoted.isNotNull() & clean.rlike(r"^\s*[\[{]"), F.struct(F.lit("literal").alias("step"), quoted.alias("json"))
            ),
        )

    return let(_without_wrapping(text), tries)


def parse_responses(df: DataFrame, text: str, strong: bool = False) -> DataFrame:
    """Adds ``step`` and ``json``; rejects keep NULL in both."""
    parsed = strong_cascade(F.col(text)) if strong else basic_cascade(F.col(text))
    return df.withColumn("_p", parsed).select(*df.columns, F.col("_p.step").alias("step"), F.col("_p.json").alias("json"))


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("json is null")


def step_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("step", F.lit("rejected")).alias("step")).agg(F.count(F.lit(1)).alias("responses"))
