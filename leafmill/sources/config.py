"""JSON configuration sources: paragraphs, batch job specs, chunk corpora, logs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import strip, text_bool

# Legacy mark and job-spec options with their defaults.
LEGACY_ORIGINAL = "原文"
PARAGRAPHS = "paragraphs array<struct<id string, generate string, example string, data array<variant>>>"
OPTIONS = {
    "force_ocr": ("boolean", False),
    "extract_regions": ("boolean", True),
    "extract_assets": ("boolean", True),
    "chunking_enabled": ("boolean", True),
    "chunk_max_chars": ("int", 1200),
    "chunk_min_chars": ("int", 600),
    "chunk_overlap_sentences": ("int", 1),
}
SECTION = "struct<section_id string, title string, content string, summary string>"
CORPUS = (
    "file_name string, title string, "
    "sections array<struct<section_id string, title string, content string, summary string>>, "
    "chunks array<struct<chunk_id string, id string, section_id string, title string, title_path array<string>, "
    "content string, text string, summary string>>"
)
LOG = "timestamp string, level string, message string, logger string, error struct<type string, message string, traceback string>"
LOG_KEYS = ["timestamp", "level", "message", "logger", "error"]


def _flag(v: Column, key: str) -> Column:
    return text_bool(F.try_variant_get(v, f"$.{key}", "string"))


def paragraph_items(df: DataFrame, key: str, json: str) -> DataFrame:
    """One row per data item (a paragraph without items keeps one row with NULLs)."""
    parsed = F.from_json(json, PARAGRAPHS)
    paras = df.select(key, F.posexplode_outer(parsed["paragraphs"]).alias("para_no", "p"))
    items = paras.select(
        key,
        "para_no",
        F.coalesce("p.id", F.lit("")).alias("paragraph_id"),
        F.coalesce("p.generate", F.lit("")).alias("generate"),
        F.col("p.example").alias("example"),
        F.posexplode_outer("p.data").alias("item_no", "v"),
    )
    v = F.col("v")
    # an absent key is SQL NULL; a key with null is a variant null and still counts as present
    present = F.try_variant_get(v, "$.original_mode", "variant").isNotNull()
    legacy = strip(F.try_variant_get(v, "$.options", "string")) == LEGACY_ORIGINAL
    return items.select(
        key,
        "para_no",
        "paragraph_id",
        "generate",
        "example",
        "item_no",
        F.try_variant_get(v, "$.extract", "string").alias("extract"),
        F.try_variant_get(v, "$.datas", "array<variant>").alias("datas"),
        F.when(present, _flag(v, "original_mode")).otherwise(F.coalesce(legacy, F.lit(False))).alias("original_mode"),
        _flag(v, "insert_original").alias("insert_original"),
        F.try_variant_get(v, "$.quote", "string").alias("quote"),
    )


def item_files(items: DataFrame, keys: list[str]) -> DataFrame:
    """File names of each item: entries are strings or objects with ``file``."""
    named = items.select(*keys, F.posexplode("datas").alias("file_no", "f"))
    return named.select(
        *keys, "file_no", F.coalesce(F.try_variant_get("f", "$.file", "string"), F.try_variant_get("f", "$", "string")).alias("file")
    )


def paragraphs(df: DataFrame, key: str, json: str) -> DataFrame:
    """One row per paragraph; ``insert_original`` holds when any item has it (inside the row)."""
    parsed = F.from_json(json, PARAGRAPHS)
    return df.select(key, F.posexplode(parsed["paragraphs"]).alias("para_no", "p")).select(
        key,
        "para_no",
        F.coalesce("p.id", F.lit("")).alias("paragraph_id"),
        F.coalesce("p.generate", F.lit("")).alias("generate"),
        F.col("p.example").alias("example"),
        F.size(F.coalesce("p.data", F.array().cast("array<variant>"))).alias("items"),
        F.coalesce(F.exists("p.data", lambda v: _flag(v, "insert_original")), F.lit(False)).alias("insert_original"),
    )


def job_tasks(df: DataFrame, key: str, json: str) -> DataFrame:
    """One row per path of a batch job spec; options resolve item, then global, then default, by key presence."""
    spec = df.select(key, F.from_json(json, "map<string,variant>").alias("spec"))
    shared = F.try_element_at("spec", F.lit("config"))
    groups = spec.select(key, shared.alias("shared"), F.explode("spec").alias("file_type", "v")).where("file_type <> 'config'")
    items = groups.select(
        key, "shared", "file_type", F.posexplode(F.try_variant_get("v", "$.data", "array<variant>")).alias("item_no", "item")
    )
    item = F.col("item")
    listed = F.try_variant_get(item, "$.path", "array<string>")
    single = F.try_variant_get(item, "$.path", "string")
    is_text = F.coalesce(F.schema_of_variant(F.try_variant_get(item, "$.path", "variant")) == "STRING", F.lit(False))

    def option(name, kind, default):
        path = f"$.{name}"
        own = F.try_variant_get(item, path, "variant").isNotNull()
        common = F.try_variant_get("shared", path, "variant").isNotNull()
        return (
            F.when(own, F.try_variant_get(item, path, kind))
            .when(common, F.try_variant_get("shared", path, kind))
            .otherwise(F.lit(default))
            .alias(name)
        )

    return items.select(
        key,
        "file_type",
        "item_no",
        F.coalesce(F.try_variant_get(item, "$.name", "string"), F.lit("未命名")).alias("group_name"),
        *[option(n, k, d) for n, (k, d) in OPTIONS.items()],
        F.try_variant_get(item, "$.type", "string").alias("content_type"),
        F.posexplode(F.when(is_text, F.array(single)).otherwise(listed)).alias("path_no", "file_path"),
    )


def corpus_chunks(df: DataFrame, key: str, json: str) -> DataFrame:
    """Chunks of both corpus generations in one shape; ``sections`` win when not empty."""
    c = F.from_json(json, CORPUS)
    has_sections = F.coalesce(F.size(c["sections"]) > 0, F.lit(False))

    def first_of(*names):
        return lambda x, i: F.coalesce(*[F.when(x[n] != "", x[n]) for n in names], (i + 1).cast("string"))

    legacy_id = first_of("chunk_id", "id", "section_id")
    shaped = F.when(
        has_sections,
        F.transform(
            c["sections"],
            lambda s: F.struct(
                s["section_id"].alias("section_id"), s["title"].alias("title"), s["content"].alias("content"), s["summary"].alias("summary")
            ),
        ),
    ).otherwise(
        F.transform(
            c["chunks"],
            lambda s, i: F.struct(
                legacy_id(s, i).alias("section_id"),
                s["title"].alias("title"),
                F.coalesce(F.when(s["content"] != "", s["content"]), s["text"], F.lit("")).alias("content"),
                s["summary"].alias("summary"),
            ),
        )
    )
    return df.select(
        key, F.when(has_sections, "sections").otherwise("chunks").alias("generation"), F.posexplode(shaped).alias("pos", "s")
    ).select(key, "generation", (F.col("pos") + 1).alias("ord"), "s.*")


def log_lines(rows: DataFrame) -> DataFrame:
    """Log rows as JSON lines; an error row's message carries its type and text."""
    has_error = F.col("error").isNotNull()
    shown = F.when(
        has_error,
        F.concat(F.col("message"), F.lit(" | "), F.col("error.type"), F.lit(": "), F.col("error.message")),
    ).otherwise(F.col("message"))
    return rows.select(
        F.to_json(F.struct("timestamp", "level", shown.alias("message"), "logger", "error", "extra")).alias("value")
    )


def parse_log(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to typed columns, everything else in ``extra``."""
    return df.select(F.from_json(value, LOG).alias("l"), F.from_json(value, "extra map<string,string>")["extra"].alias("extra")).select(
        "l.*", "extra"
    )
