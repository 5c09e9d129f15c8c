"""Standard package table and run outputs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.functions.ordered import join_parts
from leafmill.sources.commits import CommittedTable

# What each family keeps.
TEXT_TYPES = ["docx", "doc", "word", "pdf"]
SHEET_TYPES = ["xlsx", "excel", "rtf"]
SHEET_REGION_FIELDS = ["label", "path", "markdown_path"]
STANDARD_INFO = {
    "processing_time": "0.0",
    "extract_regions": "false",
    "extract_assets": "false",
    "original_file": "",
    "markdown_files": "[]",
}
OPTIONAL_INFO = [
    "chunks_total",
    "structured_chunks_file",
    "chunking_mode",
    "chunk_params",
    "conversion_method",
    "steps",
    "sheets_total",
]


def standard_info(info: Column) -> Column:
    """Fixed keys with defaults plus the optional keys that are present."""
    defaults = F.create_map(*[F.lit(x) for kv in STANDARD_INFO.items() for x in kv])
    known = F.array(*[F.lit(k) for k in [*STANDARD_INFO, *OPTIONAL_INFO]])
    kept = F.map_filter(info, lambda k, v: F.array_contains(known, k))
    missing = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(kept, k))
    return F.map_concat(kept, missing)


def package_table(df: DataFrame, chunk_files: DataFrame) -> DataFrame:
    """Per-type package rows; ``chunks_file`` only where the file exists.

    Sheet packages keep only label, path and markdown_path of a region; the other
    fields of the region struct are NULL there.
    """
    kind = F.lower(F.col("file_type"))
    is_text, is_sheet = kind.isin(TEXT_TYPES), kind.isin(SHEET_TYPES)
    extra = [f for f in df.schema["regions"].dataType.elementType.fields if f.name not in SHEET_REGION_FIELDS]

    def shortened(r):
        for f in extra:
            r = r.withField(f.name, F.lit(None).cast(f.dataType))
        return r

    known = chunk_files.select(F.col("path").alias("chunks_file"), F.lit(True).alias("_known")).distinct()
    return df.join(known, "chunks_file", "left").select(
        "source_file",
        "file_type",
        "content_type",
        F.when(is_text, F.col("text_content")).alias("text_content"),
        F.when(is_text, F.col("markdown_content")).alias("markdown_content"),
        F.when(is_sheet, F.transform("regions", shortened)).otherwise(F.col("regions")).alias("regions"),
        F.when(~is_sheet, F.col("assets")).alias("assets"),
        F.when(is_sheet, standard_info(F.col("info"))).otherwise(F.col("info")).alias("info"),
        F.when(F.col("structured_data") != "", F.col("structured_data")).alias("structured_data"),
        F.when(F.col("_known"), F.col("chunks_file")).alias("chunks_file"),
    )


def write_packages(packages: DataFrame, path: str, job: str = "job") -> None:
    """Adds the packages of a job; a job that is written again replaces its own."""
    CommittedTable(packages.sparkSession, path, packages.schema).write(packages, job, ["file_type"])


def read_packages(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One package per source file, that of the last job that made it."""
    return CommittedTable(spark, path, schema).newest_row(["source_file"])


def paragraph_text(results: DataFrame, run: str, ord_col: str, paragraph: str, content: str) -> DataFrame:
    """Readable run text in parts, each paragraph under its id header."""
    headed = results.withColumn(
        "text", F.concat(F.lit("=== 段落ID: "), F.col(paragraph).cast("string"), F.lit(" ===\n"), F.col(content), F.lit("\n"))
    )
    return join_parts(headed, [run], ord_col, "text", "\n")


def write_text_parts(parts: DataFrame, run: str, content: str, path: str) -> None:
    """Text files per run in part order; a long run is spread over several files by part range. A run written again replaces its files."""
    (
        parts.repartitionByRange(F.col(run), F.col("part"))
        .sortWithinPartitions(run, "part")
        .select(run, F.col(content).alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(run)
        .text(path)
    )


def write_run_table(rows: DataFrame, run: str, path: str, batch: str = "batch") -> None:
    """Summaries, extracted data, provenance or timings of runs, partitioned by run; a batch written again replaces its rows."""
    CommittedTable(rows.sparkSession, path, rows.schema).write(rows, batch, [run])


def read_run_table(spark: SparkSession, path: str, schema: StructType, run: str) -> DataFrame:
    """Rows of every run, those of the last batch that wrote it."""
    return CommittedTable(spark, path, schema).newest_rows([run])


def run_summary(results: DataFrame, run: str) -> DataFrame:
    """Counts of one run and whether any result waits for a selection."""
    return results.groupBy(run).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.coalesce(F.bool_or(F.col("status") == "needs_selection"), F.lit(False)).alias("needs_selection"),
    )
