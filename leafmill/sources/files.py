"""File manifests, plain-text documents, type routing, prompt templates, incremental intake."""
from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

import leafmill
from leafmill.functions.text import none_if_blank, stem, suffix

# The data source below travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(leafmill)

#: Files up to this size are read by Spark as one value; larger ones are streamed.
WHOLE_BYTES = 64 << 20
#: Bytes of a streamed file that a task holds.
BLOCK_BYTES = 4 << 20

# Suffix routing.
SUFFIX_TYPE = {"docx": "docx", "doc": "doc", "rtf": "rtf", "xlsx": "xlsx", "xls": "xlsx", "pdf": "pdf"}
TYPE_FAMILY = {"docx": "word", "doc": "word", "xlsx": "excel", "xls": "excel"}
ROUTED = ["word", "pdf", "excel", "rtf"]
TEMPLATE_PARTS = [
    "header",
    "selection_requirements",
    "extraction_requirements",
    "summary_requirements",
    "file_list_header",
    "file_list",
    "content_header",
    "content",
    "footer",
]


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


class OneFile(InputPartition):
    def __init__(self, path: str, uri: str, length: int, modified):
        self.path, self.uri, self.length, self.modified = path, uri, length, modified


class DigestReader(DataSourceReader):
    """One partition per file; a task reads its file block by block into the digest."""

    def __init__(self, options):
        folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.folder, self.glob, self.above = folder, options.get("glob", "*"), int(options.get("above", "-1"))

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        """File system, folder on it, and what makes a path on it a URI."""
        if "://" not in self.folder:
            return fs.LocalFileSystem(), self.folder, "file:"
        files, path = fs.FileSystem.from_uri(self.folder)
        return files, path, self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else self.folder.split("://")[0] + "://"

    def partitions(self) -> list[InputPartition]:
        files, path, prefix = self._open()
        root = path.rstrip("/")
        out = []
        for info in files.get_file_info(fs.FileSelector(root, recursive=True)):
            below = info.path[len(root) + 1 :].split("/")
            hidden = any(p.startswith(".") or (p.startswith("_") and "=" not in p) for p in below)  # as Spark's own readers leave out
            if info.type == fs.FileType.File and not hidden and (info.size > self.above or not info.size) and fnmatch.fnmatchcase(below[-1], self.glob):
                out.append(OneFile(info.path, prefix + info.path, info.size, info.mtime))
        return out

    def read(self, partition: OneFile | None) -> Iterator[tuple]:
        if partition is None:  # so Spark asks if there are no partitions
            return
        files, _, _ = self._open()
        digest = hashlib.sha256()
        with files.open_input_stream(partition.path) as stream:
            while block := stream.read(BLOCK_BYTES):
                digest.update(block)
        yield partition.uri, partition.modified, partition.length, digest.hexdigest()


class DigestSource(DataSource):
    """``spark.read.format("file_digests").option("glob", …).option("above", bytes).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return DigestReader(self.options)


def binary_manifest(spark: SparkSession, folder: str, glob: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Name, path, size and SHA-256 of every file, of any size.

    Small files are hashed in Spark's scan and dropped there. Spark's reader holds a file as
    one value, which ends at 2 GiB and costs that much memory before; so files above
    ``whole_bytes`` go through a data source that streams them, one task a file, and so do
    empty ones, which Spark's reader leaves out. The hash of
    a file does not depend on which of the two reads it.
    """
    spark.dataSource.register(DigestSource)
    small = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    small = small.where((F.col("length") <= whole_bytes) & (F.col("length") > 0)).select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))
    large = spark.read.format("file_digests").option("glob", glob).option("above", whole_bytes).load(folder)
    return small.unionByName(large).withColumn("name", F.element_at(F.split("path", "/"), -1))


def file_items(df: DataFrame, item: str) -> DataFrame:
    """Name and id of a file item: a bare name or an object; anything else is skipped."""
    v = F.try_parse_json(item)
    get = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    is_map = F.schema_of_variant(v).startswith("OBJECT")
    name = F.when(is_map, F.coalesce(none_if_blank(get("filename")), none_if_blank(get("name")))).when(
        F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")
    )
    file_id = F.when(is_map, F.coalesce(none_if_blank(get("id")), none_if_blank(get("file_id"))))
    return df.withColumn("name", name).withColumn("file_id", file_id).where("coalesce(name, '') <> ''")


def hash_items(items: DataFrame, contents: DataFrame) -> DataFrame:
    """Items with the SHA-256 of their file; a missing file gives an empty hash, not an error."""
    hashed = contents.select("name", F.sha2("content", 256).alias("sha256"))
    return items.join(hashed, "name", "left").withColumn("sha256", F.coalesce("sha256", F.lit("")))


def text_documents(files: DataFrame) -> DataFrame:
    """(path, content) rows of unknown suffix as plain-text documents.

    Unreadable bytes give an empty document with method ``failed``.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.where(_lookup(SUFFIX_TYPE, suffix(F.col("path"))).isNull()).select(
        "path",
        stem(F.col("path")).alias("name"),
        F.lit("PLAIN_TEXT").alias("content_type"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.when(text.isNotNull(), "fallback_text").otherwise("failed").alias("method"),
    )


def read_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def route(df: DataFrame, path: str = "path") -> DataFrame:
    """File type, extraction family and a status: an unhandled type is an error row."""
    kind = F.coalesce(_lookup(SUFFIX_TYPE, suffix(F.col(path))), F.lit("unknown"))
    family = F.coalesce(_lookup(TYPE_FAMILY, F.col("file_type")), F.col("file_type"))
    return (
        df.withColumn("file_type", kind)
        .withColumn("family", family)
        .withColumn("status", F.when(F.col("family").isin(ROUTED), "ok").otherwise("error"))
    )


def template_table(registry: DataFrame) -> DataFrame:
    """Prompt templates: the body file when present, else the structured parts joined by blank lines."""
    parts = F.transform(F.array(*[F.lit(p) for p in TEMPLATE_PARTS]), lambda k: F.try_element_at(F.col("parts"), k))
    joined = F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n\n")
    return registry.select("template_id", F.coalesce(none_if_blank(F.col("body")), joined).alias("template"))
