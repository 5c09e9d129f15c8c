"""Helpers shared by the corpus operators."""
from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import cut_lineage, shared_dir, small_batches

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the Python workers, once per application (as ``--py-files`` would).

    The archive is built in the driver's temporary folder; Spark copies it to every executor.
    Whole texts travel to the workers in Arrow batches: where the session has Spark's default
    of 10,000 rows a batch, 512 are set, so that a worker holds few texts at a time.
    """
    small_batches(spark)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        import leafmill

        home = os.path.dirname(os.path.abspath(leafmill.__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="leafmill-src-"), "leafmill_src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(home):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(home)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared storage."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder and read again: for wide rows, which a checkpoint would not compress."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(df: DataFrame, key: Column, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows (all, if there are no more), picked by a hash of ``key``: the same at every run and order of rows."""
    total = df.count()
    if total <= rows:
        return df
    scale = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(scale)) < F.lit(int(scale * rows / total)))


def split_words(text: str) -> list[bytes]:
    """UTF-8 words; ``bytes.split`` cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split()


LETTERS = re.compile(r"[^\W\d_]+")
