"""A table of per-batch snapshots that is merged as it grows, so that a read touches few folders.

Micro-batch ``n`` writes the folder ``l0/n``. When ``fan`` folders of a level are full they
become one of the next level, with one row per key: the folders that count are the digits of
the number of batches to the base ``fan``, so a reader needs that number only, and after
``n`` batches it reads at most ``(fan - 1) * log(n)`` folders. The number is one small file
that is replaced in one move, after everything it speaks of is written. A batch that is
repeated after a failure writes the same folders again.
"""
from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.functions.ordered import first_by
from leafmill.session import shared_files


class LevelledTable:
    """Newest row per key of all batches in ``folder``; ``schema`` is that of a batch."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: StructType, fan: int = 8):
        self.spark, self.folder, self.keys, self.fan = spark, folder.rstrip("/"), keys, fan
        self.schema = StructType([*schema.fields, StructField("batch_id", LongType())])

    def batches(self) -> int:
        """Number of batches that are written whole."""
        files, path = shared_files(self.folder)
        if files.get_file_info(f"{path}/head").type != fs.FileType.File:
            return 0
        with files.open_input_stream(f"{path}/head") as f:
            return int(f.read())

    def live(self, count: int) -> list[str]:
        """Folders that hold the first ``count`` batches, oldest first."""
        out, level, at = [], 0, count
        while at:
            out += [f"{self.folder}/l{level}/{k}" for k in range(at - at % self.fan, at)][::-1]
            at //= self.fan
            level += 1
        return out[::-1]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a batch and merges what it completes; ``batch_id`` counts from 0 without gaps."""
        if batch_id < self.batches():
            return  # repeated after it was whole
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.folder}/l0/{batch_id}")
        level, at, merged = 0, batch_id + 1, []
        while at % self.fan == 0:
            parts = [f"{self.folder}/l{level}/{k}" for k in range(at - self.fan, at)]
            at //= self.fan
            level += 1
            self._newest(self.spark.read.schema(self.schema).parquet(*parts)).write.mode("overwrite").parquet(f"{self.folder}/l{level}/{at - 1}")
            merged += parts
        files, path = shared_files(self.folder)
        with files.open_output_stream(f"{path}/head.new") as f:
            f.write(str(batch_id + 1).encode())
        files.move(f"{path}/head.new", f"{path}/head")
        for part in merged:  # no reader of the new head needs them
            files.delete_dir(shared_files(part)[1])

    def _newest(self, rows: DataFrame) -> DataFrame:
        newest = first_by(rows.withColumn("_at", F.col("batch_id")), self.keys, ["_at"], last=True)
        return newest.select(*self.schema.fieldNames())

    def rows(self, only: DataFrame | None = None) -> DataFrame:
        """Newest row per key with its ``batch_id``; ``only`` (some key columns) limits the rows that are read."""
        count = self.batches()
        if not count:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(*self.live(count))
        return self._newest(found if only is None else found.join(only, only.columns, "left_semi"))
