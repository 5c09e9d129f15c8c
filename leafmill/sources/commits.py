"""Tables that are written batch by batch and read through a log, so that a batch may be written again.

The rows of a batch go to a folder of their own, ``data/<batch>-<attempt>``. One small file per
batch, ``log/<batch>``, then names that folder and numbers the commit; it is replaced in one
move. Readers see the folders that the log names and nothing else: a writer that dies before
the log leaves rows that no one reads, and a batch that is written again takes the place of
its earlier rows.
"""
from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.functions.ordered import first_by
from leafmill.session import shared_files


class CommittedTable:
    """Batches of rows of ``schema`` in ``folder``. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def log(self) -> dict[str, dict]:
        """``folder`` and number ``at`` of every committed batch."""
        files, path = shared_files(f"{self.folder}/log")
        if files.get_file_info(path).type != fs.FileType.Directory:
            return {}
        out = {}
        for info in files.get_file_info(fs.FileSelector(path)):
            if not info.path.endswith(".new"):
                with files.open_input_stream(info.path) as f:
                    entry = json.loads(f.read())
                out[entry["batch"]] = entry
        return out

    def write(self, rows: DataFrame, batch: str, partition_by: Sequence[str] = ()) -> None:
        """Adds a batch, or puts these rows in the place of those that it had."""
        known = self.log()
        safe = re.sub(r"[^A-Za-z0-9-]", lambda m: f"_{ord(m[0]):x}_", batch)
        folder = f"data/{safe}-{uuid.uuid4().hex}"
        rows.select(*self.schema.fieldNames()).write.partitionBy(*partition_by).parquet(f"{self.folder}/{folder}")
        files, path = shared_files(self.folder)
        files.create_dir(f"{path}/log", recursive=True)
        entry = {"batch": batch, "folder": folder, "at": 1 + max((e["at"] for e in known.values()), default=0)}
        with files.open_output_stream(f"{path}/log/{safe}.new") as f:
            f.write(json.dumps(entry).encode())
        files.move(f"{path}/log/{safe}.new", f"{path}/log/{safe}")
        if batch in known:
            files.delete_dir(f"{path}/{known[batch]['folder']}")

    def rows(self, at: str | None = None) -> DataFrame:
        """Rows of all committed batches, with the number of their commit as column ``at`` if that is named."""
        out = None
        for entry in sorted(self.log().values(), key=lambda e: e["at"]):
            part = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{entry['folder']}").select(*self.schema.fieldNames())
            part = part if at is None else part.withColumn(at, F.lit(entry["at"]))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], self.schema)
            out = out if at is None else out.withColumn(at, F.lit(0))
        return out

    def newest_rows(self, keys: Sequence[str]) -> DataFrame:
        """Of the rows of one key those of the last batch that has it: a key written again replaces itself."""
        rows = self.rows("_at")
        last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_at").alias("_last"))
        same = F.col("_at") == F.col("_last")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(last, same, "left_semi").drop("_at")

    def newest_row(self, keys: list[str]) -> DataFrame:
        """One row per key, from the last batch that has it (of several in that batch any)."""
        return first_by(self.rows("_at"), keys, ["_at"], last=True).select(*self.schema.fieldNames())
