"""Tables laid out by key: a join on the key reads them without a shuffle, an upsert rewrites the slots it touches.

A table is a folder of Parquet files, ``slot=<s>/<bucket file>``. Rows of one key have one slot
(a digest of the key, a partition column) and one bucket (Spark's own bucketing), so

* scans are already distributed by key: only the other side of a join is shuffled;
* an upsert reads and writes the slots of its own keys; all other files stay as they are.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill.session import shared_files

SLOT = "_slot"


class KeyedTable:
    """Rows of ``schema``, one per value of ``keys``, in ``folder``, which all executors reach.

    ``slots`` and ``buckets`` belong to the folder: open it with the numbers it was made with.
    A bucket file holds about ``rows / (slots * buckets)`` rows. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], slots: int = 64, buckets: int = 64):
        self.spark, self.schema, self.keys, self.slots = spark, schema, list(keys), slots
        self.name = "keyed_" + hashlib.sha256(f"{folder}:{slots}:{buckets}".encode()).hexdigest()[:20]
        files, path = shared_files(folder)
        files.create_dir(path, recursive=True)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{k}`" for k in self.keys)
        spark.sql(
            f"""create table if not exists {self.name} ({columns}, {SLOT} int) using parquet
            options (partitionOverwriteMode 'dynamic') partitioned by ({SLOT})
            clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{folder}'"""
        )
        spark.catalog.recoverPartitions(self.name)  # slots that other sessions wrote

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.slots)).cast("int")

    def _read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """All rows, distributed by key. Empty before the first upsert."""
        return self._read().drop(SLOT)

    def upsert(self, batch: DataFrame, stamp: Sequence[str]) -> list[int]:
        """Writes ``batch``, one row per key, over older rows of its keys; returns the slots written.

        A stored row stays if its ``stamp`` is greater; equal stamps give way to the batch, so a
        batch may be written again. Slots are replaced one by one: if the writer dies between
        them, write the batch again. A null key ends the upsert with an error; null stamps are lowest.
        """
        some_null = F.greatest(*[F.col(k).isNull() for k in self.keys])
        whole = batch.select(*self.schema.names)
        checked = whole.withColumn(self.keys[0], F.when(some_null, F.raise_error(F.lit("a key of the batch is null"))).otherwise(F.col(self.keys[0])))
        touched = [r[0] for r in checked.select(self.slot()).distinct().collect()]  # at most self.slots numbers
        if not touched:
            return []
        old = self._read().where(F.col(SLOT).isin(touched)).drop(SLOT)
        # the struct tells a row that is there from one that is not; keys stay columns, so the stored side keeps its buckets
        both = old.select(*self.keys, F.struct(*self.schema.names).alias("_old")).join(
            checked.select(*self.keys, F.struct(*self.schema.names).alias("_new")), self.keys, "full_outer"
        )
        at = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in stamp])
        keep_old = F.col("_new").isNull() | (F.col("_old").isNotNull() & (at("_old") > at("_new")))
        merged = both.select(F.when(keep_old, F.col("_old")).otherwise(F.col("_new")).alias("r")).select("r.*")
        merged.select(*self.schema.names, self.slot().alias(SLOT)).write.insertInto(self.name, overwrite=True)
        self.spark.catalog.recoverPartitions(self.name)
        return sorted(touched)

    def drop(self) -> None:
        """Forgets the name in this session; the files stay."""
        self.spark.sql(f"drop table if exists {self.name}")
