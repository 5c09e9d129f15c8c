"""Streaming forms of the telemetry operators and the file intake.

State goes out in update mode through ``foreachBatch`` into one folder per
micro-batch (rewriting a batch after a failure replaces it), in the shared
folder of the cluster.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from leafmill.operators.telemetry import COMPLETE, event_gates, log_counters, tag_state, task_state
from leafmill.session import cut_lineage, shared_dir
from leafmill.streaming.levels import LevelledTable

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    """Files of ``folder`` by name, or those below a folder of that name, as a table of many files has.

    Spark takes a path without a pattern for a folder; so the last character of a plain
    name is put in brackets, and the name stands for either.
    """
    name = glob if any(c in glob for c in "*?[{") else f"{glob[:-1]}[{glob[-1]}]"
    return spark.readStream.format("parquet").schema(schema).load(f"{folder}/{name}")


def start_to_folder(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run over what is available and write each micro-batch to its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def run_available(stream: DataFrame, mode: str = "update") -> DataFrame:
    """All written rows of one available-now run, with their ``batch_id``."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = start_to_folder(stream, f"{base}/rows", f"{base}/checkpoint", mode)
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(schema).parquet(f"{base}/rows")


def run_state(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Latest state per key after an available-now run of an update-mode query, from a table that is merged as it grows."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    table = LevelledTable(spark, f"{base}/rows", keys, stream.schema)
    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(table.write)
        .start()
    )
    query.awaitTermination()
    return table.rows().drop("batch_id")


def task_state_stream(events: DataFrame) -> DataFrame:
    return task_state(events)


def tag_state_stream(events: DataFrame) -> DataFrame:
    """Readers of the state table leave out rows with status ``reset``."""
    return tag_state(events, keep_reset=True)


def log_counter_stream(logs: DataFrame) -> DataFrame:
    return log_counters(logs)


def timing_stream(timings: DataFrame) -> DataFrame:
    """Running timing summary per operation, mean included."""
    return timings.groupBy("name").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("duration").alias("total_duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        F.avg("duration").alias("avg_duration"),
    )


def windowed_log_counts(logs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Level counts per event-time window; rows later than the watermark are dropped by Spark and counted in its metrics."""
    return (
        logs.withWatermark("ts", WATERMARK)
        .groupBy(F.window("ts", width).alias("w"), "level")
        .agg(F.count(F.lit(1)).alias("logs"))
        .select(F.col("w.start").alias("start"), "level", "logs")
    )


def run_feed(events: DataFrame, width: str = "hour") -> DataFrame:
    """Delivered events of a stream of ``request, ts, event_id, kind``: the batch feed's rows, whatever the order of arrival.

    Every micro-batch is added to a log that is partitioned by time tile, with the last
    control event of each request and tile beside it, in a table that is merged as it grows
    and of which a batch reads its own requests. An arriving row can only change what
    lies behind it in its request, so the requests of a batch are decided anew from the
    batch's earliest tile on, starting from the gate that the earlier tiles leave. A decision
    is ``delivered`` or not; the last one on an event holds. A repeated batch replaces itself.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    columns = ["request", "ts", "event_id", "kind"]
    tile = F.date_trunc(width, "ts")
    control = F.col("kind").isin("register", COMPLETE)
    gate_columns = ["request", F.lit(0).cast("long").alias("tile"), F.struct("ts", "event_id", "kind").alias("gate")]
    gate_table = LevelledTable(spark, f"{base}/gates", ["request", "tile"], events.select(*gate_columns).schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.select(*columns, F.unix_seconds(tile.cast("timestamp")).alias("tile"))
        own = cut_lineage(own)
        own.write.mode("overwrite").partitionBy("tile").parquet(f"{base}/log/batch_id={batch_id}")
        gates = own.where(control).groupBy("request", "tile").agg(F.max(F.struct("ts", "event_id", "kind")).alias("gate"))
        # a tile's last control event may have come in an earlier batch
        earlier = gate_table.rows(gates.select("request", "tile")).select("request", "tile", "gate")
        gate_table.write(cut_lineage(gates.unionByName(earlier).groupBy("request", "tile").agg(F.max("gate").alias("gate"))), batch_id)
        first = own.agg(F.min("tile").alias("t")).first()["t"]
        if first is None:
            return
        touched = own.select("request").distinct()
        log = spark.read.parquet(f"{base}/log").where((F.col("batch_id") <= batch_id) & (F.col("tile") >= first))
        known = gate_table.rows(touched)
        carried = known.where(F.col("tile") < first).groupBy("request").agg(F.max("gate").alias("gate"))
        rows = log.select(*columns, F.lit(False).alias("carried")).unionByName(carried.select("request", "gate.*", F.lit(True).alias("carried")))
        placed = event_gates(rows.join(touched, "request", "left_semi"), tile)
        delivered = F.coalesce((F.col("gate") == "register") & (F.col("kind") != "register"), F.lit(False))
        decided = placed.where("not carried").select(*columns, delivered.alias("delivered"))
        decided.write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")

    query = (
        events.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    schema = events.select(*columns).schema.add("delivered", "boolean").add("batch_id", "long")
    decisions = spark.read.schema(schema).parquet(f"{base}/rows")
    last = decisions.groupBy(*columns).agg(F.max(F.struct("batch_id", "delivered")).alias("last"))
    return last.where("last.delivered").select(*columns)


#: Rows that go into one entry of the list state.
PACK_ROWS = 1 << 16


def _packed(parts: list[pa.Table]) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    table = pa.concat_tables(parts).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _trailing(codes: np.ndarray, times: np.ndarray, width: int) -> np.ndarray:
    """Rows of the same code within ``width`` before each row, itself and its equals included."""
    # codes are set apart on one axis by more than the longest look back, a slab of codes at a time where it would end
    offset = times - times.min()
    apart = int(offset.max()) + width + 1
    slab = max(1, (1 << 62) // apart)
    out = np.zeros(len(times), dtype=np.int64)
    for first in range(0, int(codes.max()) + 1, slab):
        some = np.flatnonzero((codes >= first) & (codes < first + slab))
        place = (codes[some] - first) * apart + offset[some]
        ordered = np.sort(place)
        out[some] = np.searchsorted(ordered, place, "right") - np.searchsorted(ordered, place - width, "right")
    return out


class TrailingCount(StatefulProcessor):
    """Counts of the keys of one bucket and tile: rows wait in list state until the watermark has passed the tile, then all of it goes.

    An entry of the state holds many rows as one Arrow table, so that a group costs a few
    calls to the state store, whatever its size.
    """

    SCHEMA = pa.schema([("k", pa.string()), ("us", pa.int64()), ("id", pa.string()), ("own", pa.bool_())])

    def __init__(self, width: int, max_requests: int):
        self.width, self.max_requests = width, max_requests

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "pack binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            self.handle.registerTimer((int(key[1]) + 1) * self.width // 1000)
        parts, held = [], 0
        for part in rows:
            parts.append(pa.Table.from_pandas(part[self.SCHEMA.names], self.SCHEMA, preserve_index=False))
            held += len(part)
            if held >= PACK_ROWS:
                self.rows.appendValue(_packed(parts))
                parts, held = [], 0
        if parts:
            self.rows.appendValue(_packed(parts))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pa.concat_tables([pa.ipc.open_stream(bytes(pack)).read_all() for (pack,) in self.rows.get()])
        self.rows.clear()
        k = held["k"].combine_chunks().dictionary_encode(null_encoding="encode")
        recent = _trailing(k.indices.to_numpy().astype(np.int64), held["us"].to_numpy(), self.width)
        own = held["own"].to_numpy()
        if own.any():
            shown = held.select(["k", "id"]).filter(pa.array(own)).to_pandas()
            yield shown.assign(recent=recent[own], violation=recent[own] > self.max_requests)

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which list state and timers need; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def request_rate_stream(requests: DataFrame, key: str, event_id: str, ts: str, width: int, max_requests: int, delay: str = WATERMARK, buckets: int = 16) -> DataFrame:
    """Streaming form of ``request_rate``: ``key, event_id, recent, violation``, each request once, when it is final.

    Time is cut into tiles of ``width`` microseconds (whole milliseconds). A request waits
    in its own tile and is lent to the next one; once the watermark, ``delay`` behind the
    latest request, has passed a tile, its requests are counted and its state is dropped, so
    a key that falls silent leaves nothing behind and a hot key is spread over its tiles.
    A tile's keys are dealt to ``buckets`` groups, so that few rows do not make many groups.
    Requests may arrive in any order inside the watermark; later ones are dropped by Spark
    and counted in its metrics. Needs ``rocks_state`` where the query is started.
    """
    at = F.col(ts).cast("timestamp")
    timed = requests.select(at.alias("at"), F.col(key).cast("string").alias("k"), F.col(event_id).cast("string").alias("id"), F.unix_micros(at).alias("us")).withWatermark("at", delay)
    lent = timed.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "tile", F.floor(F.col("us") / width) + F.when(F.col("own"), 0).otherwise(1)
    )
    grouped = lent.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets))).groupBy("bucket", "tile")
    counted = grouped.transformWithStateInPandas(TrailingCount(width, max_requests), "k string, id string, recent long, violation boolean", "Append", "eventTime")
    typed = [F.col(c).cast(requests.schema[name].dataType).alias(name) for c, name in (("k", key), ("id", event_id))]
    return counted.select(*typed, "recent", "violation")


#: Time of the row that ends a feed, late in what nanoseconds of 64 bits hold: the watermark passes every tile before it.
END = "2250-01-01 00:00:00"


def run_request_rate(requests: DataFrame, key: str, event_id: str, ts: str, width: int, max_requests: int, delay: str = WATERMARK, buckets: int = 16) -> DataFrame:
    """All rows of ``request_rate_stream`` over what is available, after which the feed is ended.

    The end is a row of its own, in a second run of the same query, so that the tiles that
    are still open count as well.
    """
    spark = requests.sparkSession
    base = f"{shared_dir(spark)}/rate-{uuid.uuid4().hex}"
    slim = requests.select(key, event_id, ts)
    spark.createDataFrame([], slim.schema).write.parquet(f"{base}/end")
    both = slim.unionByName(spark.readStream.schema(slim.schema).parquet(f"{base}/end"))
    for last in (False, True):
        if last:
            row = [F.lit(None).cast(slim.schema[c].dataType).alias(c) if c != ts else F.lit(END).cast(slim.schema[ts].dataType).alias(ts) for c in slim.columns]
            spark.range(1).select(*row).write.mode("append").parquet(f"{base}/end")
        with rocks_state(spark):
            query = start_to_folder(request_rate_stream(both, key, event_id, ts, width, max_requests, delay, buckets), f"{base}/rows", f"{base}/checkpoint", "append")
        query.awaitTermination()
    schema = request_rate_stream(both, key, event_id, ts, width, max_requests, delay, buckets).schema
    return spark.read.schema(schema).parquet(f"{base}/rows")


def intake(
    files: DataFrame, process: Callable[[DataFrame], DataFrame], packages: str, results: str, checkpoint: str
) -> StreamingQuery:
    """Process arriving files; each gives one result row, a failure does not stop the others.

    ``process`` turns a batch into rows with ``path, status, error`` and the
    package columns; failed rows only reach the result table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = cut_lineage(process(batch))  # both tables show the same outcome, and a file is processed once
        done.where("status = 'success'").drop("status", "error").write.mode("overwrite").parquet(
            f"{packages}/batch_id={batch_id}"
        )
        done.select("path", "status", "error").write.mode("overwrite").parquet(f"{results}/batch_id={batch_id}")

    return (
        files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
