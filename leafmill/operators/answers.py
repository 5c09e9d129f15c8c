"""Answers of a model kept in a table, so that no prompt is paid for twice.

A store is a folder in the shared storage::

    answers/task=…/attempt=…/bucket=…/   committed answers
    log/run=…/part=…/                    answers of a bucket as they arrive, written by the tasks themselves

Prompts are dealt to buckets by their hash; a bucket is worked on by one task. The task
writes every list of answers to the log before it goes on, so another attempt of it finds
them there and asks only the rest. A run that ends well is committed: its log becomes rows
of ``answers``. The log of a run that died is read like the table, and committed by the next.
"""
from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.model import CONCURRENCY, FAILED, Backend, OfflineBackend, Pace, answers_of
from leafmill.session import shared_dir, shared_files, small_batches

LOGGED = "task string, attempt int, bucket int, prompt_hash string, output string, failed boolean"
KEPT = "prompt_hash string, output string, run string, task string, attempt int, bucket int"
_LOG_TYPE = pa.schema([("task", pa.string()), ("attempt", pa.int32()), ("bucket", pa.int32()), ("prompt_hash", pa.string()), ("output", pa.string()), ("failed", pa.bool_())])


class AnswerStore:
    """Answers of all runs in ``folder``; ``buckets`` is the number of tasks that ask at once and stays the same for a folder. One run at a time."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64):
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = buckets

    def _logs(self) -> DataFrame:
        files, path = shared_files(f"{self.folder}/log")
        if files.get_file_info(path).type != fs.FileType.Directory:
            return self.spark.createDataFrame([], f"{LOGGED}, run string, part int")
        return self.spark.read.schema(f"{LOGGED}, run string, part int").parquet(f"{self.folder}/log")

    def _table(self) -> DataFrame:
        files, path = shared_files(f"{self.folder}/answers")
        if files.get_file_info(path).type != fs.FileType.Directory:
            return self.spark.createDataFrame([], KEPT)
        return self.spark.read.schema(KEPT).parquet(f"{self.folder}/answers")

    def known(self, task: str, attempt: int) -> DataFrame:
        """``bucket, prompt_hash, output`` of good answers: one winner per prompt, that of the first run by name."""
        one = (F.col("task") == task) & (F.col("attempt") == attempt)
        rows = self._table().where(one).select("bucket", "prompt_hash", "output", "run")
        logged = self._logs().where(one & ~F.col("failed")).select("bucket", "prompt_hash", "output", "run")
        return rows.unionByName(logged).groupBy("bucket", "prompt_hash").agg(F.min_by("output", F.struct("run", "output")).alias("output"))

    def commit(self) -> None:
        """Moves the logs of all runs into the table; what a died commit left is done again and gives each answer once."""
        runs = [r["run"] for r in self._logs().select("run").distinct().collect()]  # one row per open run
        files, path = shared_files(self.folder)
        for run in sorted(runs):
            good = self._logs().where((F.col("run") == run) & ~F.col("failed"))
            new = good.join(self._table().where(F.col("run") != run).select("task", "attempt", "bucket", "prompt_hash"), ["task", "attempt", "bucket", "prompt_hash"], "left_anti")
            won = new.groupBy("task", "attempt", "bucket", "prompt_hash").agg(F.min("output").alias("output"), F.first("run").alias("run"))
            left = won.join(self._table().where(F.col("run") == run).select("task", "attempt", "bucket", "prompt_hash"), ["task", "attempt", "bucket", "prompt_hash"], "left_anti")
            left.repartition("bucket").write.mode("append").partitionBy("task", "attempt", "bucket").parquet(f"{self.folder}/answers")
            files.delete_dir(f"{path}/log/run={run}")


def bucket_of(hash_column: str, buckets: int):
    return F.pmod(F.xxhash64(hash_column), F.lit(buckets)).cast("int")


def ask_once(
    prompts: DataFrame,
    store: AnswerStore,
    prompt: str = "prompt",
    task: str = "extraction",
    backend: Backend | None = None,
    attempt: int = 1,
    rate: float | None = None,
    batch_size: int = 1,
    concurrency: int = CONCURRENCY,
) -> DataFrame:
    """``prompt_hash, output`` for every distinct prompt, read from the store; only what it lacks is asked.

    Answers are stored under task, ``attempt`` and the prompt's hash, so a repeated question
    (``retry_until_parsed``) has an answer of its own, and a second run replays it. The model
    is called here, before the frame is returned: actions on it only read. A task that is
    tried again, and a run after one that died, ask what no earlier attempt has logged; at
    most the lists in flight at that moment are asked again. With speculative execution two
    attempts may ask at once; one answer wins. ``rate`` is the total of calls per second,
    retries included. A failed answer is returned as ``FAILED …`` and not stored.
    """
    client = backend or OfflineBackend()
    spark, buckets, run = store.spark, store.buckets, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    log = f"{store.folder}/log/run={run}"
    gap = buckets / rate if rate else 0.0
    hashed = prompts.where(F.col(prompt).isNotNull()).select(F.sha2(prompt, 256).alias("prompt_hash"), F.col(prompt).alias("prompt"))
    wanted = hashed.withColumn("bucket", bucket_of("prompt_hash", buckets))
    distinct = wanted.dropDuplicates(["bucket", "prompt_hash"])
    missing = distinct.join(store.known(task, attempt), ["bucket", "prompt_hash"], "left_anti").repartition(buckets, "bucket")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = shared_files(log)
        pace = Pace(gap)
        logged: dict[int, set[str]] = {}  # by bucket: hashes that an earlier attempt of this task has answered

        def answered(bucket: int) -> set[str]:
            if bucket not in logged:
                folder = f"{base}/part={bucket}"
                files.create_dir(folder, recursive=True)
                found = [i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.path.endswith(".parquet")]
                logged[bucket] = {h for p in found for h in pq.read_table(p, columns=["prompt_hash"], filesystem=files)["prompt_hash"].to_pylist()}
            return logged[bucket]

        def ask(bucket: int, hashes: list[str], some: list[str]) -> int:
            outputs = answers_of(client, some, task, time.sleep, pace)
            rows = [{"task": task, "attempt": attempt, "bucket": bucket, "prompt_hash": h, "output": o, "failed": o.startswith(FAILED)} for h, o in zip(hashes, outputs)]
            name = f"{base}/part={bucket}/{uuid.uuid4().hex}"
            pq.write_table(pa.Table.from_pylist(rows, schema=_LOG_TYPE), f"{name}.tmp", filesystem=files)
            files.move(f"{name}.tmp", f"{name}.parquet")  # seen whole or not at all
            return len(rows)

        done = 0
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            open_calls: set = set()
            for batch in batches:
                for bucket, part in batch.groupby("bucket"):
                    part = part[~part["prompt_hash"].isin(answered(int(bucket)))]
                    hashes, texts = list(part["prompt_hash"]), list(part["prompt"])
                    for i in range(0, len(texts), batch_size):
                        if len(open_calls) >= 2 * concurrency:
                            ready, open_calls = wait(open_calls, return_when=FIRST_COMPLETED)
                            done += sum(f.result() for f in ready)
                        open_calls.add(pool.submit(ask, int(bucket), hashes[i : i + batch_size], texts[i : i + batch_size]))
            done += sum(f.result() for f in open_calls)
        yield pd.DataFrame({"asked": [done]})

    small_batches(missing.sparkSession)
    missing.mapInPandas(call, "asked long").write.format("noop").mode("overwrite").save()
    failed = spark.createDataFrame([], "prompt_hash string, output string")
    files, base = shared_files(log)
    if files.get_file_info(base).type == fs.FileType.Directory:
        own = store._logs().where((F.col("run") == run) & F.col("failed"))
        # few as a rule, and the log goes with the commit: kept aside
        own.select("prompt_hash", "output").dropDuplicates(["prompt_hash"]).write.mode("overwrite").parquet(f"{store.folder}/failed/run={run}")
        failed = spark.read.schema("prompt_hash string, output string").parquet(f"{store.folder}/failed/run={run}")
    store.commit()
    outputs = wanted.select("bucket", "prompt_hash").distinct().join(store.known(task, attempt), ["bucket", "prompt_hash"])
    return outputs.select("prompt_hash", "output").unionByName(failed)
