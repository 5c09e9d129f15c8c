"""The one step that is not relational: text out of a model, as a column.

A backend is any picklable object with ``generate(prompts, task) -> list[str]``.
Spark partitions the distinct prompts; each task sends lists of prompts through a small
pool of threads and paces them with its share of the total rate.
"""
from __future__ import annotations

import hashlib
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import leafmill
from leafmill.session import cut_lineage, small_batches

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(leafmill)

# Failure mark and call limits.
FAILED = "[生成失败]"
ATTEMPTS = 3
BACKOFF = 1.5
BACKOFF_CAP = 10.0
CONCURRENCY = 4


class Backend(Protocol):
    def generate(self, prompts: list[str], task: str) -> list[str]: ...


class OfflineBackend:
    """Deterministic stand-in: answers with a digest of the prompt."""

    def generate(self, prompts: list[str], task: str) -> list[str]:
        return [f"{task}:{hashlib.md5(p.encode()).hexdigest()}" for p in prompts]


def _answer(backend: Backend, prompt: str, task: str, sleep: Callable[[float], None], pace: Pace | None = None) -> str:
    """One prompt with retries, each of them paced; a ``retry_after`` attribute on the error sets the wait."""
    error: Exception | None = None
    for attempt in range(ATTEMPTS):
        try:
            if pace:
                pace.wait()
            return backend.generate([prompt], task)[0]
        except Exception as exc:  # noqa: BLE001 - every failure becomes a row
            error = exc
            if attempt + 1 < ATTEMPTS:
                wait = getattr(exc, "retry_after", None) or min(BACKOFF_CAP, BACKOFF**attempt) + random.uniform(0, 0.3)
                sleep(wait)
    return f"{FAILED} {error}"


def answers_of(backend: Backend, prompts: list[str], task: str, sleep: Callable[[float], None], pace: Pace | None = None) -> list[str]:
    """A list of prompts in one call; a list that fails is asked prompt by prompt, so one bad prompt spoils no other."""
    if len(prompts) > 1:
        try:
            if pace:
                pace.wait()
            found = backend.generate(prompts, task)
            if len(found) == len(prompts):
                return found
        except Exception:  # noqa: BLE001,S110 - asked again one by one
            pass
    return [_answer(backend, p, task, sleep, pace) for p in prompts]


class Pace:
    """Lets one call begin every ``gap`` seconds, over all threads of a task."""

    def __init__(self, gap: float):
        self.gap = gap
        self.next = 0.0
        self.lock = threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            time.sleep(at - now)


def model_column(
    prompts: DataFrame,
    prompt: str = "prompt",
    task: str = "extraction",
    backend: Backend | None = None,
    rate: float | None = None,
    partitions: int | None = None,
    batch_size: int = 1,
    concurrency: int = CONCURRENCY,
) -> DataFrame:
    """``prompt_hash, output`` for every distinct prompt.

    Equal prompts are asked once per action (``answers.ask_once`` keeps them), in lists of ``batch_size``, by ``concurrency`` threads a
    task. ``rate`` is the total of calls per second, retries included; each of ``partitions`` tasks keeps to
    its share of it, so the total holds however many of them run at once. With a rate and
    no ``partitions`` there is one task.
    """
    small_batches(prompts.sparkSession)
    client = backend or OfflineBackend()
    tasks = partitions or (1 if rate else None)
    gap = (tasks or 1) / rate if rate else 0.0

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(gap)

        def ask(some: list[str]) -> list[str]:
            return answers_of(client, some, task, time.sleep, pace)

        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                asked = list(batch["prompt"])
                lists = [asked[i : i + batch_size] for i in range(0, len(asked), batch_size)]
                yield pd.DataFrame({"prompt_hash": batch["prompt_hash"], "output": [x for found in pool.map(ask, lists) for x in found]})

    distinct = prompts.select(F.sha2(prompt, 256).alias("prompt_hash"), F.col(prompt).alias("prompt")).dropDuplicates(
        ["prompt_hash"]
    )
    if tasks:
        distinct = distinct.repartition(tasks)
    return distinct.mapInPandas(call, "prompt_hash string, output string")


def with_outputs(rows: DataFrame, outputs: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Rows with the stored output of their prompt."""
    return rows.withColumn("prompt_hash", F.sha2(prompt, 256)).join(outputs, "prompt_hash", "left")


def missing_prompts(rows: DataFrame, outputs: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Rows whose prompt has no stored output yet, so a re-run never asks twice."""
    return rows.withColumn("prompt_hash", F.sha2(prompt, 256)).join(
        outputs.select("prompt_hash"), "prompt_hash", "left_anti"
    )


def retry_until_parsed(
    prompts: DataFrame,
    key: str,
    ask: Callable[[DataFrame, int], DataFrame],
    parse: Callable[[DataFrame], DataFrame],
    attempts: int = ATTEMPTS,
    empty_is_failure: bool = True,
) -> DataFrame:
    """At most ``attempts`` passes; each asks only what is still unparsed.

    ``ask(pending, attempt)`` adds ``output``; ``parse`` adds ``json`` (NULL when
    it failed). Every pass is checkpointed, so outputs are never asked for again
    after a lost executor. Rows that never parse come back with NULL ``json``.
    """
    pending, done = prompts, None
    last = None
    for attempt in range(1, attempts + 1):
        answered = cut_lineage(parse(ask(pending, attempt)).withColumn("attempt", F.lit(attempt)))
        ok = F.col("json").isNotNull()
        if empty_is_failure:
            ok = ok & ~F.col("json").isin("{}", "[]", "null")
        good = answered.where(ok)
        done = good if done is None else done.unionByName(good)
        last = answered.where(~F.coalesce(ok, F.lit(False)))
        pending = prompts.join(last.select(key), key, "left_semi")
    return done.unionByName(last.withColumn("json", F.lit(None).cast("string")))
