"""Task, tag, timing and log state as combinable aggregates (batch and stream alike)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.ordered import bucketed_last, first_by, trailing_count
from leafmill.functions.text import fixed_text, grain

# Stage labels and milestones.
STAGE_LABELS = {
    "pending": "等待处理",
    "preprocessing": "开始提取",
    "extraction": "开始提取",
    "generation": "开始生成",
    "postprocessing": "开始生成",
    "completed": "生成完毕",
    "failed": "生成失败",
}
MILESTONES = {
    "extraction_started": (10, "开始提取"),
    "extraction_completed": (40, "提取完毕"),
    "generation_started": (60, "开始生成"),
    "generation_completed": (90, "生成完毕"),
    "completed": (100, "生成完毕"),
}
DONE, FAILED = "生成完毕", "生成失败"
LEVELS = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
COMPLETE = "_complete"


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def task_state(events: DataFrame) -> DataFrame:
    """Latest progress per task.

    ``events``: task, ts, event_id, stage, message, progress, error. Completion
    gives 100 percent; a failure keeps the last percentage and stores its error.
    Every output is a max or min, so a hot task combines before the shuffle and
    the same query runs on a stream.
    """
    at = F.struct("ts", "event_id")
    failed = F.col("stage") == "failed"
    state = events.groupBy("task").agg(
        F.max_by(F.struct("stage", "message", "error"), at).alias("last"),
        F.max_by("progress", F.when(~failed, at)).alias("progress"),
        F.min(F.when(F.col("stage") != "pending", F.col("ts"))).alias("started_at"),
        F.max("ts").alias("updated_at"),
    )
    shown = (
        F.when(F.col("last.stage") == "completed", "生成完成")
        .when(F.col("last.stage") == "failed", F.concat(F.lit("失败: "), F.coalesce("last.error", F.lit(""))))
        .otherwise(F.col("last.message"))
    )
    return state.select(
        "task",
        F.col("last.stage").alias("stage"),
        shown.alias("message"),
        F.when(F.col("last.stage") == "completed", 100).otherwise(F.coalesce("progress", F.lit(0))).alias("progress"),
        "started_at",
        "updated_at",
        F.when(F.col("last.stage") == "failed", F.col("last.error")).alias("error"),
    )


def tag_state(events: DataFrame, keep_reset: bool = False) -> DataFrame:
    """State machine of each tag from the latest event of each kind.

    ``events``: tag, ts, event_id, kind in (start, stage, error, success, reset),
    stage. Since the last reset: an error after the last start means failed, else a
    success after it means success, else processing; without a start, error, then
    success, then pending. The order between error and success does not matter.
    A tag whose last event is a reset has no state; ``keep_reset`` shows it as
    ``reset`` instead, which a stream needs to withdraw an earlier state.
    """
    at = F.struct("ts", "event_id")
    last = lambda kind: F.max(F.when(F.col("kind") == kind, at))
    seen = events.groupBy("tag").agg(
        last("reset").alias("reset"),
        last("start").alias("start"),
        last("error").alias("error"),
        last("success").alias("success"),
        F.max(F.when(F.col("kind") == "stage", F.struct(at.alias("at"), F.col("stage").alias("stage")))).alias("staged"),
        F.max(F.when(F.col("kind") != "reset", at)).alias("any"),
    )
    since = lambda c: F.when(F.col("reset").isNull() | (F.col(c) > F.col("reset")), F.col(c))
    is_live = F.col("reset").isNull() | F.coalesce(F.col("any") > F.col("reset"), F.lit(False))
    live = (seen if keep_reset else seen.where(is_live)).select(
        "tag", is_live.alias("live"), since("start").alias("start"), since("error").alias("error"), since("success").alias("success"),
        F.when(F.col("reset").isNull() | (F.col("staged.at") > F.col("reset")), F.col("staged.stage")).alias("current_stage"),
    )
    after = lambda c: F.col(c).isNotNull() & (F.col("start").isNull() | (F.col(c) > F.col("start")))
    return live.select(
        "tag",
        F.when(~F.col("live"), "reset")
        .when(after("error"), "failed")
        .when(after("success"), "success")
        .when(F.col("start").isNotNull(), "processing")
        .otherwise("pending")
        .alias("status"),
        "current_stage",
        F.col("start.ts").alias("started_at"),
    )


def tag_errors(events: DataFrame) -> DataFrame:
    """Errors of each tag since its last reset, as rows."""
    at = F.struct("ts", "event_id")
    resets = events.where("kind = 'reset'").groupBy("tag").agg(F.max(at).alias("reset"))
    errors = events.where("kind = 'error'")
    return errors.join(resets, "tag", "left").where(F.col("reset").isNull() | (at > F.col("reset"))).drop("reset")


def tag_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("tags"))


def stage_label(stage: Column) -> Column:
    return _lookup(STAGE_LABELS, stage)


def milestone_rows(events: DataFrame, kind: str) -> DataFrame:
    """Percentage and label of milestone events."""
    percents = {k: v[0] for k, v in MILESTONES.items()}
    labels = {k: v[1] for k, v in MILESTONES.items()}
    return events.withColumn("percent", _lookup(percents, F.col(kind))).withColumn("label", _lookup(labels, F.col(kind))).where(
        "percent is not null"
    )


def final_label(failed: Column, status: Column) -> Column:
    """Recorded failure first, then the result's own status."""
    return F.when(failed | (F.coalesce(status, F.lit("success")) != "success"), FAILED).otherwise(DONE)


def timing_summary(timings: DataFrame) -> DataFrame:
    """Count, total, extremes and mean per operation and over all; ``grain`` tells the two apart."""
    return timings.rollup("name").agg(
        grain("name", "operation"),
        F.count(F.lit(1)).alias("count"),
        F.sum("duration").alias("total_duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        F.avg("duration").alias("avg_duration"),
    )


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 1, F.concat(fixed_text(seconds * 1000, 2), F.lit("ms")))
        .when(seconds < 60, F.concat(fixed_text(seconds, 2), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), fixed_text(seconds % 60, 2), F.lit("s")))
    )


def log_counters(logs: DataFrame, task: str = "task") -> DataFrame:
    """Rows per level, total, and whether there are errors."""
    counts = [F.count_if(F.col("level") == lv).alias(lv.lower()) for lv in LEVELS]
    return logs.groupBy(task).agg(
        *counts, F.count(F.lit(1)).alias("total_logs"), F.bool_or(F.col("level") == "ERROR").alias("has_errors")
    )


def recent_tasks(tasks: DataFrame, limit: int = 100) -> DataFrame:
    """Newest tasks first; the limit is the feature (each partition keeps only its own best)."""
    return tasks.orderBy(F.col("created_at").desc(), F.col("task").desc()).limit(limit)


def request_rate(requests: DataFrame, key: str, micros: Column, width: int, max_requests: int) -> DataFrame:
    """Requests of the same key in the trailing window, and whether they exceed the limit."""
    return trailing_count(requests, [key], micros, width).withColumn("violation", F.col("recent") > max_requests)


def event_feed(events: DataFrame, tile: Column) -> DataFrame:
    """Events delivered to registered requests.

    ``events``: request, ts, event_id, kind. An event is delivered when the last
    control event before it is a registration; the completion marker is the last
    one delivered. Exact for requests of any size (bucket by bucket).
    """
    return event_gates(events, tile).where("gate = 'register' and kind <> 'register'").drop("gate")


def event_gates(events: DataFrame, tile: Column) -> DataFrame:
    """Adds ``gate``: the last control event of the request before each event."""
    control = F.when(F.col("kind").isin("register", COMPLETE), F.col("kind"))
    return bucketed_last(events, ["request"], ["ts", "event_id"], tile, control, "gate")


def batch_tally(results: DataFrame, batch: str) -> DataFrame:
    """Totals of each batch with its elapsed seconds."""
    return results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") != "success").alias("failed"),
        F.sum("elapsed").alias("elapsed"),
    )


def batch_errors(results: DataFrame, batch: str) -> DataFrame:
    return results.where("status <> 'success'").select(batch, "file", "error")


def session_logs(logs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Log rows whose session is known."""
    return logs.join(sessions.select("session").distinct(), "session", "left_semi")


def latest_per_key(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Newest snapshot of each key from an append-only state table."""
    return first_by(snapshots, keys, ["batch_id"], last=True).drop("batch_id")
