"""Queries of the telemetry and streaming family."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.operators import telemetry as T
from leafmill.plans.family import family
from leafmill.plans.recipes import load
from leafmill.session import shared_dir
from leafmill.sources.files import route
from leafmill.streaming import telemetry as ST

QUERIES, SQL, query = family()


def text(c):
    return F.col(c).cast("string")


def kind_map(c, table):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c))


def event_stream(spark, d):
    schema = load(spark, d, "events").schema
    return ST.file_stream(spark, d, "events.parquet", schema)


# --- tasks ------------------------------------------------------------------------------------


def task_events(e):
    """A user is a task; the event type gives the stage."""
    stages = {"signup": "pending", "view": "extraction", "click": "generation", "purchase": "completed", "error": "failed"}
    return e.select(
        F.col("user_id").alias("task"),
        "ts",
        "event_id",
        kind_map("event_type", stages).alias("stage"),
        F.concat(F.lit("m"), text("event_id")).alias("message"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.floor(F.col("value")).cast("int")).alias("progress"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), text("event_id"))).alias("error"),
    )


TASK_SQL = """select user_id as task, s as stage, case s when 'completed' then '生成完成' when 'failed' then '失败: e' || id else 'm' || id end as message,
  case when s = 'completed' then 100 else coalesce(p, 0) end as progress, started_at, updated_at, case when s = 'failed' then 'e' || id end as error
from (select user_id, max_by(s, (ts, event_id)) as s, max_by(event_id, (ts, event_id)) as id, max_by(p, (ts, event_id)) filter (where s <> 'failed') as p, min(ts) filter (where s <> 'pending') as started_at, max(ts) as updated_at
  from (select *, case event_type when 'signup' then 'pending' when 'view' then 'extraction' when 'click' then 'generation' when 'purchase' then 'completed' else 'failed' end as s, floor(value)::bigint as p from events) group by user_id)"""


def _task(df):
    return df.withColumn("progress", F.col("progress").cast("bigint"))


@query("str_1_task_state", TASK_SQL)
def str_1(spark, d):
    return _task(T.task_state(task_events(load(spark, d, "events"))))


@query("str_1_task_state_stream", TASK_SQL)
def str_1_stream(spark, d):
    return _task(ST.run_state(ST.task_state_stream(task_events(event_stream(spark, d))), ["task"]))


# --- tags -------------------------------------------------------------------------------------


def tag_events(e):
    kinds = {"signup": "start", "view": "stage", "click": "stage", "purchase": "success", "error": "error"}
    return e.select(
        F.col("user_id").alias("tag"),
        "ts",
        "event_id",
        F.when(F.col("event_id") % 50 == 7, "reset").otherwise(kind_map("event_type", kinds)).alias("kind"),
        F.when(F.col("event_type") == "view", "extraction").when(F.col("event_type") == "click", "generation").alias("stage"),
        "value",
    )


TAG_SQL = """
te as (select user_id as tag, ts, event_id, case when event_id % 50 = 7 then 'reset' else case event_type when 'signup' then 'start' when 'purchase' then 'success' when 'error' then 'error' else 'stage' end end as kind,
  case event_type when 'view' then 'extraction' when 'click' then 'generation' end as stage from events),
seq as (select *, row_number() over (partition by tag order by ts, event_id) as n from te),
rs as (select tag, max(n) as r from seq where kind = 'reset' group by tag),
live as (select s.* from seq s left join rs using (tag) where n > coalesce(r, 0)),
st as (select tag, max(n) as n from live where kind = 'start' group by tag),
tag_state as (select l.tag, case when bool_or(kind = 'error' and l.n > coalesce(st.n, 0)) then 'failed' when bool_or(kind = 'success' and l.n > coalesce(st.n, 0)) then 'success' when max(st.n) is not null then 'processing' else 'pending' end as status,
  max_by(stage, l.n) filter (where kind = 'stage') as current_stage, max(ts) filter (where kind = 'start') as started_at from live l left join st using (tag) group by l.tag)"""


@query("str_2_tag_state", f"with {TAG_SQL} select tag, status, current_stage, started_at from tag_state")
def str_2(spark, d):
    return T.tag_state(tag_events(load(spark, d, "events")))


@query("str_2_tag_state_stream", f"with {TAG_SQL} select tag, status, current_stage, started_at from tag_state")
def str_2_stream(spark, d):
    return ST.run_state(ST.tag_state_stream(tag_events(event_stream(spark, d))), ["tag"]).where("status <> 'reset'")


@query("str_2_tag_errors", f"with {TAG_SQL} select tag, ts, event_id from live where kind = 'error'")
def str_2_errors(spark, d):
    return T.tag_errors(tag_events(load(spark, d, "events"))).select("tag", "ts", "event_id")


@query("str_3_tag_summary", f"with {TAG_SQL} select status, count(*) as tags from tag_state group by status")
def str_3(spark, d):
    return T.tag_summary(T.tag_state(tag_events(load(spark, d, "events"))))


@query("str_3_failed_tags", f"with {TAG_SQL} select tag, current_stage from tag_state where status = 'failed'")
def str_3_failed(spark, d):
    return T.tag_state(tag_events(load(spark, d, "events"))).where("status = 'failed'").select("tag", "current_stage")


@query(
    "str_4_stage_labels",
    """select event_id, case event_type when 'signup' then '等待处理' when 'view' then '开始提取' when 'click' then '开始生成' when 'purchase' then '生成完毕' else '生成失败' end as stage_label,
  case event_type when 'view' then 10 when 'click' then 60 when 'purchase' then 100 end as percent, case when event_id % 7 = 0 or event_type = 'error' then '生成失败' else '生成完毕' end as final_label
from events where event_type in ('view', 'click', 'purchase')""",
)
def str_4(spark, d):
    stages = {"signup": "pending", "view": "extraction", "click": "generation", "purchase": "completed", "error": "failed"}
    marks = {"view": "extraction_started", "click": "generation_started", "purchase": "completed"}
    e = load(spark, d, "events").withColumn("mark", kind_map("event_type", marks))
    return T.milestone_rows(e, "mark").select(
        "event_id",
        T.stage_label(kind_map("event_type", stages)).alias("stage_label"),
        F.col("percent").cast("bigint").alias("percent"),
        T.final_label(F.col("event_id") % 7 == 0, F.when(F.col("event_type") == "error", "error")).alias("final_label"),
    )


# --- timings and logs ---------------------------------------------------------------------------


def timings(e):
    return e.select(F.col("event_type").alias("name"), F.col("value").alias("duration"))


@query(
    "str_5_timing_summary",
    """select event_type as name, case when grouping(event_type) = 0 then 'operation' else 'total' end as grain, count(*) as count, round(sum(value), 4) as total_duration, min(value) as min_duration, max(value) as max_duration, round(avg(value), 6) as avg_duration,
  printf('%dm', floor(round(sum(value), 4) / 60)::bigint) as minutes from events group by rollup(event_type)""",
)
def str_5(spark, d):
    s = T.timing_summary(timings(load(spark, d, "events")))
    total = F.round("total_duration", 4)
    return s.select(
        "name",
        "grain",
        "count",
        total.alias("total_duration"),
        "min_duration",
        "max_duration",
        F.round("avg_duration", 6).alias("avg_duration"),
        F.split(T.duration_text(total), " ")[0].alias("minutes"),
    )


@query(
    "str_5_duration_text",
    """select event_id, case when value < 1 then printf('%.2fms', value * 1000) when value < 60 then printf('%.2fs', value) else printf('%dm %.2fs', floor(value / 60)::bigint, value % 60) end as shown from events""",
)
def str_5_text(spark, d):
    return load(spark, d, "events").select("event_id", T.duration_text(F.col("value")).alias("shown"))


@query(
    "str_5_timing_stream",
    """select event_type as name, count(*) as count, round(sum(value), 4) as total_duration, min(value) as min_duration, max(value) as max_duration, round(avg(value), 6) as avg_duration from events group by event_type""",
)
def str_5_stream(spark, d):
    return ST.run_state(ST.timing_stream(timings(event_stream(spark, d))), ["name"]).withColumns(
        {"total_duration": F.round("total_duration", 4), "avg_duration": F.round("avg_duration", 6)}
    )


def logs(e):
    return e.select(
        F.col("user_id").alias("task"),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO").alias("level"),
        F.concat(F.lit("s"), (F.col("user_id") % 13).cast("string")).alias("session"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


COUNTER_SQL = """select user_id as task, 0 as debug, count(*) filter (where event_type not in ('error', 'signup')) as info, count(*) filter (where event_type = 'signup') as warning, count(*) filter (where event_type = 'error') as error, 0 as critical,
  count(*) as total_logs, bool_or(event_type = 'error') as has_errors from events group by user_id"""


@query("str_6_log_counters", COUNTER_SQL)
def str_6(spark, d):
    return T.log_counters(logs(load(spark, d, "events")))


@query("str_6_log_counters_stream", COUNTER_SQL)
def str_6_stream(spark, d):
    return ST.run_state(ST.log_counter_stream(logs(event_stream(spark, d))), ["task"])


@query(
    "str_7_recent_tasks",
    "select user_id as task, min(ts) as created_at from events group by user_id order by created_at desc, task desc limit 20",
)
def str_7(spark, d):
    tasks = load(spark, d, "events").groupBy(F.col("user_id").alias("task")).agg(F.min("ts").alias("created_at"))
    return T.recent_tasks(tasks, 20)


@query(
    "str_8_request_rate",
    """select event_id, user_id, count(*) over w as recent, count(*) over w > 3 as violation from (select *, epoch_us(ts) as us from events) window w as (partition by user_id order by us range between 3599999999 preceding and current row)""",
)
def str_8(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, d, "events").select("event_id", "user_id", "ts")
    return T.request_rate(e, "user_id", micros, 3600000000, 3).select("event_id", "user_id", "recent", "violation")


@query("str_8_request_rate_stream", SQL["str_8_request_rate"])
def str_8_stream(spark, d):
    return ST.run_request_rate(event_stream(spark, d), "user_id", "event_id", "ts", 3600000000, 3, buckets=2).select("event_id", "user_id", "recent", "violation")


def feed(e):
    return e.select(
        F.col("user_id").alias("request"),
        "ts",
        "event_id",
        F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "error", "_complete").otherwise(F.col("event_type")).alias("kind"),
    )


@query(
    "str_9_event_feed",
    """with f as (select user_id as request, ts, event_id, case event_type when 'signup' then 'register' when 'error' then '_complete' else event_type end as kind from events),
g as (select *, last_value(case when kind in ('register', '_complete') then kind end ignore nulls) over (partition by request order by ts, event_id rows between unbounded preceding and 1 preceding) as gate from f)
select request, ts, event_id, kind from g where gate = 'register' and kind <> 'register'""",
)
def str_9(spark, d):
    return T.event_feed(feed(load(spark, d, "events")), F.date_trunc("hour", "ts"))


@query("str_9_event_feed_stream", SQL["str_9_event_feed"])
def str_9_stream(spark, d):
    return ST.run_feed(feed(event_stream(spark, d)))


@query(
    "str_10_batch_tally",
    """select source as batch, count(*) as total, count(*) filter (where doc_id % 7 <> 0) as succeeded, count(*) filter (where doc_id % 7 = 0) as failed, sum(n_chars / 8)::double as elapsed from documents group by source""",
)
def str_10(spark, d):
    return T.batch_tally(_results(spark, d), "batch")


def _results(spark, d):
    bad = F.col("doc_id") % 7 == 0
    return load(spark, d, "documents").select(
        F.col("source").alias("batch"),
        F.concat(F.lit("d"), text("doc_id")).alias("file"),
        F.when(bad, "error").otherwise("success").alias("status"),
        F.when(bad, F.concat(F.lit("lost "), text("doc_id"))).alias("error"),
        (F.col("n_chars") / 8).alias("elapsed"),
    )


@query("str_10_batch_errors", "select source as batch, 'd' || doc_id as file, 'lost ' || doc_id as error from documents where doc_id % 7 = 0")
def str_10_errors(spark, d):
    return T.batch_errors(_results(spark, d), "batch")


@query(
    "str_11_session_logs",
    "select 's' || (user_id % 13) as session, event_id from events where user_id % 13 in (select doc_id % 5 from documents)",
)
def str_11(spark, d):
    sessions = load(spark, d, "documents").select(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")).alias("session"))
    return T.session_logs(logs(load(spark, d, "events")), sessions).select("session", "event_id")


@query(
    "src_11_file_intake",
    """select 'in/d' || doc_id || case doc_id % 3 when 0 then '.docx' when 1 then '.rtf' else '.zip' end as path, case when doc_id % 3 = 2 then 'error' else 'success' end as status,
  case when doc_id % 3 = 2 then 'unknown type' end as error from documents""",
)
def src_11(spark, d):
    """Documents arrive as a file stream; unknown types become error rows."""
    docs = ST.file_stream(spark, d, "documents.parquet", load(spark, d, "documents").schema)
    k = F.col("doc_id") % 3
    files = docs.select(
        F.concat(F.lit("in/d"), text("doc_id"), F.when(k == 0, ".docx").when(k == 1, ".rtf").otherwise(".zip")).alias("path"), "text"
    )

    def process(batch):
        routed = route(batch)
        ok = F.col("status") == "ok"
        return routed.withColumn("error", F.when(~ok, "unknown type")).withColumn("status", F.when(ok, "success").otherwise("error"))

    base = f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    ST.intake(files, process, f"{base}/packages", f"{base}/results", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/results").select("path", "status", "error")
