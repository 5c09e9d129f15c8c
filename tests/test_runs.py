"""Model calls, retries, streams over several batches, sources and sinks on disk."""
import json

import pytest
from pyspark.sql import functions as F

from leafmill.operators import model, responses, telemetry
from leafmill.session import shared_dir
from leafmill.sources import config, files, packages
from leafmill.streaming import telemetry as streaming


def test_model_column(spark, monkeypatch):
    class Flaky:
        """Fails on every prompt that names a failure."""

        def generate(self, prompts, task):
            if "fail" in prompts[0]:
                raise ValueError("no answer")
            return [p.upper() for p in prompts]

    monkeypatch.setattr(model, "BACKOFF_CAP", 0.0)
    rows = spark.createDataFrame([("a",), ("a",), ("fail",)], "prompt string")
    out = model.model_column(rows, backend=Flaky(), partitions=2)
    got = {r.prompt: r.output for r in model.with_outputs(rows, out).collect()}
    assert out.count() == 2
    assert got == {"a": "A", "fail": "[生成失败] no answer"}
    more = spark.createDataFrame([("a",), ("new",)], "prompt string")
    assert [r.prompt for r in model.missing_prompts(more, out).collect()] == ["new"]


def test_answer_retries():
    calls, waits = [], []

    class Once:
        def generate(self, prompts, task):
            calls.append(prompts)
            if len(calls) < 3:
                error = ValueError("busy")
                error.retry_after = 7.0 if len(calls) == 1 else None
                raise error
            return ["ok"]

    assert model._answer(Once(), "p", "t", waits.append) == "ok"
    assert waits[0] == 7.0 and 1.5 <= waits[1] <= 1.8


def test_retry_keeps_unparsed_rows(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")

    def ask(pending, attempt):
        return pending.withColumn("output", F.when(F.col("id") == 1, F.lit("{}")).otherwise(F.lit('{"a": 1}')))

    parse = lambda a: responses.parse_responses(a, "output")
    got = {r.id: (r.attempt, r.json) for r in model.retry_until_parsed(rows, "id", ask, parse).collect()}
    assert got == {1: (3, None), 2: (1, '{"a":1}')}


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


def slices(spark, sf_dir, tmp_path):
    """The events as five files, so that a stream sees several batches."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(5, "event_id").write.parquet(str(tmp_path / "events"))
    return events, streaming.file_stream(spark, str(tmp_path / "events"), "*.parquet", events.schema)


def one_by_one(stream, out, keys, spark):
    """Drive a stream with one file per micro-batch."""

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    q = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{out}/cp")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    q.awaitTermination()
    return telemetry.latest_per_key(spark.read.parquet(f"{out}/rows"), keys)


def kinds(e):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("start", "stage", "error", "success", "reset")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("tag"), "ts", "event_id", kind.alias("kind"), F.col("event_type").alias("stage"))


def test_tag_stream_equals_batch(spark, sf_dir, tmp_path):
    events, _ = slices(spark, sf_dir, tmp_path)
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    )
    state = one_by_one(streaming.tag_state_stream(kinds(stream)), str(tmp_path / "out"), ["tag"], spark).where("status <> 'reset'")
    batch = telemetry.tag_state(kinds(events))
    assert spark.read.parquet(str(tmp_path / "out/rows")).select("batch_id").distinct().count() == 5
    assert sorted(state.select(batch.columns).collect()) == sorted(batch.collect())


def test_windowed_counts(spark, sf_dir, tmp_path):
    events, stream = slices(spark, sf_dir, tmp_path)
    shape = lambda e: e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("level"))
    rows = streaming.run_state(streaming.windowed_log_counts(shape(stream)), ["start", "level"])
    expected = shape(events).groupBy(F.window("ts", "1 hour")["start"].alias("start"), "level").count()
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, expected.collect()))


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("héllo".encode())
    (tmp_path / "in/b.bin").write_bytes(b"\xc4\xe3\xba\xc3")
    (tmp_path / "in/c.docx").write_bytes(b"x")
    got = {r.name: r.sha256 for r in files.binary_manifest(spark, str(tmp_path / "in")).collect()}
    assert got["c.docx"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    raw = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    docs = {r.name: (r.text, r.method) for r in files.text_documents(raw).collect()}
    assert docs == {"a": ("héllo", "fallback_text"), "b": ("", "failed")}
    assert files.read_text_documents(spark, str(tmp_path / "in/a.txt")).first()["text"] == "héllo"


def test_files_of_any_size(spark, tmp_path):
    """A file of more than 2 GiB has its hash, in little memory; both readers give the same rows."""
    import hashlib
    import tracemalloc

    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden/x.bin").write_bytes(b"x")
    (tmp_path / ".y.bin").write_bytes(b"y")
    size = (2 << 30) + 100_000_000
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    for k in range(5):
        (tmp_path / f"deep/er/f {k}.bin").write_bytes(bytes([k]) * (1000 * k))
    want = hashlib.sha256()
    for _ in range(size >> 20):
        want.update(bytes(1 << 20))
    want.update(bytes(size & ((1 << 20) - 1)))
    got = {r["name"]: (r["length"], r["sha256"]) for r in files.binary_manifest(spark, str(tmp_path), "*.bin").collect()}
    assert got["big.bin"] == (size, want.hexdigest()) and len(got) == 6
    (tmp_path / "big.bin").write_bytes(b"small now")
    tracemalloc.start()
    reader = files.DigestReader({"path": str(tmp_path)})
    assert len(list(reader.partitions())) == 6
    for part in reader.partitions():
        list(reader.read(part))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    both = [files.binary_manifest(spark, str(tmp_path), "*.bin", n) for n in (-1, 2000, 1 << 40)]
    rows = [sorted((r["name"], r["path"].removeprefix("file:").replace("%20", " ").replace("///", "/"), r["length"], r["sha256"]) for r in b.collect()) for b in both]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 6


def test_packages_round_trip(spark, sf_dir, tmp_path):
    from leafmill.plans.sources import package_rows

    rows = packages.package_table(package_rows(spark, sf_dir), spark.createDataFrame([("c/0.json",)], "path string"))
    for job in ("one", "one", "two/again"):  # a repeated job, and a second one over the same files
        packages.write_packages(rows, str(tmp_path / "packages"), job)
        back = packages.read_packages(spark, str(tmp_path / "packages"), rows.schema)
        assert back.count() == rows.count()
    assert back.where("chunks_file is not null").count() == 1
    assert {r.file_type for r in back.select("file_type").distinct().collect()} == {"docx", "pdf", "xlsx", "unknown"}


def test_text_export(spark, tmp_path):
    parts = spark.range(40).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).alias("part"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("text"))
    for _ in range(2):
        packages.write_text_parts(parts, "run", "text", str(tmp_path / "out"))
    packages.write_text_parts(parts.where("run = 1"), "run", "text", str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).text(str(tmp_path / "out/run=*"))
    assert sorted((r.run, r.value) for r in back.collect()) == sorted((i % 2, f"p{i}") for i in range(40))


def test_commits_are_seen_once(spark, tmp_path, monkeypatch):
    """A batch written twice, one that dies between rows and log, and runs that later batches write again."""
    from leafmill.sources import commits

    frame = lambda *rows: spark.createDataFrame(rows, "run string, v long")
    path, schema = str(tmp_path / "t"), frame(("a", 1)).schema
    table = commits.CommittedTable(spark, path, schema)
    assert table.rows().collect() == []
    write = lambda batch, *rows: packages.write_run_table(frame(*rows), "run", path, batch)
    seen = lambda: sorted(map(str, (tuple(r) for r in packages.read_run_table(spark, path, schema, "run").collect())))
    write("b1", ("a", 1), ("a", 2), ("b", 3), (None, 9))
    write("b2", ("b", 4))
    write("b2", ("b", 5), ("b", 6))
    with monkeypatch.context() as m:
        m.setattr(commits, "shared_files", lambda folder: 1 / 0 if not folder.endswith("/log") else (commits.fs.LocalFileSystem(), folder))
        with pytest.raises(ZeroDivisionError):
            write("b3", ("a", 100))
    assert seen() == sorted(map(str, [("a", 1), ("a", 2), ("b", 5), ("b", 6), (None, 9)]))
    write("b3", ("a", 7))
    write("b1", ("a", 8), ("c", 8))  # the whole batch anew, and now the last word on run a
    assert seen() == sorted(map(str, [("a", 8), ("b", 5), ("b", 6), ("c", 8)]))
    assert sorted(r["v"] for r in table.rows().collect()) == [5, 6, 7, 8, 8]


def test_log_round_trip(spark, sf_dir, tmp_path):
    from leafmill.plans.sources import log_rows

    config.log_lines(log_rows(spark, sf_dir)).write.text(str(tmp_path / "log"))
    line = json.loads(spark.read.text(str(tmp_path / "log")).where("value like '%ERROR%'").first()["value"])
    assert line["message"].endswith(f"ValueError: {line['error']['message']}")
    parsed = config.parse_log(spark.read.text(str(tmp_path / "log")))
    assert parsed.where("error is not null").count() == parsed.where("level = 'ERROR'").count() > 0


def test_paragraph_flags(spark):
    cfg = {
        "paragraphs": [
            {"id": "p", "data": [{"extract": "a", "options": "原文"}, {"original_mode": None, "options": "原文"}, {"original_mode": " True", "insert_original": True}]},
            {},
        ]
    }
    df = spark.createDataFrame([(1, json.dumps(cfg))], "k int, j string")
    got = config.paragraph_items(df, "k", "j").orderBy("para_no", "item_no").collect()
    assert [(r.paragraph_id, r.original_mode, r.insert_original) for r in got] == [
        ("p", True, False),
        ("p", False, False),
        ("p", True, True),
        ("", False, False),
    ]


@pytest.mark.parametrize("seconds,shown", [(0.5, "500.00ms"), (1.0, "1.00s"), (59.999, "60.00s"), (61.5, "1m 1.50s")])
def test_duration_text(spark, seconds, shown):
    df = spark.createDataFrame([(seconds,)], "s double")
    assert df.select(telemetry.duration_text(F.col("s")).alias("x")).first()["x"] == shown


def test_model_lists_and_pace(spark, tmp_path):
    """Lists of the asked size, a bad prompt alone fails, calls keep the total rate."""
    import time

    log = str(tmp_path)

    class Listed:
        def generate(self, prompts, task):
            import os
            import uuid

            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(f"{len(prompts)} {time.time()}")
            if "bad" in prompts:
                raise ValueError("no")
            return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(f"p{i}",) for i in range(11)] + [("bad",)], "prompt string").coalesce(1)
    out = {r["output"] for r in model.model_column(rows, backend=Listed(), batch_size=4, partitions=1).collect()}
    assert {f"P{i}" for i in range(11)} <= out and any(o.startswith(model.FAILED) for o in out) and len(out) == 12
    sizes = [int(p.read_text().split()[0]) for p in tmp_path.iterdir()]
    assert max(sizes) == 4
    for p in tmp_path.iterdir():
        p.unlink()
    good = rows.where("prompt <> 'bad'")
    model.model_column(good, backend=Listed(), rate=20.0, partitions=2).collect()
    times = sorted(float(p.read_text().split()[1]) for p in tmp_path.iterdir())
    assert len(times) >= 11 and times[-1] - times[0] >= 0.3


def test_feed_in_any_order_of_arrival(spark, tmp_path):
    """Five shuffled files, one micro-batch each, give the rows of the batch feed."""
    from leafmill.operators.telemetry import event_feed
    from leafmill.streaming.telemetry import run_feed

    kinds = ["register", "_complete", "a", "b", "c"]
    rows = spark.range(400).selectExpr(
        "id % 7 as request", "timestamp_seconds(1700000000 + id * 997) as ts", "id as event_id",
        f"element_at(array({', '.join(repr(k) for k in kinds)}), cast(pmod(xxhash64(id), 5) as int) + 1) as kind",
    )
    folder = str(tmp_path / "events")
    rows.repartition(5, F.xxhash64(F.lit(3), "event_id")).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = sorted(map(tuple, run_feed(stream).collect()))
    want = sorted(map(tuple, event_feed(rows, F.date_trunc("hour", "ts")).select("request", "ts", "event_id", "kind").collect()))
    assert got == want and len(want) > 50
