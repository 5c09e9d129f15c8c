"""The request rate as a stream gives the batch rows for any order of arrival inside the watermark."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leafmill.operators.telemetry import request_rate
from leafmill.streaming import telemetry as ST

START = datetime(2024, 1, 1)
SCHEMA = "user string, id long, ts timestamp"


def test_any_order_inside_the_watermark(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in range(1200):  # one user has half of the requests, some come at the same instant, one user has no name
        user = rnd.choice(["hot", "hot", "a", "b", None])
        rows.append((user, i, START + timedelta(seconds=rnd.choice([rnd.randint(0, 7200), 3600, 60 * rnd.randint(0, 120)]))))
    arrivals = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rnd.randint(0, 500)))
    for k in range(6):  # one micro-batch each, in this order
        spark.createDataFrame(arrivals[k * 200 : k * 200 + 200], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = ST.run_request_rate(stream, "user", "id", "ts", 600_000_000, 5)
    got = sorted((r["id"], r["user"] or "", r["recent"], r["violation"]) for r in out.collect())
    batch = request_rate(spark.createDataFrame(rows, SCHEMA), "user", F.unix_micros("ts"), 600_000_000, 5)
    assert got == sorted((r["id"], r["user"] or "", r["recent"], r["violation"]) for r in batch.collect())
    assert out.select("batch_id").distinct().count() > 3 if "batch_id" in out.columns else True
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_silent_keys_leave_no_state_and_late_rows_are_dropped(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = ST.request_rate_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "user", "id", "ts", 60_000_000, 1, "1 minute")
        with ST.rocks_state(spark):
            query = ST.start_to_folder(stream, str(tmp_path / "out"), str(tmp_path / "check"), "append")
        query.awaitTermination()
        return query.recentProgress[-1]["stateOperators"][0]

    at = lambda minute: START + timedelta(minutes=minute, seconds=5)
    put([(f"u{k}", k, at(0)) for k in range(50)])
    held = run()["numRowsTotal"]
    put([("v", 100, at(30))])
    assert run()["numRowsTotal"] < held / 10  # the fifty fell silent
    put([("u1", 200, at(1)), ("v", 101, at(30))])  # the first is far too late
    put([("w", 300, at(90))])
    run()
    rows = {r["id"]: r["recent"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(rows) == {*range(50), 100, 101} and rows[100] == rows[101] == 2 and rows[7] == 1
