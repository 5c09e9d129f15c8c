"""Tables laid out by key: results of upserts, files written, plans of joins."""
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import LongType, StringType, StructField, StructType

from leafmill.operators import catalog as K
from leafmill.sources.keyed import KeyedTable

SCHEMA = StructType([StructField(n, LongType() if n == "at" else StringType()) for n in ("project", "file", "at", "path")])


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "catalogue"), SCHEMA, ["project", "file"], slots=16, buckets=8)
    yield t
    t.drop()


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files_of(folder):
    return {os.path.join(a, n): os.stat(os.path.join(a, n)).st_mtime_ns for a, _, ns in os.walk(folder) for n in ns if n.endswith(".parquet")}


def test_upserts_in_any_order_keep_the_last(spark, table):
    draw = random.Random(5)
    best, batches = {}, []
    for b in range(4):
        batch = {(f"p{draw.randrange(4)}", f"f{draw.randrange(60)}"): draw.choice([None, *range(9)]) for _ in range(50)}
        batches.append([(p, f, at, f"{b}") for (p, f), at in batch.items()])
        for p, f, at, path in batches[-1]:
            old = best.get((p, f))
            if old is None or (old[0] if old[0] is not None else -1) <= (at if at is not None else -1):
                best[(p, f)] = (at, path)
    for rows in batches:
        table.upsert(frame(spark, rows), ["at"])
    table.upsert(frame(spark, batches[-1]), ["at"])  # a batch may come again
    assert {(r.project, r.file): (r.at, r.path) for r in table.rows().collect()} == best
    assert table.rows().count() == len(best)


def test_an_upsert_writes_only_the_slots_of_its_keys(spark, table, tmp_path):
    assert table.upsert(frame(spark, []), ["at"]) == [] and table.rows().collect() == []
    table.upsert(frame(spark, [("p", f"f{i}", 1, "a") for i in range(2000)]), ["at"])
    before = files_of(tmp_path)
    written = table.upsert(frame(spark, [("p", "f7", 2, "b"), ("q", "new", 2, "b")]), ["at"])
    after = files_of(tmp_path)
    assert 1 <= len(written) <= 2
    changed = {n for n in before.keys() | after.keys() if before.get(n) != after.get(n)}
    assert changed and all(any(f"_slot={s}/" in n for s in written) for n in changed)
    assert table.rows().count() == 2001 and table.rows().where("file = 'f7'").first().path == "b"


def test_another_session_reads_the_folder(spark, table, tmp_path):
    table.upsert(frame(spark, [("p", "f", 1, "a")]), ["at"])
    other = KeyedTable(spark.newSession(), str(tmp_path / "catalogue"), SCHEMA, ["project", "file"], slots=16, buckets=8)
    assert other.rows().collect() == table.rows().collect()
    table.drop()
    again = KeyedTable(spark, str(tmp_path / "catalogue"), SCHEMA, ["project", "file"], slots=16, buckets=8)
    assert again.rows().count() == 1


def test_null_keys_are_an_error(spark, table):
    with pytest.raises(PySparkException, match="key of the batch is null"):
        table.upsert(frame(spark, [("p", None, 1, "a")]), ["at"])


def test_joins_do_not_shuffle_the_stored_side(spark, table):
    table.upsert(frame(spark, [("p", f"f{i}", 1, "a") for i in range(500)]), ["at"])
    asked = frame(spark, [("p", f"f{i % 700}", i, "") for i in range(3000)]).select("project", "file", "at")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (
            asked.join(table.rows().select("project", "file", "path"), ["project", "file"], "left"),
            K.unfinished(asked, table.rows(), ["project", "file"]),
        ):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1, plan
            assert "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert K.unfinished(asked, table.rows(), ["project", "file"]).select("file").distinct().count() == 200
