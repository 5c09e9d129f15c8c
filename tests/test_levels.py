"""Merged snapshots: newest row per key, few folders, batches that are repeated or die half way."""
import os
import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from leafmill.streaming import levels

SCHEMA = StructType([StructField("key", StringType()), StructField("value", LongType())])


def folders(path):
    return sorted(f"{a}/{b}" for a in os.listdir(path) if a.startswith("l") for b in os.listdir(path / a))


def test_two_hundred_batches(spark, tmp_path):
    rnd = random.Random(1)
    table = levels.LevelledTable(spark, str(tmp_path / "t"), ["key"], SCHEMA, fan=6)
    assert table.rows().collect() == [] and table.batches() == 0
    state = {}
    for n in range(200):
        rows = [(f"k{rnd.randint(0, 30)}", n)] if n % 9 else []
        table.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), n)
        state |= dict(rows)
    live = table.live(table.batches())
    assert table.batches() == 200 and len(live) <= 5 * 3 and len(folders(tmp_path / "t")) == len(live)
    assert {r["key"]: (r["value"], r["batch_id"]) for r in table.rows().collect()} == {k: (v, v) for k, v in state.items()}
    some = spark.createDataFrame([("k1",), ("none",)], "key string")
    assert [(r["key"], r["value"]) for r in table.rows(some).collect()] == [("k1", state["k1"])]


def test_repeated_and_died_batches(spark, tmp_path, monkeypatch):
    table = levels.LevelledTable(spark, str(tmp_path / "t"), ["key"], SCHEMA, fan=2)
    put = lambda n: table.write(spark.createDataFrame([("a", n), (f"k{n}", n)], SCHEMA), n)
    put(0)
    with monkeypatch.context() as m:
        m.setattr(levels, "shared_files", lambda folder: 1 / 0)
        m.setattr(table, "batches", lambda: 1)
        with pytest.raises(ZeroDivisionError):
            put(1)  # written and merged, but not yet said so
    assert table.batches() == 1 and {r["value"] for r in table.rows().collect()} == {0}
    for n in (1, 1, 0, 2, 3, 3):
        put(n)
    assert {r["key"]: r["value"] for r in table.rows().collect()} == {"a": 3, "k0": 0, "k1": 1, "k2": 2, "k3": 3}
    assert folders(tmp_path / "t") == ["l2/0"]
