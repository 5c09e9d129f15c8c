"""The answer store: each distinct prompt is asked once over actions, runs, failed tasks and died commits."""
import os
import subprocess
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leafmill.operators import answers
from leafmill.operators.model import FAILED, retry_until_parsed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks ask the backends of this module
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Counting:
    """Notes each prompt it is asked in a file of its own."""

    def __init__(self, folder, fail=(), prefix="a"):
        self.folder, self.fail, self.prefix = str(folder), set(fail), prefix

    def generate(self, prompts, task):
        import os
        import uuid

        if self.fail & set(prompts):
            raise ValueError("no")
        for p in prompts:
            open(os.path.join(self.folder, f"{p}~{uuid.uuid4().hex}"), "w").close()
        return [f"{self.prefix}:{p}" for p in prompts]


def asked(folder):
    return sorted(n.split("~")[0] for n in os.listdir(folder))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "prompt string")


def test_two_actions_and_a_second_run(spark, tmp_path, calls):
    store = answers.AnswerStore(spark, str(tmp_path / "store"), buckets=4)
    names = [f"p{i}" for i in range(40)]
    out = answers.ask_once(frame(spark, names + names + [None]), store, backend=Counting(calls), batch_size=3)
    assert {r["output"] for r in out.collect()} == {f"a:{n}" for n in names} == {r["output"] for r in out.collect()}
    assert out.count() == 40 and asked(calls) == sorted(names)
    more = answers.ask_once(frame(spark, names[20:] + ["new"]), answers.AnswerStore(spark, str(tmp_path / "store"), 4), backend=Counting(calls, prefix="b"))
    assert sorted(r["output"] for r in more.collect()) == sorted([f"a:{n}" for n in names[20:]] + ["b:new"])
    assert asked(calls) == sorted([*names, "new"])
    assert answers.ask_once(frame(spark, []), store, backend=Counting(calls)).collect() == []
    # another task or attempt is another question
    assert answers.ask_once(frame(spark, ["p0"]), store, task="other", backend=Counting(calls, prefix="c")).first()["output"] == "c:p0"
    assert answers.ask_once(frame(spark, ["p0"]), store, attempt=2, backend=Counting(calls, prefix="d")).first()["output"] == "d:p0"


def test_failed_answers_are_asked_again(spark, tmp_path, calls, monkeypatch):
    monkeypatch.setattr("leafmill.operators.model.BACKOFF_CAP", 0.0)
    store = answers.AnswerStore(spark, str(tmp_path / "store"), 2)
    got = answers.ask_once(frame(spark, ["x", "y", "z"]), store, backend=Counting(calls, fail=["y"]), batch_size=3).collect()
    assert sorted(r["output"] for r in got) == [f"{FAILED} no", "a:x", "a:z"]
    got = answers.ask_once(frame(spark, ["x", "y", "z"]), store, backend=Counting(calls)).collect()
    assert sorted(r["output"] for r in got) == ["a:x", "a:y", "a:z"] and asked(calls) == ["x", "y", "z"]


def test_a_died_run_and_a_died_commit(spark, tmp_path, calls, monkeypatch):
    store = answers.AnswerStore(spark, str(tmp_path / "store"), 2)
    monkeypatch.setattr(answers.AnswerStore, "commit", lambda self: None)
    answers.ask_once(frame(spark, ["x", "y"]), store, backend=Counting(calls))  # answers stay in the log
    answers.ask_once(frame(spark, ["y", "z"]), store, backend=Counting(calls))
    assert asked(calls) == ["x", "y", "z"]
    monkeypatch.undo()
    with monkeypatch.context() as m:
        m.setattr(answers, "shared_files", lambda folder: (Sulky(), folder))
        with pytest.raises(OSError):
            store.commit()  # written to the table, not yet out of the log
    store.commit()
    store.commit()
    assert store._logs().count() == 0
    assert sorted(r["prompt_hash"] for r in store._table().collect()) == sorted(r["h"] for r in frame(spark, ["x", "y", "z"]).select(F.sha2("prompt", 256).alias("h")).collect())


class Sulky:
    def get_file_info(self, path):
        return answers.fs.LocalFileSystem().get_file_info(path)

    def delete_dir(self, path):
        raise OSError("died")


def test_retries_replay(spark, tmp_path, calls):
    """An answer that does not parse is asked again; a second run asks nothing."""
    store = answers.AnswerStore(spark, str(tmp_path / "store"), 2)
    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, prompt string")

    def ask(pending, attempt):
        found = answers.ask_once(pending, store, backend=Counting(calls, prefix=f"try{attempt}"), attempt=attempt)
        return pending.withColumn("prompt_hash", F.sha2("prompt", 256)).join(found, "prompt_hash").drop("prompt_hash")

    def parse(rows):
        ok = (F.col("prompt") == "good") | F.col("output").startswith("try2")
        return rows.withColumn("json", F.when(ok, F.col("output")))

    for _ in range(2):
        got = retry_until_parsed(rows, "id", ask, parse).collect()
        assert sorted((r["id"], r["json"], r["attempt"]) for r in got) == [(1, "try1:good", 1), (2, "try2:bad", 2)]
        assert asked(calls) == ["bad", "bad", "good"]


def test_rate_holds_with_retries(spark, tmp_path, calls, monkeypatch):
    monkeypatch.setattr("leafmill.operators.model.BACKOFF_CAP", 0.0)
    store = answers.AnswerStore(spark, str(tmp_path / "store"), 1)
    start = time.monotonic()
    answers.ask_once(frame(spark, ["x", "y"]), store, backend=Counting(calls, fail=["y"]), rate=4.0)
    assert time.monotonic() - start >= 3 / 4.0  # four calls: x, and y three times


CRASH = """
import os, sys
sys.path.insert(0, {home!r}); sys.path.insert(0, {home!r} + "/tests")
from leafmill.session import build_session
from leafmill.operators import answers
from test_answers import Counting, frame

class Crashing(Counting):
    def generate(self, prompts, task):
        mark = self.folder + "-crashed"
        if "p25" in prompts and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return super().generate(prompts, task)

spark = build_session("crash", master="local[2,4]", shuffle_partitions=2, shared={base!r})
store = answers.AnswerStore(spark, {base!r} + "/store", 2)
out = answers.ask_once(frame(spark, ["p%d" % i for i in range(50)]), store, backend=Crashing({calls!r}), concurrency=1)
assert out.count() == 50
"""


def test_a_task_that_dies_is_tried_again(tmp_path, calls):
    """The worker exits in the middle of a task; the next attempt asks only what is not in the log."""
    code = CRASH.format(home=HOME, base=str(tmp_path), calls=str(calls))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert os.path.exists(f"{calls}-crashed") and asked(calls) == sorted(f"p{i}" for i in range(50))
