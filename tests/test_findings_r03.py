"""What the findings of the third round asked for."""
import random
import shutil

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from leafmill.llm import token_counts
from leafmill.operators import catalog as K
from leafmill.operators import rollup as RU
from leafmill.operators.model import model_column
from leafmill.plans import registry
from leafmill.streaming import telemetry as ST

QUERIES = registry.queries()


def as_folders(sf_dir, out, *names):
    """The tables as folders of part files."""
    for name in names:
        (out / f"{name}.parquet").mkdir()
        shutil.copy(f"{sf_dir}/{name}.parquet", out / f"{name}.parquet" / "part-0.parquet")
    return str(out)


def test_streams_read_a_table_that_is_a_folder(spark, sf_dir, tmp_path):
    folder = as_folders(sf_dir, tmp_path, "documents", "events")
    for name in ("src_11_file_intake", "str_6_log_counters_stream"):
        assert sorted(QUERIES[name](spark, folder).collect(), key=str) == sorted(QUERIES[name](spark, sf_dir).collect(), key=str) != []


def test_a_plain_name_takes_no_other_file(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "events.parquet2"))
    stream = ST.file_stream(spark, str(tmp_path), "events.parquet", spark.range(1).schema)
    assert ST.run_available(stream, "append").count() == 3


def test_full_content_of_every_document_in_parts(spark, sf_dir, tmp_path):
    docs = [(k, "\n".join(f"line {i} of {k}" for i in range(n)), "en", "web", 0) for k, n in enumerate([5, 30, 7000, 1])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["ext_15_full_content"](spark, str(tmp_path)).select("doc_id", "part", "content", "glued").collect())
    assert {r[:2] for r in got} == {(0, 0), (1, 0), (2, 0), (2, 1), (3, 0)}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select doc_id, part, content, glued from ({registry.oracle_sql()['ext_15_full_content']})").fetchall())


def test_full_content_leaves_out_items_with_a_query_or_another_mode(spark):
    items = spark.createDataFrame([(1, None, True), (2, "find", True), (3, " ", False), (4, "\t", True)], "item long, extract string, original_mode boolean")
    chunks = spark.createDataFrame([(i, 1, f"c{i}") for i in range(1, 6)], "item long, ord long, content string")
    assert {r["item"] for r in RU.full_content(items, chunks, "item").collect()} == {1, 4}


def test_waiting_requests_are_packed(monkeypatch):
    """A group makes a few entries of state, and its counts are those of every key by itself, slab by slab too."""

    class Rows:
        def __init__(self):
            self.held = []

        def exists(self):
            return bool(self.held)

        def appendValue(self, value):
            self.held.append(value)

        def get(self):
            return iter(self.held)

        def clear(self):
            self.held = []

    class Handle:
        def getListState(self, name, schema):
            self.rows = Rows()
            return self.rows

        def registerTimer(self, at):
            self.at = at

    rnd, width, handle = random.Random(5), 1 << 40, Handle()
    data = [(rnd.choice(["a", "b", None, "c"]), rnd.randrange(2 * width), str((1 << 60) + i), rnd.random() < 0.6) for i in range(900)]
    counter = ST.TrailingCount(width, 3)
    counter.init(handle)
    list(counter.handleInputRows((0, 1), iter([pd.DataFrame(data[i : i + 300], columns=["k", "us", "id", "own"]) for i in (0, 300, 600)]), None))
    assert len(handle.rows.held) == 1 and handle.at == 2 * width // 1000
    got = pd.concat(counter.handleExpiredTimer((0, 1), None, None))
    want = {i: sum(k2 == k and us - width < us2 <= us for k2, us2, _, _ in data) for k, us, i, own in data if own}
    assert dict(zip(got["id"], got["recent"])) == want
    codes, times = np.array([0, 1, 2, 3] * 3), np.array([0] * 4 + [1 << 61] * 4 + [1] * 4)
    assert list(ST._trailing(codes, times, 5)) == [1] * 8 + [2] * 4


def test_model_tasks_hold_few_texts(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        prompts = spark.range(2000, numPartitions=1).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
        assert model_column(prompts).count() == 2000
        assert spark.conf.get(name) == "512"
    finally:
        spark.conf.set(name, before)


def test_the_memo_of_words_keeps_no_long_ones():
    class Letters:
        def encode_batch_fast(self, words, add_special_tokens):
            return words

    counts = token_counts.WordCounts(Letters())
    words = [b"ab", b"x" * 1000, b"ab", b"y" * 65]
    assert counts.total(words) == 2 + 1000 + 2 + 65 and set(counts) == {b"ab"}


def test_chunk_files_of_nulls_and_repeated_rows(spark):
    """One row per item and position; a missing package leaves the other paths, a missing chunk file leaves nothing."""
    rows = [
        (1, 1, None, "AAA/c/a_chunks.json", "s1"),
        (1, 2, "pk/b/package.json", "b.json", "s2"),
        (1, 2, "pk/b/package.json", "b.json", "s2"),
        (1, 3, "pk/c/package.json", None, "s3"),
        (None, 1, "pk/b/package.json", "b.json", "s4"),
    ]
    matches = spark.createDataFrame(rows, "item long, ord long, json_path string, structured_chunks_file string, source_file string").withColumn("file_type", F.lit("docx"))
    manifest = spark.createDataFrame([("AAA/c/a_chunks_structured.json",), ("AAA/c/a_chunks.json",), ("pk/b/b.json",)], "path string")
    got = K.document_files(matches, "item", manifest).select("item", "ord", "chunks_file", "source_file").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 1, "AAA/c/a_chunks_structured.json", "s1"), (1, 2, "pk/b/b.json", "s2"), (None, 1, "pk/b/b.json", "s4")], key=str
    )


def test_fixed_text_is_laid_out_once(spark):
    """The expression that Spark gets stays small: each step stands in it once or twice, not once for each use."""
    from leafmill.functions.text import fixed_text

    df = spark.range(1).select(fixed_text(F.rand(), 6).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.Rand") < 60


def test_grid_cells_are_tidied_where_they_are_texts(spark):
    """Every white run of a text becomes one space, line breaks too; numbers are shown to six decimals, exact halves to even."""
    from leafmill.operators import sheets as H

    given = [
        ("a\r\n b|c", None, False, None, "a b\\|c"), ("  x  y\n", None, False, None, "x y"), ("\n", None, False, None, "..."), (None, None, False, None, "..."),
        (None, 0.0000005, False, None, "0"), (None, 12.5, False, None, "12.5"), (None, 7.0, None, None, "7"),
        (None, -0.125, False, "0.00%", "-12.5"), (None, 1.0, False, "0%", "100"), ("t", 100.0, True, None, "100"), (None, 0.9999999, False, None, "1"), (None, float("inf"), None, None, "Infinity"),
    ]
    rows = [("w", "s", i, 1, t, n, k, f) for i, (t, n, k, f, _) in enumerate(given)]
    cells = spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, text string, num double, is_int boolean, number_format string")
    assert [r["shown"] for r in H.formatted(cells).orderBy("row").collect()] == [g[-1] for g in given]


def test_large_and_small_groups_have_the_same_ranks(spark, monkeypatch):
    """Groups ranked whole and per bucket: the same positions, rows without an order count first, rows without a key go."""
    from leafmill.functions import ordered

    rows = [(k, t) for k in range(5) for t in random.Random(k).sample(range(500), 20 + 40 * k)] + [(0, None), (4, None), (None, 7)]
    df = spark.createDataFrame(rows, "k int, t long")
    want = sorted((k, t, 1 + sum(t > u for j, u in rows if j == k and u is not None) + (k in (0, 4))) for k, t in rows if k is not None and t is not None)
    for whole in (1, 100, 100_000):
        monkeypatch.setattr(ordered, "WHOLE_GROUP", whole)
        got = ordered.bucketed_rank(df, ["k"], ["t"], F.floor(F.col("t") / 50))
        assert sorted(map(tuple, got.select("k", "t", "ord").collect())) == want


def test_small_groups_are_ranked_without_a_join_of_their_rows(spark):
    """Rows of groups that one task may sort meet nothing but the broadcast list of the large groups."""
    from leafmill.functions import ordered

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).select((F.col("id") % 300).alias("k"), F.col("id").alias("t"))
        ranked = ordered.bucketed_rank(df, ["k"], ["t"], F.floor(F.col("t") / 10))
        assert ranked.count() == 2000
        ranked.collect()
        assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_that_many_rows_ask_for_are_split(spark):
    """The lookup of paths is a join of two plain shuffles, and adaptive execution splits its large task."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        n = 30_000
        rows = spark.range(0, n, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("note"), F.array(F.lit("shared"), F.col("id").cast("string"), F.lit(None).cast("string")).alias("paths"))
        manifest = spark.range(n).where("id % 2 = 0").select(F.col("id").cast("string").alias("path")).distinct()
        found = K._first_existing(rows, ["id"], manifest, ["note"])
        assert {(r["id"], r["path"]) for r in found.collect()} == {(i, str(i)) for i in range(0, n, 2)}
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        for name in own:
            spark.conf.unset(name)
