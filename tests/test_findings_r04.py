"""What the findings of the fourth round asked for: less to shuffle in the lookups of files."""
from pyspark.sql import functions as F

from leafmill.operators import catalog as K
from leafmill.plans import catalogue as C


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def shuffled_rows(df):
    """Rows that the first shuffle by path got from the left side of the lookup."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        else:
            if name == "Exchange" and "length(path" in node.toString().split("\n")[0]:
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_candidates_where_no_files_lie_do_not_move(spark):
    n = 500
    rows = spark.range(n).select("id", F.array(F.concat(F.lit("C:/x/"), F.col("id").cast("string"), F.lit(".json")), F.concat(F.lit("in/"), F.col("id").cast("string"), F.lit(".json")), F.lit("a/b/c/d.md")).alias("paths"))
    manifest = spark.range(n).where("id % 2 = 0").select(F.concat(F.lit("in/"), F.col("id").cast("string"), F.lit(".json")).alias("path"))
    found = K._first_existing(rows, ["id"], manifest, [])
    assert {(r["id"], r["path"]) for r in found.collect()} == {(i, f"in/{i}.json") for i in range(0, n, 2)}
    assert sorted(shuffled_rows(found)) == [n]


def test_any_path_that_exists_is_found(spark):
    """Paths without folders, without endings, absolute, empty, and files of no path; the first in rank counts, its columns come with it."""
    known = ["a", "", "/", "/a/b.txt", "x/y", "x/y.1234567890", "C:/d/é.docx", "x//y", ".hidden", "in/no.ending.d9", None]
    rows = [(i, f"note {i}", ["none", p, "a"]) for i, p in enumerate(known)] + [(99, "n", None), (100, "n", ["none", None]), (7, "again", ["a"]), (None, "z", ["x/y"])]
    candidates = spark.createDataFrame(rows, "id int, note string, paths array<string>")
    found = K._first_existing(candidates, ["id"], spark.createDataFrame([(p,) for p in known], "path string"), ["note"])
    want = {(i, p if p is not None else "a", f"note {i}") for i, p in enumerate(known)} - {(7, "x//y", "note 7")} | {(7, "a", "again"), (None, "x/y", "z")}
    assert {tuple(r) for r in found.collect()} == want


def lineitem(spark, tmp_path, rows):
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_the_manifest_has_every_path_once(spark, tmp_path):
    pairs = [(p, s) for p in [*range(40), None, 12, 12] for s in (1, 2, 3, 6, 12, None, 2)]
    d = lineitem(spark, tmp_path, [(1, p, s, "A", "O") for p, s in pairs])
    want = set()
    for p, s in pairs:
        key = "_".join(str(x) for x in (p, s) if x is not None)
        if p is not None:
            want |= {x for x, there in ((f"AAA/c/{key}_chunks_structured.json", p % 3 == 0), (f"AAA/c/{key}_chunks.json", p % 2 == 0), (f"pk/{key}/c{key}.json", p % 2), (f"pk/{key}/t1.docx", p % 5 < 2), ("pk/regions_word/t1.docx", p % 5 == 2), (f"AAA/img/{key}", p % 4 == 0)) if there}
        if s is not None:
            want |= {f"pk/{s}/markdown/s{k}.md" for k, n in ((1, 3), (2, 2)) if s % n}
    got = [r["path"] for r in C.manifest(spark, d).collect()]
    assert sorted(got) == sorted(want)


def test_matches_move_once(spark, tmp_path, monkeypatch):
    """Grouping and ranking share a shuffle; items too large for one task give the same rows by another way."""
    rows = [(o, p, s, "ANR"[(p or 0) % 3], "FO"[s % 2]) for o in (1, 2, None) for p in (5, 3, 1500, 3, None, 8) for s in (2, 1)]
    d = lineitem(spark, tmp_path, rows)
    want = []
    for o in (1, 2):
        files = {(p, s) for _, p, s, _, _ in rows if p is not None}
        want += [(o, i + 2 + 1, f"src/{p}_{s}") for i, (p, s) in enumerate(sorted(files))]  # those without a part count first
    from leafmill.functions import ordered

    for whole in (100_000, 3):
        monkeypatch.setattr(ordered, "WHOLE_GROUP", whole)
        m = C.matches(spark, d).select("item", "ord", "source_file")
        assert sorted(map(tuple, m.collect())) == want
        if whole > 3:
            assert final_plan(m).count("hashpartitioning(l_orderkey") == 1


def test_groups_of_laid_out_files_are_not_shuffled_again(spark):
    n = 1200
    keys = spark.range(n).select((F.col("id") % 2).alias("item"), (F.floor(F.col("id") / 2) + 1).alias("ord"), F.format_string("f%04d", "id").alias("name"))
    m = keys.select("item", "ord", F.lit("docx").alias("file_type"), F.lit("pk/package.json").alias("json_path"), F.concat("name", F.lit(".json")).alias("structured_chunks_file"), F.col("name").alias("source_file"))
    manifest = keys.select(F.concat(F.lit("pk/"), F.col("name"), F.lit(".json")).alias("path"))
    plain, laid = (K.document_groups(K.document_files(m, "item", manifest, **more), "item") for more in ({}, {"parts": True}))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, laid.collect())) and laid.count() == 4
    assert final_plan(laid).count("hashpartitioning(item") == final_plan(plain).count("hashpartitioning(item") - 1
