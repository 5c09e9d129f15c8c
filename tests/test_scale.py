"""Hot groups and partition order: one key holds most rows, results stay exact."""
from collections import defaultdict

from pyspark.sql import functions as F

from leafmill.functions.joins import substring_join
from leafmill.functions.ordered import bucketed_last, bucketed_rank, join_parts, trailing_count
from leafmill.operators import rollup, sections, sheets, tables, telemetry
from leafmill.plans.recipes import md_docs


def hot(spark, n=3000):
    """Two thirds of the rows have key 1."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, F.lit(1)).otherwise(F.col("id") % 7 + 2).cast("int").alias("k"),
        ((F.col("id") * 7919) % n).alias("t"),
        F.col("id").cast("string").alias("v"),
    )


def by_key(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.k].append(r)
    return {k: sorted(v, key=lambda r: r.t) for k, v in out.items()}


def test_bucketed_rank(spark):
    ranked = bucketed_rank(hot(spark), ["k"], ["t"], F.floor(F.col("t") / 100)).collect()
    assert len(ranked) == 3000
    for rows in by_key(ranked).values():
        assert [r.ord for r in rows] == list(range(1, len(rows) + 1))


def test_join_parts_is_whole(spark):
    ranked = bucketed_rank(hot(spark), ["k"], ["t"], F.floor(F.col("t") / 100))
    parts = join_parts(ranked, ["k"], "ord", "v", ",", rows=100).orderBy("k", "part").collect()
    assert max(r.v.count(",") for r in parts) == 99
    whole = defaultdict(list)
    for r in parts:
        whole[r.k] += r.v.split(",")
    assert dict(whole) == {k: [r.v for r in rows] for k, rows in by_key(hot(spark).collect()).items()}


def test_trailing_count(spark):
    got = trailing_count(hot(spark), ["k"], F.col("t"), 50).collect()
    for rows in by_key(got).values():
        for r in rows:
            assert r.recent == sum(1 for o in rows if r.t - 50 < o.t <= r.t)


def test_bucketed_last(spark):
    value = F.when(F.col("t") % 11 == 0, F.col("v"))
    got = bucketed_last(hot(spark), ["k"], ["t"], F.floor(F.col("t") / 40), value, "before").collect()
    assert len(got) == 3000
    for rows in by_key(got).values():
        last = None
        for r in rows:
            assert r.before == last
            last = r.v if r.t % 11 == 0 else last


def test_substring_join(spark):
    words = ["a", "ab", "abc", "bcd", "zzz", "needle", "AAA/in", "x_1.docx"]
    texts = ["abcd", "has a needle in it", "AAA/in/x_1.docx", "AAA/in/y", "", "zz", "dabc"]
    needles = spark.createDataFrame([(w,) for w in words], "w string")
    hay = spark.createDataFrame([(t,) for t in texts], "t string")
    got = sorted((r.w, r.t) for r in substring_join(needles, "w", hay, "t").collect())
    assert got == sorted((w, t) for w in words for t in texts if w in t)


def test_long_sheet(spark):
    n = sheets.ROW_BLOCK * 2 + 5
    cells = spark.range(n).select(
        F.lit("w").alias("workbook"),
        F.lit("s").alias("sheet"),
        (F.col("id") * 2 + 1).cast("int").alias("row"),
        F.lit(2).alias("col"),
        F.lit(None).cast("string").alias("text"),
        F.col("id").cast("double").alias("num"),
        F.lit(True).alias("is_int"),
        F.lit(None).cast("string").alias("number_format"),
    ).unionByName(
        spark.createDataFrame(
            [("w", "s", r, 3, "x", None, False, None) for r in (1, 3)],
            "workbook string, sheet string, row int, col int, text string, num double, is_int boolean, number_format string",
        )
    )
    lines = sheets.sheet_lines(sheets.grid_rows(cells, sheets.used_range(cells))).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == list(range(1, len(lines) + 1))
    text = [r.line for r in lines]
    # name, one title per single-cell row (all distinct numbers), gap, then two real rows, blanks and the rule
    assert text[0] == "s" and text[1] == "2" and text[n - 2] == str(n - 1) and text[n - 1] == ""
    assert text[n : n + 4] == ["| 0 | x |", "| --- | --- |", "| ... | ... |", "| 1 | x |"]
    assert len(text) == 2 * n + 2  # n - 1 heads, a gap, n + 1 table rows, the rule


def test_partition_order_does_not_matter(spark, sf_dir):
    base = md_docs(spark, sf_dir)

    def run(df):
        return (
            sections.section_table(df, "doc_id", "md").collect(),
            tables.tag_tables_and_images(df, "doc_id", "md").collect(),
        )

    one, seven = run(base.repartition(1)), run(base.repartition(7))
    assert [sorted(x) for x in one] == [sorted(x) for x in seven]


def test_hot_paragraph_keeps_every_file(spark):
    files = spark.range(1500).select(
        F.lit(1).alias("item"),
        (F.col("id") + 1).alias("ord"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"),
        F.lit("success").alias("status"),
        F.lit("c").alias("content"),
    )
    parts = rollup.file_results(files, "item").orderBy("part").collect()
    assert len(parts) == 3
    whole = rollup.FILE_RULE.join(r.content for r in parts)
    assert whole == rollup.FILE_RULE.join(f"## Source: f{i}\n\nc" for i in range(1500))


def test_directories_across_parts(spark):
    files = spark.range(1200).select(
        F.lit(1).alias("item"),
        (F.col("id") + 1).alias("ord"),
        F.when(F.col("id") % 3 == 0, "in/b/markdown").otherwise("in/a").alias("directory"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("title"),
        F.lit("c").alias("content"),
    )
    whole = "".join(r.content for r in rollup.directory_results(files, "item").orderBy("part").collect())
    block = lambda ids: rollup.SHEET_RULE.join(f"### Sheet: s{i}\n\nc\n" for i in ids)
    b, a = [i for i in range(1200) if i % 3 == 0], [i for i in range(1200) if i % 3]
    assert whole == f"## 来源: b\n\n{block(b)}" + rollup.DIRECTORY_RULE + f"## 来源: a\n\n{block(a)}"


def test_tag_machine_against_replay(spark):
    kinds = ["start", "stage", "error", "success", "reset"]
    events = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("tag"),
        ((F.col("id") * 31) % 500).alias("ts"),
        F.col("id").alias("event_id"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), ((F.col("id") * 13) % 23 % 5 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("stage"),
    )
    state = {}
    for e in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        if e.kind == "reset":
            state.pop(e.tag, None)
            continue
        s = state.setdefault(e.tag, {"status": "pending", "stage": None, "start": None})
        if e.kind == "start":
            s["status"], s["start"] = "processing", e.ts
        elif e.kind == "stage":
            s["stage"] = e.stage
        elif e.kind == "error":
            s["status"] = "failed"
        elif s["status"] != "failed":
            s["status"] = "success"
    got = {r.tag: {"status": r.status, "stage": r.current_stage, "start": r.started_at} for r in telemetry.tag_state(events).collect()}
    assert got == state


def test_fixed_text_rounds_the_binary_value(spark):
    """Exact halves to even, everything else by its exact value, as Python does."""
    import random

    from leafmill.functions.text import fixed_text, percent_text

    rnd = random.Random(5)
    values = [3.125, 28.125, 0.5, 1.5, 2.5, 2.675, 1.005, 0.125, -0.125, 0.0, -0.001, 99.995, 0.999, 9.5, 1e-7, 123456789.125, 2.0**53, 1e-300]
    values += [rnd.randint(0, 4000) / 8 for _ in range(200)] + [rnd.random() * 10 ** rnd.randint(-6, 6) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for d in (0, 1, 2, 6):
        for r in df.select("x", fixed_text(F.col("x"), d).alias("t")).collect():
            assert r["t"] == f"{r['x']:.{d}f}"
    rates = spark.createDataFrame([(18, 64), (0, 0), (1, 3)], "a long, b long").select(percent_text(F.col("a"), F.col("b")).alias("t"))
    assert [r["t"] for r in rates.collect()] == ["28.12%", "0%", "33.33%"]


def test_no_limit_hides_cells_lines_or_names(spark):
    from leafmill.operators import clean, sections, sheets

    wide = spark.range(1).select(F.concat(F.array(F.lit("head")), F.array_repeat(F.lit("..."), 20_000), F.array(F.lit("value"))).alias("c"))
    assert wide.select(sheets.row_kind(F.col("c")).alias("k")).first()["k"] == "data"
    text = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(30)))], "d long, t string")
    assert clean.line_roles(text, "d", "t").count() == 30 and clean.line_roles(text, "d", "t", 20).count() == 20
    long = spark.createDataFrame([("x" * 60_000,)], "t string")
    assert long.select(F.length(sections.summary_model_input(F.col("t"))).alias("n")).first()["n"] == 60_000
    names = ["n" * 31 + "a", "n" * 31 + "b", "N" * 31, "other"]
    cells = spark.createDataFrame([("w", n, 1, 1, None, "v") for n in names], "workbook string, sheet string, row int, col int, num double, text string")
    safe = [r["safe_name"] for r in sheets.filled_sheets(cells).collect()]
    assert len({s.lower() for s in safe}) == 4 and max(map(len, safe)) <= 31


def test_images_with_one_short_name_stay_apart(spark):
    from leafmill.operators import images

    rows = [(1, 0, "same.png", "png", 1, "d1", b"a"), (2, 0, "same.png", "png", 1, "d2", b"b"), (3, 0, "same.png", "png", 1, "d1", b"a")]
    got = images.asset_store(spark.createDataFrame(rows, "doc long, ord int, name string, format string, size int, digest string, bytes binary"), "doc").collect()
    assert {(r["digest"], bytes(r["bytes"]), r["occurrences"]) for r in got} == {("d1", b"a", 2), ("d2", b"b", 1)}
    assert len({r["name"] for r in got}) == 2


def joined(parts, sep):
    """Text of ``part, glued, content`` rows."""
    return "".join((sep if k and not glued else "") + t for k, (_, glued, t) in enumerate(sorted(parts)))


def canonical(t):
    """The rule on a whole text."""
    import re

    t = re.sub(rollup.ANY_BRACES.replace(r"\{", "{").replace(r"\}", "}"), r"{{\1}}", t)
    for k in rollup.KINDS:
        t = re.sub(r"\{\{" + k + r"_(\d+)_Start\}\}[\s\S]*?\{\{" + k + r"_\1_End\}\}", "{{" + k + r"_\1_Start}}", t)
    return t


def test_an_item_glued_from_end_to_end(spark, monkeypatch):
    """Every row ends one region and begins the next: parts stay small, and so does every list that Spark gathers."""
    from leafmill.operators import spans

    monkeypatch.setattr(spans, "BUCKET", 50)
    n = 1500
    rows = [(1, i + 1, f"a{i} {{{{Table_{i}_End}}}} b{i} {{{{Table_{i + 1}_Start}}}} c{i}") for i in range(n)]
    rows += [(2, i + 1, f"{{{{Image_{i % 2}_Start}}}} x {{{{Image_{(i + 1) % 2}_End}}}}") for i in range(n)]
    rows += [(3, i + 1, "{{Table_1_Start}} t {{Table_1_End}} {{Image_7_Start}}") for i in range(20)]
    want = {k: canonical("\n\n".join(t for i, _, t in rows if i == k)) for k in (1, 2, 3)}
    chunks = spark.createDataFrame(rows, "item long, ord int, content string").repartition(6)
    asked = spark.range(4).select(F.col("id").alias("item"), F.lit("").alias("extract"), F.lit(True).alias("original_mode"))
    got = defaultdict(list)
    for r in rollup.full_content(asked, chunks, "item", 100).collect():
        got[r["item"]].append((r["part"], r["glued"], r["content"]))
        assert len(r["content"]) < 100 * 40
    assert {k: joined(p, "\n\n") for k, p in got.items()} == want
    assert len(got[1]) == n // 100 and all(glued for part, glued, _ in got[1] if part)
    crossing = spans.crossing_items(chunks, "item", "ord", "content", rollup.KINDS)
    assert sorted(r["item"] for r in crossing.collect()) == [1, 2]
    assert spans.crossing_items(chunks.where("item = 3"), "item", "ord", "content", rollup.KINDS) is None


def test_regions_are_chosen_from_the_left(spark, monkeypatch):
    import random

    from leafmill.operators import spans

    monkeypatch.setattr(spans, "BUCKET", 8)
    rnd = random.Random(12)
    rows, want = [], set()
    for item in range(30):
        reach = rnd.choice([2, 9, 60])
        places = sorted(rnd.sample(range(400), rnd.randint(1, 80)))
        own = []
        for p in places:
            own.append((p, p + rnd.randint(1, reach)))
        last = -1
        for a, b in own:
            rows.append((item, (a // 3, 2 * (a % 3)), (b // 3, 2 * (b % 3) + 1)))
            if 2 * a > last:
                want.add((item, a))
                last = 2 * b + 1
    schema = "item long, start struct<o:bigint,i:int>, end struct<o:bigint,i:int>"
    got = spans.chosen_regions(spark.createDataFrame(rows, schema).repartition(5), "item").collect()
    assert sorted((r["item"], r["start"]["o"] * 3 + r["start"]["i"] // 2) for r in got) == sorted(want)


def test_part_size_changes_no_text(spark):
    """Regions and HTML tables that span rows: parts of 2 and of 10,000 rows give the text of the whole item."""
    import random

    from leafmill.operators import assemble

    rnd = random.Random(8)
    bits = [f"{{{{{k}_{n}_{s}}}}}" for k in ("Table", "Image") for n in (1, 2, 3) for s in ("Start", "End")] + ["{Table_1_Start}", "a", "b c", " ", "\n", "x"]
    rows, texts = [], {}
    for item in range(60):
        own = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 14))]
        own += ["plain"] * (1500 if item == 7 else 0) + ["{{Table_9_Start}} in", "middle", "{{Table_9_End}} out"]
        texts[item] = canonical("\n\n".join(own))
        rows += [(item, i + 1, "success", t) for i, t in enumerate(own)]
    chunks = spark.createDataFrame(rows, "item long, ord int, status string, content string").repartition(5)
    asked = spark.range(60).select(F.col("id").alias("item"), F.lit("").alias("extract"), F.lit(True).alias("original_mode"))
    for part_rows in (2, 512, 10_000):
        got = defaultdict(list)
        for r in rollup.full_content(asked, chunks, "item", part_rows).collect():
            got[r["item"]].append((r["part"], r["glued"], r["content"]))
        assert {i: joined(p, "\n\n") for i, p in got.items()} == texts

    items = [(1, i, "success", "line", False) for i in range(1, 1501)] + [(2, 1, "error", "x", False)]
    items[511] = (1, 512, "success", "before\n<table>", False)
    items[513] = (1, 514, "success", "gone\n</table>\nafter", False)
    frame = spark.createDataFrame(items, "paragraph long, ord long, status string, content string, insert_original boolean")
    files = spark.createDataFrame([], "paragraph long, ord long, placeholder string")
    want = "\n".join(["line"] * 511 + ["before", "after"] + ["line"] * 986)
    for part_rows in (2, 512, 10_000):
        got = defaultdict(list)
        for r in assemble.direct_text(frame, files, "paragraph", part_rows).collect():
            got[r["paragraph"]].append((r["part"], r["content"]))
        assert "\n".join(t for _, t in sorted(got[1])) == want
        assert got[2] == [(0, "")]
