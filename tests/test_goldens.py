"""Edge documents with outputs derived by hand."""
from pyspark.sql import functions as F

from leafmill.operators import blocks, catalog, clean, images, judge, prompts, regions, responses, rollup, sections, select, sheets, tables


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, md string")


def one(spark, text, expr):
    return docs(spark, text).select(expr(F.col("md")).alias("x")).first()["x"]


def titles(spark, text):
    out = sections.h1_sections(docs(spark, text), "doc", "md").orderBy("ord").collect()
    return [(r.section_id, r.title, r.content) for r in out]


def test_sections(spark):
    pre = "文档开头"
    assert titles(spark, "") == [("h1_1", pre, "")]
    assert titles(spark, "\n\n") == [("h1_1", pre, "")]
    assert titles(spark, "\n# A") == [("h1_1", pre, ""), ("h1_2", "A", "# A")]
    assert titles(spark, "## only\nx") == [("h1_1", pre, "## only\nx")]
    assert titles(spark, "#\n # B \nb\n## c") == [("h1_1", pre, "#"), ("h1_2", "B", "# B \nb\n## c")]
    inside = "# A\n{{T_Start}}\n# hidden\n{{T_End}}\n# B"
    assert [t for _, t, _ in titles(spark, inside)] == ["A", "B"]
    unclosed = "# A\n{{T_Start}}\n# shown"
    assert [t for _, t, _ in titles(spark, unclosed)] == ["A", "shown"]
    assert [t for _, t, _ in titles(spark, "# A\r\ntext\r\n# B\r\n")] == ["A", "B"]


def test_table_count_ignores_heading_lines(spark):
    r = sections.section_table(docs(spark, "# {{X_Start}}\n{{Y_Start}}\n{{Image_1_Start}} {{Z_Start}}"), "doc", "md").first()
    assert (r.table_count, r.has_tables, r.total_sections) == (2, True, 1)


def test_summary(spark):
    text = "# T\nshort. This sentence is long enough! 这是一个足够长的中文句子吗？ {{Table_1_Start}}"
    r = sections.section_table(docs(spark, text), "doc", "md").first()
    assert r.summary == "本节主要内容：This sentence is long enough。这是一个足够长的中文句子吗。"
    r = sections.section_table(docs(spark, "# T\nno"), "doc", "md").first()
    assert r.summary == "本节为「T」相关内容。"
    r = sections.section_table(docs(spark, "# T\n" + "x" * 300), "doc", "md").first()
    assert r.summary == "本节主要内容：T\n" + "x" * 198 + "...。"


def ranges(spark, text, scope="stack"):
    out = regions.region_ranges(docs(spark, text), "doc", "md", scope).collect()
    return sorted((r.name, r.first_line, r.last_line) for r in out)


def test_paired_ranges(spark):
    assert ranges(spark, "{{A_End}}\n{{A_Start}}") == []
    assert ranges(spark, "{{A_Start}}\n{{A_Start}}\n{{A_End}}\n{{a_End}}\n{{A_end}}") == [("A", 0, 4), ("A", 1, 2)]
    assert ranges(spark, "{{A_Start}} x {{A_End}}") == [("A", 0, 0)]
    assert ranges(spark, "{{A_Start}}{{B_Start}}\n{{B_End}}") == []  # only the first Start of a line counts
    assert ranges(spark, "{{A_Start}}\n{{B_Start}}\n{{A_End}}\n{{B_End}}") == [("A", 0, 2), ("B", 1, 3)]


def test_single_open_ranges(spark):
    text = "{{Table_1_Start}}\n{{Table_2_Start}}\nx\n{{Table_1_End}}\n{{Table_2_End}}\n {{Image_3_Start}} \n{{Image_3_End}}"
    assert ranges(spark, text, "single_open") == [("Image_3", 6, 5), ("Table_2", 2, 3)]


def test_numbered_regions(spark):
    text = "{{Table_01_Start}}a{{Table_1_End}}b{{Table_1_End}}{{Image_2_Start}}{{Image_2_Start}}c{{Image_2_End}}{{Table_9_End}}"
    got = regions.scan_regions(docs(spark, text), "doc", "md").orderBy("ord").collect()
    assert [(r.name, r.start_pos, r.end_pos) for r in got] == [("Table_1", 0, 34), ("Table_1", 0, 50), ("Image_2", 67, 100)]
    assert text[67:100].startswith("{{Image_2_Start}}c")


def test_empty_regions_drop_out(spark):
    text = "{{Table_1_Start}} \n{{Table_1_End}}{{Table_2_Start}}\nx\n{{Table_2_End}}"
    got = regions.extract_regions(docs(spark, text), "doc", "md").collect()
    assert [(r.name, r.content, r.images, r.preview) for r in got] == [("Table_2", "x", 0, "x")]


def chunks(spark, text, **kw):
    b = blocks.blocks(docs(spark, text), "doc", "md")
    return [(r.title_path, r.content) for r in blocks.pack_chunks(b, "doc", **kw).orderBy("chunk_no").collect()]


def block_list(spark, text):
    return [(r.type, r.text) for r in blocks.blocks(docs(spark, text), "doc", "md").orderBy("ord").collect()]


def test_blocks(spark):
    # prose right after a table is written before the table
    assert block_list(spark, "|a|\n|-|\nprose\n|b|\n\nend") == [("paragraph", "prose"), ("table", "|a|\n|-|\n|b|"), ("paragraph", "end")]
    assert block_list(spark, "```py\n# not a head\n\n```\n# H #\nx") == [("code", "```py\n# not a head\n\n```"), ("heading", "H #"), ("paragraph", "x")]
    assert block_list(spark, "```\nopen") == [("code", "```\nopen")]
    assert block_list(spark, "a\n{{R_Start}}\nb\n\n{{r_end}}c") == [
        ("paragraph", "a"),
        ("region", "{{R_Start}}\nb\n\n{{r_end}}"),
        ("paragraph", "c"),
    ]
    assert block_list(spark, "a\n{{R_Start}}\nb\n\nc\n") == [("paragraph", "a"), ("region", "{{R_Start}}\nb\n\nc")]
    assert block_list(spark, "a\x0bb\x0c\x0cc") == [("paragraph", "a\nb"), ("paragraph", "c")]


def test_packing(spark):
    assert chunks(spark, "# A\n\naaaa\n\n# B\n\nbbbb", max_chars=6, min_chars=0) == [(["B"], "aaaa"), (["B"], "bbbb")]
    assert chunks(spark, "# A\n\naaaa\n\nbb", max_chars=6, min_chars=0) == [(["A"], "aaaa\n\nbb")]
    assert chunks(spark, "### C\n\nlong text\n\nx", max_chars=4, min_chars=5) == [(["C"], "long text\n\nx")]
    assert chunks(spark, "a\n\n{{R_Start}}x{{R_End}}\n\nb", max_chars=50, min_chars=0) == [
        ([], "a"),
        ([], "{{R_Start}}x{{R_End}}"),
        ([], "b"),
    ]


def test_auto_tagging(spark):
    def tag(t):
        return tables.tag_tables_and_images(docs(spark, t), "doc", "md").first()["marked"]

    assert tag("|a|\n|-|\n|1|") == "\n{{Table_1_Start}}\n\n|a|\n|-|\n|1|"  # runs to the end: no End tag
    assert tag("|a|\n|-|\n![i](u)\n![j](v)") == (
        "\n{{Table_1_Start}}\n\n|a|\n|-|\n\n{{Table_1_End}}\n\n![i](u)\n\n{{Image_1_Start}}\n![j](v)\n{{Image_1_End}}\n"
    )
    assert tag("|a|\n|-|\n|![i](u)|\n") == "\n{{Table_1_Start}}\n\n|a|\n|-|\n|![i](u)|\n\n{{Table_1_End}}\n\n"
    assert tag("") == ""


def test_grid_simplification(spark):
    def simple(t):
        return tables.simplify_grid_tables(docs(spark, t), "doc", "md").first()["simplified"]

    assert simple("t\n+--+--+\n| a (  x  ) | b  c |\n| 1 | 2 |\n+--+--+\nend") == "t\n|a (x)|b c|\n|--- | ---|\n|1|2|\nend"
    assert simple("| a |\n|---|\n| 1 |") == "|---|\n|a|\n|---|\n|1|"
    assert simple("| one |") == "|one|"
    assert simple("a\n---\n||\nb") == "a\nb"
    assert simple("") == ""


def test_table_documents(spark):
    text = "# Name: *x*\n\n|a|\n|b|\nafter\n|c|\ntail"
    got = tables.split_by_tables(docs(spark, text), "doc", "md").orderBy("table_no").collect()
    assert [(r.file_stem, r.text) for r in got] == [("Name_ _x__1", "# Name: *x*\n\n|a|\n|b|"), ("after_2", "after\n|c|")]
    assert tables.split_by_tables(docs(spark, "|a|\n|b|"), "doc", "md").first()["name"] == "sheet"


def test_images(spark):
    good = "![a](data:image/JPEG;base64,aGk=) ![](data:image/x;base64,aGk=) ![b](data:image/png;base64,a)"
    got = images.embedded_images(docs(spark, good), "doc", "md").orderBy("ord").collect()
    assert [(r.name, r.size, r.alt_text) for r in got] == [("image_49f68a5c8493.jpg", 2, "a"), ("image_49f68a5c8493.png", 2, "image")]
    assert one(spark, good, images.rewrite_embedded) == (
        "![a](./images/image_49f68a5c8493.jpg) ![image](./images/image_49f68a5c8493.png) ![b](data:image/png;base64,a)"
    )
    assert one(spark, "x ![](u) ![alt](v)", images.strip_images) == "x [图片] [图片: alt]"


def test_clean(spark):
    assert one(spark, "## H\n\n![i](u)\n```\n{{Table_1_Start}}\n<table>\nx\n</table>\ny", clean.plain_from_markdown) == "H\n{{Table_1_Start}}\ny"
    assert one(spark, "a\n<table>b\nc", clean.plain_from_markdown) == "a"
    dirty = " a\u00a0b\u200bc\u3000\r\nd\x07e\ufffd "
    assert one(spark, dirty, clean.normalise_characters) == "a bc  d e"
    assert one(spark, "a  \n\n\n\nb", lambda c: clean.normalise_characters(c, "preserve")) == "a\n\nb"
    assert one(spark, "\u3000\n ## T # \nx", lambda c: clean.pick_title(c, F.lit("f"))) == "T #"
    assert one(spark, " \n", lambda c: clean.pick_title(c, F.lit("f"))) == "f"


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"h\xc3\xa9\xff\xef\xbf\xbd"),), (bytearray("好\ufffd".encode()),)], "b binary")
    assert [r.t for r in df.select(clean.decode_text(F.col("b")).alias("t")).collect()] == ["hé", "好\ufffd"]


def test_line_roles(spark):
    got = clean.line_roles(docs(spark, "第1章\n- x\n\nk: v\na:b:c\n6. z"), "doc", "md").orderBy("ord").collect()
    assert [r.line_role for r in got] == ["章节: 第1章", "列表项: - x", "键值对: k = v", "段落: a:b:c", "段落: 6. z"]


def test_placeholders(spark):
    text = "{Table_1_Start} body {{{Table_1_End}}} {{Image_2_Start}}{Table_1_End} {{Block_Start}}"
    assert one(spark, text, rollup.canonical_placeholders) == "{{Table_1_Start}} {{Image_2_Start}}{{Table_1_End}} {{Block_Start}}"
    assert one(spark, "{{Table_1_Start}}a{{Table_2_End}}b{{Table_1_End}}", rollup.canonical_placeholders) == "{{Table_1_Start}}"
    assert one(spark, "{Table_2_Start} {{Image_1_Start}} {{Table_2_Start}}", rollup.harvest_placeholders) == [
        "{{Image_1_Start}}",
        "{{Table_2_Start}}",
    ]


def test_prompt_rendering(spark):
    def fill(t):
        return one(spark, t, lambda c: prompts.render(c, {"a": F.lit("{{b}}"), "b": F.lit("B")}))

    assert fill("x {{ a }} {b} {none}") == "x {b} B "  # the second pass halves doubled braces
    assert fill('{{b}} {"k": 1}') == 'B {"k": 1}'  # braces that do not fit: first pass only
    assert fill("plain") == "plain"
    assert fill("{{1x}} {{b}}") == "{1x} B"


def parse(spark, text, strong=False):
    cascade = responses.strong_cascade if strong else responses.basic_cascade
    r = one(spark, text, cascade)
    return (r["step"], r["json"]) if r else None


def test_response_cascades(spark):
    assert parse(spark, '{"a":1}') == ("whole", '{"a":1}')
    assert parse(spark, 'x ```json\n{"a":1}\n``` y') == ("json_fence", '{"a":1}')
    assert parse(spark, '```\n{"a":1}```') == ("fence", '{"a":1}')
    assert parse(spark, 'so {"a":1} there') == ("object", '{"a":1}')
    assert parse(spark, "no json") is None
    assert parse(spark, '{"a":1,}') is None
    strong = lambda t: parse(spark, t, True)
    assert strong('\ufeff```json\n{"a":1}\n```') == ("clean", '{"a":1}')
    assert strong('{"u": "http://x"} // note') == ("clean", '{"u":"http://x"}')
    assert strong('text {"a":"}"} more }') == ("balanced", '{"a":"}"}')
    assert strong('{"a":[1,2,],}') == ("balanced_commas", '{"a":[1,2]}')
    assert strong('{“a”:“b”}') == ("clean", '{"a":"b"}')
    assert strong('{"a":["b", "c') == ("closed", '{"a":["b","c"]}')
    assert strong("{'a': True, 'b': None}") == ("literal", '{"a":true,"b":null}')
    assert strong("nothing") is None
    assert strong("") is None


def test_chunk_ids(spark):
    chunks = spark.createDataFrame(
        [(1, "chunks", o, str(o), [c, None, None], None, f"t{o}") for o, c in ((1, "a"), (2, None), (3, ""))]
        + [(2, "sections", 1, "h1_1", ["h1_1"], "T", "s1")],
        "doc int, generation string, ord int, section_id string, ids array<string>, title string, content string",
    )
    asked = ["0", "1", "2", "3", "sec_0002", "x_0003", "a", "4", "b_9"]
    want = spark.createDataFrame(
        [(1, i + 1, w, 1.0) for i, w in enumerate(asked)] + [(2, 1, "h1_1", 1.0), (2, 2, "1", 1.0)],
        "doc int, rel_ord int, wanted string, score double",
    )
    got = select.resolve_chunks(want, chunks, "doc").collect()
    found = {(r.doc, r.wanted): r.content for r in got}
    # a plain number is the 0-based position, except the last, which only exists 1-based
    assert found == {
        (1, "0"): "t1",
        (1, "1"): "t2",
        (1, "2"): "t3",
        (1, "3"): "t3",
        (1, "sec_0002"): "t3",
        (1, "x_0003"): "t3",
        (1, "a"): "t1",
        (1, "4"): "t3",
        (2, "h1_1"): "s1",
    }


def test_cells(spark):
    rows = [
        (1, None, 0.123456, False, "0.00%"), (2, None, 0.5, False, "0%"), (3, None, 3.0, False, None), (4, None, 2.50, False, None),
        (5, None, 7.0, True, None), (6, " a|b\r\nc ", None, False, None), (7, "  ", None, False, None), (8, None, 1e20, False, None), (9, None, 1e-9, False, None),
    ]
    df = spark.createDataFrame(
        [("w", "s", i, 1, t, n, k, f) for i, t, n, k, f in rows],
        "workbook string, sheet string, row int, col int, text string, num double, is_int boolean, number_format string",
    )
    got = [r.shown for r in sheets.formatted(df).orderBy("row").collect()]
    assert got == ["12.3", "50", "3", "2.5", "7", "a\\|b c", "...", "100000000000000000000", "0"]
    assert one(spark, "b3:AA1", sheets.a1_range).asDict() == {"min_row": 1, "min_col": 2, "max_row": 3, "max_col": 27}


def test_row_kinds(spark):
    rows = [["T", "...", ""], ["- note", "..."], ["final", "x"], ["Final 2025-01-07 12:36", "..."], ["...", "..."], ["p.sas"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>")
    got = [r.k for r in df.select("i", sheets.row_kind(F.col("cells")).alias("k")).orderBy("i").collect()]
    assert got == ["title", "footer", "data", "footer", "data", "footer"]


def test_rtf_orientation(spark):
    assert one(spark, "{\\rtf\n\\paperw10\\paperh20", sheets.rtf_orientation) == "portrait"
    assert one(spark, "{\\rtf\n\\paperw30\\paperh20", sheets.rtf_orientation) == "landscape"
    assert one(spark, "{\\rtf\n\\paperw10\\paperh20\n\\landscape", sheets.rtf_orientation) == "portrait"
    assert one(spark, "{\\rtf\\paperw10\n\\landscape", sheets.rtf_orientation) == "landscape"
    assert one(spark, "\n" * 10 + "\\paperw10\\paperh20", sheets.rtf_orientation) == "landscape"


def test_paths(spark):
    assert one(spark, "C:\\x\\Aaa\\p\\f.docx", catalog.below_root) == "p/f.docx"
    assert one(spark, "x/AAA//p", catalog.index_path) == "AAA/p"
    assert one(spark, "x\\y", catalog.index_path) == "x\\y"
    assert one(spark, "'/p/q'", catalog.insertion_path) == "p/q"
    assert one(spark, "a/project_data/P1/x", catalog.project_of) == "P1"


def test_verdicts(spark):
    assert one(spark, '```json\n{"is_valid": true}\n```', judge.parse_verdict) is None
    assert one(spark, 'so: {"is_valid": true}', judge.parse_verdict) == '{"is_valid":true}'
    assert one(spark, '[生成失败] {"is_valid": true}', judge.parse_verdict) is None
