"""Queries of the sheet family."""
from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import sheets as H
from leafmill.plans.family import family
from leafmill.plans.recipes import load

QUERIES, SQL, query = family()


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _cell(row, col, text=None, num=None, is_int=False, fmt=None):
    return F.struct(
        row.cast("int").alias("row"),
        F.lit(col).alias("col"),
        (text if text is not None else F.lit(None)).cast("string").alias("text"),
        (num if num is not None else F.lit(None)).cast("double").alias("num"),
        F.lit(is_int).alias("is_int"),
        F.lit(fmt).cast("string").alias("number_format"),
    )


def _books(spark, d):
    return load(spark, d, "documents").select(
        F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("workbook"), F.split("text", "\n", -1).alias("ls")
    )


def cells(spark, d):
    """A workbook per document, a sheet row per line: data from row 4, column 2.

    A title stands in row 3, a footer after a gap at the end; a second sheet is blank.
    """

    def row(x, i):
        r, n = i + 4, F.length(x)
        return F.array(
            _cell(r, 2, num=i * 7, is_int=True),
            _cell(r, 3, text=F.concat(x, F.lit("| x\n  y"))),
            _cell(r, 4, num=n / 8, fmt="0.00"),
            _cell(r, 5, num=(n % 100) / 100, fmt="0.00%"),
            _cell(r, 6, text=F.when(n % 3 == 0, F.lit(" ")).when(n % 3 == 1, F.lit("")).otherwise(F.lit("z"))),
        )

    books = _books(spark, d)
    frame = F.array(
        _cell(F.lit(3), 2, text=F.concat(F.lit(" Title "), F.col("workbook"))),
        _cell(F.size("ls") + 5, 2, text=F.concat(F.lit("- 数据来源 "), F.col("workbook"))),
    )
    full = books.select(
        "workbook", F.lit("p1").alias("sheet"), F.inline(F.concat(F.flatten(F.transform("ls", row)), frame))
    )
    blank = books.select("workbook", F.lit("q[1]").alias("sheet"), F.inline(F.array(_cell(F.lit(2), 2, text=F.lit("  ")))))
    return full.unionByName(blank)


CELLS_SQL = """
sizes as (select 'w' || doc_id as workbook, 'p1' as sheet, len(string_split(text, chr(10))) as n from documents),
placed as (select 'w' || doc_id as workbook, 'p1' as sheet, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as rn from documents),
cells as (
  select workbook, sheet, rn + 3 as "row", 2 as col, null as text, ((rn - 1) * 7)::double as num, true as is_int, null as fmt from placed
  union all select workbook, sheet, rn + 3, 3, x || '| x' || chr(10) || '  y', null, false, null from placed
  union all select workbook, sheet, rn + 3, 4, null, length(x)::double / 8, false, '0.00' from placed
  union all select workbook, sheet, rn + 3, 5, null, (length(x) % 100)::double / 100, false, '0.00%' from placed
  union all select workbook, sheet, rn + 3, 6, case length(x) % 3 when 0 then ' ' when 1 then '' else 'z' end, null, false, null from placed
  union all select workbook, sheet, 3, 2, ' Title ' || workbook, null, false, null from sizes
  union all select workbook, sheet, n + 5, 2, '- 数据来源 ' || workbook, null, false, null from sizes
  union all select workbook, 'q[1]', 2, 2, '  ', null::double, false, null from sizes)"""

RANGE_SQL = CELLS_SQL + """,
rng as (select workbook, sheet, coalesce(min("row") filter (where f), 1) as min_row, coalesce(min(col) filter (where f), 1) as min_col,
  coalesce(max("row") filter (where f), 1) as max_row, coalesce(max(col) filter (where f), 1) as max_col
  from (select *, coalesce(text <> '', num is not null) as f from cells) group by workbook, sheet)"""


@query(
    "tab_1_filled_sheets",
    f"""with {CELLS_SQL} select workbook, sheet, replace(replace(sheet, '[', '_'), ']', '_') as safe_name, count(*) filter (where f) as filled_cells
from (select *, trim(coalesce(text, num::varchar)) <> '' as f from cells) group by workbook, sheet having bool_or(f)""",
)
def tab_1(spark, d):
    return H.filled_sheets(cells(spark, d))


@query("tab_1_sheet_cells", f"""with {CELLS_SQL} select workbook, sheet, "row", col from cells where sheet <> 'q[1]'""")
def tab_1_cells(spark, d):
    return H.split_sheets(cells(spark, d)).select("workbook", "sheet", *big("row", "col"))


@query("tab_2_used_range", f"with {RANGE_SQL} select workbook, sheet, min_row, min_col, max_row, max_col from rng")
def tab_2(spark, d):
    return H.used_range(cells(spark, d)).select("workbook", "sheet", *big("min_row", "min_col", "max_row", "max_col"))


@query(
    "tab_2_a1_range",
    """select p_partkey, least(p_size, 7) as min_row, least(p_size % 26 + 1, 27 + p_size % 26) as min_col, greatest(p_size, 7) as max_row, 27 + p_size % 26 as max_col from part""",
)
def tab_2_a1(spark, d):
    size = F.col("p_size")
    letter = F.chr(size % 26 + 65)
    a1 = F.concat(F.lit("a"), letter, F.lit("7:"), letter, size.cast("string"))
    part = load(spark, d, "part").select("p_partkey", H.a1_range(a1).alias("r"))
    return part.select("p_partkey", *[F.col(f"r.{c}").cast("bigint").alias(c) for c in ("min_row", "min_col", "max_row", "max_col")])


def merges(spark, d):
    m = lambda *v: F.struct(*[x.cast("int").alias(n) for x, n in zip(v, ("min_row", "min_col", "max_row", "max_col"))])
    return _books(spark, d).select(
        "workbook",
        F.lit("p1").alias("sheet"),
        F.inline(
            F.array(m(F.lit(3), F.lit(2), F.lit(3), F.lit(6)), m(F.lit(4), F.lit(3), F.size("ls") + 3, F.lit(4)))
        ),
    )


MERGE_SQL = CELLS_SQL + """,
merges as (select workbook, sheet, 3 as min_row, 2 as min_col, 3 as max_row, 6 as max_col from sizes union all select workbook, sheet, 4, 3, n + 3, 4 from sizes),
laid as (select m.workbook, m.sheet, r."row", c.col, r."row" = min_row and c.col = min_col as own, k.text as corner
  from merges m, unnest(range(min_row, max_row + 1)) r("row"), unnest(range(min_col, max_col + 1)) c(col), cells k
  where k.workbook = m.workbook and k.sheet = m.sheet and k."row" = m.min_row and k.col = m.min_col)"""


@query("tab_3_merge_fill_dots", f"""with {MERGE_SQL} select workbook, sheet, "row", col, case when own then corner else '...' end as filled from laid""")
def tab_3(spark, d):
    return H.expand_merges(cells(spark, d), merges(spark, d)).select("workbook", "sheet", *big("row", "col"), "filled")


@query("tab_3_merge_fill_copy", f"""with {MERGE_SQL} select workbook, sheet, "row", col, corner as filled from laid""")
def tab_3_copy(spark, d):
    return H.expand_merges(cells(spark, d), merges(spark, d), "copy").select("workbook", "sheet", *big("row", "col"), "filled")


FORMAT_SQL = RANGE_SQL + """,
fmt as (select workbook, sheet, "row", col, case
    when fmt like '%\\%%' escape '\\' and num is not null then regexp_replace(regexp_replace(printf('%.1f', num * 100.0), '0+$', ''), '\\.$', '')
    when num is not null and (is_int or abs(num - round(num)) < 1e-12) then round(num)::decimal(38,0)::varchar
    when num is not null then regexp_replace(regexp_replace(printf('%.6f', num), '0+$', ''), '\\.$', '')
    when trim(coalesce(text, '')) = '' then '...'
    else trim(regexp_replace(replace(replace(text, chr(10), ' '), '|', '\\|'), '\\s+', ' ', 'g')) end as shown from cells),
grid as (select r.workbook, r.sheet, x."row", list(coalesce(f.shown, '...') order by c.col) as cs
  from rng r, unnest(range(min_row, max_row + 1)) x("row"), unnest(range(min_col, max_col + 1)) c(col)
  left join fmt f on f.workbook = r.workbook and f.sheet = r.sheet and f."row" = x."row" and f.col = c.col
  group by r.workbook, r.sheet, x."row"),
kinds as (select *, case when cs[1] <> '...' and len(list_filter(cs[2:], lambda c: c not in ('', '...'))) = 0 then
    case when starts_with(cs[1], '-') or contains(cs[1], '数据来源') then 'footer' else 'title' end else 'data' end as kind from grid),
titles as (select workbook, sheet, line, min(p) as p from (select workbook, sheet, sheet as line, -1 as p from rng union all select workbook, sheet, cs[1], "row" from kinds where kind = 'title') group by all),
ranked as (select *, row_number() over (partition by workbook, sheet order by "row") as nth from kinds where kind = 'data'),
lines as (
  select workbook, sheet, line, 0 as phase, p, 0 as k from titles
  union all select workbook, sheet, '', 1, 0, 0 from rng
  union all select workbook, sheet, '| ' || array_to_string(cs, ' | ') || ' |', 2, "row", 0 from ranked
  union all select workbook, sheet, '| ' || array_to_string(list_transform(cs, lambda c: '---'), ' | ') || ' |', 2, "row", 1 from ranked where nth = 1),
numbered as (select *, row_number() over (partition by workbook, sheet order by phase, p, k) as line_no from lines)"""


@query("tab_4_grid_rows", f"""with {FORMAT_SQL} select workbook, sheet, "row", array_to_string(cs, chr(9)) as cells from grid""")
def tab_4(spark, d):
    c = cells(spark, d)
    return H.grid_rows(c, H.used_range(c)).select("workbook", "sheet", *big("row"), F.array_join("cells", "\t").alias("cells"))


@query("tab_5_cell_format", f"""with {FORMAT_SQL} select workbook, sheet, "row", col, shown from fmt""")
def tab_5(spark, d):
    return H.formatted(cells(spark, d)).select("workbook", "sheet", *big("row", "col"), "shown")


@query("tab_6_row_kinds", f"""with {FORMAT_SQL} select workbook, sheet, "row", kind from kinds""")
def tab_6(spark, d):
    c = cells(spark, d)
    return H.grid_rows(c, H.used_range(c)).select("workbook", "sheet", *big("row"), H.row_kind(F.col("cells")).alias("kind"))


def _lines(spark, d):
    c = cells(spark, d)
    return H.sheet_lines(H.grid_rows(c, H.used_range(c)))


@query(
    "tab_7_sheet_markdown",
    f"with {FORMAT_SQL} select workbook, sheet, (line_no - 1) // 512 as part, string_agg(line, chr(10) order by line_no) as line from numbered group by workbook, sheet, (line_no - 1) // 512",
)
def tab_7(spark, d):
    return H.sheet_markdown(_lines(spark, d)).withColumn("part", F.col("part").cast("bigint"))


@query(
    "tab_7_shape_stats",
    f"""with {FORMAT_SQL} select workbook, sheet, count(*) filter (where starts_with(line, '|')) as rows,
  coalesce(arg_min(length(line) - length(replace(line, '|', '')) - 1, line_no) filter (where starts_with(line, '|')), 0) as cols from numbered group by workbook, sheet""",
)
def tab_7_stats(spark, d):
    return H.shape_stats(_lines(spark, d)).select("workbook", "sheet", *big("rows", "cols"))


@query(
    "tab_8_edge_trim",
    f"""with {RANGE_SQL},
full_cells as (select workbook, sheet, min("row") as a, min(col) as b, max("row") as c, max(col) as e from cells where trim(coalesce(text, num::varchar)) <> '' group by all)
select r.workbook, r.sheet, coalesce(a, 1) as min_row, coalesce(b, 1) as min_col, coalesce(c, 1) as max_row, coalesce(e, 1) as max_col from rng r left join full_cells f using (workbook, sheet)""",
)
def tab_8(spark, d):
    c = cells(spark, d)
    wide = H.used_range(c).select(
        "workbook", "sheet", F.lit(1).alias("min_row"), F.lit(1).alias("min_col"), (F.col("max_row") + 3).alias("max_row"), (F.col("max_col") + 2).alias("max_col")
    )
    return H.trimmed_range(c, wide).select("workbook", "sheet", *big("min_row", "min_col", "max_row", "max_col"))


@query(
    "tab_9_orientation",
    f"""with {RANGE_SQL},
f as (select workbook || '/' || sheet || '.xlsx' as path, case when sheet = 'q[1]' then 'portrait' when max_col > max_row then 'landscape' else 'portrait' end as orientation from rng)
select * from f
union all
select 'd' || doc_id || case doc_id % 5 when 0 then '.docx' else '.rtf' end,
  case doc_id % 5 when 0 then 'portrait' when 1 then 'landscape' when 2 then case when n_chars > 2000 then 'landscape' else 'portrait' end
    when 3 then case when n_chars > 1000 then 'portrait' else 'landscape' end else 'portrait' end from documents""",
)
def tab_9(spark, d):
    c = cells(spark, d)
    sizes = H.used_range(c).select(F.concat("workbook", F.lit("/"), "sheet", F.lit(".xlsx")).alias("path"), "max_row", "max_col", "sheet")
    sheets = sizes.select("path", (F.col("sheet") != "q[1]").alias("exists"), F.lit(None).cast("string").alias("head"))
    i, n = F.col("doc_id"), F.col("n_chars").cast("string")
    k = i % 5
    head = (
        F.when(k == 1, F.concat(F.lit("{\\rtf1\n"), F.lit("\n" * 3), F.lit("\\landscape\n\\paperw1\\paperh2")))
        .when(k == 2, F.concat(F.lit("{\\rtf1\n\\paperw"), n, F.lit("\n\\paperh2000\n\\landscape")))
        .when(k == 3, F.concat(F.lit("{\\rtf1\n"), F.when(F.col("n_chars") > 1000, F.lit("\\paperh2\\paperw1")).otherwise(F.lit("\\paperw1"))))
    )
    docs = load(spark, d, "documents").select(
        F.concat(F.lit("d"), i.cast("string"), F.when(k == 0, ".docx").otherwise(".rtf")).alias("path"), (k != 4).alias("exists"), head.alias("head")
    )
    return H.orientation(sheets.unionByName(docs), sizes.drop("sheet"))
