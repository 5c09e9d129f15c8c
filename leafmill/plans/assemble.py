"""Queries of the generation and assembly family (a customer is a paragraph, an order an item)."""
from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.ordered import bucketed_rank, join_parts
from leafmill.operators import assemble as G
from leafmill.plans.family import family
from leafmill.plans.recipes import load, spread

QUERIES, SQL, query = family()


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def text(c):
    return F.col(c).cast("string")


def raw_items(spark, d):
    """Items in key order: ``ord`` is the order key, not dense."""
    k = F.col("o_orderkey")
    p = F.substring("o_orderpriority", 1, 1)
    body = F.concat(
        F.lit("## Source: f"),
        text("o_orderkey"),
        F.lit("\n\n# Head "),
        text("o_orderkey"),
        F.lit("\n---\n### Sheet: s\n{{ORIGINAL_CONTENT:zz}}{{Table_"),
        (k % 3).cast("string"),
        F.lit("_Start}} body\n\n\n\nend {{Image_7_Start}}"),
    )
    return spread(load(spark, d, "orders"), "o_orderkey").select(
        F.col("o_custkey").alias("paragraph"),
        k.alias("item"),
        k.alias("ord"),
        F.when(k % 11 == 0, "error").otherwise("success").alias("status"),
        F.when(k % 11 == 0, F.concat(F.lit("bad "), text("o_orderkey"))).alias("error"),
        F.when(p == "1", "word").when(p == "2", "pdf").when(p == "3", "excel").when(p == "4", "rtf").otherwise("tfl").alias("data_type"),
        F.when(k % 2 == 0, F.concat(F.lit("q"), "o_orderstatus")).alias("quote"),
        body.alias("content"),
        (F.col("o_orderstatus") == "F").alias("insert_original"),
    )


def items(spark, d):
    """Items with a dense 1-based ``ord``."""
    return bucketed_rank(raw_items(spark, d).drop("ord"), ["paragraph"], ["item"], F.floor(F.col("item") / 100000))


ITEMS_SQL = """
items as (select o_custkey as paragraph, o_orderkey as item, o_orderkey % 11 <> 0 as ok, 'bad ' || o_orderkey as error,
  case o_orderpriority[1] when '1' then 'word' when '2' then 'pdf' when '3' then 'excel' when '4' then 'rtf' else 'tfl' end as data_type,
  case when o_orderkey % 2 = 0 then 'q' || o_orderstatus end as quote, o_orderstatus = 'F' as ins,
  '## Source: f' || o_orderkey || chr(10) || chr(10) || '# Head ' || o_orderkey || chr(10) || '---' || chr(10) || '### Sheet: s' || chr(10) || '{{ORIGINAL_CONTENT:zz}}{{Table_' || (o_orderkey % 3) || '_Start}} body' || repeat(chr(10), 4) || 'end {{Image_7_Start}}' as content,
  row_number() over (partition by o_custkey order by o_orderkey) as ord from orders)"""


@query(
    "gen_1_two_phases",
    f"""with {ITEMS_SQL}
select paragraph, case when bool_and(ok) then 'items ' || count(*) else '' end as generated_content, case when bool_and(ok) then 'success' else 'error' end as status,
  arg_min(error, ord) filter (where not ok) as error from items group by paragraph""",
)
def gen_1(spark, d):
    generate = lambda sound: sound.groupBy("paragraph").agg(F.concat(F.lit("items "), F.count(F.lit(1)).cast("string")).alias("generated_content"))
    slim = raw_items(spark, d).select("paragraph", "ord", "status", "error")
    return G.two_phases(slim, "paragraph", generate)


@query(
    "gen_2_reference_text",
    f"""with {ITEMS_SQL} select paragraph, (ord - 1) // 512 as part, string_agg(case when quote is not null then '【' || quote || '】' || chr(10) else '' end || content, chr(10) || chr(10) order by ord) as content
from items where ok and data_type <> 'tfl' group by paragraph, (ord - 1) // 512
union all select distinct paragraph, 0, '' from items where paragraph not in (select paragraph from items where ok and data_type <> 'tfl')""",
)
def gen_2(spark, d):
    return G.reference_text(items(spark, d), "paragraph").withColumn("part", F.col("part").cast("bigint"))


def file_tags(spark, d):
    """File placeholders: every item of sheet type offers one, some twice."""
    sheets = raw_items(spark, d).where("data_type in ('excel', 'rtf')")
    tag = F.concat(F.lit("{{TFL_t"), (F.col("item") % 4).cast("string"), F.lit("}}"))
    return sheets.select(
        "paragraph",
        "ord",
        tag.alias("placeholder"),
        F.concat(F.lit("AAA/x/"), text("item"), F.when(F.col("data_type") == "excel", ".xlsx").otherwise(".rtf")).alias("path"),
        F.concat(F.lit("src "), text("item")).alias("source"),
    )


TAGS_SQL = ITEMS_SQL + """,
tags as (select paragraph, ord, '{{TFL_t' || (item % 4) || '}}' as placeholder, 'AAA/x/' || item || case data_type when 'excel' then '.xlsx' else '.rtf' end as path, 'src ' || item as source, data_type
  from items where data_type in ('excel', 'rtf'))"""


@query(
    "gen_3_direct_text",
    f"""with {TAGS_SQL},
c as (select paragraph, 0 as section, ord, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?m)^##\\s*Source:.*$', '', 'g'),
   '(?m)^###\\s*Sheet:\\s*.+\\n?', '', 'g'), '(?m)^\\s*---\\s*\\n?', '', 'g'), '(?m)^##\\s*来源:\\s*.+\\n?', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\{{\\{{ORIGINAL_CONTENT:[^}}]*\\}}\\}}', '', 'g'), ' ' || chr(10)) as t
   from items where ok
  union all select paragraph, 1, ord, placeholder from tags where paragraph in (select paragraph from items where ins)),
j as (select paragraph, string_agg(t, chr(10) || chr(10) order by section, ord) as t from c where t <> '' group by paragraph)
select paragraph, 0 as part, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^#+\\s*', '')), lambda x: trim(x) <> ''), chr(10)) as content from j
union all select distinct paragraph, 0, '' from items where paragraph not in (select paragraph from j)""",
)
def gen_3(spark, d):
    return G.direct_text(raw_items(spark, d), file_tags(spark, d), "paragraph").withColumn("part", F.col("part").cast("bigint"))


def generated(spark, d):
    """One model text per customer; half of them take originals."""
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("paragraph"),
        F.concat(F.lit("text of "), "c_name").alias("content"),
        (F.col("c_custkey") % 2 == 0).alias("insert_original"),
    )


@query(
    "gen_4_placeholder_append",
    f"""with {TAGS_SQL},
p as (select c_custkey as paragraph, 'text of ' || c_name as content, c_custkey % 2 = 0 as ins from customer),
f as (select paragraph, string_agg(placeholder, chr(10) order by ord) as t from tags group by paragraph),
g as (select paragraph, string_agg(t, chr(10) order by t) as t from (select distinct paragraph, '{{{{Table_' || (item % 3) || '_Start}}}}' as t from items where ins) group by paragraph)
select p.paragraph, 0 as part, content || case when p.ins and f.t is not null then chr(10) || chr(10) || f.t else '' end || case when p.ins and g.t is not null then chr(10) || chr(10) || g.t else '' end as content
from p left join f using (paragraph) left join g using (paragraph)""",
)
def gen_4(spark, d):
    tags = raw_items(spark, d).where("insert_original").select(
        "paragraph", F.concat(F.lit("{{Table_"), (F.col("item") % 3).cast("string"), F.lit("_Start}}")).alias("placeholder")
    )
    return G.append_placeholders(generated(spark, d), file_tags(spark, d), tags, "paragraph").withColumn("part", F.col("part").cast("bigint"))


def outputs(spark, d):
    """Paragraph texts that use file, table and image placeholders."""
    c = F.col("c_custkey")
    return load(spark, d, "customer").select(
        c.alias("paragraph"),
        F.concat(
            F.lit("A {{TFL_t"), (c % 4).cast("string"), F.lit("}} b {{Table_"), (c % 3).cast("string"),
            F.lit("_Start}} c {{Image_7}} d {{Table_"), (c % 3).cast("string"), F.lit("_Start}} e {{Nothing}}"),
        ).alias("content"),
    )


OUT_SQL = """
outs as (select c_custkey as paragraph, 'A {{TFL_t' || (c_custkey % 4) || '}} b {{Table_' || (c_custkey % 3) || '_Start}} c {{Image_7}} d {{Table_' || (c_custkey % 3) || '_Start}} e {{Nothing}}' as content from customer),
inv as (select paragraph, unnest(regexp_extract_all(content, '\\{\\{[^}]+\\}\\}')) as placeholder, generate_subscripts(regexp_extract_all(content, '\\{\\{[^}]+\\}\\}'), 1) - 1 as pos from outs)"""


@query("gen_5_placeholder_inventory", f"with {OUT_SQL} select paragraph, pos, placeholder from inv")
def gen_5(spark, d):
    return G.placeholder_inventory(outputs(spark, d), "paragraph", "content").select("paragraph", *big("pos"), "placeholder")


def resources(spark, d):
    """Each document item offers a table (label without its suffix) and an image (label with one)."""
    docs = raw_items(spark, d).where("data_type in ('word', 'pdf')")
    r = lambda label, kind: F.struct(label.alias("label"), F.lit(kind).alias("type"))
    table = F.concat(F.lit("Table_"), (F.col("item") % 3).cast("string"), F.when(F.col("item") % 2 == 0, "_Start").otherwise(""))
    return docs.select(
        "paragraph",
        F.col("ord"),
        F.concat(F.lit("r/"), text("item")).alias("path"),
        F.concat(F.lit("doc "), text("item")).alias("source_file"),
        F.inline(F.array(r(table, "table"), r(F.lit("Image_7_End"), "image"))),
    )


MAP_SQL = TAGS_SQL + "," + OUT_SQL + """,
res as (select paragraph, ord, 'Table_' || (item % 3) || case when item % 2 = 0 then '_Start' else '' end as label, 'table' as type, 'r/' || item as path, 'doc ' || item as source_file from items where data_type in ('word', 'pdf')
  union all select paragraph, ord, 'Image_7_End', 'image', 'r/' || item, 'doc ' || item from items where data_type in ('word', 'pdf')),
used as (select distinct paragraph, placeholder from inv),
direct as (select paragraph, placeholder, 'table' as type, arg_max(path, ord) as path, arg_max(source, ord) as source_file from used join tags using (paragraph, placeholder) group by all),
viares as (select paragraph, placeholder, arg_min(type, ord) as type, arg_min(path, ord) as path, arg_min(source_file, ord) as source_file
  from (select u.paragraph, u.placeholder, replace(replace(u.placeholder, '{{', ''), '}}', '') as l from used u) u join res r using (paragraph)
  where r.label = l or (ends_with(l, '_Start') and r.label = l[:-7]) or (ends_with(r.label, '_Start') and l = r.label[:-7]) or (ends_with(l, '_End') and r.label = l[:-5]) or (ends_with(r.label, '_End') and l = r.label[:-5])
  group by paragraph, placeholder),
rmap as (select * from direct union all select * from viares where (paragraph, placeholder) not in (select paragraph, placeholder from direct))"""


def mapping(spark, d):
    inventory = G.placeholder_inventory(outputs(spark, d), "paragraph", "content")
    return G.resource_map(inventory, file_tags(spark, d), resources(spark, d), "paragraph")


@query("gen_6_resource_map", f"with {MAP_SQL} select paragraph, placeholder, type, path, source_file from rmap")
def gen_6(spark, d):
    return mapping(spark, d).select("paragraph", "placeholder", "type", "path", "source_file")


@query(
    "gen_6_run_resource_map",
    f"""with {MAP_SQL} select c_nationkey as run, placeholder, arg_max(type, paragraph) as type, arg_max(path, paragraph) as path, max(paragraph) as paragraph, count(*) as owners
from rmap join customer on c_custkey = paragraph group by c_nationkey, placeholder""",
)
def gen_6_run(spark, d):
    order = load(spark, d, "customer").select(F.col("c_nationkey").alias("run"), F.col("c_custkey").alias("paragraph"), F.col("c_custkey").alias("para_ord"))
    return G.run_resource_map(mapping(spark, d), order, "run", "paragraph").select("run", "placeholder", "type", "path", "paragraph", "owners")


@query(
    "gen_7_orientation_split",
    f"""with {MAP_SQL},
o as (select i.paragraph, i.pos, i.placeholder, case when m.path is null then 'portrait' when ends_with(m.path, '.xlsx') then 'landscape' when ends_with(m.path, '.rtf') then 'portrait' when hash_digit(m.path) then 'landscape' else 'portrait' end as orientation
  from inv i left join rmap m using (paragraph, placeholder)),
l as (select paragraph, coalesce(array_to_string(list(placeholder order by pos) filter (where orientation = 'portrait'), ','), '') as portrait, coalesce(array_to_string(list(placeholder order by pos) filter (where orientation = 'landscape'), ','), '') as landscape,
  coalesce(list(distinct placeholder) filter (where orientation = 'landscape'), []) as ls from o group by paragraph)
select l.paragraph, portrait, landscape, case len(ls) when 0 then content when 1 then replace(content, ls[1], '') when 2 then replace(replace(content, ls[1], ''), ls[2], '') else replace(replace(replace(content, ls[1], ''), ls[2], ''), ls[3], '') end as body
from l join outs using (paragraph)""".replace("hash_digit(m.path)", "substr(m.path, 3)::bigint % 2 = 0 and m.path like 'r/%'"),
)
def gen_7(spark, d):
    m = mapping(spark, d)
    paths = m.select("path").distinct()
    turned = F.when(F.col("path").endswith(".xlsx"), "landscape").when(F.col("path").endswith(".rtf"), "portrait").when(
        F.col("path").startswith("r/") & (F.try_to_number(F.substring("path", 3, 20), F.lit("99999999999999999999")) % 2 == 0), "landscape"
    ).otherwise("portrait")
    out = G.orientation_split(outputs(spark, d), m, paths.select("path", turned.alias("orientation")), "paragraph", "content")
    return out.select("paragraph", F.array_join("portrait", ",").alias("portrait"), F.array_join("landscape", ",").alias("landscape"), "body")


@query(
    "gen_8_provenance_items",
    f"""with {ITEMS_SQL}
select paragraph, item, 'find ' || item as extract_item, data_type,
  case when data_type in ('word', 'pdf') then 'chunk' when data_type in ('excel', 'rtf') then 'sheet' end as kind,
  case when data_type in ('word', 'pdf') then 'c/' || item || '.json' end as structured_chunks_file, case when data_type in ('word', 'pdf') then 'h1_2' end as section_id,
  case when data_type in ('excel', 'rtf') then 's' || item end as sheet_name, case when data_type in ('excel', 'rtf') then 'm/' || item || '.md' end as markdown_path,
  case when data_type = 'tfl' then '' else 'f' || item || '.docx' end as name, case when data_type = 'tfl' then '' else 'in/f' || item || '.docx' end as path,
  case when data_type in ('word', 'pdf') then 'word' when data_type in ('excel', 'rtf') then 'excel' else data_type end as source_type
from items where ok""",
)
def gen_8(spark, d):
    i = text("item")
    rows = raw_items(spark, d).select(
        "paragraph",
        "item",
        "status",
        "data_type",
        "content",
        F.concat(F.lit("find "), i).alias("extract"),
        F.array(F.concat(F.lit("C:\\AAA\\c\\"), i, F.lit(".json")), F.lit("other")).alias("chunks_files"),
        F.array(F.lit("h1_2"), F.lit("h1_1")).alias("sections"),
        F.array(F.lit("T")).alias("titles"),
        F.array(F.struct(F.concat(F.lit("s"), i).alias("sheet_name"), F.concat(F.lit("AAA/m/"), i, F.lit(".md")).alias("md_file"))).alias("sheets"),
        F.when(F.col("data_type") != "tfl", F.array(F.concat(F.lit("AAA/in/f"), i, F.lit(".docx, b.docx")))).alias("source_files"),
    )
    out = G.provenance_items(rows, ["paragraph", "item", "data_type"])
    return out.select(
        "paragraph",
        "item",
        "extract_item",
        "data_type",
        "used_data.kind",
        "used_data.structured_chunks_file",
        "used_data.section_id",
        "used_data.sheet_name",
        "used_data.markdown_path",
        "data_source.name",
        "data_source.path",
        F.col("data_source.type").alias("source_type"),
    )


def prompt_files(spark, d):
    """Prompt files named by paragraph and type for every third customer, plus the common ones."""
    cust = load(spark, d, "customer")
    c = text("c_custkey")
    own = cust.select(
        F.explode(
            F.array(
                F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("data_extraction_prompt_"), c, F.lit("_word_1.txt"))),
                F.concat(F.lit("generation_prompt_"), c, F.lit("_1.txt")),
                F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("generation_prompt_"), c, F.lit("_2.txt"))),
            )
        ).alias("name")
    ).where("name is not null")
    kinds = raw_items(spark, d).select(F.concat(F.lit("data_extraction_prompt_"), "data_type", F.lit("_9.txt")).alias("name")).distinct()
    return own.unionByName(kinds).withColumn("mtime", F.regexp_extract("name", r"_(\d)\.txt$", 1).cast("int"))


@query(
    "gen_9_item_prompt_files",
    f"""with {ITEMS_SQL}
select paragraph::varchar as paragraph, ord as item_no, data_type as type, case when paragraph % 3 = 0 and data_type = 'word' then 'data_extraction_prompt_' || paragraph || '_word_1.txt' else 'data_extraction_prompt_' || data_type || '_9.txt' end as name,
  case when paragraph % 3 = 0 and data_type = 'word' then 'paragraph' else 'type' end as scope from items""",
)
def gen_9_files(spark, d):
    rows = items(spark, d).select(text("paragraph").alias("paragraph"), F.col("ord").cast("bigint").alias("item_no"), F.col("data_type").alias("type"))
    return G.item_prompt_files(rows, prompt_files(spark, d), "paragraph").select("paragraph", "item_no", "type", "name", "scope")


@query(
    "gen_9_provenance_document",
    f"""with {ITEMS_SQL},
n as (select paragraph, count(*) filter (where data_type = 'tfl') as tfl_items, count(*) filter (where data_type <> 'tfl') as scheme_items from items group by paragraph)
select c_custkey::varchar as paragraph, case when c_custkey % 5 <> 0 then 'success' end as status, case when c_custkey % 5 <> 0 then 'done' else '' end as generated_content, 'write' as generate, c_mktsegment as example,
  'generation_prompt_' || c_custkey || case when c_custkey % 2 = 0 then '_2.txt' else '_1.txt' end as generation_prompt_file, coalesce(scheme_items, 0) as scheme_items, coalesce(tfl_items, 0) as tfl_items
from customer left join n on n.paragraph = c_custkey""",
)
def gen_9(spark, d):
    cust = load(spark, d, "customer")
    configs = cust.select(text("c_custkey").alias("paragraph"), F.lit("write").alias("generate"), F.col("c_mktsegment").alias("example"))
    results = cust.where("c_custkey % 5 <> 0").select(text("c_custkey").alias("paragraph"), F.lit("success").alias("status"), F.lit("done").alias("generated_content"))
    rows = raw_items(spark, d).select(text("paragraph").alias("paragraph"), "data_type")
    return G.provenance_document(configs, results, rows, prompt_files(spark, d), "paragraph")


@query(
    "gen_9_items_with_config",
    f"""with {ITEMS_SQL} select paragraph, ord as item_no, status, case when ord <= 3 then 'cfg ' || ord end as config from (select *, case when ok then 'success' else 'error' end as status from items)""",
)
def gen_9_config(spark, d):
    rows = items(spark, d).select("paragraph", F.col("ord").cast("bigint").alias("item_no"), "status")
    configs = load(spark, d, "customer").select(
        F.col("c_custkey").alias("paragraph"), F.explode(F.expr("sequence(1L, 3L)")).alias("item_no")
    ).withColumn("config", F.concat(F.lit("cfg "), text("item_no")))
    return G.items_with_config(rows, configs, "paragraph").select("paragraph", "item_no", "status", "config")


@query(
    "gen_10_selection_queue",
    f"""with {ITEMS_SQL} select paragraph, item, u.i as candidate_no, 'c' || u.i || '_' || item as candidate from items, (values (0), (1)) u(i) where data_type = 'tfl' and not ok""",
)
def gen_10(spark, d):
    i = text("item")
    rows = raw_items(spark, d).select(
        "paragraph",
        "item",
        F.upper("data_type").alias("data_type"),
        F.when(F.col("status") == "error", "needs_selection").otherwise("success").alias("status"),
        F.array(F.concat(F.lit("c0_"), i), F.concat(F.lit("c1_"), i)).alias("candidates"),
    )
    return G.selection_queue(rows, ["paragraph", "item"]).select("paragraph", "item", *big("candidate_no"), "candidate")


PLAN_SQL = ITEMS_SQL + "," + OUT_SQL + """,
labels as (select c_nationkey as run, item, 'table' as kind, '{{Table_' || (item % 5) || '_Start}}' as s, '{{Table_' || (item % 5) || '_End}}' as e from items join customer on c_custkey = paragraph),
rawout as (select c_nationkey as run, o.paragraph, case when c_nationkey % 4 = 0 then 'none' else o.content end as content from outs o join customer on c_custkey = o.paragraph),
pos as (select run, paragraph, unnest(regexp_extract_all(content, '\\{\\{(?:Table|Image)_\\d+_Start\\}\\}')) as s, generate_subscripts(regexp_extract_all(content, '\\{\\{(?:Table|Image)_\\d+_Start\\}\\}'), 1) - 1 as pos from rawout),
found as (select run, 'table' as kind, s as start, '' as "end", min(paragraph)::bigint as first_seen, arg_min(pos, (paragraph, pos))::bigint as first_pos from pos group by run, s),
plan as (select * from found union all select run, kind, s, e, min(item), 0 from labels where run not in (select run from found) group by run, kind, s, e)"""


def plan(spark, d):
    nation = load(spark, d, "customer").select(F.col("c_custkey").alias("paragraph"), F.col("c_nationkey").alias("run"))
    tag = lambda end: F.concat(F.lit("{{Table_"), (F.col("item") % 5).cast("string"), F.lit(f"_{end}}}}}"))
    labels = raw_items(spark, d).join(nation, "paragraph").select(
        "run", F.col("item").alias("plan_ord"), F.lit("table").alias("kind"), tag("Start").alias("start"), tag("End").alias("end")
    )
    outs = outputs(spark, d).join(nation, "paragraph").select(
        "run", F.col("paragraph").alias("para_ord"), F.when(F.col("run") % 4 == 0, "none").otherwise(F.col("content")).alias("content")
    )
    return G.merged_plan(labels, outs, "run")


@query("gen_11_merged_plan", f"""with {PLAN_SQL} select run, kind, start, "end", first_seen, first_pos from plan""")
def gen_11(spark, d):
    return plan(spark, d)


@query(
    "gen_11_delivery_manifest",
    f"""with {PLAN_SQL} select run, kind, start as id, 'datas/data/index/' || case when run % 2 = 0 then 'd_marked/' else '' end || substr(start, 3, 7) || '.docx' as path, first_seen, first_pos from plan where start <> '{{{{Table_2_Start}}}}'""",
)
def gen_11_manifest(spark, d):
    p = plan(spark, d)
    exported = p.where(F.col("start") != "{{Table_2_Start}}").select(
        "run",
        F.col("start").alias("tag"),
        F.concat(F.when(F.col("run") % 2 == 0, "out/d_marked/").otherwise("out/d/"), F.substring("start", 3, 7), F.lit(".docx")).alias("path"),
    )
    return G.delivery_manifest(p, exported, "run")


@query(
    "gen_11_delivery_files",
    f"""with {TAGS_SQL} select paragraph, ord, case when item % 8 < 4 then placeholder else '{{{{TFL_' || item || '}}}}' end as id, 'datas/data/rtf&index/' || substr(path, 7) as path
from (select paragraph, item, item as ord, '{{{{TFL_t' || (item % 4) || '}}}}' as placeholder, 'AAA/x/' || item || case data_type when 'excel' then '.xlsx' else '.rtf' end as path from items where data_type in ('excel', 'rtf')) where item % 3 <> 0""",
)
def gen_11_files(spark, d):
    tags = file_tags(spark, d).withColumn("placeholder", F.when(F.col("ord") % 8 < 4, F.col("placeholder")).otherwise(F.lit(" ")))
    known = file_tags(spark, d).where("ord % 3 <> 0").select("path")
    return G.delivery_files(tags, known, "paragraph")


@query(
    "gen_12_result_payloads",
    """select c_custkey as paragraph, case when c_custkey % 5 = 0 then '生成失败' else '生成完毕' end as label, 'text of ' || c_name as generated_content, case when c_custkey % 3 = 0 then 1 else 0 end as traced, c_custkey % 5 <> 0 as success from customer""",
)
def gen_12(spark, d):
    paras = generated(spark, d).select(
        "paragraph", F.col("content").alias("generated_content"), F.when(F.col("paragraph") % 5 == 0, "error").when(F.col("paragraph") % 2 == 0, "success").alias("status")
    )
    traced = generated(spark, d).where("paragraph % 3 = 0").select("paragraph", F.array(F.concat(F.lit("item of "), text("paragraph"))).alias("extracted_items"))
    out = G.result_payloads(paras, traced, "paragraph")
    return out.select(
        "paragraph",
        "label",
        F.get_json_object("payload", "$.generated_content").alias("generated_content"),
        F.size(F.from_json(F.get_json_object("payload", "$.extracted_items"), "array<string>")).cast("bigint").alias("traced"),
        (F.get_json_object("payload", "$.success") == "true").alias("success"),
    )


@query(
    "gen_13_insertion_rows",
    """select c_custkey, 0 as pos, 'P' || c_custkey as control_title, 'a {{X}} b {{Y}}' as generated_content, '{{X}}' as placeholders from customer
union all select c_custkey, 2, 'T', '', '' from customer""",
)
def gen_13(spark, d):
    c = text("c_custkey")
    rows = F.concat(
        F.lit('[{"paragraph_id": "P'), c, F.lit('", "content": "a {{X}} b {{Y}}"}, {"paragraph_id": "Q", "status": "error"}, {"paragraph_id": "R", "control_title": "T", "status": "success"}]')
    )
    name = F.when(F.col("c_custkey") % 2 == 0, '"generation_results": ').otherwise('"generation_results": [], "paragraphs": ')
    js = F.concat(F.lit("{"), name, rows, F.lit(', "resource_mappings": {"{{X}}": {"path": "p"}}}'))
    return G.insertion_rows(load(spark, d, "customer").select("c_custkey", js.alias("j")), "c_custkey", "j").select(
        "c_custkey", *big("pos"), "control_title", "generated_content", F.array_join("placeholders", ",").alias("placeholders")
    )


@query(
    "gen_14_extraction_resources",
    f"""with {TAGS_SQL} select paragraph, placeholder, arg_max(path, ord) as path, case when arg_max(path, ord) like '%.xlsx' then 'excel' else 'table' end as type, arg_max(source, ord) as source_file from tags group by paragraph, placeholder""",
)
def gen_14(spark, d):
    return G.extraction_resources(file_tags(spark, d), ["paragraph"])


@query(
    "src_9_extracted_data_text",
    f"""with {ITEMS_SQL} select paragraph, (ord - 1) // 512 as part, string_agg('[' || data_type || '] ' || case when ok then 'success' else 'error' end, chr(10) order by ord) as line from items group by paragraph, (ord - 1) // 512""",
)
def src_9_extracted(spark, d):
    rows = items(spark, d).withColumn("line", F.concat(F.lit("["), "data_type", F.lit("] "), "status"))
    return join_parts(rows, ["paragraph"], "ord", "line", "\n").withColumn("part", F.col("part").cast("bigint"))
