"""Queries of the source, sink and allocation families."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions.ordered import bucketed_rank
from leafmill.operators import allocate as A
from leafmill.operators.model import retry_until_parsed
from leafmill.operators.responses import parse_responses
from leafmill.plans.family import family
from leafmill.plans.recipes import load
from leafmill.session import shared_dir
from leafmill.sources import config as C
from leafmill.sources import files as FS
from leafmill.sources import packages as P
from leafmill.sources.commits import CommittedTable

QUERIES, SQL, query = family()


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def text(c):
    return F.col(c).cast("string")


# --- file manifests and text documents -------------------------------------------------


@query(
    "src_1_file_manifest",
    """select doc_id, case doc_id % 5 when 1 then 'doc' || doc_id || '.txt' when 2 then 'doc' || doc_id || '.txt' else 'doc' || doc_id || '.txt' end as name,
  case doc_id % 5 when 1 then 'f' || doc_id when 2 then 'g' || doc_id end as file_id,
  case when doc_id % 7 = 0 then '' else sha256(text) end as sha256
from documents where doc_id % 5 <> 4""",
)
def src_1(spark, d):
    docs = load(spark, d, "documents")
    name = F.concat(F.lit("doc"), text("doc_id"), F.lit(".txt"))
    k = F.col("doc_id") % 5
    item = (
        F.when(k == 1, F.format_string('{"filename": "%s", "id": "f%d"}', name, "doc_id"))
        .when(k == 2, F.format_string('{"name": "%s", "file_id": "g%d"}', name, "doc_id"))
        .when(k == 4, F.lit("17"))
        .otherwise(F.format_string('"%s"', name))
    )
    items = FS.file_items(docs.select("doc_id", item.alias("item")), "item")
    contents = docs.where(F.col("doc_id") % 7 != 0).select(name.alias("name"), F.encode("text", "UTF-8").alias("content"))
    return FS.hash_items(items, contents).select("doc_id", "name", "file_id", "sha256")


@query(
    "src_1_binary_manifest",
    """select coalesce(source, '') || '/' || doc_id % 40 as file, sum(strlen(coalesce(text, '')) + 1)::bigint as length, sha256(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as sha256
from documents group by 1""",
)
def src_1_binary(spark, d):
    """The texts of a source and a remainder of the id make one file; files above 64 KiB are streamed."""
    docs = load(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value"), F.coalesce("source", F.lit("")).alias("s"), (F.col("doc_id") % 40).alias("k"), "doc_id")
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    named = docs.select("value", "doc_id", F.concat("s", F.lit("~"), "k").alias("name"))
    named.repartition("name").sortWithinPartitions("name", "doc_id").drop("doc_id").write.partitionBy("name").text(folder)
    found = FS.binary_manifest(spark, folder, "*.txt", 64 << 10)
    file = F.translate(F.url_decode(F.regexp_extract("path", "/name=([^/]*)/", 1)), "~", "/")
    return found.select(file.alias("file"), "length", "sha256")


@query("src_1_table_files")
def src_1_tables(spark, d):
    """The files of the tables themselves; their listing is not known to SQL."""
    return FS.binary_manifest(spark, d, "*.parquet").select("name", "length", "sha256")


@query(
    "src_2_text_documents",
    """select 'in/doc' || doc_id || case when doc_id % 3 = 0 then '.log' else '' end as path, 'doc' || doc_id as name,
  'PLAIN_TEXT' as content_type, text, 'fallback_text' as method from documents where doc_id % 3 <> 1""",
)
def src_2(spark, d):
    k = F.col("doc_id") % 3
    end = F.when(k == 0, ".log").when(k == 1, ".DOCX").otherwise("")
    files = load(spark, d, "documents").select(
        F.concat(F.lit("in/doc"), text("doc_id"), end).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return FS.text_documents(files)


@query(
    "src_3_type_routing",
    """with f as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
   case l_returnflag when 'A' then case when l_linenumber % 2 = 0 then 'DOCX' else 'doc' end when 'N' then case when l_linenumber % 2 = 0 then 'xls' else 'xlsx' end
     else case l_linenumber % 3 when 0 then 'rtf' when 1 then 'Pdf' else 'csv' end end as sfx from lineitem),
g as (select *, case lower(sfx) when 'docx' then 'docx' when 'doc' then 'doc' when 'rtf' then 'rtf' when 'xlsx' then 'xlsx' when 'xls' then 'xlsx' when 'pdf' then 'pdf' else 'unknown' end as file_type from f),
h as (select *, case file_type when 'docx' then 'word' when 'doc' then 'word' when 'xlsx' then 'excel' else file_type end as family from g)
select file_type, family, case when family in ('word', 'pdf', 'excel', 'rtf') then 'ok' else 'error' end as status, count(*) as files from h group by all""",
)
def src_3(spark, d):
    n = F.col("l_linenumber")
    sfx = (
        F.when(F.col("l_returnflag") == "A", F.when(n % 2 == 0, "DOCX").otherwise("doc"))
        .when(F.col("l_returnflag") == "N", F.when(n % 2 == 0, "xls").otherwise("xlsx"))
        .otherwise(F.when(n % 3 == 0, "rtf").when(n % 3 == 1, "Pdf").otherwise("csv"))
    )
    files = load(spark, d, "lineitem").select(F.concat(F.lit("a\\b/f"), text("l_orderkey"), F.lit("."), sfx).alias("path"))
    return FS.route(files).groupBy("file_type", "family", "status").agg(F.count(F.lit(1)).alias("files"))


# --- paragraph configs and job specs ----------------------------------------------------


def configs(spark, d):
    """One JSON configuration per order: two paragraphs, the first with two items."""
    p = F.col("o_orderpriority")
    flag = F.when(p.startswith("1"), 'true').when(p.startswith("2"), '" TRUE "').when(p.startswith("3"), '"no"').otherwise("false")
    mode = (
        F.when(F.col("o_orderstatus") == "O", '"original_mode": "true", ')
        .when(F.col("o_orderstatus") == "F", '"options": " 原文 ", ')
        .otherwise('"original_mode": null, "options": "原文", ')
    )
    js = F.concat(
        F.lit('{"paragraphs": [{"id": "P'),
        text("o_orderkey"),
        F.lit('", "generate": "write", "data": [{"extract": "total", "datas": ["a'),
        text("o_custkey"),
        F.lit('.docx", {"file": "b.xlsx"}], '),
        mode,
        F.lit('"insert_original": '),
        flag,
        F.lit('}, {"extract": "status", "datas": [], "quote": "'),
        F.col("o_orderstatus"),
        F.lit('"}]}, {"id": "Q'),
        text("o_orderkey"),
        F.lit('", "example": "e", "data": []}]}'),
    )
    return load(spark, d, "orders").select("o_orderkey", js.alias("config"))


@query(
    "src_4_paragraph_items",
    """with o as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders)
select o_orderkey, 0 as para_no, 'P' || o_orderkey as paragraph_id, 'write' as generate, null as example, 0 as item_no, 'total' as extract,
  o_orderstatus in ('O', 'F') as original_mode, o_orderpriority[1] in ('1', '2') as insert_original, null as quote, 2 as files from o
union all
select o_orderkey, 0, 'P' || o_orderkey, 'write', null, 1, 'status', false, false, o_orderstatus, 0 from o
union all
select o_orderkey, 1, 'Q' || o_orderkey, '', 'e', null, null, false, false, null, 0 from o""",
)
def src_4(spark, d):
    return C.paragraph_items(configs(spark, d), "o_orderkey", "config").select(
        "o_orderkey",
        *big("para_no", "item_no"),
        "paragraph_id",
        "generate",
        "example",
        "extract",
        "original_mode",
        "insert_original",
        "quote",
        F.coalesce(F.size("datas"), F.lit(0)).cast("bigint").alias("files"),
    )


@query(
    "src_4_paragraphs",
    """select o_orderkey, 0 as para_no, 'P' || o_orderkey as paragraph_id, 2 as items, o_orderpriority[1] in ('1', '2') as insert_original from orders
union all select o_orderkey, 1, 'Q' || o_orderkey, 0, false from orders""",
)
def src_4_paragraphs(spark, d):
    return C.paragraphs(configs(spark, d), "o_orderkey", "config").select(
        "o_orderkey", *big("para_no", "items"), "paragraph_id", "insert_original"
    )


@query(
    "src_4_item_files",
    """select o_orderkey, 0 as file_no, 'a' || o_custkey || '.docx' as file from orders
union all select o_orderkey, 1, 'b.xlsx' from orders""",
)
def src_4_files(spark, d):
    items = C.paragraph_items(configs(spark, d), "o_orderkey", "config")
    return C.item_files(items, ["o_orderkey", "item_no"]).select("o_orderkey", *big("file_no"), "file")


@query(
    "src_5_job_tasks",
    """with s as (select s_suppkey, s_nationkey, s_name from supplier)
select s_suppkey, 'word' as file_type, 0 as item_no, s_name as group_name, false as force_ocr, 900 + s_nationkey as chunk_max_chars,
  600 as chunk_min_chars, null as content_type, 0 as path_no, 'in/' || s_suppkey || '.docx' as file_path from s
union all
select s_suppkey, 'pdf', 0, '未命名', true, 700, null, 'txt', u.i, 'in/' || s_suppkey || '_' || u.i || '.pdf' from s, (values (0), (1)) u(i)""",
)
def src_5(spark, d):
    key = text("s_suppkey")
    spec = F.concat(
        F.lit('{"config": {"chunk_max_chars": '),
        (F.col("s_nationkey") + 900).cast("string"),
        F.lit('}, "word": {"data": [{"name": "'),
        F.col("s_name"),
        F.lit('", "path": "in/'),
        key,
        F.lit('.docx"}, {"name": "none", "path": []}]}, "pdf": {"data": [{"path": ["in/'),
        key,
        F.lit('_0.pdf", "in/'),
        key,
        F.lit('_1.pdf"], "type": "txt", "force_ocr": true, "chunk_max_chars": 700, "chunk_min_chars": null}]}, "rtf": 5}'),
    )
    return C.job_tasks(load(spark, d, "supplier").select("s_suppkey", spec.alias("spec")), "s_suppkey", "spec").select(
        "s_suppkey",
        "file_type",
        *big("item_no", "chunk_max_chars", "chunk_min_chars", "path_no"),
        "group_name",
        "force_ocr",
        "content_type",
        "file_path",
    )


# --- chunk corpora ------------------------------------------------------------------------


def corpora(spark, d):
    """JSON chunk files: current form for most documents, the legacy form for every third."""
    ls = F.split("text", "\n", -1)
    current = F.to_json(
        F.struct(
            F.lit("f").alias("file_name"),
            F.transform(
                ls,
                lambda x, i: F.struct(
                    F.concat(F.lit("h1_"), (i + 1).cast("string")).alias("section_id"),
                    F.concat(F.lit("line "), (i + 1).cast("string")).alias("title"),
                    x.alias("content"),
                    F.lit("").alias("summary"),
                ),
            ).alias("sections"),
        )
    )
    legacy = F.to_json(
        F.struct(
            F.lit("t").alias("title"),
            F.transform(
                ls,
                lambda x, i: F.struct(
                    F.when(i % 4 == 0, F.concat(F.lit("c_"), i.cast("string"))).alias("chunk_id"),
                    F.when(i % 4 <= 1, F.concat(F.lit("i_"), i.cast("string"))).alias("id"),
                    F.when(i % 4 == 2, F.concat(F.lit("s_"), i.cast("string"))).alias("section_id"),
                    F.when(i % 2 == 0, x).alias("content"),
                    F.when(i % 2 == 1, x).alias("text"),
                ),
            ).alias("chunks"),
        )
    )
    return load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, legacy).otherwise(current).alias("corpus"))


CORPUS_SQL = """
x as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as ord from documents),
corpus as (select doc_id, ord, content, case when doc_id % 3 = 0 then 'chunks' else 'sections' end as generation,
  case when doc_id % 3 <> 0 then 'h1_' || ord else case (ord - 1) % 4 when 0 then 'c_' || (ord - 1) when 1 then 'i_' || (ord - 1) when 2 then 's_' || (ord - 1) else ord::varchar end end as section_id,
  case when doc_id % 3 <> 0 then 'line ' || ord end as title from x)"""


@query("src_6_chunk_corpora", f"with {CORPUS_SQL} select doc_id, generation, ord, section_id, title, content from corpus")
def src_6(spark, d):
    return C.corpus_chunks(corpora(spark, d), "doc_id", "corpus").select(
        "doc_id", "generation", *big("ord"), "section_id", "title", "content"
    )


# --- packages, logs, run outputs -----------------------------------------------------------


def package_rows(spark, d):
    i = text("doc_id")
    kind = F.when(F.col("doc_id") % 4 == 0, "docx").when(F.col("doc_id") % 4 == 1, "pdf").when(F.col("doc_id") % 4 == 2, "xlsx").otherwise("unknown")
    region = F.array(
        F.struct(
            F.concat(F.lit("Table_"), i).alias("label"), F.concat(F.lit("r/"), i).alias("path"), F.lit("m.md").alias("markdown_path"), F.col("n_chars").alias("extra")
        )
    )
    return load(spark, d, "documents").select(
        F.concat(F.lit("in/"), i).alias("source_file"),
        kind.alias("file_type"),
        F.lit("word").alias("content_type"),
        F.col("text").alias("text_content"),
        F.col("text").alias("markdown_content"),
        region.alias("regions"),
        F.array(F.lit("a.png")).alias("assets"),
        F.create_map(F.lit("sheets_total"), text("n_chars"), F.lit("private"), F.lit("x"), F.lit("original_file"), i).alias("info"),
        F.when(F.col("lang") == "en", F.col("source")).otherwise(F.lit("")).alias("structured_data"),
        F.concat(F.lit("c/"), i, F.lit(".json")).alias("chunks_file"),
    )


@query(
    "src_7_packages",
    """with p as (select *, case doc_id % 4 when 0 then 'docx' when 1 then 'pdf' when 2 then 'xlsx' else 'unknown' end as ft from documents)
select 'in/' || doc_id as source_file, ft as file_type, case when ft in ('docx', 'pdf') then text end as text_content,
  'Table_' || doc_id || '>r/' || doc_id || '>m.md' || case when ft <> 'xlsx' then '>' || n_chars else '' end as regions,
  case when ft <> 'xlsx' then 'a.png' end as assets,
  case when ft = 'xlsx' then 'extract_assets=false,extract_regions=false,markdown_files=[],original_file=' || doc_id || ',processing_time=0.0,sheets_total=' || n_chars
    else 'original_file=' || doc_id || ',private=x,sheets_total=' || n_chars end as info,
  case when lang = 'en' then source end as structured_data,
  case when doc_id % 2 = 0 then 'c/' || doc_id || '.json' end as chunks_file from p""",
)
def src_7(spark, d):
    chunk_files = load(spark, d, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("c/"), text("doc_id"), F.lit(".json")).alias("path"))
    p = P.package_table(package_rows(spark, d), chunk_files)
    pairs = F.transform(F.sort_array(F.map_entries("info")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.select(
        "source_file",
        "file_type",
        "text_content",
        F.array_join(F.transform("regions", lambda r: F.concat_ws(">", r["label"], r["path"], r["markdown_path"], r["extra"].cast("string"))), ";").alias("regions"),
        F.array_join("assets", ",").alias("assets"),
        F.array_join(pairs, ",").alias("info"),
        "structured_data",
        "chunks_file",
    )


def log_rows(spark, d):
    bad = F.col("event_type") == "error"
    return load(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(bad, "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO").alias("level"),
        F.concat(F.lit("event "), text("event_id")).alias("message"),
        F.concat(F.lit("task"), text("user_id")).alias("logger"),
        F.when(bad, F.struct(F.lit("ValueError").alias("type"), F.concat(F.lit("bad "), text("event_id")).alias("message"), F.lit("tb").alias("traceback"))).alias("error"),
        F.from_json("props", "map<string,string>").alias("extra"),
    )


@query(
    "src_8_task_log",
    """select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp,
  case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' else 'INFO' end as level,
  'event ' || event_id || case when event_type = 'error' then ' | ValueError: bad ' || event_id else '' end as message,
  'task' || user_id as logger, case when event_type = 'error' then 'ValueError' end as error_type, json_extract_string(props, '$.k') as k from events""",
)
def src_8(spark, d):
    return C.parse_log(C.log_lines(log_rows(spark, d))).select(
        "timestamp", "level", "message", "logger", F.col("error.type").alias("error_type"), F.col("extra")["k"].alias("k")
    )


def order_results(spark, d):
    """Results of a run: a customer is the run, an order is a paragraph."""
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return bucketed_rank(orders, ["o_custkey"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 100000))


@query(
    "src_9_run_text",
    """with r as (select *, row_number() over (partition by o_custkey order by o_orderkey) as ord from orders)
select o_custkey, (ord - 1) // 512 as part, string_agg('=== 段落ID: ' || o_orderkey || ' ===' || chr(10) || o_orderpriority || chr(10), chr(10) order by ord) as text
from r group by o_custkey, (ord - 1) // 512""",
)
def src_9(spark, d):
    return P.paragraph_text(order_results(spark, d), "o_custkey", "ord", "o_orderkey", "o_orderpriority").withColumn(
        "part", F.col("part").cast("bigint")
    )


@query(
    "src_9_run_summary",
    """select o_custkey, count(*) as total, count(*) filter (where o_orderstatus = 'F') as success, bool_or(o_orderstatus = 'P') as needs_selection
from orders group by o_custkey""",
)
def src_9_summary(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "needs_selection").otherwise("error")
    return P.run_summary(load(spark, d, "orders").select("o_custkey", state.alias("status")), "o_custkey")


@query(
    "src_9_rewritten_runs",
    """select o_custkey, o_orderkey, case when o_custkey % 2 = 0 then o_orderstatus else 'old' end as status from orders""",
)
def src_9_rewritten(spark, d):
    """All runs (customers) in a first batch, half of them again in a second one, which is written twice."""
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    bucket = lambda df: df.withColumn("run", F.col("o_custkey") % 16)
    first, second = bucket(rows.withColumn("status", F.lit("old"))), bucket(rows.where("o_custkey % 2 = 0"))
    table = CommittedTable(spark, folder, first.schema)
    for batch, part in (("first", first), ("second", second), ("second", second)):
        table.write(part, batch, ["run"])
    return table.newest_rows(["o_custkey"]).select("o_custkey", "o_orderkey", "status")


@query(
    "src_10_prompt_templates",
    """select 't' || item_id as template_id, case when item_id % 3 = 0 then text else 'head' || chr(10) || chr(10) || text || chr(10) || chr(10) || '{content}' end as template from benchmark""",
)
def src_10(spark, d):
    reg = load(spark, d, "benchmark").select(
        F.concat(F.lit("t"), text("item_id")).alias("template_id"),
        F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.lit("")).alias("body"),
        F.create_map(
            F.lit("content"), F.lit("{content}"), F.lit("extraction_requirements"), F.col("text"), F.lit("footer"), F.lit(""), F.lit("header"), F.lit("head")
        ).alias("parts"),
    )
    return FS.template_table(reg)


# --- allocation ------------------------------------------------------------------------------


def requests(spark, d):
    """One request per supplier: a nation's tag, an item with five candidates, an item without a rule."""
    key = F.col("s_suppkey")
    s = lambda n: (key + n).cast("string")
    js = F.concat(
        F.lit('[{"tagId": "'),
        F.when(F.col("s_nationkey") % 5 == 0, F.lit("")).otherwise(text("s_nationkey")),
        F.lit('", "data": [{"id": "i'),
        text("s_suppkey"),
        F.lit('", "first_match_logic": "rule", "source_full_file": [{"fileName": "f'),
        s(2),
        F.lit('"}, "f'),
        s(0),
        F.lit('", " ", {"fileName": "f'),
        s(1),
        F.lit('"}, "f'),
        s(0),
        F.lit('", "f'),
        s(3),
        F.lit('"]}, {"id": "j'),
        text("s_suppkey"),
        F.lit('", "first_match_logic": " ", "source_full_file": ["f"]}]}, null]'),
    )
    return load(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", js.alias("request"))


@query(
    "alc_1_request_items",
    """select s_suppkey, 0 as item_no, case when s_nationkey % 5 = 0 then 'unknown' else s_nationkey::varchar end as tag, 'i' || s_suppkey as item_id, 'rule' as rule,
  'f' || (s_suppkey + 2) || ',f' || s_suppkey || ',f' || (s_suppkey + 1) || ',f' || s_suppkey || ',f' || (s_suppkey + 3) as candidates, true as needs_match from supplier
union all
select s_suppkey, 1, case when s_nationkey % 5 = 0 then 'unknown' else s_nationkey::varchar end, 'j' || s_suppkey, ' ', 'f', false from supplier""",
)
def alc_1(spark, d):
    return A.flatten_requests(requests(spark, d), "s_suppkey", "request").select(
        "s_suppkey", *big("item_no"), "tag", "item_id", "rule", F.array_join("candidates", ",").alias("candidates"), "needs_match"
    )


def _matches(spark, d):
    items = A.flatten_requests(requests(spark, d), "s_suppkey", "request")
    s = lambda n: F.concat(F.lit("f"), (F.col("s_suppkey") + n).cast("string"))
    answer = F.when(F.col("s_suppkey") % 4 != 0, F.array(s(0), F.lit("nobody"), s(2), s(0)))
    return items.withColumn("matched", F.when(F.col("needs_match"), A.restrict_matches(F.col("candidates"), answer)).otherwise(F.array().cast("array<string>")))


@query(
    "alc_2_matched_files",
    """select s_suppkey, 'i' || s_suppkey as item_id, case when s_suppkey % 4 = 0 then '' else 'f' || (s_suppkey + 2) || ',f' || s_suppkey end as matched from supplier
union all select s_suppkey, 'j' || s_suppkey, '' from supplier""",
)
def alc_2(spark, d):
    return _matches(spark, d).select("s_suppkey", "item_id", F.array_join("matched", ",").alias("matched"))


@query(
    "alc_2_allocation_run",
    """select s_suppkey, 'i' || s_suppkey as item_id, case when s_suppkey % 5 >= 3 then '' else 'f' || (s_suppkey + 2) || ',f' || s_suppkey end as matched from supplier""",
)
def alc_2_run(spark, d):
    """The whole path: prompt, answer, parse with up to three attempts, restrict to the candidates.

    The stand-in answers wrongly on the first (suppkey mod 5) attempts.
    """
    asked = (
        A.flatten_requests(requests(spark, d), "s_suppkey", "request")
        .where("needs_match")
        .select("s_suppkey", "item_id", "candidates", F.concat("rule", F.lit("\n"), F.array_join("candidates", "\n")).alias("prompt"))
    )

    def ask(pending, attempt):
        answer = F.concat(
            F.lit('```json\n{"Compliant": ["nobody", "f'), text("s_suppkey"), F.lit('", "f'), (F.col("s_suppkey") + 2).cast("string"), F.lit('"],}\n```')
        )
        return pending.withColumn("output", F.when(F.col("s_suppkey") % 5 < attempt, answer).otherwise(F.lit("no idea")))

    last_chance = 3
    answered = retry_until_parsed(asked, "item_id", ask, lambda a: parse_responses(a, "output", strong=True), last_chance)
    names = F.from_json(F.get_json_object("json", "$.Compliant"), "array<string>")
    return answered.select("s_suppkey", "item_id", F.array_join(A.restrict_matches(F.col("candidates"), names), ",").alias("matched"))


@query(
    "alc_3_rules_and_files",
    """select p_partkey, case p_partkey % 5 when 0 then 'flat' when 1 then 'FLAT' when 2 then 'cat' when 3 then 'named' else '' end as rules,
  case p_partkey % 5 when 0 then 'a' || p_partkey || ',b' when 1 then 'one' when 2 then 'c' || p_partkey when 3 then 'n1,n2' else '' end as files from part""",
)
def alc_3(spark, d):
    k = F.col("p_partkey") % 5
    key = text("p_partkey")
    spec = (
        F.when(k == 0, F.concat(F.lit('{"rules": "flat", "files": ["a'), key, F.lit('", "b"]}')))
        .when(k == 1, F.lit('{"Rules": "FLAT", "file": "one", "categories": [{"files": ["x"]}]}'))
        .when(k == 2, F.concat(F.lit('{"rules": "outer", "categories": [{"rules": "cat", "file": "c'), key, F.lit('"}, {"files": ["y"]}]}')))
        .when(k == 3, F.lit('{"rules": "outer", "files": [], "name": {"first": {"rules": "named", "files": ["n1", "n2"]}}}'))
        .otherwise(F.lit('{"other": 1}'))
    )
    rules, files = A.rules_and_files(F.col("spec"))
    return load(spark, d, "part").select("p_partkey", spec.alias("spec")).select(
        "p_partkey", rules.alias("rules"), F.array_join(files, ",").alias("files")
    )


@query(
    "alc_4_compliance_split",
    """select p_partkey, 'f0,f1' as compliant, 'f' || (2 + p_size % 3) as checked, 'f' || (2 + p_size % 3) || '=' || case when p_size % 2 = 0 then '' else 'size' end as reasons from part""",
)
def alc_4(spark, d):
    other = F.concat(F.lit("f"), (2 + F.col("p_size") % 3).cast("string"))
    rows = load(spark, d, "part").select(
        "p_partkey",
        F.array(*[F.lit(f"f{i}") for i in range(5)]).alias("files"),
        F.array(F.lit("f0"), F.lit("nobody"), F.lit("f1")).alias("compliant"),
        F.array(F.lit("f1"), other, F.lit("ghost")).alias("checks"),
        F.create_map(other, F.when(F.col("p_size") % 2 != 0, "size"), F.lit("ghost"), F.lit("x"), F.lit("f0"), F.lit("y")).alias("reasons"),
    )
    out = A.compliance_split(rows, "files", "compliant", "checks", "reasons")
    shown = F.transform(F.map_entries("check_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select(
        "p_partkey",
        F.array_join("compliant_files", ",").alias("compliant"),
        F.array_join("check_files", ",").alias("checked"),
        F.array_join(shown, ",").alias("reasons"),
    )


@query(
    "alc_5_match_rates",
    """select case when s_nationkey % 5 = 0 then 'unknown' else s_nationkey::varchar end as tag, case when grouping(case when s_nationkey % 5 = 0 then 'unknown' else s_nationkey::varchar end) = 0 then 'category' else 'total' end as grain, sum(6)::bigint as total_files,
  sum(case when s_suppkey % 4 = 0 then 0 else 2 end)::bigint as matched_files,
  printf('%.2f%%', sum(case when s_suppkey % 4 = 0 then 0 else 2 end) * 100.0::double / sum(6)) as match_rate
from supplier group by rollup(case when s_nationkey % 5 = 0 then 'unknown' else s_nationkey::varchar end)""",
)
def alc_5(spark, d):
    return A.match_rates(_matches(spark, d), "tag", F.size("candidates"), F.size("matched")).select(
        "tag", "grain", *big("total_files", "matched_files"), "match_rate"
    )


@query(
    "alc_5_pass_rates",
    """select p_brand as category, case when grouping(p_brand) = 0 then 'category' else 'total' end as grain, count(*) as total, count(*) filter (where p_size % 4 = 0) as passed, printf('%.2f%%', count(*) filter (where p_size % 4 = 0) * 100.0::double / count(*)) as pass_rate from part group by rollup(p_brand)""",
)
def alc_5_pass(spark, d):
    checks = F.when(F.col("p_size") % 4 != 0, F.array(F.lit("f1"))).otherwise(F.array().cast("array<string>"))
    rows = load(spark, d, "part").select(F.col("p_brand").alias("category"), checks.alias("check_files"))
    return A.pass_rates(rows, "category", "check_files")
