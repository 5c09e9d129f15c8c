"""Queries of the extraction family (model outputs are data or the offline backend)."""
from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from leafmill.operators import judge as J
from leafmill.operators import model as M
from leafmill.operators import prompts as PR
from leafmill.operators import responses as RS
from leafmill.operators import rollup as RU
from leafmill.operators import select as SE
from leafmill.operators.answers import AnswerStore, ask_once
from leafmill.operators.sections import chunk_catalogue, section_table
from leafmill.plans.catalogue import MATCH_SQL, matches
from leafmill.plans.family import family
from leafmill.plans.recipes import MD_SQL, load, md_docs
from leafmill.plans.sources import CORPUS_SQL, corpora
from leafmill.plans.text import SECTIONS_SQL
from leafmill.sources.config import CORPUS

QUERIES, SQL, query = family()


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def text(c):
    return F.col(c).cast("string")


def sections(spark, d):
    return section_table(md_docs(spark, d), "doc_id", "md")


@query(
    "ext_1_prompts",
    f"""with {SECTIONS_SQL},
p as (select s.doc_id, s.section_id, b.text as t, s.title, s.content, s.wc from (select doc_id, 'h1_' || ord as section_id, title, content, length(content) as wc from secs) s
  left join benchmark b on b.item_id = s.doc_id % (select count(*) from benchmark))
select doc_id, section_id, case when t is null then '' else replace(replace(
   t || chr(10) || title || ' / ' || content || ' ', '{{{{', '{{'), '}}}}', '}}') || wc || ' 项目 {{}}' end as prompt from p""",
)
def ext_1(spark, d):
    templates = load(spark, d, "benchmark").select(
        F.concat(F.lit("t"), text("item_id")).alias("template_id"),
        F.concat("text", F.lit("\n{{title}} / {{ content }} {{none}}{word_count} {project_desc} {{{{x}}}}")).alias("template"),
    )
    n = load(spark, d, "benchmark").count()
    rows = sections(spark, d).withColumn("template_id", F.concat(F.lit("t"), (F.col("doc_id") % n).cast("string")))
    return PR.build_prompts(rows, templates, ["title", "content", "word_count"], "项目").select("doc_id", "section_id", "prompt")


@query(
    "ext_2_chunk_catalogue",
    f"""with {SECTIONS_SQL}
select doc_id, string_agg('【分块 h1_' || ord || '】' || chr(10) || case when title <> '' then '标题: ' || title || chr(10) else '' end || '摘要: ' || summary || chr(10), chr(10) order by ord) as catalogue
from section_table group by doc_id""",
)
def ext_2(spark, d):
    return chunk_catalogue(md_docs(spark, d), "doc_id", "md")


@query(
    "ext_3_model_column",
    "select distinct sha256(text) as prompt_hash, 'extraction:' || md5(text) as output from documents",
)
def ext_3(spark, d):
    return M.model_column(load(spark, d, "documents"), "text")


class Signed:
    """Answers with a digest of the prompt, signed, so that a row shows which run asked."""

    def __init__(self, name):
        self.name = name

    def generate(self, prompts, task):
        return [f"{self.name}:{hashlib.md5(p.encode()).hexdigest()}" for p in prompts]


@query(
    "ext_3_answer_store",
    "select sha256(text) as prompt_hash, case when bool_or(lang = 'en') then 'first:' else 'second:' end || md5(text) as output from documents group by text",
)
def ext_3_store(spark, d):
    """A first run asks for the English documents, a second for all: it finds those answers in the store."""
    docs = load(spark, d, "documents")
    store = AnswerStore(spark, buckets=16)
    ask_once(docs.where("lang = 'en'"), store, "text", backend=Signed("first"), batch_size=50)
    return ask_once(docs, store, "text", backend=Signed("second"), batch_size=50)


def responses(spark, d):
    """Relevance answers in five disguises: plain, fenced, inside prose, trailing comma, cut off."""
    i = text("doc_id")
    body = F.concat(
        F.lit('{"n": '), i, F.lit(', "relevant_sections": [{"section_id": "h1_2", "relevance_score": 0.5, "reason": "a } b"}, {"chunk_id": " h1_1 ", "relevance_score": 1}')
    )
    full = F.concat(body, F.lit("]}"))
    k = F.col("doc_id") % 5
    return load(spark, d, "documents").select(
        "doc_id",
        F.when(k == 0, full)
        .when(k == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Sure: "), full, F.lit(" as asked")))
        .when(k == 3, F.concat(F.lit("/* note */ "), body, F.lit(",],}")))
        .otherwise(body)
        .alias("output"),
    )


@query(
    "ext_4_basic_cascade",
    """select doc_id, case doc_id % 5 when 0 then 'whole' when 1 then 'json_fence' when 2 then 'object' end as step, case when doc_id % 5 < 3 then doc_id end as n from documents""",
)
def ext_4(spark, d):
    return RS.parse_responses(responses(spark, d), "output").select(
        "doc_id", "step", F.get_json_object("json", "$.n").cast("bigint").alias("n")
    )


@query(
    "ext_4_strong_cascade",
    """select doc_id, case doc_id % 5 when 0 then 'clean' when 1 then 'clean' when 2 then 'balanced' when 3 then 'balanced_commas' else 'closed' end as step, doc_id as n from documents""",
)
def ext_4_strong(spark, d):
    return RS.parse_responses(responses(spark, d), "output", strong=True).select(
        "doc_id", "step", F.get_json_object("json", "$.n").cast("bigint").alias("n")
    )


@query(
    "ext_4_step_counts",
    """select coalesce(case doc_id % 5 when 0 then 'whole' when 1 then 'json_fence' when 2 then 'object' end, 'rejected') as step, count(*) as responses from documents group by 1""",
)
def ext_4_counts(spark, d):
    return RS.step_counts(RS.parse_responses(responses(spark, d), "output"))


@query(
    "ext_5_retry_until_parsed",
    """select doc_id, least(n_chars % 4 + 1, 3) as attempt, case when n_chars % 4 < 3 then doc_id end as n from documents""",
)
def ext_5(spark, d):
    """An answer is readable only from attempt (n_chars mod 4) + 1 on."""
    docs = load(spark, d, "documents").select("doc_id", "n_chars")

    def ask(pending, attempt):
        answer = F.concat(F.lit('{"n": '), text("doc_id"), F.lit("}"))
        return pending.withColumn("output", F.when(F.col("n_chars") % 4 < attempt, answer).otherwise(F.lit("not yet {")))

    out = M.retry_until_parsed(docs, "doc_id", ask, lambda a: RS.parse_responses(a, "output"))
    return out.select("doc_id", *big("attempt"), F.get_json_object("json", "$.n").cast("bigint").alias("n"))


@query(
    "ext_6_relevant_chunks",
    """select doc_id, 1 as rel_ord, 'h1_2' as wanted, 0.5::double as score, 'a } b' as reason from documents
union all select doc_id, 2, 'h1_1', 1.0, null from documents""",
)
def ext_6(spark, d):
    parsed = RS.parse_responses(responses(spark, d), "output", strong=True)
    return SE.relevant_chunks(parsed, "doc_id", "json").select("doc_id", *big("rel_ord"), "wanted", "score", "reason")


@query(
    "ext_6_offline_relevance",
    """with c as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
w as (select doc_id, i, list_distinct(list_filter(regexp_split_to_array(lower('line ' || i || ' ' || x), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda t: t <> '')) as ws from c),
s as (select doc_id, i, len(list_intersect(ws, ['the', 'and', 'der', 'la', 'line', '2'])) / 6.0::double as score from w),
r as (select *, row_number() over (partition by doc_id order by score desc, i) as rel_ord from s where score > 0)
select doc_id, rel_ord, 'h1_' || i as wanted, score from r where rel_ord <= 3""",
)
def ext_6_offline(spark, d):
    docs = load(spark, d, "documents").select(
        "doc_id",
        F.transform(
            F.split("text", "\n", -1),
            lambda x, i: F.struct(
                F.concat(F.lit("h1_"), (i + 1).cast("string")).alias("section_id"),
                F.concat(F.lit("line "), (i + 1).cast("string")).alias("title"),
                x.alias("content"),
            ),
        ).alias("chunks"),
    )
    return SE.overlap_ranking(docs, "doc_id", "chunks", F.lit("the and der la line 2"), 3).select(
        "doc_id", *big("rel_ord"), "wanted", "score"
    )


def chunk_rows(spark, d):
    """Chunks with every id they carry."""
    c = F.from_json("corpus", CORPUS)
    is_new = F.coalesce(F.size(c["sections"]) > 0, F.lit(False))
    current = F.transform(
        c["sections"],
        lambda s: F.struct(
            s["section_id"].alias("section_id"),
            F.array(s["section_id"]).alias("ids"),
            s["title"].alias("title"),
            s["content"].alias("content"),
        ),
    )
    old = F.transform(
        c["chunks"],
        lambda s, i: F.struct(
            (i + 1).cast("string").alias("section_id"),
            F.array(s["chunk_id"], s["id"], s["section_id"]).alias("ids"),
            F.array_join(s["title_path"], " / ").alias("title"),
            F.coalesce(s["content"], s["text"], F.lit("")).alias("content"),
        ),
    )
    rows = corpora(spark, d).select(
        "doc_id", F.when(is_new, "sections").otherwise("chunks").alias("generation"), F.posexplode(F.when(is_new, current).otherwise(old)).alias("pos", "c")
    )
    return rows.select("doc_id", "generation", (F.col("pos") + 1).alias("ord"), "c.*")


WANTED = ["h1_2", "c_0", "sec_0001", "h1_1", "1", "i_1", "zz", "s_0002", "0000"]


def wanted(spark, d):
    return load(spark, d, "documents").select(
        "doc_id", F.posexplode(F.array(*[F.lit(w) for w in WANTED])).alias("pos", "wanted")
    ).select("doc_id", (F.col("pos") + 1).alias("rel_ord"), "wanted", ((F.col("pos") + 1) / 8).alias("score"))


RESOLVE_SQL = (
    CORPUS_SQL
    + """,
ids as (select doc_id, generation, ord, content, case when generation = 'sections' then [section_id] else
   [case when (ord - 1) % 4 = 0 then 'c_' || (ord - 1) end, case when (ord - 1) % 4 <= 1 then 'i_' || (ord - 1) end, case when (ord - 1) % 4 = 2 then 's_' || (ord - 1) end, ord::varchar, (ord - 1)::varchar] end as ks from corpus),
owner as (select doc_id, k, max(ord) as ord from (select doc_id, ord, unnest(ks) as k from ids) where k is not null group by all),
want as (select doc_id, u.i as rel_ord, u.w as wanted, u.i::double / 8 as score, case when doc_id % 3 = 0 then 1 else 0 end as legacy from documents,
  (values """
    + ", ".join(f"({i + 1}, '{w}')" for i, w in enumerate(WANTED))
    + """) u(i, w)),
tries as (
  select doc_id, rel_ord, wanted, score, 0 as a, wanted as k from want
  union all select doc_id, rel_ord, wanted, score, 1, string_split(wanted, '_')[-1] from want where legacy = 1 and contains(wanted, '_')
  union all select doc_id, rel_ord, wanted, score, 2, string_split(wanted, '_')[-1]::int::varchar from want where legacy = 1 and regexp_full_match(string_split(wanted, '_')[-1], '\\d+')
  union all select doc_id, rel_ord, wanted, score, 3, (string_split(wanted, '_')[-1]::int - 1)::varchar from want where legacy = 1 and regexp_full_match(string_split(wanted, '_')[-1], '\\d+') and string_split(wanted, '_')[-1]::int > 0),
hit as (select doc_id, rel_ord, wanted, score, arg_min(o.ord, a) as ord from tries t join owner o using (doc_id, k) group by all),
loaded as (select h.doc_id, rel_ord, wanted, score, h.ord, case when generation = 'sections' then 'line ' || h.ord end as title, content from hit h join ids i on i.doc_id = h.doc_id and i.ord = h.ord)"""
)


def loaded(spark, d):
    return SE.resolve_chunks(wanted(spark, d), chunk_rows(spark, d), "doc_id")


@query("ext_7_chunk_resolution", f"with {RESOLVE_SQL} select doc_id, rel_ord, wanted, ord, score, title, content from loaded")
def ext_7(spark, d):
    return loaded(spark, d).select("doc_id", *big("rel_ord", "ord"), "wanted", "score", "title", "content")


@query(
    "ext_8_selected_text",
    f"with {RESOLVE_SQL} select doc_id, 0 as part, string_agg(content, chr(10) || chr(10) order by rel_ord) as content from loaded where content <> '' group by doc_id",
)
def ext_8(spark, d):
    return SE.selected_text(loaded(spark, d), "doc_id").withColumn("part", F.col("part").cast("bigint"))


@query(
    "ext_9_selection_statistics",
    f"""with {RESOLVE_SQL},
t as (select doc_id, count(*) as total_chunks from corpus group by doc_id), s as (select doc_id, count(*) as n, avg(score) as a from loaded group by doc_id)
select doc_id, total_chunks, coalesce(n, 0) as selected_chunks, printf('%.2f%%', coalesce(n, 0) * 100.0::double / total_chunks) as selection_rate, coalesce(a, 0) as avg_score from t left join s using (doc_id)""",
)
def ext_9(spark, d):
    return SE.selection_statistics(chunk_rows(spark, d), loaded(spark, d), "doc_id").select(
        "doc_id", *big("total_chunks", "selected_chunks"), "selection_rate", F.round("avg_score", 9).alias("avg_score")
    )


# --- file, sheet and directory results of an item (an order; its files are line items) ---------


def file_rows(spark, d):
    o = text("ord")
    return matches(spark, d).select(
        "item",
        "ord",
        F.concat("source_file", F.lit(".json")).alias("file"),
        F.when(F.col("state") == "O", "success").otherwise("error").alias("status"),
        F.concat(F.lit("{Table_"), o, F.lit("_Start}} in\n{{{Table_"), o, F.lit("_End} after "), "source_file").alias("content"),
        F.when(F.col("state") != "O", F.concat(F.lit("no "), "source_file")).alias("error"),
        F.col("ord").alias("sections"),
    )


@query(
    "ext_10_file_results",
    f"""with {MATCH_SQL} select item, 0::bigint as part, string_agg('## Source: src/' || k || '.json' || chr(10) || chr(10) || '{{{{Table_' || ord || '_Start}}}} after src/' || k, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by ord) as content, false as glued
from m where state = 'O' group by item""",
)
def ext_10(spark, d):
    return RU.file_results(file_rows(spark, d), "item").withColumn("part", F.col("part").cast("bigint"))


@query(
    "ext_10_file_status",
    f"""with {MATCH_SQL} select item, case when bool_or(state = 'O') then 'success' else 'error' end as status, coalesce(sum(ord) filter (where state = 'O'), 0)::bigint as total_sections,
  count(*) as source_files, count(*) filter (where state <> 'O') as failed_files from m group by item""",
)
def ext_10_status(spark, d):
    return RU.file_status(file_rows(spark, d), "item")


@query(
    "ext_10_file_errors",
    f"""with {MATCH_SQL} select item, ord, 'src/' || k || '.json' as file, 'no src/' || k as error from m where item not in (select item from m where state = 'O')""",
)
def ext_10_errors(spark, d):
    return RU.file_errors(file_rows(spark, d), "item").withColumn("ord", F.col("ord").cast("bigint"))


def sheet_rows(spark, d):
    m = matches(spark, d)
    return m.select(
        F.col("item").alias("workbook"),
        "ord",
        F.concat(F.lit("s"), text("ord")).alias("title"),
        F.when((F.col("item") + F.col("ord")) % 4 == 0, F.lit(" \n")).otherwise(F.col("source_file")).alias("content"),
    )


@query(
    "ext_11_sheet_results",
    f"""with {MATCH_SQL} select item as workbook, (ord - 1) // 512 as part, string_agg('### Sheet: s' || ord || chr(10) || chr(10) || 'src/' || k || chr(10), chr(10) || '---' || chr(10) || chr(10) order by ord) as content
from m where (item + ord) % 4 <> 0 group by item, (ord - 1) // 512""",
)
def ext_11(spark, d):
    return RU.sheet_results(sheet_rows(spark, d), "workbook").withColumn("part", F.col("part").cast("bigint"))


@query(
    "ext_11_sheet_status",
    f"""with {MATCH_SQL} select item as workbook, count(*) as total_sheets, count(*) filter (where (item + ord) % 4 <> 0) as successful_sheets, count(*) filter (where (item + ord) % 4 = 0) as failed_sheets, 'success' as status from m group by item""",
)
def ext_11_status(spark, d):
    return RU.sheet_status(sheet_rows(spark, d), "workbook")


@query(
    "ext_11_sheet_extraction",
    """select doc_id, case when n_chars % 4 = 0 then 'error' else 'success' end as status, case when n_chars % 4 = 0 then 'Sheet内容为空' end as error,
  case n_chars % 4 when 0 then '' when 1 then text else 'excel:' || md5('find' || chr(10) || chr(10) || '# s' || doc_id || chr(10) || chr(10) || text) end as extracted from documents""",
)
def ext_11_extraction(spark, d):
    k = F.col("n_chars") % 4
    sheets = load(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("s"), text("doc_id")).alias("title"),
        F.when(k == 0, F.lit(" ")).otherwise(F.col("text")).alias("content"),
        F.when(k == 1, F.lit(" ")).otherwise(F.lit("find")).alias("asked"),
    )
    sheets = sheets.withColumn("prompt", RU.sheet_prompt(F.col("title"), F.col("content"), F.col("asked")))
    outputs = M.model_column(sheets.where("prompt is not null"), task="excel")
    return RU.sheet_extraction(sheets, outputs).select("doc_id", "status", "error", "extracted")


@query(
    "ext_11_workbooks",
    f"""with {MATCH_SQL} select item, (ord - 1) // 512 as part, case when (ord - 1) // 512 = 0 then chr(10) || chr(10) || repeat('=', 70) else '' end ||
  string_agg('## Excel文件: src/' || k || chr(10) || chr(10) || 'body ' || ord || chr(10), chr(10) || chr(10) order by ord) as content from m group by item, (ord - 1) // 512""",
)
def ext_11_workbooks(spark, d):
    books = matches(spark, d).select("item", "ord", F.col("source_file").alias("source"), F.concat(F.lit("body "), text("ord")).alias("content"))
    return RU.workbook_results(books, "item").withColumn("part", F.col("part").cast("bigint"))


@query(
    "ext_12_directories",
    f"""with {MATCH_SQL},
f as (select item, ord, case when l_suppkey % 3 = 0 then 'in/d0' else 'in/d' || (l_suppkey % 3) || '/markdown' end as dir, 'd' || (l_suppkey % 3) as label, '### Sheet: s' || ord || chr(10) || chr(10) || 'src/' || k || chr(10) as c from m),
g as (select item, dir, label, min(ord) as first_ord, string_agg(c, chr(10) || '---' || chr(10) || chr(10) order by ord) as c from f group by all)
select item, 0 as part, string_agg('## 来源: ' || label || chr(10) || chr(10) || c, chr(10) || chr(10) || '====' || chr(10) || chr(10) order by first_ord) as content from g group by item""",
)
def ext_12(spark, d):
    s = F.element_at(F.split("source_file", "_"), -1).cast("bigint") % 3
    files = matches(spark, d).select(
        "item",
        "ord",
        F.when(s == 0, "in/d0").otherwise(F.concat(F.lit("in/d"), s.cast("string"), F.lit("/markdown"))).alias("directory"),
        F.concat(F.lit("s"), text("ord")).alias("title"),
        F.col("source_file").alias("content"),
    )
    return RU.directory_results(files, "item").withColumn("part", F.col("part").cast("bigint"))


@query(
    "ext_12_source_text",
    f"""with {MATCH_SQL} select item, (ord - 1) // 512 as part, string_agg('### ' || k || chr(10) || file_type || chr(10), chr(10) || '---' || chr(10) order by ord) as content from m group by item, (ord - 1) // 512""",
)
def ext_12_source(spark, d):
    files = matches(spark, d).select("item", "ord", F.regexp_replace("source_file", "^src/", "").alias("stem"), F.col("file_type").alias("content"))
    return RU.source_text(files, "item").withColumn("part", F.col("part").cast("bigint"))


LOOSE_SQL = MD_SQL + ", loose as (select doc_id, replace(replace(md, '{{Table', '{Table'), '_End}}' || chr(10), '_End}}}' || chr(10)) as md from md)"


def loose(spark, d):
    """Documents whose table tags lost or gained a brace."""
    md = F.replace(F.replace("md", F.lit("{{Table"), F.lit("{Table")), F.lit("_End}}\n"), F.lit("_End}}}\n"))
    return md_docs(spark, d).select("doc_id", md.alias("md"))


@query(
    "ext_13_canonical_placeholders",
    f"""with {LOOSE_SQL} select doc_id, regexp_replace(regexp_replace(md, '\\{{*((Table|Image)_\\d+_(Start|End))\\}}*', '{{{{\\1}}}}', 'g'),
  '\\{{\\{{Table_(\\d+)_Start\\}}\\}}(?s:.*?)\\{{\\{{Table_\\d+_End\\}}\\}}', '{{{{Table_\\1_Start}}}}', 'g') as md from loose""",
)
def ext_13(spark, d):
    return loose(spark, d).select("doc_id", RU.canonical_placeholders(F.col("md")).alias("md"))


@query(
    "ext_14_placeholder_harvest",
    f"""with {LOOSE_SQL},
h as (select doc_id, list_sort(list_distinct(regexp_extract_all(string_split(md, chr(10))[1], '\\{{*((Table|Image)_\\d+_Start)\\}}*', 1))) as a,
  list_sort(list_distinct(regexp_extract_all(md, '\\{{*((Table|Image)_\\d+_Start)\\}}*', 1))) as b from loose)
select doc_id, array_to_string(list_transform(case when len(a) > 0 then a else b end, lambda p: '{{{{' || p || '}}}}'), ',') as placeholders from h""",
)
def ext_14(spark, d):
    first_line = F.split("md", "\n")[0]
    return loose(spark, d).select(
        "doc_id", F.array_join(RU.harvest_placeholders(first_line, F.col("md")), ",").alias("placeholders")
    )


@query(
    "ext_15_full_content",
    f"""with {SECTIONS_SQL} select doc_id, (ord - 1) // 512 as part, regexp_replace(string_agg(content, chr(10) || chr(10) order by ord), '\\{{\\{{Table_(\\d+)_Start\\}}\\}}(?s:.*?)\\{{\\{{Table_\\d+_End\\}}\\}}', '{{{{Table_\\1_Start}}}}', 'g') as content, false as glued
from secs where content <> '' group by doc_id, (ord - 1) // 512""",
)
def ext_15(spark, d):
    """Every document is taken in original mode; its query is missing, empty or blank."""
    k = F.col("doc_id") % 3
    items = load(spark, d, "documents").select(
        "doc_id", F.when(k == 1, F.lit(" ")).when(k == 2, F.lit("")).alias("extract"), F.lit(True).alias("original_mode")
    )
    return RU.full_content(items, sections(spark, d), "doc_id").withColumn("part", F.col("part").cast("bigint"))


@query(
    "ext_16_item_routing",
    """with i as (select o_orderkey as item, o_custkey, o_orderstatus, case o_orderpriority[1] when '1' then 'word' when '2' then 'pdf' when '3' then 'excel' when '4' then 'rtf' else 'zip' end as family from orders)
select item, family as data_type, case when family = 'zip' then 'error' else 'success' end as status,
  case family when 'zip' then '' when 'word' then 'doc ' || item when 'pdf' then 'doc ' || item else 'sheet ' || item end as content,
  case when family = 'zip' then '不支持的数据类型: zip' end as error, 'q' || o_custkey as quote, o_orderstatus = 'F' as insert_original,
  length('get') + case when o_custkey % 2 = 0 then 35 else 0 end + case when o_orderstatus = 'F' then length('x') else 0 end > 0 as asked from i""",
)
def ext_16(spark, d):
    p = F.substring("o_orderpriority", 1, 1)
    family = F.when(p == "1", "word").when(p == "2", "pdf").when(p == "3", "excel").when(p == "4", "rtf").otherwise("zip")
    items = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("item"),
        family.alias("family"),
        F.concat(F.lit("q"), text("o_custkey")).alias("quote"),
        (F.col("o_orderstatus") == "F").alias("insert_original"),
        (F.col("o_custkey") % 2 == 0).alias("original_mode"),
    )
    items = items.withColumn("extract", RU.extraction_query(F.lit("get"), F.col("original_mode"), F.col("insert_original")))
    answer = lambda label: lambda rows: rows.select("item", F.lit("success").alias("status"), F.concat(F.lit(label), text("item")).alias("content"))
    handlers = {**{f: answer("doc ") for f in RU.DOCUMENT_FAMILIES}, **{f: answer("sheet ") for f in RU.SHEET_FAMILIES}}
    return RU.route_items(items, handlers, "item").select(
        "item", "data_type", "status", "content", "error", "quote", "insert_original", (F.length("extract") > 0).alias("asked")
    )


def paragraph_items(spark, d):
    """Items of a paragraph: a customer is the paragraph, an order is an item."""
    k = F.col("o_orderkey")
    bad = F.col("o_orderpriority").startswith("5")
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("paragraph"),
        k.alias("ord"),
        F.when(bad, "error").otherwise("success").alias("status"),
        F.when(bad, F.concat(F.lit("failed "), text("o_orderkey"))).alias("error"),
        (F.col("o_orderstatus") == "F").alias("insert_original"),
        F.array(
            F.concat(F.lit("{{Table_"), (k % 3).cast("string"), F.lit("_Start}}")), F.lit("{{Image_1_Start}}")
        ).alias("placeholders"),
        (k % 5).alias("chunks_loaded"),
        (k % 2).alias("matches"),
    )


@query(
    "ext_17_paragraph_rollup",
    """select o_custkey as paragraph, count(*) as items, count(*) filter (where o_orderpriority[1] <> '5') as success_items, count(*) filter (where o_orderpriority[1] = '5') as error_items,
  sum(o_orderkey % 5)::bigint as total_chunks_loaded, sum(o_orderkey % 2)::bigint as total_matches, bool_or(o_orderstatus = 'F') as insert_original from orders group by o_custkey""",
)
def ext_17(spark, d):
    return RU.paragraph_rollup(paragraph_items(spark, d), "paragraph")


@query(
    "ext_17_paragraph_placeholders",
    """select o_custkey as paragraph, '{{Table_' || (o_orderkey % 3) || '_Start}}' as placeholder, count(*) as items from orders where o_orderstatus = 'F' group by all
union all select o_custkey, '{{Image_1_Start}}', count(*) from orders where o_orderstatus = 'F' group by all""",
)
def ext_17_placeholders(spark, d):
    return RU.paragraph_placeholders(paragraph_items(spark, d), "paragraph")


@query(
    "ext_17_first_error",
    "select o_custkey as paragraph, 'failed ' || min(o_orderkey) as error from orders where o_orderpriority[1] = '5' group by o_custkey",
)
def ext_17_error(spark, d):
    return RU.first_error(paragraph_items(spark, d), "paragraph")


@query(
    "ext_18_validation_gate",
    """select doc_id, case when doc_id % 7 = 6 then true when doc_id % 7 in (0, 1, 3) then n_chars % 2 = 0 when doc_id % 7 in (2, 4) then false end as is_valid,
  case when doc_id % 7 in (0, 1) then n_chars % 100 when doc_id % 7 in (2, 3, 4) then 0 end as score, doc_id % 7 < 5 as is_validated,
  case when doc_id % 7 in (0, 1, 3) then n_chars % 2 = 0 when doc_id % 7 in (2, 4) then false else true end as kept from documents""",
)
def ext_18(spark, d):
    k = F.col("doc_id") % 7
    valid = F.when(F.col("n_chars") % 2 == 0, "true").otherwise("false")
    score = (F.col("n_chars") % 100).cast("string")
    full = F.concat(
        F.lit('{"is_valid": '), valid, F.lit(', "overall_score": '), score, F.lit(', "validation_details": {}, "failed_reasons": [], "improvement_suggestions": ""}')
    )
    out = (
        F.when(k == 0, full)
        .when(k == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(k == 2, F.lit('{"is_valid": true, "overall_score": 90}'))
        .when(k == 3, F.concat(F.lit("I think "), F.lit('{"is_valid": '), valid, F.lit("} ok")))
        .when(k == 4, F.concat(F.lit("500 Server Error "), full))
        .otherwise(full)
    )
    docs = load(spark, d, "documents").select(
        "doc_id", out.alias("output"), F.when(k == 5, "LLM timeout").alias("error"), (k != 6).alias("enabled")
    )
    return J.gate(docs, "output", "error", F.col("enabled")).select("doc_id", "is_valid", *big("score"), "is_validated", "kept")


@query(
    "ext_19_best_attempt",
    """select lang, source, doc_id as attempt, n_chars % 10 as score from documents
qualify row_number() over (partition by lang, source order by n_chars % 10 desc, doc_id) = 1""",
)
def ext_19(spark, d):
    rows = load(spark, d, "documents").select("lang", "source", F.col("doc_id").alias("attempt"), (F.col("n_chars") % 10).alias("score"))
    return J.best_attempt(rows, ["lang", "source"])


@query(
    "ext_20_strategy",
    """select doc_id, case doc_id % 5 when 0 then 'word' when 1 then 'PDF' when 2 then 'excel' when 3 then 'rtf' else 'zip' end as doc_type, doc_id % 5 = 1 as validate, doc_id % 5 = 1 as retry,
  case when doc_id % 5 = 1 then 2 else 0 end as max_retries from documents""",
)
def ext_20(spark, d):
    k = F.col("doc_id") % 5
    kind = F.when(k == 0, "word").when(k == 1, "PDF").when(k == 2, "excel").when(k == 3, "rtf").otherwise("zip")
    rows = load(spark, d, "documents").select("doc_id", kind.alias("doc_type"))
    return J.strategy(rows, "doc_type", {"pdf": (True, True, 2)}).withColumn("max_retries", F.col("max_retries").cast("bigint"))


@query(
    "ext_21_load_audit",
    f"with {SECTIONS_SQL} select doc_id, ord, 'h1_' || ord as section_id, title, length(content) as content_length, summary from section_table",
)
def ext_21(spark, d):
    return SE.load_audit(sections(spark, d), "doc_id").select("doc_id", *big("ord", "content_length"), "section_id", "title", "summary")
