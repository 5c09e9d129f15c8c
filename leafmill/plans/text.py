"""Queries of the document-structuring family."""
from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import blocks as B
from leafmill.operators import clean as C
from leafmill.operators import images as I
from leafmill.operators import regions as R
from leafmill.operators import sections as S
from leafmill.operators import tables as T
from leafmill.operators.model import model_column, with_outputs
from leafmill.plans.family import family
from leafmill.plans.recipes import LN_SQL, MD_SQL, load, md_docs, s_strip

QUERIES, SQL, query = family()


START = r"(?i)\{\{\s*([A-Za-z0-9_\-]+?)\s*_Start\s*\}\}"
END = r"(?i)\{\{\s*([A-Za-z0-9_\-]+?)\s*_End\s*\}\}"

RANGES_SQL = LN_SQL + f""",
tags as (
  select doc_id, ln, regexp_extract(line, '{START}', 1) as name, ln * 2 as pos, 1 as d from ln where regexp_matches(line, '{START}')
  union all
  select doc_id, ln, regexp_extract(line, '{END}', 1), ln * 2 + 1, -1 from ln where regexp_matches(line, '{END}')),
cum as (select *, sum(d) over (partition by doc_id, name order by pos) as c from tags),
low as (select *, least(0, min(c) over (partition by doc_id, name order by pos)) as lo from cum),
dep as (select *, c - lo as depth from low),
lev as (select *, coalesce(lag(depth) over (partition by doc_id, name order by pos), 0) as before from dep),
sides as (select *, case when d = 1 then depth else before end as level from lev where d = 1 or before > 0),
ranges as (
  select doc_id, name, first_line, last_line from (
    select doc_id, name, d, ln as last_line,
           last_value(case when d = 1 then ln end ignore nulls) over (partition by doc_id, name, level order by pos) as first_line
    from sides) where d = -1)"""

SECTIONS_SQL = RANGES_SQL + f""",
heads as (
  select l.doc_id, l.ln, l.line,
         regexp_matches({s_strip('l.line')}, '^#\\s')
           and not exists (select 1 from ranges r where r.doc_id = l.doc_id and l.ln between r.first_line and r.last_line) as head
  from ln l),
numbered as (select *, sum(head::int) over (partition by doc_id order by ln) as sec from heads),
sec as (
  select doc_id, sec,
         coalesce(max(case when head then {s_strip("regexp_extract(" + s_strip('line') + ", '^#\\s+(.*)$', 1)")} end), '文档开头') as title,
         {s_strip("string_agg(line, chr(10) order by ln)")} as content,
         count(*) filter (where not head and regexp_matches(line, '{START}')) as table_count
  from numbered group by doc_id, sec),
secs as (
  select *, row_number() over (partition by doc_id order by sec) as ord, count(*) over (partition by doc_id) as total_sections
  from sec),
summed as (
  select *, array_to_string(list_filter(list_transform(string_split_regex(
     regexp_replace(regexp_replace(content, '[#*`\\[\\]()]', '', 'g'), '\\{{\\{{[^}}]+\\}}\\}}', '', 'g'), '[。！？.!?]'),
     lambda s: {s_strip('s')}), lambda s: length(s) > 10)[1:3], '。') as body
  from secs),
section_table as (
  select *, case when body = '' then '本节为「' || title || '」相关内容。'
     else '本节主要内容：' || case when length(body) > 200 then substr(body, 1, 200) || '...' else body end || '。' end as summary
  from summed)"""


@query(
    "doc_1_h1_sections",
    f"with {SECTIONS_SQL} select doc_id, ord, 'h1_' || ord as section_id, title, content from secs",
)
def doc_1(spark, d):
    return S.h1_sections(md_docs(spark, d), "doc_id", "md").select(
        "doc_id", F.col("ord").cast("bigint").alias("ord"), "section_id", "title", "content"
    )


@query("doc_2_region_ranges", f"with {RANGES_SQL} select doc_id, name, first_line, last_line from ranges")
def doc_2(spark, d):
    return R.region_ranges(md_docs(spark, d), "doc_id", "md").select(
        "doc_id",
        "name",
        F.col("first_line").cast("bigint").alias("first_line"),
        F.col("last_line").cast("bigint").alias("last_line"),
    )


SINGLE_SQL = LN_SQL + f""",
body as (select doc_id, ln, {s_strip('line')} as t from ln),
tags as (
  select doc_id, ln, regexp_extract(t, '^\\{{\\{{((?:Table|Image)_\\d+)_(Start|End)\\}}\\}}$', 1) as name,
         regexp_matches(t, 'Start') as s
  from body where regexp_matches(t, '^\\{{\\{{((?:Table|Image)_\\d+)_(Start|End)\\}}\\}}$')),
grp as (select *, sum(s::int) over (partition by doc_id order by ln) as g from tags),
pairs as (
  select doc_id, g, max(name) filter (where s) as name, max(ln) filter (where s) as a from grp group by doc_id, g)
select p.doc_id, p.name, p.a + 1 as first_line, min(e.ln) - 1 as last_line
from pairs p join grp e on e.doc_id = p.doc_id and e.g = p.g and not e.s and e.name = p.name
group by p.doc_id, p.g, p.name, p.a"""


@query("doc_2_single_open_ranges", f"with {SINGLE_SQL}")
def doc_2_single(spark, d):
    return R.region_ranges(md_docs(spark, d), "doc_id", "md", "single_open").select(
        "doc_id",
        "name",
        F.col("first_line").cast("bigint").alias("first_line"),
        F.col("last_line").cast("bigint").alias("last_line"),
    )


@query(
    "doc_3_section_metadata",
    f"""with {SECTIONS_SQL}
select doc_id, 'h1_' || ord as section_id, title, length(content) as word_count, table_count > 0 as has_tables,
       table_count, total_sections from secs""",
)
def doc_3(spark, d):
    return S.section_table(md_docs(spark, d), "doc_id", "md").select(
        "doc_id",
        "section_id",
        "title",
        F.col("word_count").cast("bigint").alias("word_count"),
        "has_tables",
        F.col("table_count").cast("bigint").alias("table_count"),
        F.col("total_sections").cast("bigint").alias("total_sections"),
    )


@query("doc_4_section_summary", f"with {SECTIONS_SQL} select doc_id, 'h1_' || ord as section_id, summary from section_table")
def doc_4(spark, d):
    return S.section_table(md_docs(spark, d), "doc_id", "md").select("doc_id", "section_id", "summary")


@query(
    "doc_4_model_summary",
    f"""with {SECTIONS_SQL},
c as (select *, {s_strip("regexp_replace(regexp_replace(content, '\\n\\s*\\n', chr(10), 'g'), '\\{\\{[^}]+\\}\\}', '', 'g')")} as cleaned from section_table),
q as (select *, title || chr(10) || cleaned as prompt from c)
select doc_id, 'h1_' || ord as section_id, case when length(content) % 3 = 0 then summary else 'summary:' || md5(prompt) end as summary from q""",
)
def doc_4_model(spark, d):
    """Model summaries (offline backend); sections of every third length get no answer and fall back."""
    secs = S.section_table(md_docs(spark, d), "doc_id", "md").withColumn(
        "prompt", F.concat("title", F.lit("\n"), S.summary_model_input(F.col("content")))
    )
    outputs = model_column(secs, task="summary")
    answered = with_outputs(secs, outputs)
    output = F.when(F.length("content") % 3 != 0, F.col("output"))
    return answered.select("doc_id", "section_id", S.finish_summary(output, F.col("content"), F.col("title")).alias("summary"))


# First start tag from the current position, then its end tag; unclosed takes the rest.
CARVE_SQL = MD_SQL + f""",
carve as (
  select doc_id, md as rest, 0 as step, null::varchar as kind, null::varchar as name, null::varchar as seg from md
  union all
  select doc_id,
    case when tag = '' then '' when tag_at > 1 then substr(rest, tag_at) when close_at > 0 then substr(rest, close_at + length(end_tag)) else '' end,
    step + 1,
    case when tag = '' or tag_at > 1 then 'text' when close_at > 0 then 'region' else 'open' end,
    case when tag = '' or tag_at > 1 then null else tag_name end,
    case when tag = '' then rest when tag_at > 1 then substr(rest, 1, tag_at - 1)
         when close_at > 0 then substr(rest, 1, close_at + length(end_tag) - 1) else rest end
  from (
    select *, strpos(rest, tag) as tag_at, strpos(rest, end_tag) as close_at from (
      select *, regexp_extract(tag, '{START}', 1) as tag_name, '{{{{' || regexp_extract(tag, '{START}', 1) || '_End}}}}' as end_tag from (
        select doc_id, rest, step, regexp_extract(rest, '{START}', 0) as tag from carve where rest <> '')))),
segs as materialized (select doc_id, row_number() over (partition by doc_id order by step) as seg_no, kind, name, seg from carve where step > 0)"""


@query("doc_6_region_carving", f"with recursive {CARVE_SQL} select doc_id, kind, name, seg, seg_no from segs")
def doc_6(spark, d):
    carved = R.carve(md_docs(spark, d), "doc_id", "md")
    return carved.select("doc_id", "kind", "name", "seg", (F.col("seg_no") + 1).cast("bigint").alias("seg_no"))


BLOCKS_SQL = CARVE_SQL + f""",
sl as (
  select doc_id, seg_no, unnest(string_split(seg, chr(10))) as line, generate_subscripts(string_split(seg, chr(10)), 1) as ln
  from segs where kind = 'text'),
f1 as (select *, regexp_matches(line, '^```+') as fence,
         sum(regexp_matches(line, '^```+')::int) over (partition by doc_id, seg_no order by ln) as fences from sl),
f2 as (select *, case when fence or fences % 2 = 1 then 'code' when {s_strip('line')} = '' then 'blank'
         when regexp_matches(line, '^#{{1,6}}\\s+') then 'heading' when contains(line, '|') then 'table'
         when regexp_matches(line, '!\\[[^\\]]*\\]\\([^\\)]+\\)') then 'image' else 'paragraph' end as type from f1),
f3 as (select *, sum((type not in ('table', 'paragraph'))::int) over (partition by doc_id, seg_no order by ln) as k0 from f2),
f4 as (select *, case type when 'table' then 1 when 'paragraph' then 0 else -1 end as k1,
         case when type = 'paragraph' then sum((type = 'table')::int) over (partition by doc_id, seg_no, k0 order by ln) else 0 end as k2,
         case when type = 'code' then (fences + 1) // 2 end as code_no from f3),
f5 as (select doc_id, seg_no, type, k1, k2, code_no, min(k0) as k0, string_agg(line, chr(10) order by ln) as raw
       from f4 where type <> 'blank'
       group by doc_id, seg_no, type, k1, k2, code_no, case when type = 'code' then null else k0 end),
f6 as (
  select doc_id, seg_no, k0, k1, k2, type,
    case when type = 'heading' then length(regexp_extract(raw, '^(#{{1,6}})\\s+', 1)) end as level,
    null::varchar as name,
    case when type = 'heading' then {s_strip("regexp_extract(raw, '^#{1,6}\\s+(.*)$', 1)")}
         when type in ('image', 'paragraph') then {s_strip('raw')} else raw end as text
  from f5
  union all
  select doc_id, seg_no, 0, 0, 0, 'region', null, name, seg from segs where kind <> 'text'),
blk as materialized (select doc_id, row_number() over (partition by doc_id order by seg_no, k0, k1, k2) as ord, type, level, name, text from f6)"""


@query("doc_5_blocks", f"with recursive {BLOCKS_SQL} select doc_id, ord, type, level, name, text from blk")
def doc_5(spark, d):
    return B.blocks(md_docs(spark, d), "doc_id", "md").select(
        "doc_id",
        F.col("ord").cast("bigint").alias("ord"),
        "type",
        F.col("level").cast("bigint").alias("level"),
        "name",
        "text",
    )


# Greedy packing as a recursion over the ordered blocks.
PACK_SQL = BLOCKS_SQL + """,
paths as (
  select b.*, h1.t as p1, case when h2.ord > coalesce(h1.ord, 0) then h2.t end as p2
  from blk b
  asof left join (select doc_id, ord, text as t from blk where type = 'heading' and level = 1) h1
    on b.doc_id = h1.doc_id and b.ord >= h1.ord
  asof left join (select doc_id, ord, text as t from blk where type = 'heading' and level = 2) h2
    on b.doc_id = h2.doc_id and b.ord >= h2.ord),
units as materialized (
  select *, row_number() over (partition by doc_id order by ord) as u, length(text) as n from paths where type <> 'heading'),
slim as materialized (select doc_id, u, n, type from units),
walk as (
  select doc_id, u, n as len, 1 as chunk, type = 'region' or n >= 1200 as shut from slim where u = 1
  union all
  select x.doc_id, x.u,
    case when w.shut or x.type = 'region' or w.len + x.n > 1200 then x.n else w.len + x.n end,
    w.chunk + case when w.shut or x.type = 'region' or w.len + x.n > 1200 then 1 else 0 end,
    x.type = 'region' or (case when w.shut or w.len + x.n > 1200 then x.n else w.len + x.n end) >= 1200
  from walk w join slim x on x.doc_id = w.doc_id and x.u = w.u + 1),
last_head as (select doc_id, max(ord) as last_ord from blk group by doc_id),
members as (
  select x.*, w.chunk, w.shut from units x join walk w on w.doc_id = x.doc_id and w.u = x.u),
ends as (
  select doc_id, chunk, min(u) as first_u, max(u) as last_u, string_agg(text, chr(10) || chr(10) order by u) as body,
         bool_or(shut) as shut, min(ord) as first_ord, max(ord) as last_ord from members group by doc_id, chunk),
nxt as (
  -- a chunk closes at its own last block when full (or a region), else at the block that opens the next chunk
  select e.*, case when e.shut then e.last_ord else coalesce(
      lead(e.first_ord) over (partition by e.doc_id order by e.chunk), h.last_ord) end as close_ord
  from ends e join last_head h on h.doc_id = e.doc_id),
titled as (
  select n.*, array_to_string(list_filter([p.p1, p.p2], lambda t: t is not null and t <> ''), ' / ') as title_path
  from nxt n join paths p on p.doc_id = n.doc_id and p.ord = n.close_ord),
counted as materialized (select *, count(*) over (partition by doc_id) as n_chunks from titled)"""

MERGED_SQL = PACK_SQL + """,
merged as (
  select a.doc_id, a.chunk as chunk_no, a.title_path,
    case when b.doc_id is not null then a.body || chr(10) || chr(10) || b.body else a.body end as content,
    a.n_chunks - case when t.doc_id is not null then 1 else 0 end as total
  from counted a
  left join counted t on t.doc_id = a.doc_id and t.chunk = t.n_chunks and t.n_chunks >= 2 and length(t.body) < 600
  left join counted b on b.doc_id = a.doc_id and b.chunk = a.chunk + 1 and b.chunk = t.chunk
  where t.doc_id is null or a.chunk < t.chunk)"""


def _packed(spark, d, merge_tail):
    return B.pack_chunks(B.blocks(md_docs(spark, d), "doc_id", "md"), "doc_id", merge_tail=merge_tail)


@query(
    "doc_7_chunk_packing",
    f"with recursive {PACK_SQL} select doc_id, chunk as chunk_no, n_chunks as total, body as content from counted",
)
def doc_7(spark, d):
    return _packed(spark, d, False).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("total").cast("bigint").alias("total"), "content"
    )


@query(
    "doc_8_heading_path",
    f"with recursive {PACK_SQL} select doc_id, chunk as chunk_no, title_path from counted",
)
def doc_8(spark, d):
    return _packed(spark, d, False).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.array_join("title_path", " / ").alias("title_path")
    )


@query(
    "doc_9_tail_merge",
    f"with recursive {MERGED_SQL} select doc_id, chunk_no, total, title_path, content from merged",
)
def doc_9(spark, d):
    return _packed(spark, d, True).select(
        "doc_id",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("total").cast("bigint").alias("total"),
        F.array_join("title_path", " / ").alias("title_path"),
        "content",
    )


@query(
    "doc_10_sentences",
    f"""with d as (select doc_id, {s_strip("regexp_replace(text, '\\s+', ' ', 'g')")} as t from documents),
s as (select doc_id, list_filter(list_transform(
  regexp_extract_all(t, '[^。！？!\\?；;…]+(?:[。！？!；;…]+|$)'), lambda x: {s_strip('x')}), lambda x: x <> '') as xs from d)
select doc_id, generate_subscripts(xs, 1) - 1 as ord, unnest(xs) as sentence from s""",
)
def doc_10(spark, d):
    return B.sentences(load(spark, d, "documents"), "doc_id", "text").select(
        "doc_id", F.col("ord").cast("bigint").alias("ord"), "sentence"
    )


@query(
    "doc_10_chunk_overlap",
    f"""with recursive {MERGED_SQL},
t as (select doc_id, chunk_no, content, list_filter(list_transform(regexp_extract_all({s_strip("regexp_replace(content, '\\s+', ' ', 'g')")}, '[^。！？!\\?；;…]+(?:[。！？!；;…]+|$)'), lambda x: {s_strip('x')}), lambda x: x <> '') as xs from merged),
p as (select *, lag(xs[-1]) over (partition by doc_id order by chunk_no) as ov from t)
select doc_id, chunk_no::bigint as chunk_no, case when ov is null then 0 else 1 end::bigint as overlap_from_prev, coalesce(ov || chr(10) || chr(10), '') || content as content from p""",
)
def doc_10_overlap(spark, d):
    return B.with_overlap(_packed(spark, d, True), "doc_id").select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("overlap_from_prev").cast("bigint").alias("overlap_from_prev"), "content"
    )


@query(
    "doc_11_flat_chunk_index",
    f"""with recursive {MERGED_SQL}
select doc_id, chunk_no as "index", total, 'doc' || doc_id || '_' || printf('%04d', chunk_no) as chunk_id, title_path,
       0 as overlap_from_prev, length(content) as char_len, content from merged""",
)
def doc_11(spark, d):
    name = F.concat(F.lit("in/doc"), F.col("doc_id").cast("string"), F.lit(".docx"))
    return B.flat_chunk_index(_packed(spark, d, True), "doc_id", name).select(
        "doc_id",
        F.col("index").cast("bigint").alias("index"),
        F.col("total").cast("bigint").alias("total"),
        "chunk_id",
        F.array_join("title_path", " / ").alias("title_path"),
        "overlap_from_prev",
        F.col("char_len").cast("bigint").alias("char_len"),
        "content",
    )


TAGGED_SQL = LN_SQL + f""",
t1 as (select *, contains(line, '|') and coalesce(regexp_matches(lead(line) over (partition by doc_id order by ln), '^\\s*\\|?\\s*[-:]+\\s*\\|'), false) as head,
         {s_strip('line')} <> '' and (contains(line, '|') or regexp_matches(line, '^\\s*\\|?\\s*[-:]+')) as cont from ln),
t2 as (select *, sum((not cont)::int) over (partition by doc_id order by ln) as run from t1),
t3 as (select *, cont and sum((head and cont)::int) over (partition by doc_id, run order by ln) > 0 as in_t from t2),
t4 as (select *, coalesce(lag(in_t) over (partition by doc_id order by ln), false) as was from t3),
t5 as (select *, in_t and not was as opens, was and not in_t as closes,
         not in_t and not was and regexp_matches(line, '!\\[([^\\]]*)\\]\\([^)]+\\)') as img from t4),
t6 as (select *, sum(opens::int) over (partition by doc_id order by ln) as tn, sum(img::int) over (partition by doc_id order by ln) as im from t5),
marked as (select doc_id, string_agg(case
    when opens then chr(10) || '{{{{Table_' || tn || '_Start}}}}' || chr(10) || chr(10) || line
    when closes then chr(10) || '{{{{Table_' || tn || '_End}}}}' || chr(10) || chr(10) || line
    when img then chr(10) || '{{{{Image_' || im || '_Start}}}}' || chr(10) || line || chr(10) || '{{{{Image_' || im || '_End}}}}' || chr(10)
    else line end, chr(10) order by ln) as marked from t6 group by doc_id)"""


@query("doc_12_auto_tagging", f"with {TAGGED_SQL} select doc_id, marked from marked")
def doc_12(spark, d):
    return T.tag_tables_and_images(md_docs(spark, d), "doc_id", "md")


NUMBERED = r"\{\{(Table|Image)_(\d+)_(Start|End)\}\}"
SCAN_SQL = MD_SQL + f""",
tagged as (select doc_id, md, string_split_regex(md, '{NUMBERED}') as gaps, regexp_extract_all(md, '{NUMBERED}') as tags from md),
tg as (select doc_id, generate_subscripts(tags, 1) as k, unnest(tags) as tag, unnest(gaps[1:len(tags)]) as gap from tagged),
pos as (select *, sum(length(gap) + length(tag)) over (partition by doc_id order by k) as until from tg),
named as (select doc_id, k, until, until - length(tag) as tag_at, contains(tag, '_Start') as s, regexp_extract(tag, '{NUMBERED}', 1) as kind,
           regexp_extract(tag, '{NUMBERED}', 2)::int as idx from pos),
paired as (select *, last_value(case when s then tag_at end ignore nulls) over (partition by doc_id, kind, idx order by k) as start_pos from named),
reg as (select doc_id, k, lower(kind) as type, idx, kind || '_' || idx as name, start_pos, until as end_pos
        from paired where not s and start_pos is not null),
regions as (select *, row_number() over (partition by doc_id order by k) - 1 as ord from reg)"""


@query("doc_13_region_scan", f"with {SCAN_SQL} select doc_id, ord, type, idx, name, start_pos, end_pos from regions")
def doc_13(spark, d):
    r = R.scan_regions(md_docs(spark, d), "doc_id", "md")
    return r.select(
        "doc_id",
        F.col("ord").cast("bigint").alias("ord"),
        "type",
        "idx",
        "name",
        F.col("start_pos").cast("bigint").alias("start_pos"),
        F.col("end_pos").cast("bigint").alias("end_pos"),
    )


# The whole chain runs on auto-tagged text, so images in image regions are met as well.
CHAIN_SQL = TAGGED_SQL + "," + SCAN_SQL[len(MD_SQL) + 1 :].replace("string_split_regex(md,", "string_split_regex(marked,").replace(
    "regexp_extract_all(md,", "regexp_extract_all(marked,"
).replace("select doc_id, md,", "select doc_id, marked,").replace("as tags from md)", "as tags from marked)") + f""",
bare as (
  select r.doc_id, r.ord, r.type, r.idx, r.name,
    {s_strip("replace(replace(substr(m.marked, r.start_pos::int + 1, (r.end_pos - r.start_pos)::int), '{{' || r.name || '_Start}}', ''), '{{' || r.name || '_End}}', '')")} as bare
  from regions r join marked m using (doc_id)),
content as (
  -- an image region holds one reference, a table region none: one replacement is enough
  select doc_id, ord, type, idx, name, bare,
    case when contains(bare, ';base64,') then
      regexp_replace(bare, '!\\[([^\\]]*)\\]\\(data:image/([^;,]+);base64,([^)]+)\\)',
        '![\\1](./images/image_' || substr(md5(from_base64(regexp_extract(bare, '!\\[([^\\]]*)\\]\\(data:image/([^;,]+);base64,([^)]+)\\)', 3))), 1, 12) || '.png)')
    else bare end as content,
    len(regexp_extract_all(bare, '!\\[([^\\]]*)\\]\\(data:image/[^;,]+;base64,[^)]+\\)')) as images
  from bare where bare <> '')"""


def _regions(spark, d):
    return R.extract_regions(T.tag_tables_and_images(md_docs(spark, d), "doc_id", "md"), "doc_id", "marked")


@query(
    "doc_14_region_extraction",
    f"""with {CHAIN_SQL}
select doc_id, ord, type, idx, name, images, content, case when length(content) > 100 then substr(content, 1, 100) || '...' else content end as preview
from content""",
)
def doc_14(spark, d):
    return _regions(spark, d).select(
        "doc_id",
        F.col("ord").cast("bigint").alias("ord"),
        "type",
        "idx",
        "name",
        F.col("images").cast("bigint").alias("images"),
        "content",
        "preview",
    )


@query(
    "doc_15_region_summary",
    f"""with {CHAIN_SQL}
select doc_id, case when grouping(doc_id) = 0 then 'document' else 'total' end as grain, count(*) filter (where type = 'table') as total_tables, count(*) filter (where type = 'image') as total_images,
       count(*) as total_regions, sum(images)::bigint as total_extracted_images
from content group by rollup(doc_id)""",
)
def doc_15(spark, d):
    return R.region_summary(_regions(spark, d), "doc_id")


EMB = r"!\[([^\]]*)\]\(data:image/([^;,]+);base64,([^)]+)\)"
IMAGES_SQL = MD_SQL + f""",
hits as (select doc_id, regexp_extract_all(md, '{EMB}', 1) as alts, regexp_extract_all(md, '{EMB}', 3) as datas from md),
im as (select doc_id, generate_subscripts(datas, 1) - 1 as ord, unnest(alts) as alt_text, from_base64(unnest(datas)) as raw from hits),
named as (select *, 'image_' || substr(md5(raw), 1, 12) || '.png' as name, octet_length(raw) as size from im)"""


@query(
    "doc_16_embedded_images",
    f"with {IMAGES_SQL} select doc_id, ord, name, './images/' || name as path, 'png' as format, size, alt_text from named",
)
def doc_16(spark, d):
    return I.embedded_images(md_docs(spark, d), "doc_id", "md").select(
        "doc_id", F.col("ord").cast("bigint").alias("ord"), "name", "path", "format", F.col("size").cast("bigint").alias("size"), "alt_text"
    )


@query(
    "doc_16_asset_store",
    f"with {IMAGES_SQL} select any_value(name) as name, sha256(raw) as digest, 'png' as format, max(size) as size, count(*) as occurrences, hex(raw) as content_hex from named group by raw",
)
def doc_16_store(spark, d):
    return I.asset_store(I.embedded_images(md_docs(spark, d), "doc_id", "md"), "doc_id").select(
        "name", "digest", "format", F.col("size").cast("bigint").alias("size"), "occurrences", F.hex("bytes").alias("content_hex")
    )


@query(
    "doc_16_rewritten_text",
    f"""with {IMAGES_SQL},
gap as (select doc_id, string_split_regex(md, '{EMB}') as gaps from md),
g as (select doc_id, generate_subscripts(gaps, 1) - 1 as ord, unnest(gaps) as gap from gap)
select g.doc_id, string_agg(gap || case when n.name is null then '' else '![' || n.alt_text || '](./images/' || n.name || ')' end, '' order by g.ord) as md
from g left join named n on n.doc_id = g.doc_id and n.ord = g.ord group by g.doc_id""",
)
def doc_16_text(spark, d):
    return md_docs(spark, d).select("doc_id", I.rewrite_embedded(F.col("md")).alias("md"))


@query(
    "doc_17_image_statistics",
    f"""with {MD_SQL},
m as (select doc_id, md, octet_length(encode(md)) as original_size, regexp_extract_all(md, '{EMB}') as f from md),
n as (select *, len(f) as num_images, coalesce(list_sum(list_transform(f, lambda x: length(x))), 0)::bigint - 50 * len(f) as cut from m)
select doc_id, original_size, original_size - cut as estimated_cleaned_size, cut as reduction_bytes,
       round(cut::double / original_size * 100, 2) as reduction_percent, num_images,
       regexp_replace(regexp_replace(md, '!\\[([^\\]]+)\\]\\([^)]+\\)', '[图片: \\1]', 'g'), '!\\[\\]\\([^)]+\\)', '[图片]', 'g') as stripped
from n where original_size > 0""",
)
def doc_17(spark, d):
    docs = md_docs(spark, d)
    stripped = docs.select("doc_id", "md", I.strip_images(F.col("md")).alias("stripped"))
    est = I.size_estimate(stripped.withColumn("key", F.struct("doc_id", "stripped")), "key", "md")
    return est.where("original_size > 0").select(
        "key.doc_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("original_size", "estimated_cleaned_size", "reduction_bytes")],
        "reduction_percent",
        F.col("num_images").cast("bigint").alias("num_images"),
        "key.stripped",
    )


@query(
    "doc_18_grid_simplification",
    f"""with {LN_SQL},
k as (select *, case when regexp_matches(line, '^[\\+\\-\\|: ]+$') and contains(line, '+') then 'flush'
        when regexp_matches(line, '^[\\+\\-\\|: ]+$') and contains(line, '|') and contains(line, '---') then 'separator'
        when regexp_matches(line, '^[\\+\\-\\|: ]+$') then 'gone' when contains(line, '|') then 'row' else 'text' end as kind from ln),
g as (select *, sum((kind in ('flush', 'text'))::int) over (partition by doc_id order by ln) as grp from k),
c as (select *, case when kind = 'row' then '|' || array_to_string(list_transform(string_split(trim(line, '|'), '|'),
        lambda x: regexp_replace(regexp_replace(regexp_replace({s_strip('x')}, '\\s+', ' ', 'g'), '\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g')), '|') || '|' else line end as shown
      from g where kind in ('separator', 'row', 'text')),
n as (select *, count(*) over (partition by doc_id, grp, kind) as rows, row_number() over (partition by doc_id, grp, kind order by ln) as nth from c),
o as (select doc_id, grp, case kind when 'text' then 0 when 'separator' then 1 else 2 end as phase, ln,
        case when kind = 'row' and rows > 1 and nth = 1 then shown || chr(10) || '|' || array_to_string(list_transform(range(length(shown) - length(replace(shown, '|', '')) - 1), lambda i: '---'), ' | ') || '|' else shown end as shown from n)
select md.doc_id, coalesce(max(s.t), '') as simplified from md
left join (select doc_id, string_agg(shown, chr(10) order by grp, phase, ln) as t from o group by doc_id) s using (doc_id) group by md.doc_id""",
)
def doc_18(spark, d):
    return T.simplify_grid_tables(md_docs(spark, d), "doc_id", "md")


@query(
    "doc_19_table_documents",
    f"""with {LN_SQL},
a as (select *, {s_strip('line')} as s from ln),
b as (select *, starts_with(s, '|') and ends_with(s, '|') and length(s) >= 3 as tab from a),
c as (select *, coalesce(lag(tab) over (partition by doc_id order by ln), false) and not tab as turn from b),
e as (select *, sum(turn::int) over (partition by doc_id order by ln) + 1 as table_no from c),
g as (select doc_id, table_no, string_agg(line, chr(10) order by ln) as text, count(*) filter (where tab) as table_lines,
        arg_min(s, ln) filter (where not tab and s <> '') as first_line from e group by doc_id, table_no),
h as (select *, coalesce(substr(regexp_replace(regexp_replace(regexp_replace(first_line, '^[#\\s*]+', ''), '\\*\\*', '', 'g'), '[\\\\/:*?"<>|]', '_', 'g'), 1, 40), 'sheet') as name
      from g where table_lines > 0)
select doc_id, table_no, name, name || '_' || table_no as file_stem, table_lines, text from h""",
)
def doc_19(spark, d):
    return T.split_by_tables(md_docs(spark, d), "doc_id", "md").withColumn("table_no", F.col("table_no").cast("bigint"))


def _with_html(spark, d):
    """Every fourth heading group turns into an HTML table block."""
    return md_docs(spark, d).select(
        "doc_id", F.replace(F.replace("md", F.lit("\n## "), F.lit("\n<table>\n<tr>")), F.lit("\n```"), F.lit("\n</table>")).alias("md")
    )


@query(
    "doc_20_plain_text",
    f"""with {MD_SQL},
h as (select doc_id, replace(replace(md, chr(10) || '## ', chr(10) || '<table>' || chr(10) || '<tr>'), chr(10) || '```', chr(10) || '</table>') as md from md),
l as (select doc_id, unnest(string_split(md, chr(10))) as line, generate_subscripts(string_split(md, chr(10)), 1) as ln from h),
e as (select *, case when contains(line, '</table>') then 0 when contains(line, '<table>') then 1 end as ev from l),
f as (select *, coalesce(last_value(ev ignore nulls) over (partition by doc_id order by ln), 0) as inside from e),
k as (select *, regexp_replace(regexp_replace(line, '!\\[.*?\\]\\(.*?\\)', '', 'g'), '^#+\\s*', '') as bare,
        regexp_matches({s_strip('line')}, '^\\{{\\{{Table_\\d+_(Start|End)\\}}\\}}') as mark
      from f where inside = 0 and not contains(line, '</table>'))
select h.doc_id, coalesce(string_agg(case when mark then line else bare end, chr(10) order by ln)
   filter (where mark or ({s_strip('line')} <> '```' and {s_strip('bare')} <> '')), '') as plain
from h left join k on k.doc_id = h.doc_id group by h.doc_id""",
)
def doc_20(spark, d):
    return _with_html(spark, d).select("doc_id", C.plain_from_markdown(F.col("md")).alias("plain"))


@query(
    "doc_21_character_cleanup",
    """with d as (select doc_id, '  ' || replace(replace(text, ' a', chr(160) || 'a' || chr(8203)), '. ', '.' || chr(12288) || chr(7)) || chr(10) as t from documents),
e as (select doc_id, translate(replace(replace(t, chr(13) || chr(10), chr(13)), chr(10), chr(13)), chr(160) || chr(12288), '  ') as t from d)
select doc_id, trim(regexp_replace(replace(t, chr(8203), ''), '[\\x{00}-\\x{08}\\x{0B}-\\x{1F}\\x{FFFD}]', ' ', 'g'), ' ' || chr(9) || chr(10)) as cleaned from e""",
)
def doc_21(spark, d):
    t = F.replace(F.replace("text", F.lit(" a"), F.lit(" a​")), F.lit(". "), F.lit(".　\u0007"))
    return load(spark, d, "documents").select(
        "doc_id", C.normalise_characters(F.concat(F.lit("  "), t, F.lit("\n"))).alias("cleaned")
    )


@query(
    "doc_22_line_roles",
    f"""with {MD_SQL},
l as (select doc_id, list_filter(list_transform(string_split(replace(md, chr(10) || '## ', chr(10) || '第 '), chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '') as xs from md),
u as (select doc_id, generate_subscripts(xs, 1) - 1 as ord, unnest(xs) as x from l)
select doc_id, ord, case when starts_with(x, '第') then '章节: ' || x
  when starts_with(x, '•') or starts_with(x, '-') or starts_with(x, '*') or regexp_matches(x, '^[1-5]\\.') then '列表项: ' || x
  when len(string_split(x, ':')) = 2 then '键值对: ' || {s_strip("string_split(x, ':')[1]")} || ' = ' || {s_strip("string_split(x, ':')[2]")}
  else '段落: ' || x end as line_role from u""",
)
def doc_22(spark, d):
    docs = md_docs(spark, d).withColumn("md", F.replace("md", F.lit("\n## "), F.lit("\n第 ")))
    return C.line_roles(docs, "doc_id", "md").withColumn("ord", F.col("ord").cast("bigint"))


@query(
    "doc_23_titles",
    f"""with {MD_SQL},
l as (select doc_id, list_filter(list_transform(string_split(md, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '') as xs from md)
select doc_id, coalesce(case when starts_with(xs[1], '#') then {s_strip("regexp_replace(xs[1], '^#+', '')")} else xs[1] end, 'doc' || doc_id) as title from l""",
)
def doc_23(spark, d):
    return md_docs(spark, d).select(
        "doc_id", C.pick_title(F.col("md"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("title")
    )


@query(
    "doc_24_document_class",
    f"""with recursive {BLOCKS_SQL},
c as (select doc_id, coalesce(sum(length(text)) filter (where type = 'paragraph'), 0) as text_chars,
        count(*) filter (where type = 'table') + count(*) filter (where type = 'region' and starts_with(name, 'Table')) as tables,
        coalesce(sum(length(text) - length(replace(text, '|', ''))) filter (where type in ('table', 'region')), 0) as cells,
        count(*) filter (where type = 'image') as images
      from blk group by doc_id),
w as (select md.doc_id, md.lang, text_chars, tables, cells, images from c join md using (doc_id))
select doc_id, text_chars::bigint as text_chars, tables, cells::bigint as cells, images,
  case when lang = 'de' then 'tables' when lang = 'es' then 'images'
       when (cells >= 30 or tables >= 2) and text_chars < 200 then 'tables'
       when images >= 1 and text_chars < 200 and not (cells >= 30 or tables >= 2) then 'images' else 'text' end as doc_class from w""",
)
def doc_24(spark, d):
    docs = md_docs(spark, d)
    is_tab = F.col("type") == "table"
    counts = (
        B.blocks(docs, "doc_id", "md")
        .groupBy("doc_id")
        .agg(
            F.coalesce(F.sum(F.when(F.col("type") == "paragraph", F.length("text"))), F.lit(0)).alias("text_chars"),
            F.count_if(is_tab | ((F.col("type") == "region") & F.col("name").startswith("Table"))).alias("tables"),
            F.coalesce(
                F.sum(F.when(F.col("type").isin("table", "region"), F.regexp_count("text", F.lit(r"\|")))), F.lit(0)
            ).alias("cells"),
            F.count_if(F.col("type") == "image").alias("images"),
        )
    )
    wanted = F.when(F.col("lang") == "de", "Tbl").when(F.col("lang") == "es", " jpg").when(F.col("lang") == "fr", "sound")
    return counts.join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id",
        "text_chars",
        "tables",
        "cells",
        "images",
        C.document_class(F.col("text_chars"), F.col("tables"), F.col("cells"), F.col("images"), wanted).alias("doc_class"),
    )


@query(
    "doc_25_label_block",
    f"""with d as (select doc_id, n_chars, text from documents)
select doc_id, case when n_chars % 3 <> 0 then '{{"chars": ' || n_chars || '}}' end as label_json,
  n_chars % 3 <> 0 as label_ok,
  case n_chars % 3 when 0 then text
    when 1 then {s_strip("text || chr(10) || chr(10) || 'json' || chr(10) || '{"+'"chars": '+"' || n_chars || '}' || chr(10) || '```'")}
    else {s_strip("text")} end as body from d""",
)
def doc_25(spark, d):
    label = F.concat(
        F.lit('\n\n## 标签信息 (JSON)\n```json\n{"chars": '), F.col("n_chars").cast("string"), F.lit("}\n```\n")
    )
    kind = F.col("n_chars") % 3
    docs = load(spark, d, "documents").select(
        "doc_id",
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.col("text"), label))
        .otherwise(F.concat(F.lit("lead\n"), label, F.lit("\n## 清理后的原文内容\n"), F.col("text")))
        .alias("t"),
    )
    return C.split_label_block(docs, "doc_id", "t").select(
        "doc_id", "label_json", F.coalesce("label_ok", F.lit(False)).alias("label_ok"), "body"
    )


@query(
    "doc_26_placeholder_coverage",
    f"""with {MD_SQL},
r as (select md.doc_id, md.md, list_transform(range(1, length(d.text) - length(replace(d.text, chr(10), '')) + 2), lambda i: 'Table_' || i || '_Start') as ids
      from md join documents d using (doc_id)),
f as (select *, list_filter(ids, lambda i: contains(md, '{{{{' || i || '}}}}')) as found from r)
select doc_id, array_to_string(found, ',') as found, array_to_string(list_filter(ids, lambda i: not list_contains(found, i)), ',') as missing,
       len(ids) as total, len(found) as found_count, len(found) = len(ids) as is_valid from f""",
)
def doc_26(spark, d):
    base = load(spark, d, "documents").select(
        "doc_id",
        F.transform(
            F.sequence(F.lit(1), F.regexp_count("text", F.lit("\n")) + 1),
            lambda i: F.concat(F.lit("Table_"), i.cast("string"), F.lit("_Start")),
        ).alias("ids"),
    )
    docs = md_docs(spark, d).join(base, "doc_id")
    return C.placeholder_coverage(docs, "doc_id", "md", "ids").select(
        "doc_id",
        F.array_join("found", ",").alias("found"),
        F.array_join("missing", ",").alias("missing"),
        F.col("total").cast("bigint").alias("total"),
        F.col("found_count").cast("bigint").alias("found_count"),
        "is_valid",
    )
