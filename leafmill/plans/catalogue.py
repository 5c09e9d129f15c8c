"""Queries of the catalogue family."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions.ordered import large_groups, shifted_rank, whole_rank
from leafmill.operators import catalog as K
from leafmill.plans.family import family
from leafmill.plans.recipes import load
from leafmill.session import shared_dir
from leafmill.sources.keyed import KeyedTable

QUERIES, SQL, query = family()


def text(c):
    return F.col(c).cast("string")


def _paths(spark, d):
    k, i = F.col("doc_id") % 6, text("doc_id")
    p = (
        F.when(k == 0, F.concat(F.lit("C:\\work\\AAA\\project_data\\"), "source", F.lit("\\d"), i, F.lit(".docx")))
        .when(k == 1, F.concat(F.lit("/home/aaa//Preprocessing/d"), i, F.lit(".json")))
        .when(k == 2, F.concat(F.lit("aaa/project_data/"), "source", F.lit("/d"), i))
        .when(k == 3, F.concat(F.lit("/plain/d"), i, F.lit("?.rtf")))
        .when(k == 4, F.concat(F.lit('"out\\AAA/AAA/x'), i, F.lit('"')))
        .otherwise(F.concat(F.lit("d"), i))
    )
    return load(spark, d, "documents").select("doc_id", p.alias("path"))


@query(
    "cat_1_path_forms",
    """with p as (select doc_id, case doc_id % 6 when 0 then 'C:\\work\\AAA\\project_data\\' || source || '\\d' || doc_id || '.docx'
    when 1 then '/home/aaa//Preprocessing/d' || doc_id || '.json' when 2 then 'aaa/project_data/' || source || '/d' || doc_id
    when 3 then '/plain/d' || doc_id || '?.rtf' when 4 then '"out\\AAA/AAA/x' || doc_id || '"' else 'd' || doc_id end as path from documents),
q as (select *, replace(path, '\\', '/') as s from p)
select doc_id, regexp_replace(s, '(?i)^.*?aaa/', '') as relative,
  case when regexp_matches(s, '(?i)aaa/') then 'AAA/' || regexp_replace(ltrim(regexp_replace(s, '(?i)^.*?aaa/', ''), '/'), '/+', '/', 'g') else path end as index_form,
  case when contains(lower(trim(s, '"')), '/aaa/') then regexp_replace(trim(s, '"'), '(?i)^.*?/aaa/', '') when starts_with(lower(trim(s, '"')), 'aaa/') then substr(trim(s, '"'), 5)
    when starts_with(s, '/') then substr(trim(s, '"'), 2) else trim(s, '"') end as insert_form,
  translate(path, '<>:"/\\|?*', '_________') as safe,
  coalesce(nullif(regexp_extract(s, '(?:^|/)project_data/([^/]+)/', 1), ''), 'default') as project
from q""",
)
def cat_1(spark, d):
    p = F.col("path")
    return _paths(spark, d).select(
        "doc_id",
        K.below_root(p).alias("relative"),
        K.index_path(p).alias("index_form"),
        K.insertion_path(p).alias("insert_form"),
        K.safe_name(p).alias("safe"),
        K.project_of(p).alias("project"),
    )


def events(spark, d):
    """Catalogue events: the project is a source, fifty file names per language."""
    i = F.col("doc_id")
    ok = i % 7 != 0
    return load(spark, d, "documents").select(
        F.col("source").alias("project"),
        F.concat("lang", F.lit("_"), (i % 50).cast("string"), F.lit(".docx")).alias("file"),
        F.when(i % 2 == 0, F.concat(F.lit("id"), text("doc_id"))).alias("file_id"),
        F.when(ok, "success").when(i % 14 == 0, "failed").alias("status"),
        i.alias("processed_at"),
        F.concat(F.lit("p/"), text("doc_id"), F.lit(".json")).alias("json_path"),
        F.when(i % 21 == 0, "broken").alias("error_message"),
        F.when(i % 3 == 0, "docx").when(i % 3 == 1, "pdf").alias("file_type"),
    )


EVENTS_SQL = """
ev as (select source as project, lang || '_' || (doc_id % 50) || '.docx' as file, case when doc_id % 2 = 0 then 'id' || doc_id end as file_id,
  case when doc_id % 7 <> 0 then 'success' when doc_id % 14 = 0 then 'failed' end as status, doc_id as processed_at, 'p/' || doc_id || '.json' as json_path,
  case when doc_id % 21 = 0 then 'broken' end as error_message, case doc_id % 3 when 0 then 'docx' when 1 then 'pdf' end as file_type from documents),
cat as (select project, file, coalesce(file_id, sha256(file)) as file_id, status, processed_at,
  case when status = 'success' then json_path end as json_path, case when status = 'success' then null else coalesce(error_message, '处理失败') end as error_message, file_type
  from (select *, row_number() over (partition by project, file order by processed_at desc) as rn from ev) where rn = 1),
pord as (select project, min(processed_at) as project_ord from ev group by project)"""


def catalog(spark, d):
    e = events(spark, d)
    return K.upsert(
        e.withColumn("status", F.coalesce("status", F.lit("unknown"))).withColumn("file_id", K.file_key(F.col("file_id"), F.col("file"))),
        ["project", "file"],
        ["processed_at"],
    ).withColumn("status", F.when(F.col("status") != "unknown", F.col("status")))


def stored_catalog(spark, d):
    """The catalogue as a table laid out by key, filled by two upserts: a first load, then a late batch."""
    shaped = events(spark, d).withColumn("status", F.coalesce("status", F.lit("unknown"))).withColumn("file_id", K.file_key(F.col("file_id"), F.col("file")))
    first, late = (K.upsert(shaped.where(c), ["project", "file"], ["processed_at"]) for c in ("processed_at % 5 <> 0", "processed_at % 5 = 0"))
    store = KeyedTable(spark, f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}", first.schema, ["project", "file"], slots=16, buckets=8)
    store.upsert(first, ["processed_at"])
    store.upsert(late, ["processed_at"])
    return store.rows().withColumn("status", F.when(F.col("status") != "unknown", F.col("status")))


def ordered_catalog(spark, d):
    first_seen = events(spark, d).groupBy("project").agg(F.min("processed_at").alias("project_ord"))
    return catalog(spark, d).join(first_seen, "project")


@query("cat_2_upsert", f"with {EVENTS_SQL} select project, file, file_id, status, processed_at, json_path, error_message, file_type from cat")
def cat_2(spark, d):
    return catalog(spark, d).select("project", "file", "file_id", "status", "processed_at", "json_path", "error_message", "file_type")


@query("cat_2_stored_upsert", SQL["cat_2_upsert"])
def cat_2_stored(spark, d):
    return stored_catalog(spark, d).select("project", "file", "file_id", "status", "processed_at", "json_path", "error_message", "file_type")


def asked(spark, d):
    i = F.col("doc_id")
    return load(spark, d, "documents").select(
        i.alias("req"),
        F.concat(F.lit("src"), (i % 23).cast("string")).alias("project"),
        F.concat("lang", F.lit("_"), (i % 60).cast("string"), F.lit(".docx")).alias("file"),
    )


ASKED_SQL = "asked as (select doc_id as req, 'src' || (doc_id % 23) as project, lang || '_' || (doc_id % 60) || '.docx' as file from documents)"


@query(
    "cat_3_lookup",
    f"""with {EVENTS_SQL}, {ASKED_SQL}
select a.req, a.project, a.file, c.json_path as found_path from asked a left join cat c on c.project = a.project and c.file = a.file and c.status = 'success'""",
)
def cat_3(spark, d):
    return K.lookup(asked(spark, d), catalog(spark, d)).select("req", "project", "file", "found_path")


@query("cat_3_stored_lookup", SQL["cat_3_lookup"])
def cat_3_stored(spark, d):
    return K.lookup(asked(spark, d), stored_catalog(spark, d)).select("req", "project", "file", "found_path")


@query(
    "cat_3_lookup_any_project",
    f"""with {EVENTS_SQL}, {ASKED_SQL},
f as (select c.*, row_number() over (partition by file order by project_ord, project) as rn from cat c join pord using (project))
select a.req, a.file, f.project as found_project, f.status as found_status, f.json_path as found_path from asked a left join f on f.file = a.file and f.rn = 1""",
)
def cat_3_any(spark, d):
    return K.lookup_any_project(asked(spark, d), ordered_catalog(spark, d)).select(
        "req", "file", "found_project", "found_status", "found_path"
    )


@query(
    "cat_4_search",
    f"""with {EVENTS_SQL} select p.pattern, project, file from cat join (values ('FR_1'), ('2.docx'), ('zz')) p(pattern) on contains(lower(file), lower(p.pattern))""",
)
def cat_4(spark, d):
    return K.search(catalog(spark, d), ["FR_1", "2.docx", "zz"]).select("pattern", "project", "file")


@query(
    "cat_5_delete_and_list",
    f"""with {EVENTS_SQL} select project, count(*) as files from cat c
where not exists (select 1 from ev e where e.project = c.project and e.file = c.file and e.processed_at % 10 = 3) group by project""",
)
def cat_5(spark, d):
    gone = events(spark, d).where("processed_at % 10 = 3").select("project", "file")
    return K.files_per_project(K.delete(catalog(spark, d), gone, ["project", "file"]))


@query(
    "cat_6_statistics",
    f"""with {EVENTS_SQL}
select case when grouping(t) = 0 then 'type' when grouping(s) = 0 then 'status' else 'total' end as grain, coalesce(t, s, 'all') as value, count(*) as files, max(processed_at) as last_updated
from (select coalesce(file_type, 'unknown') as t, coalesce(status, 'unknown') as s, processed_at from cat) group by grouping sets ((t), (s), ())""",
)
def cat_6(spark, d):
    return K.statistics(catalog(spark, d))


@query(
    "cat_6_mapping_statistics",
    f"""with {EVENTS_SQL} select count(distinct project) as total_projects, count(*) as total_files, count(*) filter (where status = 'success') as success_files,
  count(*) filter (where status is distinct from 'success') as failed_files, max(processed_at) as last_updated from cat""",
)
def cat_6_mapping(spark, d):
    return K.mapping_statistics(catalog(spark, d)).select(
        "total_projects", *[F.col(c).cast("bigint").alias(c) for c in ("total_files", "success_files", "failed_files", "last_updated")]
    )


# Enrichment: file names up to 140 per language; the catalogue knows the first 50, the index some, packages the rest.
def file_names(spark, d):
    i = F.col("doc_id")
    return load(spark, d, "documents").select(
        i.alias("item"), F.concat("lang", F.lit("_"), (i % 140).cast("string"), F.lit(".docx")).alias("file")
    )


def packages(spark, d):
    i, n = F.col("doc_id"), (F.col("doc_id") % 130).cast("string")
    name = F.concat("lang", F.lit("_"), n, F.lit(".docx"))
    k = i % 4
    return load(spark, d, "documents").select(
        F.when(k == 0, F.concat(F.lit("AAA/in/"), name))
        .when(k == 1, F.concat(F.lit("AAA/in/copy_"), name, F.lit("/body")))
        .otherwise(F.concat(F.lit("AAA/in/x"), text("doc_id")))
        .alias("source_file"),
        F.when(k == 2, F.concat("lang", F.lit("_"), n)).when(k == 3, name).otherwise(F.lit("none")).alias("package_dir"),
        F.concat(F.lit("q/"), text("doc_id"), F.lit(".json")).alias("json_path"),
    )


@query(
    "cat_7_enrichment",
    f"""with {EVENTS_SQL},
names as (select doc_id as item, lang || '_' || (doc_id % 140) || '.docx' as file from documents),
idx as (select lang || '_' || (doc_id % 70) || '.docx' as file, min('i/' || doc_id || '.json') as json_path from documents where doc_id % 2 = 0 group by 1),
pk as (select 'q/' || doc_id || '.json' as json_path,
  case doc_id % 4 when 0 then 'AAA/in/' || lang || '_' || (doc_id % 130) || '.docx' when 1 then 'AAA/in/copy_' || lang || '_' || (doc_id % 130) || '.docx/body' else 'AAA/in/x' || doc_id end as source_file,
  case doc_id % 4 when 2 then lang || '_' || (doc_id % 130) when 3 then lang || '_' || (doc_id % 130) || '.docx' else 'none' end as package_dir from documents),
c as (select file, json_path from (select c.*, row_number() over (partition by file order by project_ord, project) as rn from cat c join pord using (project) where status = 'success') where rn = 1),
files as (select distinct file from names),
hits as (select f.file, case when string_split(p.source_file, '/')[-1] = f.file then 1 when contains(p.source_file, f.file) then 2 when p.package_dir = regexp_replace(f.file, '\\.[^.]*$', '') then 3 else 4 end as rule, p.json_path
  from files f join pk p on contains(p.source_file, f.file) or p.package_dir = f.file or p.package_dir = regexp_replace(f.file, '\\.[^.]*$', '')),
scan as (select file, rule, json_path from (select *, row_number() over (partition by file order by rule, json_path) as rn from hits) where rn = 1)
select n.item, n.file, case when c.file is not null then 'catalogue' when i.file is not null then 'index' when s.file is not null then 'scan_' || s.rule end as via,
  coalesce(c.json_path, i.json_path, s.json_path) as json_path
from names n left join c using (file) left join idx i using (file) left join scan s using (file)""",
)
def cat_7(spark, d):
    docs = load(spark, d, "documents")
    index = docs.where("doc_id % 2 = 0").select(
        F.concat("lang", F.lit("_"), (F.col("doc_id") % 70).cast("string"), F.lit(".docx")).alias("file"),
        F.concat(F.lit("i/"), text("doc_id"), F.lit(".json")).alias("json_path"),
    )
    names = file_names(spark, d)
    found = K.resolve_files(names, ordered_catalog(spark, d), index, packages(spark, d))
    return K.enrich(names, found).select("item", "file", "via", "json_path")


# Matches of an item: an order is the item, its line items are files.
def matches(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").where("l_orderkey is not null")
    large = large_groups(li, ["l_orderkey"])
    per_file = lambda rows: rows.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("state"))
    # a file's position inside its item: keys are already distinct, so order by them
    rank = ["l_orderkey"], ["l_partkey", "l_suppkey"], F.floor(F.col("l_partkey") / 1000)
    # one shuffle by item serves both steps; items too large for a task are found before and go their own way
    whole = whole_rank(per_file(li.join(large, "l_orderkey", "left_anti").repartition("l_orderkey")), *rank)
    ranked = whole.unionByName(shifted_rank(per_file(li.join(large, "l_orderkey", "left_semi")), *rank)).withColumn("item", F.col("l_orderkey"))
    key = F.concat_ws("_", text("l_partkey"), text("l_suppkey"))
    kind = F.when(F.col("flag") == "A", "docx").when(F.col("flag") == "N", "xlsx").otherwise("pdf")
    region = lambda label, path: F.struct(F.lit(label).alias("label"), path.alias("path"))
    return ranked.select(
        "item",
        "ord",
        "state",
        kind.alias("file_type"),
        F.concat(F.lit("pk/"), key, F.lit("/package.json")).alias("json_path"),
        F.concat(F.lit("src/"), key).alias("source_file"),
        F.when(F.col("state") == "O", F.concat(F.lit("C:\\x\\AAA\\c\\"), key, F.lit("_chunks.json")))
        .otherwise(F.concat(F.lit("c"), key, F.lit(".json")))
        .alias("structured_chunks_file"),
        F.array(
            region("Table_1", F.lit("t1.docx")),
            region("Image_2_Start", F.concat(F.lit("AAA/img/"), key)),
            region("Sheet_1", F.lit("s")),
            region("Table_9_End", F.lit("")),
        ).alias("regions"),
        F.concat(F.lit("pk/"), text("l_suppkey"), F.lit("/markdown")).alias("markdown_dir"),
    )


MATCH_SQL = """
pf as (select l_orderkey as item, l_partkey, l_suppkey, min(l_returnflag) as flag, min(l_linestatus) as state from lineitem group by all),
m as (select *, row_number() over (partition by item order by l_partkey, l_suppkey) as ord, case flag when 'A' then 'docx' when 'N' then 'xlsx' else 'pdf' end as file_type,
  l_partkey || '_' || l_suppkey as k, case when flag = 'N' then 'table' else 'document' end as family from pf),
lead as (select item, min(family) as family from m group by item),
docs as (select m.* from m join lead using (item, family) where family = 'document'),
tabs as (select m.* from m join lead using (item, family) where family = 'table')"""


def manifest(spark, d):
    """Existing files: some chunk files in both forms, regions beside packages, sheets of most suppliers."""
    li = load(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    key = F.concat_ws("_", text("l_partkey"), text("l_suppkey"))
    p, sheets = F.col("l_partkey"), F.concat(F.lit("pk/"), text("l_suppkey"), F.lit("/markdown/"))
    # files of a pair bear its key, those of a supplier its number: distinct pairs and suppliers give distinct paths
    of_pair = li.distinct().select(
        F.explode(
            F.array(
                F.when(p % 3 == 0, F.concat(F.lit("AAA/c/"), key, F.lit("_chunks_structured.json"))),
                F.when(p % 2 == 0, F.concat(F.lit("AAA/c/"), key, F.lit("_chunks.json"))),
                F.when(p % 2 == 1, F.concat(F.lit("pk/"), key, F.lit("/c"), key, F.lit(".json"))),
                F.when(p % 5 < 2, F.concat(F.lit("pk/"), key, F.lit("/t1.docx"))),
                F.when(p % 4 == 0, F.concat(F.lit("AAA/img/"), key)),
            )
        ).alias("path")
    )
    of_supplier = li.select("l_suppkey").distinct().select(
        F.explode(
            F.array(
                F.when(F.col("l_suppkey") % 3 != 0, F.concat(sheets, F.lit("s1.md"))),
                F.when(F.col("l_suppkey") % 2 != 0, F.concat(sheets, F.lit("s2.md"))),
            )
        ).alias("path")
    )
    shared = li.where(p % 5 == 2).select(F.lit("pk/regions_word/t1.docx").alias("path")).distinct()
    return of_pair.unionByName(of_supplier).unionByName(shared).where("path is not null")


CHUNKS_SQL = MATCH_SQL + """,
cf as (select item, ord, file_type, 'src/' || k as source_file, case when state = 'O' then case when l_partkey % 3 = 0 then 'AAA/c/' || k || '_chunks_structured.json' when l_partkey % 2 = 0 then 'AAA/c/' || k || '_chunks.json' end
    when l_partkey % 2 = 1 then 'pk/' || k || '/c' || k || '.json' end as chunks_file from docs)"""


@query("cat_8_document_files", f"with {CHUNKS_SQL} select item, ord, chunks_file, source_file, file_type from cf where chunks_file is not null")
def cat_8(spark, d):
    return K.document_files(matches(spark, d), "item", manifest(spark, d))


@query(
    "cat_8_document_groups",
    f"""with {CHUNKS_SQL}
select item, (ord - 1) // 512 as part, arg_min(file_type, ord) as file_type, string_agg(chunks_file, ',' order by ord) as chunks_files, string_agg(source_file, ', ' order by ord) as source_file
from cf where chunks_file is not null group by item, (ord - 1) // 512""",
)
def cat_8_groups(spark, d):
    return K.document_groups(K.document_files(matches(spark, d), "item", manifest(spark, d), parts=True), "item").withColumn("part", F.col("part").cast("bigint"))


@query(
    "cat_8_region_resources",
    f"""with {MATCH_SQL}, has as (select exists (select 1 from lineitem where l_partkey % 5 = 2) as shared)
select item, ord, 'Table_1_Start' as label, 'table' as type, case when l_partkey % 5 < 2 then 'pk/' || k || '/t1.docx' else 'pk/regions_word/t1.docx' end as path, 'src/' || k as source_file
from docs, has where l_partkey % 5 < 2 or has.shared
union all select item, ord, 'Image_2_Start', 'image', 'AAA/img/' || k, 'src/' || k from docs where l_partkey % 4 = 0""",
)
def cat_8_regions(spark, d):
    return K.region_resources(matches(spark, d), "item", manifest(spark, d)).drop("region_no")


@query(
    "cat_9_table_groups",
    f"""with {MATCH_SQL}, dirs as (select item, l_suppkey, min(ord) as dir_ord from tabs group by item, l_suppkey),
f as (select l_suppkey, u.s from (select distinct l_suppkey from lineitem) x, (values (1), (2)) u(s) where (u.s = 1 and l_suppkey % 3 <> 0) or (u.s = 2 and l_suppkey % 2 <> 0))
select item, dir_ord, 'pk/' || l_suppkey || '/markdown' as markdown_dir, 'pk/' || l_suppkey || '/markdown/s' || s || '.md' as markdown_file from dirs join f using (l_suppkey)""",
)
def cat_9(spark, d):
    return K.table_groups(matches(spark, d), "item", manifest(spark, d))


@query("cat_9_table_sources", f"with {MATCH_SQL} select item, 'src/' || k as source_file, min(ord) as first_ord from tabs group by item, k")
def cat_9_sources(spark, d):
    return K.table_sources(matches(spark, d), "item")


@query(
    "cat_10_type_pick",
    """with it as (select doc_id as item, case doc_id % 6 when 0 then '原文' when 1 then 'pdf' when 2 then 'excel' when 3 then 'rtf' when 4 then 'XLS' else 'zip' end as item_type from documents),
pk as (select 'q/' || doc_id || '.json' as json_path, case doc_id % 5 when 0 then 'docx' when 1 then 'PDF' when 2 then 'xlsx' when 3 then 'rtf' end as file_type,
  'in/' || source || case when doc_id % 9 = 4 then '_pdf' when doc_id % 9 = 5 then '_xls' else '' end as source_file from documents where doc_id % 11 <> 0),
syn as (select * from (values ('原文', 'word'), ('原文', 'doc'), ('原文', 'docx'), ('pdf', 'pdf'), ('excel', 'excel'), ('excel', 'xlsx'), ('rtf', 'rtf'), ('rtf', 'excel'), ('XLS', 'xls'), ('zip', 'zip')) s(item_type, wanted)),
c as (select distinct s.item_type, p.* from syn s join pk p on contains(lower(p.file_type), s.wanted) or contains(s.wanted, lower(p.file_type))),
best as (select * from (select *, row_number() over (partition by item_type order by case when contains(lower(source_file), lower(item_type)) then 0 else 1 end, json_path) as rn from c) where rn = 1)
select it.item, it.item_type, b.json_path, b.source_file, b.file_type from it left join best b using (item_type)""",
)
def cat_10(spark, d):
    i = F.col("doc_id")
    docs = load(spark, d, "documents")
    items = docs.select(
        i.alias("item"),
        F.when(i % 6 == 0, "原文").when(i % 6 == 1, "pdf").when(i % 6 == 2, "excel").when(i % 6 == 3, "rtf").when(i % 6 == 4, "XLS").otherwise("zip").alias("item_type"),
    )
    pk = docs.select(
        F.concat(F.lit("q/"), text("doc_id"), F.lit(".json")).alias("json_path"),
        F.when(i % 5 == 0, "docx").when(i % 5 == 1, "PDF").when(i % 5 == 2, "xlsx").when(i % 5 == 3, "rtf").alias("file_type"),
        F.concat(F.lit("in/"), "source", F.when(i % 9 == 4, "_pdf").when(i % 9 == 5, "_xls").otherwise("")).alias("source_file"),
        F.when(i % 11 != 0, F.lit("c.json")).alias("chunks_file"),
    )
    return K.pick_by_type(items, pk).select("item", "item_type", "json_path", "source_file", "file_type")


@query(
    "cat_11_unfinished_files",
    """select 'd/' || doc_id as path, sha256(text) as sha256, n_chars from documents where not (doc_id % 3 = 0 and doc_id % 5 <> 0)""",
)
def cat_11(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), text("doc_id")).alias("path"), F.sha2("text", 256).alias("sha256"), "n_chars")
    done = docs.where("doc_id % 3 = 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("sha256")))
    return K.unfinished(docs, done).select("path", "sha256", "n_chars")


@query("cat_11_stored_unfinished", SQL["cat_11_unfinished_files"])
def cat_11_stored(spark, d):
    """As above; the finished packages are a table laid out by path and hash, of which the join moves nothing."""
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("d/"), text("doc_id")).alias("path"), F.sha2("text", 256).alias("sha256"), "n_chars")
    done = docs.where("doc_id % 3 = 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("sha256"))
    store = KeyedTable(spark, f"{shared_dir(spark)}/finished-{uuid.uuid4().hex}", done.schema, ["path", "sha256"], slots=16, buckets=8)
    store.upsert(done.distinct(), ["path"])
    return K.unfinished(docs, store.rows()).select("path", "sha256", "n_chars")


@query(
    "cat_12_file_placeholders",
    """select doc_id, '{{TFL_' || source || '.v' || doc_id || '}}' as placeholder, case doc_id % 3 when 0 then 'AAA/in/' || source || '.v' || doc_id || '.rtf' when 1 then 'AAA/in/' || source || '.v' || doc_id || '.rtf' else '/base/data/x.xlsx' end as path,
  source || '.v' || doc_id || case when doc_id % 3 = 2 then '.xlsx' else '.rtf' end as source from documents""",
)
def cat_12(spark, d):
    name = F.concat("source", F.lit(".v"), text("doc_id"))
    k = F.col("doc_id") % 3
    src = (
        F.when(k == 0, F.concat(F.lit("AAA\\in\\"), name, F.lit(".rtf")))
        .when(k == 1, F.concat(F.lit("/AAA/in/"), name, F.lit(".rtf")))
        .otherwise(F.concat(F.lit('{"'), name, F.lit('.xlsx": "data/x.xlsx"}')))
    )
    return load(spark, d, "documents").select(
        "doc_id", F.explode(K.file_placeholders(src, base="/base/")).alias("m")
    ).select("doc_id", "m.placeholder", "m.path", "m.source")
