"""From items to paragraph texts, resource maps, provenance and delivery rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.arrays import let
from leafmill.functions.ordered import PART_ROWS, bucketed_rank, first_by, join_parts
from leafmill.functions.text import base_name, blank, strip, suffix
from leafmill.operators.catalog import below_root
from leafmill.operators.clean import plain_from_markdown, table_open_after
from leafmill.operators.rollup import first_error
from leafmill.operators.spans import state_before
from leafmill.session import cut_lineage

# Types, labels, syntax.
DOCUMENT_TYPES = ["word", "doc", "docx", "pdf", "excel", "xlsx", "xls", "rtf"]
PLACEHOLDER = r"\{\{[^}]+\}\}"
START_TAG = r"\{\{(?:Table|Image)_\d+_Start\}\}"
SKIPPED_ERROR = "提取阶段失败"
DONE, FAILED = "生成完毕", "生成失败"
PROMPT_FILE = r"^data_extraction_prompt_(?:(.+)_)?([a-z]+)_[^_]*\.txt$"


def two_phases(items: DataFrame, paragraph: str, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Extraction results first, generation after; failed paragraphs skip generation.

    The items are checkpointed between the phases, so generation never runs
    extraction again. ``generate`` gets the items of sound paragraphs and returns
    ``paragraph, generated_content``; a sound paragraph that it leaves out has an empty text.
    """
    ready = cut_lineage(items)
    failed = first_error(ready, paragraph)
    sound = ready.join(failed.select(paragraph), paragraph, "left_anti")
    texts = generate(sound).select(paragraph, "generated_content")
    good = (
        sound.select(paragraph).distinct().join(texts, paragraph, "left")
        .select(paragraph, F.coalesce("generated_content", F.lit("")).alias("generated_content"), F.lit("success").alias("status"))
    )
    bad = failed.select(
        paragraph,
        F.lit("").alias("generated_content"),
        F.lit("error").alias("status"),
        F.coalesce("error", F.lit(SKIPPED_ERROR)).alias("error"),
    )
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


def reference_text(items: DataFrame, paragraph: str) -> DataFrame:
    """Successful document items with their quote line, blank line between, in parts; every paragraph has one."""
    used = items.where(
        (F.col("status") == "success") & (F.coalesce("content", F.lit("")) != "") & F.coalesce("data_type", F.lit("word")).isin(DOCUMENT_TYPES)
    )
    quoted = F.when(
        F.coalesce("quote", F.lit("")) != "", F.concat(F.lit("【"), F.col("quote"), F.lit("】\n"), F.col("content"))
    ).otherwise(F.col("content"))
    return with_empty(join_parts(used.withColumn("content", quoted), [paragraph], "ord", "content", "\n\n"), items, paragraph)


def without_markers(content: Column) -> Column:
    """Item text without source, sheet and rule lines and without invented tags."""
    c = F.regexp_replace(content, r"(?md)^##\s*Source:.*$", "")
    c = F.regexp_replace(c, r"(?md)^###\s*Sheet:\s*.+\n?", "")
    c = F.regexp_replace(c, r"(?md)^\s*---\s*\n?", "")
    c = F.regexp_replace(c, r"(?md)^##\s*来源:\s*.+\n?", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"\{\{ORIGINAL_CONTENT:[^}]*\}\}", ""))


def with_empty(parts: DataFrame, items: DataFrame, paragraph: str) -> DataFrame:
    """Part 0 with an empty text for every paragraph of ``items`` that has no text."""
    missing = items.select(paragraph).distinct().join(parts.select(paragraph), paragraph, "left_anti")
    return parts.unionByName(missing.select(paragraph, F.lit(0).alias("part"), F.lit("").alias("content")))


def direct_text(items: DataFrame, files: DataFrame, paragraph: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Paragraph text without a model, in parts that join with a line break; every paragraph has one.

    Cleaned item texts, then (for inserting paragraphs) the file placeholders.
    ``items``: paragraph, ord, status, content, insert_original; ``files``:
    paragraph, ord, placeholder. The measured service also strips tags when not
    inserting, but with a pattern that never matches, so nothing is stripped.
    """
    good = items.where("status = 'success'")
    texts = good.withColumn("content", without_markers(F.col("content"))).where("content <> ''").select(
        paragraph, F.lit(0).alias("section"), "ord", "content"
    )
    inserting = items.groupBy(paragraph).agg(F.bool_or("insert_original").alias("_in")).where("_in").select(paragraph)
    tags = files.join(inserting, paragraph, "left_semi").where("placeholder <> ''").select(
        paragraph, F.lit(1).alias("section"), "ord", F.col("placeholder").alias("content")
    )
    placed = bucketed_rank(
        texts.unionByName(tags),
        [paragraph],
        ["section", "ord"],
        F.struct("section", F.floor(F.col("ord") / PART_ROWS).alias("b")),
        "nth",
        counted=items.select(paragraph).unionByName(files.select(paragraph)),
    )
    # an HTML table may begin in one row and end in another; blank lines go, so rows meet with one line break
    placed = state_before(placed, paragraph, "nth", table_open_after(F.col("content")), "_inside")
    tidy = placed.withColumn("content", plain_from_markdown(strip(F.col("content")), F.col("_inside"))).where("content <> ''")
    return with_empty(join_parts(tidy, [paragraph], "nth", "content", "\n", part_rows), items, paragraph)


def append_placeholders(texts: DataFrame, files: DataFrame, tags: DataFrame, paragraph: str) -> DataFrame:
    """Model text plus file placeholders (order and repeats kept) plus distinct tags (sorted), in parts.

    ``texts``: paragraph, content, insert_original; ``files``: paragraph, ord,
    placeholder; ``tags``: paragraph, placeholder.
    """
    into = texts.where("insert_original").select(paragraph)
    body = texts.select(paragraph, F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("tag"), "content")
    tail1 = files.join(into, paragraph, "left_semi").select(
        paragraph, F.lit(1).alias("section"), F.col("ord").cast("bigint").alias("ord"), F.lit("").alias("tag"), F.col("placeholder").alias("content")
    )
    tail2 = (
        tags.select(paragraph, "placeholder")
        .distinct()
        .join(into, paragraph, "left_semi")
        .select(paragraph, F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("ord"), F.col("placeholder").alias("tag"), F.col("placeholder").alias("content"))
    )
    rows = body.unionByName(tail1).unionByName(tail2)
    firsts = rows.groupBy(paragraph, "section").agg(F.min(F.struct("ord", "tag")).alias("_first"))
    tile = F.struct("section", F.floor(F.col("ord") / PART_ROWS).alias("b"), F.substring("tag", 1, 10).alias("t"))
    placed = bucketed_rank(rows.join(firsts, [paragraph, "section"]), [paragraph], ["section", "ord", "tag"], tile, "nth")
    sep = (
        F.when(F.col("section") == 0, F.lit(""))
        .when(F.struct("ord", "tag") == F.col("_first"), F.lit("\n\n"))
        .otherwise(F.lit("\n"))
    )
    return join_parts(placed.withColumn("content", F.concat(sep, F.col("content"))), [paragraph], "nth", "content", "")


def placeholder_inventory(texts: DataFrame, paragraph: str, content: str) -> DataFrame:
    """Every ``{{...}}`` of a text with its position; repeats are kept."""
    return texts.select(
        paragraph, F.posexplode(F.regexp_extract_all(content, F.lit(PLACEHOLDER), F.lit(0))).alias("pos", "placeholder")
    )


def resource_map(inventory: DataFrame, files: DataFrame, resources: DataFrame, paragraph: str) -> DataFrame:
    """Resource of each placeholder a paragraph uses.

    File placeholders first (the last mapping wins), then resources by label: equal,
    or one side with ``_Start`` or ``_End`` more; the first resource wins. A label
    is looked up under each spelling it may have, so the join is on equality.
    ``files``: paragraph, ord, placeholder, path, source; ``resources``: paragraph,
    ord, label, type, path, source_file.
    """
    used = inventory.select(paragraph, "placeholder").distinct()
    by_file = first_by(
        files.select(paragraph, "placeholder", "ord", "path", "source"), [paragraph, "placeholder"], ["ord"], last=True
    )
    direct = used.join(by_file, [paragraph, "placeholder"]).select(
        paragraph, "placeholder", F.lit("table").alias("type"), "path", F.col("source").alias("source_file")
    )
    label = F.replace(F.replace("placeholder", F.lit("{{"), F.lit("")), F.lit("}}"), F.lit(""))
    bare = lambda end: F.when(F.col("label").endswith(end), F.regexp_replace("label", end + "$", ""))
    spellings = F.array(
        F.col("label"), bare("_Start"), bare("_End"), F.concat("label", F.lit("_Start")), F.concat("label", F.lit("_End"))
    )
    asked = (
        used.join(direct.select(paragraph, "placeholder"), [paragraph, "placeholder"], "left_anti")
        .withColumn("label", label)
        .select(paragraph, "placeholder", F.explode(F.array_distinct(spellings)).alias("label"))
        .where("label is not null")
    )
    hits = asked.join(resources.withColumnRenamed("ord", "res_ord"), [paragraph, "label"])
    best = first_by(
        hits.select(paragraph, "placeholder", "res_ord", "type", "path", "source_file"), [paragraph, "placeholder"], ["res_ord"]
    )
    return direct.unionByName(best.drop("res_ord"))


def run_resource_map(mapping: DataFrame, order: DataFrame, run: str, paragraph: str) -> DataFrame:
    """Run-level map: the last paragraph that uses a placeholder wins.

    ``order``: run, paragraph, para_ord. ``owners`` shows how many paragraphs claim the placeholder.
    """
    won = F.max_by(F.struct("type", "path", "source_file", paragraph), "para_ord")
    placed = mapping.join(order, paragraph).groupBy(run, "placeholder").agg(won.alias("_won"), F.count(F.lit(1)).alias("owners"))
    return placed.select(run, "placeholder", "_won.*", "owners")


def orientation_split(texts: DataFrame, mapping: DataFrame, orientations: DataFrame, paragraph: str, content: str) -> DataFrame:
    """Portrait and landscape placeholders in text order; landscape tags leave the text.

    A placeholder without a mapping or whose file is unknown is portrait.
    """
    inventory = placeholder_inventory(texts, paragraph, content)
    known = mapping.select(paragraph, "placeholder", "path").join(orientations.select("path", "orientation"), "path", "left")
    typed = inventory.join(known, [paragraph, "placeholder"], "left").withColumn(
        "orientation", F.coalesce("orientation", F.lit("portrait"))
    )
    # the group is one text's own placeholders
    grouped = typed.groupBy(paragraph).agg(F.sort_array(F.collect_list(F.struct("pos", "placeholder", "orientation"))).alias("ps"))
    pick = lambda kind: F.transform(F.filter("ps", lambda p: p["orientation"] == kind), lambda p: p["placeholder"])
    return texts.join(grouped, paragraph, "left").select(
        paragraph,
        F.coalesce(pick("portrait"), F.array().cast("array<string>")).alias("portrait"),
        F.coalesce(pick("landscape"), F.array().cast("array<string>")).alias("landscape"),
        F.when(F.col("ps").isNull(), F.col(content))
        .otherwise(F.aggregate(pick("landscape"), F.col(content), lambda t, p: F.replace(t, p, F.lit(""))))
        .alias("body"),
    )


def provenance_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Query, text, the data used and the source of each successful item.

    ``chunks_file`` and ``source_file`` may be arrays or comma lists; the first entry counts.
    """
    kind = F.lower(F.coalesce("data_type", F.lit("")))
    is_doc, is_sheet = kind.isin("word", "pdf"), kind.isin("excel", "rtf")
    source = below_root(strip(F.split(F.coalesce(F.get("source_files", F.lit(0)), F.lit("")), ",")[0]))
    used = F.struct(
        F.when(is_doc, "chunk").when(is_sheet, "sheet").alias("kind"),
        F.when(is_doc, below_root(F.get("chunks_files", F.lit(0)))).alias("structured_chunks_file"),
        F.when(is_doc, F.get("sections", F.lit(0))).alias("section_id"),
        F.when(is_doc, F.get("titles", F.lit(0))).alias("title"),
        F.when(is_sheet, F.get("sheets", F.lit(0))["sheet_name"]).alias("sheet_name"),
        F.when(is_sheet & (F.size("sheets") > 0), F.lit(1)).alias("sheet_index"),
        F.when(is_sheet, below_root(F.get("sheets", F.lit(0))["md_file"])).alias("markdown_path"),
    )
    return items.where("status = 'success'").select(
        *keys,
        F.coalesce("extract", F.lit("")).alias("extract_item"),
        F.col("content").alias("extract_text"),
        used.alias("used_data"),
        F.struct(
            F.when(source == "", F.lit("")).otherwise(base_name(source)).alias("name"),
            source.alias("path"),
            F.when(is_doc, "word").when(is_sheet, "excel").otherwise(kind).alias("type"),
        ).alias("data_source"),
    )


def item_prompt_files(items: DataFrame, prompt_files: DataFrame, paragraph: str) -> DataFrame:
    """Prompt files of each item: those named for its paragraph and type, else those of the type.

    ``items``: paragraph, item_no, type; ``prompt_files``: name, mtime.
    """
    named = prompt_files.select(
        "name",
        F.nullif(F.regexp_extract("name", PROMPT_FILE, 1), F.lit("")).alias("_pid"),
        F.nullif(F.regexp_extract("name", PROMPT_FILE, 2), F.lit("")).alias("type"),
    ).where("type is not null")
    own = items.join(named.where("_pid is not null").withColumnRenamed("_pid", paragraph), [paragraph, "type"]).select(
        paragraph, "item_no", "type", "name", F.lit("paragraph").alias("scope")
    )
    rest = items.join(own.select(paragraph, "item_no").distinct(), [paragraph, "item_no"], "left_anti")
    common = rest.join(named.where("_pid is null").drop("_pid"), "type").select(
        paragraph, "item_no", "type", "name", F.lit("type").alias("scope")
    )
    return own.unionByName(common)


def provenance_document(
    configs: DataFrame, results: DataFrame, items: DataFrame, prompt_files: DataFrame, paragraph: str
) -> DataFrame:
    """One row per configured paragraph: result, generation prompt file (latest by mtime), item counts by class.

    ``configs``: paragraph, generate, example; ``results``: paragraph, status,
    generated_content; ``items``: paragraph, data_type.
    """
    latest = first_by(
        prompt_files.select(
            F.regexp_extract("name", r"^generation_prompt_(.+)_[^_]*\.txt$", 1).alias(paragraph), "mtime", "name"
        ).where(F.col(paragraph) != ""),
        [paragraph],
        ["mtime", "name"],
        last=True,
    ).select(paragraph, F.col("name").alias("generation_prompt_file"))
    inputs = items.groupBy(paragraph).agg(
        F.count_if(F.lower(F.coalesce("data_type", F.lit(""))) == "tfl").alias("tfl_items"),
        F.count_if(F.lower(F.coalesce("data_type", F.lit(""))) != "tfl").alias("scheme_items"),
    )
    return (
        configs.join(results, paragraph, "left")
        .join(latest, paragraph, "left")
        .join(inputs, paragraph, "left")
        .select(
            paragraph,
            "status",
            F.coalesce("generated_content", F.lit("")).alias("generated_content"),
            "generate",
            "example",
            "generation_prompt_file",
            F.coalesce("scheme_items", F.lit(0)).alias("scheme_items"),
            F.coalesce("tfl_items", F.lit(0)).alias("tfl_items"),
        )
    )


def items_with_config(items: DataFrame, configs: DataFrame, paragraph: str) -> DataFrame:
    """Item results next to the configured item at the same position."""
    return items.join(configs, [paragraph, "item_no"], "left")


def selection_queue(items: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of table items that wait for a choice."""
    waiting = items.where("lower(data_type) = 'tfl' and status = 'needs_selection'")
    return waiting.select(*keys, F.posexplode("candidates").alias("candidate_no", "candidate"))


def merged_plan(plan_labels: DataFrame, outputs: DataFrame, run: str) -> DataFrame:
    """Start tags of a run: those found in the outputs if any, else the distinct planned ones.

    ``plan_labels``: run, plan_ord, kind, start, end; ``outputs``: run, para_ord,
    content. ``first_seen`` and ``first_pos`` order the rows.
    """
    planned = plan_labels.groupBy(run, "kind", "start", "end").agg(F.min("plan_ord").cast("bigint").alias("first_seen"))
    planned = planned.withColumn("first_pos", F.lit(0).cast("bigint"))
    tags = outputs.select(
        run, "para_ord", F.posexplode(F.regexp_extract_all("content", F.lit(START_TAG), F.lit(0))).alias("pos", "start")
    )
    found = tags.groupBy(run, "start").agg(F.min(F.struct("para_ord", "pos")).alias("at")).select(
        run,
        F.when(F.col("start").startswith("{{Table"), "table").otherwise("image").alias("kind"),
        "start",
        F.lit("").alias("end"),
        F.col("at.para_ord").cast("bigint").alias("first_seen"),
        F.col("at.pos").cast("bigint").alias("first_pos"),
    )
    kept = planned.join(found.select(run).distinct(), run, "left_anti")
    return found.unionByName(kept.select(run, "kind", "start", "end", "first_seen", "first_pos"))


def delivery_manifest(plan: DataFrame, exported: DataFrame, run: str) -> DataFrame:
    """Plan entries with the archive path of their exported file."""
    parent = F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2)
    name = base_name(F.col("path"))
    archive = F.when(
        parent.endswith("_marked"), F.concat(F.lit("datas/data/index/"), parent, F.lit("/"), name)
    ).otherwise(F.concat(F.lit("datas/data/index/"), name))
    return plan.join(exported.select(run, F.col("tag").alias("start"), "path"), [run, "start"]).select(
        run, "kind", F.col("start").alias("id"), archive.alias("path"), "first_seen", "first_pos"
    )


def delivery_files(mappings: DataFrame, known_files: DataFrame, run: str) -> DataFrame:
    """File entries of the manifest: placeholder (or one made from the file name) and archive path.

    Mappings without a path or whose file does not exist are left out; repeats are kept.
    """
    name = base_name(F.col("path"))
    made = F.concat(F.lit("{{TFL_"), F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("}}"))
    usable = mappings.where(~blank(F.col("path"))).join(known_files.select("path"), "path", "left_semi")
    return usable.select(
        run,
        "ord",
        F.when(blank(F.col("placeholder")), made).otherwise(F.col("placeholder")).alias("id"),
        F.concat(F.lit("datas/data/rtf&index/"), name).alias("path"),
    )


def result_payloads(paragraphs: DataFrame, provenance: DataFrame, paragraph: str) -> DataFrame:
    """Outbox row per paragraph; a paragraph without provenance gets an empty list."""
    traced = paragraphs.join(provenance, paragraph, "left")
    ok = F.coalesce("status", F.lit("success")) == "success"
    return traced.select(
        paragraph,
        F.when(ok, DONE).otherwise(FAILED).alias("label"),
        F.to_json(
            F.struct(
                F.col(paragraph).alias("id"),
                F.when(ok, DONE).otherwise(FAILED).alias("status"),
                ok.alias("success"),
                F.coalesce("generated_content", F.lit("")).alias("generated_content"),
                F.coalesce("extracted_items", F.array().cast("array<string>")).alias("extracted_items"),
            )
        ).alias("payload"),
    )


INSERTION = (
    "generation_results array<struct<paragraph_id:string,control_title:string,generated_content:string,content:string,status:string>>,"
    "paragraphs array<struct<paragraph_id:string,control_title:string,generated_content:string,content:string,status:string>>,"
    "resource_mappings map<string,struct<path:string,type:string,source_file:string>>"
)


def insertion_rows(df: DataFrame, key: str, json: str) -> DataFrame:
    """Successful results in the current field names with the placeholders that have a mapping."""
    x = F.from_json(json, INSERTION)
    rows = F.when(F.size(x["generation_results"]) > 0, x["generation_results"]).otherwise(x["paragraphs"])
    flat = df.select(key, F.posexplode(rows).alias("pos", "r"), x["resource_mappings"].alias("m"))
    content = F.coalesce("r.generated_content", "r.content", F.lit(""))
    found = F.regexp_extract_all(content, F.lit(PLACEHOLDER), F.lit(0))
    return flat.where(F.coalesce("r.status", F.lit("success")) == "success").select(
        key,
        "pos",
        F.coalesce("r.control_title", "r.paragraph_id").alias("control_title"),
        content.alias("generated_content"),
        let(found, lambda f: F.filter(f, lambda p: F.coalesce(F.map_contains_key("m", p), F.lit(False)))).alias("placeholders"),
    )


def extraction_resources(mappings: DataFrame, keys: list[str]) -> DataFrame:
    """Placeholder to file, typed by suffix; a later mapping replaces an earlier one."""
    ext = suffix(F.col("path"))
    usable = mappings.where(~blank(F.col("placeholder")) & ~blank(F.col("path")))
    last = first_by(usable.select(*keys, "placeholder", "ord", "path", "source"), [*keys, "placeholder"], ["ord"], last=True)
    return last.select(
        *keys,
        "placeholder",
        "path",
        F.when(ext.isin("xlsx", "xls"), "excel").when(ext.isin("docx", "doc", "rtf"), "table").otherwise("unknown").alias("type"),
        F.coalesce("source", F.lit("")).alias("source_file"),
    )
