"""Catalogue of processed files: paths, upsert, lookup, search, statistics, enrichment."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.arrays import let
from leafmill.functions.joins import substring_join
from leafmill.functions.ordered import first_by, join_parts, part_of
from leafmill.functions.text import base_name, stem, strip

# Root marker, default texts, type families.
ROOT = "AAA"
PROJECT_FOLDER = "project_data"
DEFAULT_PROJECT = "default"
DEFAULT_ERROR = "处理失败"
ILLEGAL_NAME_CHARS = '<>:"/\\|?*'
DOCUMENT_TYPES = ["word", "doc", "docx", "pdf"]
TABLE_TYPES = ["excel", "xlsx", "rtf"]
#: Shapes of paths are told apart by a number below this.
SHAPE_SLOTS = 1 << 16
TYPE_SYNONYMS = {
    "方案": ["word", "doc", "docx"],
    "伦理资料": ["word", "doc", "docx"],
    "原文": ["word", "doc", "docx"],
    "pdf": ["pdf"],
    "excel": ["excel", "xlsx"],
    "rtf": ["rtf", "excel"],
}


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def below_root(path: Column, root: str = ROOT) -> Column:
    """Path after the first ``<root>/`` in any case; unchanged without it."""
    return F.regexp_replace(slashes(path), f"(?i)^.*?{root}/", "")


def index_path(path: Column, root: str = ROOT) -> Column:
    """``<root>/<rest>``; a path without the root marker stays as it was written."""
    rest = F.regexp_replace(F.regexp_replace(below_root(path, root), "^/+", ""), "/{2,}", "/")
    return F.when(slashes(path).rlike(f"(?i){root}/"), F.concat(F.lit(f"{root}/"), rest)).otherwise(path)


def insertion_path(path: Column, root: str = ROOT) -> Column:
    """Path below the root folder without quotes or a leading slash."""
    bare = F.regexp_replace(strip(slashes(path)), "^[\"']+|[\"']+$", "")
    low = F.lower(bare)
    return (
        F.when(F.contains(low, F.lit(f"/{root.lower()}/")), F.regexp_replace(bare, f"(?i)^.*?/{root}/", ""))
        .when(low.startswith(f"{root.lower()}/"), F.substring(bare, len(root) + 2, 2147483647))
        .otherwise(F.regexp_replace(bare, "^/", ""))
    )


def safe_name(name: Column) -> Column:
    return F.translate(name, ILLEGAL_NAME_CHARS, "_" * len(ILLEGAL_NAME_CHARS))


def project_of(path: Column) -> Column:
    found = F.regexp_extract(slashes(path), f"(?:^|/){PROJECT_FOLDER}/([^/]+)/", 1)
    return F.when(found == "", F.lit(DEFAULT_PROJECT)).otherwise(found)


def file_key(file_id: Column, name: Column) -> Column:
    """Given id, else the SHA-256 digest of the name."""
    return F.coalesce(file_id, F.sha2(name, 256))


def upsert(events: DataFrame, keys: Sequence[str], stamp: Sequence[str]) -> DataFrame:
    """Latest event per key. ``max_by`` combines before the shuffle, so hot keys stay small."""
    ok = F.col("status") == "success"
    shaped = events.withColumn(
        "error_message", F.when(~ok, F.coalesce("error_message", F.lit(DEFAULT_ERROR)))
    ).withColumn("json_path", F.when(ok, F.col("json_path")))
    return first_by(shaped, keys, stamp, last=True)


def lookup(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Path for (project, file); only successful entries answer."""
    found = catalog.where("status = 'success'").select("project", "file", F.col("json_path").alias("found_path"))
    return requests.join(found, ["project", "file"], "left")


def lookup_any_project(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Path for a file in the first project (by ``project_ord``) that knows it."""
    first = first_by(
        catalog.select("file", "project", "project_ord", "status", "json_path"), ["file"], ["project_ord", "project"]
    ).select(
        "file",
        F.col("project").alias("found_project"),
        F.col("status").alias("found_status"),
        F.when(F.col("status") == "success", F.col("json_path")).alias("found_path"),
    )
    return requests.join(first, "file", "left")


def search(catalog: DataFrame, patterns: Sequence[str], name: str = "file") -> DataFrame:
    """Case-insensitive substring search for a few given patterns."""
    wanted = F.array(*[F.lit(p) for p in patterns])
    hits = F.filter(wanted, lambda p: F.contains(F.lower(F.col(name)), F.lower(p)))
    return catalog.withColumn("pattern", F.explode(hits))


def delete(catalog: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return catalog.join(removed.select(*keys).distinct(), list(keys), "left_anti")


def files_per_project(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("project").agg(F.count(F.lit(1)).alias("files"))


def statistics(catalog: DataFrame) -> DataFrame:
    """Totals, per type and per status, in one pass over grouping sets."""
    kind = F.coalesce("file_type", F.lit("unknown")).alias("file_type")
    state = F.coalesce("status", F.lit("unknown")).alias("status")
    base = catalog.select(kind, state, "project", "processed_at")
    return (
        base.groupingSets([["file_type"], ["status"], []], "file_type", "status")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if(F.col("status") == "success").alias("_ok"),
            F.max("processed_at").alias("last_updated"),
            F.grouping_id().alias("_g"),
        )
        .select(
            F.when(F.col("_g") == 1, F.lit("type")).when(F.col("_g") == 2, F.lit("status")).otherwise(F.lit("total")).alias("grain"),
            F.coalesce("file_type", "status", F.lit("all")).alias("value"),
            "files",
            "last_updated",
        )
    )


def mapping_statistics(catalog: DataFrame) -> DataFrame:
    """Projects, files, successes; everything that is not a success failed.

    Two levels of combinable sums: no distinct set is built.
    """
    per = catalog.groupBy("project").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "success").alias("ok"),
        F.max("processed_at").alias("last"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("total_projects"),
        F.sum("n").alias("total_files"),
        F.sum("ok").alias("success_files"),
        (F.sum("n") - F.sum("ok")).alias("failed_files"),
        F.max("last").alias("last_updated"),
    )


def resolve_files(names: DataFrame, catalog: DataFrame, index: DataFrame, packages: DataFrame) -> DataFrame:
    """Where each distinct file name is found: ``file, via, json_path``.

    Order: catalogue (success only), index, then packages by rule: same source
    name (1), name inside the source path (2), package folder equals the stem
    (3) or the name (4); ties by path. Only names still open go to the next step.
    """
    files = names.select("file").distinct()
    via_catalog = first_by(
        catalog.where("status = 'success'").select("file", "project_ord", "project", "json_path"),
        ["file"],
        ["project_ord", "project"],
    ).select("file", F.lit("catalogue").alias("via"), "json_path")
    via_index = first_by(index.select("file", "json_path"), ["file"], ["json_path"]).select(
        "file", F.lit("index").alias("_via"), F.col("json_path").alias("_path")
    )
    first = (
        files.join(via_catalog, "file", "left")
        .join(via_index, "file", "left")
        .select("file", F.coalesce("via", "_via").alias("via"), F.coalesce("json_path", "_path").alias("json_path"))
    )
    still = first.where("json_path is null").select("file")
    packs = packages.select(
        F.col("source_file"), base_name(F.col("source_file")).alias("source_name"), "package_dir", F.col("json_path").alias("pack_path")
    )

    def scan(rule, hits):
        return hits.select("file", F.lit(rule).alias("rule"), "pack_path")

    by_stem = still.withColumn("file_stem", stem(F.col("file")))
    hits = (
        scan(1, still.join(packs, still.file == packs.source_name))
        .unionByName(scan(2, substring_join(still, "file", packs.select("source_file", "pack_path"), "source_file")))
        .unionByName(scan(3, by_stem.join(packs, by_stem.file_stem == packs.package_dir)))
        .unionByName(scan(4, still.join(packs, still.file == packs.package_dir)))
    )
    best = first_by(hits, ["file"], ["rule", "pack_path"])
    found = best.select("file", F.concat(F.lit("scan_"), F.col("rule").cast("string")).alias("via"), F.col("pack_path").alias("json_path"))
    return first.where("json_path is not null").unionByName(found)


def enrich(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests with what was found; items without a hit stay."""
    return requests.join(resolved, "file", "left")


def _shape_slot(path: Column) -> Column:
    """One of ``SHAPE_SLOTS`` numbers for a path's top folder, depth and short ending, digits alike."""
    top = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1))
    depth = F.length(path) - F.length(F.replace(path, F.lit("/")))
    end = F.substring_index(path, ".", -1)
    return F.pmod(F.xxhash64(top, depth, F.when(F.contains(path, F.lit(".")) & (F.length(end) <= 8), F.translate(end, "123456789", "000000000"))), F.lit(SHAPE_SLOTS))


def _existing(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """The ranked ``paths`` that the manifest knows, one row each: ``rank, path`` beside the other columns.

    Most candidates lie where there are no such files at all; these go before the rows move.
    """
    # outer: else a test that there are paths, with all that makes them, would go down to the rows
    others = [c for c in candidates.columns if c != "paths"]
    flat = candidates.select(*others, F.posexplode_outer(F.array_distinct("paths")).alias("rank", "path")).where("path is not null")
    files = manifest.select(F.col("path").alias("_file"))
    # SHAPE_SLOTS rows at most
    slots = files.where("_file is not null").select(_shape_slot(F.col("_file")).alias("_slot")).distinct()
    likely = flat.join(F.broadcast(slots), _shape_slot(F.col("path")) == F.col("_slot"), "left_semi")
    # Many rows may ask for one path. Over a second key, which is part of no layout, both sides of the
    # join are plain shuffles, and only of such joins does adaptive execution split the large tasks.
    # Without the hint a manifest that comes from an explode, which Spark sizes too low, goes through the driver.
    return likely.join(files.hint("merge"), (F.col("path") == F.col("_file")) & (F.length("path") == F.length("_file")), "left_semi")


def _first_existing(candidates: DataFrame, keys: Sequence[str], manifest: DataFrame, keep: Sequence[str], near: Sequence[str] = ()) -> DataFrame:
    """First of the ranked ``paths`` that the manifest knows, per key, with the ``keep`` columns.

    The columns ride along, so the candidates are computed once. With ``near``, some of the
    keys, the rows lie by these.
    """
    known = _existing(candidates.select(*keys, *keep, "paths"), manifest)
    known = known.repartition(*near) if near else known
    best = known.groupBy(*keys).agg(F.min(F.struct("rank", "path", *keep)).alias("_row"))
    return best.select(*keys, "_row.path", *[f"_row.{c}" for c in keep])


def _structured(path: Column) -> Column:
    end = "_chunks.json"
    return F.when(path.endswith(end), F.concat(F.substring(path, F.lit(1), F.length(path) - len(end)), F.lit("_chunks_structured.json")))


def documents_of(matches: DataFrame) -> DataFrame:
    """Matches with text documents; these always take precedence."""
    return matches.where(F.lower(F.col("file_type")).isin(DOCUMENT_TYPES))


def tables_of(matches: DataFrame, item: str) -> DataFrame:
    """Matches with table files, of items that reach no text document at all."""
    tables = matches.where(F.lower(F.col("file_type")).isin(TABLE_TYPES))
    return tables.join(documents_of(matches).select(item), item, "left_anti")


def document_files(matches: DataFrame, item: str, manifest: DataFrame, parts: bool = False) -> DataFrame:
    """Chunk file of each document match that exists: ``item, ord, chunks_file, source_file, file_type``.

    With ``parts`` there is also ``part``, the part of ``document_groups``, and the rows lie
    by it, so that the groups need no shuffle of their own.
    """
    raw, rooted, beside = F.col("_raw"), F.col("_rooted"), F.col("_beside")
    named = documents_of(matches).withColumn("_raw", slashes(F.col("structured_chunks_file")))
    placed = named.withColumns(
        {
            "_rooted": F.when(raw.rlike(f"(?i){ROOT}/"), index_path(raw)),
            "_beside": F.concat(F.regexp_replace("json_path", "/[^/]*$", ""), F.lit("/"), raw),
        }
    )
    ranked = placed.withColumn("paths", F.array(_structured(rooted), rooted, _structured(raw), raw, _structured(beside), beside))
    keys, near = ([item, "ord", "part"], [item, "part"]) if parts else ([item, "ord"], [])
    found = _first_existing(ranked.withColumn("part", part_of(F.col("ord"))), keys, manifest, ["source_file", "file_type"], near)
    return found.select(item, "ord", F.col("path").alias("chunks_file"), "source_file", "file_type", *near[1:])


def document_groups(files: DataFrame, item: str) -> DataFrame:
    """Chunk files and sources of an item in order, in parts (``ord`` is 1-based).

    The type is that of the item's first file, in every part. Files that have their ``part``
    already and lie by it are not shuffled for it.
    """
    both = files.withColumn("pair", F.concat_ws("\u0001", "chunks_file", "source_file"))
    part = F.col("part") if "part" in files.columns else None
    joined = join_parts(both, [item], "ord", "pair", "\u0002", extra=[F.min_by("file_type", "ord").alias("file_type")], part=part)
    pairs = F.split("pair", "\u0002")
    by_part = Window.partitionBy(item).orderBy("part")
    return joined.select(
        item,
        "part",
        F.first("file_type").over(by_part).alias("file_type"),
        F.array_join(F.transform(pairs, lambda p: F.split(p, "\u0001")[0]), ",").alias("chunks_files"),
        F.array_join(F.transform(pairs, lambda p: F.split(p, "\u0001")[1]), ", ").alias("source_file"),
    )


def region_resources(matches: DataFrame, item: str, manifest: DataFrame) -> DataFrame:
    """Existing table and image files of the documents: ``item, ord, region_no, label, type, path, source_file``."""
    regions = documents_of(matches).select(
        item, "ord", "source_file", "json_path", F.posexplode("regions").alias("region_no", "r")
    ).where("r.label like 'Table\\_%' or r.label like 'Image\\_%'")
    raw = slashes(F.col("r.path"))
    folder = F.regexp_replace("json_path", "/[^/]*$", "")
    ranked = regions.where("coalesce(r.path, '') <> ''").select(
        item,
        "ord",
        "region_no",
        "source_file",
        F.col("r.label").alias("label"),
        F.array(
            F.when(raw.rlike(f"(?i){ROOT}/"), index_path(raw)),
            raw,
            F.concat(folder, F.lit("/"), raw),
            F.concat(F.regexp_replace(folder, "/[^/]*$", ""), F.lit("/regions_word/"), base_name(raw)),
        ).alias("paths"),
    )
    found = _first_existing(ranked, [item, "ord", "region_no"], manifest, ["label", "source_file"])
    label = F.col("label")
    return found.select(
        item,
        "ord",
        "region_no",
        F.when(label.endswith("_Start") | label.endswith("_End"), label)
        .otherwise(F.concat(label, F.lit("_Start")))
        .alias("label"),
        F.when(label.startswith("Table_"), "table").otherwise("image").alias("type"),
        "path",
        "source_file",
    )


def table_groups(matches: DataFrame, item: str, manifest: DataFrame) -> DataFrame:
    """Markdown files of each distinct directory an item reaches, in first-seen order."""
    dirs = tables_of(matches, item).groupBy(item, "markdown_dir").agg(F.min("ord").alias("dir_ord"))
    files = manifest.where("path like '%.md'").select(
        F.regexp_replace("path", "/[^/]*$", "").alias("markdown_dir"), F.col("path").alias("markdown_file")
    )
    return dirs.join(files, "markdown_dir").select(item, "dir_ord", "markdown_dir", "markdown_file")


def table_sources(matches: DataFrame, item: str) -> DataFrame:
    """Distinct source files of an item, with their first position."""
    tables = tables_of(matches, item).where("coalesce(source_file, '') <> ''")
    return tables.groupBy(item, "source_file").agg(F.min("ord").alias("first_ord"))


def pick_by_type(items: DataFrame, packages: DataFrame) -> DataFrame:
    """Package for each item type: a source that contains the type word, else the first.

    Package types match by substring in either direction. All substring steps go
    through gram joins over distinct values.
    """
    synonyms = F.create_map(*[x for k, v in TYPE_SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    types = items.select("item_type").distinct()
    expected = types.select(
        "item_type",
        F.explode(F.coalesce(F.try_element_at(synonyms, F.col("item_type")), F.array(F.lower("item_type")))).alias("wanted"),
    ).withColumn("wanted", F.lower("wanted"))
    usable = packages.where("chunks_file is not null and coalesce(file_type, '') <> ''").withColumn(
        "kind", F.lower("file_type")
    )
    kinds = usable.select("kind").distinct()
    wanted = expected.select("wanted").distinct()
    fits = (
        substring_join(wanted, "wanted", kinds, "kind")
        .select("wanted", "kind")
        .unionByName(substring_join(kinds, "kind", wanted, "wanted").select("wanted", "kind"))
        .distinct()
    )
    pairs = expected.join(fits, "wanted").select("item_type", "kind").distinct()
    firsts = first_by(usable.select("kind", "json_path", "source_file", "file_type"), ["kind"], ["json_path"])
    any_pick = first_by(
        pairs.join(firsts, "kind").select("item_type", "json_path", "source_file", "file_type"), ["item_type"], ["json_path"]
    ).withColumn("named", F.lit(1))
    named_hits = substring_join(
        types.withColumn("word", F.lower("item_type")),
        "word",
        usable.withColumn("source_low", F.lower("source_file")),
        "source_low",
    ).join(pairs, ["item_type", "kind"])
    named = first_by(
        named_hits.select("item_type", "json_path", "source_file", "file_type"), ["item_type"], ["json_path"]
    ).withColumn("named", F.lit(0))
    best = first_by(any_pick.unionByName(named), ["item_type"], ["named"])
    return items.join(best.drop("named"), "item_type", "left")


def unfinished(manifest: DataFrame, packages: DataFrame, keys: Sequence[str] = ("path", "sha256")) -> DataFrame:
    """Files whose path and content hash have no finished package yet.

    With ``packages`` from a ``KeyedTable`` of these keys, only the manifest is shuffled.
    """
    return manifest.join(packages.select(*keys), list(keys), "left_anti")


def file_placeholders(source: Column, root: str = ROOT, base: str = "") -> Column:
    """``{placeholder, path, source}`` for one source entry: a path, or a JSON object name → path."""
    norm = slashes(source)

    def entry(name, path):
        return F.struct(
            F.concat(F.lit("{{TFL_"), F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("}}")).alias("placeholder"),
            path.alias("path"),
            name.alias("source"),
        )

    plain = F.array(
        entry(F.element_at(F.split(norm, "/"), -1), F.regexp_replace(norm, f"^/({root}/)", "$1"))
    )
    mapped = let(
        F.map_entries(F.from_json(source, "map<string,string>")),
        lambda es: F.transform(
            es,
            lambda e: entry(
                e["key"], F.when(slashes(e["value"]).startswith("/"), e["value"]).otherwise(F.concat(F.lit(base), e["value"]))
            ),
        ),
    )
    return F.when(source.startswith("{"), mapped).otherwise(plain)
