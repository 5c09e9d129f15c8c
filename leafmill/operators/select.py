"""Which chunks matter, what their ids mean, and the text they give."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.ordered import join_parts
from leafmill.functions.text import percent_text, strip

_ENTRY = "struct<section_id:string,chunk_id:string,title:string,relevance_score:double,reason:string>"
RELEVANCE = f"relevant_sections array<{_ENTRY}>, relevant_chunks array<{_ENTRY}>"


def relevant_chunks(df: DataFrame, key: str, json: str) -> DataFrame:
    """Chunks a relevance answer lists: ``rel_ord`` (1-based), requested id, score, reason."""
    r = F.from_json(json, RELEVANCE)
    listed = F.when(F.size(r["relevant_sections"]) > 0, r["relevant_sections"]).otherwise(r["relevant_chunks"])
    return df.select(key, F.posexplode(listed).alias("pos", "c")).select(
        key,
        (F.col("pos") + 1).alias("rel_ord"),
        strip(F.coalesce(F.nullif("c.section_id", F.lit("")), F.col("c.chunk_id"), F.lit(""))).alias("wanted"),
        F.coalesce("c.relevance_score", F.lit(0.0)).alias("score"),
        F.col("c.reason").alias("reason"),
    )


def overlap_ranking(df: DataFrame, key: str, chunks: str, query: Column, k: int) -> DataFrame:
    """Offline relevance: share of query words in title and content, best ``k`` of a document.

    ``chunks`` is the document's own array, so ranking needs no shuffle; ties go
    to the earlier chunk.
    """

    def words(c):
        return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: w != ""))

    asked = words(query)
    scored = F.transform(
        chunks,
        lambda c, i: F.struct(
            (-F.size(F.array_intersect(asked, words(F.concat_ws(" ", c["title"], c["content"])))) / F.greatest(F.size(asked), F.lit(1))).alias("neg"),
            i.alias("pos"),
            c["section_id"].alias("section_id"),
        ),
    )
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["neg"] < 0)), 1, k)
    return df.select(key, F.posexplode(best).alias("rank", "c")).select(
        key, (F.col("rank") + 1).alias("rel_ord"), F.col("c.section_id").alias("wanted"), (-F.col("c.neg")).alias("score")
    )


def resolve_chunks(wanted: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Requested ids matched to chunks; unknown ids drop out.

    ``chunks``: ``key, generation, ord, section_id, ids, title, content``. Current
    documents need the exact id. Legacy ones are known by every id they carry and
    by their 1-based and 0-based number, a later chunk taking over a shared key;
    a request falls back to the part after ``_``, then to its number, then to one less.
    """
    keyed = chunks.select(
        key,
        "ord",
        F.explode(
            F.when(F.col("generation") == "sections", F.array("section_id")).otherwise(
                F.array_distinct(
                    F.filter(
                        F.concat(
                            F.coalesce("ids", F.array().cast("array<string>")),
                            F.array(F.col("ord").cast("string"), (F.col("ord") - 1).cast("string")),
                        ),
                        lambda i: i.isNotNull() & (i != ""),
                    )
                )
            )
        ).alias("id"),
    )
    owners = keyed.groupBy(key, "id").agg(F.max("ord").alias("ord"))
    forms = chunks.groupBy(key).agg(F.any_value("generation").alias("generation"))
    w = F.col("wanted")
    after = F.element_at(F.split(w, "_"), -1)
    number = F.when(after.rlike(r"^\d+$"), after.try_cast("decimal(38,0)"))
    tries = F.when(F.col("generation") == "sections", F.array(w)).otherwise(
        F.array(
            w,
            F.when(F.contains(w, F.lit("_")), after),
            number.cast("string"),
            F.when(number > 0, (number - 1).cast("string")),
        )
    )
    asked = wanted.join(forms, key).select(
        key, "rel_ord", "wanted", "score", F.posexplode(tries).alias("attempt", "id")
    ).where("id is not null")
    hits = asked.join(owners, [key, "id"]).groupBy(key, "rel_ord", "wanted", "score").agg(F.min_by("ord", "attempt").alias("ord"))
    return hits.join(chunks.select(key, "ord", "title", "content"), [key, "ord"])


def selected_text(loaded: DataFrame, key: str) -> DataFrame:
    """Non-empty contents in relevance order, blank line between, in parts."""
    return join_parts(loaded.where("coalesce(content, '') <> ''"), [key], "rel_ord", "content", "\n\n")


def selection_statistics(chunks: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    totals = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_chunks"))
    picked = loaded.groupBy(key).agg(F.count(F.lit(1)).alias("selected_chunks"), F.avg("score").alias("avg_score"))
    out = totals.join(picked, key, "left").withColumn("selected_chunks", F.coalesce("selected_chunks", F.lit(0)))
    return out.select(
        key,
        "total_chunks",
        "selected_chunks",
        percent_text(F.col("selected_chunks"), F.col("total_chunks")).alias("selection_rate"),
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
    )


def load_audit(chunks: DataFrame, key: str) -> DataFrame:
    """What was loaded, without the contents."""
    return chunks.select(
        key,
        "ord",
        "section_id",
        "title",
        F.length("content").alias("content_length"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )
