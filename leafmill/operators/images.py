"""Images written into Markdown as data URIs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.arrays import let, weave
from leafmill.functions.text import strip

# Image syntax, known formats and the labels left behind.
EMBEDDED = r"!\[([^\]]*)\]\(data:image/([^;,]+);base64,([^)]+)\)"
ANY_IMAGE = r"!\[([^\]]*)\]\([^)]+\)"
EXTENSIONS = {
    "jpeg": "jpg",
    "jpg": "jpg",
    "png": "png",
    "gif": "gif",
    "webp": "webp",
    "bmp": "bmp",
    "tiff": "tiff",
    "svg+xml": "svg",
}
IMAGE_LABEL = "图片"
REFERENCE_CHARS = 50


def _extension(fmt: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(known[F.lower(fmt)], F.lit("png"))


def _describe(match: Column, folder: str) -> Column:
    """Struct for one data-URI reference; ``name`` is NULL when it cannot be decoded."""
    alt = F.regexp_extract(match, EMBEDDED, 1)
    alt = F.when(alt == "", F.lit("image")).otherwise(alt)
    ext = _extension(F.regexp_extract(match, EMBEDDED, 2))
    data = F.regexp_replace(strip(F.regexp_extract(match, EMBEDDED, 3)), "[^A-Za-z0-9+/=]", "")
    return let(
        F.try_to_binary(data, F.lit("base64")),
        lambda raw: F.when(
            raw.isNotNull(),
            F.struct(
                F.concat(F.lit("image_"), F.substring(F.md5(raw), 1, 12), F.lit("."), ext).alias("name"),
                F.sha2(raw, 256).alias("digest"),
                ext.alias("format"),
                F.octet_length(raw).alias("size"),
                alt.alias("alt_text"),
                raw.alias("bytes"),
            ),
        ),
    )


def rewrite_embedded(text: Column, folder: str = "images") -> Column:
    """Point every decodable data-URI image at ``./<folder>/<name>``."""
    found = F.regexp_extract_all(text, F.lit(EMBEDDED), F.lit(0))

    def link(m):
        return let(
            _describe(m, folder),
            lambda d: F.when(
                d.isNotNull(), F.concat(F.lit("!["), d["alt_text"], F.lit(f"](./{folder}/"), d["name"], F.lit(")"))
            ).otherwise(m),
        )

    return F.when(
        text.contains(";base64,"),
        let(F.transform(found, link), lambda new: weave(F.split(text, EMBEDDED, -1), new)),
    ).otherwise(text)


def embedded_images(df: DataFrame, doc: str, text: str, folder: str = "images") -> DataFrame:
    """One row per occurrence; equal bytes share one name."""
    found = F.regexp_extract_all(F.col(text), F.lit(EMBEDDED), F.lit(0))
    return (
        df.where(F.col(text).contains(";base64,"))
        .select(doc, F.posexplode(F.transform(found, lambda m: _describe(m, folder))).alias("ord", "d"))
        .where("d is not null")
        .select(
            doc,
            "ord",
            "d.name",
            F.concat(F.lit(f"./{folder}/"), F.col("d.name")).alias("path"),
            "d.format",
            "d.size",
            "d.alt_text",
            "d.bytes",
            "d.digest",
        )
    )


def asset_store(images: DataFrame, doc: str) -> DataFrame:
    """One row per distinct image by its full SHA-256 and format; ``name`` is for display.

    Digests, sizes and counts combine in a hash aggregate that no bytes enter. The bytes are
    fetched by a join with the one occurrence of each image that the aggregate names
    (``doc`` and ``ord`` of the first); where two images share a short name, ``name`` is
    followed by the digest.
    """
    keys = ["digest", "format"]
    counted = images.groupBy(*keys).agg(
        F.min(F.struct(doc, "ord", "name")).alias("_first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("occurrences")
    )
    first = counted.select(*keys, "_first.*", "size", "occurrences")
    alike = F.count(F.lit(1)).over(Window.partitionBy("name"))  # images of one short name: nearly always one
    named = first.withColumn("name", F.when(alike > 1, F.concat("name", F.lit("."), "digest")).otherwise(F.col("name")))
    whole = named.join(images.select(*keys, doc, "ord", "bytes"), [*keys, doc, "ord"])
    return whole.select("name", "digest", "format", "size", "occurrences", "bytes")


def count_embedded(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"!\[([^\]]*)\]\(data:image/[^;,]+;base64,[^)]+\)"))


def strip_images(text: Column) -> Column:
    """Replace image references by a bracketed label with the alt text."""
    named = F.regexp_replace(text, r"!\[([^\]]+)\]\([^)]+\)", f"[{IMAGE_LABEL}: $1]")
    return F.regexp_replace(named, ANY_IMAGE, f"[{IMAGE_LABEL}]")


def size_estimate(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Expected size after images move out: bytes minus matched characters plus 50 per link."""
    found = F.regexp_extract_all(F.col(text), F.lit(EMBEDDED), F.lit(0))
    measured = df.select(
        doc,
        F.octet_length(F.col(text)).alias("original_size"),
        F.inline(
            F.array(
                let(
                    found,
                    lambda f: F.struct(
                        F.size(f).alias("num_images"),
                        F.aggregate(f, F.lit(0), lambda a, m: a + F.length(m)).alias("image_chars"),
                    ),
                )
            )
        ),
    )
    cut = F.col("image_chars") - F.lit(REFERENCE_CHARS) * F.col("num_images")
    return measured.select(
        doc,
        "original_size",
        (F.col("original_size") - cut).alias("estimated_cleaned_size"),
        cut.alias("reduction_bytes"),
        F.when(F.col("original_size") > 0, F.round(cut / F.col("original_size") * 100, 2))
        .otherwise(F.lit(0.0))
        .alias("reduction_percent"),
        "num_images",
    )
