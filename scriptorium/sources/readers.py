"""Reading Markdown corpora, evaluation cases and post feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.functions.text import blank, strip

_FRONT_MATTER = r"\A---\n([\s\S]*?)\n---\n([\s\S]*)"


def read_markdown_corpus(spark: SparkSession, path: str, *, recursive: bool = False, slug: str | None = None) -> DataFrame:
    """``(file, stem, text)``, one row per ``*.md`` file; ``slug`` keeps the file of that stem."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=recursive).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )
    named = files.withColumn("stem", F.regexp_replace(F.substring_index("file", "/", -1), r"\.md$", ""))
    return named if slug is None else named.where(F.col("stem") == slug)


def split_front_matter(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(posts, rejected)``: rows with a header, parsed, and rows without one, with a reason.

    The header's flat ``key: value`` lines become ``front``, a string map; lists
    are written ``[a, b]`` or as ``- item`` lines under their key.
    """
    found = corpus.withColumn("header", F.regexp_extract("text", _FRONT_MATTER, 1))
    # A list under a key is pulled up into one line, so that each line is one entry.
    flat = F.regexp_replace(F.regexp_replace("header", r"\n\s*- +", "\u0001"), r":\s*\u0001", ": \u0001")
    entries = F.filter(F.split(flat, "\n"), lambda line: line.rlike(r"^[^#\s][^:]*:"))
    front = F.map_from_entries(
        F.transform(
            entries,
            lambda line: F.struct(
                strip(F.regexp_extract(line, r"^([^:]*):", 1)).alias("key"),
                _unquoted(F.regexp_extract(line, r"^[^:]*:\s*(.*)$", 1)).alias("value"),
            ),
        )
    )
    has_header = F.col("header") != ""
    posts = found.where(has_header).select(
        "file", "stem", front.alias("front"), strip(F.regexp_extract("text", _FRONT_MATTER, 2)).alias("body")
    )
    rejected = found.where(~has_header).select(F.col("stem").alias("slug"), F.lit("no front matter").alias("reason"))
    return posts, rejected


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(strip(value), r"""\A(['"])(.*)\1\z""", "$2")


def front_list(value: Column) -> Column:
    """A header value as an array."""
    inner = F.regexp_replace(F.coalesce(value, F.lit("")), r"\A\[|\]\z|\A\u0001", "")
    return F.filter(F.transform(F.split(inner, r"\u0001|,\s*"), _unquoted), lambda v: v != "")


# Header keys that are lists, numbers and plain texts of a post.
_LISTS = ("tags", "gallery_images")
_NUMBERS = ("year", "source_page")
_TEXTS = (
    "title", "internal", "summary", "quarter", "category", "location", "partner", "featured_image", "seo_title",
    "seo_description", "source_document", "source_section", "language", "status", "visibility",
)


def posts_from_front_matter(parsed: DataFrame) -> DataFrame:
    """Typed posts; keys of no known column go to ``extra``."""
    known = F.array(*[F.lit(k) for k in ("slug", "date", *_LISTS, *_NUMBERS, *_TEXTS)])
    value = F.col("front").getItem
    return parsed.select(
        F.coalesce(F.when(value("slug") != "", value("slug")), F.col("stem")).alias("slug"),
        F.try_to_date(value("date"), "yyyy-MM-dd").alias("date"),
        *[F.coalesce(value(k), F.lit("")).alias(k) for k in _TEXTS],
        *[F.expr(f"try_cast(front['{k}'] AS int)").alias(k) for k in _NUMBERS],
        *[front_list(value(k)).alias(k) for k in _LISTS],
        "body",
        F.map_filter("front", lambda k, _: ~F.array_contains(known, k)).alias("extra"),
    )


def knowledge_from_front_matter(parsed: DataFrame) -> DataFrame:
    value = F.col("front").getItem
    texts = ("title", "slug", "knowledge_type", "status", "language", "priority", "memory_layer")
    return parsed.select(
        *[value(k).alias(k) for k in texts],
        F.expr("try_cast(front['published'] AS boolean)").alias("published"),
        "body",
        F.col("file").alias("source_file"),
    )


def read_csv_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases with trimmed fields; blank optional ones are null, ``min_results`` is at least given as 1."""
    raw = spark.read.csv(path, header=True)
    cleaned = raw.select(
        *[F.when(~blank(F.col(c)), F.regexp_replace(strip(F.col(c)), r'\A"+|"+\z', "")).alias(c) for c in raw.columns]
    )
    if "min_results" in raw.columns:
        cleaned = cleaned.withColumn("min_results", F.coalesce(F.expr("try_cast(min_results AS int)"), F.lit(1)))
    return cleaned


def read_posts_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Posts of a feed, whether a bare array, ``{"posts": [...]}`` or one post per line."""
    reader = spark.read.option("multiLine", schema is None)
    raw = reader.schema(schema).json(path) if schema else reader.json(path)
    return raw.selectExpr("inline(posts)") if "posts" in raw.columns else raw
