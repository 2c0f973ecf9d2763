"""Checks over posts, knowledge documents, media, dictionaries and the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.text import blank


def _messages(*conditional: Column) -> Column:
    return F.array_compact(F.array(*conditional))


def _missing(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("")) == ""


def validate_posts(
    posts: DataFrame,
    *,
    require_slug: bool = True,
    require_title: bool = True,
    require_summary: bool = False,
    fail_on_missing_slug: bool = True,
    fail_on_missing_date: bool = False,
) -> DataFrame:
    """Add ``warnings`` and ``valid``. Only a missing slug or date can fail a post.

    A failing slug ends the checks of that post.
    """
    no_slug = _missing(F.col("slug")) & F.lit(require_slug)
    failed_slug = no_slug & F.lit(fail_on_missing_slug)
    failed_date = _missing(F.col("date")) & F.lit(fail_on_missing_date) & ~failed_slug
    go_on = ~failed_slug
    return posts.withColumn(
        "warnings",
        _messages(
            F.when(no_slug, "missing slug"),
            F.when(go_on & F.lit(require_title) & _missing(F.col("title")), "missing title"),
            F.when(go_on & F.lit(require_summary) & blank(F.col("summary")), "missing summary"),
            F.when(failed_date, "missing date"),
        ),
    ).withColumn("valid", ~(failed_slug | failed_date))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and ``(slug, reason)`` of the failed ones."""
    failed = validated.where(~F.col("valid")).select("slug", F.array_join("warnings", "; ").alias("reason"))
    return validated.where("valid").drop("warnings", "valid"), failed


# Fields every knowledge document must carry.
KNOWLEDGE_FIELDS = [
    "title", "slug", "knowledge_type", "status", "published", "language", "priority", "memory_layer",
]


def validate_required(docs: DataFrame, fields: list[str] | None = None, layer: str = "knowledge") -> DataFrame:
    """Add ``warnings`` and ``valid``: every field present, and the right memory layer."""
    fields = KNOWLEDGE_FIELDS if fields is None else fields
    got = F.coalesce(F.col("memory_layer"), F.lit("None"))
    wrong_layer = F.when(
        ~F.col("memory_layer").eqNullSafe(F.lit(layer)),
        F.concat(F.lit(f"memory_layer must be '{layer}', got '"), got, F.lit("'")),
    )
    checks = [F.when(_missing(F.col(f)), f"missing field: {f}") for f in fields]
    return docs.withColumn("warnings", _messages(*checks, wrong_layer)).withColumn("valid", F.size("warnings") == 0)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def media_list(featured: Column, gallery: Column) -> Column:
    """Referenced media, featured first."""
    gallery = F.coalesce(gallery, F.array().cast("array<string>"))
    return F.when(F.coalesce(featured, F.lit("")) != "", F.concat(F.array(featured), gallery)).otherwise(gallery)


# Fields a normalized post must carry.
NORMALIZED_FIELDS = ["title", "slug", "date", "category", "tags", "summary", "featured_image"]


def validate_normalized(
    posts: DataFrame, assets: DataFrame, *, min_tags: int = 3, fields: list[str] | None = None
) -> DataFrame:
    """``(slug, issues)``, one row per post; ``assets(name)`` lists the media files there are.

    Media are looked up by the references of a post, so posts that share a slug
    keep their own issues.

    Where posts were renamed, ``original_media`` may hold the former references
    in the same order; a file under either name counts. Bodies are not touched:
    what is joined are media references and slugs.
    """
    fields = NORMALIZED_FIELDS if fields is None else fields

    def absent(field: str) -> Column:
        if field == "tags":
            return F.size(F.coalesce("tags", F.array().cast("array<string>"))) == 0
        return _missing(F.col(field))

    n_tags = F.size(F.coalesce("tags", F.array().cast("array<string>")))
    own = _messages(
        *[F.when(absent(f), f"missing: {f}") for f in fields],
        F.when(F.coalesce("year", F.lit(0)) == 0, "missing: year (date not parsed)"),
        F.when(
            n_tags < min_tags,
            F.concat(F.lit("low tag count: "), n_tags.cast("string"), F.lit(f" (min {min_tags})")),
        ),
    )
    current = media_list(F.col("featured_image"), F.col("gallery_images"))
    original = F.col("original_media") if "original_media" in posts.columns else current
    has_featured = F.coalesce(F.col("featured_image"), F.lit("")) != ""
    metadata = posts.select("slug", own.alias("own"), current.alias("current"), original.alias("original"), has_featured.alias("has_featured")).withColumn(
        "media", F.sha2(F.to_json(F.struct("current", "original", "has_featured")), 256)
    )
    known = assets.select("name").distinct()
    refs = metadata.select("media", "original", "has_featured", F.posexplode("current").alias("pos", "ref")).select(
        "media", "pos", "ref", "has_featured", F.explode(F.array_distinct(F.array_compact(F.array("ref", F.get("original", F.col("pos")))))).alias("candidate")
    )
    found = (
        refs.select("media", "pos", "ref", "has_featured", basename(F.col("candidate")).alias("name"))
        .join(known.withColumn("present", F.lit(True)), "name", "left")
        .groupBy("media", "pos", "ref", "has_featured")
        .agg(F.max(F.coalesce("present", F.lit(False))).alias("present"))
        .where(~F.col("present"))
    )
    label = F.when((F.col("pos") == 0) & F.col("has_featured"), "image file not found: ").otherwise("gallery image not found: ")
    missing = found.groupBy("media").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.concat(label, F.col("ref")).alias("message")))).alias("lost")
    )
    lost = F.coalesce(F.transform("lost", lambda m: m["message"]), F.array().cast("array<string>"))
    return metadata.select("slug", "own", "media").join(missing, "media", "left").select("slug", F.concat("own", lost).alias("issues"))


def duplicate_slugs(posts: DataFrame) -> DataFrame:
    return posts.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")


# The fields a search can be narrowed by.
FILTER_FIELDS = [
    "category", "year", "quarter", "chunk_type", "language", "status", "published", "visibility",
    "knowledge_type", "memory_layer", "priority",
]


def payload_filter(**wanted: object) -> Column:
    """Equality on every given field; empty values are skipped, ``published`` only when None."""
    unknown = set(wanted) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"unknown filter fields: {sorted(unknown)}")
    used = {
        k: v for k, v in wanted.items() if (v is not None if k == "published" else bool(v))
    }
    conditions = [F.col(k) == F.lit(int(v) if k == "year" else v) for k, v in used.items()]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def live_prefilter(**extra: object) -> Column:
    """What the public may see: published, approved, public, in one language."""
    base: dict[str, object] = {"published": True, "status": "approved", "language": "en", "visibility": "public"}
    return payload_filter(**{**base, **extra})


def orphan_media(assets: DataFrame, posts: DataFrame) -> DataFrame:
    """Assets that no post refers to."""
    used = posts.select(F.explode(media_list(F.col("featured_image"), F.col("gallery_images"))).alias("ref"))
    return assets.join(used.select(basename(F.col("ref")).alias("name")), "name", "left_anti")


def alias_conflicts(dictionary: DataFrame) -> DataFrame:
    """Aliases claimed by a second canonical name; the first owner keeps them.

    ``dictionary(etype, entry_pos, alias_pos, canonical, alias)``.
    """
    place = F.struct("entry_pos", "alias_pos")
    rows = dictionary.where("alias <> ''").withColumn("key", F.lower(F.trim("alias"))).withColumn("place", place)
    # Counted on the map side; only aliases with a second name go on.
    owners = (
        rows.groupBy("key")
        .agg(F.min_by("canonical", "place").alias("owner"), F.min("canonical").alias("low"), F.max("canonical").alias("high"))
        .where("low <> high")
        .select("key", "owner")
    )
    shared = rows.join(owners, "key")
    # The rows in which the owner itself lists the alias: one per listing.
    own = shared.where(F.col("canonical") == F.col("owner")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "etype"))).alias("own"))
    earlier = F.filter("own", lambda o: o["place"] < F.col("place"))
    return (
        shared.where(F.col("canonical") != F.col("owner"))
        .join(own, "key")
        .select(
            "alias", F.element_at(earlier, -1)["etype"].alias("owner_type"), "owner",
            F.col("etype").alias("claimant_type"), F.col("canonical").alias("claimant"),
        )
    )


# Payload fields that must never be null.
INDEX_FIELDS = ["article_id", "chunk_id", "slug", "chunk_text", "chunk_type", "chunk_index"]


def payload_completeness(index: DataFrame, required: list[str] | None = None) -> DataFrame:
    """``(field, n_null)`` over the whole index in one pass."""
    required = INDEX_FIELDS if required is None else required
    counts = index.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in required])
    pairs = ", ".join(f"'{f}', `{f}`" for f in required)
    return counts.selectExpr(f"stack({len(required)}, {pairs}) AS (field, n_null)")


def index_contract(index: DataFrame, dim: int) -> DataFrame:
    """One row: points, vector sizes, and points lacking either kind of vector."""
    return index.agg(
        F.count("*").alias("points"),
        F.min(F.size("dense")).alias("min_dim"),
        F.max(F.size("dense")).alias("max_dim"),
        F.count_if(F.col("dense").isNull() | (F.size("dense") != dim)).alias("wrong_dense"),
        F.count_if(F.col("sparse").isNull() | (F.size("sparse") == 0)).alias("without_sparse"),
    )


def coverage_report(posts: DataFrame) -> DataFrame:
    """One row of totals: how many posts are dated, illustrated and tagged."""
    return posts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("date").isNotNull()).alias("dated"),
        F.count_if(F.coalesce("featured_image", F.lit("")) != "").alias("with_image"),
        F.count_if(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0).alias("with_tags"),
    )


def coverage_gaps(posts: DataFrame) -> DataFrame:
    """``(slug, gap)`` for posts without a date or a featured image."""
    gaps = _messages(
        F.when(F.col("date").isNull(), "date"),
        F.when(F.coalesce("featured_image", F.lit("")) == "", "featured_image"),
    )
    return posts.select("slug", F.explode(gaps).alias("gap"))


def category_counts(posts: DataFrame, blank_as: str = "—") -> DataFrame:
    category = F.trim(F.coalesce("category", F.lit("")))
    return (
        posts.select(F.when(category == "", blank_as).otherwise(category).alias("category"))
        .groupBy("category")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "category")
    )
