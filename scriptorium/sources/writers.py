"""Records that are published, and writing them.

Feeds are written as one record per line in many files, next to a one-row
envelope; nothing gathers a whole feed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.text import null_if_empty
from scriptorium.operators.index import _timestamp
from scriptorium.operators.normalize import seo_title
from scriptorium.operators.validate import basename, media_list


def absolute_url(path: Column, base_url: str) -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/" if base_url else ""), F.ltrim(path))


def _non_zero(column: str) -> Column:
    return F.when(F.col(column) != 0, F.col(column))


def _empty_to_null(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def posts_feed(posts: DataFrame, base_url: str = "", include_body: bool = True) -> DataFrame:
    """Flat records of posts."""
    gallery = F.coalesce("gallery_images", F.array().cast("array<string>"))
    title = F.coalesce(null_if_empty(F.col("seo_title")), F.col("title"), F.lit(""))
    columns = [
        F.col("slug").alias("id"),
        "internal",
        "slug",
        absolute_url(F.concat(F.lit("posts/"), "slug"), base_url).alias("url"),
        null_if_empty(F.col("title")).alias("title"),
        null_if_empty(F.col("summary")).alias("summary"),
        seo_title(title).alias("seo_title"),
        null_if_empty(F.col("seo_description")).alias("seo_description"),
        null_if_empty(F.col("category")).alias("category"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("date").cast("string").alias("date"),
        _timestamp(F.col("date")).alias("date_published"),
        _non_zero("year").alias("year"),
        null_if_empty(F.col("quarter")).alias("quarter"),
        F.when(F.col("featured_image") != "", absolute_url(F.col("featured_image"), base_url)).alias("featured_image"),
        F.transform(gallery, lambda g: absolute_url(g, base_url)).alias("gallery_images"),
        null_if_empty(F.col("location")).alias("location"),
        null_if_empty(F.col("partner")).alias("partner"),
        "source_document",
        "source_section",
        _non_zero("source_page").alias("source_page"),
    ]
    if include_body:
        columns.append(null_if_empty(F.col("body")).alias("body_markdown"))
    return posts.select(*columns)


def write_posts_feed(posts: DataFrame, path: str, base_url: str = "", include_body: bool = True) -> None:
    posts_feed(posts, base_url, include_body).write.mode("overwrite").partitionBy("year").json(path)


def json_feed_items(posts: DataFrame, base_url: str = "", extension: str = "_archive") -> DataFrame:
    """Items of a JSON Feed 1.1 as JSON texts; empty fields are left out."""
    r = posts_feed(posts, base_url)
    own = F.struct(
        "internal", "category", "quarter", _empty_to_null(F.col("gallery_images")).alias("gallery_images"), "seo_title",
        "seo_description", "location", "partner", "source_document",
    )
    item = F.struct(
        F.coalesce("url", "slug").alias("id"),
        "url",
        "title",
        "summary",
        "date_published",
        _empty_to_null(F.col("tags")).alias("tags"),
        F.col("featured_image").alias("image"),
        own.alias(extension),
        F.col("body_markdown").alias("content_text"),
    )
    return r.select("slug", F.to_date("date").alias("date"), F.to_json(item).alias("item"))


def json_feed_envelope(items: DataFrame, title: str, description: str = "", language: str = "en", base_url: str = "") -> DataFrame:
    """One row: what a JSON Feed says about itself, with the number of its items."""
    home = base_url.rstrip("/") or None
    return items.agg(F.count("*").alias("total_items")).select(
        F.lit("https://jsonfeed.org/version/1.1").alias("version"),
        F.lit(title).alias("title"),
        F.lit(description).alias("description"),
        F.lit(language).alias("language"),
        "total_items",
        F.lit(home).alias("home_page_url"),
        F.lit(f"{home}/feed.json" if home else "feed.json").alias("feed_url"),
    )


def write_json_feed(posts: DataFrame, path: str, title: str, base_url: str = "", **about: str) -> None:
    """Items in feed order under ``items``, the envelope under ``envelope``."""
    items = json_feed_items(posts, base_url)
    ordered = items.orderBy(F.col("date").isNull().desc(), F.col("date").desc(), "slug")
    ordered.select("item").write.mode("overwrite").text(f"{path}/items")
    json_feed_envelope(items, title, base_url=base_url, **about).write.mode("overwrite").json(f"{path}/envelope")


# The fields of a publishing manifest and of a review sheet.
MANIFEST_FIELDS = [
    "internal", "slug", "title", "date", "year", "quarter", "category", "tags", "featured_image", "gallery_images",
    "seo_title", "seo_description", "summary", "source_document", "source_section",
]
REVIEW_FIELDS = [
    "internal", "slug", "title", "date", "year", "quarter", "category", "tags", "location", "partner", "seo_title",
    "seo_description", "featured_image", "image_count", "summary", "validation",
]


def publishing_manifest(posts: DataFrame) -> DataFrame:
    return posts.select(*MANIFEST_FIELDS)


def source_manifest(posts: DataFrame) -> DataFrame:
    """The short manifest of one source's posts."""
    return posts.select("source_document", "internal", "slug", "title", "date", "featured_image", image_count().alias("image_count"))


def image_count() -> Column:
    return F.size(media_list(F.col("featured_image"), F.col("gallery_images")))


def review_sheet(posts: DataFrame, issues: DataFrame) -> DataFrame:
    """16 columns for editors; ``issues(slug, issues)`` come from validation."""
    joined = posts.drop("body").join(issues, "slug", "left")
    validation = F.coalesce(null_if_empty(F.array_join("issues", "; ")), F.lit("ok"))
    return (
        joined.withColumn("image_count", image_count())
        .withColumn("validation", validation)
        .withColumn("tags", F.array_join("tags", ", "))
        .select(*REVIEW_FIELDS)
    )


def write_review_csv(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def cms_articles(posts: DataFrame, structure: str = "NEWS_ARTICLE", folder: str = "highlights", locale: str = "en_US") -> DataFrame:
    """Nested article records with references that do not change between runs."""
    def text(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    category = F.struct(F.lit("Category").alias("taxonomyVocabularyName"), F.col("category").alias("name"))
    return posts.select(
        F.concat(F.lit("WH-"), "slug").alias("externalReferenceCode"),
        F.lit(structure).alias("contentStructureId"),
        F.concat(F.lit(f"{folder}/"), "slug").alias("friendlyUrlPath"),
        F.lit(locale).alias("defaultLanguageId"),
        F.create_map(F.lit(locale), text("title")).alias("title"),
        F.create_map(F.lit(locale), text("summary")).alias("description"),
        F.col("date").alias("datePublished"),
        _non_zero("year").alias("year"),
        null_if_empty(F.col("quarter")).alias("quarter"),
        F.lit("approved").alias("status"),
        F.when(text("category") != "", F.array(category)).otherwise(F.array().cast("array<struct<taxonomyVocabularyName:string,name:string>>")).alias("taxonomyCategories"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("keywords"),
        F.struct(
            text("summary").alias("Summary"),
            text("body").alias("Body"),
            text("featured_image").alias("FeaturedImage"),
            F.array_join("gallery_images", ", ").alias("GalleryImages"),
            text("source_document").alias("SourceDocument"),
            text("seo_title").alias("SEOTitle"),
            text("seo_description").alias("SEODescription"),
            text("location").alias("Location"),
            text("partner").alias("Partner"),
        ).alias("contentFields"),
    )


def cms_media(posts: DataFrame, folder: str = "highlights", locale: str = "en_US") -> DataFrame:
    """One record per referenced image: the featured one is 1, the gallery counts from 2."""
    featured = F.filter(F.array("featured_image"), lambda f: f != "")
    entries = F.concat(
        F.transform(featured, lambda f: F.struct(F.lit(1).alias("sequence"), f.alias("ref"))),
        F.transform(
            F.coalesce("gallery_images", F.array().cast("array<string>")),
            lambda g, i: F.struct((i + 2).alias("sequence"), g.alias("ref")),
        ),
    )
    rows = posts.select("slug", "title", F.explode(entries).alias("e")).select("slug", "title", "e.*")
    number = F.lpad(F.col("sequence").cast("string"), F.greatest(F.length(F.col("sequence").cast("string")), F.lit(2)), F.lit("0"))
    is_first = F.col("sequence") == 1
    caption = F.when(is_first, F.concat("title", F.lit(" — Featured Image"))).otherwise(
        F.concat("title", F.lit(" — Image "), F.col("sequence").cast("string"))
    )
    return rows.select(
        F.concat(F.lit("IMG-"), "slug", F.lit("-"), number).alias("externalReferenceCode"),
        basename(F.col("ref")).alias("fileName"),
        F.create_map(F.lit(locale), caption).alias("title"),
        F.concat(F.lit("WH-"), "slug").alias("articleReference"),
        "sequence",
        F.when(is_first, "featured").otherwise("gallery").alias("mediaType"),
        F.lit(folder).alias("folder"),
    )


def append_rejected(rejected: DataFrame, path: str) -> None:
    rejected.select("slug", "reason").write.mode("append").json(path)


def batch_index(classified: DataFrame) -> DataFrame:
    """One summary row per classified post."""
    types = [c for c in classified.columns if c.startswith("e_")]
    present = sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in types), F.lit(0))
    return classified.select(
        "slug", "category", "subcategory", F.col("source").alias("classification_source"), "category_score",
        present.alias("detected_entity_types"), F.lit(True).alias("ok"),
    )
