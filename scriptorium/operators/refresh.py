"""Replacing everything that came from a source, and telling what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.operators.index import delete_by_slugs, latest, slug_order, upsert
from scriptorium.operators.validate import media_list


def _source_key(column: str = "source_document") -> Column:
    return F.lower(F.coalesce(column, F.lit("")))


def match_existing(posts: DataFrame, sources: DataFrame) -> DataFrame:
    """Posts whose source document, whatever its case, is among ``sources(source_document)``."""
    keys = sources.select(_source_key().alias("__key")).distinct()
    return posts.withColumn("__key", _source_key()).join(keys, "__key", "left_semi").drop("__key")


def without_sources(posts: DataFrame, sources: DataFrame) -> DataFrame:
    keys = sources.select(_source_key().alias("__key")).distinct()
    return posts.withColumn("__key", _source_key()).join(keys, "__key", "left_anti").drop("__key")


def write_snapshot(matched: DataFrame, path: str, stamp: str) -> None:
    """Keep rows that are about to be replaced, under their time stamp."""
    matched.withColumn("snapshot", F.lit(stamp)).write.mode("append").partitionBy("snapshot").parquet(path)


def snapshot_manifest(matched: DataFrame, stamp: str) -> DataFrame:
    """One row: how many posts and how many distinct media a snapshot keeps."""
    media = matched.select(F.explode(media_list(F.col("featured_image"), F.col("gallery_images"))).alias("m"))
    return matched.agg(F.count("*").alias("posts")).select(
        F.lit(stamp).alias("created_at"), "posts", media.agg(F.countDistinct("m")).scalar().alias("images")
    )


def replace_source(posts: DataFrame, incoming: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Drop the posts of all incoming sources and add the incoming ones.

    Of incoming posts with the same slug one stays, the first by ``order``; it
    also replaces a post of another source with that slug.
    """
    fresh = latest(incoming, "slug", order or slug_order(incoming))
    kept = without_sources(posts, incoming.select("source_document"))
    return upsert(kept, fresh, "slug")


def refresh_index(index: DataFrame, replaced: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The index without the chunks of replaced posts and with those of new ones."""
    return upsert(delete_by_slugs(index, replaced.select("slug").distinct()), new_rows)


def refresh_report(
    before: DataFrame, after: DataFrame, matched: DataFrame, incoming: DataFrame, index_before: DataFrame, index_after: DataFrame, *, dry_run: bool = False
) -> DataFrame:
    """One row of counts before and after."""
    def count(df: DataFrame) -> Column:
        return df.agg(F.count("*")).scalar()

    duplicates = incoming.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")
    return before.agg(F.count("*").alias("posts_before")).select(
        F.lit(dry_run).alias("dry_run"),
        "posts_before",
        count(matched).alias("posts_matched"),
        count(incoming).alias("posts_extracted"),
        count(duplicates).alias("duplicate_slugs"),
        count(after).alias("posts_after"),
        count(index_before).alias("chunks_before"),
        count(index_after).alias("chunks_after"),
    )


def catalog_counts(posts: DataFrame, images: DataFrame, knowledge: DataFrame, configs: DataFrame, managed: list[str]) -> DataFrame:
    """``(measure, n)``: posts, images, knowledge documents, managed configurations and missing ones."""
    spark = posts.sparkSession
    wanted = spark.createDataFrame([(m,) for m in managed], "name string")
    missing = wanted.join(configs.select("name"), "name", "left_anti")
    measures = [("posts", posts), ("images", images), ("knowledge_docs", knowledge), ("configs_managed", wanted), ("configs_missing", missing)]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n") for name, df in measures]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
