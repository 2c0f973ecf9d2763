"""Tables that are written in an exchange format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import index as ix
from scriptorium.session import shared_folder
from scriptorium.sources import readers, writers
from workloads import chunks as ck, fixtures as fx, searching as sw


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/roundtrips/{uuid.uuid4().hex}"


def csv_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, i = _place(spark), F.col("page_id")
    pages = fx.table(spark, sf_dir, "pages")
    pages.select(
        F.concat(F.lit(" "), "url", F.lit(" ")).alias("query"),
        F.when(i % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit("page, "), i.cast("string"))).alias("expected_text_contains"),
        F.when(i % 4 == 0, F.lit("")).when(i % 4 == 1, F.lit("many")).otherwise((i % 4).cast("string")).alias("min_results"),
    ).write.csv(path, header=True)
    return readers.read_csv_cases(spark, path)


CSV_CASES_SQL = """
SELECT trim(url) AS query, CASE WHEN page_id % 3 <> 0 THEN 'page, ' || page_id END AS expected_text_contains,
  (CASE WHEN page_id % 4 IN (0, 1) THEN 1 ELSE page_id % 4 END)::INT AS min_results FROM pages"""


def posts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    fx.posts(spark, sf_dir).select("slug", "title", "body", "gallery_images").write.json(path)
    back = readers.read_posts_json(spark, path, "slug string, title string, body string, gallery_images array<string>")
    return back.select("slug", "title", F.md5("body").alias("body"), F.size("gallery_images").alias("n_images"))


POSTS_JSON_SQL = f"WITH {fx.POSTS_SQL} SELECT slug, title, md5(body) AS body, len(gallery_images)::INT AS n_images FROM posts"


def rejected_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a front matter are rejected in two batches."""
    path = _place(spark)
    corpus = fx.table(spark, sf_dir, "documents").select(
        F.lit("").alias("file"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("stem"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("---\ntitle: x\n---\n"), "text")).otherwise(F.col("text")).alias("text"), "doc_id",
    )
    for odd in (0, 1):
        writers.append_rejected(readers.split_front_matter(corpus.where(F.col("doc_id") % 2 == odd).drop("doc_id"))[1], path)
    return spark.read.schema("slug string, reason string").json(path)


REJECTED_SQL = "SELECT 'doc-' || doc_id AS slug, 'no front matter' AS reason FROM documents WHERE doc_id % 5 <> 0"


def rebuilt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is written anew, twice, and read under the name that is live."""
    path, name = _place(spark), f"live_{uuid.uuid4().hex}"
    rows = sw.news_index(spark, sf_dir).select("chunk_id", "slug", "language", "chunk_text")
    for _ in range(2):
        ix.rebuild_index(rows, path)
    ix.live_view(spark.read.parquet(path), name)
    return spark.table(name).select("chunk_id", "slug", "language", F.md5("chunk_text").alias("text"))


REBUILT_SQL = f"""WITH RECURSIVE {ck.CHUNKS_CTES}
SELECT chunk_id, slug, language, md5(chunk_text) AS text FROM chunks JOIN posts USING (slug)"""

QUERIES = {
    "csv_cases": (csv_cases, CSV_CASES_SQL),
    "posts_json": (posts_json, POSTS_JSON_SQL),
    "rejected_sink": (rejected_sink, REJECTED_SQL),
    "rebuilt_index": (rebuilt_index, REBUILT_SQL),
}
