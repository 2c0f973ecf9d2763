import datetime
import json

from pyspark.sql import functions as F

from scriptorium import session
from scriptorium.operators import validate
from scriptorium.plans import jobs
from scriptorium.sources import readers, writers
from scriptorium.streaming import ingest
from workloads import fixtures as fx

POST = """---
slug: first
title: "A: title"
date: 2024-05-06
year: 2024
tags: [x, 'y z']
gallery_images:
- images/a.png
- images/b.png
custom: kept
---

Body *text*.

Second the.
"""


def corpus(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.md").write_text(POST, encoding="utf-8")
    (tmp_path / "two.md").write_text("no header", encoding="utf-8")
    (tmp_path / "sub" / "three.md").write_text("---\ntitle: T\n---\nx", encoding="utf-8")
    (tmp_path / "note.txt").write_text("---\ntitle: T\n---\nx", encoding="utf-8")
    return str(tmp_path)


def test_markdown_corpus(spark, tmp_path):
    path = corpus(tmp_path)
    assert {r["stem"] for r in readers.read_markdown_corpus(spark, path).collect()} == {"one", "two"}
    assert {r["stem"] for r in readers.read_markdown_corpus(spark, path, recursive=True).collect()} == {"one", "two", "three"}
    assert readers.read_markdown_corpus(spark, path, slug="one").count() == 1
    parsed, rejected = readers.split_front_matter(readers.read_markdown_corpus(spark, path))
    post = readers.posts_from_front_matter(parsed).first()
    assert (post["slug"], post["title"], post["date"], post["year"]) == ("first", "A: title", datetime.date(2024, 5, 6), 2024)
    assert post["tags"] == ["x", "y z"] and post["gallery_images"] == ["images/a.png", "images/b.png"]
    assert post["extra"] == {"custom": "kept"} and post["body"] == "Body *text*.\n\nSecond the."
    assert [tuple(r) for r in rejected.collect()] == [("two", "no front matter")]


def test_knowledge_front_matter(spark, tmp_path):
    (tmp_path / "k.md").write_text("---\ntitle: T\nslug: k\nknowledge_type: faq\nstatus: approved\npublished: true\nlanguage: en\npriority: high\nmemory_layer: news\n---\nx", encoding="utf-8")
    parsed, _ = readers.split_front_matter(readers.read_markdown_corpus(spark, str(tmp_path)))
    row = validate.validate_required(readers.knowledge_from_front_matter(parsed)).first()
    assert row["warnings"] == ["memory_layer must be 'knowledge', got 'news'"] and row["published"] is True


def test_csv_cases(spark, tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text('query,expected_slug_contains,category,min_results\n" one, two ",a|b,,2\nthree,,news,\n', encoding="utf-8")
    rows = readers.read_csv_cases(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("one, two", "a|b", None, 2), ("three", None, "news", 1)]


def test_posts_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"posts": [{"slug": "a"}, {"slug": "b"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"slug": "c"}]))
    assert {r["slug"] for r in readers.read_posts_json(spark, str(tmp_path / "a.json")).collect()} == {"a", "b"}
    assert {r["slug"] for r in readers.read_posts_json(spark, str(tmp_path / "b.json")).collect()} == {"c"}


def test_publish(spark, tmp_path):
    parsed, rejected = readers.split_front_matter(readers.read_markdown_corpus(spark, corpus(tmp_path / "in" if (tmp_path / "in").mkdir() is None else tmp_path)))
    posts = readers.posts_from_front_matter(parsed)
    assets = spark.createDataFrame([("a.png",)], "name string")
    out = str(tmp_path / "out")
    jobs.publish(posts, assets, out, title="Archive", base_url="https://example.org")
    feed = spark.read.json(f"{out}/posts").first()
    assert feed["url"] == "https://example.org/posts/first" and feed["date_published"] == "2024-05-06T00:00:00+00:00"
    item = json.loads(spark.read.text(f"{out}/feed/items").first()["value"])
    assert item["tags"] == ["x", "y z"] and "image" not in item and item["_archive"]["gallery_images"][0] == "https://example.org/images/a.png"
    assert spark.read.json(f"{out}/feed/envelope").first()["total_items"] == 1
    sheet = spark.read.csv(f"{out}/review", header=True)
    assert sheet.columns == writers.REVIEW_FIELDS
    assert sheet.first()["validation"] == (
        "missing: category; missing: summary; missing: featured_image; low tag count: 2 (min 3); gallery image not found: images/b.png"
    )
    assert spark.read.json(f"{out}/cms_media").count() == 2
    for _ in range(2):
        writers.append_rejected(rejected, f"{out}/rejected")
    assert spark.read.json(f"{out}/rejected").count() == 2


def test_streaming_ingest(spark, tmp_path):
    schema = fx.posts(spark, "/root/testdata/sf0.001").select("slug", "title", "summary", "body", "date", "year", "quarter", "category", "tags", "partner", "location", "featured_image", "gallery_images", "language", "status", "visibility", "source_document", "source_section", "source_page").schema
    arriving = tmp_path / "arriving"
    arriving.mkdir()
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    base = {"title": "T", "body": "one", "language": "en", "tags": [], "gallery_images": [], "featured_image": ""}

    def drain():
        stream = ingest.stream_posts(spark, str(arriving), ddl)
        ingest.ingest_stream(stream, fx.dictionary(spark), str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
        return {(r["chunk_id"], r["chunk_text"]) for r in ingest.read_index(spark, str(tmp_path / "index")).select("chunk_id", "chunk_text").collect()}

    (arriving / "1.json").write_text("\n".join(json.dumps({**base, "slug": s}) for s in ("a", "b")) + "\n")
    assert drain() == {("a__000", "T"), ("a__001", "one"), ("b__000", "T"), ("b__001", "one")}
    (arriving / "2.json").write_text(json.dumps({**base, "slug": "a", "body": ""}) + "\n")
    assert drain() == {("a__000", "T"), ("b__000", "T"), ("b__001", "one")}


def test_large_inputs_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    size = sum(f.stat().st_size for f in (tmp_path / "one").glob("*.parquet"))
    monkeypatch.setattr(session, "TASK_BYTES", size // 40)
    dealt = session.spread(one)
    assert dealt.rdd.getNumPartitions() >= 40 and dealt.count() == 20_000
    # Enough splits stay as they are.
    rows.repartition(64).write.parquet(str(tmp_path / "many"))
    monkeypatch.setattr(session, "TASK_BYTES", size)
    many = spark.read.option("maxPartitionBytes", 1).parquet(str(tmp_path / "many"))
    assert session.spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions()
