from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import buckets, index as ix
from scriptorium.plans import jobs
from scriptorium.session import written
from tests.test_refresh import frame, post
from workloads import fixtures as fx

CHUNK = "chunk_id string, slug string, source_document string, v int"


def chunks(spark, *rows):
    return spark.createDataFrame([(f"{slug}__{n:03}", slug, source, v) for slug, source, n, v in rows], CHUNK)


def content(spark, layout):
    return sorted(tuple(r) for r in buckets.read_index(spark, layout).select("chunk_id", "slug", "source_document", "v").collect())


def files(layout):
    return {p: p.stat().st_mtime_ns for p in Path(layout.path).rglob("*.parquet")}


def written_buckets(before, after):
    """Buckets that have other files than before."""
    return {int(p.parent.name.split("=")[1]) for p in {*before, *after} if before.get(p) != after.get(p)}


@pytest.mark.parametrize("by", ["slug", "source_document"])
def test_a_change_writes_touched_buckets_only_and_equals_a_full_rewrite(spark, tmp_path, by):
    rows = chunks(spark, *[(f"s{i}", f"src{i % 12}", n, i) for i in range(60) for n in range(1 + i % 3)])
    layout = buckets.Layout(str(tmp_path / "index"), by, 40)
    buckets.create_index(rows, layout)
    before, old = files(layout), written(buckets.read_index(spark, layout).drop("bucket"))
    new = chunks(spark, ("s3", "SRC3", 0, 100), ("s3", "SRC3", 1, 101), ("fresh", "src3", 0, 102), ("s4", "other", 0, 103))
    gone = new.select("slug").union(spark.createDataFrame([("s15",), ("absent",)], "slug string"))
    change = buckets.change_index(spark, layout, new, gone)
    want = sorted(tuple(r) for r in ix.upsert(ix.delete_by_slugs(old, gone), new).select("chunk_id", "slug", "source_document", "v").collect())
    assert content(spark, layout) == want and change.upserted == 4
    assert written_buckets(before, files(layout)) == set(change.buckets) and len(change.buckets) <= 5
    held = old.where("slug IN ('s3', 's4', 's15')").union(new).select(layout.bucket().alias("b")).distinct()
    assert set(change.buckets) == {r["b"] for r in held.collect()}
    # Once more gives the same.
    buckets.change_index(spark, layout, new, gone)
    assert content(spark, layout) == want


def test_emptied_buckets_and_empty_changes(spark, tmp_path):
    layout = buckets.Layout(str(tmp_path / "index"), buckets=8)
    buckets.create_index(chunks(spark, *[(f"s{i}", "a", 0, i) for i in range(20)]), layout)
    before = files(layout)
    assert buckets.change_index(spark, layout, None, spark.createDataFrame([("nobody",)], "slug string")).buckets == []
    assert files(layout) == before
    everyone = spark.createDataFrame([(f"s{i}",) for i in range(20)], "slug string")
    buckets.change_index(spark, layout, None, everyone)
    assert content(spark, layout) == []
    buckets.change_index(spark, layout, chunks(spark, ("x", None, 0, 1)))
    assert content(spark, layout) == [("x__000", "x", None, 1)]


def test_refresh_of_sources_leaves_other_buckets_alone(spark, tmp_path):
    posts = written(frame(spark, *[post(f"p{i}", f"src{i % 20}") for i in range(60)]))
    dictionary = fx.dictionary(spark)
    layout = buckets.Layout(str(tmp_path / "index"), "source_document", 64)
    buckets.create_index(ix.ingest_posts(posts, dictionary)[0], layout)
    before = files(layout)
    new = frame(spark, *[post(f"p{i}", f"SRC{i % 20}", "changed") for i in range(60) if i % 20 < 5])
    after, change = jobs.refresh_stored(posts, layout, new, dictionary)
    assert len(change.buckets) <= 5 and written_buckets(before, files(layout)) == set(change.buckets)
    whole = jobs.refresh_corpus(posts, written(ix.ingest_posts(posts, dictionary)[0]), new, dictionary)
    columns = ["chunk_id", "title", "chunk_text", "source_document"]
    assert sorted(map(tuple, buckets.read_index(spark, layout).select(*columns).collect())) == sorted(map(tuple, whole.index.select(*columns).collect()))
    assert sorted(r["slug"] for r in after.select("slug").collect()) == sorted(r["slug"] for r in whole.posts.select("slug").collect())


def test_refresh_archive_flags_and_files(spark, tmp_path):
    more = {"internal": F.col("slug"), "seo_title": F.col("title")}
    posts = written(frame(spark, post("a", "one"), post("b", "one"), post("c", "two")).withColumns(more))
    dictionary, assets = fx.dictionary(spark), spark.createDataFrame([("x.png",)], "name string")
    rules = jobs.NormalizationRules(fx.ordered_rules(spark), fx.ordered_rules(spark))
    new = frame(spark, post("a", "ONE", "new", 1), post("a", "ONE", "newer", 2)).withColumns(more)

    def run(name, **flags):
        layout = buckets.Layout(str(tmp_path / name / "index"))
        buckets.create_index(ix.ingest_posts(posts, dictionary)[0], layout)
        done = jobs.refresh_archive(posts, layout, new, dictionary, rules, assets, str(tmp_path / name), "2024", jobs.RefreshOptions(**flags))
        slugs = sorted({r["slug"] for r in buckets.read_index(spark, layout).select("slug").collect()})
        return done.report.first(), slugs, sorted(r["slug"] for r in done.posts.select("slug").collect()), {p.name for p in (tmp_path / name).iterdir()}

    report, slugs, after, made = run("all")
    assert (report["posts_found"], report["posts_extracted"], report["duplicate_slugs"], report["posts_after"], report["orphan_images"]) == (2, 2, 1, 2, 1)
    assert slugs == after == ["a", "c"]
    assert made == {"index", "snapshots", "posts", "feed", "manifest", "review", "cms_articles", "cms_media"}
    _, slugs, after, made = run("keep", delete_existing=False, backup=False, cms_manifest=False)
    assert slugs == after == ["a", "b", "c"] and not made & {"snapshots", "cms_articles"}
    report, slugs, after, _ = run("out", reinsert=False)
    assert slugs == ["c"] and after == ["a", "c"] and report["index_points"] == report["points_upserted"] == 0
    report, slugs, after, made = run("dry", dry_run=True)
    assert slugs == after == ["a", "b", "c"] and report["points_upserted"] == 0 < report["chunks_produced"] and made == {"index", "snapshots"}


def test_counts_come_from_the_write(spark):
    rows = spark.range(1000).where("id % 3 = 0").withColumn("v", F.col("id") * 2)
    table, n = jobs._counted(rows)
    assert n == 334 == table.count()


def _shuffled(spark, work):
    """Bytes that ``work`` shuffles, from the stages of its plans."""
    store = spark._jsc.sc().statusStore()
    total = lambda: sum(s.shuffleWriteBytes() for s in map(store.lastStageAttempt, range(_stages(spark))))
    before = total()
    work()
    return total() - before


def _stages(spark):
    return spark._jsc.sc().dagScheduler().nextStageId()


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_rows_that_stay_are_not_shuffled(spark, tmp_path, monkeypatch, sent):
    """Half of the slugs go and some chunks are replaced; wide rows that stay go from file to file."""
    wide = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda n: F.hash(n, "slug", "n").cast("string")), " ")
    rows = written(
        spark.range(4000).select(F.concat(F.lit("s"), (F.col("id") / 2).cast("int").cast("string")).alias("slug"), (F.col("id") % 2).alias("n"))
        .select(F.concat_ws("__", "slug", "n").alias("chunk_id"), "slug", F.lit("src").alias("source_document"), wide.alias("v"))
    )
    monkeypatch.setattr(buckets, "SMALL_FILE", 0)
    monkeypatch.setattr(buckets, "MAX_SENT_MARKS", sent)
    layout = buckets.Layout(str(tmp_path / "index"), buckets=4)
    buckets.create_index(rows, layout)
    gone = rows.where("slug < 's15'").select("slug")
    new = written(rows.where("slug = 's1500' OR chunk_id = 's7__1'").withColumn("v", F.lit("new")))
    want = ix.upsert(ix.delete_by_slugs(rows, gone), new)
    moved = _shuffled(spark, lambda: buckets.change_index(spark, layout, new, gone, dealt=3))
    got = buckets.read_index(spark, layout).drop("bucket")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    if sent:
        assert moved < 1_000_000  # the rows that stay hold some 5 MB
