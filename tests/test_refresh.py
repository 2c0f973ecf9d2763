from pyspark.sql import functions as F

from scriptorium.operators import index as ix, refresh
from scriptorium.plans import jobs
from scriptorium.session import written
from workloads import fixtures as fx

SCHEMA = (
    "slug string, title string, summary string, body string, date date, year int, quarter string, category string, tags array<string>, location string,"
    " partner string, featured_image string, gallery_images array<string>, language string, status string, visibility string, source_document string,"
    " source_section string, source_page int, section_no int"
)


def post(slug, source, body="the text", n=1):
    return (slug, slug.upper(), "", body, None, None, None, "", [], "", "", "", [], "en", "approved", "public", source, "", 0, n)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def state(df):
    return sorted(tuple(r) for r in df.select("slug", "body", "source_document").collect())


def test_replace_source_twice_is_once(spark):
    posts = frame(spark, post("a", "One.docx"), post("b", "one.DOCX"), post("c", "two"), post("d", "two"))
    new = frame(spark, post("a", "ONE.docx", "new"), post("x", "ONE.docx", "first", 1), post("x", "ONE.docx", "second", 2), post("d", "ONE.docx", "moved"))
    once = written(refresh.replace_source(posts, new))
    assert state(once) == [("a", "new", "ONE.docx"), ("c", "the text", "two"), ("d", "moved", "ONE.docx"), ("x", "second", "ONE.docx")]
    assert state(refresh.replace_source(once, new)) == state(once)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "chunk_id string, v string")
    new = spark.createDataFrame([("2", "c"), ("3", "d")], "chunk_id string, v string")
    once = ix.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("1", "a"), ("2", "c"), ("3", "d")]
    assert sorted(map(tuple, ix.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_refresh_corpus(spark):
    posts = frame(spark, post("a", "one"), post("b", "one", "\n\n".join(["# H\nthe"] * 3)), post("c", "two"))
    index = written(ix.ingest_posts(posts, fx.dictionary(spark))[0])
    new = frame(spark, post("a", "one", "changed"))
    done = jobs.refresh_corpus(posts, index, new, fx.dictionary(spark))
    assert {r["slug"] for r in done.index.select("slug").collect()} == {"a", "c"}
    report = done.report.first()
    assert (report["posts_before"], report["posts_matched"], report["posts_after"]) == (3, 2, 2)
    again = jobs.refresh_corpus(written(done.posts), written(done.index), new, fx.dictionary(spark))
    columns = ["chunk_id", "chunk_text", "title"]
    assert sorted(map(tuple, again.index.select(*columns).collect())) == sorted(map(tuple, done.index.select(*columns).collect()))
    dry = jobs.refresh_corpus(posts, index, new, fx.dictionary(spark), dry_run=True)
    assert dry.posts.count() == 3 and dry.report.first()["dry_run"]


def test_snapshot(spark, tmp_path):
    posts = frame(spark, post("a", "one"), post("b", "two"))
    matched = refresh.match_existing(posts, spark.createDataFrame([("ONE",)], "source_document string"))
    refresh.write_snapshot(matched, str(tmp_path / "s"), "2024")
    refresh.write_snapshot(matched, str(tmp_path / "s"), "2025")
    kept = spark.read.parquet(str(tmp_path / "s"))
    assert kept.groupBy("snapshot").count().orderBy("snapshot").select(F.col("count")).collect() == [(1,), (1,)]


def test_refresh_chunks_posts_once(spark):
    """Index and report read stored chunks; neither plan cuts texts again."""
    posts = frame(spark, post("a", "one"), post("c", "two"))
    index = written(ix.ingest_posts(posts, fx.dictionary(spark))[0])
    done = jobs.refresh_corpus(posts, index, frame(spark, post("a", "one", "changed")), fx.dictionary(spark))
    for table in (done.index, done.report):
        assert "Generate" not in table._jdf.queryExecution().optimizedPlan().toString()
