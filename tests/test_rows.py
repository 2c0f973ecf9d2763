"""Rows that share a slug or have none keep their own results, inline and joined."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import classify, context, evaluate, index as ix, normalize, routing, search, tagging, validate
from scriptorium.plans import jobs
from workloads import fixtures as fx

POST = "slug string, title string, summary string, body string, featured_image string, gallery_images array<string>"
POSTS = [
    ("a", "Acme grows", "", "", "x.png", ["y.png"]),
    ("a", "Bolt grows", "", "", "z.png", []),
    (None, "Nobody", "", "", None, None),
    (None, "Acme and Bolt", "", "", None, None),
]


def posts(spark):
    return spark.createDataFrame(POSTS, POST)


@pytest.mark.parametrize("max_inline", [2000, 0])
def test_tags_follow_the_row(spark, max_inline):
    dictionary = spark.createDataFrame(
        [("organizations", 0, "Acme", "Acme"), ("organizations", 1, "Bolt", "Bolt")], "etype string, entry_pos int, canonical string, alias string"
    )
    got = tagging.tag_entities(posts(spark), dictionary, max_inline=max_inline).select("title", "entities_organizations").collect()
    assert dict(map(tuple, got)) == {"Acme grows": ["Acme"], "Bolt grows": ["Bolt"], "Nobody": [], "Acme and Bolt": ["Acme", "Bolt"]}


@pytest.mark.parametrize("max_inline", [2000, 0])
def test_rules_follow_the_row_and_ties_go_by_name(spark, max_inline):
    rules = spark.createDataFrame([(1, "zz", "grows"), (1, "aa", "grows"), (0, "x", "acme"), (2, "y", "bolt")], "rule_pos int, name string, keyword string")
    got = normalize.rule_names(posts(spark), rules, max_inline=max_inline).select("title", "rule_names").collect()
    assert dict(map(tuple, got)) == {"Acme grows": ["x", "aa", "zz"], "Bolt grows": ["aa", "zz", "y"], "Nobody": [], "Acme and Bolt": ["x", "y"]}
    first = normalize.assign_category(posts(spark), rules, "g", max_inline=max_inline).select("title", "category").collect()
    assert dict(map(tuple, first)) == {"Acme grows": "x", "Bolt grows": "aa", "Nobody": "g", "Acme and Bolt": "x"}


@pytest.mark.parametrize("max_inline", [2000, 0])
def test_keywords_and_routes_follow_the_row(spark, max_inline):
    rules = fx.classification_rules(spark)
    keywords = spark.createDataFrame([("c", "acme"), ("d", "bolt"), ("d", "bolt"), ("e", "")], "category string, keyword string")
    rules = type(rules)(**{**rules.__dict__, "keyword_rules": keywords})
    got = classify.score_keywords(posts(spark), rules, text=F.col("title"), max_inline=max_inline).select("title", "keyword_hits").collect()
    assert dict(map(tuple, got)) == {"Acme grows": ["c"], "Bolt grows": ["d"], "Nobody": [], "Acme and Bolt": ["c", "d"]}
    signals = spark.createDataFrame([("news", "latest"), ("news", "latest"), ("knowledge", "policy")], "kind string, phrase string")
    queries = spark.createDataFrame([(1, "latest"), (1, "policy"), (None, "policy latest"), (None, None)], "query_id int, query string")
    counts = routing.signal_counts(queries, signals, max_inline).select("query", "news", "knowledge").collect()
    assert {r[0]: (r[1], r[2]) for r in counts} == {"latest": (1, 0), "policy": (0, 1), "policy latest": (1, 1), None: (0, 0)}


def test_media_and_issues_follow_the_row(spark):
    assets = spark.createDataFrame([("x.png",), ("z.png",)], "name string")
    issues = validate.validate_normalized(posts(spark).withColumn("tags", F.array(F.lit("t"))).withColumn("year", F.lit(1)), assets, min_tags=0, fields=[])
    assert sorted((r["slug"] or "", r["issues"]) for r in issues.collect()) == [("", []), ("", []), ("a", []), ("a", ["gallery image not found: y.png"])]
    keyed = posts(spark).withColumn("media_key", normalize.media_key())
    media = normalize.renamed_media(normalize.media_refs(keyed, assets, "media_key"), "media_key")
    got = keyed.join(media.select("media_key", "original_media"), "media_key", "left").select("title", "original_media").collect()
    assert dict(map(tuple, got)) == {"Acme grows": ["x.png", "y.png"], "Bolt grows": ["z.png"], "Nobody": None, "Acme and Bolt": None}


def test_one_post_per_slug_is_indexed(spark):
    base = fx.posts(spark, "/root/testdata/sf0.001").orderBy("slug").limit(20)
    doubled = base.union(base.withColumn("body", F.concat("body", F.lit("\n\nA later version.")))).union(base)
    rows, _ = ix.ingest_posts(doubled, fx.dictionary(spark))
    rows = rows.persist()
    assert rows.count() == rows.select("chunk_id").distinct().count() == rows.select("id").distinct().count()
    assert rows.select("slug").distinct().count() == base.select("slug").distinct().count()
    assert ix.superseded(doubled).agg(F.sum("n_superseded")).first()[0] == 40
    queries = search.embed_queries(spark.createDataFrame([(1, "the and")], "query_id int, query string"))
    assert all(r["score"] <= 1.0 for r in search.hybrid_search(queries, rows).collect())


def test_refresh_leaves_no_stale_chunks(spark):
    base = fx.posts(spark, "/root/testdata/sf0.001").orderBy(F.desc(F.length("body"))).limit(3)
    dictionary = fx.dictionary(spark)
    index = ix.ingest_posts(base, dictionary)[0]
    slug = base.first()["slug"]
    incoming = base.where(F.col("slug") == slug).withColumn("source_document", F.lit("another")).withColumn("body", F.lit("Short now."))
    done = jobs.refresh_corpus(base, index, incoming, dictionary)
    fresh = {r["chunk_id"] for r in ix.ingest_posts(incoming, dictionary)[0].collect()}
    assert {r["chunk_id"] for r in done.index.where(F.col("slug") == slug).collect()} == fresh
    assert index.where(F.col("slug") == slug).count() > len(fresh)
    assert done.posts.where(F.col("slug") == slug).count() == 1


def test_page_text_is_whole(spark):
    html = '<p>nav</p><article><h1>T</h1><p><b>one two<br>three.<p>four</p><ul><li><a href="/x">five</a> six</li></ul><p> </article><footer><p>no</p>'
    got = spark.createDataFrame([(html,)], "html string").select(fx.page_elements(F.col("html")).alias("e")).first()["e"]
    assert [tuple(e) for e in got] == [("h1", "T"), ("p", "one two three."), ("p", "four"), ("li", "five six"), ("p", " ")]


def test_shared_folder_is_asked_for_on_a_cluster():
    from scriptorium.session import runs_in_one_process

    assert runs_in_one_process("local[8]") and runs_in_one_process("local")
    assert not runs_in_one_process("local-cluster[3,2,1024]") and not runs_in_one_process("spark://host:7077") and not runs_in_one_process("yarn")


def test_tag_rules_order(spark):
    topics = spark.createDataFrame([(0, "topic", "t"), (4, "late", "l")], "rule_pos int, name string, keyword string")
    dictionary = spark.createDataFrame(
        [("credentials", 0, "Cert", "cert"), ("organizations", 1, "Org B", "b"), ("organizations", 0, "Org A", "a"), ("people", 0, "P", "p"), ("locations", 7, "L", "l")],
        "etype string, entry_pos int, canonical string, alias string",
    )
    rules = normalize.tag_rules(topics, dictionary).orderBy("rule_pos").collect()
    assert [r["name"] for r in rules] == ["topic", "late", "org-a", "org-b", "l", "cert"]
    assert len({r["rule_pos"] for r in rules}) == 6


def test_alias_conflicts_with_a_shared_alias(spark):
    rows = [("people", 0, 0, "A", "x"), ("people", 1, 0, "B", "X "), ("places", 2, 0, "A", "x"), ("people", 3, 0, "C", "x"), ("people", 4, 0, "D", "only"), ("people", 5, 0, "E", "")]
    d = spark.createDataFrame(rows, "etype string, entry_pos int, alias_pos int, canonical string, alias string")
    assert sorted(map(tuple, validate.alias_conflicts(d).collect())) == [("X ", "people", "A", "people", "B"), ("x", "places", "A", "people", "C")]


def test_context_holds_entities_lanes_and_profiles_in_order(spark):
    queries = spark.createDataFrame([(1, "topic one"), (2, "topic two")], "query_id int, query string")
    lanes = spark.createDataFrame([(1, "knowledge", "K"), (1, "news", "N"), (1, "editorial", "  ")], "query_id int, lane string, block string")
    graph = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_id int, pos int, block string")
    entities = context.entity_block(
        spark.createDataFrame([(1, "people", "Zoe"), (1, "organizations", "B"), (1, "organizations", "A"), (1, "people", "Zoe")], "query_id int, etype string, name string")
    )
    got = {r["query_id"]: r["context"] for r in context.context_pack(queries, lanes, graph, entities).collect()}
    assert got[1] == (
        "Topic: topic one\n\n=== DETECTED ENTITIES ===\n\n  Organizations: A, B\n  People: Zoe\n\n=== NEWS / EVENT EVIDENCE ===\n\nN\n\n"
        "=== INSTITUTIONAL KNOWLEDGE ===\n\nK\n\n=== KNOWLEDGE GRAPH CONTEXT ===\n\nfirst\n\nsecond"
    )
    assert got[2] == "Topic: topic two"


def test_pattern_is_found_across_the_joined_texts(spark):
    hits = spark.createDataFrame([(1, 2, "two", "T2"), (1, 1, "one", "T1"), (1, 6, "six", "T6")], "query_id int, rank int, chunk_text string, title string")
    cases = spark.createDataFrame([(1, "T1 TWO", 2)], "query_id int, expected_text_contains string, min_results int")
    (row,) = evaluate.eval_text(hits, cases).collect()
    assert (row["n_results"], row["matched"], row["passed"]) == (2, True, True)


def test_posts_are_numbered_in_feed_order(spark):
    rows = [(f"s{i % 37:02d}", f"2024-01-{i % 28 + 1:02d}" if i % 5 else None) for i in range(400)] + [(None, None), ("s01", None), (None, "2024-01-03")]
    posts = spark.createDataFrame(rows, "slug string, date string").select("slug", F.to_date("date").alias("date"), F.lit(0).alias("n")).repartition(7)
    got = sorted((r["feed_position"], r["slug"], r["date"]) for r in normalize.number_posts(posts).collect())
    want = [(r["slug"], r["date"]) for r in normalize.sort_posts(posts).collect()]
    assert [g[0] for g in got] == list(range(1, len(rows) + 1)) and [g[1:] for g in got] == want
    assert normalize.number_posts(posts.where("n > 0")).count() == 0
