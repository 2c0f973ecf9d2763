"""Index maintenance, refresh, front matter and whole-job queries."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import buckets, index as ix, refresh, validate as va
from scriptorium.plans import jobs
from scriptorium.session import shared_folder, written
from scriptorium.sources import readers, writers
from workloads import assets as mw, chunks as ck, corpus, drafts as dw, fixtures as fx, graphs, labels, searching as sw

SOURCES = ("src0", "src1", "src2", "src3", "src4")


def _order() -> list:
    return [F.desc("section_no")]



def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New versions of everything from five sources: every third text changed, one slug twice."""
    posts = fx.posts(spark, sf_dir).where(F.col("source_document").isin(*SOURCES))
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Corrected.\n\n"), "body")).otherwise(F.col("body"))
    fresh = posts.withColumn("body", changed).withColumn("source_document", F.upper("source_document")).withColumn("section_no", F.lit(1))
    again = fresh.where("doc_id % 4 = 0").withColumn("title", F.lit("Second version")).withColumn("section_no", F.lit(2))
    return fresh.unionByName(again)


_IN = "source_document IN ('src0', 'src1', 'src2', 'src3', 'src4')"
INCOMING_SQL = f"""
fresh AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'Corrected.' || chr(10) || chr(10) || body ELSE body END AS body, upper(source_document) AS source_document,
    CASE WHEN doc_id % 4 = 0 THEN 'Second version' ELSE title END AS title) FROM posts WHERE {_IN}
),
after AS MATERIALIZED (SELECT * FROM posts WHERE NOT ({_IN}) UNION ALL SELECT * FROM fresh)"""


def match_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = incoming(spark, sf_dir).select("source_document").distinct()
    return refresh.match_existing(fx.posts(spark, sf_dir), sources).select("slug", "source_document")


def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = incoming(spark, sf_dir).select("source_document").distinct()
    return refresh.snapshot_manifest(refresh.match_existing(fx.posts(spark, sf_dir), sources), "2024-06-01")


SNAPSHOT_SQL = f"""WITH {fx.POSTS_SQL}, m AS (SELECT * FROM posts WHERE {_IN})
SELECT '2024-06-01' AS created_at, (SELECT count(*) FROM m) AS posts, count(DISTINCT r) AS images
FROM (SELECT unnest(list_concat([featured_image], gallery_images)) AS r FROM m) WHERE r <> ''"""


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = refresh.replace_source(fx.posts(spark, sf_dir), incoming(spark, sf_dir), _order())
    return after.select("slug", "title", "body", "source_document")


REPLACE_SQL = f"WITH {fx.POSTS_SQL}, {INCOMING_SQL} SELECT slug, title, body, source_document FROM after"


@cache
def _refreshed(spark: SparkSession, sf_dir: str) -> jobs.Refreshed:
    return jobs.refresh_corpus(fx.posts(spark, sf_dir), sw.news_index(spark, sf_dir), incoming(spark, sf_dir), fx.dictionary(spark), order=_order())


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the incoming posts written over the index without deleting anything first."""
    old = sw.news_index(spark, sf_dir)
    fresh = ix.latest(incoming(spark, sf_dir), "slug", _order())
    new, _ = ix.ingest_posts(fresh, fx.dictionary(spark))
    return ix.upsert(old, new.drop("ingested_at")).select("chunk_id", "chunk_text")


_FRESH_CHUNKS = f"{sw._rename(ck._SECTIONS + ', ' + ck.chunks_sql(), 'posts', 'fresh')}"
for _name in (
    "body_lines", "marked", "numbered", "first_secs", "heads", "sections", "paths", "paras", "sums", "overlap_at", "steps", "walk", "pieces",
    "body_chunks", "intros", "all_chunks", "chunks",
):
    _FRESH_CHUNKS = sw._rename(_FRESH_CHUNKS, _name, f"f_{_name}")
_BOTH = f"{ck.CHUNKS_CTES}, {INCOMING_SQL}, {_FRESH_CHUNKS}"
UPSERT_SQL = f"""WITH RECURSIVE {_BOTH}
SELECT chunk_id, chunk_text FROM f_chunks UNION ALL SELECT chunk_id, chunk_text FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM f_chunks)"""


def refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).index.select("chunk_id", "title", "chunk_text")


REFRESH_INDEX_SQL = f"""WITH RECURSIVE {_BOTH}
SELECT chunk_id, nullif(title, '') AS title, chunk_text FROM f_chunks JOIN fresh USING (slug) UNION ALL
SELECT chunk_id, nullif(title, ''), chunk_text FROM chunks JOIN posts USING (slug) WHERE NOT ({_IN})"""


def refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).report


REPORT_SQL = f"""WITH RECURSIVE {_BOTH}
SELECT false AS dry_run, (SELECT count(*) FROM posts) AS posts_before, (SELECT count(*) FROM posts WHERE {_IN}) AS posts_matched,
  (SELECT count(*) + count(*) FILTER (WHERE doc_id % 4 = 0) FROM posts WHERE {_IN}) AS posts_extracted,
  (SELECT count(*) FILTER (WHERE doc_id % 4 = 0) FROM posts WHERE {_IN}) AS duplicate_slugs, (SELECT count(*) FROM after) AS posts_after,
  (SELECT count(*) FROM chunks) AS chunks_before,
  (SELECT count(*) FROM f_chunks) + (SELECT count(*) FROM chunks JOIN posts USING (slug) WHERE NOT ({_IN})) AS chunks_after"""


# --- the archive on disk, stage by stage ------------------------------------------------

def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(ix.latest(incoming(spark, sf_dir), "slug", _order()))


@cache
def _archive(spark: SparkSession, sf_dir: str, by: str, **flags: bool) -> tuple[jobs.Archive, buckets.Layout]:
    folder = f"{shared_folder(spark)}/archive/{uuid.uuid4().hex}"
    layout = buckets.Layout(f"{folder}/index", by, 32)
    posts = written(fx.posts(spark, sf_dir))
    rows, _ = ix.ingest_posts(layout.deal(posts), fx.dictionary(spark))
    buckets.create_index(rows.drop("ingested_at"), layout, dealt=True)
    rules = jobs.NormalizationRules(fx.ordered_rules(spark), fx.ordered_rules(spark), "general", min_tags=3, max_tags=5)
    done = jobs.refresh_archive(
        posts, layout, _fresh(spark, sf_dir), fx.dictionary(spark), rules, fx.image_names(spark, sf_dir), folder, "2024-06-01",
        jobs.RefreshOptions(**flags),
    )
    return done, layout


def archive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir, "source_document")[0].report


def archive_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir, "source_document")[0].orphans


def archive_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _archive(spark, sf_dir, "source_document")[0].issues
    return issues.select("slug", F.size("issues").alias("n_issues"))


def archive_as_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts are not normalized, and found ones are not deleted."""
    return _archive(spark, sf_dir, "slug", regenerate=False, delete_existing=False, cms_manifest=False, backup=False)[0].report


def archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index on disk after that."""
    _, layout = _archive(spark, sf_dir, "slug", regenerate=False, delete_existing=False, cms_manifest=False, backup=False)
    return buckets.read_index(spark, layout).select("chunk_id", "chunk_text")


def archive_without_reinsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir, "slug", regenerate=False, reinsert=False, cms_manifest=False)[0].report


def archive_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir, "source_document", dry_run=True)[0].report


_NORMAL = f"{fx.ORDERED_RULES_SQL}, {corpus._RULE_HITS}, {corpus._BACKFILLED}"
for _name in ("rule_hits", "dated"):
    _NORMAL = sw._rename(_NORMAL, _name, f"f_{_name}")
_NORMAL = sw._rename(_NORMAL, "posts", "fresh")
_ARCHIVE_CTES = f"""{_BOTH}, {fx.IMAGE_NAMES_SQL}, {_NORMAL},
f_r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY rule_pos) AS rn FROM f_rule_hits),
f_named AS (SELECT slug, count(name) FILTER (WHERE rn <= 5) AS n_tags FROM fresh LEFT JOIN f_r USING (slug) GROUP BY slug),
f_refs AS (
  SELECT slug, unnest(m) AS old_ref, generate_subscripts(m, 1) AS seq FROM (
    SELECT slug, CASE WHEN featured_image <> '' THEN list_concat([featured_image], gallery_images) ELSE gallery_images END AS m FROM fresh)),
f_moved AS MATERIALIZED (
  SELECT slug, list(CASE WHEN name IS NULL THEN substr(old_ref, 8) ELSE slug || '-' || lpad(seq::VARCHAR, 2, '0') || '.' || regexp_extract(old_ref, '\\.([a-z]+)$', 1) END) AS m,
    count(*) FILTER (WHERE name IS NULL) AS lost
  FROM f_refs LEFT JOIN image_names ON name = substr(old_ref, 8) GROUP BY slug),
f_issues AS (
  SELECT slug, ((n_tags = 0)::INT + (m IS NULL)::INT + (n_tags < 3)::INT + coalesce(lost, 0) + (title = '')::INT + (body = '')::INT)::INT AS n_issues
  FROM f_dated JOIN f_named USING (slug) LEFT JOIN f_moved USING (slug)),
old_refs AS (SELECT source_document, unnest(list_concat([featured_image], gallery_images)) AS ref FROM posts),
f_orphans AS (
  SELECT name FROM image_names WHERE name NOT IN (SELECT unnest(m) FROM f_moved)
    AND name NOT IN (SELECT substr(ref, 8) FROM old_refs WHERE ref <> '' AND NOT ({_IN}))),
o_orphans AS (SELECT name FROM image_names WHERE name NOT IN (SELECT substr(ref, 8) FROM old_refs WHERE ref <> ''))"""


def _archive_sql(dry_run: str, produced: str, upserted: str, points: str, posts_after: str, missing: str, orphans: str) -> str:
    return f"""WITH RECURSIVE {_ARCHIVE_CTES}
SELECT {dry_run} AS dry_run, (SELECT count(*) FROM posts WHERE {_IN}) AS posts_found,
  (SELECT count(DISTINCT ref) FROM old_refs WHERE ref <> '' AND {_IN}) AS images_found, (SELECT count(*) FROM chunks JOIN posts USING (slug) WHERE {_IN}) AS points_found,
  (SELECT count(*) FROM fresh) AS posts_extracted, {produced} AS chunks_produced, {upserted} AS points_upserted, {points} AS index_points, {posts_after} AS posts_after,
  {missing} AS missing_metadata, 0::BIGINT AS duplicate_slugs, (SELECT count(*) FROM {orphans}) AS orphan_images"""


_MADE, _ISSUES = "(SELECT count(*) FROM f_chunks)", "(SELECT count(*) FROM f_issues WHERE n_issues > 0)"
# Without deletion chunks with a number that the new version lacks stay.
_LEFT = f"{_MADE} + (SELECT count(*) FROM chunks JOIN posts USING (slug) WHERE {_IN} AND chunk_id NOT IN (SELECT chunk_id FROM f_chunks))"
_ALL_POSTS = "(SELECT count(*) FROM posts)"
ARCHIVE_REPORT_SQL = _archive_sql("false", _MADE, _MADE, _MADE, _ALL_POSTS, _ISSUES, "f_orphans")
AS_EXTRACTED_SQL = _archive_sql("false", _MADE, _MADE, _LEFT, _ALL_POSTS, "0::BIGINT", "o_orphans")
WITHOUT_REINSERT_SQL = _archive_sql("false", "0::BIGINT", "0::BIGINT", "0::BIGINT", _ALL_POSTS, "0::BIGINT", "o_orphans")
DRY_RUN_SQL = _archive_sql("true", _MADE, "0::BIGINT", _MADE, _ALL_POSTS, _ISSUES, "o_orphans")


def _source_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts(spark, sf_dir).where(F.col("source_document").isin(*SOURCES)).select("slug")


def delete_by_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.delete_by_slugs(sw.news_index(spark, sf_dir), _source_slugs(spark, sf_dir)).select("chunk_id", "slug")


def count_for_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.count_for_slugs(sw.news_index(spark, sf_dir), _source_slugs(spark, sf_dir))


def payload_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.payload_completeness(sw.news_index(spark, sf_dir), [*va.INDEX_FIELDS, "title", "date", "category", "partner"])


COMPLETENESS_SQL = f"""WITH RECURSIVE {ck.CHUNKS_CTES}, j AS (SELECT * FROM chunks JOIN posts USING (slug))
SELECT unnest(['article_id', 'chunk_id', 'slug', 'chunk_text', 'chunk_type', 'chunk_index']) AS field, 0::BIGINT AS n_null
UNION ALL SELECT 'title', count(*) FILTER (WHERE title = '') FROM j UNION ALL SELECT 'date', count(*) FILTER (WHERE date IS NULL) FROM j
UNION ALL SELECT 'category', count(*) FROM j UNION ALL SELECT 'partner', count(*) FILTER (WHERE partner = '') FROM j"""


def index_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.index_contract(sw.news_index(spark, sf_dir), ix.DENSE_DIM)


CONTRACT_SQL = rf"""WITH RECURSIVE {ck.CHUNKS_CTES}
SELECT count(*) AS points, 64 AS min_dim, 64 AS max_dim, 0::BIGINT AS wrong_dense,
  count(*) FILTER (WHERE NOT regexp_matches(chunk_text, '[\p{{L}}\p{{N}}_]')) AS without_sparse FROM chunks"""


def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return refresh.catalog_counts(
        fx.posts(spark, sf_dir), fx.image_names(spark, sf_dir), fx.knowledge_docs(spark, sf_dir), configs, ["view", "click", "absent"]
    )


CATALOG_SQL = f"""WITH {fx.IMAGE_NAMES_SQL}
SELECT 'posts' AS measure, count(*) AS n FROM documents UNION ALL SELECT 'images', count(*) FROM image_names UNION ALL SELECT 'knowledge_docs', count(*) FROM pages
UNION ALL SELECT 'configs_managed', 3 UNION ALL SELECT 'configs_missing', 1"""


# --- front matter -----------------------------------------------------------------------

def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written out as Markdown files would hold them, and parsed again; some lack a header."""
    posts = fx.posts(spark, sf_dir)
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("slug: "), F.col("slug")),
        F.concat(F.lit("title: '"), F.regexp_replace("title", "[':]", ""), F.lit("'")),
        F.concat(F.lit("date: "), F.coalesce(F.col("date").cast("string"), F.lit(""))),
        F.concat(F.lit("tags: [a, 'b c']\ngallery_images:\n- "), F.array_join(F.array(F.lit("x.png"), F.col("source_document")), "\n- ")),
        F.lit("custom: kept"),
    )
    text = F.when(F.col("doc_id") % 9 == 0, F.col("body")).otherwise(F.concat(F.lit("---\n"), header, F.lit("\n---\n\n"), F.col("body"), F.lit("\n")))
    corpus_rows = posts.select(F.lit("f").alias("file"), F.col("slug").alias("stem"), text.alias("text"))
    parsed, rejected = readers.split_front_matter(corpus_rows)
    typed = readers.posts_from_front_matter(parsed)
    kept = typed.select(
        "slug", "title", F.col("date").cast("string").alias("date"), F.array_join("tags", "|").alias("tags"), F.array_join("gallery_images", "|").alias("gallery"),
        "body", F.col("extra").getItem("custom").alias("custom"), F.lit("ok").alias("reason"),
    )
    nothing = F.lit(None).cast("string")
    lost = rejected.select("slug", *[nothing.alias(c) for c in ("title", "date", "tags", "gallery", "body", "custom")], "reason")
    return kept.unionByName(lost)


FRONT_SQL = f"""WITH {fx.POSTS_SQL}
SELECT slug, regexp_replace(title, '['':]', '', 'g') AS title, date::VARCHAR AS date, 'a|b c' AS tags, 'x.png|' || source_document AS gallery, trim(body, ' ' || chr(10)) AS body,
  'kept' AS custom, 'ok' AS reason FROM posts WHERE doc_id % 9 <> 0
UNION ALL SELECT slug, NULL, NULL, NULL, NULL, NULL, NULL, 'no front matter' FROM posts WHERE doc_id % 9 = 0"""


# --- whole jobs ----------------------------------------------------------------------------

def normalize_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = jobs.NormalizationRules(fx.ordered_rules(spark), fx.ordered_rules(spark), "general", min_tags=3, max_tags=5)
    posts, issues = jobs.normalize_corpus(fx.posts(spark, sf_dir), fx.image_names(spark, sf_dir), rules)
    return posts.join(issues, "slug").select(
        "slug", "category", F.array_join("tags", "|").alias("tags"), F.col("date").cast("string").alias("date"), "featured_image",
        F.array_join("gallery_images", "|").alias("gallery"), F.size("issues").alias("n_issues"),
    )


NORMALIZE_SQL = f"""WITH {fx.POSTS_SQL}, {fx.IMAGE_NAMES_SQL}, {fx.ORDERED_RULES_SQL}, {corpus._RULE_HITS}, {corpus._BACKFILLED},
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY rule_pos) AS rn FROM rule_hits),
named AS (SELECT slug, coalesce(arg_min(name, rule_pos), 'general') AS category, coalesce(string_agg(name, '|' ORDER BY rule_pos) FILTER (WHERE rn <= 5), '') AS tags,
  count(name) FILTER (WHERE rn <= 5) AS n_tags FROM posts LEFT JOIN r USING (slug) GROUP BY slug),
refs AS (
  SELECT slug, unnest(m) AS old_ref, generate_subscripts(m, 1) AS seq FROM (
    SELECT slug, CASE WHEN featured_image <> '' THEN list_concat([featured_image], gallery_images) ELSE gallery_images END AS m FROM posts)
),
moved AS (
  SELECT slug, list(CASE WHEN name IS NULL THEN old_ref ELSE 'images/' || slug || '-' || lpad(seq::VARCHAR, 2, '0') || '.' || regexp_extract(old_ref, '\\.([a-z]+)$', 1) END ORDER BY seq) AS m,
    count(*) FILTER (WHERE name IS NULL) AS lost
  FROM refs LEFT JOIN image_names ON name = substr(old_ref, 8) GROUP BY slug
)
SELECT slug, category, tags, date::VARCHAR AS date, coalesce(m[1], '') AS featured_image, coalesce(array_to_string(m[2:], '|'), '') AS gallery,
  ((n_tags = 0)::INT + (m IS NULL)::INT + (n_tags < 3)::INT + coalesce(lost, 0) + (title = '')::INT + (body = '')::INT)::INT AS n_issues
FROM dated JOIN named USING (slug) LEFT JOIN moved USING (slug)"""


def routed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = jobs.routed_context(
        fx.queries(spark, sf_dir), fx.route_signals(spark), sw.news_index(spark, sf_dir), sw.knowledge_index(spark, sf_dir),
        graphs.nodes(spark, sf_dir), graphs.edges(spark, sf_dir),
    )
    return packed.select("query_id", "route", "context", "over_budget")


def draft_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each warning kind is raised."""
    checked = jobs.draft_qa(dw.drafts(spark, sf_dir), dw.RULES, dw.modes(spark))
    kinds = checked.select("mode", F.explode("qa_warnings").alias("w")).select("mode", F.regexp_extract("w", r"^QA \[([^\]]+)\]", 1).alias("kind"))
    return kinds.groupBy("mode", "kind").agg(F.count("*").alias("n"))


DRAFT_QA_SQL = f"""WITH {dw.DRAFTS_SQL}, m AS (SELECT mode, unnest(list_distinct(list_concat(s.w, b.w))) AS w FROM style s JOIN by_mode b USING (draft_id))
SELECT mode, regexp_extract(w, '^QA \\[([^\\]]+)\\]', 1) AS kind, count(*) AS n FROM m GROUP BY 1, 2"""


def rank_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets per part and role."""
    return jobs.rank_media(mw.assets(spark, sf_dir)).groupBy("part", "role").agg(F.count("*").alias("n"))


RANK_MEDIA_SQL = f"WITH RECURSIVE {mw.GROUPS_SQL}, {mw._BEST_SQL}, {mw._ROLES_SQL} SELECT part, role, count(*) AS n FROM roles GROUP BY part, role"


def batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.batch_index(labels.classified(spark, sf_dir))


BATCH_INDEX_SQL = f"""{labels.CLASSIFIED_CTES}
SELECT slug, category, subcategory, source AS classification_source, category_score, round(entity_extraction_score * 6 / 100.0)::INT AS detected_entity_types, true AS ok FROM classified"""

QUERIES = {
    "archive_report": (archive_report, ARCHIVE_REPORT_SQL),
    "archive_orphans": (archive_orphans, f"WITH RECURSIVE {_ARCHIVE_CTES} SELECT name FROM f_orphans"),
    "archive_issues": (archive_issues, f"WITH RECURSIVE {_ARCHIVE_CTES} SELECT slug, n_issues FROM f_issues"),
    "archive_as_extracted": (archive_as_extracted, AS_EXTRACTED_SQL),
    "archive_index": (archive_index, UPSERT_SQL),
    "archive_without_reinsert": (archive_without_reinsert, WITHOUT_REINSERT_SQL),
    "archive_dry_run": (archive_dry_run, DRY_RUN_SQL),
    "match_existing": (match_existing, f"WITH {fx.POSTS_SQL} SELECT slug, source_document FROM posts WHERE {_IN}"),
    "snapshot_manifest": (snapshot_manifest, SNAPSHOT_SQL),
    "replace_source": (replace_source, REPLACE_SQL),
    "upsert": (upsert, UPSERT_SQL),
    "refresh_index": (refresh_index, REFRESH_INDEX_SQL),
    "refresh_report": (refresh_report, REPORT_SQL),
    "delete_by_slugs": (delete_by_slugs, f"WITH RECURSIVE {ck.CHUNKS_CTES} SELECT chunk_id, slug FROM chunks JOIN posts USING (slug) WHERE NOT ({_IN})"),
    "count_for_slugs": (count_for_slugs, f"WITH RECURSIVE {ck.CHUNKS_CTES} SELECT count(*) AS n_chunks FROM chunks JOIN posts USING (slug) WHERE {_IN}"),
    "payload_completeness": (payload_completeness, COMPLETENESS_SQL),
    "index_contract": (index_contract, CONTRACT_SQL),
    "catalog_counts": (catalog_counts, CATALOG_SQL),
    "front_matter": (front_matter, FRONT_SQL),
    "normalize_corpus": (normalize_corpus, NORMALIZE_SQL),
    "routed_context": (routed_context, None),
    "draft_qa": (draft_qa, DRAFT_QA_SQL),
    "rank_media": (rank_media, RANK_MEDIA_SQL),
    "batch_index": (batch_index, BATCH_INDEX_SQL),
}
