"""Validation, segmentation, normalization and publishing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import normalize as nz, validate as va
from scriptorium.sources import writers
from workloads import fixtures as fx


# --- validation ---------------------------------------------------------------------

def validate_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = va.validate_posts(fx.posts(spark, sf_dir), require_summary=True, fail_on_missing_date=True)
    return checked.select("slug", F.array_join("warnings", "; ").alias("warnings"), "valid")


VALIDATE_POSTS_SQL = f"""WITH {fx.POSTS_SQL}
SELECT slug, concat_ws('; ', CASE WHEN title = '' THEN 'missing title' END, CASE WHEN trim(summary) = '' THEN 'missing summary' END,
  CASE WHEN date IS NULL THEN 'missing date' END) AS warnings, date IS NOT NULL AS valid FROM posts"""


def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = va.validate_required(fx.knowledge_docs(spark, sf_dir))
    return checked.select("slug", F.array_join("warnings", "; ").alias("warnings"), "valid")


VALIDATE_REQUIRED_SQL = f"""WITH {fx.KNOWLEDGE_SQL}, w AS (
SELECT slug, concat_ws('; ', CASE WHEN title = '' THEN 'missing field: title' END, CASE WHEN language = '' THEN 'missing field: language' END,
  CASE WHEN priority = '' THEN 'missing field: priority' END,
  CASE WHEN memory_layer <> 'knowledge' THEN 'memory_layer must be ''knowledge'', got ''' || memory_layer || '''' END) AS warnings FROM knowledge_docs)
SELECT slug, warnings, warnings = '' AS valid FROM w"""


def validate_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = va.validate_normalized(fx.posts(spark, sf_dir), fx.image_names(spark, sf_dir))
    return issues.select("slug", F.array_join("issues", "; ").alias("issues"))


VALIDATE_NORMALIZED_SQL = f"""WITH {fx.POSTS_SQL}, {fx.IMAGE_NAMES_SQL}
SELECT slug, concat_ws('; ', CASE WHEN title = '' THEN 'missing: title' END, CASE WHEN date IS NULL THEN 'missing: date' END, 'missing: category',
  'missing: tags', CASE WHEN summary = '' THEN 'missing: summary' END, CASE WHEN featured_image = '' THEN 'missing: featured_image' END,
  CASE WHEN date IS NULL THEN 'missing: year (date not parsed)' END, 'low tag count: 0 (min 3)',
  CASE WHEN featured_image <> '' AND substr(featured_image, 8) NOT IN (SELECT name FROM image_names) THEN 'image file not found: ' || featured_image END,
  CASE WHEN len(gallery_images) > 0 AND substr(gallery_images[1], 8) NOT IN (SELECT name FROM image_names) THEN 'gallery image not found: ' || gallery_images[1] END,
  CASE WHEN len(gallery_images) > 1 AND substr(gallery_images[2], 8) NOT IN (SELECT name FROM image_names) THEN 'gallery image not found: ' || gallery_images[2] END
  ) AS issues FROM posts"""


def duplicate_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs made of titles alone; copies of a document share one."""
    posts = fx.posts(spark, sf_dir).withColumn("slug", tx.slugify(F.col("title"), "tag"))
    return va.duplicate_slugs(posts)


_TAG_SLUG = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-')"
DUPLICATE_SLUGS_SQL = f"""WITH {fx.POSTS_SQL}
SELECT slug, count(*) AS n FROM (SELECT {_TAG_SLUG.format('title')} AS slug FROM posts) GROUP BY slug HAVING count(*) > 1"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    title = F.col("title")
    return posts.select(
        "slug",
        tx.slugify(title, "tag").alias("tag_slug"),
        tx.slugify(title, "topic", year=F.col("year")).alias("topic_slug"),
        tx.slugify(title, "export_topic").alias("export_slug"),
        tx.slugify(title, "post").alias("post_slug"),
    )


SLUGS_SQL = rf"""WITH {fx.POSTS_SQL}, t AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS topic FROM posts),
c AS (SELECT *, CASE WHEN len(topic) <= 50 THEN topic WHEN contains(substr(topic, 1, 50), '-')
      THEN regexp_replace(substr(topic, 1, 50), '-[^-]*$', '') ELSE substr(topic, 1, 50) END AS cut FROM t)
SELECT slug, {_TAG_SLUG.format('title')} AS tag_slug, cut || coalesce('-' || year, '') AS topic_slug,
  substr(regexp_replace(trim(lower(title)), '[^\p{{L}}\p{{N}}_-]', '-', 'g'), 1, 60) AS export_slug,
  substr(trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-'), 1, 80) AS post_slug
FROM c"""


def orphan_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.orphan_media(fx.image_names(spark, sf_dir), fx.posts(spark, sf_dir))


ORPHANS_SQL = f"""WITH {fx.POSTS_SQL}, {fx.IMAGE_NAMES_SQL}
SELECT name FROM image_names WHERE name NOT IN (
  SELECT substr(r, 8) FROM (SELECT unnest(list_concat([featured_image], gallery_images)) AS r FROM posts))"""


def alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts as a dictionary in which market segments and types are shared aliases."""
    customers = fx.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("etype"), F.col("c_custkey").alias("entry_pos"), F.col("c_name").alias("canonical"), F.array("c_name", "c_mktsegment").alias("a")
    )
    parts = fx.table(spark, sf_dir, "part").select(
        F.lit("part"), F.col("p_partkey") + 10_000_000, F.col("p_name"), F.array("p_name", "p_brand")
    )
    return va.alias_conflicts(customers.union(parts).select("etype", "entry_pos", "canonical", F.posexplode("a").alias("alias_pos", "alias")))


ALIAS_CONFLICTS_SQL = """WITH d AS (
  SELECT 'customer' AS etype, c_custkey AS entry_pos, c_name AS canonical, unnest([c_name, c_mktsegment]) AS alias, unnest([0, 1]) AS alias_pos FROM customer
  UNION ALL SELECT 'part', p_partkey + 10000000, p_name, unnest([p_name, p_brand]), unnest([0, 1]) FROM part
), o AS (
  SELECT *, first_value(canonical) OVER w AS owner, first_value(etype) OVER w AS owner_etype FROM d WINDOW w AS (PARTITION BY lower(trim(alias)) ORDER BY entry_pos, alias_pos)
), t AS (
  SELECT *, max_by(CASE WHEN canonical = owner THEN etype END, CASE WHEN canonical = owner THEN (entry_pos, alias_pos) END)
    OVER (PARTITION BY lower(trim(alias)) ORDER BY entry_pos, alias_pos) AS owner_type FROM o
)
SELECT alias, owner_type, owner, etype AS claimant_type, canonical AS claimant FROM t WHERE canonical <> owner"""


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.coverage_report(fx.posts(spark, sf_dir))


COVERAGE_SQL = f"""WITH {fx.POSTS_SQL}
SELECT count(*) AS total, count(date) AS dated, count(*) FILTER (WHERE featured_image <> '') AS with_image, 0::BIGINT AS with_tags FROM posts"""


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.coverage_gaps(fx.posts(spark, sf_dir))


GAPS_SQL = f"""WITH {fx.POSTS_SQL}
SELECT slug, 'date' AS gap FROM posts WHERE date IS NULL UNION ALL SELECT slug, 'featured_image' FROM posts WHERE featured_image = ''"""


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = nz.assign_category(fx.posts(spark, sf_dir), fx.ordered_rules(spark), "")
    return va.category_counts(posts, blank_as="General")


# --- segmentation ------------------------------------------------------------------------

def lines_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.spread(fx.table(spark, sf_dir, "pages").select("page_id", "html"))
    line = F.transform(
        fx.page_elements(F.col("html")),
        lambda e: F.struct(
            F.when(e["kind"] == "h1", 1).otherwise(0).alias("level"), e["text"].alias("text"), (e["kind"] == "li").alias("is_list"),
            F.lit(None).cast("string").alias("image"),
        ),
    )
    return pages.select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".docx")).alias("source_document"), line.alias("lines"))


def segment_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = nz.segment_posts(lines_of_pages(spark, sf_dir))
    return sections.select("source_document", "section_no", "title", F.size("lines").alias("n_lines"))


_LINES_SQL = rf"""
page_lines AS MATERIALIZED (
  SELECT 'page-' || page_id || '.docx' AS source_document, kind, text, i FROM ({fx.PAGE_ELEMENTS_SQL})
),
counted AS (SELECT *, sum((kind = 'h1')::INT) OVER (PARTITION BY source_document ORDER BY i) AS sec,
  bool_or(kind = 'h1') OVER (PARTITION BY source_document) AS cut FROM page_lines),
sections AS MATERIALIZED (
  SELECT source_document, greatest(sec, 1)::INT AS section_no,
    coalesce(max(CASE WHEN kind = 'h1' THEN trim(text) END), replace(source_document, '.docx', '')) AS title,
    count(*) FILTER (WHERE kind <> 'h1')::INT AS n_lines,
    arg_min(trim(text), i) FILTER (WHERE kind <> 'h1' AND trim(text) <> '') AS first_text,
    coalesce(string_agg(CASE WHEN kind = 'li' THEN '- ' ELSE '' END || trim(text), chr(10) ORDER BY i) FILTER (WHERE kind <> 'h1' AND trim(text) <> ''), '') AS body
  FROM counted WHERE sec > 0 OR NOT cut GROUP BY source_document, sec
)"""
SEGMENT_SQL = f"WITH {_LINES_SQL} SELECT source_document, section_no, title, n_lines FROM sections"


def build_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = nz.build_posts(nz.segment_posts(lines_of_pages(spark, sf_dir)))
    return posts.select("source_document", "internal", "title", "slug", "summary", "body", "seo_title", "seo_description", "featured_image")


BUILD_SQL = rf"""WITH {_LINES_SQL}, t AS (SELECT *, lpad(section_no::VARCHAR, 3, '0') AS nnn,
  coalesce(nullif(trim(regexp_replace(title, '(?i)\s*[\[(]*[)\]]*\s*[–—-]*\s*Internal\s*$', '')), ''), substr(first_text, 1, 80), 'Untitled Post') AS t2,
  coalesce(substr(first_text, 1, 200) || CASE WHEN len(first_text) > 200 THEN '…' ELSE '' END, '') AS s FROM sections)
SELECT source_document, 'post-' || nnn AS internal, t2 AS title,
  coalesce(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(t2)), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-'), 1, 80), ''), 'post-' || nnn) AS slug,
  s AS summary, body, substr(t2, 1, 60) AS seo_title, substr(s, 1, 155) AS seo_description, '' AS featured_image FROM t"""


# --- normalization --------------------------------------------------------------------------

def backfill_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.backfill_date(fx.posts(spark, sf_dir)).select("slug", F.col("date").cast("string").alias("date"), "year", "quarter", "month")


_BACKFILLED = """
dated AS (
  SELECT * REPLACE (CASE WHEN doc_id % 10 <> 3 THEN date WHEN doc_id % 4 = 0 THEN DATE '2024-03-15' WHEN doc_id % 4 = 1 THEN DATE '2024-03-05'
    WHEN doc_id % 4 = 2 THEN DATE '2024-03-04' ELSE DATE '2024-03-01' END AS date) FROM posts
)"""
BACKFILL_SQL = f"""WITH {fx.POSTS_SQL}, {_BACKFILLED}
SELECT slug, date::VARCHAR AS date, year(date)::INT AS year, 'Q' || quarter(date) AS quarter, month(date)::INT AS month FROM dated"""

_RULE_HITS = """
hay AS MATERIALIZED (SELECT slug, lower(title || ' ' || summary || ' ' || body) AS t FROM posts),
rule_hits AS MATERIALIZED (SELECT DISTINCT slug, rule_pos, name FROM hay JOIN ordered_rules ON contains(t, keyword))"""


def assign_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.assign_category(fx.posts(spark, sf_dir), fx.ordered_rules(spark), "general").select("slug", "category")


def assign_category_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.assign_category(fx.posts(spark, sf_dir), fx.ordered_rules(spark), "general", max_inline=0).select("slug", "category")


CATEGORY_SQL = f"""WITH {fx.POSTS_SQL}, {fx.ORDERED_RULES_SQL}, {_RULE_HITS}
SELECT slug, coalesce(arg_min(name, rule_pos), 'general') AS category FROM posts LEFT JOIN rule_hits USING (slug) GROUP BY slug"""
CATEGORY_COUNTS_SQL = f"""WITH {fx.POSTS_SQL}, {fx.ORDERED_RULES_SQL}, {_RULE_HITS},
c AS (SELECT slug, coalesce(arg_min(name, rule_pos), 'General') AS category FROM posts LEFT JOIN rule_hits USING (slug) GROUP BY slug)
SELECT category, count(*) AS n FROM c GROUP BY category"""


def assign_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = nz.assign_tags(fx.posts(spark, sf_dir), fx.ordered_rules(spark), min_tags=3, max_tags=5)
    return tagged.select("slug", F.array_join("tags", "|").alias("tags"))


TAGS_SQL = f"""WITH {fx.POSTS_SQL}, {fx.ORDERED_RULES_SQL}, {_RULE_HITS},
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY rule_pos) AS rn FROM rule_hits)
SELECT slug, coalesce(string_agg(name, '|' ORDER BY rule_pos) FILTER (WHERE rn <= 5), '') AS tags FROM posts LEFT JOIN r USING (slug) GROUP BY slug"""


def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = nz.summarize_posts(fx.posts(spark, sf_dir))
    return posts.select("slug", "summary", "seo_description", nz.seo_title(F.col("source_section")).alias("seo_title"))


SUMMARY_SQL = r"""WITH {posts}, raw AS (
  SELECT slug, source_section, coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda l: trim(l)),
    lambda l: l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, 'http'))[1], trim(summary)) AS r FROM posts
), cut AS (SELECT *, substr(r, 1, 200) AS c FROM raw),
pos AS (
  SELECT *, CASE WHEN contains(c, '. ') THEN len(c) - strpos(reverse(c), ' .') - 1 ELSE -1 END AS p1,
    CASE WHEN contains(c, '! ') THEN len(c) - strpos(reverse(c), ' !') - 1 ELSE -1 END AS p2,
    CASE WHEN contains(c, '? ') THEN len(c) - strpos(reverse(c), ' ?') - 1 ELSE -1 END AS p3,
    CASE WHEN contains(c, ' ') THEN len(c) - strpos(reverse(c), ' ') ELSE -1 END AS p4 FROM cut
), s AS (
  SELECT slug, source_section, CASE WHEN len(r) <= 200 THEN r WHEN p1 > 60 THEN substr(c, 1, p1 + 1) WHEN p2 > 60 THEN substr(c, 1, p2 + 1)
    WHEN p3 > 60 THEN substr(c, 1, p3 + 1) WHEN p4 > 60 THEN substr(c, 1, p4) || '…' ELSE rtrim(c) || '…' END AS summary FROM pos
)
SELECT slug, summary, CASE WHEN len(summary) <= 155 THEN summary WHEN contains(substr(summary, 1, 155), ' ')
    THEN regexp_replace(substr(summary, 1, 155), ' [^ ]*$', '') || '…' ELSE substr(summary, 1, 155) END AS seo_description,
  CASE WHEN len(source_section) <= 60 THEN source_section
       WHEN contains(substr(source_section, 1, 60), ' ') AND len(regexp_replace(substr(source_section, 1, 60), ' [^ ]*$', '')) > 20
       THEN rtrim(regexp_replace(substr(source_section, 1, 60), ' [^ ]*$', ''), '- ,') ELSE rtrim(substr(source_section, 1, 60), '- ,') END AS seo_title
FROM s""".replace("{posts}", fx.POSTS_SQL)


def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.posts(spark, sf_dir).select("slug", tx.extract_summary(F.col("body")).alias("summary"))


# The leading sentences as a walk: one step per sentence until the summary is long enough.
EXTRACT_SQL = r"""WITH RECURSIVE {posts}, plain AS (
  SELECT slug, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(body, '#{1,6}\s+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g'),
    '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`[^`]+`', '', 'g'), '(?m)^[-*+]\s+', '', 'g'), '(?m)^\d+\.\s+', '', 'g'), '\n{3,}', E'\n\n', 'g'), ' ' || chr(10)) AS p FROM posts
), marked AS (SELECT slug, p, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM plain),
sentences AS MATERIALIZED (
  SELECT slug, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM marked
), sized AS MATERIALIZED (SELECT slug, i, trim(s, ' ' || chr(10)) AS s, greatest(1, len(regexp_extract_all(s, '\S+'))) AS n FROM sentences),
walk AS (
  SELECT slug, 1 AS i, s AS summary, n AS words, n >= 30 AS stop FROM sized WHERE i = 1
  UNION ALL
  SELECT z.slug, z.i, CASE WHEN w.words + z.n > 60 AND w.summary <> '' THEN w.summary WHEN w.summary = '' THEN z.s ELSE w.summary || ' ' || z.s END,
    CASE WHEN w.words + z.n > 60 AND w.summary <> '' THEN w.words ELSE w.words + z.n END, w.words + z.n >= 30
  FROM walk w JOIN sized z ON z.slug = w.slug AND z.i = w.i + 1 WHERE NOT w.stop
)
SELECT slug, coalesce(nullif(arg_max(w.summary, w.i), ''), any_value(rtrim(substr(p, 1, 250)))) AS summary
FROM plain LEFT JOIN walk w USING (slug) GROUP BY slug""".replace("{posts}", fx.POSTS_SQL)


def media_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nz.media_refs(fx.posts(spark, sf_dir), fx.image_names(spark, sf_dir))


MEDIA_REFS_SQL = f"""WITH {fx.POSTS_SQL}, {fx.IMAGE_NAMES_SQL}, refs AS (
  SELECT slug, unnest(m) AS old_ref, generate_subscripts(m, 1) AS seq FROM (
    SELECT slug, CASE WHEN featured_image <> '' THEN list_concat([featured_image], gallery_images) ELSE gallery_images END AS m FROM posts)
)
SELECT slug, seq::INT AS seq, old_ref, CASE WHEN name IS NULL THEN old_ref ELSE 'images/' || slug || '-' || lpad(seq::VARCHAR, 2, '0') || '.' || regexp_extract(old_ref, '\\.([a-z]+)$', 1) END AS new_ref,
  name IS NULL AS missing
FROM refs LEFT JOIN image_names ON name = substr(old_ref, 8)"""


def sort_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in feed order."""
    ordered = nz.sort_posts(fx.posts(spark, sf_dir).select("slug", "date"))
    return ordered.select("slug", F.col("date").cast("string").alias("date"))


def feed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts numbered in feed order."""
    numbered = nz.number_posts(fx.posts(spark, sf_dir).select("slug", "date"))
    return numbered.select("slug", F.col("date").cast("string").alias("date"), "feed_position")


# --- publishing --------------------------------------------------------------------------------

def posts_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = writers.posts_feed(fx.posts(spark, sf_dir), "https://example.org/")
    return feed.select(
        "id", "url", "title", "summary", "date", "date_published", "year", "quarter", "featured_image",
        F.array_join("gallery_images", "|").alias("gallery"), "location", "partner", "source_document", "body_markdown",
    )


POSTS_FEED_SQL = f"""WITH {fx.POSTS_SQL}
SELECT slug AS id, 'https://example.org/posts/' || slug AS url, nullif(title, '') AS title, nullif(summary, '') AS summary, date::VARCHAR AS date,
  strftime(date, '%Y-%m-%dT00:00:00+00:00') AS date_published, year::INT AS year, quarter,
  CASE WHEN featured_image <> '' THEN 'https://example.org/' || featured_image END AS featured_image,
  coalesce(array_to_string(list_transform(gallery_images, lambda g: 'https://example.org/' || g), '|'), '') AS gallery,
  nullif(location, '') AS location, nullif(partner, '') AS partner, source_document, nullif(body, '') AS body_markdown FROM posts"""


def json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read back from their JSON, so that dropped fields show."""
    items = writers.json_feed_items(fx.posts(spark, sf_dir), "https://example.org")

    def field(path: str):
        return F.get_json_object("item", f"$.{path}")

    return items.select(
        field("id").alias("id"), field("title").alias("title"), field("image").alias("image"), field("content_text").alias("content_text"),
        field("_archive.partner").alias("partner"), F.col("item").contains('"tags"').alias("has_tags"),
    )


JSON_FEED_SQL = f"""WITH {fx.POSTS_SQL}
SELECT 'https://example.org/posts/' || slug AS id, nullif(title, '') AS title, CASE WHEN featured_image <> '' THEN 'https://example.org/' || featured_image END AS image,
  nullif(body, '') AS content_text, nullif(partner, '') AS partner, false AS has_tags FROM posts"""


def publishing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = writers.publishing_manifest(fx.posts(spark, sf_dir))
    return manifest.select("internal", "slug", "title", "year", "quarter", "featured_image", "summary", "source_document")


MANIFEST_SQL = f"WITH {fx.POSTS_SQL} SELECT internal, slug, title, year::INT AS year, quarter, featured_image, summary, source_document FROM posts"


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.source_manifest(fx.posts(spark, sf_dir)).select("source_document", "slug", "image_count")


SOURCE_MANIFEST_SQL = f"""WITH {fx.POSTS_SQL}
SELECT source_document, slug, (len(gallery_images) + (featured_image <> '')::INT)::INT AS image_count FROM posts"""


def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    sheet = writers.review_sheet(posts, va.validate_normalized(posts, fx.image_names(spark, sf_dir), fields=["title", "date"], min_tags=0))
    return sheet.select("slug", "tags", "image_count", "validation")


REVIEW_SQL = f"""WITH {fx.POSTS_SQL}, {fx.IMAGE_NAMES_SQL}
SELECT slug, '' AS tags, (len(gallery_images) + (featured_image <> '')::INT)::INT AS image_count, coalesce(nullif(concat_ws('; ',
  CASE WHEN title = '' THEN 'missing: title' END, CASE WHEN date IS NULL THEN 'missing: date' END, CASE WHEN date IS NULL THEN 'missing: year (date not parsed)' END,
  CASE WHEN featured_image <> '' AND substr(featured_image, 8) NOT IN (SELECT name FROM image_names) THEN 'image file not found: ' || featured_image END,
  CASE WHEN len(gallery_images) > 0 AND substr(gallery_images[1], 8) NOT IN (SELECT name FROM image_names) THEN 'gallery image not found: ' || gallery_images[1] END,
  CASE WHEN len(gallery_images) > 1 AND substr(gallery_images[2], 8) NOT IN (SELECT name FROM image_names) THEN 'gallery image not found: ' || gallery_images[2] END), ''), 'ok') AS validation FROM posts"""


def cms_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = writers.cms_articles(fx.posts(spark, sf_dir))
    return a.select(
        F.col("externalReferenceCode").alias("code"), F.col("friendlyUrlPath").alias("path"), F.col("title").getItem("en_US").alias("title"),
        F.size("taxonomyCategories").alias("n_categories"), F.col("contentFields.GalleryImages").alias("gallery"), F.col("contentFields.Partner").alias("partner"),
    )


CMS_ARTICLES_SQL = f"""WITH {fx.POSTS_SQL}
SELECT 'WH-' || slug AS code, 'highlights/' || slug AS path, title, 0 AS n_categories, coalesce(array_to_string(gallery_images, ', '), '') AS gallery, partner FROM posts"""


def cms_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = writers.cms_media(fx.posts(spark, sf_dir))
    return m.select(
        F.col("externalReferenceCode").alias("code"), F.col("fileName").alias("file"), F.col("title").getItem("en_US").alias("title"),
        F.col("articleReference").alias("article"), "sequence", F.col("mediaType").alias("kind"),
    )


CMS_MEDIA_SQL = f"""WITH {fx.POSTS_SQL}
SELECT 'IMG-' || slug || '-01' AS code, substr(featured_image, 8) AS file, title || ' — Featured Image' AS title, 'WH-' || slug AS article, 1 AS sequence, 'featured' AS kind
FROM posts WHERE featured_image <> ''
UNION ALL
SELECT 'IMG-' || slug || '-' || lpad((i + 1)::VARCHAR, 2, '0'), substr(g, 8), title || ' — Image ' || (i + 1), 'WH-' || slug, (i + 1)::INT, 'gallery'
FROM (SELECT slug, title, unnest(gallery_images) AS g, generate_subscripts(gallery_images, 1) AS i FROM posts)"""

QUERIES = {
    "validate_posts": (validate_posts, VALIDATE_POSTS_SQL),
    "validate_required": (validate_required, VALIDATE_REQUIRED_SQL),
    "validate_normalized": (validate_normalized, VALIDATE_NORMALIZED_SQL),
    "duplicate_slugs": (duplicate_slugs, DUPLICATE_SLUGS_SQL),
    "slugs": (slugs, SLUGS_SQL),
    "orphan_media": (orphan_media, ORPHANS_SQL),
    "alias_conflicts": (alias_conflicts, ALIAS_CONFLICTS_SQL),
    "coverage_report": (coverage_report, COVERAGE_SQL),
    "coverage_gaps": (coverage_gaps, GAPS_SQL),
    "category_counts": (category_counts, CATEGORY_COUNTS_SQL),
    "segment_posts": (segment_posts, SEGMENT_SQL),
    "build_posts": (build_posts, BUILD_SQL),
    "backfill_date": (backfill_date, BACKFILL_SQL),
    "assign_category": (assign_category, CATEGORY_SQL),
    "assign_category_joined": (assign_category_joined, CATEGORY_SQL),
    "assign_tags": (assign_tags, TAGS_SQL),
    "clean_summary": (clean_summary, SUMMARY_SQL),
    "extract_summary": (extract_summary, EXTRACT_SQL),
    "media_refs": (media_refs, MEDIA_REFS_SQL),
    "feed_positions": (
        feed_positions,
        f"""WITH {fx.POSTS_SQL}
        SELECT slug, date::VARCHAR AS date, row_number() OVER (ORDER BY (date IS NULL) DESC, date DESC, slug) AS feed_position FROM posts""",
    ),
    "sort_posts": (sort_posts, f"WITH {fx.POSTS_SQL} SELECT slug, date::VARCHAR AS date FROM posts"),
    "posts_feed": (posts_feed, POSTS_FEED_SQL),
    "json_feed": (json_feed, JSON_FEED_SQL),
    "publishing_manifest": (publishing_manifest, MANIFEST_SQL),
    "source_manifest": (source_manifest, SOURCE_MANIFEST_SQL),
    "review_sheet": (review_sheet, REVIEW_SQL),
    "cms_articles": (cms_articles, CMS_ARTICLES_SQL),
    "cms_media": (cms_media, CMS_MEDIA_SQL),
}
