"""Dictionary tagging and classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import classify, tagging
from workloads import fixtures as fx

# One row per document and term that hits, in both kinds of matching.
TAGS_SQL = r"""
texts AS MATERIALIZED (SELECT slug, lower(concat_ws(chr(10), nullif(title, ''), nullif(summary, ''), nullif(body, ''))) AS t FROM posts),
tokens AS MATERIALIZED (SELECT slug, unnest(list_distinct(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'))) AS token FROM texts),
plain_tags AS MATERIALIZED (
  SELECT DISTINCT k.slug, d.etype, d.entry_pos, d.canonical FROM tokens k JOIN dictionary d ON k.token = lower(d.alias)
  UNION
  SELECT DISTINCT x.slug, d.etype, d.entry_pos, d.canonical
  FROM texts x JOIN dictionary d ON regexp_matches(d.alias, '[^\p{L}\p{N}_]') AND contains(x.t, lower(d.alias))
)"""
# Words are marked at both ends, so that a term between other words is found as a plain substring.
_MARKED = r"""regexp_replace({0}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g')"""
BOUNDED_SQL = rf"""
full_texts AS MATERIALIZED (SELECT slug, lower(title || chr(10) || chr(10) || trim(body)) AS t FROM posts),
full_tokens AS MATERIALIZED (SELECT slug, unnest(list_distinct(regexp_split_to_array(t, '[^\p{{L}}\p{{N}}_]+'))) AS token FROM full_texts),
marked_texts AS MATERIALIZED (SELECT slug, {_MARKED.format('t')} AS m FROM full_texts),
marked_terms AS MATERIALIZED (SELECT *, {_MARKED.format('lower(alias)')} AS m FROM dictionary WHERE regexp_matches(alias, '[^\p{{L}}\p{{N}}_]')),
bounded_tags AS MATERIALIZED (
  SELECT DISTINCT k.slug, d.etype, d.entry_pos, d.canonical FROM full_tokens k JOIN dictionary d ON k.token = lower(d.alias)
  UNION
  SELECT DISTINCT x.slug, d.etype, d.entry_pos, d.canonical
  FROM marked_texts x JOIN marked_terms d ON contains(x.m, d.m) AND contains(replace(x.m, d.m || chr(1), chr(3)), d.m)
)"""


def tagged_posts(spark: SparkSession, sf_dir: str, **how: object) -> DataFrame:
    return tagging.tag_entities(fx.posts(spark, sf_dir), fx.dictionary(spark), **how)


def _flat(tagged: DataFrame) -> DataFrame:
    return tagged.select("slug", *[F.array_join(f"entities_{t}", "|").alias(t) for t in tagging.ENTITY_TYPES])


def tag_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(tagged_posts(spark, sf_dir))


def tag_entities_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken for dictionaries too large for the plan."""
    return _flat(tagged_posts(spark, sf_dir, max_inline=0))


def _per_type(source: str, types: list[str], order: str, prefix: str = "") -> str:
    return ", ".join(
        f"coalesce(string_agg(canonical, '|' ORDER BY {order}) FILTER (WHERE etype = '{t}'), '') AS {prefix}{t}" for t in types
    )


TAG_SQL = f"""
WITH {fx.POSTS_SQL}, {fx.DICTIONARY_SQL}, {TAGS_SQL}
SELECT p.slug, {_per_type('g', tagging.ENTITY_TYPES, 'canonical')}
FROM posts p LEFT JOIN plain_tags g USING (slug) GROUP BY p.slug"""


def tag_entities_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("title", F.lit("\n\n"), F.trim("body"))
    tagged = tagged_posts(spark, sf_dir, bounded=True, text=text)
    return tagged.select(
        "slug",
        *[F.array_join(f"entities_{t}", "|").alias(t) for t in tagging.CLASSIFIER_TYPES],
        F.array_join(tagging.entities_flat(), "|").alias("flat"),
    )


def tag_entities_bounded_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.posts(spark, sf_dir).select("slug", F.concat("title", F.lit("\n\n"), F.trim("body")).alias("text"))
    return tagging.long_tags(posts, fx.dictionary(spark), key="slug", text="text", bounded=True)


_FLAT = " , ".join(f"string_agg(canonical, '|' ORDER BY entry_pos) FILTER (WHERE etype = '{t}')" for t in tagging.CLASSIFIER_TYPES)
BOUNDED_TAG_SQL = f"""
WITH {fx.POSTS_SQL}, {fx.DICTIONARY_SQL}, {BOUNDED_SQL}
SELECT p.slug, {_per_type('g', tagging.CLASSIFIER_TYPES, 'entry_pos')}, concat_ws('|', {_FLAT}) AS flat
FROM posts p LEFT JOIN bounded_tags g USING (slug) GROUP BY p.slug"""
BOUNDED_LONG_SQL = f"WITH {fx.POSTS_SQL}, {fx.DICTIONARY_SQL}, {BOUNDED_SQL} SELECT * FROM bounded_tags"


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagging.mention_counts(tagged_posts(spark, sf_dir))


MENTIONS_SQL = f"""
WITH {fx.POSTS_SQL}, {fx.DICTIONARY_SQL}, {TAGS_SQL}
SELECT lower(canonical) AS name, count(DISTINCT slug) AS n_docs FROM plain_tags
WHERE etype IN ('organizations', 'programs', 'locations', 'credentials', 'people') GROUP BY lower(canonical)"""


def entity_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities found per post, with the attributes kept for some of them."""
    people = tagged_posts(spark, sf_dir).select("slug", F.explode("entities_people").alias("canonical"))
    attributes = spark.createDataFrame([("Is Person", "Director")], "canonical string, title string")
    return tagging.entity_metadata(people, attributes)


METADATA_SQL = f"""
WITH {fx.POSTS_SQL}, {fx.DICTIONARY_SQL}, {TAGS_SQL}
SELECT slug, canonical, CASE WHEN canonical = 'Is Person' THEN 'Director' END AS title FROM plain_tags WHERE etype = 'people'"""


def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms per type of a dictionary made of the names of the star schema."""
    return tagging.dictionary_stats(star_dictionary(spark, sf_dir))


def star_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name")]
    frames = [
        fx.table(spark, sf_dir, t).select(
            F.lit(t).alias("etype"),
            F.col(k).cast("int").alias("entry_pos"),
            F.col(n).alias("canonical"),
            F.explode(F.array(n, F.lower(F.regexp_replace(n, "[#_]", " ")))).alias("alias"),
        )
        for t, k, n in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


DICTIONARY_STATS_SQL = """
SELECT 'nation' AS etype, 2 * count(*) AS n_terms FROM nation UNION ALL
SELECT 'customer', 2 * count(*) FROM customer UNION ALL SELECT 'part', 2 * count(*) FROM part"""


# --- classification -----------------------------------------------------------------

SCORES_SQL = r"""
weights(kind, w) AS (VALUES ('activity', 40), ('credential', 30), ('program', 25), ('organization', 15), ('location', 8)),
type_weights(etype, w) AS (VALUES ('programs', 25), ('credentials', 30), ('locations', 8), ('organizations', 15), ('people', 15)),
kinds(kind, etype) AS (VALUES ('activity', 'activities'), ('program', 'programs'), ('organization', 'organizations'),
  ('credential', 'credentials'), ('location', 'locations'), ('person', 'people')),
counts AS (SELECT slug, etype, count(*) AS n FROM bounded_tags GROUP BY slug, etype),
signal_points AS MATERIALIZED (
  SELECT c.slug, s.category, c.n * w.w AS points FROM cat_signals s JOIN type_weights w ON s.kind = 'entity_type' AND w.etype = s.value
  JOIN counts c ON c.etype = s.value
  UNION ALL
  SELECT g.slug, s.category, w.w FROM cat_signals s JOIN weights w USING (kind) JOIN kinds k USING (kind)
  JOIN bounded_tags g ON g.etype = k.etype AND g.canonical = s.value
),
pattern_hits AS MATERIALIZED (
  SELECT DISTINCT g.slug, p.category, p.pattern_id, p.element FROM cat_patterns p
  JOIN kinds k ON k.kind = p.element JOIN bounded_tags g ON g.etype = k.etype
  UNION
  SELECT DISTINCT g.slug, p.category, p.pattern_id, p.element FROM cat_patterns p JOIN bounded_tags g ON g.canonical = p.element
),
pattern_sizes AS (SELECT category, pattern_id, count(*) AS n FROM cat_patterns GROUP BY category, pattern_id),
pattern_points AS (
  SELECT h.slug, h.category, 35 AS points FROM pattern_hits h JOIN pattern_sizes s USING (category, pattern_id)
  GROUP BY h.slug, h.category, h.pattern_id, s.n HAVING count(*) = s.n
),
raw_scores AS MATERIALIZED (
  SELECT p.slug, o.category, o.pos, coalesce(sum(points), 0) AS score
  FROM posts p CROSS JOIN category_order o
  LEFT JOIN (SELECT * FROM signal_points UNION ALL SELECT * FROM pattern_points) x ON x.slug = p.slug AND x.category = o.category
  GROUP BY p.slug, o.category, o.pos
),
facts AS MATERIALIZED (
  SELECT p.slug,
    count(*) FILTER (WHERE etype = 'organizations') AS orgs, count(*) FILTER (WHERE etype = 'credentials') AS creds,
    coalesce(bool_or(canonical = 'Graduation'), false) AS graduation, coalesce(bool_or(canonical = 'Media Coverage'), false) AS media,
    coalesce(bool_or(canonical = 'Agreement'), false) AS agreement, coalesce(bool_or(canonical = 'Certification'), false) AS certification,
    count(DISTINCT etype) AS n_types
  FROM posts p LEFT JOIN bounded_tags USING (slug) GROUP BY p.slug
),
bump1 AS (
  SELECT s.slug, category, pos, CASE WHEN category = 'Events & Ceremonies' AND graduation AND NOT media
    THEN greatest(score, greatest(max(score) OVER (PARTITION BY s.slug), 45) + 1) ELSE score END AS score
  FROM raw_scores s JOIN facts USING (slug)
),
bump2 AS (
  SELECT s.slug, category, pos, CASE WHEN category = 'Partnerships & Agreements' AND orgs >= 2 AND agreement
    THEN greatest(score, greatest(max(score) OVER (PARTITION BY s.slug), 45) + 1) ELSE score END AS score
  FROM bump1 s JOIN facts USING (slug)
),
scores AS MATERIALIZED (
  SELECT s.slug, category, pos, CASE WHEN category = 'Accreditation & Compliance' AND creds > 0 AND certification
    THEN greatest(score, greatest(max(score) OVER (PARTITION BY s.slug), 45) + 1) ELSE score END AS score
  FROM bump2 s JOIN facts USING (slug)
),
keyword_points AS MATERIALIZED (
  SELECT slug, category, 5 * count(*) AS points FROM (
    SELECT DISTINCT x.slug, k.category, k.keyword
    FROM marked_texts x JOIN (SELECT *, regexp_replace(lower(keyword), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g') AS m FROM keyword_rules) k ON contains(x.m, k.m)
  ) GROUP BY slug, category
)"""
PICK_SQL = """
best AS (SELECT slug, arg_min(category, (-score, pos)) AS category FROM scores WHERE score > 0 GROUP BY slug),
best_keyword AS (SELECT slug, arg_min(category, pos) AS category FROM keyword_points JOIN category_order USING (category) GROUP BY slug),
picked AS (
  SELECT p.slug, coalesce(b.category, k.category, 'General') AS category, b.category IS NULL AND k.category IS NOT NULL AS used_fallback
  FROM posts p LEFT JOIN best b USING (slug) LEFT JOIN best_keyword k USING (slug)
),
scored AS (
  SELECT p.slug, p.category, p.used_fallback, coalesce(s.score, 0)::INT AS entity_score, coalesce(k.points, 0)::INT AS keyword_score
  FROM picked p LEFT JOIN scores s ON s.slug = p.slug AND s.category = p.category
  LEFT JOIN keyword_points k ON k.slug = p.slug AND k.category = p.category
),
chosen AS MATERIALIZED (
  SELECT *, CASE WHEN entity_score >= 45 THEN CASE WHEN keyword_score > 0 THEN 'hybrid' ELSE 'entity_match' END
                 WHEN used_fallback THEN 'keyword_fallback' WHEN entity_score > 0 THEN 'entity_match' ELSE 'default' END AS source
  FROM scored
),
conditions AS (SELECT DISTINCT rule_pos, category, subcategory, cond_kind FROM subcat_rules),
conditions_met AS (
  SELECT DISTINCT c.slug, r.rule_pos, r.cond_kind FROM chosen c JOIN subcat_rules r USING (category)
  JOIN kinds k ON k.kind = r.cond_kind JOIN bounded_tags g ON g.slug = c.slug AND g.etype = k.etype AND g.canonical = r.value
),
rules_met AS (
  SELECT m.slug, m.rule_pos FROM conditions_met m GROUP BY m.slug, m.rule_pos
  HAVING count(*) = (SELECT count(*) FROM conditions x WHERE x.rule_pos = m.rule_pos)
),
subcats AS (
  SELECT m.slug, arg_min(c.subcategory, m.rule_pos) AS subcategory FROM rules_met m JOIN conditions c USING (rule_pos) GROUP BY m.slug
),
graded AS (
  SELECT c.*, coalesce(s.subcategory, 'General') AS subcategory, s.subcategory IS NOT NULL AS matched,
    least(100, entity_score + CASE WHEN used_fallback THEN keyword_score ELSE 0 END)::INT AS category_score, n_types
  FROM chosen c LEFT JOIN subcats s USING (slug) JOIN facts USING (slug)
),
capped AS (
  SELECT slug, etype, canonical AS tag, row_number() OVER (PARTITION BY slug, etype ORDER BY entry_pos) AS rn, entry_pos,
    list_position(['organizations', 'programs', 'credentials', 'locations', 'activities', 'people'], etype) AS part
  FROM bounded_tags
),
all_tags AS (
  SELECT c.slug, c.part, c.entry_pos AS k, c.tag FROM capped c JOIN tag_caps USING (etype) WHERE rn <= max_per_doc AND tag <> 'Una Person'
  UNION ALL
  SELECT c.slug, 7, t.thematic_pos, t.tag FROM chosen c JOIN thematic_rules t ON t.tag <> 'Hidden' JOIN full_texts x ON x.slug = c.slug
  WHERE CASE t.cond_kind WHEN 'category' THEN t.value = c.category WHEN 'text' THEN contains(x.t, t.value)
    ELSE EXISTS (SELECT 1 FROM bounded_tags g JOIN kinds k USING (etype) WHERE g.slug = c.slug AND k.kind = t.cond_kind AND g.canonical = t.value) END
),
tags AS (
  SELECT slug, string_agg(tag, '|' ORDER BY part, k) AS tags FROM (
    SELECT *, row_number() OVER (PARTITION BY slug ORDER BY part, k) AS rn FROM all_tags) WHERE rn <= 9 GROUP BY slug
),
classified AS (
  SELECT g.slug, g.category, g.subcategory, g.source, g.category_score,
    CASE WHEN matched THEN least(100, floor(g.category_score * 0.85::DOUBLE + 0.5)) ELSE least(40, g.category_score) END::INT AS subcategory_score,
    floor(n_types / 6::DOUBLE * 100 + 0.5)::INT AS entity_extraction_score, coalesce(t.tags, '') AS tags
  FROM graded g LEFT JOIN tags t USING (slug)
)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify_corpus(fx.posts(spark, sf_dir), fx.dictionary(spark), fx.classification_rules(spark))


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("title", F.lit("\n\n"), F.trim("body"))
    return tagging.tag_entities(fx.posts(spark, sf_dir), fx.dictionary(spark), bounded=True, text=text, prefix="e_")


def _long_scores(scored: DataFrame) -> DataFrame:
    rows = scored.select("slug", F.explode_outer("scores").alias("s")).where("s IS NOT NULL")
    return rows.select("slug", "s.category", F.col("s.score").cast("long").alias("score"))


def score_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = fx.classification_rules(spark)
    scored = classify.score_categories(_bounded(spark, sf_dir), rules)
    return _long_scores(scored)


def apply_tie_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = fx.classification_rules(spark)
    scored = classify.apply_tie_breakers(classify.score_categories(_bounded(spark, sf_dir), rules), rules)
    return _long_scores(scored)


def score_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("title", F.lit("\n\n"), F.trim("body"))
    scored = classify.score_keywords(fx.posts(spark, sf_dir), fx.classification_rules(spark), text=text)
    return (
        scored.select("slug", F.explode_outer("keyword_hits").alias("category"))
        .where("category IS NOT NULL")
        .groupBy("slug", "category")
        .agg((F.count("*") * 5).alias("points"))
    )


def classify_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select(
        "slug", "category", "subcategory", "source", "category_score", "subcategory_score", "entity_extraction_score",
        F.array_join("class_tags", "|").alias("tags"),
    )


def classification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classification_counts(classified(spark, sf_dir))


_BASE = f"WITH {fx.POSTS_SQL}, {fx.DICTIONARY_SQL}, {fx.RULES_SQL}, {BOUNDED_SQL}, {SCORES_SQL}"
CLASSIFIED_CTES = f"{_BASE}, {PICK_SQL}"

QUERIES = {
    "tag_entities": (tag_entities, TAG_SQL),
    "tag_entities_joined": (tag_entities_joined, TAG_SQL),
    "tag_entities_bounded": (tag_entities_bounded, BOUNDED_TAG_SQL),
    "tag_entities_bounded_joined": (tag_entities_bounded_joined, BOUNDED_LONG_SQL),
    "mention_counts": (mention_counts, MENTIONS_SQL),
    "entity_metadata": (entity_metadata, METADATA_SQL),
    "dictionary_stats": (dictionary_stats, DICTIONARY_STATS_SQL),
    "score_categories": (score_categories, f"{_BASE} SELECT slug, category, score::BIGINT AS score FROM raw_scores"),
    "apply_tie_breakers": (apply_tie_breakers, f"{_BASE} SELECT slug, category, score::BIGINT AS score FROM scores"),
    "score_keywords": (score_keywords, f"{_BASE} SELECT slug, category, points FROM keyword_points"),
    "classify_corpus": (classify_corpus, f"{CLASSIFIED_CTES} SELECT * FROM classified"),
    "classification_counts": (
        classification_counts,
        f"{CLASSIFIED_CTES} SELECT 'category' AS kind, category AS name, count(*) AS n FROM classified GROUP BY category"
        " UNION ALL SELECT 'source', source, count(*) FROM classified GROUP BY source",
    ),
}
