"""Index, search, routing, context and evaluation queries."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import context, evaluate, index as ix, routing, search
from scriptorium.operators.tagging import ENTITY_TYPES, entities_for_hits
from scriptorium.session import written
from workloads import chunks as ck, fixtures as fx, labels

# --- the index ------------------------------------------------------------------


@cache
def _stored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(ix.ingest_posts(fx.posts(spark, sf_dir), fx.dictionary(spark))[0].drop("ingested_at"))


@cache
def _stored_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(ix.ingest_knowledge(fx.knowledge_docs(spark, sf_dir), fx.dictionary(spark))[0].drop("ingested_at"))


def news_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_news(spark, sf_dir)


def knowledge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_knowledge(spark, sf_dir)


def _sections_sql(prefix: str, posts: str) -> str:
    """The chunk CTEs over another table of documents, with prefixed names."""
    text = f"{ck._SECTIONS}, {ck.chunks_sql(posts='posts', limit=585, overlap=65)}"
    for name in (
        "body_lines", "marked", "numbered", "first_secs", "heads", "sections", "paths", "paras", "sums", "overlap_at",
        "steps", "walk", "pieces", "body_chunks", "intros", "all_chunks", "chunks",
    ):
        text = _rename(text, name, prefix + name)
    return _rename(text, "posts", posts)


def _rename(text: str, old: str, new: str) -> str:
    import re

    return re.sub(rf"\b{old}\b", new, text)


VALID_KNOWLEDGE_SQL = f"""{fx.KNOWLEDGE_SQL},
k_posts AS MATERIALIZED (
  SELECT *, '' AS summary FROM knowledge_docs WHERE title <> '' AND language <> '' AND priority <> '' AND memory_layer = 'knowledge'
), {_sections_sql('k_', 'k_posts')}"""


def vectors_sql(chunks: str, prefix: str = "") -> str:
    """CTEs ``{prefix}postings`` and ``{prefix}dense`` in long form."""
    return rf"""
{prefix}terms AS MATERIALIZED (
  SELECT chunk_id, term, count(*) AS tf FROM (
    SELECT chunk_id, unnest(regexp_split_to_array(lower(chunk_text), '[^\p{{L}}\p{{N}}_]+')) AS term FROM {chunks}
  ) WHERE term <> '' GROUP BY chunk_id, term
),
{prefix}lengths AS MATERIALIZED (SELECT chunk_id, sum(tf)::DOUBLE AS n FROM {prefix}terms GROUP BY chunk_id),
{prefix}postings AS MATERIALIZED (
  SELECT chunk_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 256::DOUBLE)) AS w
  FROM {prefix}terms JOIN {prefix}lengths USING (chunk_id)
),
{prefix}buckets AS MATERIALIZED (
  SELECT chunk_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, sum(tf)::DOUBLE AS v FROM {prefix}terms GROUP BY 1, 2
),
{prefix}dense AS MATERIALIZED (
  SELECT b.chunk_id, b.bucket, (b.v / x.norm)::FLOAT::DOUBLE AS v
  FROM {prefix}buckets b JOIN (SELECT chunk_id, sqrt(sum(v * v)) AS norm FROM {prefix}buckets GROUP BY chunk_id) x USING (chunk_id)
)"""


QUERY_VECTORS_SQL = vectors_sql("(SELECT query_id AS chunk_id, query AS chunk_text FROM queries)", "q_")


def hybrid_sql(name: str, *, wanted: str, members: str, limit: int, candidates: int, threshold: float, prefix: str = "") -> str:
    """CTE ``name(query_id, chunk_id, score, rank)``.

    ``wanted`` selects query ids, ``members`` selects the chunk ids searched.
    """
    return f"""
{name}_members AS MATERIALIZED ({members}),
{name}_wanted AS MATERIALIZED ({wanted}),
{name}_norms AS MATERIALIZED (SELECT chunk_id, sqrt(sum(v * v)) AS norm FROM {prefix}dense GROUP BY chunk_id),
{name}_qnorms AS MATERIALIZED (SELECT chunk_id, sqrt(sum(v * v)) AS norm FROM q_dense GROUP BY chunk_id),
{name}_dense_scores AS (
  SELECT q.chunk_id AS query_id, c.chunk_id, round(coalesce(sum(a.v * b.v), 0) / (any_value(q.norm) * any_value(c.norm)), 6) AS score
  FROM {name}_qnorms q JOIN {name}_wanted t ON t.query_id = q.chunk_id
  CROSS JOIN (SELECT * FROM {name}_norms SEMI JOIN {name}_members USING (chunk_id)) c
  JOIN q_dense a ON a.chunk_id = q.chunk_id LEFT JOIN {prefix}dense b ON b.chunk_id = c.chunk_id AND b.bucket = a.bucket
  GROUP BY q.chunk_id, c.chunk_id
),
{name}_dense_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {name}_dense_scores) WHERE rank <= {candidates}
),
{name}_sparse_top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.chunk_id AS query_id, p.chunk_id, round(sum(p.w), 6) AS score
      FROM q_terms q JOIN {name}_wanted t ON t.query_id = q.chunk_id JOIN {prefix}postings p USING (term)
      SEMI JOIN {name}_members m ON m.chunk_id = p.chunk_id
      GROUP BY q.chunk_id, p.chunk_id)
  ) WHERE rank <= {candidates}
),
{name} AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
      SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (1 + rank)), 6) AS score
      FROM (SELECT query_id, chunk_id, rank FROM {name}_dense_top UNION ALL SELECT query_id, chunk_id, rank FROM {name}_sparse_top)
      GROUP BY query_id, chunk_id
    ) WHERE score >= {threshold}
  ) WHERE rank <= {limit}
)"""


INDEX_SQL = f"{ck.CHUNKS_CTES}, {vectors_sql('chunks')}, {fx.QUERIES_SQL}, {QUERY_VECTORS_SQL}"
_ALL = "SELECT chunk_id FROM chunks"
_LIVE = "SELECT chunk_id FROM chunks JOIN posts USING (slug) WHERE posts.status = 'approved' AND posts.language = 'en'"
_EVERY_QUERY = "SELECT query_id FROM queries"
HITS_SQL = hybrid_sql("hits", wanted=_EVERY_QUERY, members=_ALL, limit=8, candidates=24, threshold=0)


def embedded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.embed_queries(fx.queries(spark, sf_dir))


def news_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news_index(spark, sf_dir)
    return rows.select(
        "chunk_id", "id", "title", "url", "chunk_index", "chunk_type", "heading_path", "word_count", "summary", "date", "year", "quarter",
        "month", "partner", "location", "featured_image", F.array_join("image_names", "|").alias("image_names"), "language", "status",
        "source_document", F.array_join("entities_organizations", "|").alias("organizations"), F.array_join("entities_people", "|").alias("people"),
    )


UUID_SQL = ck.STABLE_ID_SQL.split("SELECT doc_id,")[1].split(" AS point_id")[0]
NEWS_PAYLOAD_SQL = f"""
WITH RECURSIVE {ck.CHUNKS_CTES}, {fx.DICTIONARY_SQL}, {labels.TAGS_SQL},
names AS (SELECT p.slug, {labels._per_type('g', ['organizations', 'people'], 'canonical')}
  FROM posts p LEFT JOIN plain_tags g USING (slug) GROUP BY p.slug)
SELECT chunk_id, {UUID_SQL} AS id, nullif(title, '') AS title, 'posts/' || slug AS url, chunk_index, chunk_type,
  nullif(heading_path, '') AS heading_path, word_count, nullif(summary, '') AS summary, strftime(date, '%Y-%m-%dT00:00:00+00:00') AS date,
  year::INT AS year, quarter, month(date)::INT AS month, nullif(partner, '') AS partner, nullif(location, '') AS location,
  nullif(featured_image, '') AS featured_image,
  concat_ws('|', nullif(featured_image, ''), nullif(array_to_string(gallery_images, '|'), '')) AS image_names, language, status, source_document,
  organizations, people
FROM (SELECT c.*, p.* EXCLUDE (slug), n.organizations, n.people,
        sha1('\\x6b\\xa7\\xb8\\x10\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::BLOB || encode(c.chunk_id)) AS h
      FROM chunks c JOIN posts p USING (slug) JOIN names n USING (slug))"""


def knowledge_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knowledge_index(spark, sf_dir)
    return rows.select("chunk_id", "title", "knowledge_type", "section", "chunk_type", "priority", "language", "status", "word_count", "source_file")


KNOWLEDGE_PAYLOAD_SQL = f"""
WITH RECURSIVE {VALID_KNOWLEDGE_SQL}
SELECT c.chunk_id, d.title, d.knowledge_type, nullif(c.heading_path, '') AS section,
  CASE WHEN c.chunk_type = 'summary' THEN 'overview'
       WHEN regexp_matches(lower(c.heading_path), 'faq|frequently asked|questions & answers|q&a') THEN 'faq'
       WHEN regexp_matches(lower(c.heading_path), 'definition|glossary|terminology|key terms|terms') THEN 'definition'
       ELSE 'section' END AS chunk_type, d.priority, d.language, d.status, c.word_count, d.source_file
FROM k_chunks c JOIN k_posts d USING (slug)"""


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    rows, failed = ix.ingest_posts(posts, fx.dictionary(spark), fail_on_missing_date=True)
    return ix.ingest_counters(posts, rows, failed)


INGEST_COUNTERS_SQL = f"""
WITH RECURSIVE {ck.CHUNKS_CTES}
SELECT (SELECT count(*) FROM posts) AS loaded, (SELECT count(*) FROM posts WHERE date IS NOT NULL) AS valid,
       (SELECT count(*) FROM posts WHERE date IS NULL) AS failed,
       (SELECT count(*) FROM chunks JOIN posts USING (slug) WHERE date IS NOT NULL) AS chunks_produced,
       (SELECT count(DISTINCT chunk_id) FROM chunks JOIN posts USING (slug) WHERE date IS NOT NULL) AS points_upserted"""


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = ix.sparse_long(news_index(spark, sf_dir))
    return long.select("chunk_id", "term", F.round("w", 6).alias("w"))


def sparse_vectors_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = ix.sparse_long(news_index(spark, sf_dir), idf=True)
    return long.groupBy("chunk_id").agg(F.round(F.sum("w"), 6).alias("total"), F.count("*").alias("n_terms"))


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = news_index(spark, sf_dir).select("chunk_id", F.posexplode("dense").alias("bucket", "v"))
    return rows.where("v <> 0").select("chunk_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("v").cast("double"), 5).alias("v"))


def _centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = fx.table(spark, sf_dir, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centroids = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("dense"))
    index = vectors.select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("embedding").alias("dense"))
    return centroids.select(F.col("label").cast("bigint").alias("query_id"), "dense"), index


def _dense(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        centroids, index = _centroids(spark, sf_dir)
        return search.dense_topk(centroids, index, 10, metric)

    return query


def dense_sql(metric: str) -> str:
    score = {
        "dot": "dot", "cosine": "dot / (qn * cn)", "euclid": "0 - round(sqrt(qn * qn + cn * cn - 2 * dot), 6)",
    }[metric]
    return f"""
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS MATERIALIZED (SELECT label, pos, avg(v) AS v FROM e GROUP BY label, pos),
qn AS (SELECT label, sqrt(sum(v * v)) AS qn FROM c GROUP BY label),
cn AS (SELECT vec_id, sqrt(sum(v * v)) AS cn FROM e GROUP BY vec_id),
dots AS (SELECT c.label, e.vec_id, sum(c.v * e.v) AS dot FROM c JOIN e USING (pos) GROUP BY c.label, e.vec_id),
scored AS (SELECT label::BIGINT AS query_id, 'vec-' || vec_id AS chunk_id, round({score}, 6) AS score FROM dots JOIN qn USING (label) JOIN cn USING (vec_id))
SELECT query_id, chunk_id, score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10"""


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sparse_topk(fx.queries(spark, sf_dir), news_index(spark, sf_dir), 24)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(embedded_queries(spark, sf_dir), news_index(spark, sf_dir))


def hits_with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = news_index(spark, sf_dir)
    return search.with_payload(_stored_hits(spark, sf_dir), index, *[c for c in index.columns if c not in ("dense", "sparse")])


@cache
def _stored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(hybrid_search(spark, sf_dir))


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.retrieve(embedded_queries(spark, sf_dir), news_index(spark, sf_dir))


RETRIEVE_SQL = f"""WITH RECURSIVE {INDEX_SQL}, {hybrid_sql('live', wanted=_EVERY_QUERY, members=_LIVE, limit=8, candidates=24, threshold=0.15)}
SELECT * FROM live"""


def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = news_index(spark, sf_dir)
    from scriptorium.operators.validate import payload_filter as where

    return index.where(where(language="en", year=2023, quarter="Q2", chunk_type="body", category="", published=True)).select("chunk_id", "slug")


PAYLOAD_FILTER_SQL = f"""WITH RECURSIVE {ck.CHUNKS_CTES}
SELECT chunk_id, slug FROM chunks JOIN posts USING (slug) WHERE language = 'en' AND year = 2023 AND quarter = 'Q2' AND chunk_type = 'body'"""


# --- routing --------------------------------------------------------------------------

def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route_queries(fx.asked(spark, sf_dir), fx.route_signals(spark))
    return routed.select("query_id", "draft", "news", "knowledge", "route", "reasoning")


def route_queries_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route_queries(fx.asked(spark, sf_dir), fx.route_signals(spark), max_inline=0)
    return routed.select("query_id", "draft", "news", "knowledge", "route", "reasoning")


def routed_sql(asked: str) -> str:
    return f"""
counted AS (
  SELECT q.query_id, q.intent,
    count(*) FILTER (WHERE kind = 'draft')::INT AS draft, count(*) FILTER (WHERE kind = 'news')::INT AS news,
    count(*) FILTER (WHERE kind = 'knowledge')::INT AS knowledge
  FROM {asked} q LEFT JOIN route_signals s ON contains(lower(q.query), s.phrase) GROUP BY q.query_id, q.intent
),
routed AS (
  SELECT query_id, draft, news, knowledge,
    CASE WHEN intent IS NOT NULL THEN intent WHEN draft > 0 THEN 'both' WHEN news > 0 AND knowledge > 0 THEN 'both'
         WHEN knowledge > news THEN 'knowledge' WHEN news > 0 THEN 'news' ELSE 'both' END AS route,
    CASE WHEN intent IS NOT NULL THEN 'Explicit intent override: ' || intent
         WHEN draft > 0 THEN format('Drafting/authoring task detected (draft={{}}, news={{}}, knowledge={{}})', draft, news, knowledge)
         WHEN news > 0 AND knowledge > 0 THEN format('Mixed signals — querying both collections (news={{}}, knowledge={{}})', news, knowledge)
         WHEN knowledge > news THEN format('Institutional knowledge query (knowledge={{}}, news={{}})', knowledge, news)
         WHEN news > 0 THEN format('News/event query (news={{}}, knowledge={{}})', news, knowledge)
         ELSE 'No strong signal — defaulting to both collections' END AS reasoning
  FROM counted
)"""


ROUTE_SQL = f"WITH {fx.ASKED_SQL}, {fx.ROUTE_SIGNALS_SQL}, {routed_sql('asked')} SELECT * FROM routed"


def routed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = embedded_queries(spark, sf_dir).withColumn("intent", F.lit(None).cast("string"))
    return routing.route_queries(queries, fx.route_signals(spark))


@cache
def _stored_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = written(routed_queries(spark, sf_dir))
    return written(routing.lane_retrieve(routed, news_index(spark, sf_dir), knowledge_index(spark, sf_dir)))


def lane_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_lanes(spark, sf_dir)


_EFFECTIVE = "SELECT query_id FROM effective WHERE route IN ({})"
LANES_CTES = f"""{INDEX_SQL}, {VALID_KNOWLEDGE_SQL}, {vectors_sql('k_chunks', 'k_')}, {fx.ROUTE_SIGNALS_SQL},
asked AS (SELECT *, NULL::VARCHAR AS intent FROM queries), {routed_sql('asked')},
effective AS (SELECT query_id, CASE WHEN route = 'news' THEN 'both' ELSE route END AS route FROM routed),
{hybrid_sql('news_lane', wanted=_EFFECTIVE.format("'news', 'both'"), members=_LIVE, limit=8, candidates=24, threshold=0)},
{hybrid_sql('knowledge_lane', wanted=_EFFECTIVE.format("'knowledge', 'both'"), members='SELECT chunk_id FROM k_chunks', limit=4, candidates=12, threshold=0, prefix='k_')},
{hybrid_sql('editorial_lane', wanted=_EFFECTIVE.format("'both'"),
            members="SELECT chunk_id FROM k_chunks JOIN k_posts USING (slug) WHERE knowledge_type = 'editorial_guidelines'", limit=2, candidates=8, threshold=0, prefix='k_')},
lanes AS (
  SELECT query_id, 'news' AS lane, chunk_id, score, rank FROM news_lane UNION ALL
  SELECT query_id, 'knowledge', chunk_id, score, rank FROM knowledge_lane UNION ALL
  SELECT query_id, 'editorial', chunk_id, score, rank FROM editorial_lane
)"""


# --- context -----------------------------------------------------------------------------

def format_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = context.format_hits(hits_with_payload(spark, sf_dir), text_limit=300)
    return hits.select("query_id", "rank", "score", "chunk_type", "title", "slug", "text", "date", "category", "language")


FORMAT_SQL = f"""WITH RECURSIVE {INDEX_SQL}, {HITS_SQL}
SELECT query_id, rank, round(score, 4) AS score, chunk_type, title, slug, substr(chunk_text, 1, 300) AS text,
  strftime(date, '%Y-%m-%d') AS date, '' AS category, language
FROM hits JOIN chunks USING (chunk_id) JOIN posts USING (slug)"""


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.facets(news_index(spark, sf_dir))


FACETS_SQL = f"""WITH RECURSIVE {ck.CHUNKS_CTES}, j AS (SELECT * FROM chunks JOIN posts USING (slug))
SELECT 'chunk_type' AS facet, chunk_type AS value, count(*) AS n FROM j GROUP BY 2 UNION ALL
SELECT 'quarter', quarter, count(*) FROM j WHERE quarter IS NOT NULL GROUP BY 2 UNION ALL
SELECT 'year', year::VARCHAR, count(*) FROM j WHERE year IS NOT NULL GROUP BY 2 UNION ALL
SELECT 'language', language, count(*) FROM j GROUP BY 2"""


def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.unique_slugs(hits_with_payload(spark, sf_dir)).select("query_id", F.array_join("slugs", "|").alias("slugs"))


UNIQUE_SLUGS_SQL = f"""WITH RECURSIVE {INDEX_SQL}, {HITS_SQL}
SELECT query_id, string_agg(slug, '|' ORDER BY rank, slug) AS slugs FROM (
  SELECT query_id, slug, min(rank) AS rank FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id, slug) GROUP BY query_id"""


def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.citation_list(hits_with_payload(spark, sf_dir))


CITATIONS_SQL = f"""WITH RECURSIVE {INDEX_SQL}, {HITS_SQL}
SELECT query_id, string_agg('[' || rank || '] ' || title || ' (' || slug || ')' || coalesce(' — ' || strftime(date, '%Y-%m-%d'), '')
  || '  score=' || printf('%.4f', round(score, 4)), chr(10) ORDER BY rank) AS citations
FROM hits JOIN chunks USING (chunk_id) JOIN posts USING (slug) GROUP BY query_id"""


def hit_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities_for_hits(hits_with_payload(spark, sf_dir))


HIT_ENTITIES_SQL = f"""WITH RECURSIVE {INDEX_SQL}, {HITS_SQL}, {fx.DICTIONARY_SQL}, {labels.TAGS_SQL}
SELECT DISTINCT query_id, etype, canonical AS name FROM hits JOIN chunks USING (chunk_id) JOIN plain_tags USING (slug)
WHERE etype IN ({', '.join(repr(t) for t in ENTITY_TYPES)})"""


def lane_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane hits with what their blocks show."""
    lanes = _stored_lanes(spark, sf_dir)
    news = news_index(spark, sf_dir).select(
        "chunk_id", "chunk_text", "title", "date", "category", "tags", F.lit(None).cast("string").alias("knowledge_type"), F.lit(None).cast("string").alias("section")
    )
    knowledge = knowledge_index(spark, sf_dir).select(
        "chunk_id", "chunk_text", "title", F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("category"),
        F.array().cast("array<string>").alias("tags"), "knowledge_type", "section",
    )
    return lanes.join(news.unionByName(knowledge), "chunk_id")


def lane_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.lane_blocks(lane_rows(spark, sf_dir))


LANE_BLOCKS_SQL = f"""WITH RECURSIVE {LANES_CTES},
shown AS (
  SELECT l.*, c.chunk_text, p.title, strftime(p.date, '%Y-%m-%d') AS date, NULL::VARCHAR AS knowledge_type, NULL::VARCHAR AS section_path
  FROM lanes l JOIN chunks c USING (chunk_id) JOIN posts p USING (slug)
  UNION ALL
  SELECT l.*, c.chunk_text, p.title, NULL, p.knowledge_type, nullif(c.heading_path, '')
  FROM lanes l JOIN k_chunks c USING (chunk_id) JOIN k_posts p USING (slug)
)
SELECT query_id, lane, string_agg(
  CASE lane
    WHEN 'news' THEN '--- Chunk ' || rank || ' (score=' || printf('%.4f', score) || ') ---' || coalesce(chr(10) || 'Title   : ' || title, '')
      || coalesce(chr(10) || 'Date    : ' || date, '') || chr(10) || 'Text    :' || chr(10) || trim(chunk_text) || chr(10)
    WHEN 'knowledge' THEN '--- Knowledge ' || rank || ' (score=' || printf('%.4f', score) || ') ---' || coalesce(chr(10) || 'Title         : ' || title, '')
      || coalesce(chr(10) || 'Knowledge type: ' || knowledge_type, '') || coalesce(chr(10) || 'Section       : ' || section_path, '')
      || chr(10) || 'Text          :' || chr(10) || trim(chunk_text) || chr(10)
    ELSE '--- Editorial ' || rank || ' (score=' || printf('%.4f', score) || ') ---' || coalesce(chr(10) || 'Title   : ' || title, '')
      || coalesce(chr(10) || 'Section : ' || section_path, '') || chr(10) || 'Text    :' || chr(10) || trim(chunk_text) || chr(10)
  END, chr(10) ORDER BY rank) AS block
FROM shown GROUP BY query_id, lane"""


# --- evaluation --------------------------------------------------------------------------------

def slug_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query expects the slugs of its own number; every third wants more hits than there are."""
    q = fx.queries(spark, sf_dir)
    return q.select(
        "query_id",
        F.concat(F.lit("DOC-.*"), (F.col("query_id") % 10).cast("string"), F.lit("$")).alias("expected_slug_contains"),
        F.when(F.col("query_id") % 3 == 0, 9).otherwise(1).alias("min_results"),
    )


def eval_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.eval_slugs(hits_with_payload(spark, sf_dir), slug_cases(spark, sf_dir))


EVAL_SLUGS_SQL = f"""WITH RECURSIVE {INDEX_SQL}, {HITS_SQL}, j AS (
  SELECT query_id, count(*) AS n_results, bool_or(regexp_matches(slug, 'doc-.*' || (query_id % 10) || '$')) AS matched
  FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id)
SELECT q.query_id, coalesce(n_results, 0) AS n_results, coalesce(matched, false) AS matched,
  coalesce(n_results, 0) >= CASE WHEN q.query_id % 3 = 0 THEN 9 ELSE 1 END AND coalesce(matched, false) AS passed
FROM queries q LEFT JOIN j USING (query_id)"""


def eval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query is looked for, word for word, in the texts it brings up."""
    cases = fx.queries(spark, sf_dir).select("query_id", F.col("query").alias("expected_text_contains"), F.lit(1).alias("min_results"))
    return evaluate.eval_text(hits_with_payload(spark, sf_dir), cases)


EVAL_TEXT_SQL = f"""WITH RECURSIVE {INDEX_SQL}, {HITS_SQL}, j AS (
  SELECT query_id, count(*) AS n_results,
    contains(string_agg(lower(chunk_text || ' ' || title), ' ' ORDER BY rank), lower(any_value(query))) AS matched
  FROM hits JOIN chunks USING (chunk_id) JOIN posts USING (slug) JOIN queries USING (query_id) WHERE rank <= 5 GROUP BY query_id)
SELECT q.query_id, coalesce(n_results, 0) AS n_results, coalesce(matched, false) AS matched,
  coalesce(n_results, 0) >= 1 AND coalesce(matched, false) AS passed FROM queries q LEFT JOIN j USING (query_id)"""


def eval_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.asked(spark, sf_dir)
    cases = asked.select("query_id", F.when(F.length("query") % 2 == 0, "both").otherwise("news").alias("expected_route"))
    return evaluate.pass_rate(evaluate.eval_routes(routing.route_queries(asked, fx.route_signals(spark)), cases))


EVAL_ROUTES_SQL = f"""WITH {fx.ASKED_SQL}, {fx.ROUTE_SIGNALS_SQL}, {routed_sql('asked')}
SELECT count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM (
  SELECT route = CASE WHEN len(query) % 2 = 0 THEN 'both' ELSE 'news' END AS ok FROM asked JOIN routed USING (query_id))"""


def eval_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = _stored_lanes(spark, sf_dir)
    cases = fx.queries(spark, sf_dir).select(
        "query_id", (F.col("query_id") % 10).alias("expect_news_min"), (F.col("query_id") % 6).alias("expect_know_min")
    )
    return evaluate.eval_dual(lanes.where("lane = 'knowledge'"), lanes.where("lane = 'editorial'"), cases)


EVAL_DUAL_SQL = f"""WITH RECURSIVE {LANES_CTES},
a AS (SELECT query_id, count(*) AS n_news FROM lanes WHERE lane = 'knowledge' GROUP BY query_id),
b AS (SELECT query_id, count(*) AS n_knowledge FROM lanes WHERE lane = 'editorial' GROUP BY query_id),
c AS (SELECT query_id, count(*) AS n_shared FROM lanes x JOIN lanes y USING (query_id, chunk_id)
      WHERE x.lane = 'knowledge' AND y.lane = 'editorial' GROUP BY query_id)
SELECT query_id, coalesce(n_news, 0) AS n_news, coalesce(n_knowledge, 0) AS n_knowledge, coalesce(n_shared, 0) AS n_shared,
  coalesce(n_news, 0) >= query_id % 10 AND coalesce(n_knowledge, 0) >= query_id % 6 AS passed
FROM queries LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN c USING (query_id)"""


_CHUNK_VECTORS = f"WITH RECURSIVE {ck.CHUNKS_CTES}, {vectors_sql('chunks')}"
QUERIES = {
    "news_payload": (news_payload, NEWS_PAYLOAD_SQL),
    "knowledge_payload": (knowledge_payload, KNOWLEDGE_PAYLOAD_SQL),
    "ingest_counters": (ingest_counters, INGEST_COUNTERS_SQL),
    "sparse_vectors": (sparse_vectors, f"{_CHUNK_VECTORS} SELECT chunk_id, term, round(w, 6) AS w FROM postings"),
    "sparse_vectors_idf": (
        sparse_vectors_idf,
        f"""{_CHUNK_VECTORS}, f AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
        SELECT chunk_id, round(sum(w * ln(1 + ((SELECT count(*) FROM chunks) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 6) AS total, count(*) AS n_terms
        FROM postings JOIN f USING (term) GROUP BY chunk_id""",
    ),
    "dense_vectors": (dense_vectors, f"{_CHUNK_VECTORS} SELECT chunk_id, bucket, round(v, 5) AS v FROM dense"),
    "dense_topk_cosine": (_dense("cosine"), dense_sql("cosine")),
    "dense_topk_dot": (_dense("dot"), dense_sql("dot")),
    "dense_topk_euclid": (_dense("euclid"), dense_sql("euclid")),
    "sparse_topk": (sparse_topk, f"WITH RECURSIVE {INDEX_SQL}, {HITS_SQL} SELECT query_id, chunk_id, score, rank::INT AS rank FROM hits_sparse_top"),
    "hybrid_search": (hybrid_search, f"WITH RECURSIVE {INDEX_SQL}, {HITS_SQL} SELECT * FROM hits"),
    "retrieve": (retrieve, RETRIEVE_SQL),
    "payload_filter": (payload_filter, PAYLOAD_FILTER_SQL),
    "route_queries": (route_queries, ROUTE_SQL),
    "route_queries_joined": (route_queries_joined, ROUTE_SQL),
    "lane_retrieve": (lane_retrieve, f"WITH RECURSIVE {LANES_CTES} SELECT * FROM lanes"),
    "format_hits": (format_hits, FORMAT_SQL),
    "facets": (facets, FACETS_SQL),
    "unique_slugs": (unique_slugs, UNIQUE_SLUGS_SQL),
    "citation_list": (citation_list, CITATIONS_SQL),
    "hit_entities": (hit_entities, HIT_ENTITIES_SQL),
    "lane_blocks": (lane_blocks, LANE_BLOCKS_SQL),
    "eval_slugs": (eval_slugs, EVAL_SLUGS_SQL),
    "eval_text": (eval_text, EVAL_TEXT_SQL),
    "eval_routes": (eval_routes, EVAL_ROUTES_SQL),
    "eval_dual": (eval_dual, EVAL_DUAL_SQL),
}
