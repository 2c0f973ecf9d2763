"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import chunking
from workloads import fixtures as fx


def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.spread(fx.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.estimate_tokens(F.col("text")).alias("tokens"))


ESTIMATE_TOKENS_SQL = r"""
SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INT AS words,
       greatest(1, trunc(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE))::INT AS tokens
FROM documents"""


def split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = fx.posts(spark, sf_dir)
    sections = posts.select("slug", "title", chunking.split_sections(F.col("body")).alias("s"))
    paths = sections.select("slug", "s", chunking.heading_paths(F.col("s"), F.col("title")).alias("p"))
    return paths.select("slug", F.posexplode(F.arrays_zip("s", "p")).alias("section", "x")).select(
        "slug",
        "section",
        F.col("x.s.level").alias("level"),
        F.col("x.s.heading").alias("heading"),
        F.col("x.p").alias("heading_path"),
        F.length("x.s.text").alias("n_chars"),
    )


_SECTIONS = r"""
body_lines AS (
  SELECT slug, title, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i
  FROM posts WHERE body <> ''
),
marked AS (
  SELECT *, regexp_matches(line, '^#{1,6}\s') AS is_head,
         len(regexp_extract(line, '^(#{1,6})\s', 1)) AS level,
         trim(regexp_extract(line, '^#{1,6}\s+(.*)', 1)) AS heading
  FROM body_lines
),
numbered AS MATERIALIZED (
  SELECT *, sum(is_head::INT) OVER (PARTITION BY slug ORDER BY i) AS sec,
         max(CASE WHEN level = 1 THEN i END) OVER w AS p1,
         max(CASE WHEN level = 2 THEN i END) OVER w AS p2,
         max(CASE WHEN level = 3 THEN i END) OVER w AS p3
  FROM marked WINDOW w AS (PARTITION BY slug ORDER BY i)
),
first_secs AS (SELECT slug, min(sec) AS first_sec FROM numbered GROUP BY slug),
heads AS (SELECT slug, i, heading FROM marked WHERE is_head),
sections AS MATERIALIZED (
  SELECT n.slug, n.title, n.sec, max(n.level)::INT AS level, max(n.heading) AS heading,
         max(p1) AS p1, max(p2) AS p2, max(p3) AS p3,
         trim(coalesce(string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY i), ''), ' ' || chr(10)) AS text
  FROM numbered n GROUP BY n.slug, n.title, n.sec
),
paths AS MATERIALIZED (
  SELECT s.slug, s.title, s.sec - f.first_sec AS section, s.level, coalesce(s.heading, '') AS heading, s.text,
    CASE WHEN s.level = 0 THEN s.title ELSE concat_ws(' / ', h1.heading, h2.heading, h3.heading) END AS heading_path
  FROM sections s JOIN first_secs f USING (slug)
  LEFT JOIN heads h1 ON h1.slug = s.slug AND h1.i = s.p1
  LEFT JOIN heads h2 ON h2.slug = s.slug AND h2.i = s.p2 AND s.p2 > coalesce(s.p1, 0) AND s.level >= 2
  LEFT JOIN heads h3 ON h3.slug = s.slug AND h3.i = s.p3 AND s.p3 > coalesce(s.p1, 0) AND s.p3 > coalesce(s.p2, 0) AND s.level >= 3
)"""

SPLIT_SECTIONS_SQL = f"""
WITH {fx.POSTS_SQL}, {_SECTIONS}
SELECT slug, section::INT AS section, level, heading, heading_path, len(text)::INT AS n_chars FROM paths"""


def make_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.make_chunks(fx.posts(spark, sf_dir))


def chunks_sql(posts: str = "posts", limit: int = 700, overlap: int = 100) -> str:
    """CTEs ending in ``chunks``; needs the CTEs of the posts and of their sections."""
    return rf"""
paras AS MATERIALIZED (
  SELECT slug, section, heading_path, j, text, greatest(1, trunc(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE))::INT AS tok
  FROM (
    SELECT slug, section, heading_path, row_number() OVER (PARTITION BY slug, section ORDER BY k) AS j, text
    FROM (
      SELECT slug, section, heading_path, 0 AS k, heading AS text FROM paths WHERE level > 0 AND heading <> ''
      UNION ALL
      SELECT slug, section, heading_path, generate_subscripts(ps, 1) AS k, trim(unnest(ps)) AS text
      FROM (SELECT *, regexp_split_to_array(text, '\n{{2,}}') AS ps FROM paths)
    ) WHERE text <> ''
  )
),
sums AS MATERIALIZED (SELECT *, sum(tok) OVER (PARTITION BY slug, section ORDER BY j) AS cum FROM paras),
overlap_at AS MATERIALIZED (
  SELECT a.slug, a.section, a.j, coalesce(min(b.j), a.j) AS ov
  FROM sums a LEFT JOIN sums b
    ON a.slug = b.slug AND a.section = b.section AND b.j < a.j AND (a.cum - a.tok) - (b.cum - b.tok) <= {overlap}
  GROUP BY a.slug, a.section, a.j
),
steps AS MATERIALIZED (SELECT s.*, o.ov FROM sums s JOIN overlap_at o USING (slug, section, j)),
walk AS MATERIALIZED (
  SELECT slug, section, j, 1::BIGINT AS start, tok::BIGINT AS held, NULL::BIGINT AS closed_start FROM steps WHERE j = 1
  UNION ALL
  SELECT s.slug, s.section, s.j,
         CASE WHEN w.held + s.tok > {limit} THEN greatest(w.start, s.ov) ELSE w.start END,
         CASE WHEN w.held + s.tok > {limit}
              THEN (s.cum - (SELECT x.cum - x.tok FROM sums x WHERE x.slug = s.slug AND x.section = s.section
                                                                AND x.j = greatest(w.start, s.ov)))::BIGINT
              ELSE w.held + s.tok END,
         CASE WHEN w.held + s.tok > {limit} THEN w.start END
  FROM walk w JOIN steps s ON s.slug = w.slug AND s.section = w.section AND s.j = w.j + 1
),
pieces AS MATERIALIZED (
  SELECT slug, section, closed_start AS a, j - 1 AS b FROM walk WHERE closed_start IS NOT NULL
  UNION ALL
  SELECT slug, section, arg_max(start, j), max(j) FROM walk GROUP BY slug, section
),
body_chunks AS (
  SELECT p.slug, p.section, p.a, p.b, any_value(q.heading_path) AS heading_path, string_agg(q.text, chr(10) || chr(10) ORDER BY q.j) AS chunk_text
  FROM pieces p JOIN paras q ON q.slug = p.slug AND q.section = p.section AND q.j BETWEEN p.a AND p.b
  GROUP BY p.slug, p.section, p.a, p.b
),
intros AS (
  SELECT slug, title AS heading_path, concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(summary, '')) AS chunk_text
  FROM {posts} WHERE trim(title) <> '' OR trim(summary) <> ''
),
all_chunks AS (
  SELECT slug, -1 AS section, 0 AS a, 0 AS b, heading_path, chunk_text, 'summary' AS chunk_type FROM intros
  UNION ALL
  SELECT slug, section, a, b, heading_path, chunk_text, 'body' FROM body_chunks
),
chunks AS MATERIALIZED (
  SELECT slug || '__' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS chunk_id, slug,
         n::INT AS chunk_index, chunk_type, heading_path, chunk_text,
         len(regexp_extract_all(chunk_text, '\S+'))::INT AS word_count
  FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY section, a, b) - 1 AS n FROM all_chunks)
)"""


CHUNKS_CTES = f"{fx.POSTS_SQL}, {_SECTIONS}, {chunks_sql()}"
MAKE_CHUNKS_SQL = f"WITH RECURSIVE {CHUNKS_CTES} SELECT * FROM chunks"


def pack_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing alone, with tight limits so that overlaps are common."""
    docs = fx.spread(fx.table(spark, sf_dir, "documents"))
    blocks = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return docs.select(
        F.col("doc_id"), F.posexplode(chunking.pack_paragraphs(blocks, 120, 40)).alias("piece", "piece_text")
    )


PACK_SQL = f"""
WITH RECURSIVE posts AS (SELECT doc_id::VARCHAR AS slug, '' AS title, '' AS summary FROM documents),
paths AS MATERIALIZED (
  SELECT doc_id::VARCHAR AS slug, 0 AS section, '' AS heading_path, 0 AS level, '' AS heading,
         replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents
), {chunks_sql(limit=120, overlap=40)}
SELECT slug::BIGINT AS doc_id, chunk_index AS piece, chunk_text AS piece_text FROM chunks"""


def knowledge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.make_chunks(fx.posts(spark, sf_dir), *chunking.KNOWLEDGE_LIMITS)
    return chunks.select(
        "chunk_id",
        chunking.map_chunk_type(F.col("chunk_type"), F.replace(F.lower("heading_path"), F.lit("the"), F.lit("terms"))).alias("chunk_type"),
        "word_count",
    )


KNOWLEDGE_CHUNKS_SQL = f"""
WITH RECURSIVE {fx.POSTS_SQL}, {_SECTIONS}, {chunks_sql(limit=585, overlap=65)}
SELECT chunk_id,
  CASE WHEN chunk_type = 'summary' THEN 'overview'
       WHEN regexp_matches(lower(heading_path), 'faq|frequently asked|questions & answers|q&a') THEN 'faq'
       WHEN regexp_matches(replace(lower(heading_path), 'the', 'terms'), 'definition|glossary|terminology|key terms|terms') THEN 'definition'
       ELSE 'section' END AS chunk_type, word_count
FROM chunks"""


def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", chunking.stable_id(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("__000"))).alias("point_id"))


STABLE_ID_SQL = r"""
SELECT doc_id,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1('\x6b\xa7\xb8\x10\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode('doc-' || doc_id || '__000')) AS h FROM documents)"""

QUERIES = {
    "estimate_tokens": (estimate_tokens, ESTIMATE_TOKENS_SQL),
    "split_sections": (split_sections, SPLIT_SECTIONS_SQL),
    "pack_paragraphs": (pack_paragraphs, PACK_SQL),
    "make_chunks": (make_chunks, MAKE_CHUNKS_SQL),
    "knowledge_chunks": (knowledge_chunks, KNOWLEDGE_CHUNKS_SQL),
    "stable_id": (stable_id, STABLE_ID_SQL),
}
