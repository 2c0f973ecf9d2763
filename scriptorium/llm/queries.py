"""Registered queries of this package and their SQL counterparts: ``name -> (query, sql or None)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontamination, divergence, fingerprints, jaccard_join, language_id, lm_scoring, mixing, prefix_trie, quality, simhash, suffix_dedup, token_counts, url_filter
from scriptorium.llm.common import fold

TOKENIZER = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, str(public_tokenizers.path(TOKENIZER)), token_counts.private_cache(spark))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), own_blocks=mixing.OWN_BLOCKS)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify_languages(docs, language_id.fit_languages(docs.where(fold("doc_id", 5) != 0)))


# host, path, verdict
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_rules(spark))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_counts(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


_OP9 = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
located AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT n, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM located JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM located LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (n)
"""

_OP7 = r"""
WITH rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM rows_ GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER upto, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0) AS open_
  FROM weighed WINDOW upto AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS MATERIALIZED (
  SELECT place, source, source_size,
    CASE WHEN cap * open_ <= rest * weight THEN cap ELSE weight * max(CASE WHEN cap * open_ > rest * weight THEN rest / open_ END) OVER () END AS target FROM filled),
size_ AS (SELECT greatest(1, ceil(coalesce(sum(source_size), 0)::BIGINT * 1.5::DOUBLE / 1000000))::BIGINT AS most FROM targets),
sized AS MATERIALIZED (
  SELECT *, greatest(1, least(most, floor(least(source_size, target) / 2000)))::BIGINT AS block FROM targets, size_),
blocked AS (
  SELECT *, ceil(source_size / block)::BIGINT AS blocks, floor(target / source_size) AS rounds FROM sized WHERE target > 0),
needs AS (
  SELECT place, blocks, least(rounds * blocks + floor((target - rounds * source_size) / block + 0.5), blocks * 2)::BIGINT AS need FROM blocked),
-- A source's slots have the ranks from 0 to its need, in rounds over its blocks.
draws AS (
  SELECT place, block_no, need // blocks + (block_no < need % blocks)::INT AS times
  FROM (SELECT *, unnest(range(blocks)) AS block_no FROM needs)),
placed AS (
  SELECT r, doc_id, size, source_size, target, place, block,
    coalesce(sum(size) OVER (PARTITION BY place ORDER BY ('0x' || h[1:6])::BIGINT % 4096, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_
  FROM rows_ JOIN sized ON rows_.source IS NOT DISTINCT FROM sized.source),
pieces AS (
  SELECT r, place, begin_, begin_ + size AS end_, block, unnest(range(begin_ // block, (begin_ + size - 1) // block + 1)) AS block_no
  FROM placed WHERE size > 0),
taken AS (
  SELECT r, sum((least(end_, (block_no + 1) * block) - greatest(begin_, block_no * block)) * times)::BIGINT AS taken
  FROM pieces JOIN draws USING (place, block_no) GROUP BY r)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (r)
"""

_OP10 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS MATERIALIZED (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
starts AS (SELECT r, i FROM windows SEMI JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)),
runs AS (
  SELECT r, i, sum((before IS NULL OR i > before + 400)::INT) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM starts)),
spans AS MATERIALIZED (SELECT r, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, g),
pieces AS (
  SELECT r, a AS pos, substr(h, 2 * before + 1, 2 * (a - before)) AS s
  FROM (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans) JOIN d USING (r)
  UNION ALL SELECT r, 1099511627776, substr(h, 2 * b + 1) FROM (SELECT r, max(b) AS b FROM spans GROUP BY r) JOIN d USING (r)),
kept AS (SELECT r, string_agg(s, '' ORDER BY pos) AS s FROM pieces GROUP BY r),
counts AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(s, h))) AS kept_sha256
FROM d LEFT JOIN counts USING (r) LEFT JOIN kept USING (r)
"""

QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_lm_scores": (op2_lm_scores, None),
    "op3_fingerprints": (op3_fingerprints, None),
    "op4_decontamination": (op4_decontamination, None),
    "op5_simhash_groups": (op5_simhash_groups, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_mixing": (op7_mixing, _OP7),
    "op8_language_id": (op8_language_id, None),
    "op9_url_filter": (op9_url_filter, _OP9),
    "op10_suffix_dedup": (op10_suffix_dedup, _OP10),
    "op11_divergence": (op11_divergence, divergence.SQL),
    "op12_prefix_trie": (op12_prefix_trie, prefix_trie.SQL),
    "op13_jaccard_join": (op13_jaccard_join, jaccard_join.SQL),
}
