"""Media queries: quality, near-duplicates, hero and gallery, events."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions.text import word_list
from scriptorium.operators import media
from scriptorium.session import written
from workloads import fixtures as fx


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text fingerprints: per bit the sum of plus or minus one over the first 64 bits of each
    distinct word's md5, made in the task that reads its document."""
    docs = fx.spread(fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    bits = media.word_fingerprint(word_list(F.col("text")))
    return docs.select(F.col("lang").alias("event_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"), "doc_id", bits.alias("bits"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return _stored_prints(spark, sf_dir).select(
        "event_id",
        "filename",
        "bits",
        (400 + i * 37 % 2600).cast("int").alias("width"),
        (300 + i * 53 % 1700).cast("int").alias("height"),
        (1000 + i * 7919 % 2_000_000).alias("bytes"),
        (i * 31 % 1500).cast("double").alias("lap_var"),
        (i * 17 % 256).cast("double").alias("mean_b"),
    )


@cache
def _stored_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(fingerprints(spark, sf_dir))


PRINTS_SQL = r"""
words AS (SELECT doc_id, lang, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'))) AS w FROM documents),
hashed AS MATERIALIZED (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::UBIGINT AS hi, ('0x' || substr(md5(w), 9, 8))::UBIGINT AS lo FROM words WHERE w <> ''),
bits AS (
  SELECT doc_id, i, 2 * sum(CASE WHEN i < 32 THEN (hi >> (31 - i)) & 1 ELSE (lo >> (63 - i)) & 1 END) > count(*) AS b
  FROM hashed, range(64) r(i) GROUP BY doc_id, i
),
prints AS MATERIALIZED (
  SELECT d.lang AS event_id, 'd' || d.doc_id AS filename, d.doc_id,
    (coalesce(sum(CASE WHEN b AND i < 63 THEN 1::HUGEINT << i WHEN b THEN -(1::HUGEINT << 63) ELSE 0 END), 0))::BIGINT AS bits
  FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY d.lang, d.doc_id
),
assets AS MATERIALIZED (
  SELECT event_id, filename, bits, (400 + doc_id * 37 % 2600)::INT AS width, (300 + doc_id * 53 % 1700)::INT AS height,
    1000 + doc_id * 7919 % 2000000 AS bytes, (doc_id * 31 % 1500)::DOUBLE AS lap_var, (doc_id * 17 % 256)::DOUBLE AS mean_b FROM prints
),
parts AS (
  SELECT *, least(width::DOUBLE * height / 3000000, 1) * 100 AS res, least(lap_var / 1000, 1) * 100 AS sharp,
    CASE WHEN mean_b BETWEEN 80 AND 180 THEN 100 WHEN mean_b < 80 THEN mean_b / 80 * 100 ELSE greatest(0, (1 - (mean_b - 180) / 75) * 100) END AS expo,
    least(bytes / 1048576::DOUBLE, 1) * 100 AS fsize FROM assets
),
quality AS MATERIALIZED (
  SELECT event_id, filename, round(0.35::DOUBLE * res + 0.4::DOUBLE * sharp + 0.15::DOUBLE * expo + 0.1::DOUBLE * fsize, 1) AS total,
    round(res, 1) AS resolution, round(sharp, 1) AS sharpness, round(expo, 1) AS exposure, round(fsize, 1) AS filesize FROM parts
)"""


def text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, sf_dir).select("event_id", "filename", "bits")


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.quality_score(assets(spark, sf_dir)).select("event_id", "filename", "total", "resolution", "sharpness", "exposure", "filesize")


def difference_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = media.difference_bits(F.col("embedding"))
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(bits, "").alias("bits"), media.pack_bits(bits).alias("packed"))


DIFFERENCE_SQL = """WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
b AS (SELECT a.vec_id, a.i, (n.x > a.x)::INT AS b FROM v a JOIN v n ON a.vec_id = n.vec_id AND n.i = a.i + 1)
SELECT vec_id, string_agg(b::VARCHAR, '' ORDER BY i) AS bits, sum(b::HUGEINT << (i - 1)::INT)::BIGINT AS packed FROM b GROUP BY vec_id"""


@cache
def _stored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(media.near_duplicate_groups(_stored_prints(spark, sf_dir)))


def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_groups(spark, sf_dir).select("part", "name", "leader")


def near_duplicate_groups_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups with few wide bands that are probed within a radius."""
    return media.near_duplicate_groups(_stored_prints(spark, sf_dir), bands=(4, 2)).select("part", "name", "leader")


# Leaders one after the other, in name order: each step takes the next undecided item of a part.
GROUPS_SQL = f"""{PRINTS_SQL},
distinct_prints AS MATERIALIZED (SELECT event_id, bits, min(filename) AS filename FROM prints GROUP BY event_id, bits),
close AS MATERIALIZED (
  SELECT a.event_id, a.filename AS early, b.filename AS late FROM distinct_prints a JOIN distinct_prints b
  ON a.event_id = b.event_id AND a.filename < b.filename AND bit_count(xor(a.bits, b.bits)) <= 8
),
ordered AS MATERIALIZED (SELECT event_id, filename, row_number() OVER (PARTITION BY event_id ORDER BY filename) AS k FROM distinct_prints),
early_lists AS MATERIALIZED (
  SELECT o.event_id, o.k, o.filename, list(c.early) FILTER (WHERE c.early IS NOT NULL) AS earlier
  FROM ordered o LEFT JOIN close c ON c.event_id = o.event_id AND c.late = o.filename GROUP BY o.event_id, o.k, o.filename
),
greedy AS (
  SELECT event_id, 1::BIGINT AS k, [filename] AS leaders FROM early_lists WHERE k = 1
  UNION ALL
  SELECT g.event_id, e.k, CASE WHEN list_has_any(coalesce(e.earlier, []), g.leaders) THEN g.leaders ELSE list_append(g.leaders, e.filename) END
  FROM greedy g JOIN early_lists e ON e.event_id = g.event_id AND e.k = g.k + 1
),
leaders AS MATERIALIZED (SELECT event_id, unnest(leaders) AS leader FROM (SELECT event_id, arg_max(leaders, k) AS leaders FROM greedy GROUP BY event_id)),
led AS (
  SELECT d.event_id, d.bits, coalesce(own.leader, min(c.early)) AS leader FROM distinct_prints d
  LEFT JOIN leaders own ON own.event_id = d.event_id AND own.leader = d.filename
  LEFT JOIN (SELECT close.* FROM close JOIN leaders ON leaders.event_id = close.event_id AND leaders.leader = close.early) c ON c.event_id = d.event_id AND c.late = d.filename
  GROUP BY d.event_id, d.bits, own.leader
),
groups AS MATERIALIZED (SELECT p.event_id AS part, p.filename AS name, l.leader FROM prints p JOIN led l ON l.event_id = p.event_id AND l.bits = p.bits)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.quality_score(assets(spark, sf_dir)).select(F.col("event_id").alias("part"), F.col("filename").alias("name"), "total")


def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.keep_best(_stored_groups(spark, sf_dir), _scores(spark, sf_dir)).select("part", "name", "leader", "total", "group_size", "duplicate")


_BEST_SQL = """
best AS MATERIALIZED (
  SELECT g.part, g.name, g.leader, q.total, count(*) OVER (PARTITION BY g.part, leader) AS group_size,
    row_number() OVER (PARTITION BY g.part, leader ORDER BY total DESC, g.name) > 1 AS duplicate
  FROM groups g JOIN quality q ON q.event_id = g.part AND q.filename = g.name
)"""


def hero_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = media.keep_best(_stored_groups(spark, sf_dir), _scores(spark, sf_dir))
    return media.hero_gallery(kept).select("part", "name", "rank", "role")


_ROLES_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY part, NOT duplicate AND total > 0 ORDER BY total DESC, name) AS r FROM best),
roles AS MATERIALIZED (SELECT part, name, CASE WHEN NOT duplicate AND total > 0 AND r <= 10 THEN r END::INT AS rank,
  CASE WHEN duplicate THEN 'duplicate' WHEN total > 0 AND r = 1 THEN 'hero' WHEN total > 0 AND r <= 10 THEN 'gallery'
       WHEN total > 0 AND total < 15 THEN 'low_quality' ELSE 'unused' END AS role FROM ranked)"""


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = hero_gallery(spark, sf_dir).where("rank IS NOT NULL")
    pairs = F.array_sort(F.collect_list(F.struct("rank", "name")))
    return roles.groupBy(F.col("part").alias("event_id")).agg(pairs.alias("r")).select(
        "event_id",
        F.get("r", F.lit(0))["name"].alias("hero"),
        F.transform(F.slice("r", 2, 9), lambda x: x["name"]).alias("gallery"),
        F.transform("r", lambda x: x["name"]).alias("usable"),
    )


def reselect_hero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice: the third of the gallery, or in French a file that does not exist."""
    selection = written(_selection(spark, sf_dir))
    advice = selection.select("event_id", F.when(F.col("event_id") == "fr", "none.jpg").otherwise(F.get("gallery", F.lit(2))).alias("advised"))
    return media.reselect_hero(selection, advice).select("event_id", "hero", F.array_join("gallery", "|").alias("gallery"))


_PICKED_SQL = """
picked AS (SELECT part, max(CASE WHEN rank = 1 THEN name END) AS hero, list(name ORDER BY rank) FILTER (WHERE rank > 1) AS gallery FROM roles WHERE rank IS NOT NULL GROUP BY part)"""
RESELECT_SQL = f"""WITH RECURSIVE {GROUPS_SQL}, {_BEST_SQL}, {_ROLES_SQL}, {_PICKED_SQL}
SELECT part AS event_id, CASE WHEN part = 'fr' THEN hero ELSE gallery[3] END AS hero,
  array_to_string(CASE WHEN part = 'fr' THEN gallery ELSE list_concat([hero], list_filter(gallery, lambda g: g <> gallery[3])[1:8]) END, '|') AS gallery FROM picked"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    dated = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderpriority"))
    return orders.select(F.lit("/media").alias("base_dir"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(dated).alias("folder_name"))


def register_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days as folders; finished orders are already registered."""
    listing = _listing(spark, sf_dir)
    nothing = spark.createDataFrame([], "event_id string, folder_name string, event_name string, event_date string, base_dir string, status string")
    orders = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    first = media.register_events(
        nothing, orders.select(F.lit("/media").alias("base_dir"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderpriority")).alias("folder_name"))
    ).withColumn("status", F.lit("scored"))
    return media.register_events(first, listing)


REGISTER_SQL = r"""WITH f AS (
  SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority AS folder_name, 'scored' AS status FROM orders WHERE o_orderstatus = 'F'
), l AS (
  SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority END AS folder_name FROM orders
), a AS (SELECT * FROM f UNION ALL SELECT folder_name, 'pending' FROM l WHERE folder_name NOT IN (SELECT folder_name FROM f))
SELECT substr(sha256('/media::' || folder_name), 1, 16) AS event_id, folder_name,
  CASE WHEN regexp_matches(folder_name, '^\d{4}-\d{2}-\d{2}\s+.+$') THEN regexp_extract(folder_name, '^\d{4}-\d{2}-\d{2}\s+(.+)$', 1) ELSE folder_name END AS event_name,
  CASE WHEN regexp_matches(folder_name, '^\d{4}-\d{2}-\d{2}\s+.+$') THEN substr(folder_name, 1, 10) END AS event_date, '/media' AS base_dir, status FROM a"""


def export_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as events: some with an editor's values, all with analysed ones."""
    c = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = "map<string,string>"
    events = c.select(
        k.cast("string").alias("event_id"),
        F.col("c_name").alias("event_name"),
        F.lit(None).cast("string").alias("event_date"),
        F.concat("c_mktsegment", F.lit(".jpg")).alias("hero"),
        F.array(F.lit("a.png"), F.lit("b.JPG")).alias("gallery"),
        F.abs("c_acctbal").alias("hero_score"),
        F.when(k % 3 == 0, F.create_map(F.lit("altTextEn"), F.lit("edited"), F.lit("eventSlug"), F.concat(F.lit("e-"), k.cast("string"))))
        .otherwise(F.create_map().cast(text)).alias("meta"),
        F.create_map(F.lit("alt_text_en"), F.col("c_mktsegment")).alias("analysis"),
    )
    return media.export_metadata(events).select(
        "event_id", "event_slug", "event_date", "event_name", "alt_text_en", "caption_en", "hero_filename", F.array_join("gallery_files", "|").alias("files")
    )


EXPORT_SQL = r"""SELECT c_custkey::VARCHAR AS event_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'e-' || c_custkey ELSE regexp_replace(lower(c_name), '[^\p{L}\p{N}_-]', '-', 'g') END AS event_slug, '' AS event_date, c_name AS event_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'edited' ELSE c_mktsegment END AS alt_text_en, '' AS caption_en, 'hero.jpg' AS hero_filename, 'gallery-01.png|gallery-02.JPG' AS files FROM customer"""

QUERIES = {
    "text_fingerprints": (text_fingerprints, f"WITH {PRINTS_SQL} SELECT event_id, filename, bits FROM prints"),
    "quality_score": (quality_score, f"WITH {PRINTS_SQL} SELECT * FROM quality"),
    "difference_bits": (difference_bits, DIFFERENCE_SQL),
    "near_duplicate_groups": (near_duplicate_groups, f"WITH RECURSIVE {GROUPS_SQL} SELECT part, name, leader FROM groups"),
    "near_duplicate_groups_narrow": (near_duplicate_groups_narrow, f"WITH RECURSIVE {GROUPS_SQL} SELECT part, name, leader FROM groups"),
    "keep_best": (keep_best, f"WITH RECURSIVE {GROUPS_SQL}, {_BEST_SQL} SELECT * FROM best"),
    "hero_gallery": (hero_gallery, f"WITH RECURSIVE {GROUPS_SQL}, {_BEST_SQL}, {_ROLES_SQL} SELECT * FROM roles"),
    "reselect_hero": (reselect_hero, RESELECT_SQL),
    "register_events": (register_events, REGISTER_SQL),
    "export_metadata": (export_metadata, EXPORT_SQL),
}
