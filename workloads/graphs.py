"""Graph queries over the star schema: regions, nations, customers, suppliers, parts."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import graph
from scriptorium.session import written
from workloads import fixtures as fx

# table, type, key, name, place in the node order
_NODE_TABLES = [
    ("region", "r_regionkey", "r_name", 0),
    ("nation", "n_nationkey", "n_name", 1),
    ("supplier", "s_suppkey", "s_name", 2),
    ("customer", "c_custkey", "c_name", 3),
    ("part", "p_partkey", "p_name", 4),
]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, key, label, place in _NODE_TABLES:
        extra = F.create_map(F.lit("segment"), F.col("c_mktsegment")) if name == "customer" else F.create_map().cast("map<string,string>")
        rows = fx.table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}-"), F.col(key).cast("string")).alias("id"),
            F.col(label).alias("name"),
            F.lit(None).cast("string").alias("short_name"),
            F.array(F.col(label), F.lower(label)).alias("aliases"),
            F.lit(name).alias("type"),
            F.lit(f"A {name} of the schema.").alias("description"),
            extra.alias("attributes"),
            (F.col(key).cast("long") + place * 1_000_000_000_000).alias("node_pos"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(column: str):
        return F.col(column).cast("string")

    def edge(df: DataFrame, ident, source, kind: str, target) -> DataFrame:
        return df.select(ident.alias("id"), source.alias("source"), F.lit(kind).alias("type"), target.alias("target"), F.lit(kind.upper()).alias("label"))

    def made(prefix: str, column: str):
        return F.concat(F.lit(prefix), text(column))

    n, c, s = (fx.table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    supplies = fx.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return (
        edge(n, made("loc-", "n_nationkey"), made("nation-", "n_nationkey"), "located_in", made("region-", "n_regionkey"))
        .unionByName(edge(c, made("cus-", "c_custkey"), made("customer-", "c_custkey"), "based_in", made("nation-", "c_nationkey")))
        .unionByName(edge(s, made("sup-", "s_suppkey"), made("supplier-", "s_suppkey"), "based_in", made("nation-", "s_nationkey")))
        .unionByName(
            edge(
                supplies,
                F.concat(made("sp-", "l_suppkey"), F.lit("-"), text("l_partkey")),
                made("supplier-", "l_suppkey"),
                "supplies",
                made("part-", "l_partkey"),
            )
        )
    )


GRAPH_SQL = (
    "nodes AS MATERIALIZED ("
    + " UNION ALL ".join(
        f"SELECT '{t}-' || {k} AS id, {n} AS name, '{t}' AS type, {k}::BIGINT + {p}::BIGINT * 1000000000000 AS node_pos FROM {t}"
        for t, k, n, p in _NODE_TABLES
    )
    + """),
edges AS MATERIALIZED (
  SELECT 'loc-' || n_nationkey AS id, 'nation-' || n_nationkey AS source, 'located_in' AS type, 'region-' || n_regionkey AS target FROM nation
  UNION ALL SELECT 'cus-' || c_custkey, 'customer-' || c_custkey, 'based_in', 'nation-' || c_nationkey FROM customer
  UNION ALL SELECT 'sup-' || s_suppkey, 'supplier-' || s_suppkey, 'based_in', 'nation-' || s_nationkey FROM supplier
  UNION ALL SELECT DISTINCT 'sp-' || l_suppkey || '-' || l_partkey, 'supplier-' || l_suppkey, 'supplies', 'part-' || l_partkey FROM lineitem
),
adj AS MATERIALIZED (
  SELECT source AS id, id AS rel_id, 'outgoing' AS direction, type AS rel_type, target AS other_id FROM edges
  UNION ALL SELECT target, id, 'incoming', type, source FROM edges
),
aliases AS MATERIALIZED (SELECT lower(name) AS alias, arg_max(id, node_pos) AS id, min(node_pos) AS pos FROM nodes GROUP BY lower(name))"""
)


@cache
def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(graph.name_index(nodes(spark, sf_dir)))


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("alias", "id", F.col("alias_pos.node_pos").alias("pos"))


def implicit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that lost its parts gets them back as nodes of unknown type."""
    known = nodes(spark, sf_dir).where("type <> 'part'")
    return graph.all_nodes(known, edges(spark, sf_dir)).select("id", "name", "type")


IMPLICIT_SQL = f"""WITH {GRAPH_SQL}
SELECT id, name, type FROM nodes WHERE type <> 'part' UNION ALL
SELECT DISTINCT target, target, 'unknown' FROM edges WHERE target LIKE 'part-%'"""


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(edges(spark, sf_dir)).select("id", "rel_id", "direction", "rel_type", "other_id")


def wanted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names, names inside longer texts, and pieces of names."""
    nation = fx.table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("name"))
    supplier = fx.table(spark, sf_dir, "supplier").select(F.concat(F.lit("firm "), F.col("s_name")).alias("name"))
    region = fx.table(spark, sf_dir, "region").select(F.substring("r_name", 2, 3).alias("name"))
    unknown = fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("zz"), F.col("c_custkey").cast("string"), F.lit("zz")).alias("name"))
    return nation.union(supplier).union(region).union(unknown)


_NAMES_SQL = """
names AS MATERIALIZED (
  SELECT ' ' || lower(n_name) || ' ' AS name FROM nation UNION SELECT 'firm ' || s_name FROM supplier UNION SELECT substr(r_name, 2, 3) FROM region
  UNION SELECT 'zz' || c_custkey || 'zz' FROM customer
),
found AS MATERIALIZED (
  SELECT * FROM (SELECT name, coalesce(any_value(e.id), arg_min(p.id, p.pos)) AS found_id FROM names n
  LEFT JOIN aliases e ON e.alias = lower(trim(n.name))
  LEFT JOIN aliases p ON e.id IS NULL AND (contains(p.alias, lower(trim(n.name))) OR contains(lower(trim(n.name)), p.alias))
  GROUP BY name) WHERE found_id IS NOT NULL
)"""


def find_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_entities(wanted_names(spark, sf_dir), _index(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier, and every nation: the hubs."""
    return nodes(spark, sf_dir).where("type IN ('supplier', 'nation')").select("id")


def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = graph.entity_profile(_found(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir))
    return profile.select("id", "rel_id", "direction", "rel_type", "other_id", "other_name", "other_type", "label")


PROFILE_SQL = f"""WITH {GRAPH_SQL}
SELECT a.*, o.name AS other_name, o.type AS other_type, upper(rel_type) AS label FROM adj a JOIN nodes o ON o.id = a.other_id
JOIN nodes me ON me.id = a.id AND me.type IN ('supplier', 'nation')"""


def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graph.related_entities(_found(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir), rel_type="based_in", direction="incoming")
    return near.select("id", "other_id", "other_name")


RELATED_SQL = f"""WITH {GRAPH_SQL}
SELECT a.id, a.other_id, o.name AS other_name FROM adj a JOIN nodes o ON o.id = a.other_id
JOIN nodes me ON me.id = a.id AND me.type IN ('supplier', 'nation') WHERE rel_type = 'based_in' AND direction = 'incoming'"""


def relationships_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of every line item, seen from the part."""
    pairs = fx.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("id"),
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("other_id"),
    )
    return graph.relationships_between(pairs, edges(spark, sf_dir)).select("id", "other_id", "rel_id", "direction", "rel_type")


BETWEEN_SQL = f"""WITH {GRAPH_SQL}
SELECT id, other_id, rel_id, direction, rel_type FROM adj WHERE rel_type = 'supplies' AND direction = 'incoming'"""


def search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = spark.createDataFrame([("0000001",), ("widget",), ("RED",), ("of the",), ("none of these",)], "query string")
    return graph.search_entities(searches, nodes(spark, sf_dir))


SEARCH_SQL = f"""WITH {GRAPH_SQL}, q(query) AS (VALUES ('0000001'), ('widget'), ('RED'), ('of the'), ('none of these'))
SELECT query, id FROM q JOIN nodes ON contains(lower(name || ' A ' || type || ' of the schema. ' || name || ' ' || lower(name)), lower(query))"""


def entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities_by_type(nodes(spark, sf_dir), "supplier").select("id", "name")


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, c = (fx.table(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    told = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(c, c["c_custkey"] == s["s_suppkey"])
    text = F.concat(F.lit("Report: "), F.col("s_name"), F.lit(" sells a red widget in "), F.lower("n_name"), F.lit(" to "), F.col("c_name"))
    return told.select(F.col("s_suppkey").alias("query_id"), text.alias("query"))


def _extra_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.table(spark, sf_dir, "region")
    s = fx.table(spark, sf_dir, "supplier")
    return s.join(r, s["s_suppkey"] % 5 == r["r_regionkey"]).select(F.col("s_suppkey").alias("query_id"), F.col("r_name").alias("name"))


@cache
def _stored_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(graph.detect_graph_entities(_stories(spark, sf_dir), _index(spark, sf_dir), _extra_names(spark, sf_dir)))


def detect_graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_detected(spark, sf_dir).select("query_id", "id", "pos.part")


_DETECTED_SQL = """
stories AS (SELECT s_suppkey AS query_id, 'Report: ' || s_name || ' sells a red widget in ' || lower(n_name) || ' to ' || c_name AS query
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN customer ON c_custkey = s_suppkey),
seen AS (
  SELECT query_id, id, 0 AS part FROM stories JOIN aliases ON len(alias) >= 3 AND contains(lower(query), alias)
  UNION ALL SELECT s_suppkey, a.id, 1 FROM supplier JOIN region ON s_suppkey % 5 = r_regionkey JOIN aliases a ON a.alias = lower(r_name)
),
detected AS MATERIALIZED (SELECT query_id, id, min(part) AS part FROM seen GROUP BY query_id, id)"""


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.context_blocks(nodes(spark, sf_dir).select("id"), nodes(spark, sf_dir), edges(spark, sf_dir))


_BLOCKS_SQL = """
rels AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rel_id, direction DESC) AS k FROM adj),
rel_lines AS (
  SELECT r.id, string_agg(CASE direction WHEN 'outgoing' THEN '    -> ' || replace(rel_type, '_', ' ') || ' -> ' ELSE '    <- ' || replace(rel_type, '_', ' ') || ' <- ' END || o.name, chr(10) ORDER BY k) AS t
  FROM rels r JOIN nodes o ON o.id = r.other_id WHERE k <= 8 GROUP BY r.id
),
blocks AS MATERIALIZED (
  SELECT n.id, 'Knowledge Graph — ' || n.name || ' (' || n.type || ')' || chr(10) || '  Description: A ' || n.type || ' of the schema.'
    || coalesce(chr(10) || '  segment: ' || c_mktsegment, '') || coalesce(chr(10) || '  Relationships:' || chr(10) || t, '') AS block
  FROM nodes n LEFT JOIN rel_lines l USING (id) LEFT JOIN customer c ON n.id = 'customer-' || c.c_custkey
)"""


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_stats(nodes(spark, sf_dir), edges(spark, sf_dir))


STATS_SQL = f"""WITH {GRAPH_SQL}
SELECT 'entities' AS measure, count(*) AS n FROM nodes UNION ALL SELECT 'relationships', count(*) FROM edges UNION ALL SELECT 'aliases', count(*) FROM aliases
UNION ALL SELECT 'type:' || type, count(*) FROM nodes GROUP BY type"""


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per exported table."""
    tables = graph.graph_export(nodes(spark, sf_dir), edges(spark, sf_dir))
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


EXPORT_SQL = f"""WITH {GRAPH_SQL}
SELECT 'entities' AS table_name, count(*) AS n FROM nodes UNION ALL SELECT 'relationships', count(*) FROM edges UNION ALL SELECT 'by_name', count(*) FROM aliases
UNION ALL SELECT 'by_type', count(*) FROM nodes UNION ALL SELECT 'adjacency', count(*) FROM adj"""

QUERIES = {
    "name_index": (name_index, f"WITH {GRAPH_SQL} SELECT * FROM aliases"),
    "implicit_nodes": (implicit_nodes, IMPLICIT_SQL),
    "adjacency": (adjacency, f"WITH {GRAPH_SQL} SELECT * FROM adj"),
    "find_entities": (find_entities, f"WITH {GRAPH_SQL}, {_NAMES_SQL} SELECT name, found_id AS id FROM found"),
    "entity_profile": (entity_profile, PROFILE_SQL),
    "related_entities": (related_entities, RELATED_SQL),
    "relationships_between": (relationships_between, BETWEEN_SQL),
    "search_entities": (search_entities, SEARCH_SQL),
    "entities_by_type": (entities_by_type, f"WITH {GRAPH_SQL} SELECT id, name FROM nodes WHERE type = 'supplier'"),
    "detect_graph_entities": (detect_graph_entities, f"WITH {GRAPH_SQL}, {_DETECTED_SQL} SELECT * FROM detected"),
    "context_blocks": (context_blocks, f"WITH {GRAPH_SQL}, {_BLOCKS_SQL} SELECT * FROM blocks"),
    "graph_stats": (graph_stats, STATS_SQL),
    "graph_export": (graph_export, EXPORT_SQL),
}
