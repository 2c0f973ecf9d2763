"""Property graph joins.

``nodes(id, name, short_name, aliases, type, description, attributes, node_pos)``,
``edges(id, source, type, target, label, attributes)``. Neighbourhoods are rows,
not arrays, so a hub with a third of all edges stays spread over many tasks;
lists are only built where their length is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions.matching import joined_hits
from scriptorium.functions.rules import MAX_INLINE_RULES, fits_inline, inline_array
from scriptorium.functions.text import strip


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Known nodes, and one of type ``unknown`` for every edge end that is not known."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(
        missing.select("id", F.col("id").alias("name"), F.lit("unknown").alias("type")), allowMissingColumns=True
    )


def name_index(nodes: DataFrame) -> DataFrame:
    """``(alias, id, alias_pos)``: lower-cased names; the last owner holds a name, its first place stays."""
    names = F.concat(F.array("name", "short_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = (
        nodes.select("id", "node_pos", F.posexplode(names).alias("k", "raw"))
        .where("raw <> ''")
        .select(F.lower("raw").alias("alias"), "id", F.struct("node_pos", "k").alias("pos"))
    )
    return rows.groupBy("alias").agg(F.max_by("id", "pos").alias("id"), F.min("pos").alias("alias_pos"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge seen from both of its ends."""
    ends = F.array(
        F.struct(F.lit("outgoing").alias("direction"), F.col("source").alias("id"), F.col("target").alias("other_id")),
        F.struct(F.lit("incoming").alias("direction"), F.col("target").alias("id"), F.col("source").alias("other_id")),
    )
    carried = [c for c in ("label", "attributes") if c in edges.columns]
    return edges.select(F.col("id").alias("rel_id"), F.col("type").alias("rel_type"), *carried, F.explode(ends).alias("e")).select(
        "e.id", "rel_id", "e.direction", "rel_type", "e.other_id", *carried
    )


def find_entities(names: DataFrame, index: DataFrame) -> DataFrame:
    """``(name, id)`` for ``names(name)``: the equal alias, else the first that contains the
    name or is contained in it. Only names without an equal alias are searched further."""
    keyed = names.select("name").distinct().withColumn("key", F.lower(strip(F.col("name"))))
    exact = keyed.join(index.select(F.col("alias").alias("key"), "id"), "key")
    rest = keyed.join(exact.select("name"), "name", "left_anti")
    positions = index.select("alias", "id", "alias_pos")
    inside = joined_hits(rest, ["name"], "key", positions, ["alias"], "alias", mode="substring")
    around = joined_hits(positions, ["alias"], "alias", rest, ["name"], "key", mode="substring")
    first = (
        inside.select("name", "alias").unionByName(around.select("name", "alias"))
        .join(positions, "alias")
        .groupBy("name")
        .agg(F.min_by("id", "alias_pos").alias("id"))
    )
    return exact.select("name", "id").unionByName(first)


def entity_profile(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per entity of ``ids(id)`` and relation, with the entity at the other end."""
    others = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    near = adjacency(edges).join(ids.select("id").distinct(), "id", "left_semi")
    joined = near.join(others, "other_id", "left")
    return joined.withColumn("other_name", F.coalesce("other_name", "other_id")).withColumn(
        "other_type", F.coalesce("other_type", F.lit("unknown"))
    )


def related_entities(
    ids: DataFrame, nodes: DataFrame, edges: DataFrame, *, rel_type: str | None = None, direction: str | None = None
) -> DataFrame:
    kept = edges if rel_type is None else edges.where(F.col("type") == rel_type)
    profile = entity_profile(ids, nodes, kept)
    return profile if direction is None else profile.where(F.col("direction") == direction)


def relationships_between(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations of each pair ``(id, other_id)`` in either direction."""
    return adjacency(edges).join(pairs.select("id", "other_id").distinct(), ["id", "other_id"])


def search_entities(searches: DataFrame, nodes: DataFrame, entity_type: str | None = None, max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """``(query, id)`` for ``searches(query)``: the words anywhere in name, description or aliases.

    Up to ``max_inline`` searches ride in the plan, so that a node is read once and only hits are shuffled.
    """
    kept = nodes if entity_type is None else nodes.where(F.col("type") == entity_type)
    text = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("name", "short_name", "description")], F.array_join("aliases", " "))
    texts = kept.select("id", text.alias("text"))
    wanted = searches.select("query").where("query <> ''").distinct()
    if not fits_inline(wanted, max_inline):
        return joined_hits(texts, ["id"], "text", wanted, ["query"], "query", mode="substring").select("query", "id")
    asked = F.explode(inline_array(wanted.withColumn("t", F.lower("query")), "query", "t"))
    pairs = texts.select("id", F.lower("text").alias("text")).select("id", "text", asked.alias("asked"))
    return pairs.where(F.col("text").contains(F.col("asked.t"))).select("asked.query", "id").distinct()


def entities_by_type(nodes: DataFrame, entity_type: str) -> DataFrame:
    return nodes.where(F.col("type") == entity_type)


def detect_graph_entities(queries: DataFrame, index: DataFrame, extra_names: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, pos)``: entities whose alias of at least three characters a query
    contains, in alias order, then those of ``extra_names(query_id, name)``."""
    usable = index.where(F.length("alias") >= 3)
    in_query = joined_hits(queries, ["query_id"], "query", usable, ["alias"], "alias", mode="substring").join(usable, "alias")
    found = in_query.select("query_id", "id", F.struct(F.lit(0).alias("part"), "alias_pos").alias("pos"))
    if extra_names is not None:
        named = extra_names.where("name <> ''")
        ids = find_entities(named, index)
        first = index.groupBy("id").agg(F.min("alias_pos").alias("alias_pos"))
        extra = named.join(ids, "name").join(first, "id")
        found = found.unionByName(extra.select("query_id", "id", F.struct(F.lit(1).alias("part"), "alias_pos").alias("pos")))
    return found.groupBy("query_id", "id").agg(F.min("pos").alias("pos"))


def context_blocks(ids: DataFrame, nodes: DataFrame, edges: DataFrame, max_rels: int = 8) -> DataFrame:
    """``(id, block)``: name, description, attributes and the first ``max_rels`` relations."""
    order = Window.partitionBy("id").orderBy("rel_id", F.desc("direction"))
    near = adjacency(edges).join(ids.select("id").distinct(), "id", "left_semi")
    first = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_rels)
    others = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    named = first.join(others, "other_id", "left")
    arrow = F.when(F.col("direction") == "outgoing", "->").otherwise("<-")
    line = F.format_string("    %1$s %2$s %1$s %3$s", arrow, F.replace("rel_type", F.lit("_"), F.lit(" ")), F.coalesce("other_name", "other_id"))
    lines = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("rels"))
    wanted = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    attributes = F.transform(
        F.filter(F.array_sort(F.map_entries("attributes")), lambda e: e["value"] != ""),
        lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"]),
    )
    none = F.array().cast("array<string>")
    relations = F.coalesce(F.concat(F.array(F.lit("  Relationships:")), F.transform("rels", lambda r: r["line"])), none)
    parts = F.concat(
        F.array_compact(
            F.array(
                F.format_string("Knowledge Graph — %s (%s)", "name", F.coalesce("type", F.lit("unknown"))),
                F.when(F.col("description") != "", F.concat(F.lit("  Description: "), strip(F.col("description")))),
            )
        ),
        F.coalesce(attributes, none),
        relations,
    )
    return wanted.join(lines, "id", "left").select("id", F.array_join(parts, "\n").alias("block"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(measure, n)``: entities, relations, aliases, and entities per type."""
    everything = all_nodes(nodes, edges)

    def measure(df: DataFrame, name: Column) -> DataFrame:
        return df.groupBy(name.alias("measure")).agg(F.count("*").alias("n"))

    return (
        measure(everything, F.lit("entities"))
        .unionByName(measure(edges, F.lit("relationships")))
        .unionByName(measure(name_index(nodes), F.lit("aliases")))
        .unionByName(measure(everything, F.concat(F.lit("type:"), F.coalesce("type", F.lit("unknown")))))
    )


def graph_export(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables of an exported graph: entities, relations and three indexes."""
    everything = all_nodes(nodes, edges)
    return {
        "entities": everything,
        "relationships": edges,
        "by_name": name_index(nodes),
        "by_type": everything.select("type", "id"),
        "adjacency": adjacency(edges),
    }
