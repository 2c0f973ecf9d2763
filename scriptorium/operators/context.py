"""Hits as records, citations and context texts. Lists hold at most the hits of one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.text import strip
from scriptorium.operators.tagging import ENTITY_TYPES


def format_hits(hits: DataFrame, text_limit: int | None = None) -> DataFrame:
    """One typed record per hit, entity arrays nested, score rounded to 4 places."""
    text = F.coalesce("chunk_text", F.lit(""))
    return hits.select(
        "query_id",
        "rank",
        F.col("id"),
        F.round("score", 4).alias("score"),
        "chunk_type",
        "chunk_index",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("slug", F.lit("")).alias("slug"),
        (text if text_limit is None else F.substring(text, 1, text_limit)).alias("text"),
        "word_count",
        "heading_path",
        F.substring("date", 1, 10).alias("date"),
        "year",
        "quarter",
        "month",
        F.coalesce("category", F.lit("")).alias("category"),
        "tags",
        "source_document",
        "language",
        "status",
        F.struct(*[F.col(f"entities_{t}").alias(t) for t in ENTITY_TYPES]).alias("entities"),
    )


def facets(index: DataFrame, fields: tuple[str, ...] = ("category", "chunk_type", "quarter", "year", "language")) -> DataFrame:
    """``(facet, value, n)``: the values the index can be narrowed by, in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields])
    return (
        index.select(F.explode(pairs).alias("p"))
        .where("p.value IS NOT NULL")
        .groupBy("p.facet", "p.value")
        .agg(F.count("*").alias("n"))
    )


def sources_of(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        "rank",
        "slug",
        "chunk_id",
        "chunk_index",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.substring("date", 1, 10), F.lit("")).alias("date"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.round("score", 4).alias("score"),
        F.coalesce("source_document", F.lit("")).alias("source_document"),
    )


def unique_slugs(hits: DataFrame) -> DataFrame:
    """``(query_id, slugs)`` in order of first appearance."""
    return (
        hits.where("slug <> ''")
        .groupBy("query_id", "slug")
        .agg(F.min("rank").alias("rank"))
        .groupBy("query_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug"))), lambda s: s["slug"]).alias("slugs"))
    )


def _joined_by_rank(text: Column, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def citation_list(hits: DataFrame) -> DataFrame:
    """``(query_id, citations)``: ``[n] Title (slug) — date — category  score=0.0000`` per hit."""
    def dashed(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(value != "", F.concat(F.lit(" — "), value)).otherwise("")

    sources = sources_of(hits)
    line = F.concat(
        F.format_string("[%d] ", "rank"),
        F.col("title"),
        F.lit(" ("),
        F.col("slug"),
        F.lit(")"),
        dashed("date"),
        dashed("category"),
        F.format_string("  score=%.4f", "score"),
    )
    return sources.groupBy("query_id").agg(_joined_by_rank(line, "\n").alias("citations"))


# The label of each line of a hit, by lane.
_LANES = {
    "news": ("Chunk", [("Title   : ", "title"), ("Date    : ", "date"), ("Category: ", "category"), ("Tags    : ", "tags")], "Text    :\n"),
    "knowledge": (
        "Knowledge",
        [("Title         : ", "title"), ("Knowledge type: ", "knowledge_type"), ("Section       : ", "section")],
        "Text          :\n",
    ),
    "editorial": ("Editorial", [("Title   : ", "title"), ("Section : ", "section")], "Text    :\n"),
}
# The title of each block of a context text.
_BLOCK_TITLES = {
    "entities": "DETECTED ENTITIES",
    "news": "NEWS / EVENT EVIDENCE",
    "knowledge": "INSTITUTIONAL KNOWLEDGE",
    "editorial": "EDITORIAL GUIDANCE",
    "graph": "KNOWLEDGE GRAPH CONTEXT",
}


def lane_blocks(hits: DataFrame) -> DataFrame:
    """``(query_id, lane, block)``: all hits of a lane as one text, best first.

    ``hits`` needs lane, rank, score, chunk_text, title, date, category, tags,
    knowledge_type and section; absent ones may be null.
    """
    def rendered(lane: str) -> Column:
        name, labelled, text_label = _LANES[lane]
        parts = [F.format_string(f"--- {name} %d (score=%.4f) ---", "rank", "score")]
        for label, column in labelled:
            value = F.array_join(column, ", ") if column == "tags" else F.col(column)
            value = F.substring(value, 1, 10) if column == "date" else value
            parts.append(F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value)))
        parts.append(F.concat(F.lit(text_label), strip(F.coalesce("chunk_text", F.lit("")))))
        parts.append(F.lit(""))
        return F.array_join(F.array_compact(F.array(*parts)), "\n")

    text = F.when(F.col("lane") == "news", rendered("news")).when(F.col("lane") == "knowledge", rendered("knowledge"))
    return hits.groupBy("query_id", "lane").agg(_joined_by_rank(text.otherwise(rendered("editorial")), "\n").alias("block"))


def entity_block(entities: DataFrame) -> DataFrame:
    """``(query_id, block)`` from ``(query_id, etype, name)``: one line per type that has names."""
    labels = {"organizations": "Organizations", "programs": "Programs", "credentials": "Credentials", "locations": "Locations", "people": "People"}
    lists = entities.groupBy("query_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("etype") == t, F.col("name")))).alias(t) for t in labels]
    )
    rows = [
        F.when(F.size(t) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(t, ", "))) for t, label in labels.items()
    ]
    return lists.select("query_id", F.array_join(F.array_compact(F.array(*rows)), "\n").alias("block"))


def context_pack(
    queries: DataFrame, lanes: DataFrame, graph: DataFrame, entities: DataFrame | None = None, *, max_output_tokens: int = 4096, window_tokens: int = 200_000
) -> DataFrame:
    """``(query_id, context, over_budget)``: entity names, lane blocks and graph profiles under their titles.

    ``lanes(query_id, lane, block)``, ``graph(query_id, pos, block)``, ``entities(query_id, block)``. About four
    characters make a token; the flag tells that input and output exceed the window.
    """
    profiles = graph.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda r: r["block"]), "\n\n").alias("block")
    )
    blocks = lanes.select("query_id", "lane", "block").unionByName(
        profiles.select("query_id", F.lit("graph").alias("lane"), "block")
    )
    if entities is not None:
        blocks = blocks.unionByName(entities.select("query_id", F.lit("entities").alias("lane"), "block"))
    per_lane = blocks.groupBy("query_id").agg(
        *[F.max(F.when(F.col("lane") == lane, F.col("block"))).alias(lane) for lane in _BLOCK_TITLES]
    )
    parts = [
        F.when(strip(F.coalesce(lane, F.lit(""))) != "", F.concat(F.lit(f"=== {title} ===\n\n"), F.col(lane)))
        for lane, title in _BLOCK_TITLES.items()
    ]
    body = F.concat_ws("\n\n", F.concat(F.lit("Topic: "), F.col("query")), *parts)
    packed = queries.select("query_id", "query").join(per_lane, "query_id", "left").select("query_id", body.alias("context"))
    estimate = F.floor(F.length("context") / 4) + max_output_tokens
    return packed.withColumn("over_budget", estimate > window_tokens)
