"""Which collections a query needs, and one search per lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions.matching import inline_substrings, joined_hits, text_key
from scriptorium.functions.rules import MAX_INLINE_RULES, fits_inline, inline_array
from scriptorium.operators.search import DEFAULT_LIMIT, hybrid_search
from scriptorium.operators.validate import payload_filter

_KINDS = ("draft", "news", "knowledge")


def signal_counts(queries: DataFrame, signals: DataFrame, max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """Add ``draft``, ``news`` and ``knowledge``: how many phrases of each kind a query contains."""
    signals = signals.select("kind", "phrase").where("phrase <> ''").distinct()
    if fits_inline(signals, max_inline):
        literal = inline_array(signals.withColumn("t", F.lower("phrase")), "kind", "t")
        hits = queries.withColumn("__kinds", F.transform(inline_substrings(F.col("query"), literal), lambda h: h["kind"]))
    else:
        # Matches come back by text, so queries may share an id or have none.
        keyed = queries.withColumn("__key", text_key(F.col("query")))
        pairs = joined_hits(keyed, ["__key"], "query", signals, ["kind", "phrase"], "phrase", mode="substring")
        found = pairs.groupBy("__key").agg(F.collect_list("kind").alias("__kinds"))
        hits = (
            keyed.join(found, "__key", "left")
            .withColumn("__kinds", F.coalesce("__kinds", F.array().cast("array<string>")))
            .drop("__key")
        )
    return hits.withColumns(
        {kind: F.size(F.filter("__kinds", lambda k: k == kind)) for kind in _KINDS}
    ).drop("__kinds")


def route_queries(queries: DataFrame, signals: DataFrame, **how: int) -> DataFrame:
    """Add ``route`` (news, knowledge or both) and ``reasoning``.

    ``queries(query_id, query, intent)``: an intent of news, knowledge or both decides.
    """
    draft, news, knowledge = (F.col(k) for k in _KINDS)
    explicit = F.col("intent").isin("news", "knowledge", "both")
    route = (
        F.when(explicit, F.col("intent"))
        .when(draft > 0, "both")
        .when((news > 0) & (knowledge > 0), "both")
        .when(knowledge > news, "knowledge")
        .when(news > 0, "news")
        .otherwise("both")
    )
    reasoning = (
        F.when(explicit, F.format_string("Explicit intent override: %s", "intent"))
        .when(
            draft > 0,
            F.format_string("Drafting/authoring task detected (draft=%d, news=%d, knowledge=%d)", draft, news, knowledge),
        )
        .when(
            (news > 0) & (knowledge > 0),
            F.format_string("Mixed signals — querying both collections (news=%d, knowledge=%d)", news, knowledge),
        )
        .when(knowledge > news, F.format_string("Institutional knowledge query (knowledge=%d, news=%d)", knowledge, news))
        .when(news > 0, F.format_string("News/event query (news=%d, knowledge=%d)", news, knowledge))
        .otherwise("No strong signal — defaulting to both collections")
    )
    return signal_counts(queries, signals, **how).withColumn("route", route).withColumn("reasoning", reasoning)


def effective_route(route: Column, use_knowledge: bool) -> Column:
    """Without knowledge everything is news; with it, news is widened to both."""
    if not use_knowledge:
        return F.lit("news")
    return F.when(route == "news", "both").otherwise(route)


def lane_retrieve(
    routed: DataFrame,
    news_index: DataFrame,
    knowledge_index: DataFrame,
    *,
    limit: int = DEFAULT_LIMIT,
    threshold: float = 0.0,
    use_knowledge: bool = True,
    filters: dict[str, object] | None = None,
) -> DataFrame:
    """``(query_id, lane, chunk_id, score, rank)`` for ``routed(query_id, query, dense, route)``.

    Lanes: news (live posts), knowledge (half as many), editorial (two guideline
    chunks where both collections are asked, without a threshold).
    """
    filters = filters or {}
    routed = routed.withColumn("effective", effective_route(F.col("route"), use_knowledge))
    knowledge_limit = max(3, limit // 2)

    def lane(name: str, queries: DataFrame, index: DataFrame, n: int, candidates: int, floor: float, where: Column) -> DataFrame:
        hits = hybrid_search(queries, index, limit=n, candidates=candidates, threshold=floor, where=where)
        return hits.withColumn("lane", F.lit(name))

    # What the news lane may show, and the type of guideline documents.
    news_filter = payload_filter(
        **{k: filters[k] for k in ("category", "year", "quarter") if k in filters},
        published=True, status="approved", language="en", visibility="public",
    )
    lanes = [lane("news", routed.where("effective IN ('news', 'both')"), news_index, limit, limit * 3, threshold, news_filter)]
    if use_knowledge:
        by_type = payload_filter(knowledge_type=filters.get("knowledge_type"))
        guidelines = payload_filter(knowledge_type="editorial_guidelines")
        wanted = routed.where("effective IN ('knowledge', 'both')")
        lanes.append(lane("knowledge", wanted, knowledge_index, knowledge_limit, knowledge_limit * 3, threshold, by_type))
        lanes.append(lane("editorial", routed.where("effective = 'both'"), knowledge_index, 2, 8, 0.0, guidelines))
    out = lanes[0]
    for more in lanes[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "lane", "chunk_id", "score", "rank")
