"""Search results and routes against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def eval_slugs(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """``cases(query_id, expected_slug_contains, min_results)``: enough hits, and a slug that matches."""
    found = cases.select("query_id", "expected_slug_contains").join(hits.select("query_id", "slug"), "query_id").groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.bool_or(F.regexp_like("slug", F.concat(F.lit("(?i)"), F.col("expected_slug_contains")))).alias("matched"),
    )
    return _judged(cases, found, F.coalesce("expected_slug_contains", F.lit("")) == "")


def eval_text(hits: DataFrame, cases: DataFrame, top: int = 5) -> DataFrame:
    """``cases(query_id, expected_text_contains, min_results)``: the pattern in the texts and titles of the best hits, joined by rank."""
    text = F.concat_ws(" ", F.coalesce("chunk_text", F.lit("")), F.coalesce("title", F.lit("")))
    # At most ``top`` texts per query.
    joined = hits.where(F.col("rank") <= top).groupBy("query_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", F.lower(text).alias("t")))).alias("ts")
    )
    all_texts = F.array_join(F.transform("ts", lambda r: r["t"]), " ")
    found = cases.select("query_id", F.lower("expected_text_contains").alias("p")).join(joined, "query_id").select(
        "query_id", "n", all_texts.contains(F.col("p")).alias("matched")
    )
    return _judged(cases, found, F.coalesce("expected_text_contains", F.lit("")) == "")


def _judged(cases: DataFrame, found: DataFrame, no_pattern) -> DataFrame:
    enough = F.coalesce("n", F.lit(0)) >= F.col("min_results")
    passed = enough & (no_pattern | F.coalesce("matched", F.lit(False)))
    return cases.join(found, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).alias("n_results"), F.coalesce("matched", F.lit(False)).alias("matched"), passed.alias("passed")
    )


def eval_routes(routes: DataFrame, cases: DataFrame) -> DataFrame:
    return cases.select("query_id", "expected_route").join(routes.select("query_id", "route"), "query_id", "left").select(
        "query_id", "route", "expected_route", F.col("route").eqNullSafe(F.col("expected_route")).alias("passed")
    )


def eval_dual(news_hits: DataFrame, knowledge_hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Minimum hits per collection, and how many chunks both returned."""
    news = news_hits.groupBy("query_id").agg(F.count("*").alias("n_news"))
    knowledge = knowledge_hits.groupBy("query_id").agg(F.count("*").alias("n_knowledge"))
    shared = (
        news_hits.select("query_id", "chunk_id").distinct()
        .join(knowledge_hits.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"])
        .groupBy("query_id").agg(F.count("*").alias("n_shared"))
    )
    joined = cases.join(news, "query_id", "left").join(knowledge, "query_id", "left").join(shared, "query_id", "left")
    counted = joined.fillna(0, ["n_news", "n_knowledge", "n_shared"])
    passed = (F.col("n_news") >= F.col("expect_news_min")) & (F.col("n_knowledge") >= F.col("expect_know_min"))
    return counted.select("query_id", "n_news", "n_knowledge", "n_shared", passed.alias("passed"))


def pass_rate(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
