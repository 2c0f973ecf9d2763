import pytest

from scriptorium.functions.fixed_values import route_signals
from scriptorium.operators import evaluate, routing

# (query, intent, expected route)
CASES = [
    ("What is Acme?", None, "knowledge"),
    ("Acme mission and vision", None, "knowledge"),
    ("Acme accreditation certifications", None, "knowledge"),
    ("What short courses does Acme offer?", None, "knowledge"),
    ("Acme campus and facilities", None, "knowledge"),
    ("fire safety training drill", None, "news"),
    ("graduation ceremony female trainees", None, "news"),
    ("Samsung partnership agreement", None, "news"),
    ("Write an article about Acme and Sinopec", None, "both"),
    ("Draft LinkedIn post about female graduation", None, "both"),
    ("Generate article about Acme training methodology", None, "both"),
    ("What is Acme? Draft article about accreditation", None, "both"),
    ("graduation ceremony", "knowledge", "knowledge"),
    ("Acme overview", "news", "news"),
    ("when to postpone", None, "both"),
    ("isolated", None, "knowledge"),
    ("hello", None, "both"),
]


@pytest.mark.parametrize("max_inline", [1000, 0])
def test_routes(spark, max_inline):
    queries = spark.createDataFrame([(i, q, n) for i, (q, n, _) in enumerate(CASES)], "query_id int, query string, intent string")
    signals = spark.createDataFrame(route_signals("Acme"), "kind string, phrase string")
    cases = spark.createDataFrame([(i, w) for i, (_, _, w) in enumerate(CASES)], "query_id int, expected_route string")
    judged = evaluate.eval_routes(routing.route_queries(queries, signals, max_inline=max_inline), cases)
    assert judged.where("NOT passed").collect() == []


def test_effective_route(spark):
    df = spark.createDataFrame([("news",), ("knowledge",), ("both",)], "route string")
    assert [r[0] for r in df.select(routing.effective_route(df["route"], True)).collect()] == ["both", "knowledge", "both"]
    assert [r[0] for r in df.select(routing.effective_route(df["route"], False)).collect()] == ["news"] * 3
