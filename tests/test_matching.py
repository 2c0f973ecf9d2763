import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import matching
from scriptorium.functions.matching import inline_hits, inline_substrings, joined_hits, prepare_terms
from scriptorium.functions.rules import inline_array
from scriptorium.operators import graph

TERMS = ["a", "ab", "b.", ".b", "a b", "ab, ba", "b b", "..", " a ", "ba-ab b", "ü", "aü"]


def texts(n=120):
    rng = random.Random(3)
    return [(i, "".join(rng.choice("ab  .,-ü\n") for _ in range(rng.randrange(0, 40)))) for i in range(n)]


def expected(mode):
    out = set()
    for i, text in texts():
        for term in TERMS:
            whole = re.search(rf"(?<!\w){re.escape(term)}(?!\w)", text.lower()) is not None
            inside = term in text.lower()
            single = re.fullmatch(r"\w+", term) is not None
            hit = {"substring": inside, "bounded": whole, "dictionary": whole if single else inside}[mode]
            if hit:
                out.add((i, term))
    return out


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(texts(), "id int, text string"), spark.createDataFrame([(t,) for t in TERMS], "term string")


@pytest.mark.parametrize("mode", ["substring", "dictionary", "bounded"])
def test_joined(frames, mode):
    docs, terms = frames
    got = joined_hits(docs, ["id"], "text", terms, ["term"], "term", mode=mode).collect()
    assert len(got) == len(set(got)) and {(r["id"], r["term"]) for r in got} == expected(mode)


@pytest.mark.parametrize("mode", ["substring", "dictionary", "bounded"])
def test_inline(frames, mode):
    docs, terms = frames
    literal = inline_array(prepare_terms(terms, "term"), "term", "t", "word", "pattern")
    hits = inline_substrings(F.col("text"), literal) if mode == "substring" else inline_hits(F.col("text"), literal, bounded=mode == "bounded")
    got = docs.select("id", F.explode(F.transform(hits, lambda h: h["term"])).alias("term")).collect()
    assert {(r["id"], r["term"]) for r in got} == expected(mode)


def test_names_that_share_most_of_their_text_have_keys_of_their_own(spark):
    names = [f"Supplier#{i:09}" for i in range(1, 401)] + [f"Customer#{i:09}" for i in range(1, 401)]
    docs = spark.createDataFrame([(i, f"The supplier supplier#{i % 400 + 1:09}, not Customer#{i % 77 + 1:09}x.") for i in range(300)], "id int, text string")
    terms = spark.createDataFrame([(n,) for n in names], "term string")
    lowered = terms.select(F.lower("term").alias("__t"))
    keys = matching.rarest_keys(docs, "text", lowered, True)
    largest = keys.groupBy("__kind", "__g", "__gram").count().agg(F.max("count")).first()[0]
    assert keys.count() == 800 and largest <= 2
    # What the join compares before it verifies.
    windows = matching._cut_windows(docs, ["id"], "text", matching._shapes(keys), 3)
    compared = windows.join(keys, ["__kind", "__g", "__gram"]).count()
    hits = {m: joined_hits(docs, ["id"], "text", terms, ["term"], "term", mode=m).collect() for m in ("dictionary", "bounded")}
    assert len(hits["dictionary"]) == 600 and len(hits["bounded"]) == 300 and compared <= 2 * 600


def test_keys_avoid_what_texts_are_full_of(spark):
    docs = spark.createDataFrame([(i, "the end, the end " * 5 + f"z{i}") for i in range(400)], "id int, text string")
    terms = spark.createDataFrame([("the#q",), ("the end",)], "term string")
    keys = {r["__t"]: r["__gram"] for r in matching.rarest_keys(docs, "text", terms.withColumnRenamed("term", "__t"), True).collect()}
    assert "#" in keys["the#q"]


def test_no_terms_and_repeated_terms(spark, frames):
    docs, terms = frames
    assert joined_hits(docs, ["id"], "text", terms.where("false"), ["term"], "term", mode="bounded").count() == 0
    double = spark.createDataFrame([(1, "ab"), (2, "AB"), (3, "a b"), (4, "")], "k int, term string")
    got = {(r["id"], r["k"]) for r in joined_hits(docs, ["id"], "text", double, ["k"], "term", mode="substring").collect()}
    assert got == {(i, k) for i, t in texts() for k, term in ((1, "ab"), (2, "ab"), (3, "a b")) if term in t.lower()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_control_characters_are_characters(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(matching, "MAX_BROADCAST_TERMS", 0)
    docs = spark.createDataFrame([(1, "one\u0001two"), (2, "one two"), (3, "x one\u0001two x")], "id int, text string")
    terms = spark.createDataFrame([("one two",), ("e\u0001t",)], "term string")
    got = {m: {tuple(r) for r in joined_hits(docs, ["id"], "text", terms, ["term"], "term", mode=m).collect()} for m in ("substring", "bounded")}
    assert got == {"substring": {(1, "e\u0001t"), (2, "one two"), (3, "e\u0001t")}, "bounded": {(2, "one two")}}


def test_no_lambda_runs_on_a_place(spark, frames, capsys):
    docs, terms = frames
    for mode in ("substring", "dictionary", "bounded"):
        joined_hits(docs, ["id"], "text", terms, ["term"], "term", mode=mode).explain(True)
    assert "lambda" not in capsys.readouterr().out


@pytest.mark.parametrize("mode", ["substring", "dictionary", "bounded"])
def test_sorted_terms_find_the_same(frames, monkeypatch, mode):
    monkeypatch.setattr(matching, "MAX_BROADCAST_TERMS", 0)
    docs, terms = frames
    got = joined_hits(docs, ["id"], "text", terms, ["term"], "term", mode=mode).collect()
    assert len(got) == len(set(got)) and {(r["id"], r["term"]) for r in got} == expected(mode)


def test_entity_search_runs_no_lambda_on_a_place(spark, capsys):
    nodes = spark.createDataFrame([("a", "Red Widget", None, "A part.", ["x"], "part"), ("b", "Blue", None, "", [], "part")], "id string, name string, short_name string, description string, aliases array<string>, type string")
    found = graph.search_entities(spark.createDataFrame([("WIDGET a",), ("blu",)], "query string"), nodes)
    found.explain(True)
    assert "lambda" not in capsys.readouterr().out and {tuple(r) for r in found.collect()} == {("WIDGET a", "a"), ("blu", "b")}


def test_few_searches_ride_in_the_plan(spark, capsys):
    rows = [(f"n{i}", f"Part {i % 7} \"red\"", None, "Ünder a Σ.", ["x", None]) for i in range(40)] + [("n1", "Part 1", None, "", [])]
    nodes = spark.createDataFrame(rows, "id string, name string, short_name string, description string, aliases array<string>").withColumn("type", F.lit("part"))
    searches = spark.createDataFrame([("PART 3",), ("Part 3",), ('"RED"',), ("ü",), ("σ",), ("",), (None,), ("none",)], "query string")
    few = graph.search_entities(searches, nodes)
    capsys.readouterr()
    few.explain()
    # One exchange for distinct hits; no place of a text is a row, nothing is joined.
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = sorted(tuple(r) for r in few.collect())
    assert got and got == sorted(tuple(r) for r in graph.search_entities(searches, nodes, max_inline=1).collect())
