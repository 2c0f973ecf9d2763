from pyspark.sql import functions as F

from scriptorium.operators import classify
from scriptorium.operators.tagging import CLASSIFIER_TYPES
from workloads import fixtures as fx


def documents(spark, *rows):
    schema = "slug string, " + ", ".join(f"e_{t} array<string>" for t in CLASSIFIER_TYPES)
    return spark.createDataFrame([tuple([str(i)] + [r.get(t, []) for t in CLASSIFIER_TYPES]) for i, r in enumerate(rows)], schema)


def scores(spark, row):
    rules = fx.classification_rules(spark)
    df = classify.apply_tie_breakers(classify.score_categories(documents(spark, row), rules), rules)
    return {s["category"]: s["score"] for s in df.first()["scores"]}


def test_leader_is_lifted_by_one_more(spark):
    assert scores(spark, {"activities": ["Graduation"]})["Events & Ceremonies"] == 46
    many = {"activities": ["Graduation"], "programs": ["In Course", "To Program"]}
    assert scores(spark, many) == {**scores(spark, many), "Training Programs": 75, "Events & Ceremonies": 76}


def test_later_tie_breaker_beats_earlier(spark):
    got = scores(spark, {"activities": ["Graduation", "Agreement"], "organizations": ["A", "B"]})
    assert got["Partnerships & Agreements"] > got["Events & Ceremonies"] > 45


def test_media_coverage_suppresses_graduation(spark):
    got = scores(spark, {"activities": ["Graduation", "Media Coverage"]})
    assert got["Events & Ceremonies"] == 40


def test_pattern_of_types_and_names(spark):
    got = scores(spark, {"activities": ["Agreement"], "organizations": ["X"]})
    assert got["Partnerships & Agreements"] == 40 + 35


def pick(spark, row, keywords):
    rules = fx.classification_rules(spark)
    df = classify.score_categories(documents(spark, row), rules).withColumn("keyword_hits", F.array(*[F.lit(k) for k in keywords]).cast("array<string>"))
    return classify.pick_category(df, rules).select("category", "source", "used_fallback").first()


def test_keywords_only_without_any_entity_score(spark):
    assert tuple(pick(spark, {}, ["Media", "Training Programs"])) == ("Training Programs", "keyword_fallback", True)
    assert tuple(pick(spark, {"locations": ["X"]}, ["Media"])) == ("Community Outreach", "entity_match", False)
    assert tuple(pick(spark, {}, [])) == ("General", "default", False)


def test_earlier_category_wins_ties(spark):
    row = {"programs": ["In Course"], "locations": []}
    assert pick(spark, row, [])["category"] == "Training Programs"
    tie = {"organizations": ["The Works"], "people": ["P"]}
    assert pick(spark, tie, [])["category"] == "Partnerships & Agreements"
