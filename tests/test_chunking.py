import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunking


def bounds(spark, tokens, limit=700, overlap=100):
    df = spark.createDataFrame([(tokens,)], "t array<int>")
    return [(b["first"], b["end"]) for b in df.select(chunking.pack_bounds(F.col("t"), limit, overlap).alias("b")).first()["b"]]


@pytest.mark.parametrize(
    "tokens, want",
    [
        ([300, 300, 200, 900, 10], [(0, 2), (2, 3), (3, 4), (4, 5)]),
        ([400, 60, 30, 300], [(0, 3), (1, 4)]),
        ([650, 90, 680], [(0, 1), (1, 2), (1, 3)]),
        ([], []),
        ([5000], [(0, 1)]),
    ],
)
def test_packing(spark, tokens, want):
    assert bounds(spark, tokens) == want


def slow_pack(tokens, limit, overlap):
    """Brute force over whole lists."""
    done, run = [], []
    for i, size in enumerate(tokens):
        if run and sum(tokens[j] for j in run) + size > limit:
            done.append((run[0], run[-1] + 1))
            tail = [k for k in range(len(run) + 1) if sum(tokens[j] for j in run[k:]) <= overlap][0]
            run = run[tail:]
        run = [*run, i]
    return done + ([(run[0], run[-1] + 1)] if run else [])


def test_packing_against_brute_force(spark):
    rng = random.Random(7)
    for _ in range(25):
        tokens = [rng.choice([1, 5, 20, 60, 90, 150]) for _ in range(rng.randrange(1, 40))]
        assert bounds(spark, tokens, 200, 100) == slow_pack(tokens, 200, 100), tokens


def test_chunks_number_paths_and_summary(spark):
    body = "before\n# A\ntext a\n### B\nb1\n\nb2\n## C\n# D\nlast"
    df = spark.createDataFrame([("s", "T", "S", body), ("u", "", " ", "only"), ("v", "V", "", "")], "slug string, title string, summary string, body string")
    rows = {r["chunk_id"]: r for r in chunking.make_chunks(df).collect()}
    assert [(r["heading_path"], r["chunk_text"]) for k, r in sorted(rows.items()) if k.startswith("s")] == [
        ("T", "T\n\nS"), ("T", "before"), ("A", "A\n\ntext a"), ("A / B", "B\n\nb1\n\nb2"), ("A / C", "C"), ("D", "D\n\nlast"),
    ]
    assert rows["u__000"]["chunk_type"] == "body" and rows["v__000"]["chunk_type"] == "summary"
    assert len([k for k in rows if k.startswith("v")]) == 1


def test_more_than_a_thousand_chunks(spark):
    body = "\n".join(f"# h{i}" for i in range(1005))
    df = spark.createDataFrame([("s", "T", "", body)], "slug string, title string, summary string, body string")
    ids = [r["chunk_id"] for r in chunking.make_chunks(df).orderBy("chunk_index").collect()]
    assert len(ids) == 1006 and ids[-1] == "s__1005" and ids[7] == "s__007"


def test_chunk_types(spark):
    df = spark.createDataFrame(
        [("summary", "x", "overview"), ("body", "FAQ / Glossary", "faq"), ("body", "Key Terms", "definition"), ("body", "Other", "section"), ("body", None, "section")],
        "t string, p string, want string",
    )
    for r in df.select("want", chunking.map_chunk_type(F.col("t"), F.col("p")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_stable_id_is_version_five(spark):
    names = ["a__000", "doc-1__012", "ü__001"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", chunking.stable_id(F.col("n")).alias("i"))
    for r in df.collect():
        assert r["i"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["n"]))


def test_chunking_shuffles_nothing(spark):
    df = spark.createDataFrame([("s", "T", "S", "b")], "slug string, title string, summary string, body string")
    plan = chunking.make_chunks(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not re.search(r"\bWindow\b", plan)
