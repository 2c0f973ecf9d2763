import hashlib
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import index as ix, search


def test_fusion_of_recorded_ranks(spark):
    # (dense rank, sparse rank) from 1, and the score they give
    ranks = [(1, 1, 1.0), (2, 3, 0.583333), (10, 4, 0.290909), (7, 19, 0.175)]
    dense = spark.createDataFrame([(1, f"c{i}", a) for i, (a, _, _) in enumerate(ranks)], "query_id bigint, chunk_id string, rank int")
    sparse = spark.createDataFrame([(1, f"c{i}", b) for i, (_, b, _) in enumerate(ranks)], "query_id bigint, chunk_id string, rank int")
    got = {r["chunk_id"]: r["score"] for r in search.rrf_fuse([dense, sparse], 8).collect()}
    assert got == {f"c{i}": s for i, (_, _, s) in enumerate(ranks)}
    assert search.rrf_fuse([dense, sparse], 8, threshold=0.29).count() == 3
    assert search.rrf_fuse([dense, sparse], 2).count() == 2


def brute(scores, k):
    return [(c, s) for c, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_dense_against_brute_force(spark, monkeypatch, metric, block_bytes):
    monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(search, "_BUFFER", 20)
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, size=(300, 4)).astype(float)
    queries = rng.integers(-2, 3, size=(9, 4)).astype(float)
    index = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "chunk_id string, dense array<double>").repartition(5)
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id bigint, dense array<double>")
    got = {}
    for r in search.dense_topk(asked, index, 7, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    scores = search.similarity(queries, vectors, metric)
    for i in range(len(queries)):
        assert got[i] == brute({f"c{j:03d}": scores[i, j] for j in range(300)}, 7)


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_sparse_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(search, "QUERY_BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(search, "_BUFFER", 20)
    monkeypatch.setattr(search, "_MATCHES", 50)
    monkeypatch.setattr(search, "_MATRIX_CELLS", 200)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    texts = [(f"c{i:03d}", " ".join(rng.choice(words[: 1 + i % 25]) for _ in range(rng.randrange(0, 12)))) for i in range(200)]
    asked = [(i, " ".join(rng.sample(words, 4)) + " unknown") for i in range(12)]
    index = spark.createDataFrame(texts, "chunk_id string, t string").repartition(4).withColumn("sparse", ix.sparse_vector(ix.term_counts(F.col("t"))))
    weights = {r["chunk_id"]: {s["term"]: s["w"] for s in r["sparse"]} for r in index.collect()}
    got = {}
    for r in search.sparse_topk(spark.createDataFrame(asked, "query_id bigint, query string"), index, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
    for i, q in asked:
        scores = {c: round(sum(w.get(t, 0) for t in set(q.split())), 6) for c, w in weights.items()}
        assert got.get(i, []) == brute({c: s for c, s in scores.items() if s > 0}, 6)


def test_work_per_hit_does_not_grow_with_the_queries():
    rng = np.random.default_rng(2)
    seconds = {}
    for n in (500, 5000):
        queries = rng.normal(size=(n, 16))
        best = search._Best(np.arange(n), 24)
        start = time.process_time()
        for i in range(40_000_000 // n // 500):
            vectors = rng.normal(size=(500, 16))
            best.add_matrix(pa.array([f"c{i}-{j}" for j in range(500)]), search.similarity(queries, vectors, "dot"))
        list(best.batches())
        seconds[n] = time.process_time() - start
    # As many pairs either way.
    assert seconds[5000] < 3 * seconds[500] + 1


def test_term_counts_and_weights(spark):
    df = spark.createDataFrame([("B a b. A, b",), ("",)], "t string").select(ix.term_counts(F.col("t")).alias("c"))
    df = df.select("c", ix.sparse_vector(F.col("c")).alias("s"), ix.hashed_vector(F.col("c")).alias("v"))
    full, empty = df.collect()
    assert [(c["term"], c["tf"]) for c in full["c"]] == [("a", 2), ("b", 3)]
    norm = 1.2 * (0.25 + 0.75 * 5 / 256)
    assert full["s"][0]["w"] == pytest.approx(2 * 2.2 / (2 + norm))
    assert np.linalg.norm(full["v"]) == pytest.approx(1) and len(full["v"]) == ix.DENSE_DIM
    assert empty["s"] == [] and set(empty["v"]) == {0.0}


def test_stop_words(spark):
    df = spark.createDataFrame([("the a the b",)], "t string").select(ix.term_counts(F.col("t"), ["the"]).alias("c"))
    assert [c["term"] for c in df.first()["c"]] == ["a", "b"]


def test_hashed_vectors(spark):
    words = [f"w{i}" for i in range(200)]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate((1, 2, 40, 400))] + [(8, ""), (9, None)]
    got = ix.add_hashed_vectors(spark.createDataFrame(rows, "id int, text string"), "text").collect()
    for row in got:
        sums = [0.0] * ix.DENSE_DIM
        for word in (row["text"] or "").split():
            sums[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % ix.DENSE_DIM] += 1
        norm = sum(v * v for v in sums) ** 0.5
        assert row["dense"] == pytest.approx([v / norm if norm else 0.0 for v in sums], abs=1e-6)
    assert len(got) == 6


def test_memory_of_a_worker_does_not_follow_the_matches():
    # 10 million matches of 100 terms, each in 50 queries.
    words = [f"t{i}" for i in range(100)]
    part = pa.RecordBatch.from_arrays(
        [pa.array([f"c{i}" for i in range(2000)]), pa.array([words] * 2000), pa.array([[1.0] * 100] * 2000)], names=["chunk_id", "terms", "weights"]
    )
    known, starts, members = pa.array(words), np.arange(101) * 50, np.tile(np.arange(50), 100)
    tracemalloc.start()
    query, chunk, sums = search._added_weights(part, known, starts, members)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(query) == len(chunk) == 100_000 and set(sums) == {100.0}
    assert peak < 128 * 1024 * 1024


def test_vectors_of_a_batch_equal_those_of_expressions(spark):
    """Chunks get the same vectors to the last bit, in batches without calls per word or conversions of hashes."""
    texts = ["the cat, the CAT and Ünïcode_1", "", "...", None, "ß ſtraße 日本 日本 á", "x " * 400 + "y", "z퟿ \U0001f600 \U00010400a ￮a"]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, chunk_text string")
    for stops in (None, ["the", "x"]):
        counts = ix.term_counts(F.col("chunk_text"), stops)
        want = chunks.select("chunk_id", ix.sparse_vector(counts).alias("sparse"), ix.hashed_vector(counts).alias("dense"))
        made = ix.with_vectors(chunks, stop_words=stops)
        assert "conv(" not in made._jdf.queryExecution().optimizedPlan().toString()
        got = made.select("chunk_id", "sparse", "dense")
        assert got.schema["dense"].dataType == want.schema["dense"].dataType
        rows = lambda df: {r["chunk_id"]: (r["sparse"], r["dense"]) for r in df.collect()}
        assert rows(got) == rows(want)
    assert ix.with_vectors(chunks.limit(0)).count() == 0


def test_weights_are_added_without_sorting(monkeypatch):
    ids, vocabulary, starts, members = search._inverted(np.array([5, 5, 9]), np.array(["a", "b", "b"]))
    part = pa.RecordBatch.from_arrays([pa.array(["x", "y"]), pa.array([["a", "b"], ["b", "z"]]), pa.array([[0.5, 0.25], [1.0, 2.0]])], names=["chunk_id", "terms", "weights"])

    def sorts(*args, **how):
        raise AssertionError("pairs are sorted")

    monkeypatch.setattr(np, "unique", sorts)
    for matches in (1_000_000, 1):
        monkeypatch.setattr(search, "_MATCHES", matches)
        query, chunk, sums = search._added_weights(part, pa.array(vocabulary), starts, members)
        assert list(zip(ids[query].tolist(), chunk.tolist(), sums.tolist())) == [(5, 0, 0.75), (5, 1, 1.0), (9, 0, 0.25), (9, 1, 1.0)]
