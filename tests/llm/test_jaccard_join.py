import random
import re

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import jaccard_join
from tests.llm.helpers import frame, hard_texts, words


def shingles(text, width=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1)))


def brute(rows, percent=85, width=4):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edited(rnd, text, edits, vocabulary):
    own = text.split()
    for _ in range(edits):
        own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
    return " ".join(own)


def near_copies(seed=4):
    """Groups around originals with edits on both sides of the threshold, chains, and passages that all share."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = words(rnd, 40, vocabulary)
    texts = []
    for size in (12, 40, 90, 160):
        base = words(rnd, size, vocabulary)
        texts += [base] + [edited(rnd, base, rnd.randint(0, 1 + size // 25), vocabulary) for _ in range(25)]
        chain = words(rnd, size, vocabulary)
        for _ in range(8):
            chain = edited(rnd, chain, max(1, size // 60), vocabulary)
            texts.append(chain)
    # Mostly one passage, which alone does not make them similar enough, or just does.
    texts += [line + " " + words(rnd, n, vocabulary) for n in range(14) for _ in range(3)]
    texts += [words(rnd, n, vocabulary) for n in (1, 2, 3, 4, 5)] * 2
    return texts


def test_near_copies_match_brute_force(spark):
    rows = list(enumerate(near_copies()))
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(want) - 60
    # Many buckets and blocks; the registered query is compared with SQL at the usual sizes.
    assert result(jaccard_join.jaccard_groups(frame(spark, rows), bucket=300, block=200)) == want


def test_another_threshold_and_hard_texts(spark):
    rows = list(enumerate(near_copies(7) + hard_texts()))
    assert result(jaccard_join.jaccard_groups(frame(spark, rows), 50, 2, block=2000)) == brute(rows, 50, 2)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e"), (7, "A  B\tc d e"), (3, "q r"), (3, "q r"), (None, None), (9, ""), (4, " \n"), (None, "lone one")]
    assert result(jaccard_join.jaccard_groups(frame(spark, rows))) == brute(rows)
    assert result(jaccard_join.jaccard_groups(frame(spark, rows).where(F.lit(False)))) == []


def test_very_long_texts(spark):
    rnd = random.Random(2)
    long = " ".join(f"x{rnd.randrange(10**6)}" for _ in range(900_000))
    rows = [(1, long), (2, long + " and more"), (3, long[: len(long) // 2])]
    got = result(jaccard_join.jaccard_groups(frame(spark, rows, clashes=False)))
    assert [(d, c) for d, _, c in got] == [(1, 1), (2, 1), (3, 3)] and got[1][1] == got[0][1] + 2


def test_search_finds_what_intersections_find():
    rnd = random.Random(6)
    for _ in range(40):
        n = rnd.randint(2, 30)
        core = rnd.sample(range(300), 60)
        sets = [sorted({*rnd.sample(core, rnd.randint(40, 60)), *rnd.sample(range(300), rnd.randint(0, 12))}) for _ in range(n)]
        percent = rnd.choice([30, 60, 85])
        postings = [[d for d, s in enumerate(sets) if t in s] for t in range(300)]
        begin = np.concatenate(([0], np.cumsum([len(p) for p in postings])))
        index = begin, np.array([d for p in postings for d in p])
        sizes = np.array([len(s) + rnd.randint(0, 3) for s in sets])
        for q in range(n):
            got = jaccard_join.t_occurrence(q, [np.array(s) for s in sets], index, sizes, percent).tolist()
            both = [len({*sets[q]} & {*s}) for s in sets]
            want = [d for d in range(n) if d != q and 100 * both[d] >= percent * (sizes[q] + sizes[d] - both[d]) and 100 * min(sizes[q], sizes[d]) >= percent * max(sizes[q], sizes[d])]
            assert got == want


def test_only_texts_that_passed_are_shuffled(spark):
    """All texts that passed are offered to the join, and hardly any other, copies and empty tables included."""
    rows = [(i, f"text {i} of many") for i in range(4000)] + [(4000 + i, f"text {i} of many") for i in range(0, 100, 10)]
    texts = frame(spark, rows).select("text")
    hashes = texts.select(F.xxhash64("text").alias("text_hash"), "text").distinct()
    wanted = {f"text {i} of many" for i in range(0, 1000, 10)}
    passed = hashes.where(F.col("text").isin(wanted)).select("text_hash")
    got = [r["text"] for r in jaccard_join.offered(texts, passed).collect()]
    assert sorted(t for t in got if t in wanted) == sorted(t for _, t in rows if t in wanted)
    assert sum(t not in wanted for t in got) < 400
    assert jaccard_join.offered(texts, passed.limit(0)).count() == 0
    assert jaccard_join.offered(texts.limit(0), passed).count() == 0
