import random
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import simhash
from tests.llm.helpers import frame, hard_texts


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {p: root(p) for p in distinct}


def test_fingerprints_and_groups_match_brute_force(spark):
    texts = hard_texts()
    docs = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_groups(prints)
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(roots[p], i)
    assert got == {i: (format(p, "016x"), first[roots[p]]) for i, p in enumerate(prints)}


def test_long_text_over_255_shingles():
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(3000))
    assert simhash.text_fingerprints(pa.array([text]))[0] == brute_print(text)


def test_masks_cover_every_close_pair():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            flipped = (1 << i) | (1 << j)
            assert any(not mask & flipped for mask in masks)


def test_crowded_cells_keep_components(spark):
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    prints = {c for c in centres}
    for c in centres:
        for _ in range(150):
            prints.add(c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    prints |= {rnd.getrandbits(64) for _ in range(50)}
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = brute_groups(prints)
    want = sorted(Counter(roots.values()).values())
    for limit in (2, 1000):
        comps = simhash.components(simhash.covering_links(nodes, pair_limit=limit))
        sizes = [r["count"] for r in comps.groupBy("root").count().collect()]
        assert sorted(sizes + [1] * (len(prints) - sum(sizes))) == want


def test_null_ids_empty_tables_and_one_per_group(spark):
    docs = frame(spark, [(None, "a b c d"), (7, "a b c d"), (3, "q r s t u v"), (3, "q r s t u v"), (None, None)])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.simhash_groups(docs).collect() if r["fingerprint"] != "0" * 16)
    assert got == [(False, 3, 3), (False, 3, 3), (False, 7, 7), (True, 0, 7)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["text"] or "") for r in kept.collect()) == [(False, "q r s t u v"), (True, ""), (True, "a b c d")]
    assert simhash.simhash_groups(docs.where(F.lit(False))).count() == 0
    assert simhash.keep_one(docs.where(F.lit(False))).count() == 0
