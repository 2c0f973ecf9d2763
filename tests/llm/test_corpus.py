"""Decontamination, mixing, fingerprints and the pipeline."""

import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import decontamination, fingerprints, mixing, quality, suffix_dedup
from tests.llm.helpers import frame, hard_texts, words
from tests.llm.test_simhash import brute_groups, brute_print
from tests.llm.test_suffix_dedup import removed_mask

VOCABULARY = [a + b for a in "bcdfghklm" for b in "aeiou"]


# --- decontamination -------------------------------------------------------------

def test_masks_find_two_substitutions_in_thirteen_tokens():
    for errors in itertools.combinations(range(13), 2):
        assert any(not {start + o for o in mask} & set(errors) for mask in decontamination.MASKS for start in range(13 - mask[-1]))


def patterns(size, need):
    """The places of substitutions in all stretches of ``size`` tokens with equal ends that qualify with ``need`` matches."""
    most = min(size - need, math.floor(size / 5))
    return [set(c) for n in range(most + 1) for c in itertools.combinations(range(1, size - 1), n)]


def seeded(size, errors, masks):
    return any(not {start + o for o in mask} & errors for mask in masks for start in range(size - mask[-1]))


def test_every_qualifying_pattern_has_a_seed():
    lost = [(size, e) for size in range(11, 22) for e in patterns(size, max(11, math.ceil(size * 4 / 5))) if not seeded(size, e, decontamination.MASKS)]
    for item in range(5, 13):
        need = max(5, math.ceil(item * 4 / 5))
        assert need == decontamination._needed(item)
        lost += [
            (size, e) for size in range(need, item + 1) for e in patterns(size, max(need, math.ceil(size * 4 / 5)))
            if not seeded(size, e, decontamination.SHORT_MASKS)
        ]
    assert not lost


def test_no_length_escapes_the_masks():
    # Best sum of +1 per match and -4 per substitution on the way to every state (the last tokens,
    # matches so far) without a seed; a stretch qualifies if its sum is not negative.
    span = max(mask[-1] for mask in decontamination.MASKS)
    states = np.arange(1 << span)
    best = np.full((1 << span, 12), -(10**9))
    best[0, 0] = 0
    masks = [sum(1 << (mask[-1] - o) for o in mask) for mask in decontamination.MASKS]
    for _ in range(500):
        new = best.copy()
        for bit, gain in ((0, -4), (1, 1)):
            word = states << 1 | bit
            free = ~np.any([(word & m) == m for m in masks], axis=0)
            to, moved = word[free] & ((1 << span) - 1), best[free] + gain
            if bit:
                last = np.maximum(moved[:, 10], moved[:, 11])
                moved = np.concatenate((np.full((len(moved), 1), -(10**9)), moved[:, :10], last[:, None]), axis=1)
            np.maximum.at(new, to, moved)
        if (new == best).all():
            break
        best = new
    else:
        raise AssertionError("sums grow without end")
    assert best[:, 11].max() < 0


def test_overlaps_match_brute_force_alignment(spark):
    rnd = random.Random(11)
    items = [words(rnd, rnd.choice([5, 6, 7, 8, 10, 12, 13, 15, 18, 21, 30]), VOCABULARY) for _ in range(60)]
    # Three substitutions in 15 tokens, one in the middle of six.
    items += [words(rnd, 15, VOCABULARY), words(rnd, 6, VOCABULARY)]
    planted = [items[60].split(), items[61].split()]
    for k in (7, 8, 12):
        planted[0][k] = "other"
    planted[1][3] = "other"
    docs = [words(rnd, 8, VOCABULARY) + " " + " ".join(p) + " " + words(rnd, 8, VOCABULARY) for p in planted]
    for _ in range(400):
        own = rnd.choice(items).split()
        own = [rnd.choice(VOCABULARY) if rnd.random() < 0.2 else w for w in own]
        docs.append(words(rnd, rnd.randrange(5), VOCABULARY) + " " + " ".join(own) + " " + words(rnd, rnd.randrange(5), VOCABULARY))

    def overlaps(text, item):
        need = max(5, math.ceil(min(13, len(item)) * 4 / 5))
        for shift in range(-len(item) + 1, len(text)):
            equal = [0 <= shift + k < len(text) and text[shift + k] == w for k, w in enumerate(item)]
            inside = [k for k in range(len(item)) if 0 <= shift + k < len(text)]
            for a in inside:
                for b in range(a + need, inside[-1] + 2):
                    if sum(equal[a:b]) >= need and 5 * sum(equal[a:b]) >= 4 * (b - a):
                        return True
        return False

    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if overlaps(d.split(), t.split())}
    assert {(0, 60), (1, 61)} <= want
    found = decontamination.find_overlaps(frame(spark, list(enumerate(docs))), spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_finds_planted_overlaps_and_nothing_else(spark):
    rnd = random.Random(3)
    items = [words(rnd, n, VOCABULARY) for n in (40, 13, 20, 7, 5, 30, 30)] + ["", None, "one two", words(rnd, 3, VOCABULARY)]
    docs, want = [], set()
    for i in range(120):
        text, item = words(rnd, 80, VOCABULARY), rnd.randrange(7)
        kind = i % 5
        own = items[item].split()
        if kind == 1:
            text += " " + items[item].upper().replace(" ", ", ") + "! " + words(rnd, 20, VOCABULARY)
        if kind == 2 and len(own) >= 13:
            for _ in range(2):
                own[rnd.randrange(13)] = "other"
            text = " ".join(own[:13]) + " " + text
        if kind == 3 and len(own) >= 30:
            text += " " + " ".join(own[10:26])
        if kind == 1 or kind == 2 and len(own) >= 13 or kind == 3 and len(own) >= 30:
            want.add((i, item))
        docs.append((i, text))
    docs += [(1000 + i, t) for i, t in enumerate(hard_texts())] + [(None, items[0])]
    frame_ = frame(spark, docs)
    benchmark = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id long, text string")
    found = decontamination.find_overlaps(frame_, benchmark).collect()
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["item_id"]) for r in found) == sorted(want | {(-1, 0)})
    assert all(r["similarity"] >= 0.8 and r["matched"] >= 5 and r["last_token"] - r["first_token"] + 1 == r["overlap"] for r in found)
    clean = decontamination.drop_contaminated(frame_, benchmark)
    assert clean.columns == frame_.columns and clean.count() == len(docs) - len({i for i, _ in want}) - 1


def test_full_bitmaps_and_short_pieces_change_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    items = [words(rnd, n, VOCABULARY) for n in (40, 13, 20, 7, 300)]
    docs = [(i, words(rnd, 40, VOCABULARY) + " " + " ".join(items[i % 5].split()[i % 3 :]) + " end " + words(rnd, i, VOCABULARY)) for i in range(40)]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    want = sorted(map(tuple, decontamination.find_overlaps(frame(spark, docs), benchmark).collect()))
    # Five of the seven tokens of item 3 are too few.
    assert {w[:2] for w in want} >= {(i, i % 5) for i in range(40) if (i % 5, i % 3) != (3, 2)}
    monkeypatch.setattr(decontamination, "MAX_BITS", 10)
    monkeypatch.setattr(decontamination, "PIECE", 3)
    monkeypatch.setattr(decontamination, "RUN", 500)
    assert sorted(map(tuple, decontamination.find_overlaps(frame(spark, docs), benchmark).collect())) == want


def test_a_phrase_of_many_items_and_documents(spark):
    # 300 x 300 with copies: every pair overlaps, one overlap is enough to drop a row; ids of any type.
    rnd = random.Random(9)
    phrase = words(rnd, 30, VOCABULARY)
    items = [(f"item {i}".encode(), f"{phrase} {words(rnd, 20, VOCABULARY)}") for i in range(300)]
    docs = [(i, f"{words(rnd, 20, VOCABULARY)} {phrase} {i}") for i in range(300)] + [(400, "clean " * 40)]
    docs += [(1000 + i, f"{phrase} copied") for i in range(2000)]
    benchmark = spark.createDataFrame(items, "item_id binary, text string")
    frame_ = frame(spark, docs)
    assert [r["doc_id"] for r in decontamination.drop_contaminated(frame_, benchmark).collect()] == [400]
    found = decontamination.find_overlaps(frame_.where("doc_id < 1010"), benchmark)
    got = found.agg(F.count("*"), F.countDistinct("doc_id", "item_id"), F.min("matched")).first()
    assert tuple(got)[:2] == (310 * 300, 310 * 300) and got[2] >= 30


def test_a_very_long_text_and_a_very_long_item(spark):
    rnd = random.Random(10)
    numbered = " ".join(f"w{i}" for i in range(120_000))
    passage = words(rnd, 30, VOCABULARY)
    docs = frame(spark, [(1, numbered + " " + passage), (2, numbered[: len(numbered) // 2]), (3, "w7 w8 w9")])
    benchmark = spark.createDataFrame([(1, passage), (2, numbered)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_overlaps(docs, benchmark).collect()}
    assert set(found) == {(1, 1), (1, 2), (2, 2)}
    assert found[1, 1]["first_token"] == 120_000 and found[1, 1]["matched"] == 30
    assert found[1, 2]["matched"] == 120_000 and found[2, 2]["overlap"] == found[2, 2]["matched"] > 50_000


def test_decontamination_of_empty_tables(spark):
    docs, none = frame(spark, [(1, words(random.Random(0), 50))]), spark.createDataFrame([], "item_id long, text string")
    benchmark = spark.createDataFrame([(1, docs.first()["text"])], "item_id long, text string")
    assert decontamination.find_overlaps(docs, none).count() == 0
    assert decontamination.drop_contaminated(docs, none).count() == 1
    assert decontamination.find_overlaps(docs.where(F.lit(False)), benchmark).count() == 0
    assert decontamination.find_overlaps(docs, benchmark).count() == 1


# --- mixing ------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), total=1.5, repeat=2):
    """Share by weight, cap, share what was cut off, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, capped = total * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] >= repeat * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = float(repeat * sizes[s])
        left = total * sum(sizes.values()) - sum(capped.values())


@pytest.mark.parametrize("seed,slots", [(1, 1_000_000), (2, 500)])
def test_mix_follows_targets(spark, seed, slots):
    rnd = random.Random(seed)
    sources = [None, "", "é", "Z", "a", "b", "hot", "c", "none"]
    rows = [(i, words(rnd, rnd.choice([0, 1, 5, 60, 200])), rnd.choice(sources[:-1] + ["hot"] * 5)) for i in range(500)]
    rows += [(None, None, "none"), (7, "ab cd", "a"), (7, "ab cd", "a"), (8, " \t ", "none")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, slots=slots, key_col="source").collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["key"]] += r["size"]
        taken[r["key"]] += r["taken"]
    assert sum(sizes.values()) == sum(len((t or "").split()) for _, t, _ in rows)
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["key"]] and r["target"] == pytest.approx(want[r["key"]])
    step = max(1, sum(want.values()) / slots)
    assert all(abs(taken[s] - want[s]) <= 12 * step for s in sizes)
    again = mixing.mix_sources(docs.repartition(5), slots=slots, key_col="source").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_small_sources_reach_their_targets_beside_a_hot_one(spark):
    # With 20 slots a block of the mix is far larger than the small sources, as in a large corpus.
    rnd = random.Random(5)
    small = {"a": 300, "b": 100, "d": 800, "e": 7, "f": 1}
    rows = [(i, words(rnd, 40), "hot") for i in range(300)]
    rows += [(1000 + i, words(rnd, 1), s) for s, n in small.items() for i in range(n)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, slots=20, key_col="source", own_blocks=mixing.OWN_BLOCKS).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["key"]] += r["taken"]
        target[r["key"]] = r["target"]
    assert target == pytest.approx(brute_targets({"hot": 12_000, **small}))
    assert all(abs(taken[s] - t) <= max(0.5, 0.001 * t) for s, t in target.items()), (taken, target)


def test_slots_spread_evenly(spark):
    targets = spark.createDataFrame([(1, "a", 10_000, 6000.0), (2, "b", 10_000, 3000.0), (3, "c", 10_000, 1000.0)], "place int, source string, source_size long, target double")
    places = [r["place"] for r in mixing.schedule(targets, 1, 10_000.0).orderBy("slot").collect()]
    assert len(places) == 10_000
    for start in range(0, 9000, 500):
        part = places[start : start + 1000]
        assert abs(part.count(1) - 600) < 8 and abs(part.count(2) - 300) < 8 and abs(part.count(3) - 100) < 8


def test_mixing_of_empty_tables(spark):
    docs = frame(spark, [(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {tuple(r)[1:] for r in mixing.mix_sources(docs).collect()} == {(0, 0, 0.0, 0)}
    assert mixing.mix_sources(docs.where(F.lit(False))).count() == 0


# --- fingerprints --------------------------------------------------------------------

def test_fingerprints_match_brute_force(spark):
    texts = hard_texts() + ["\n".join(words(random.Random(i), 9) for i in range(n)) for n in (3, 40, 200, 201)]
    rows = [(10 * i - 40, t) for i, t in enumerate(texts)] + [(0, "ties of an id"), (0, "ties of an id")]
    docs = frame(spark, rows, parts=5)
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    digests = dict(docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect())
    order = sorted(((i, digests[t or ""], t or "") for i, t in rows))
    exact = spark.createDataFrame(
        [(t, t[: len(t) - len(t) // 4] + n[: len(t) // 4], n, i) for (i, _, t), (_, _, n) in zip(order, order[1:] + order[:1], strict=True)],
        "t string, e string, n string, i long",
    )
    a, e, n = (fingerprints.paragraph_digests(F.col(c)) for c in "ten")
    want = exact.select("i", F.length("t"), F.sha2("e", 256), fingerprints.exact_likeness(a, e), fingerprints.exact_likeness(a, n)).collect()
    key = lambda r: (r[0], r[1], r[2], round(r[3], 9), round(r[4], 9))
    assert sorted(key((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"])) for r in got) == sorted(map(key, want))
    by_text = defaultdict(set)
    texts_of = defaultdict(set)
    for i, t in rows:
        texts_of[i].add(t or "")
    for r in got:
        if len(texts_of[r["doc_id"]]) == 1:
            by_text[next(iter(texts_of[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())


def test_peeling_recovers_differences_and_reports_failure(spark):
    rnd = random.Random(1)
    common = [rnd.getrandbits(63) for _ in range(300)]
    rows = [(common + [rnd.getrandbits(63) for _ in range(g)], common + [rnd.getrandbits(63) for _ in range(c)], g, c) for g in (0, 1, 4) for c in (0, 2, 5)]
    rows.append(([rnd.getrandbits(63) for _ in range(100)], [], 100, 0))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, g int, c int")
    a, b = F.col("a"), F.col("b")
    peeled = fingerprints.peel(fingerprints.subtract(fingerprints.sketch(a), fingerprints.sketch(b)))
    out = df.select("g", "c", peeled.alias("p"), fingerprints.dealt_likeness(a, b, 2).alias("l"), fingerprints.exact_likeness(a, b).alias("x")).collect()
    for r in out[:-1]:
        assert r["p"]["ok"] and (r["p"]["gone"], r["p"]["come"]) == (r["g"], r["c"])
    assert not out[-1]["p"]["ok"]
    assert sum(r["l"] == r["x"] for r in out) >= 8 and all(r["l"] in (None, r["x"]) for r in out)


def test_single_document_null_ids_and_empty_table(spark):
    docs = frame(spark, [(None, "one two three four")])
    (row,) = fingerprints.fingerprint_documents(docs).collect()
    assert row["doc_id"] is None and row["near_next"] == 1.0
    assert row["edited_sha256"] == hashlib.sha256(b"one two three one ").hexdigest()
    assert fingerprints.fingerprint_documents(docs.where(F.lit(False))).count() == 0


# --- pipeline --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(8)
    passage = words(rnd, 150, VOCABULARY)
    rows = []
    for i in range(260):
        text = words(rnd, rnd.randint(120, 200), VOCABULARY)
        if i % 9 == 0:
            text = "| " + " | ".join(text.split())
        if i % 13 == 1:
            text += " " + passage
        if i % 31 == 5:
            text += " benchmark says " + words(random.Random(99), 25, VOCABULARY)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(1000 + i, rows[i][1], "en", "s1", rows[i][4]) for i in range(40)] + [(2000, None, None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, words(random.Random(99), 25, VOCABULARY))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    rows = [r for r, s in zip(rows, model.scores([(r["text"] or "").encode() for r in rows]), strict=True) if s >= 0.3]
    prints = [brute_print(r["text"]) for r in rows]
    roots, kept = brute_groups(prints), {}
    for r, p in zip(rows, prints, strict=True):
        kept.setdefault(roots[p], r)
    rows = list(kept.values())
    for r, raw, mask in zip(rows, *removed_mask([r["text"] for r in rows], suffix_dedup.LENGTH), strict=True):
        if r["text"] is not None:
            r["text"] = bytes(b for b, m in zip(raw, mask, strict=True) if not m).decode()
            r["n_chars"] = len(r["text"])
    item = words(random.Random(99), 25, VOCABULARY)
    rows = [r for r in rows if item not in (r["text"] or "")]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: (r["text"], r["n_chars"]) for i, r in got.items()} == {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows}
    assert sum(1 for i in got if i % 9 == 0 and i < 260) < 3 and len(got) > 190
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").split())
    want = brute_targets(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"] for r in got.values())


def test_tables_of_former_stages_are_emptied(spark, sf_dir, monkeypatch):
    folders = []

    def stage(spark, docs, sf_dir):
        folders.append(docs.inputFiles()[0].rsplit("/", 1)[0])
        return docs.unionByName(docs)

    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, stage) for name in "abc"])
    assert corpus_pipeline.run(spark, sf_dir).count() == 8 * n
    # The first one reads the input, which stays.
    assert spark.read.parquet(f"{sf_dir}/documents.parquet").count() == n
    assert [spark.read.parquet(f).count() for f in folders[1:]] == [0, 0]


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where(F.lit(False)), sf_dir)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns


def test_mix_keeps_columns_with_names_of_its_own(spark, sf_dir):
    docs = spark.createDataFrame([(i, "ab cd " * i, "s", -i, f"t{i}", "kept") for i in range(6)], "doc_id long, text string, source string, Size int, taken string, taken_ string")
    out = corpus_pipeline.mix(spark, docs, sf_dir)
    assert out.columns == ["doc_id", "text", "source", "Size_", "taken__", "taken_", "size", "source_size", "target", "taken"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all((r["Size_"], r["taken__"], r["taken_"], r["size"]) == (-i, f"t{i}", "kept", 2 * i) for i, r in rows.items()) and len(rows) == 6
