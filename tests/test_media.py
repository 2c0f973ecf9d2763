import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import media


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def greedy(items, threshold=8):
    """Leaders one by one in name order."""
    out = {}
    for part in {p for p, _, _ in items}:
        leaders = []
        for _, name, bits in sorted((i for i in items if i[0] == part), key=lambda i: i[1]):
            close = [n for n, b in leaders if bin((b ^ bits) & (2**64 - 1)).count("1") <= threshold]
            if not close:
                leaders.append((name, bits))
            out[(part, name)] = close[0] if close else name
    return out


def groups(spark, items, **how):
    df = spark.createDataFrame([(p, n, signed(b)) for p, n, b in items], "event_id string, filename string, bits bigint")
    return {(r["part"], r["name"]): r["leader"] for r in media.near_duplicate_groups(df, **how).collect()}


def test_threshold(spark):
    items = [("e", "a", 0), ("e", "b", 0), ("e", "c", 2**8 - 1), ("e", "d", 2**9 - 1), ("f", "e", 0)]
    assert groups(spark, items) == {("e", "a"): "a", ("e", "b"): "a", ("e", "c"): "a", ("e", "d"): "d", ("f", "e"): "e"}


def test_members_do_not_recruit(spark):
    items = [("e", "a", 0), ("e", "b", 2**8 - 1), ("e", "c", 2**16 - 1)]
    assert groups(spark, items)[("e", "c")] == "c"


def test_items_without_part_or_bits_have_no_group(spark):
    rows = [("e", "a", 0), ("e", "b", 1), ("e", None, 3), (None, "c", 0), ("e", "d", None)]
    df = spark.createDataFrame(rows, "event_id string, filename string, bits bigint")
    got = {(r["part"], r["name"], r["leader"]) for r in media.near_duplicate_groups(df).collect()}
    assert got == {("e", "a", "a"), ("e", "b", "a"), ("e", None, None)}


@pytest.mark.parametrize("bands", [None, (9, 0), (4, 2), (3, 2), (2, 4)])
def test_against_one_by_one(spark, bands):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(4)]
    items = []
    for i in range(90):
        bits = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(0, 8)):
            bits ^= 1 << b
        items.append((rng.choice("ef"), f"n{i:03d}", bits))
    # A third of all rows are copies of one item.
    items += [("e", f"z{i:03d}", centres[0]) for i in range(45)]
    assert groups(spark, items, bands=bands) == greedy(items)


def test_probed_sides_are_not_broadcast(spark):
    items = spark.createDataFrame([("e", b, f"n{b}") for b in range(40)], "part string, bits long, name string")
    first = media._close_earlier(items, items, 4, 2, 8, 40)
    assert {r["bits"]: r["leader"] for r in first.collect()} == {b: "n0" for b in range(1, 40)}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_radii_pass_the_threshold_and_no_more():
    assert media._band_radii(4, 2, 8) == [1, 1, 1, 2] and media._band_radii(2, 4, 8) == [3, 4]
    # A radius that is too small for the threshold stays.
    assert media._band_radii(2, 1, 8) == [1, 1] and media._band_radii(9, 2, 8) == [0] * 9


def test_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT_BUCKET", 5)
    rng = random.Random(2)
    # The lower half is the same everywhere, so that every lower band is one bucket.
    items = [("e", f"n{i:03d}", rng.choice([0, 2**63, 2**62 + 2**61]) ^ (rng.getrandbits(9) << 40)) for i in range(80)]
    for bands in (None, (4, 2)):
        assert groups(spark, items, bands=bands) == greedy(items)


def test_bits(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 5.0],)], "v array<double>")
    row = df.select(media.difference_bits(F.col("v")).alias("b"), media.pack_bits(media.difference_bits(F.col("v"))).alias("p")).first()
    assert (row["b"], row["p"]) == ([1, 0, 1], 5)


def test_word_fingerprints_are_counted_in_batches(spark, monkeypatch):
    def one_by_one(words):
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in set(words or [])]
        return signed(sum(1 << i for i in range(64) if 2 * sum(h >> (63 - i) & 1 for h in hashes) > len(hashes)))

    rng = random.Random(5)
    lists = [None, [], ["a"], ["a", "a", "b"], ["ünd", "σ"]] + [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))] for _ in range(60)]
    expected = [one_by_one(words) for words in lists]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, words array<string>").repartition(3)
    assert [r["b"] for r in df.select("i", media.word_fingerprint(F.col("words")).alias("b")).orderBy("i").collect()] == expected
    monkeypatch.setattr(media, "_PAIRS", 7)
    assert media._word_fingerprints(pa.array(lists, pa.list_(pa.string()))).to_pylist() == expected
    assert media._word_fingerprints(pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_quality(spark):
    rows = [("e", "a", 2000, 1500, 1_048_576, 1000.0, 100.0), ("e", "b", 0, 0, 0, 0.0, 40.0), ("e", "c", 0, 0, 0, 0.0, 255.0)]
    df = spark.createDataFrame(rows, "event_id string, filename string, width int, height int, bytes bigint, lap_var double, mean_b double")
    assert [r["total"] for r in media.quality_score(df).orderBy("filename").collect()] == [100.0, 7.5, 0.0]


# The total is 56.45, as a sum of doubles 56.449999999999996.
_HALF = [("en", "d5300", 1500, 700, 1_970_700, 800.0, 244.0)]
_ASSET = "event_id string, filename string, width int, height int, bytes bigint, lap_var double, mean_b double"


def test_halves_go_up(spark):
    (row,) = media.quality_score(spark.createDataFrame(_HALF, _ASSET)).collect()
    assert (row["total"], row["resolution"], row["sharpness"], row["exposure"], row["filesize"]) == (56.5, 35.0, 80.0, 14.7, 100.0)


def test_best_has_the_rounded_total(spark):
    groups = spark.createDataFrame([("en", "d5300", "d5300"), ("en", "d6", "d5300")], "part string, name string, leader string")
    # The other copy has 56.5 by a larger margin; equal totals are decided by name.
    marks = media.quality_score(spark.createDataFrame([*_HALF, ("en", "d6", 1500, 700, 1_975_000, 801.0, 244.0)], _ASSET))
    scores = marks.select(F.col("event_id").alias("part"), F.col("filename").alias("name"), "total")
    got = {r["name"]: (r["total"], r["duplicate"]) for r in media.keep_best(groups, scores).collect()}
    assert got == {"d5300": (56.5, False), "d6": (56.5, True)}


def test_roles(spark):
    rows = [("e", f"n{i:02d}", float(30 - i), i == 3) for i in range(20)] + [("e", "zero", 0.0, False)]
    df = spark.createDataFrame(rows, "part string, name string, total double, duplicate boolean")
    roles = {r["name"]: r["role"] for r in media.hero_gallery(df).collect()}
    assert roles["n00"] == "hero" and roles["n03"] == "duplicate" and roles["n10"] == "gallery" and roles["n11"] == "unused"
    assert roles["n16"] == "low_quality" and roles["zero"] == "unused"


def test_reselect(spark):
    selection = spark.createDataFrame([("e", "h", ["a", "b"], ["h", "a", "b", "x"]), ("f", "h", ["a"], ["h", "a"]), ("g", "h", [], ["h"])], "event_id string, hero string, gallery array<string>, usable array<string>")
    advice = spark.createDataFrame([("e", "b"), ("f", "bad")], "event_id string, advised string")
    got = {r["event_id"]: (r["hero"], r["gallery"]) for r in media.reselect_hero(selection, advice).collect()}
    assert got == {"e": ("b", ["h", "a"]), "f": ("h", ["a"]), "g": ("h", [])}


def test_events_registered_once(spark):
    nothing = spark.createDataFrame([], "event_id string, folder_name string, event_name string, event_date string, base_dir string, status string")
    listing = spark.createDataFrame([("/m", "2024-05-01 Open Day"), ("/m", "Loose")], "base_dir string, folder_name string")
    once = media.register_events(nothing, listing)
    twice = media.register_events(once, listing)
    rows = {(r["event_name"], r["event_date"]) for r in twice.collect()}
    assert twice.count() == 2 and rows == {("Open Day", "2024-05-01"), ("Loose", None)}
