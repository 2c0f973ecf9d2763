"""Media assets: quality, near-duplicates, hero and gallery.

Near-duplicates are found by greedy leaders: items are taken by name, an item
that no earlier leader is close to becomes a leader, every other item joins the
first leader close to it. Members do not recruit.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions.text import slugify
from scriptorium.session import checkpointed, written

# Task functions travel with their code, so that workers need not have this package.
register_pickle_by_value(sys.modules[__name__])

BITS = 64
# A band value shared by more distinct fingerprints than this is split over several tasks.
HOT_BUCKET = 50_000


def quality_score(assets: DataFrame) -> DataFrame:
    """Add resolution, sharpness, exposure, filesize and their weighted ``total``, 0 to 100.

    ``assets(width, height, bytes, lap_var, mean_b)``.
    """
    def clipped(value: Column) -> Column:
        return F.least(value, F.lit(1.0)) * 100

    # 3 megapixels, variance 1000 and 1 MiB are full marks; brightness 80 to 180 is well exposed.
    bright = F.col("mean_b")
    scored = assets.withColumns(
        {
            "resolution": clipped(F.col("width").cast("double") * F.col("height") / 3_000_000),
            "sharpness": clipped(F.col("lap_var") / 1000.0),
            "exposure": F.when(bright.between(80, 180), 100.0)
            .when(bright < 80, bright / 80.0 * 100)
            .otherwise(F.greatest(F.lit(0.0), (1.0 - (bright - 180) / 75.0) * 100)),
            "filesize": clipped(F.col("bytes") / 1_048_576.0),
        }
    )
    def one_digit(value: Column) -> Column:
        # Halves go up, also those that a sum of fractions misses by its last bit, like 56.449999999999996.
        return F.round(value * 10, 0) / 10

    total = 0.35 * F.col("resolution") + 0.40 * F.col("sharpness") + 0.15 * F.col("exposure") + 0.10 * F.col("filesize")
    rounded = {c: one_digit(F.col(c)) for c in ("resolution", "sharpness", "exposure", "filesize")}
    return scored.withColumn("total", one_digit(total)).withColumns(rounded)


def difference_bits(values: Column) -> Column:
    """Bit i tells whether value i+1 exceeds value i, as an array of 0 and 1."""
    return F.transform(
        F.sequence(F.lit(0), F.size(values) - 2), lambda i: (F.get(values, i + 1) > F.get(values, i)).cast("int")
    )


def pack_bits(bits: Column) -> Column:
    """Up to 64 bits as one long, the first bit lowest."""
    return F.aggregate(
        F.transform(bits, lambda b, i: F.struct(b.alias("b"), i.alias("i"))),
        F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", x["b"].cast("long"), x["i"])),
    )


def word_fingerprint(words: Column) -> Column:
    """A long per list of words: bit i tells whether bit i of the md5, highest first, is set in over half of the distinct words.

    Counted a batch of lists at a time. A null or empty list gives 0.
    """
    return F.arrow_udf(_word_fingerprints, "bigint")(words)


# Pairs of list and word whose bits are unpacked at once, 64 bytes each.
_PAIRS = 100_000


def _word_fingerprints(words: pa.Array) -> pa.Array:
    rows = len(words)
    lengths = pa.compute.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    terms = max(len(coded.dictionary), 1)
    digests = b"".join(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:8] for w in coded.dictionary.to_pylist())
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    row, term = np.divmod(np.unique(np.repeat(np.arange(rows, dtype=np.int64), lengths) * terms + coded.indices.to_numpy()), terms)
    sums = np.zeros((rows, BITS), np.int64)
    for start in range(0, len(row), _PAIRS):
        mine, firsts = np.unique(row[start : start + _PAIRS], return_index=True)
        sums[mine] += np.add.reduceat(bits[term[start : start + _PAIRS]], firsts, axis=0, dtype=np.int64)
    most = sums * 2 > np.bincount(row, minlength=rows)[:, None]
    return pa.array(np.packbits(most, axis=1, bitorder="little").view("<i8")[:, 0])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# --- near-duplicates -----------------------------------------------------------

def choose_bands(threshold: int) -> tuple[int, int]:
    """``(bands, radius)``: into how many bands a fingerprint is cut, and how far a band may differ.

    With ``m`` bands two fingerprints within ``threshold`` differ by at most
    ``threshold // m`` in one of them. One band more than that needs no probes,
    so all that meets lies in one bucket and is compared there as an array, which costs
    a hundredth of what a joined pair costs.
    """
    return min(threshold + 1, BITS), 0


def _band_layout(bands: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of each band; together they cover all 64 bits."""
    base, extra = divmod(BITS, bands)
    layout, shift = [], 0
    for b in range(bands):
        width = base + (1 if b < extra else 0)
        layout.append((shift, width))
        shift += width
    return layout


def _band_value(bits: Column, shift: int, width: int) -> Column:
    moved = F.call_function("shiftrightunsigned", bits, F.lit(shift))
    return moved if width >= BITS else moved.bitwiseAND(F.lit((1 << width) - 1))


def _plain_bands(items: DataFrame, layout: list[tuple[int, int]], prefix: str) -> DataFrame:
    """One row per item and band."""
    keys = F.array(
        *[F.struct(F.lit(b).alias("band"), _band_value(F.col("bits"), *where).alias("key")) for b, where in enumerate(layout)]
    )
    return items.select(
        "part", F.col("bits").alias(f"{prefix}bits"), F.col("name").alias(f"{prefix}name"), F.explode(keys).alias("k")
    ).select("part", "k.band", "k.key", f"{prefix}bits", f"{prefix}name")


def _band_radii(bands: int, radius: int, threshold: int) -> list[int]:
    """How far each band is probed, ``radius`` at most.

    If every band differed by more than its radius, the fingerprints would differ
    by the radii and one bit more for each band. That need only pass ``threshold``.
    """
    base, more = divmod(max(threshold + 1 - bands, 0), bands)
    return [min(radius, base + (b >= bands - more)) for b in range(bands)]


def _probing_bands(items: DataFrame, layout: list[tuple[int, int]], radii: list[int], prefix: str) -> DataFrame:
    """One row per item, band and band value within the band's radius."""
    rows = _plain_bands(items, layout, prefix)
    if not any(radii):
        return rows
    masks = []
    for (_, width), radius in zip(layout, radii, strict=True):
        own = [0]
        for r in range(1, radius + 1):
            own += [sum(1 << i for i in picked) for picked in combinations(range(width), r)]
        masks.append(own)
    per_band = reduce(
        lambda other, b: F.when(F.col("band") == b, F.from_json(F.lit(str(masks[b])), "array<bigint>")).otherwise(other),
        range(len(layout)),
        F.lit(None).cast("array<bigint>"),
    )
    return rows.withColumn("mask", F.explode(per_band)).withColumn("key", F.col("key").bitwiseXOR(F.col("mask"))).drop("mask")


def _dealt(later: DataFrame, earlier: DataFrame, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``cell`` to both sides, so that every pair of a hot bucket meets in one cell of a grid.

    A bucket of ``n`` rows of ``counted`` has ``n / HOT_BUCKET`` lines of cells either way: later rows
    lie in one line and are repeated along it, earlier rows in one column. What
    a cell holds does not grow with the bucket.
    """
    keys = ["part", "band", "key"]
    # A stored table, whose size is known: Spark sends it around only if it is small.
    hot = written(
        counted.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > HOT_BUCKET)
        .select(*keys, F.ceil(F.col("n") / HOT_BUCKET).cast("long").alias("side"))
    )

    def cells(rows: DataFrame, bits: str, cell: Callable[[Column, Column, Column], Column]) -> DataFrame:
        side = F.coalesce("side", F.lit(1).cast("long"))
        mine = F.pmod(F.xxhash64(bits), side)
        along = F.transform(F.sequence(F.lit(0).cast("long"), side - 1), lambda other: cell(mine, other, side))
        return rows.join(hot, keys, "left").withColumn("cell", F.explode(along)).drop("side")

    return (
        cells(later, "bits", lambda mine, other, side: mine * side + other),
        cells(earlier, "o_bits", lambda mine, other, side: other * side + mine),
    )


def _close_earlier(later: DataFrame, earlier: DataFrame, bands: int, radius: int, threshold: int, n: int) -> DataFrame:
    """``(part, bits, leader)``: the first earlier item within the threshold, for later items that have one."""
    layout, radii = _band_layout(bands), _band_radii(bands, radius, threshold)
    if radius:
        # What is probed is dealt out first, as a few items make many rows.
        probes = sum(comb(width, r) for (_, width), most in zip(layout, radii, strict=True) for r in range(most + 1))
        later = later.repartition(max(later.sparkSession.sparkContext.defaultParallelism, n * probes // _TASK_PROBES))
    a = _probing_bands(later, layout, radii, "")
    b = _plain_bands(earlier, layout, "o_")
    keys = ["part", "band", "key"]
    if n > HOT_BUCKET:
        counted = b.select(*keys) if radius else a.select(*keys).unionByName(b.select(*keys))
        a, b = _dealt(a, b, counted)
        keys.append("cell")
    if radius:
        on = [a[k] == b[k] for k in keys] + [hamming(a["bits"], b["o_bits"]) <= threshold, b["o_name"] < a["name"]]
        # Sides are estimated by their items, not by the rows that these make: neither is broadcast.
        met = a.join(b.hint("merge"), on).select(a["part"], "bits", F.col("o_name").alias("leader"))
    else:
        # Rows are few and small, the comparisons are the work: tasks are counted, not merged by their size.
        tasks = max(3 * later.sparkSession.sparkContext.defaultParallelism, n * bands // _TASK_ROWS)
        sides = [rows.select(*[F.col(c).alias(f"{side}_{c}") for c in keys], *rest).repartition(tasks, *[f"{side}_{c}" for c in keys])
                 for rows, side, rest in ((a, "a", ["bits", "name"]), (b, "b", ["o_bits", "o_name"]))]
        groups = [rows.groupBy(*[f"{side}_{c}" for c in keys]) for rows, side in zip(sides, "ab", strict=True)]
        met = groups[0].cogroup(groups[1]).applyInArrow(_first_earlier(threshold), _FIRST)
    return met.groupBy("part", "bits").agg(F.min("leader").alias("leader"))


# Rows of later items that one task compares, probes that one task makes, and pairs compared at once.
_TASK_ROWS = 250_000
_TASK_PROBES = 4_000_000
_CELLS = 1 << 16
_FIRST = "part string, bits bigint, leader string"


def _first_earlier(threshold: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Within one bucket: for each later item the first earlier one within ``threshold`` bits, if any."""

    def first(later: pa.Table, earlier: pa.Table) -> pa.Table:
        size = earlier.num_rows
        names = pa.concat_arrays([c.cast(pa.string()) for t, n in ((earlier, "o_name"), (later, "name")) for c in t.column(n).chunks])
        place = pa.compute.rank(names, tiebreaker="min").to_numpy().astype(np.int64) if len(names) else np.zeros(0, np.int64)
        # An item without a name comes before or after none.
        place = np.where(np.arange(len(place)) < size, place, np.where(names.is_valid().to_numpy(zero_copy_only=False), place, -1))
        in_order, waiting = np.argsort(place[:size], kind="stable"), np.argsort(place[size:], kind="stable")
        places, bits = place[:size][in_order], earlier.column("o_bits").to_numpy().view(np.uint64)[in_order]
        own_places, own = place[size:], later.column("bits").to_numpy().view(np.uint64)
        found = np.full(later.num_rows, -1, np.int64)
        step = 512
        for start in range(0, size, step):
            # Earlier items come by name, so the first hit is the answer, and an item that has it leaves.
            after = np.searchsorted(own_places[waiting], places[start], side="right")
            waiting = waiting[after:]
            left = [waiting[:0]]
            for low in range(0, len(waiting), _CELLS // step):
                some = waiting[low : low + _CELLS // step]
                near = np.bitwise_count(own[some][:, None] ^ bits[None, start : start + step]) <= threshold
                if places[min(start + step, size) - 1] >= own_places[some[0]]:
                    near &= places[None, start : start + step] < own_places[some][:, None]
                hit = near.any(axis=1)
                if hit.any():
                    found[some[hit]] = in_order[start + near[hit].argmax(axis=1)]
                    some = some[~hit]
                left.append(some)
            waiting = np.concatenate(left)
        good = np.flatnonzero(found >= 0)
        return pa.table([later.column("a_part").take(good), later.column("bits").take(good), names.take(found[good])], names=["part", "bits", "leader"])

    return first


def near_duplicate_groups(
    items: DataFrame, *, part: str = "event_id", name: str = "filename", bits: str = "bits", threshold: int = 8, bands: tuple[int, int] | None = None
) -> DataFrame:
    """``(part, name, bits, leader)`` for every item with part and bits; a leader leads itself.

    Equal fingerprints are one fingerprint named by its first item, so copies,
    however many, never meet each other in a join. Leaders are then found in
    rounds over distinct fingerprints: a fingerprint with no earlier undecided
    neighbour becomes a leader, and its undecided neighbours are decided. A round
    only asks for the first neighbour; no list of pairs is built. Leaders are never
    close to one another.
    """
    rows = written(items.select(F.col(part).alias("part"), F.col(name).alias("name"), F.col(bits).cast("long").alias("bits")))
    known = rows.where("part IS NOT NULL AND bits IS NOT NULL")
    distinct = checkpointed(known.groupBy("part", "bits").agg(F.min("name").alias("name")))
    m, radius = bands or choose_bands(threshold)
    undecided, leaders, n = distinct, None, distinct.count()
    left = n
    while left:
        blocked = _close_earlier(undecided, undecided, m, radius, threshold, left)
        fresh = undecided.join(blocked, ["part", "bits"], "left_anti")
        fresh = checkpointed(fresh)
        taken = _close_earlier(undecided.join(fresh, ["part", "bits"], "left_anti"), fresh, m, radius, threshold, left)
        rest = undecided.join(fresh.select("part", "bits").unionByName(taken.select("part", "bits")), ["part", "bits"], "left_anti")
        undecided = checkpointed(rest)
        left = undecided.count()
        leaders = fresh if leaders is None else leaders.unionByName(fresh)
    if leaders is None:
        return rows.withColumn("leader", F.lit(None).cast("string"))
    first = _close_earlier(distinct.join(leaders, ["part", "bits"], "left_anti"), leaders, m, radius, threshold, n)
    decided = leaders.select("part", "bits", F.col("name").alias("leader")).unionByName(first)
    return rows.join(decided, ["part", "bits"]).select("part", "name", "bits", "leader")


def keep_best(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """Add ``total``, ``group_size`` and ``duplicate``: all but the best of each group.

    ``groups(part, name, leader)``, ``scores(part, name, total)``. The best of a
    group is an aggregate, so one huge group is combined on the map side.
    """
    joined = groups.join(scores.select("part", "name", "total"), ["part", "name"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    best = joined.groupBy("part", "leader").agg(
        F.min(F.struct((-F.col("total")).alias("minus"), "name")).alias("best"),
        F.count("*").alias("group_size"),
    )
    return (
        joined.join(best.select("part", "leader", F.col("best.name").alias("best_name"), "group_size"), ["part", "leader"])
        .withColumn("duplicate", F.col("name") != F.col("best_name"))
        .drop("best_name")
    )


def hero_gallery(candidates: DataFrame, *, gallery: int = 9, low_score: float = 15.0) -> DataFrame:
    """Add ``rank`` and ``role`` to ``candidates(part, name, total, duplicate)``.

    Rank 1 is the hero, the next nine the gallery; beyond that a low score rejects.
    Only the top of each part has a rank, so parts of any size are pruned early.
    """
    usable = candidates.where(~F.col("duplicate") & (F.col("total") > 0))
    order = Window.partitionBy("part").orderBy(F.desc("total"), "name")
    top = usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= gallery + 1)
    ranks = top.select("part", "name", "rank")
    role = (
        F.when(F.col("duplicate"), "duplicate")
        .when(F.col("rank") == 1, "hero")
        .when(F.col("rank").isNotNull(), "gallery")
        .when((F.col("total") > 0) & (F.col("total") < low_score), "low_quality")
        .otherwise("unused")
    )
    return candidates.join(ranks, ["part", "name"], "left").withColumn("role", role)


def reselect_hero(selection: DataFrame, advice: DataFrame) -> DataFrame:
    """Swap in an advised hero that was scored and not rejected.

    ``selection(event_id, hero, gallery, usable)``, ``advice(event_id, advised)``;
    ``usable`` lists what may become hero. The old hero goes to the gallery.
    """
    joined = selection.join(advice, "event_id", "left")
    swap = F.array_contains("usable", F.col("advised")) & F.col("hero").isNotNull() & (F.col("hero") != F.col("advised"))
    replaced = F.transform("gallery", lambda g: F.when(g == F.col("advised"), F.col("advised")).otherwise(g))
    others = F.slice(F.filter(replaced, lambda g: g != F.col("advised")), 1, 8)
    with_old = F.when(F.array_contains(replaced, F.col("hero")), replaced).otherwise(F.concat(F.array("hero"), others))
    wanted = F.coalesce(swap, F.lit(False))
    return joined.select(
        "event_id",
        F.when(wanted, F.col("advised")).otherwise(F.col("hero")).alias("hero"),
        F.when(wanted, with_old).otherwise(F.col("gallery")).alias("gallery"),
    )


def event_id(base: Column, folder: Column) -> Column:
    return F.substring(F.sha2(F.concat(base, F.lit("::"), folder), 256), 1, 16)


def register_events(events: DataFrame, listing: DataFrame) -> DataFrame:
    """Add the folders of ``listing(base_dir, folder_name)`` that are not known yet.

    ``YYYY-MM-DD Name`` folders give a date and a name, others a name only.
    """
    pattern = r"^(\d{4}-\d{2}-\d{2})\s+(.+)$"
    dated = F.regexp_extract("folder_name", pattern, 2) != ""
    new = listing.dropDuplicates(["base_dir", "folder_name"]).select(
        event_id(F.col("base_dir"), F.col("folder_name")).alias("event_id"),
        "folder_name",
        F.trim(F.when(dated, F.regexp_extract("folder_name", pattern, 2)).otherwise(F.col("folder_name"))).alias("event_name"),
        F.when(dated, F.regexp_extract("folder_name", pattern, 1)).alias("event_date"),
        "base_dir",
        F.lit("pending").alias("status"),
    )
    unseen = new.join(events.select("event_id"), "event_id", "left_anti")
    return events.unionByName(unseen, allowMissingColumns=True)


def export_metadata(events: DataFrame) -> DataFrame:
    """What an event is published with: the editor's value, else the analysed one.

    ``events(event_id, event_name, event_date, hero, gallery, hero_score, meta, analysis)``
    with ``meta`` and ``analysis`` as string maps.
    """
    def suffix(name: Column) -> Column:
        return F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)

    def either(edited: str, analysed: str) -> Column:
        value = F.col("meta").getItem(edited)
        return F.coalesce(F.when(value != "", value), F.col("analysis").getItem(analysed), F.lit(""))

    hero = F.coalesce("hero", F.lit(""))
    return events.select(
        "event_id",
        F.coalesce(F.col("meta").getItem("eventSlug"), slugify(F.col("event_name"), "export_topic")).alias("event_slug"),
        F.coalesce(F.col("meta").getItem("eventDate"), "event_date", F.lit("")).alias("event_date"),
        F.coalesce(F.col("meta").getItem("eventName"), "event_name").alias("event_name"),
        either("altTextEn", "alt_text_en").alias("alt_text_en"),
        either("altTextAr", "alt_text_ar").alias("alt_text_ar"),
        either("captionEn", "caption_en").alias("caption_en"),
        either("captionAr", "caption_ar").alias("caption_ar"),
        F.bround(F.coalesce("hero_score", F.lit(0.0)), 0).cast("int").alias("quality_score"),
        F.when(hero != "", F.concat(F.lit("hero"), suffix(hero))).otherwise("").alias("hero_filename"),
        F.transform(
            "gallery", lambda g, i: F.concat(F.lit("gallery-"), F.lpad((i + 1).cast("string"), 2, "0"), suffix(g))
        ).alias("gallery_files"),
    )
