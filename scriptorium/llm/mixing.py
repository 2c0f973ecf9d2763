"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source, its documents in shuffled order, are cut into blocks of
equal size. The mix is a number of slots; slot ``i`` falls on the point
``i * golden ratio mod 1``, the cumulative target shares say whose slot that
is, and the rank of the slot among those of its source says which block it
takes, round after round. Any stretch of slots is close to the targets.

Positions and ranks are sums over cells first and within cells second, so no
source is ever ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.llm.common import WORD, text_of
from scriptorium.session import written

WEIGHTS = (5, 2, 1)
# Words of the mix per word of the input, and the most a source may repeat.
TOTAL = 1.5
REPEAT = 2
# The schedule has about so many slots; a block has at least one word.
SLOTS = 1_000_000
# Where every source has its own block: at least so many blocks per source, or blocks of one word.
OWN_BLOCKS = 2000
# Cells of the shuffled order of a source, of the slots, and of the unit interval.
ORDER_CELLS = 4096
SLOT_CELL = 4096
POINT_CELLS = 4096

_GOLDEN = (math.sqrt(5) - 1) / 2


def sized(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key_col: str | None = None
) -> DataFrame:
    """``(doc_id, source, size, shuffle, key)``: words per row, and a hash that shuffles the rows of a source."""
    return docs.select(
        F.col(key_col or id_col).alias("key"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text_of(text_col))).alias("shuffle"),
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, repeat: float = REPEAT) -> DataFrame:
    """``(place, source, source_size, target)``, one row per source, null included; targets in words.

    Sources take the weights in turn, in code-point order, null last. Targets
    share ``total`` of all sizes by weight, none above ``repeat`` times its
    source's size; what that cuts off goes to the others by weight. With the
    sources in order of size per weight, the capped ones are a prefix: source
    ``k`` is capped if its cap is at most its share of what the earlier ones
    leave.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows over the list of sources, one row each.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (
        sizes.withColumn("place", place)
        .withColumn("weight", F.element_at(cycle, (F.col("place") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * float(repeat))
    )
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    zero = F.lit(0.0)
    ordered = (
        weighed.withColumn("words", F.sum("source_size").over(all_rows) * total)
        .withColumn("weights", F.sum("weight").over(all_rows))
        .withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(upto), zero))
        .withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(upto), zero))
        .withColumn("capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    )
    # What the first source that is not capped sees holds for all behind it, and is the most.
    level = F.max(F.when(~F.col("capped"), F.col("left") / F.col("open"))).over(all_rows)
    return ordered.withColumn("level", level).select(
        "place", "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target")
    )


def schedule(targets: DataFrame, block: int, words: float, repeat: int = REPEAT) -> DataFrame:
    """``(slot, place, rank, block, round)``: which block of which source every slot of the mix takes.

    ``words`` is the sum of the targets. Slots behind the last round that a
    source may have are left out.
    """
    spark = targets.sparkSession
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        targets.where("target > 0")
        .withColumn("lo", F.coalesce(F.sum("target").over(before), F.lit(0.0)) / F.lit(words or 1.0))
        .withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("place")), F.lit(2.0)))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
    )

    def cell(x: Column) -> Column:
        return F.least(F.floor(x * POINT_CELLS), F.lit(POINT_CELLS - 1)).cast("int")

    by_cell = spans.select("place", "blocks", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    point = F.col("id") * F.lit(_GOLDEN)
    slots = (
        spark.range(math.floor(words / block + 0.5))
        .select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
        .withColumn("cell", cell(F.col("point")))
        .join(by_cell, "cell")
        .where("lo <= point AND point < hi")
        .select("slot", "place", "blocks", F.floor(F.col("slot") / SLOT_CELL).alias("slots"))
    )
    counts = slots.groupBy("place", "slots").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("place").orderBy("slots").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("place", "slots", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("place", "slots").orderBy("slot")) - 1
    ranked = slots.join(starts, ["place", "slots"]).withColumn("rank", F.col("start") + within)
    return ranked.where(F.col("rank") < F.col("blocks") * repeat).select(
        "slot", "place", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("round")
    )


def own_draws(targets: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """``(place, block, times)`` where every source has blocks of its own ``block_words``.

    A source's share of the slots is the number it needs to reach its target.
    What the points give beyond that is left out, what they fail to give comes
    as its next ranks, so every source ends within half a block of its target.
    """
    blocks = F.ceil(F.col("source_size") / F.col("block_words"))
    # A whole round is the source itself, short last block included.
    rounds = F.floor(F.col("target") / F.col("source_size"))
    rest = F.floor((F.col("target") - rounds * F.col("source_size")) / F.col("block_words") + 0.5)
    # In blocks instead of words, so that a block of the schedule is one unit.
    needs = written(
        targets.where("target > 0").select(
            "place", blocks.cast("long").alias("source_size"), F.least(rounds * blocks + rest, blocks * repeat).cast("double").alias("target")
        )
    )
    n = float(needs.agg(F.sum("target").alias("n")).first()["n"] or 0)
    drawn = schedule(needs, 1, n, repeat).select("place", "rank")
    given = drawn.groupBy("place").agg(F.count("*").alias("given"))
    missing = (
        needs.join(given, "place", "left")
        .select("place", "target", F.coalesce("given", F.lit(0)).cast("long").alias("given"))
        .where("given < target")
        .select("place", F.explode(F.sequence("given", F.col("target").cast("long") - 1)).alias("rank"))
    )
    ranks = drawn.unionByName(missing).join(needs, "place").where("rank < target")
    return ranks.groupBy("place", (F.col("rank") % F.col("source_size")).alias("block")).agg(F.count("*").alias("times"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    total: float = TOTAL,
    repeat: int = REPEAT,
    slots: int = SLOTS,
    key_col: str | None = None,
    own_blocks: int | None = None,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per row of ``docs``.

    ``taken`` counts the words of the row in the blocks that the schedule takes,
    repeats included; it is at most ``repeat`` times the size. Null and empty
    texts have size 0 and nothing to take. Null sources are one source, null ids
    are ids like others; rows that agree in id and text share an order. A rerun
    takes the same blocks. Other columns are ignored, but ``key_col`` is copied
    as a last column ``key`` if it is named.

    All sources share one block size, that of ``slots`` blocks in the mix, so a
    source of few blocks can miss its target by a large part of it. With
    ``own_blocks``, a source's blocks have at most that share of its size and of
    its target (one word at least), and every source ends within half a block.
    """
    rows = written(sized(docs, id_col, text_col, source_col, key_col))
    targets = written(source_targets(rows, weights, total, repeat))
    # What the targets sum up to, without rounding on the way.
    words = min(total, repeat) * float(targets.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    block = max(1, math.ceil(words / slots))
    size = F.lit(block).cast("long")
    if own_blocks:
        size = F.greatest(F.lit(1), F.least(size, F.floor(F.least("source_size", "target") / own_blocks).cast("long")))
    targets = targets.withColumn("block_words", size)

    placed = rows.join(targets.select("place", F.col("source").alias("__s"), "source_size", "target", "block_words"), F.col("source").eqNullSafe(F.col("__s"))).withColumn(
        "cell", F.conv(F.substring("shuffle", 1, 6), 16, 10).cast("int") % ORDER_CELLS
    )
    cells = placed.groupBy("place", "cell").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("place", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "cell").orderBy("shuffle").rowsBetween(Window.unboundedPreceding, -1)
    # Stored with a row key, so that all readers see the same rows.
    placed = written(
        placed.join(starts, ["place", "cell"])
        .withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .select("doc_id", "size", "source_size", "target", "place", "block_words", "begin", "key", F.monotonically_increasing_id().alias("row"))
    )
    end, block_of = F.col("begin") + F.col("size"), F.col("block_words")
    pieces = (
        placed.where("size > 0")
        .select("row", "place", "block_words", "begin", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block_of), F.floor((end - 1) / block_of))).alias("block"))
        .select("row", "place", "block", (F.least("end", (F.col("block") + 1) * block_of) - F.greatest("begin", F.col("block") * block_of)).alias("words"))
    )
    if own_blocks:
        draws = own_draws(targets, repeat)
    else:
        draws = schedule(targets, block, words, repeat).groupBy("place", "block").agg(F.count("*").alias("times"))
    taken = pieces.join(draws, ["place", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *(["key"] if key_col else [])
    )
