"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of some tokens of a window, chosen by a fixed mask; the
tokens the mask skips may differ. Every stretch that counts as an overlap,
however its substitutions lie, holds a seed of some mask. The seeds of the
benchmark are a table. Texts give the seeds that a bitmap of bounded size lets
pass, and both sides are joined. Around every hit the two texts are laid side
by side and the best-matching stretch is measured token by token.

Texts never travel: a hit is the digest of a text, an item and a shift, and
what is compared are the token hashes of texts with hits, cut into pieces.
Equal texts share a digest, so copies are compared once. Seeds of very many
texts are dealt over parts, each of which meets the benchmark's rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from scriptorium.llm.common import blocks, content_key, heavy_join, share, shared, text_of, unused
from scriptorium.session import written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
SIMILARITY = 0.8
# No stretch of any length with 0.8 equal tokens, 11 at least, avoids all of these.
MASKS = ((0, 2, 4, 5, 6, 7), (0, 1, 2, 5, 6, 8), (0, 1, 2, 4, 9, 10), (0, 1, 3, 4, 5, 6))
# For items shorter than the window.
SHORT_MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 2, 3, 4, 5), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5), (0, 1, 2, 3, 6))
MIN_TOKENS = len(SHORT_MASKS[0])
# A bitmap has 16 bits for each of its values, and 2 to this power at most; a full one only lets more rows into the join.
MAX_BITS = 26
# Texts are hashed in runs of about so many bytes, and compared in pieces of so many tokens.
RUN = 1 << 20
PIECE = 256
# A seed of very many texts is dealt over at most so many parts, and every item's hashes over so many.
SEED_PARTS = 200
ITEM_PARTS = 16
# Digests of contaminated texts are broadcast up to this number (32 bytes each) and joined beyond it.
MAX_BROADCAST_KEYS = 200_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TOKEN_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a run of lower-case texts, and each text's first token (one more at the end).

    Tokens are runs of ASCII letters and digits and of bytes beyond ASCII.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _TOKEN_BYTE[data]
    before = np.concatenate(([False], inside[:-1]))
    starts_text = offsets[:-1][offsets[:-1] < len(data)]
    before[starts_text] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((~inside[1:], [True]))
    after[starts_text[starts_text > 0] - 1] = True
    ends = np.flatnonzero(inside & after) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))))
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    return _mixed(hashes + (ends - starts).astype(np.uint64) * _MIX), np.searchsorted(starts, offsets)


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed of every window of the mask's span."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, sum(1 << offset for offset in mask), np.uint64)
    for offset in mask:
        total = total * np.uint64(_BASE) + hashes[offset : offset + n]
    return _mixed(total)


def _lowered(texts: pa.Array) -> pa.Array:
    return pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string())


@dataclass
class Bitmap:
    """A set of hashes with false members: each value sets two of ``2 ** bits`` bits, its first and its last ones."""

    bits: int
    words: np.ndarray

    @classmethod
    def of(cls, values: DataFrame, column: str) -> Bitmap:
        """Bits are combined word by word before they reach the driver, so at most ``2 ** MAX_BITS / 64`` words do."""
        n = values.count()
        bits = min(MAX_BITS, max(10, (16 * n).bit_length()))
        bit = F.explode(F.array(F.shiftrightunsigned(column, 64 - bits), F.col(column).bitwiseAND((1 << bits) - 1))).alias("bit")
        found = (
            values.select(bit)
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("set"))
            .toArrow()
        )
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
        return cls(bits, words)

    def has(self, values: np.ndarray) -> np.ndarray:
        def one(bit: np.ndarray) -> np.ndarray:
            return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

        found = one(values >> np.uint64(64 - self.bits))
        found[found] = one(values[found] & np.uint64((1 << self.bits) - 1))
        return found


def _runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: its first row, token hashes, first tokens of its rows (one more at the end), row of every token."""
    for first, last, offsets, data in blocks(_lowered(texts), RUN):
        hashes, starts = tokens(data, offsets)
        yield first, hashes, starts, np.repeat(np.arange(last - first), np.diff(starts))


def _packed(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The hashes between neighbouring bounds as binary values."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(hashes))]
    ).cast(pa.binary())


def item_seeds(items: DataFrame) -> DataFrame:
    """``(seed, item, place, n)``: every seed of the items, its first token's place and the item's tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, starts, row_of in _runs(batch.column(1)):
                sizes = np.diff(starts)
                for mask, for_short in [(m, False) for m in MASKS] + [(m, True) for m in SHORT_MASKS]:
                    seed = seeds(hashes, mask)
                    at = np.arange(len(seed))
                    at = at[row_of[at] == row_of[at + mask[-1]]]
                    if for_short:
                        at = at[sizes[row_of[at]] < WINDOW]
                    rows = row_of[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seed[at].view(np.int64)), batch.column(0).take(pa.array(rows + first)),
                         pa.array((at - starts[rows]).astype(np.int32)), pa.array(sizes[rows].astype(np.int32))],
                        names=["seed", "item", "place", "n"],
                    )

    return items.select("item", "text").mapInArrow(work, "seed long, item long, place int, n int")


def item_hashes(items: DataFrame) -> DataFrame:
    """``(item, own)``: the hashes of an item's tokens, eight bytes each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, starts, _ in _runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(starts) - 1), _packed(hashes, starts)], names=["item", "own"])

    return items.select("item", "text").mapInArrow(work, "item long, own binary")


def text_seeds(texts: DataFrame, listed: Bitmap) -> DataFrame:
    """``(key, seed, place)``: the seeds of the texts that the bitmap has."""
    sent = share(texts.sparkSession, listed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared(sent)
        for batch in batches:
            for first, hashes, starts, row_of in _runs(batch.column(1)):
                for mask in MASKS + SHORT_MASKS:
                    seed = seeds(hashes, mask)
                    at = np.flatnonzero(listed.has(seed))
                    at = at[row_of[at] == row_of[at + mask[-1]]]
                    rows = row_of[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows + first)), pa.array(seed[at].view(np.int64)), pa.array((at - starts[rows]).astype(np.int32))],
                        names=["key", "seed", "place"],
                    )

    return texts.mapInArrow(work, "key binary, seed long, place int")


def text_pieces(texts: DataFrame, keys: Bitmap) -> DataFrame:
    """``(key, piece, hashes)``: token hashes of the texts whose digest the bitmap has, in pieces; copies once."""
    sent = share(texts.sparkSession, keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared(sent)
        for batch in batches:
            kept = batch.filter(pa.array(keys.has(batch.column(2).to_numpy().view(np.uint64))))
            for first, hashes, starts, _ in _runs(kept.column(1)):
                sizes = -(-np.diff(starts) // PIECE)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                pieces = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                bounds = np.append(starts[rows] + pieces * PIECE, starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0).take(pa.array(rows + first)), pa.array(pieces.astype(np.int64)), _packed(hashes, bounds)],
                    names=["key", "piece", "hashes"],
                )

    cut = texts.withColumn("hash", F.xxhash64("key")).mapInArrow(work, "key binary, piece long, hashes binary")
    return cut.groupBy("key", "piece").agg(F.first("hashes").alias("hashes"))


def seed_hits(found: DataFrame, listed: DataFrame) -> DataFrame:
    """``(key, item, n, shift)``, distinct: where an item's first token would be in a text if their equal seeds coincide.

    ``found`` and ``listed`` are stored. Seeds that very many texts have are dealt over parts.
    """
    counts = found.groupBy("seed").agg(F.count("*").alias("m"))
    limit = max(1000, found.count() // 50_000)
    heavy = F.broadcast(counts.where(F.col("m") > limit).select("seed", F.least(F.lit(SEED_PARTS), F.ceil(F.col("m") / limit)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = found.join(heavy, "seed", "left").withColumn("part", F.pmod(F.xxhash64("key", "place"), parts).cast("int")).drop("parts")
    rows = listed.withColumnRenamed("place", "own_place").join(heavy, "seed", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    shift = (F.col("place") - F.col("own_place")).cast("long").alias("shift")
    return dealt.join(rows, ["seed", "part"]).select("key", "item", "n", shift).distinct()


def verified(hits: DataFrame, texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(key, item, matched, first, last)``: the best overlap of every text and item that one of the hits confirms.

    ``hits`` are stored. What a group gathers are the tokens of one item.
    """
    keys = Bitmap.of(hits.select(F.xxhash64("key").alias("hash")).distinct(), "hash")
    end = F.col("shift") + F.col("n")
    spans = hits.withColumn("piece", F.explode(F.sequence(F.floor(F.greatest("shift", F.lit(0)) / PIECE), F.floor((end - 1) / PIECE))))
    begin = F.col("piece") * PIECE
    low, high = F.greatest(F.col("shift"), begin), F.least(end, begin + PIECE)
    part = F.substring("hashes", (8 * (low - begin) + 1).cast("int"), (8 * (high - low)).cast("int"))
    beside = (
        spans.join(text_pieces(texts, keys), ["key", "piece"])
        .groupBy("key", "item", "n", "shift")
        .agg(F.sort_array(F.collect_list(F.struct("piece", part.alias("part")))).alias("pieces"))
        .withColumn("part", F.pmod(F.xxhash64("key"), F.lit(ITEM_PARTS)).cast("int"))
        .join(hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ITEM_PARTS - 1)))), ["item", "part"])
        .select("key", "item", "shift", "n", F.col("pieces.part").alias("pieces"), F.substring("own", (8 * F.greatest(-F.col("shift"), F.lit(0)) + 1).cast("int"), 8 * F.col("n")).alias("own"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            columns = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            for row, (shift, n, pieces, own) in enumerate(zip(*columns, strict=True)):
                text = b"".join(pieces)
                size = min(len(text), len(own)) // 8
                equal = np.frombuffer(text, np.uint64, size) == np.frombuffer(own, np.uint64, size)
                needed = _needed(n)
                if np.count_nonzero(equal) < needed:
                    continue
                matched, first, last = _best_stretch(equal)
                if matched >= needed:
                    rows.append(row)
                    found.append((matched, max(shift, 0) + first, max(shift, 0) + last))
            at = pa.array(rows, pa.int64())
            numbers = np.array(found, np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(3))],
                names=["key", "item", "matched", "first", "last"],
            )

    best = F.max(F.struct("matched", (-F.col("first")).alias("first"), (-F.col("last")).alias("last"))).alias("best")
    return (
        beside.mapInArrow(work, "key binary, item long, matched int, first int, last int")
        .groupBy("key", "item")
        .agg(best)
        .select("key", "item", "best.matched", (-F.col("best.first")).alias("first"), (-F.col("best.last")).alias("last"))
    )


def _best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Matches, first and last place of the longest stretch in which at least SIMILARITY of the tokens agree, ends included."""
    if not equal.any():
        return 0, 0, -1
    # A stretch qualifies if these sum up to zero or more.
    sums = np.concatenate(([0], np.cumsum(np.where(equal, round(1000 * (1 - SIMILARITY)), -round(1000 * SIMILARITY)))))
    # The first place from which the sum to here is not negative.
    begins = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int(np.argmax(np.arange(len(sums)) - begins))
    inside = np.flatnonzero(equal[begins[end] : end]) + begins[end]
    return len(inside), int(inside[0]), int(inside[-1])


def _needed(n_tokens: int) -> float:
    """Matches that make an overlap: those of a similar window, or of a whole item that is shorter."""
    if n_tokens < MIN_TOKENS:
        return math.inf
    return max(MIN_TOKENS, math.ceil(SIMILARITY * min(WINDOW, n_tokens)))


def _prepared(docs: DataFrame, benchmark: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Texts with their digests, the items' seeds and hashes, and the texts' seeds among them."""
    items = written(benchmark.select(text_of("text").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()))
    listed = written(item_seeds(items))
    texts = docs.select(content_key(text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
    return texts, items, listed, written(text_seeds(texts, Bitmap.of(listed.select("seed").distinct(), "seed")))


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``(doc_id, item_id, matched, overlap, similarity, first_token, last_token)``: one row per contaminated row and item.

    A stretch of a text overlaps an item if the two, laid side by side without
    gaps, agree in at least 0.8 of the stretch's tokens and in as many tokens as
    0.8 of 13 (of the whole item, but five at least, if it is shorter). Case and
    ASCII punctuation do not matter. Items of fewer than five tokens, null and
    empty ones among them, overlap with nothing, and so do null and empty
    texts. Repeated items count once, items that share a text each; repeated
    rows each have their rows. Ids may have any type, null included. Empty tables
    give no rows. Whole texts are read, of any length; other columns are ignored.
    """
    own = benchmark.select(F.col(item_col).alias("item_id"), text_of("text").alias("text"))
    texts, items, listed, found = _prepared(docs, own, text_col)
    best = written(verified(written(seed_hits(found, listed)), texts, item_hashes(items)))
    ids = docs.select(F.col(id_col).alias("doc_id"), content_key(text_of(text_col)).alias("key"))
    length = F.col("last") - F.col("first") + 1
    return (
        ids.join(best, "key")
        .join(own.distinct().join(items, "text").select("item", "item_id"), "item")
        .select(
            "doc_id", "item_id", "matched", length.alias("overlap"), (F.col("matched") / length).alias("similarity"),
            F.col("first").alias("first_token"), F.col("last").alias("last_token"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that overlap with no item, all columns kept. See ``find_overlaps``.

    One overlap is enough: first every seed of a text meets a single item that
    has it, then the texts that are left meet all others. Null and empty texts
    stay, repeated rows stay or go together, and an empty benchmark drops nothing.
    """
    texts, items, listed, found = _prepared(docs, benchmark.select("text"), text_col)
    hashes = written(item_hashes(items))
    one = listed.groupBy("seed").agg(F.min(F.struct("item", "place", "n")).alias("one"))
    facts = written(found.groupBy("seed").agg(F.count("*").alias("m")).join(one, "seed").select("seed", "m", "one.item", F.col("one.place").alias("own_place"), "one.n"))
    shift = (F.col("place") - F.col("own_place")).cast("long").alias("shift")
    first = written(heavy_join(found, facts, ["seed"], "m").select("key", "item", "n", shift).distinct())
    known = written(verified(first, texts, hashes).select("key").distinct())
    rest = written(found.join(known, "key", "left_anti"))
    hits = written(seed_hits(rest, listed).join(first, ["key", "item", "n", "shift"], "left_anti"))
    known = written(known.union(verified(hits, texts, hashes).select("key").distinct()))
    key = unused(docs, "__key")
    known = known.withColumnRenamed("key", key)
    if known.count() <= MAX_BROADCAST_KEYS:
        known = F.broadcast(known)
    return docs.withColumn(key, content_key(text_of(text_col))).join(known, key, "left_anti").drop(key).select(docs.columns)
