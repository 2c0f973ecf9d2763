"""SimHash near-duplicates found by covering locality-sensitive hashing.

Every fingerprint enters one table per mask. The masks are built so that any two
fingerprints within the radius agree under at least one of them: bit ``i`` gets
a nonzero vector of radius + 1 bits, and mask ``v`` holds the bits whose vector
has odd parity with ``v``. The differing bits span at most ``radius``
dimensions, so some ``v`` is orthogonal to all of their vectors, and that mask
sees none of them. No pair within the radius is missed, at any size.

Crowded table cells are not compared pair by pair. Two fingerprints of a cell
that differ in at most two bits have a neighbour in common that differs from
each in at most one of the bits the mask leaves free; fingerprints that share a
neighbour are linked with the least of them, which keeps all components.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.common import blocks, components, text_of, unused
from scriptorium.session import written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

BITS = 64
SEED = 42
# Cells with more fingerprints than this are linked through shared neighbours.
PAIR_LIMIT = 64


def _bit_majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``counts`` hashes; a bit is set if over half of the run has it."""
    result = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return result
    sizes = counts[full]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Byte lanes hold sums of up to 255 rows, so runs are cut into pieces of that size.
    pieces = -(-sizes // 255)
    first_piece = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    of_run = np.repeat(np.arange(len(full)), pieces)
    piece_starts = starts[of_run] + (np.arange(len(of_run)) - first_piece[of_run]) * 255
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, piece_starts)
        per_run = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_piece, axis=0)
        for byte in range(8):
            set_bits = per_run[:, byte] * 2 > sizes
            result[full[set_bits]] |= np.uint64(1) << np.uint64(8 * byte + bit)
    return result


def text_fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """Unsigned fingerprints of a batch of texts."""
    out = []
    digest = xxhash.xxh64_intdigest
    for first, last, offsets, data in blocks(texts):
        raw = data.tobytes().lower() if len(data) else b""
        hashes: list[int] = []
        counts = np.zeros(last - first, np.int64)
        for row, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            words = raw[start:stop].split()
            if not words:
                continue
            joined = b" ".join(words)
            if len(words) <= shingle:
                hashes.append(digest(joined, SEED))
                counts[row] = 1
                continue
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            begins = [0, *ends[:-shingle].tolist()]
            stops = (ends[shingle - 1 :] - 1).tolist()
            hashes += [digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)]
            counts[row] = len(begins)
        out.append(_bit_majorities(np.array(hashes, np.uint64), counts))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, key, fp)`` for every row; ``fp`` holds the 64 bits as a signed long, ``key`` stands for id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = text_fingerprints(batch.column(2), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    return picked.mapInArrow(work, "doc_id long, key binary, fp long")


def _row_key(id_col: str, text_col: str) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text_of(text_col))))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks, unsigned: one per nonzero vector of ``radius + 1`` bits."""
    vectors = 2 ** (radius + 1) - 1
    of_bit = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (v & of_bit[i]).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _long(value: int) -> Column:
    return F.lit(_signed(value)).cast("long")


def covering_links(nodes: DataFrame, radius: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links ``(a, b)`` among the distinct ``fp`` of ``nodes`` that keep all components of "within ``radius`` bits".

    Cells of at most ``pair_limit`` fingerprints give every close pair; larger
    ones give a star per shared neighbour. ``radius`` is 0 or 2.
    """
    if radius == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a != b")
    if radius != 2:
        raise ValueError("a neighbour between two fingerprints exists for a radius of 2")
    masks = covering_masks(radius)
    entries = F.array(*[
        F.struct(F.lit(i).cast("int").alias("t"), F.col("fp").bitwiseAND(_long(mask)).alias("cell")) for i, mask in enumerate(masks)
    ])
    tables = nodes.select("fp", F.explode(entries).alias("e")).select("fp", "e.t", "e.cell")
    crowds = written(tables.groupBy("t", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    members = written(tables.join(crowds, ["t", "cell"]))

    few = members.where(F.col("n") <= pair_limit)
    left = few.select("t", "cell", F.col("fp").alias("a"))
    right = few.select("t", "cell", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["t", "cell"]).where((F.col("a") < F.col("b")) & close).select("a", "b")

    flips = F.array(*[
        F.array(*[_long(1 << i) for i in range(BITS) if not mask >> i & 1], _long(0)) for mask in masks
    ])
    around = (
        members.where(F.col("n") > pair_limit)
        .select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
        .distinct()
    )
    hubs = around.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(hubs, "near").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def _labelled(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """``(doc_id, key, fp, root, component_id)`` for every row."""
    prints = written(fingerprints(docs, id_col, text_col))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(covering_links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted)
    names = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    labels = written(rooted.select("fp", "root").join(names, "root"))
    return prints.join(labels, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    * Words are what ASCII white space separates, with A-Z lower-cased; shingles
      have three words and repeats count. A text of fewer words is one shingle.
      Null, empty and white texts have the fingerprint zero and are linked like
      any other.
    * Equal fingerprints are one node, so copies are never compared.
    * ``component_id`` is the least non-null id of the component, null if it has
      none. Repeated ids and rows stay as they are. Other columns are ignored.
    """
    return _labelled(docs, id_col, text_col, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` with one row of every component: that of the least id, null ids first; all columns kept."""
    chosen = (
        _labelled(docs, id_col, text_col, radius)
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "key")).alias("first"))
        .select(F.col("first.key").alias(key := unused(docs, "__key")))
    )
    # Rows that agree in id and text meet on the way, and one of them stays.
    keyed = docs.withColumn(key, _row_key(id_col, text_col))
    return keyed.join(written(chosen), key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
