"""Helpers that several operators of this package share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scriptorium.session import shared_folder, stored, written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

# ASCII white space; everything else belongs to a word.
SPACE = rb" \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; the fold of a null id is that of an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def content_key(text: Column) -> Column:
    """32 bytes that stand for a text."""
    return F.unhex(F.sha2(text, 256))


def blocks(texts: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of at most ``limit`` bytes (or one longer text).

    Yields first row, row behind the last, offsets of the rows in the run, and
    the bytes of the run. Bounds the memory of vectorized work on a batch.
    """
    if not len(texts):
        return
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offset_buffer, data_buffer = raw.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(raw):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(raw))
        yield first, last, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def unused(docs: DataFrame, name: str) -> str:
    """``name``, longer if ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def share(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a model of bounded size, code of its class included; ``shared`` reads it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(sent: Broadcast) -> object:
    return cloudpickle.loads(sent.value)


class Scratch:
    """Stored tables of one job that are emptied when their last reader is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []
        self.folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        self.paths.append(path)
        return stored(df, path)

    def empty(self) -> None:
        """Write tables without rows over them; what read them must have been computed."""
        for path in self.paths:
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)
        self.paths = []


def components(edges: DataFrame) -> DataFrame:
    """Connected components as ``(node, root)``, root being the least node; nodes without edges are absent.

    ``edges`` has long columns ``a`` and ``b``. Alternates the large-star and
    small-star steps until the edges no longer change. Minima are combined on
    the map side, and both sides of every join are stored tables, so adaptive
    execution can split the rows of a hub.
    """
    current = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    state = None
    while True:
        now = current.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if (now["n"], now["x"]) == state or not now["n"]:
            break
        state = (now["n"], now["x"])
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(current.select("lo", "hi"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(
            both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")))
        joined = large.join(least, "hi")
        current = written(
            joined.where("lo > m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select("hi", "m"))
            .distinct()
        )
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)


def heavy_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, least: int = 1000, sort: bool = False) -> DataFrame:
    """``rows`` inner-joined to ``facts``, which has one row per ``keys`` and in ``weight`` the number of rows that have them.

    Rows of heavy keys stay where they are and meet a broadcast: with a limit of
    a 50 000th of all rows there are at most 50 000 such keys. Both sides are stored tables.
    With ``sort`` the other facts are never broadcast, so the plan is the same at every size.
    """
    total = facts.agg(F.sum(weight).alias("n")).first()["n"] or 0
    limit = max(least, total // 50_000)
    heavy = facts.where(F.col(weight) > limit).drop(weight)
    light = facts.where(F.col(weight) <= limit).drop(weight)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light.hint("merge") if sort else light, keys))
