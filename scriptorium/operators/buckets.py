"""An index on disk that is changed bucket by bucket.

Rows are dealt to buckets by a hash of one column, and buckets are partitions of a
parquet table. A change finds the buckets that hold its slugs or receive its rows,
reads only these, and writes them back by dynamic partition overwrite, so its cost
follows what changes and not the size of the index. Which rows leave is found out on
keys alone and kept as one bit for each row of a file, so rows that stay go from
their old file to the new one without a shuffle. Old files stay until the new
ones are complete; a change that was cut off may be run again with the same result.

``by`` decides which changes stay local: "slug" for single posts, "source_document"
for whole sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from scriptorium.session import tasks_for, written

BUCKET = "bucket"
# Files smaller than this on average are gathered into few when their buckets change.
SMALL_FILE = 1024 * 1024
# Bits of 64 rows each that are sent to all tasks at most; more are joined by file.
MAX_SENT_MARKS = 1 << 18


@dataclass(frozen=True)
class Layout:
    path: str
    by: str = "slug"
    buckets: int = 64

    def bucket(self) -> Column:
        """Upper and lower case share a bucket, as they do when sources are matched."""
        return F.pmod(F.xxhash64(F.lower(F.coalesce(self.by, F.lit("")))), F.lit(self.buckets)).cast("int")

    def deal(self, posts: DataFrame) -> DataFrame:
        """``posts(slug, source_document)`` in tasks of one length, each with slices of a few buckets.

        Their chunks can be written to the buckets where they are made; posts are shuffled, chunks with their vectors are not.
        """
        tasks = tasks_for(posts)
        slices = 4 * -(-tasks // self.buckets)
        return posts.repartition(tasks, self.bucket(), F.pmod(F.hash("slug"), F.lit(slices)))


@dataclass(frozen=True)
class Change:
    """What a change wrote: the buckets, and the rows it put in."""

    buckets: list[int]
    upserted: int


def create_index(rows: DataFrame, layout: Layout, *, dealt: bool = False) -> None:
    """Replace the whole table. It must not be the one ``rows`` are read from.

    ``dealt`` says that the rows are chunks of posts from :meth:`Layout.deal`.
    """
    rows = rows.withColumn(BUCKET, layout.bucket())
    _save(rows if dealt else _gathered(rows), layout, "static")


def _gathered(rows: DataFrame) -> DataFrame:
    """Rebalancing gathers small buckets into few files and splits large ones."""
    return rows.hint("rebalance", BUCKET)


def _save(rows: DataFrame, layout: Layout, mode: str) -> None:
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", mode)
    writer.partitionBy(BUCKET).parquet(layout.path)


def read_index(spark: SparkSession, layout: Layout) -> DataFrame:
    """The rows of the table. Read it again after every change."""
    return spark.read.parquet(layout.path).where("chunk_id IS NOT NULL")


def touched_buckets(index: DataFrame, layout: Layout, slugs: DataFrame, new: DataFrame | None) -> list[int]:
    """Buckets that hold rows of ``slugs`` or receive ``new`` ones, at most ``layout.buckets`` numbers; reads two columns."""
    found = index.join(slugs.select("slug"), "slug", "left_semi").select(BUCKET)
    if new is not None:
        found = found.union(new.select(layout.bucket().alias(BUCKET)))
    return sorted(r[BUCKET] for r in found.distinct().collect())


def _staying(index: DataFrame, gone: DataFrame, new: DataFrame | None) -> DataFrame:
    """Rows of ``index`` that neither ``gone`` slugs nor the chunk ids of ``new`` name."""
    file, row = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    keys = index.select("slug", "chunk_id", file, row)
    leaving = keys.join(gone, "slug", "left_semi").select("__file", "__row")
    if new is not None:
        leaving = leaving.union(keys.join(new.select("chunk_id"), "chunk_id", "left_semi").select("__file", "__row"))
    place, bit = F.floor(F.col("__row") / 64).alias("__place"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__row") % 64).cast("int"))
    marks = written(leaving.groupBy("__file", place).agg(F.bit_or(bit).alias("__leaves")))
    if marks.count() <= MAX_SENT_MARKS:
        marks = F.broadcast(marks)
    placed = index.select("*", file, row).withColumn("__place", place).join(marks, ["__file", "__place"], "left")
    return placed.where(F.coalesce("__leaves", F.lit(0).cast("long")).bitwiseAND(bit) == 0).drop("__file", "__row", "__place", "__leaves")


def _in_small_files(index: DataFrame) -> bool:
    files = index.select("_metadata.file_path", "_metadata.file_size").distinct()
    return (files.agg(F.avg("file_size").alias("size")).first()["size"] or 0) < SMALL_FILE


def change_index(
    spark: SparkSession, layout: Layout, new: DataFrame | None = None, gone: DataFrame | None = None, *, dealt: int | None = None
) -> Change:
    """Drop all rows of the slugs in ``gone``, then put in ``new``, replacing rows with the same ``chunk_id``.

    Run twice with the same input, the result is the same. Columns that ``new``
    lacks are null in its rows; it must not have others than the table.
    ``dealt`` says that ``new`` is a stored table of so many chunks of posts from :meth:`Layout.deal`.
    """
    index = read_index(spark, layout)
    nothing = spark.createDataFrame([], "slug string")
    gone = nothing if gone is None else written(gone.select("slug").distinct())
    upserted = dealt or 0
    if new is not None and dealt is None:
        seen = Observation()
        new = written(new.observe(seen, F.count(F.lit(1)).alias("rows")))
        upserted = seen.get["rows"]
    slugs = gone if new is None else gone.union(new.select("slug")).distinct()
    touched = touched_buckets(index, layout, slugs, new)
    if not touched:
        return Change([], 0)
    held = index.where(F.col(BUCKET).isin(touched))
    rows = _staying(held, gone, new)
    small = _in_small_files(held)
    if new is not None:
        put = new.withColumn(BUCKET, layout.bucket())
        rows = rows.unionByName(put if small or dealt is not None else _gathered(put), allowMissingColumns=True)
    # A row without a chunk keeps a bucket that lost all of its rows from being left as it was.
    marks = spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
    rows = rows.unionByName(marks, allowMissingColumns=True)
    _save(_gathered(rows) if small else rows, layout, "dynamic")
    return Change(touched, upserted)
