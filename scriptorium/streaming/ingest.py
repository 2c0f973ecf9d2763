"""Incremental ingest: new post files are indexed as they arrive.

The same ingest as for a whole corpus, run on each batch of new files. A batch
that is run again writes the same rows, because its directory is named after
the batch and readers keep the latest row per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.index import ingest_posts, latest


def stream_posts(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Posts appearing as JSON lines files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest_stream(posts: DataFrame, dictionary: DataFrame, index_path: str, checkpoint: str) -> StreamingQuery:
    """Index everything that has arrived so far, then stop."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows, failed = ingest_posts(batch, dictionary)
        rows.write.mode("overwrite").parquet(f"{index_path}/rows/batch={batch_id}")
        failed.write.mode("overwrite").json(f"{index_path}/failed/batch={batch_id}")

    return posts.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    """The current index: of chunks that came more than once, the row of the last batch."""
    rows = spark.read.parquet(f"{index_path}/rows")
    newest = rows.groupBy("slug").agg(F.max("batch").alias("batch"))
    return latest(rows.join(newest, ["slug", "batch"], "left_semi"), "chunk_id", [F.desc("batch")]).drop("batch")
