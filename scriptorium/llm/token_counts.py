"""Token counts behind a cache of digests.

A count is stored under the digest of the normalised content and the digest of
the tokenizer's vocabulary file. Only distinct contents without a stored count
are encoded, and their counts are appended to the cache, so a second run over
the same or a grown corpus encodes what is new.
"""

from __future__ import annotations

import sys
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.common import content_key, text_of
from scriptorium.session import shared_folder, written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

CACHE_SCHEMA = "version string, content binary, n_tokens long"
# Texts handed to the library at once.
_ENCODE_ROWS = 64


def tokenizer_version(model_path: str) -> str:
    """The digest of the vocabulary file."""
    with open(model_path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def encoder(model_path: str):
    """``texts -> counts`` for a .json (tokenizers) or .model (sentencepiece) file, without added tokens."""
    if model_path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)

        def count(texts: list[str]) -> list[int]:
            return [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(model_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def count(texts: list[str]) -> list[int]:
            return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return count


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts. Appending no rows first makes a new folder a readable, empty table."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def count_tokens(
    docs: DataFrame,
    model_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    * The normalised content of a null is the empty text, of others the text
      itself: the libraries are sensitive to every other change.
    * Whole texts are encoded, none is cut. Empty texts count what the library
      says. Copies are encoded once. Ids are only copied, other columns ignored.
    * ``cache_path`` is a folder that all executors reach. The vocabulary file
      must lie at ``model_path`` on every machine.
    """
    spark = docs.sparkSession
    version = tokenizer_version(model_path)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn(
        "content", content_key(F.col("text"))
    )
    stored = read_cache(spark, cache_path).where(F.col("version") == version).select("content", "n_tokens").distinct()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(model_path)
        for batch in batches:
            counts: list[int] = []
            for start in range(0, batch.num_rows, _ENCODE_ROWS):
                counts += count(batch.column(1).slice(start, _ENCODE_ROWS).to_pylist())
            names = ["version", "content", "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * batch.num_rows, pa.string()), pc.cast(batch.column(0), pa.binary()), pa.array(counts, pa.int64())],
                names=names,
            )

    # Copies meet on the map side; contents without a stored count go to the encoder once each.
    contents = keyed.groupBy("content").agg(F.first("text").alias("text"))
    misses = contents.join(stored.select("content"), "content", "left_anti")
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    # Stored, so that the join below reads two tables and adaptive execution can split the rows of a content with many copies.
    counted = written(
        read_cache(spark, cache_path).where(F.col("version") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    )
    sizes = keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counted, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def private_cache(spark: SparkSession) -> str:
    """A new cache folder next to the tables of this job."""
    return f"{shared_folder(spark)}/token_cache/{uuid.uuid4().hex}"
