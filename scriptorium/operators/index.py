"""Index rows: payload, sparse and dense vectors, upsert.

An index is one row per chunk: scalar payload, ``sparse`` as
``array<struct<term, w>>`` and ``dense`` as ``array<float>``. Both vectors are
computed inside the row of their chunk, so building an index shuffles nothing.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions.rules import inline_strings
from scriptorium.functions.text import let, null_if_empty, word_list
from scriptorium.operators import chunking
from scriptorium.operators.tagging import ENTITY_TYPES, tag_entities
from scriptorium.operators.validate import media_list, split_valid, validate_posts, validate_required
from scriptorium.session import written

# Task functions travel with their code, so that workers need not have this package.
register_pickle_by_value(sys.modules[__name__])

DENSE_DIM = 64


# --- payloads -------------------------------------------------------------------

def _timestamp(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


# Who news posts are for, and where they come from.
_AUDIENCE = ["Trainees", "Stakeholders"]


def news_payload(chunks: DataFrame, *, version: str = "1.0", ingested_at: Column | None = None) -> DataFrame:
    """One row of 39 fields per chunk.

    ``chunks`` carries the columns of its post and the entity arrays, so no join
    is needed; ``ingest_posts`` shows how they get there.
    """
    def given(name: str, default: str | None = None) -> Column:
        value = null_if_empty(F.col(name)) if name in chunks.columns else F.lit(None).cast("string")
        return value if default is None else F.coalesce(value, F.lit(default))

    empty = F.array().cast("array<string>")
    page = F.when(F.col("source_page") != 0, F.col("source_page")) if "source_page" in chunks.columns else F.lit(None).cast("int")
    return chunks.select(
        F.col("slug").alias("article_id"),
        "chunk_id",
        given("title").alias("title"),
        "slug",
        F.when(F.col("slug") != "", F.concat(F.lit("posts/"), F.col("slug"))).alias("url"),
        F.lit("news_archive").alias("source_type"),
        F.lit("news_post").alias("content_type"),
        "chunk_index",
        "chunk_type",
        given("heading_path").alias("heading_path"),
        "chunk_text",
        "word_count",
        given("summary").alias("summary"),
        _timestamp(F.col("date")).alias("date"),
        F.when(F.col("year") != 0, F.col("year")).alias("year"),
        given("quarter").alias("quarter"),
        F.month("date").alias("month"),
        given("category").alias("category"),
        F.coalesce("tags", empty).alias("tags"),
        given("partner").alias("partner"),
        given("location").alias("location"),
        inline_strings(_AUDIENCE).alias("audience"),
        given("featured_image").alias("featured_image"),
        media_list(F.col("featured_image"), F.col("gallery_images")).alias("image_names"),
        given("language", "en").alias("language"),
        given("status", "approved").alias("status"),
        given("visibility", "public").alias("visibility"),
        F.lit(True).alias("published"),
        given("source_document").alias("source_document"),
        given("source_section").alias("source_section"),
        page.alias("source_page_start"),
        page.alias("source_page_end"),
        F.lit(version).alias("version"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
        *[F.coalesce(f"entities_{t}", empty).alias(f"entities_{t}") for t in ENTITY_TYPES],
    )


def knowledge_payload(chunks: DataFrame, *, ingested_at: Column | None = None) -> DataFrame:
    """One row of 22 fields per chunk of a knowledge document."""
    empty = F.array().cast("array<string>")
    return chunks.select(
        F.col("slug").alias("doc_id"),
        "chunk_id",
        null_if_empty(F.col("title")).alias("title"),
        "slug",
        null_if_empty(F.col("knowledge_type")).alias("knowledge_type"),
        null_if_empty(F.col("heading_path")).alias("section"),
        "chunk_index",
        chunking.map_chunk_type(F.col("chunk_type"), F.col("heading_path")).alias("chunk_type"),
        "chunk_text",
        null_if_empty(F.col("priority")).alias("priority"),
        F.coalesce(null_if_empty(F.col("language")), F.lit("en")).alias("language"),
        F.coalesce(null_if_empty(F.col("status")), F.lit("approved")).alias("status"),
        F.coalesce("published", F.lit(True)).alias("published"),
        F.coalesce(null_if_empty(F.col("memory_layer")), F.lit("knowledge")).alias("memory_layer"),
        "source_file",
        "word_count",
        *[F.coalesce(f"entities_{t}", empty).alias(f"entities_{t}") for t in ENTITY_TYPES],
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
    )


# --- vectors --------------------------------------------------------------------

def term_counts(text: Column, stop_words: list[str] | None = None) -> Column:
    """``array<struct<term, tf>>`` of a text, in term order.

    Words are sorted and then counted as runs, which takes one sort per text
    instead of a shuffle of all words of the corpus.
    """
    words = word_list(text)
    if stop_words:
        stops = inline_strings(stop_words)
        words = F.filter(words, lambda w: ~F.array_contains(stops, w))

    def runs(ws: Column) -> Column:
        starts = F.filter(
            F.transform(ws, lambda w, i: F.when((i == 0) | (F.get(ws, i - 1) != w), i)), lambda i: i.isNotNull()
        )
        return let(
            starts,
            lambda at: F.transform(
                at,
                lambda s, k: F.struct(
                    F.get(ws, s).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ws)) - s).alias("tf")
                ),
            ),
        )

    return let(F.sort_array(words), runs)


# Defaults of k, b and the usual length of a chunk in words.
_SATURATION = (1.2, 0.75, 256.0)


def sparse_vector(counts: Column, *, k: float = _SATURATION[0], b: float = _SATURATION[1], avg_len: float = _SATURATION[2]) -> Column:
    """``array<struct<term, w>>`` with saturated term frequencies, from :func:`term_counts`; no stemming."""
    def weigh(counts: Column) -> Column:
        length = F.aggregate(counts, F.lit(0), lambda n, c: n + c["tf"]).cast("double")

        def weights(n: Column) -> Column:
            norm = F.lit(k) * (F.lit(1.0 - b) + F.lit(b) * n / F.lit(avg_len))
            return F.transform(
                counts,
                lambda c: F.struct(c["term"].alias("term"), (c["tf"] * F.lit(k + 1.0) / (c["tf"] + norm)).alias("w")),
            )

        return let(length, weights)

    return let(counts, weigh)


def sparse_long(index: DataFrame, idf: bool = False) -> DataFrame:
    """``(chunk_id, term, w)``; with ``idf`` rare terms weigh more."""
    long = index.select("chunk_id", F.explode_outer("sparse").alias("s")).where("s IS NOT NULL").select("chunk_id", "s.term", "s.w")
    if not idf:
        return long
    frequencies = long.groupBy("term").agg(F.count("*").alias("df"))
    total = index.agg(F.count("*").alias("n"))
    rare = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = frequencies.withColumn("n", total.scalar()).select("term", rare.alias("idf"))
    return long.join(weighted, "term").select("chunk_id", "term", (F.col("w") * F.col("idf")).alias("w"))


def hashed_vector(counts: Column) -> Column:
    """Unit vector of hashed term frequencies, for corpora without vectors of their own.

    The hash is the start of each term's md5, the same in every engine.
    """
    def bucket(term: Column) -> Column:
        return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % DENSE_DIM).cast("int")

    hashed = F.array_sort(F.transform(counts, lambda c: F.struct(bucket(c["term"]).alias("b"), c["tf"].alias("w"))))

    def sums(pairs: Column) -> Column:
        """Equal buckets lie together: each pair is visited as part of its run, not once per bucket."""
        starts = F.filter(
            F.transform(pairs, lambda p, i: F.when((i == 0) | (F.get(pairs, i - 1)["b"] != p["b"]), i)), lambda i: i.isNotNull()
        )

        def run(at: Column, s: Column, k: Column) -> Column:
            members = F.slice(pairs, s + 1, F.coalesce(F.get(at, k + 1), F.size(pairs)) - s)
            return F.aggregate(members, F.lit(0.0), lambda acc, p: acc + p["w"])

        def by_bucket(at: Column) -> Column:
            filled = F.struct(F.transform(at, lambda s: F.get(pairs, s)["b"]).alias("b"), F.transform(at, lambda s, k: run(at, s, k)).alias("v"))
            places = F.sequence(F.lit(0), F.lit(DENSE_DIM - 1))
            # A place that no run has is 0, one before the first.
            return let(filled, lambda f: F.transform(places, lambda b: F.coalesce(F.get(f["v"], (F.array_position(f["b"], b) - 1).cast("int")), F.lit(0.0))))

        return let(starts, by_bucket)

    def scaled(values: Column) -> Column:
        norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v))
        return let(norm, lambda n: F.transform(values, lambda v: F.when(n > 0, v / n).otherwise(0.0).cast("float")))

    return let(let(hashed, sums), scaled)


def add_hashed_vectors(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("dense", hashed_vector(term_counts(F.col(text))))


def with_vectors(chunks: DataFrame, vectors: DataFrame | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """Add ``sparse`` and ``dense``; supplied ``vectors(chunk_id, dense)`` replace hashed ones.

    Words are cut and counted once for both kinds, a batch of chunks at a time.
    """
    words = word_list(F.col("chunk_text"))
    if stop_words:
        stops = inline_strings(stop_words)
        words = F.filter(words, lambda w: ~F.array_contains(stops, w))
    if vectors is not None:
        sparse = chunks.withColumn("sparse", sparse_vector(term_counts(F.col("chunk_text"), stop_words)))
        return sparse.join(vectors.select("chunk_id", "dense"), "chunk_id", "left")
    both = F.arrow_udf(_both_vectors, _BOTH_VECTORS)(words)
    return chunks.withColumn("__both", both).withColumns({"sparse": F.col("__both.sparse"), "dense": F.col("__both.dense")}).drop("__both")


_BOTH_VECTORS = "struct<sparse:array<struct<term:string,w:double>>,dense:array<float>>"


def _both_vectors(words: pa.Array) -> pa.Array:
    """:func:`sparse_vector` and :func:`hashed_vector` of the :func:`term_counts` of a batch of word lists.

    Sums are those of whole numbers, so both ways give the same values to the last bit.
    """
    k, b, avg_len, rows = *_SATURATION, len(words)
    lengths = pa.compute.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    terms = coded.dictionary
    order = pa.compute.array_sort_indices(terms)
    rank = np.empty(len(terms), np.int64)
    rank[order.to_numpy()] = np.arange(len(terms))
    # One number for each pair of row and term, in row and term order.
    pairs = np.repeat(np.arange(rows, dtype=np.int64), lengths) * max(len(terms), 1) + rank[coded.indices.to_numpy()]
    distinct, tf = np.unique(pairs, return_counts=True)
    row, term = np.divmod(distinct, max(len(terms), 1))
    norm = k * ((1.0 - b) + b * lengths.astype(np.float64) / avg_len)
    w = tf * (k + 1.0) / (tf + norm[row])
    terms = terms.take(order)
    starts = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=starts[1:])
    sparse = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([terms.take(pa.array(term)), pa.array(w)], ["term", "w"]), mask=words.is_null())

    buckets = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % DENSE_DIM for t in terms.to_pylist()], np.int64)
    sums = np.bincount(row * DENSE_DIM + buckets[term], weights=tf, minlength=rows * DENSE_DIM).astype(np.float64).reshape(rows, DENSE_DIM)
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    dense = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0).astype(np.float32)
    places = pa.array(np.arange(rows + 1, dtype=np.int32) * DENSE_DIM)
    return pa.StructArray.from_arrays([sparse, pa.ListArray.from_arrays(places, pa.array(dense.ravel()))], ["sparse", "dense"])


# --- upsert ----------------------------------------------------------------------

def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``. Losers are dropped before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(index: DataFrame, new: DataFrame, key: str = "chunk_id", order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``index`` with the same key; the rest is added.

    Within ``new`` the first row by ``order`` wins.
    """
    incoming = new if order is None else latest(new, key, order)
    return index.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete_by_slugs(index: DataFrame, slugs: DataFrame) -> DataFrame:
    return index.join(slugs.select("slug"), "slug", "left_anti")


def count_for_slugs(index: DataFrame, slugs: DataFrame) -> DataFrame:
    return index.join(slugs.select("slug"), "slug", "left_semi").agg(F.count("*").alias("n_chunks"))


def rebuild_index(rows: DataFrame, path: str) -> None:
    """Replace the table at ``path``. It must not be the table ``rows`` are read from."""
    rows.write.mode("overwrite").partitionBy("language").parquet(path)


def live_view(index: DataFrame, name: str) -> None:
    """Make ``name`` mean this table from now on."""
    index.createOrReplaceTempView(name)


# --- ingest ------------------------------------------------------------------------

# Columns of a post that its chunks carry into the index.
_CARRIED = (
    "title", "summary", "date", "year", "quarter", "category", "tags", "partner", "location", "featured_image",
    "gallery_images", "language", "status", "visibility", "source_document", "source_section", "source_page",
)


def slug_order(posts: DataFrame) -> list[Column]:
    """Of posts with the same slug the last by source and section comes first."""
    return [F.desc(c) for c in ("source_document", "section_no") if c in posts.columns]


def one_per_slug(posts: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One post per slug, the last by source and section or by ``order``; ties by content.

    Only posts whose slug repeats are shuffled, unless very many slugs repeat.
    """
    content = F.sha2(F.to_json(F.struct("*")), 256)
    repeated = written(posts.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").select("slug"))
    if repeated.isEmpty():
        return posts
    chosen = latest(posts.join(repeated, "slug", "left_semi").withColumn("__content", content), "slug", [*(order or slug_order(posts)), F.asc("__content")])
    return posts.join(repeated, "slug", "left_anti").unionByName(chosen.drop("__content"))


def superseded(posts: DataFrame) -> DataFrame:
    """``(slug, n_superseded)``: how many posts :func:`one_per_slug` leaves out."""
    return posts.groupBy("slug").agg((F.count("*") - 1).alias("n_superseded")).where("n_superseded > 0")


def ingest_posts(
    posts: DataFrame, dictionary: DataFrame, *, vectors: DataFrame | None = None, one_each: bool = False, **checks: bool
) -> tuple[DataFrame, DataFrame]:
    """``(index rows, failed posts)``. Posts are tagged once and chunked in place.

    Of valid posts with the same slug one is indexed, so chunk ids are unique.
    ``one_each`` says that no slug repeats, which spares the search for those that do.
    """
    valid, failed = split_valid(validate_posts(posts, **checks))
    tagged = tag_entities(valid if one_each else one_per_slug(valid), dictionary)
    carried = tuple(c for c in _CARRIED if c in posts.columns) + tuple(f"entities_{t}" for t in ENTITY_TYPES)
    chunks = chunking.make_chunks(tagged, *chunking.NEWS_LIMITS, keep=carried)
    rows = with_vectors(news_payload(chunks), vectors)
    return rows.withColumn("id", chunking.stable_id(F.col("chunk_id"))), failed


def ingest_knowledge(docs: DataFrame, dictionary: DataFrame, *, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(index rows, failed documents)`` for knowledge documents."""
    checked = validate_required(docs.withColumn("summary", F.coalesce("summary", F.lit(""))) if "summary" in docs.columns else docs.withColumn("summary", F.lit("")))
    valid, failed = split_valid(checked)
    carried = ("title", "knowledge_type", "priority", "language", "status", "published", "memory_layer", "source_file")
    tagged = tag_entities(one_per_slug(valid), dictionary)
    chunks = chunking.make_chunks(tagged, *chunking.KNOWLEDGE_LIMITS, keep=carried + tuple(f"entities_{t}" for t in ENTITY_TYPES))
    rows = with_vectors(knowledge_payload(chunks), vectors)
    return rows.withColumn("id", chunking.stable_id(F.col("chunk_id"))), failed


def ingest_counters(posts: DataFrame, rows: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: posts loaded, valid and failed, chunks produced, and points upserted (distinct ids)."""
    loaded = posts.agg(F.count("*").alias("loaded"))
    lost = failed.agg(F.count("*").alias("failed"))
    made = rows.agg(F.count("*").alias("chunks_produced"))
    ids = rows.agg(F.countDistinct("id").alias("points_upserted"))
    return loaded.select(
        "loaded",
        (F.col("loaded") - lost.scalar()).alias("valid"),
        lost.scalar().alias("failed"),
        made.scalar().alias("chunks_produced"),
        ids.scalar().alias("points_upserted"),
    )
