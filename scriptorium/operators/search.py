"""Filtered hybrid search for many queries at once.

Queries are a table. Dense and sparse scores are computed batch by batch inside
the tasks that read the index, which keep a running best per query; what is
shuffled is at most ``k`` rows per query and task, never all scored pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.operators.index import add_hashed_vectors, term_counts
from scriptorium.operators.validate import live_prefilter, payload_filter
from scriptorium.session import written

# Task functions travel with their code, so that workers need not have this package.
register_pickle_by_value(sys.modules[__name__])

# Query vectors handled by one pass over the index, in bytes.
QUERY_BLOCK_BYTES = 32 * 1024 * 1024

# Result size, candidates per result, and lowest fused score.
DEFAULT_LIMIT = 8
CANDIDATES_PER_RESULT = 3
DEFAULT_THRESHOLD = 0.15

_HIT_SCHEMA = "query_id bigint, chunk_id string, score double"


def top_k(scored: DataFrame, k: int, key: str = "query_id", ident: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows per key by score, then ident, with ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), ident))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, index: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` for ``queries(query_id, dense)``.

    ``metric`` is cosine, dot or euclid (negated distance). Queries go through
    the index in blocks of a bounded size, one pass each; however many there
    are, every pair is scored.
    """
    vectors = queries.where("dense IS NOT NULL").select(_query_id(), "dense")
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("dense")).alias("d")).first()
    candidates = index.where("dense IS NOT NULL").select("chunk_id", "dense")
    n_blocks = -(-shape["n"] * 8 * (shape["d"] or 1) // QUERY_BLOCK_BYTES)

    def score_block(block: DataFrame) -> tuple[DataFrame, Broadcast]:
        rows = block.collect()
        ids = np.array([r["query_id"] for r in rows], dtype=np.int64)
        matrix = np.array([r["dense"] for r in rows], dtype=np.float64)
        shared = candidates.sparkSession.sparkContext.broadcast((ids, matrix))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, query_matrix = shared.value
            best = _Best(query_ids, k)
            for batch in batches:
                for part in _slices(batch, _MATRIX_CELLS // max(1, len(query_ids))):
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    best.add_matrix(part.column(0), similarity(query_matrix, flat.reshape(part.num_rows, -1), metric))
            yield from best.batches()

        return candidates.mapInArrow(score, _HIT_SCHEMA), shared

    return _over_blocks(vectors, n_blocks, score_block, candidates, k)


# Scores held at once by a task.
_MATRIX_CELLS = 1_000_000


def _query_id() -> Column:
    return F.col("query_id").cast("bigint").alias("query_id")


def _over_blocks(
    rows: DataFrame, n_blocks: int, score_block: Callable[[DataFrame], tuple[DataFrame, Broadcast]], candidates: DataFrame, k: int
) -> DataFrame:
    """Score query rows in ``n_blocks`` blocks of whole queries and keep the best over all.

    One block is in memory at a time: its best hits are written and its
    broadcast is dropped before the next one is collected.
    """
    if n_blocks <= 0:
        return top_k(candidates.sparkSession.createDataFrame([], _HIT_SCHEMA), k)
    if n_blocks == 1:
        return top_k(score_block(rows)[0], k)
    rows, found = written(rows), None
    for b in range(n_blocks):
        scored, shared = score_block(rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b))
        part = written(top_k(scored, k))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, rows)
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


# Hits that a task collects before it cuts them down to the best.
_BUFFER = 250_000


class _Best:
    """The ``k`` best chunks per query seen by one task, by score, then chunk.

    Hits below the ``k``-th best score so far are dropped at once. The rest is
    collected and merged now and then, so the work per hit does not depend on
    the number of queries.
    """

    def __init__(self, query_ids: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.edge = np.full(len(query_ids), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.limit = 0, max(_BUFFER, 4 * k * len(query_ids))

    def add_matrix(self, chunks: pa.Array, scores: np.ndarray) -> None:
        """``scores`` has a row per query and a column per chunk; every pair is a hit."""
        edge = self.edge
        if scores.shape[1] > self.k and np.isinf(edge).any():
            edge = np.maximum(edge, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        query, column = np.nonzero(scores >= edge[:, None])
        self.add(chunks, query, column, scores[query, column])

    def add(self, chunks: pa.Array, query: np.ndarray, column: np.ndarray, score: np.ndarray) -> None:
        """Hits as places of queries, places of ``chunks`` and scores, each pair once."""
        good = score >= self.edge[query]
        query, column, score = query[good], column[good], score[good]
        if len(query):
            names = np.array(chunks.to_pylist(), dtype=object)
            self.parts.append((query, names[column], score))
            self.held += len(query)
            if self.held > self.limit:
                self._merge()

    def _merge(self) -> None:
        if not self.parts:
            return
        query, chunk, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        name = np.unique(chunk.astype(str), return_inverse=True)[1]
        order = np.lexsort((name, -score, query))
        query, chunk, score = query[order], chunk[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last = place == self.k - 1
        self.edge[query[last]] = score[last]
        kept = place < self.k
        self.parts, self.held = [(query[kept], chunk[kept], score[kept])], int(kept.sum())

    def batches(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for query, chunk, score in self.parts:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.query_ids[query], type=pa.int64()),
                    pa.array(chunk.tolist(), type=pa.string()),
                    pa.array(score, type=pa.float64()),
                ],
                names=["query_id", "chunk_id", "score"],
            )


def similarity(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Scores rounded to 6 places, so that equal vectors score equally in any batch."""
    products = queries @ vectors.T
    if metric == "dot":
        return np.round(products, 6)
    if metric == "cosine":
        lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
        return np.round(np.divide(products, lengths, out=np.zeros_like(products), where=lengths > 0), 6)
    if metric == "euclid":
        squares = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None, :] - 2 * products
        return -np.round(np.sqrt(np.maximum(squares, 0)), 6)
    raise ValueError(f"unknown metric {metric!r}")


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term)``: the distinct words of each query, all of weight 1."""
    words = F.transform(term_counts(F.col("query")), lambda c: c["term"])
    return queries.select(_query_id(), F.explode_outer(words).alias("term")).where("term IS NOT NULL")


def sparse_topk(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` for ``queries(query_id, query)``.

    A task looks the terms of its chunks up among the query terms and adds their
    weights per query. Chunks that share no term with a query are no hits.
    """
    terms = written(query_terms(queries))
    postings = index.where("sparse IS NOT NULL").select("chunk_id", F.col("sparse.term").alias("terms"), F.col("sparse.w").alias("weights"))
    n_blocks = -(-terms.count() * 32 // QUERY_BLOCK_BYTES)

    def score_block(block: DataFrame) -> tuple[DataFrame, Broadcast]:
        rows = block.toPandas()
        shared = postings.sparkSession.sparkContext.broadcast(_inverted(rows["query_id"].to_numpy(), rows["term"].to_numpy()))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, vocabulary, starts, members = shared.value
            best, known = _Best(query_ids, k), pa.array(vocabulary, type=pa.string())
            for batch in batches:
                for part in _slices(batch, _MATRIX_CELLS // max(1, len(query_ids))):
                    best.add(part.column(0), *_added_weights(part, known, starts, members))
            yield from best.batches()

        return postings.mapInArrow(score, _HIT_SCHEMA), shared

    return _over_blocks(terms, n_blocks, score_block, postings, k)


def _inverted(query_ids: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Query ids, sorted terms, and per term the positions of the queries that have it."""
    ids, query = np.unique(query_ids.astype(np.int64), return_inverse=True)
    vocabulary, term = np.unique(terms.astype(str), return_inverse=True)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    return ids, vocabulary.tolist(), starts, query[order]


# Query-term matches expanded at once by a task.
_MATCHES = 1_000_000


def _added_weights(part: pa.RecordBatch, known: pa.Array, starts: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, chunks and summed weights of the pairs that share a term; other pairs cost nothing."""
    lists = part.column(1)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    chunk = np.repeat(np.arange(part.num_rows), sizes)
    found = pc.index_in(lists.flatten(), value_set=known)
    hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
    term = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
    chunk, weight = chunk[hit], part.column(2).flatten().to_numpy(zero_copy_only=False)[hit]
    # A cell for each pair of query and chunk: weights are added where they belong, nothing is sorted.
    sums = np.zeros((int(members.max(initial=-1)) + 1) * part.num_rows)
    counts = starts[term + 1] - starts[term]
    ends = np.cumsum(counts)
    low = 0
    while low < len(term):
        base = ends[low] - counts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + _MATCHES, side="right")))
        n = counts[low:high]
        offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        query = members[np.repeat(starts[term[low:high]], n) + offsets]
        np.add.at(sums, query * part.num_rows + np.repeat(chunk[low:high], n), np.repeat(weight[low:high], n))
        low = high
    sums = np.round(sums, 6)
    cells = np.flatnonzero(sums > 0)
    return cells // part.num_rows, cells % part.num_rows, sums[cells]


def rrf_fuse(ranked: list[DataFrame], limit: int, threshold: float = 0.0) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (2 + rank from 0) over all lists.

    The threshold applies to the fused score; 0 means none.
    """
    n = len(ranked)
    parts = [
        df.select("query_id", "chunk_id", *[(F.col("rank") if i == k else F.lit(None)).cast("int").alias(f"r{k}") for k in range(n)])
        for i, df in enumerate(ranked)
    ]
    lists = parts[0]
    for more in parts[1:]:
        lists = lists.unionByName(more)
    # A chunk counts once per list, by its best rank there.
    best = [F.coalesce(F.lit(1.0) / (F.min(f"r{k}") + 1), F.lit(0.0)) for k in range(n)]
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(sum(best[1:], best[0]), 6).alias("score"))
    if threshold > 0:
        fused = fused.where(F.col("score") >= threshold)
    return top_k(fused, limit)


def hybrid_search(
    queries: DataFrame,
    index: DataFrame,
    *,
    limit: int = DEFAULT_LIMIT,
    candidates: int | None = None,
    threshold: float = 0.0,
    where: Column | None = None,
    metric: str = "cosine",
) -> DataFrame:
    """Fused ``(query_id, chunk_id, score, rank)`` for ``queries(query_id, query, dense)``.

    ``where`` narrows the index before candidates are taken. Texts and other wide
    columns stay out; join them to the hits with :func:`with_payload`.
    """
    candidates = candidates or limit * CANDIDATES_PER_RESULT
    searched = index if where is None else index.where(where)
    dense = dense_topk(queries, searched, candidates, metric)
    sparse = sparse_topk(queries, searched, candidates)
    return rrf_fuse([dense, sparse], limit, threshold)


def embed_queries(queries: DataFrame) -> DataFrame:
    """Add hashed ``dense`` vectors like those of an index without its own."""
    return add_hashed_vectors(queries, "query")


def retrieve(
    queries: DataFrame, index: DataFrame, *, limit: int | None = None, threshold: float | None = None, live: bool = True, **filters: object
) -> DataFrame:
    """Search with the default limit, candidates, threshold and live filter.

    A threshold of 0.0 is kept; None takes the default.
    """
    limit = limit or DEFAULT_LIMIT
    threshold = DEFAULT_THRESHOLD if threshold is None else threshold
    where = live_prefilter(**filters) if live else payload_filter(**filters)
    return hybrid_search(queries, index, limit=limit, threshold=threshold, where=where)


def with_payload(hits: DataFrame, index: DataFrame, *columns: str) -> DataFrame:
    """Add index columns to hits. Hits are few; the index is read once, only these columns."""
    wanted = index.select("chunk_id", *[c for c in columns if c != "chunk_id"])
    return hits.join(wanted, "chunk_id")
