"""How far the sources of a language lie apart in their use of terms.

The counts are a sparse matrix of groups (a source in a language) by terms. The
divergence of every group from every peer is one row of a product of that matrix
with itself, and is computed row by row: a group scatters its terms through the
term-major index of its peers into a dense accumulator with one cell per peer, so
no pair of postings ever becomes a row. Smoothing gives every absent term a share
as well, so a row does not start from zero: what a term adds when the other side
lacks it depends on its count alone and is added for whole runs of equal counts,
and the scatter replaces that by the exact value where both sides have the term.

Tasks hold one cell each: a tile of groups, a tile of peers, and a slice of the
language's terms. Tiles and slices are dealt by hash, and there are as many as the
size of the language asks for; what cells of the same tiles add is summed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window, functions as F

from scriptorium.llm.common import blocks, text_of
from scriptorium.session import written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

MIN_DOCS = 3
TOP_TERMS = 200
# Groups on one side of a cell, and postings of one cell, on average.
TILE = 256
POSTINGS = 1 << 18
# Shares are counted in parts of this.
WHOLE = 1_000_000_000

_TERM_BYTE = np.zeros(256, bool)
_TERM_BYTE[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The terms of a run of texts in order: their rows, and the terms themselves."""
    inside = _TERM_BYTE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    letters = _LOWER[data[inside]]
    # Every byte inside belongs to the last term that began.
    at = np.append(np.searchsorted(np.flatnonzero(inside), starts), len(letters)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters)))
    return np.searchsorted(offsets, starts, side="right") - 1, found


def _group_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``, pre-aggregated: occurrences, and documents that have the term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.select([0, 1]).to_pylist()
            places: dict[tuple, int] = {}
            group = np.array([places.setdefault((r["lang"], r["source"]), len(places)) for r in names], np.int64)
            langs, sources = (pa.array([p[i] for p in places], pa.string()) for i in (0, 1))
            for first, _, offsets, data in blocks(batch.column(2)):
                row, terms = terms_of(offsets, data)
                if not len(row):
                    continue
                coded = terms.dictionary_encode()
                code, width = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                in_doc, times = np.unique(row * width + code, return_counts=True)
                owner = group[first + in_doc // width] * width + in_doc % width
                cells, back, n_docs = np.unique(owner, return_inverse=True, return_counts=True)
                n = np.bincount(back, weights=times, minlength=len(cells)).astype(np.int64)
                owned = pa.array(cells // width)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(owned), sources.take(owned), coded.dictionary.take(pa.array(cells % width)).cast(pa.string()), pa.array(n), pa.array(n_docs)],
                    names=["lang", "source", "term", "n", "docs"],
                )

    return docs.mapInArrow(work, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str, terms: str) -> str:
    """SQL for ``1 + floor(WHOLE * (count + 1) / (total + terms))`` without overflow."""
    return f"CAST(1 + (CAST({count} + 1 AS DECIMAL(20, 0)) * {WHOLE}BD) div CAST({total} + {terms} AS DECIMAL(20, 0)) AS BIGINT)"


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def cell_rows(
    terms: int, own: np.ndarray, own_term: np.ndarray, own_share: np.ndarray, own_zero: np.ndarray,
    peer: np.ndarray, peer_term: np.ndarray, peer_share: np.ndarray, peer_zero: np.ndarray, n_terms: int,
) -> Iterator[np.ndarray]:
    """For each group the sums over its peers, of ``terms`` absent terms and of the cell's postings.

    Groups and peers are numbered as in ``own_zero`` and ``peer_zero``, the shares of a term that
    they lack; terms of the cell have numbers below ``n_terms``.
    """
    # Term-major index of the peers.
    order = np.argsort(peer_term, kind="stable")
    index_peer, index_share = peer[order], peer_share[order]
    begin = np.searchsorted(peer_term[order], np.arange(n_terms + 1))
    # Runs of equal shares of a peer.
    runs, run_sizes = np.unique(np.stack([peer, peer_share]), axis=1, return_counts=True) if len(peer) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    by_group = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[by_group], np.arange(len(own_zero) + 1))
    for g, zero in enumerate(own_zero):
        mine = by_group[edges[g] : edges[g + 1]]
        term, share = own_term[mine], own_share[mine]
        neither = _gap(zero, peer_zero)
        row = terms * neither
        # The group's terms as if no peer had them, and the peers' terms as if the group had none of them.
        values, sizes = np.unique(share, return_counts=True)
        for part in range(0, len(values), 1024):
            some, often = values[part : part + 1024, None], sizes[part : part + 1024, None]
            row += ((_gap(some, peer_zero[None, :]) - neither) * often).sum(axis=0)
        np.add.at(row, runs[0], (_gap(zero, runs[1]) - neither[runs[0]]) * run_sizes)
        # Terms of both: scatter through the index.
        lengths = begin[term + 1] - begin[term]
        hits = np.repeat(begin[term] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        p, h, q = np.repeat(share, lengths), index_peer[hits], index_share[hits]
        np.add.at(row, h, _gap(p, q) - _gap(p, peer_zero[h]) - _gap(zero, q) + neither[h])
        yield row


_CELL = "lang string, own int, peer int, slice int, side int, source string, zero long, terms long, term string, share long"


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    side = table["side"].to_numpy()
    term = table["term"].combine_chunks().dictionary_encode()
    code = term.indices.to_numpy(zero_copy_only=False)
    absent = table["term"].is_null().to_numpy()
    code = np.where(absent, -1, np.nan_to_num(code)).astype(np.int64)
    zero, share = table["zero"].to_numpy(), table["share"].to_numpy()
    # Absent terms count once per pair, in the first slice.
    terms = table["terms"][0].as_py() if key[3].as_py() == 0 else 0
    sides = []
    for skip in (1, 0):
        rows = np.flatnonzero(side != skip)
        names = table["source"].combine_chunks().take(pa.array(rows)).dictionary_encode()
        number = names.indices.to_numpy().astype(np.int64)
        zeros = np.zeros(len(names.dictionary), np.int64)
        zeros[number] = zero[rows]
        posted = code[rows] >= 0
        sides.append((names.dictionary, number[posted], code[rows][posted], share[rows][posted].astype(np.int64), zeros))
    (own_names, own, own_term, own_share, own_zero), (peer_names, peer, peer_term, peer_share, peer_zero) = sides
    out = list(cell_rows(terms, own, own_term, own_share, own_zero, peer, peer_term, peer_share, peer_zero, len(term.dictionary)))
    n = len(peer_names)
    whole = pa.table({
        "lang": pa.array([key[0].as_py()] * (n * len(out)), pa.string()),
        "source": own_names.take(pa.array(np.repeat(np.arange(len(out)), n))),
        "item": peer_names.take(pa.array(np.tile(np.arange(n), len(out)))),
        "value": pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64()),
    })
    other = np.array([a != b for a in own_names.to_pylist() for b in peer_names.to_pylist()], bool)
    return whole.filter(pa.array(other))


def divergences(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    tile: int = TILE, postings: int = POSTINGS,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: every group against its peers, and the terms it uses more than its language.

    * Null texts, languages and sources are empty ones; texts without terms and
      empty texts add nothing, but their group is listed with all its peers. An
      empty table gives no rows. Repeated rows are documents of their own. Ids
      and other columns, whatever their names, are not read.
    * Terms are runs of ASCII letters and of characters beyond ASCII, A-Z
      lower-cased. A language keeps the terms that ``min_docs`` of its documents have.
    * A share is ``1 + floor(10^9 (count + 1) / (N + V))`` over the V kept terms;
      the divergence of shares p and q is ``floor((p - q)^2 / q)``. All is exact.
    * Part ``pair`` has every other source of the language, with the sum over all
      kept terms; part ``term`` the first ``top`` terms whose share in the group
      exceeds that in the language. Ties go by the bytes of ``item``.
    * Texts are counted run by run and may have any length.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], text_of(text_col).alias("text"))
    counts = written(_group_terms(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = written(
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).drop("docs")
    )
    posted = written(counts.drop("docs").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("terms"))
    sizes = posted.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("own_terms"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.fillna(0, ["group_n", "own_terms", "lang_n", "terms"]))
    posted = posted.join(groups.drop("own_terms"), ["lang", "source"]).withColumn("share", F.expr(_share("n", "group_n", "terms")))

    in_lang = F.expr(_share("total", "lang_n", "terms"))
    above = posted.select("lang", "source", "term", "share", in_lang.alias("q")).where("share > q")
    above = above.select("lang", "source", F.col("term").alias("item"), F.expr("(share - q) * (share - q) div q").alias("value"))
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    most = above.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)

    # Tiles and slices of each language.
    plan = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.sum("own_terms").alias("nnz"))
    plan = plan.withColumn("slices", F.greatest(F.lit(1), F.ceil(2 * F.col("nnz") / (F.col("tiles") * postings))).cast("int"))
    zero = F.expr(f"IF(terms = 0, 1L, {_share('0', 'group_n', 'GREATEST(terms, 1)')})").alias("zero")
    heads = groups.join(plan.drop("nnz"), "lang").select(
        "lang", "tiles", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "source", zero, "terms",
        F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("share"),
    )
    body = posted.join(plan.drop("nnz"), "lang").select(
        "lang", "tiles", F.pmod(F.xxhash64("term"), "slices").cast("int").alias("slice"), "source", zero, "terms", "term", "share",
    )
    mine = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    # Side 0: the group of a row of the product, 1: a peer, 2: both.
    own_side = F.transform(every, lambda o: F.struct(mine.alias("own"), o.alias("peer"), F.when(o == mine, 2).otherwise(0).alias("side")))
    peer_side = F.transform(F.filter(every, lambda o: o != mine), lambda o: F.struct(o.alias("own"), mine.alias("peer"), F.lit(1).alias("side")))
    cells = heads.unionByName(body).select("*", F.explode(F.concat(own_side, peer_side)).alias("cell"))
    cells = cells.select("lang", "cell.own", "cell.peer", "slice", "cell.side", "source", "zero", "terms", "term", "share")
    partial = cells.groupBy("lang", "own", "peer", "slice").applyInArrow(_cell, "lang string, source string, item string, value long")
    pairs = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ordered))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(
        most.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS MATERIALIZED (SELECT lang, sum(n)::BIGINT AS total, count(*) AS v FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY ALL),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
shares AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + v))::BIGINT AS p,
    (1 + 1000000000 * (k.n + 1) // (l.total + v))::BIGINT AS q
  FROM groups JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms)
WHERE rank <= 200
"""
