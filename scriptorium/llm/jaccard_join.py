"""Documents linked by the Jaccard similarity of their word shingles, by T-occurrence search.

A document can only be linked if nearly all of its shingles occur in other documents.
So shingles are first counted: every run of texts sends short hashes to buckets, and
what comes back is how many shingles of each document are known elsewhere. Documents
that pass are collapsed to classes of equal sets, counted once more among these, and
get exact inverted lists.

Classes that share a rare shingle at positions that leave room for enough others meet
in blocks. A search in a block is DivideSkip: the query's longest inverted lists are
set aside, the short ones are merged by a heap, and what occurs often enough there is
probed by binary search in the long ones, until it has the overlap that its size asks for.

Components need no links within a component. Under every rare shingle all classes
first meet the one with the fewest shingles of its own (in a group of near copies,
their original); only classes that then lie in another component than it are compared
with the other classes of that shingle. No pair of different components is left out.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.common import blocks, components, heavy_join, share, shared, text_of
from scriptorium.llm.decontamination import Bitmap
from scriptorium.session import written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

WORDS = 4
PERCENT = 85
# Hashes that one bucket counts, on average.
BUCKET = 1 << 21
# Texts of one run; their numbers have 16 bits.
MOST_ROWS = 1 << 16
# Bytes of a run that are cut into shingles at a time.
CUT_BYTES = 1 << 20
# Shingles of the classes that one block holds, on average.
BLOCK = 1 << 20
# How much dearer a step of the heap is than one of a binary search; decides how many lists are long.
MU = 0.01

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a run as 64-bit hashes: row and hash, sorted by both."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = solid[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letters = np.ascontiguousarray(_LOWER[data[solid]])
    at = np.append(np.searchsorted(np.flatnonzero(solid), starts), len(letters)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    word = known[coded.indices.to_numpy()]
    row = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    # A shingle starts at every word with enough words behind it; a short text is one shingle.
    left = (np.cumsum(n_words))[row] - np.arange(len(row))
    span = np.minimum(n_words[row], width)
    head = np.flatnonzero(left >= span)
    head = head[(n_words[row[head]] >= width) | (left[head] == n_words[row[head]])]
    span = span[head]
    hashes = _mixed(span.astype(np.uint64) * _ODD)
    for i in range(width):
        more = span > i
        hashes[more] = _mixed((hashes[more] ^ word[head[more] + i]) * _ODD + np.uint64(i + 1))
    owner = row[head]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))
    return owner[new], hashes[new]


def _runs(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """Per run of texts: first row, rows, where each row's hashes begin, the hashes, and a digest of each set."""
    for part in range(0, len(texts), MOST_ROWS):
        rows = texts.slice(part, MOST_ROWS)
        for first, last, _, _ in blocks(rows):
            cut = [(at, shingle_sets(offsets, data, width)) for at, _, offsets, data in blocks(rows.slice(first, last - first), CUT_BYTES)]
            row, hashes = np.concatenate([at + r for at, (r, _) in cut]), np.concatenate([h for _, (_, h) in cut])
            edges = np.searchsorted(row, np.arange(last - first + 1))
            raw = hashes.tobytes()
            digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield part + first, last - first, edges, hashes, digests


def _longs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def set_prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(doc_id, text_hash, set_a, set_b, n)`` for every row: 128 bits that stand for its set, and the size of that."""
    schema = docs.select(id_col).schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, edges, _, digests in _runs(batch.column(2), width):
                longs = _longs(digests)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(longs[:, 0]), pa.array(longs[:, 1]), pa.array(np.diff(edges))],
                    names=["doc_id", "text_hash", "set_a", "set_b", "n"],
                )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    return picked.mapInArrow(work, f"doc_id {schema}, text_hash long, set_a long, set_b long, n long")


_SENT = "run binary, bucket int, sets binary, members binary, counts binary, hashes binary, shared binary, rows int"
# Bytes of a hash within its bucket.
REST = 3


def _run_rows(keys: np.ndarray, edges: np.ndarray, hashes: np.ndarray, bits: int) -> Iterator[tuple]:
    """Rows of ``_SENT`` for at most 65 536 sets: a head, and the set members of each bucket with their hashes."""
    keys, pick = np.unique(keys, return_index=True)
    sizes = np.diff(edges)[pick]
    keys, pick, sizes = keys[sizes > 0], pick[sizes > 0], sizes[sizes > 0]
    if not len(pick):
        return
    own = np.concatenate([hashes[edges[i] : edges[i + 1]] for i in pick.tolist()])
    owner = np.repeat(np.arange(len(pick)), sizes)
    _, back, times = np.unique(own, return_inverse=True, return_counts=True)
    single = times[back] == 1
    # What sets of the run share is known already, and other runs need it once.
    local = np.bincount(owner[~single], minlength=len(pick))
    shared = np.unique(own[~single])
    lone, lone_owner = own[single], owner[single]
    order = np.lexsort((lone_owner, _bucket(lone, bits)))
    lone, lone_owner = lone[order], lone_owner[order]
    at, shared_at = _bucket(lone, bits), _bucket(shared, bits)
    buckets = np.unique(np.concatenate((at, shared_at)))
    run = hashlib.blake2b(keys.tobytes(), digest_size=16).digest()
    yield run, -1 - int(keys[0] % max(1024, 1 << bits)), keys.tobytes(), b"", local.astype(np.int64).tobytes(), b"", b"", len(buckets)
    for b in buckets.tolist():
        x, y = np.searchsorted(at, [b, b + 1])
        members, counts = np.unique(lone_owner[x:y], return_counts=True)
        i, j = np.searchsorted(shared_at, [b, b + 1])
        yield run, b, b"", members.astype(np.uint16).tobytes(), _packed(counts), _cut(lone[x:y], bits), _cut(shared[i:j], bits), 0


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _cut(hashes: np.ndarray, bits: int) -> bytes:
    rest = (hashes >> np.uint64(64 - bits - 8 * REST)).astype("<u4")
    return rest.view(np.uint8).reshape(-1, 4)[:, :REST].tobytes()


def _uncut(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // REST, 4), np.uint8)
    wide[:, :REST] = np.frombuffer(raw, np.uint8).reshape(-1, REST)
    return wide.view("<u4").ravel()


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint16 if not len(counts) or counts.max() < 1 << 16 else np.uint32).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) > 2 * n else np.uint16).astype(np.int64)


def _count_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """How many hashes of each member are in the bucket more than once; heads pass through."""
    rows = table.to_pylist()
    if key[0].as_py() < 0:
        return table.select(["run", "sets", "members", "counts", "rows"])
    members = [np.frombuffer(r["members"], np.uint16) for r in rows]
    counts = [_unpacked(r["counts"], len(m)) for r, m in zip(rows, members, strict=True)]
    lone = [_uncut(r["hashes"]) for r in rows]
    whole = np.concatenate(lone)
    ordered = np.sort(whole)
    # Cut hashes are few enough for a table of them.
    often = np.zeros(1 << 8 * REST, bool)
    often[ordered[1:][ordered[1:] == ordered[:-1]]] = True
    for r in rows:
        often[_uncut(r["shared"])] = True
    again = often[whole]
    out, at = [], 0
    for m, c, h in zip(members, counts, lone, strict=True):
        known = np.bincount(np.repeat(np.arange(len(m)), c)[again[at : at + len(h)]], minlength=len(m))
        at += len(h)
        out.append((m[known > 0].tobytes(), _packed(known[known > 0])))
    return pa.table({
        "run": table["run"], "sets": pa.array([b""] * len(rows), pa.binary()), "members": pa.array([o[0] for o in out], pa.binary()),
        "counts": pa.array([o[1] for o in out], pa.binary()), "rows": table["rows"],
    })


def _sum_run(key: tuple, table: pa.Table) -> pa.Table:
    """The sums over the buckets of a run. Equal runs have equal rows.

    A run of which rows are missing, because a task that was lost read its rows in another order, lets all of its sets pass.
    """
    rows = table.to_pylist()
    heads = [r for r in rows if r["sets"]]
    if not heads:
        return pa.table({"set_a": pa.array([], pa.int64()), "known": pa.array([], pa.int64())})
    sets = np.frombuffer(heads[0]["sets"], np.int64)
    if len(rows) != len(heads) * (1 + heads[0]["rows"]):
        return pa.table({"set_a": sets, "known": np.full(len(sets), 1 << 40)})
    known = np.zeros(len(sets), np.int64)
    for r in rows:
        if not r["sets"]:
            members = np.frombuffer(r["members"], np.uint16)
            known[members] += _unpacked(r["counts"], len(members))
    return pa.table({"set_a": sets, "known": known // len(heads) + np.frombuffer(heads[0]["counts"], np.int64)})


def _known_shingles(runs: DataFrame) -> DataFrame:
    """``(set_a, known)`` from rows of ``_SENT``: at least as many as the set's shingles that other texts have.

    Hashes are cut within their bucket, which can only raise the numbers. A shingle of
    several sets of a run is sent once, so a frequent one is not many entries, and what
    comes back for a run and a bucket is one row.
    """
    counted = runs.groupBy("bucket").applyInArrow(_count_bucket, "run binary, sets binary, members binary, counts binary, rows int")
    return counted.groupBy("run").applyInArrow(_sum_run, "set_a long, known long").groupBy("set_a").agg(F.max("known").alias("known"))


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), *[pa.binary()] * 5, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _SENT.split(", ")])


def _text_runs(docs: DataFrame, text_col: str, width: int, bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, edges, hashes, digests in _runs(batch.column(0), width):
                rows = list(_run_rows(_longs(digests)[:, 0], edges, hashes, bits))
                if rows:
                    yield _sent(rows)

    return docs.select(text_of(text_col).alias("text")).mapInArrow(work, _SENT)


def _class_runs(classes: DataFrame, bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), MOST_ROWS):
                part = batch.slice(at, MOST_ROWS)
                lists = part.column(1)
                edges = lists.offsets.to_numpy().astype(np.int64)
                hashes = lists.values.to_numpy().view(np.uint64)[edges[0] : edges[-1]]
                rows = list(_run_rows(part.column(0).to_numpy(), edges - edges[0], hashes, bits))
                if rows:
                    yield _sent(rows)

    return classes.select("set_a", "hashes").mapInArrow(work, _SENT)


def _bits(total: int | None, bucket: int) -> int:
    return ((total or 0) // bucket).bit_length()


def t_occurrence(query: int, tokens: list[np.ndarray], index: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """The documents of a block whose overlap with ``query`` reaches the threshold, by DivideSkip.

    ``index`` holds where the inverted list of each token begins and the lists one after the other;
    ``tokens`` are numbered, ``sizes`` are those of the whole sets.
    """
    begin, postings = index
    size = sizes[query]
    fits = (percent * sizes <= 100 * size) & (percent * size <= 100 * sizes)
    fits[query] = False
    if not fits.any():
        return np.zeros(0, np.int64)
    needed = -(-percent * (size + sizes) // (100 + percent))
    least = int(needed[fits].min())
    own = tokens[query]
    lengths = begin[own + 1] - begin[own]
    own, lengths = own[lengths > 1], lengths[lengths > 1]
    if len(own) < least:
        return np.zeros(0, np.int64)
    own = own[np.argsort(lengths, kind="stable")]
    n_long = min(least - 1, int(least / (MU * np.log2(lengths.max()) + 1)))
    lists = [postings[begin[t] : begin[t + 1]] for t in own.tolist()]
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    found, counts = [], []
    for doc, run in groupby(heapq.merge(*[s.tolist() for s in short])):
        times = sum(1 for _ in run)
        if times >= least - n_long and fits[doc]:
            found.append(doc)
            counts.append(times)
    docs, hits = np.array(found, np.int64), np.array(counts, np.int64)
    for done, probed in enumerate(long):
        alive = hits + (n_long - done) >= needed[docs]
        docs, hits = docs[alive], hits[alive]
        if not len(docs):
            break
        at = np.minimum(np.searchsorted(probed, docs), len(probed) - 1)
        hits = hits + (probed[at] == docs)
    return docs[hits >= needed[docs]]


def block_links(ids: list[int], sizes: np.ndarray, hashes: list[np.ndarray], percent: int, all_queries: bool) -> list[tuple[int, int]]:
    """Links within a block, whose first member is its hub.

    Those of the hub; with ``all_queries`` also those of every member that is not in the hub's component by then.
    """
    owner = np.repeat(np.arange(len(ids)), [len(h) for h in hashes])
    names, code = np.unique(np.concatenate(hashes), return_inverse=True)
    order = np.argsort(code, kind="stable")
    begin = np.searchsorted(code[order], np.arange(len(names) + 1))
    tokens = np.split(code, np.cumsum([len(h) for h in hashes])[:-1])
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for query in range(len(ids) if all_queries else 1):
        if query and root(query) == root(0):
            continue
        for doc in t_occurrence(query, tokens, (begin, owner[order]), sizes, percent).tolist():
            links.append((ids[query], ids[doc]))
            parent[root(doc)] = root(query)
    return links


def _search(members: DataFrame, classes: DataFrame, percent: int, all_queries: bool) -> DataFrame:
    """Links ``(a, b)`` found in the blocks ``(hub, chunk)`` of ``members (hub, chunk, id)``; hubs are members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, np.ndarray]] = []
        at, out = None, []

        def close() -> None:
            if len(block) > 1:
                # The hub comes first.
                block.sort(key=lambda m: (m[0] != at[0], m[0]))
                out.extend(block_links([m[0] for m in block], np.array([m[1] for m in block]), [m[2] for m in block], percent, all_queries))
            block.clear()

        for batch in batches:
            hubs, chunks, ids, sizes = (batch.column(i).to_pylist() for i in range(4))
            for i, key in enumerate(zip(hubs, chunks, strict=True)):
                if key != at:
                    close()
                    at = key
                block.append((ids[i], sizes[i], batch.column(4)[i].values.to_numpy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*out, strict=True)], names=["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*out, strict=True)], names=["a", "b"])

    rows = members.join(classes.select("id", "n", "tokens"), "id")
    dealt = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk").select("hub", "chunk", "id", "n", "tokens")
    return dealt.mapInArrow(work, "a long, b long")


def _blocks(pairs: DataFrame, block: int) -> DataFrame:
    """``(hub, chunk, id)``: the partners ``id`` of size ``n`` of each hub in blocks of about ``block`` shingles, the hub in each."""
    pairs = written(pairs)
    plan = written(pairs.groupBy("hub").agg(F.count("*").alias("rows_"), F.ceil(F.sum("n") / block).cast("int").alias("chunks")))
    chunked = heavy_join(pairs, plan, ["hub"], "rows_").select("hub", F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("chunk"), "id")
    hubs = plan.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("id"))
    return chunked.union(hubs)


def _room(percent: int, n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether two sets with a common shingle at these positions, and none before, can be similar enough."""
    needed = F.ceil((n + m) * percent / (100 + percent))
    return (F.greatest(n, m) * percent <= F.least(n, m) * 100) & (F.least(n - pos, m - at) + 1 >= needed)


def similar_classes(classes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """``(node, root)``: components of the classes ``(id, n, hashes)`` that have links to others."""
    occurrences = written(classes.select("id", "n", F.explode("hashes").alias("h")))
    lists = written(occurrences.groupBy("h").agg(F.count("*").alias("often")).where("often > 1"))
    rare_first = F.sort_array(F.collect_list(F.struct("often", "h")))
    common = heavy_join(occurrences, lists.withColumn("rows_", F.col("often")), ["h"], "rows_", sort=True).groupBy("id", "n").agg(rare_first.alias("found"))
    ordered = common.select("id", "n", F.col("found.h").alias("tokens")).where(F.size("tokens") * 100 >= F.col("n") * percent)
    ordered = written(ordered.withColumn("alone", F.col("n") - F.size("tokens")))
    # Shingles that no other class has come first; they are not in the lists, but count as positions.
    prefix = F.expr(f"n - ((n * {percent} + 99) div 100) + 1 - alone").cast("int")
    firsts = ordered.select("id", "n", "alone", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(prefix, F.lit(0)))).alias("i", "h"))
    firsts = written(firsts.select("h", "id", "n", "alone", (F.col("alone") + F.col("i") + 1).alias("pos")))
    hubs = firsts.groupBy("h").agg(F.count("*").alias("rows_"), F.min(F.struct("alone", "id", "n", "pos")).alias("hub")).where("rows_ > 1")
    hubs = written(hubs.select("h", "rows_", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")))
    starred = written(heavy_join(firsts, hubs, ["h"], "rows_"))
    near_hub = _room(percent, F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"))
    stars = starred.where((F.col("id") != F.col("hub")) & near_hub).select("hub", "id", "n").distinct()
    links = written(_search(_blocks(stars, block), ordered, percent, all_queries=True))

    rooted = written(components(links).select(F.col("node").alias("id"), "root"))
    roots = ordered.select("id").join(rooted, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    placed = starred.select("h", "id", "n", "pos", "hub").join(roots, "id")
    placed = written(placed.join(roots.withColumnRenamed("id", "hub").withColumnRenamed("root", "hub_root"), "hub"))
    # Whoever met the hub is done with it; whoever shares its component needs no link to others of that component.
    apart = placed.where("root != hub_root").select("h", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("root").alias("x_root"))
    others = placed.where("id != hub")
    both = apart.join(others, "h").where(
        (F.col("root") != F.col("x_root")) & _room(percent, F.col("n"), F.col("pos"), F.col("x_n"), F.col("x_pos"))
        # Pairs of which neither shares the hub's component come twice.
        & ((F.col("root") == F.col("hub_root")) | (F.col("x") < F.col("id")))
    )
    more = _search(_blocks(both.select(F.col("x").alias("hub"), "id", "n").distinct(), block), ordered, percent, all_queries=False)
    return components(written(links.union(more)))


def offered(texts: DataFrame, passed: DataFrame) -> DataFrame:
    """``(text, text_hash)``: the ``texts`` that may be among those ``passed (text_hash)``, so that only these are shuffled.

    The bitmap is of bounded size; a full one only lets more texts into the join.
    """
    sent = share(texts.sparkSession, Bitmap.of(passed, "text_hash"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared(sent)
        for batch in batches:
            yield batch.filter(pa.array(listed.has(batch.column(1).to_numpy().view(np.uint64))))

    return texts.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(work, "text string, text_hash long")


def jaccard_groups(
    docs: DataFrame, percent: int = PERCENT, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    * Words are what ASCII white space separates, with A-Z lower-cased; the set holds
      the distinct shingles of ``width`` words, or all words as one if they are fewer.
      Shingles are compared by 64-bit hashes.
    * Documents link when their intersection is ``percent`` hundredths of their union
      or more. ``component_id`` is the least non-null id that links reach, null if
      there is none. Null, empty and white texts have no shingles and no links, so
      their own id. Repeated ids and rows stay rows; rows with equal sets are linked.
    * Texts of any length are read whole. An empty table gives no rows. Other columns,
      whatever their names, are not read.
    """
    prints = written(set_prints(docs, id_col, text_col, width))
    sets = written(
        prints.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.min("text_hash").alias("text_hash"), F.max("n").alias("n"))
    )
    bits = _bits(sets.agg(F.sum("n").alias("n")).first()["n"], bucket)
    known = _known_shingles(_text_runs(docs, text_col, width, bits))
    # A set without a number counts as known.
    enough = F.coalesce(F.col("known") * 100 >= F.col("n") * percent, F.lit(True))
    passed = written(sets.join(known, "set_a", "left").where(enough).select("text_hash"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, edges, hashes, digests in _runs(batch.column(0), width):
                longs = _longs(digests)
                lists = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(longs[:, 0]), pa.array(longs[:, 1]), pa.array(np.diff(edges)), lists.cast(pa.list_(pa.int64()))], names=["set_a", "set_b", "n", "hashes"]
                )

    texts = offered(docs.select(text_of(text_col).alias("text")), passed).join(passed, "text_hash", "left_semi").select("text")
    full = texts.mapInArrow(work, "set_a long, set_b long, n long, hashes array<long>").where("n > 0").dropDuplicates(["set_a", "set_b"])
    classes = written(full.withColumn("id", F.monotonically_increasing_id()))
    # Once more without copies, which know all shingles of each other.
    known = _known_shingles(_class_runs(classes, _bits(classes.agg(F.sum("n").alias("n")).first()["n"], bucket)))
    passed = written(classes.select("set_a", "id", "n").join(known, "set_a", "left").where(enough).select("id"))
    roots = similar_classes(classes.select("id", "n", "hashes").join(passed, "id", "left_semi"), percent, block)
    linked = classes.select("set_a", "set_b", "id").join(roots.withColumnRenamed("node", "id"), "id").select("set_a", "set_b", "root")
    rooted = written(sets.join(linked, ["set_a", "set_b"]))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = rooted.join(firsts, "root").select("set_a", "set_b", "component_id")
    named = sets.join(of_set, ["set_a", "set_b"], "left").select("set_a", "set_b", F.coalesce("component_id", "first_id").alias("component_id"), "copies")
    found = heavy_join(prints.where("n > 0").drop("text_hash"), written(named), ["set_a", "set_b"], "copies")
    bare = prints.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(bare.select("doc_id", "n", "component_id"))


SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [md5(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END AS s FROM words),
sizes AS MATERIALIZED (SELECT r, doc_id, len(s) AS n FROM sets),
shingles AS MATERIALIZED (SELECT r, unnest(s) AS h FROM sets),
links AS MATERIALIZED (
  SELECT x.r AS a, y.r AS b FROM (SELECT p.r AS x_, q.r AS y_, count(*) AS both_ FROM shingles p JOIN shingles q ON p.h = q.h AND p.r <> q.r GROUP BY ALL)
  JOIN sizes x ON x.r = x_ JOIN sizes y ON y.r = y_ WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
reach AS (SELECT r AS a, r AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
firsts AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN sizes ON r = b GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM sizes JOIN firsts ON a = r
"""
