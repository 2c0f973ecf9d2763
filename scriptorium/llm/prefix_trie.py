"""The prefix trie of conversations, from weighted whole sequences.

Conversations are rebuilt as rows and read in order, which gives every prefix a
chained digest. Conversations with the same last digest are one sequence with a
weight and a list of ends; from there on only one representative of each sequence
is looked at. A sequence whose digest is a proper prefix of another one is dropped
by an anti-join, the rest are the leaves. Sums of weights over the prefixes of the
sequences give the nodes.

What a subtree saves needs no walk over the trie. Every node is owned by the
sequence with the least conversation that passes through it; a sequence owns the
nodes from some depth on. So the bytes of the nodes below a node are sums, over
the sequences that pass through it, of the bytes that each of them owns below.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.llm.common import heavy_join, text_of
from scriptorium.session import written

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])

# Conversations in blocks of FAMILY share the first turns of the block's first one, fewer than HEAD of them.
FAMILY = 5
HEAD = 9
# Characters of a list of ends that one row holds.
PIECE = 1 << 16
NODE = ["node_a", "node_b"]

_ROOT = hashlib.sha256(b"").digest()[:16]


def _item(role: Column, text: Column) -> Column:
    """32 bytes that stand for a turn's role and text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, item, size)``: the turns of each conversation, numbered from 1; null turns first, ties by ``item``."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _item(text_of("role"), text_of("text")).alias("item"),
        F.octet_length(text_of("text")).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "item")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "item", "size")


def rebuilt(turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """``(conv_id, part, pos, item, size)``: a row of part 0 for each conversation, then the turns it takes over and its own ones."""
    h = F.crc32(F.col("conv_id").cast("string")) % head
    convs = turns.select("conv_id").distinct()
    none = F.lit(None).cast("binary")
    heads = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), none.alias("item"), F.lit(0).cast("long").alias("size"))
    first = turns.where(F.col("pos") < head).withColumnRenamed("conv_id", "donor")
    wanted = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("donor"), h.alias("h"))
    taken = first.join(wanted, "donor").where("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "item", "size")
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(2).alias("part"), "pos", "item", "size")
    return heads.union(taken).union(own)


def chained(rows: DataFrame) -> DataFrame:
    """``(conv_id, depth, node_a, node_b, parent_a, parent_b, size, upto, last)``: every prefix of every rebuilt conversation.

    A node is 128 bits of a chained sha256; ``upto`` sums the sizes of the prefix.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, depth, upto = None, _ROOT, 0, 0
        # The last row waits for the next one, which tells whether it ends its conversation.
        held: list[tuple] = []

        def block(rows: list[tuple], ends: list[bool]) -> pa.RecordBatch:
            ids, depths, nodes, parents, sizes, sums = zip(*rows, strict=True)
            longs = [np.frombuffer(b"".join(side), ">i8").astype(np.int64).reshape(-1, 2) for side in (nodes, parents)]
            root = pa.array(np.array(depths) == 0)
            columns = [pa.array(ids, pa.int64()), pa.array(depths, pa.int64())]
            columns += [pa.array(longs[0][:, 0]), pa.array(longs[0][:, 1])]
            columns += [pa.array(longs[1][:, i], mask=root.to_numpy(zero_copy_only=False)) for i in (0, 1)]
            columns += [pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(ends, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "depth", *NODE, "parent_a", "parent_b", "size", "upto", "last"])

        for batch in batches:
            for c, item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != conv:
                    conv, node, depth, upto = c, _ROOT, 0, 0
                    held.append((c, 0, _ROOT, _ROOT, 0, 0))
                else:
                    parent, depth, upto = node, depth + 1, upto + size
                    node = hashlib.sha256(parent + item).digest()[:16]
                    held.append((c, depth, node, parent, size, upto))
            if len(held) > 1:
                yield block(held[:-1], [a[0] != b[0] for a, b in zip(held, held[1:], strict=False)])
                held = held[-1:]
        if held:
            yield block(held, [True])

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "item", "size")
    schema = "conv_id long, depth long, node_a long, node_b long, parent_a long, parent_b long, size long, upto long, last boolean"
    return dealt.mapInArrow(work, schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(node_a, node_b, ends_sha256)``: sha256 of the ascending ids of each node, joined by commas.

    The ids of one node are cut into pieces wherever they lie after a global sort; the
    pieces, not the ids, come together, and are hashed one by one.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            cuts = np.unique(np.concatenate((cuts, np.arange(0, len(ids) + 1, PIECE // 20), [len(ids)])))
            begin, stop = cuts[:-1], cuts[1:]
            texts = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(b[begin]), pa.array(ids[begin]), pa.array(texts, pa.string())], names=[*NODE, "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []

        def block() -> pa.RecordBatch:
            a, b, shas = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shas, pa.string())], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for a, b, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (a, b) != at:
                    if at is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.as_py().encode())
            if done:
                yield block()
        if at is not None:
            done.append((*at, digest.hexdigest()))
            yield block()

    cut = ends.select(*NODE, "conv_id").orderBy(*NODE, "conv_id").mapInArrow(pieces, "node_a long, node_b long, first long, piece string")
    dealt = cut.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "piece")
    return dealt.mapInArrow(hashes, "node_a long, node_b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    * Rows without ``conv_id`` belong to no conversation and are left out. Null
      turns come first; turns that tie (repeated rows as well) all stay, in the
      order of a digest of role and text. Null role or text is an empty one.
    * Conversation c takes the first h turns of conversation ``c - c % family``
      (none if it is absent), h being crc32 of c modulo ``head``, then its own
      turns after the first h. A conversation that ends up without turns is a
      member of the root alone.
    * An empty table gives no rows, not even a root. Other columns, whatever
      their names, are not read. Texts of any length count by a digest;
      conversations of any length are read row by row.
    """
    turns = written(turns_of(conversations))
    chain = written(chained(rebuilt(turns, family, head)))
    ends = chain.where("last")
    sequences = written(
        ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("upto").alias("whole"))
    )
    members = written(chain.join(sequences.select("conv_id"), "conv_id", "left_semi"))
    inner = members.where("NOT last").select(*NODE).distinct()
    leaves = sequences.join(inner, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    weighed = sequences.select("conv_id", "weight", "whole").join(leaves, "conv_id", "left").fillna(0, ["leaf"])
    prefixes = written(members.join(weighed, "conv_id").withColumn("below", F.expr("whole - upto + size")))

    nodes = written(
        prefixes.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b"),
            F.max("size").alias("size"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.expr("weight * below")).alias("spent"),
        )
    )
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("from_depth"), F.sum("size").alias("owned"))
    # A sequence that passes through nodes of others only owns nothing.
    once = prefixes.join(owners, "conv_id", "left").groupBy(*NODE).agg(
        F.sum(F.expr("CASE WHEN depth >= from_depth THEN below ELSE coalesce(owned, 0) END")).alias("once")
    )
    children = nodes.where("depth > 0").groupBy(F.col("parent_a").alias("node_a"), F.col("parent_b").alias("node_b")).agg(F.count("*").alias("n_children"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    whole = written(
        nodes.join(once, NODE).join(children, NODE, "left").join(end_digests(ends), NODE, "left")
        .select(
            *NODE, "parent_a", "parent_b", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            "n_leaves", F.expr("spent - once").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
    parents = whole.where("n_children > 0").select(
        F.col("node_a").alias("parent_a"), F.col("node_b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    inner_rows = heavy_join(whole.where("depth > 0"), parents.withColumnRenamed("n_children", "rows_"), ["parent_a", "parent_b"], "rows_")
    fields = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    root = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return inner_rows.select(*fields).union(root.select(*fields))


SQL = r"""
WITH numbered AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k, n FROM (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL)),
steps AS (
  SELECT conv_id, flatten(list_prepend([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))) AS s
  FROM (SELECT DISTINCT conv_id FROM numbered)),
convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 5 AS donor,
    xor(list_reduce(s, lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295) % 9 AS h
  FROM steps),
rows_ AS (
  SELECT c.conv_id, 1 AS part, pos, k, n FROM convs c JOIN numbered t ON t.conv_id = c.donor AND pos <= h
  UNION ALL SELECT conv_id, 2, pos, k, n FROM numbered JOIN convs USING (conv_id) WHERE pos > h),
prefixes AS MATERIALIZED (
  SELECT conv_id, row_number() OVER o AS depth, string_agg(k, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS node, n
  FROM rows_ WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
nodes AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n FROM prefixes GROUP BY node, depth),
ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM prefixes JOIN lengths USING (conv_id, depth) GROUP BY node),
children AS MATERIALIZED (SELECT substr(node, 1, 64 * (depth - 1)) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (SELECT substr(node, 1, 64 * unnest(range(depth + 1))) AS top, node, (n_convs - 1) * n AS saved FROM nodes),
sums AS (
  SELECT top AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM above LEFT JOIN children USING (node) GROUP BY top)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens,
  coalesce(sha, sha256('')) AS ends_sha256
FROM nodes v LEFT JOIN nodes p ON v.depth > 0 AND p.node = substr(v.node, 1, 64 * (v.depth - 1))
JOIN sums ON sums.node = v.node LEFT JOIN children c ON c.node = v.node LEFT JOIN ends e ON e.node = v.node
"""
