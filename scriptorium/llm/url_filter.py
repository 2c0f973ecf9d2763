"""URL rules behind a blocked Bloom filter.

A rule is a canonical URL: a lower-case host and the start of a path. A URL is
asked for under each of its parent domains and each path length that occurs in
the rules. The filter answers from one block of eight words per question and
passes every rule that is listed; an exact hash join then removes what it
passed by mistake. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.llm.common import written

WORDS = 8
# The filter is broadcast, so its size is bounded: this many blocks of eight
# 32-bit words (2 MB). Beyond BITS_PER_RULE * rules it only passes more by
# mistake, and the join removes those.
MAX_BLOCKS = 1 << 16
BITS_PER_RULE = 16


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The bit of ``word`` that a key sets: five bits of a second hash."""
    place = F.shiftrightunsigned(F.xxhash64(key, F.lit("bit")), 5 * word).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1), place)


def blocked_filter(keys: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The non-empty blocks ``(block, w0 ... w7)`` of the filter over ``keys``, and the number of blocks."""
    wanted = keys.count() * BITS_PER_RULE // (32 * WORDS) + 1
    n_blocks = min(1 << (wanted - 1).bit_length(), max_blocks)
    rows = keys.groupBy(_block(F.col(key), n_blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col(key), i)).alias(f"w{i}") for i in range(WORDS)]
    )
    return rows, n_blocks


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` has ``host`` (lower case), ``path`` (the start of a path, not
    empty) and ``verdict``. A rule fits its host and all subdomains where the
    path starts with the rule's. Of several the longest wins, host and path
    together, then the longer host; of repeated rules the least verdict.

    * A null URL, or one without ``://``, has an empty host and path and no rule.
    * A URL without a fitting rule has a null rule and the ``default`` verdict:
      a block list passes what it does not list.
    * Rules with a null or empty host or path are ignored. Repeated pages stay
      as they are, ids are only copied, other columns are ignored.
    * Every distinct host and path is judged once, so a URL that many pages
      share costs one question; its answer is joined back.
    """
    listed = written(
        rules.where("host != '' AND path != ''")
        .groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.min("verdict").alias("r_verdict"))
        .withColumn("key", F.concat("r_host", "r_path"))
    )
    # Lengths of rule paths: never more than the longest path has characters.
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())
    filter_rows, n_blocks = blocked_filter(listed, "key", max_blocks)

    located = pages.select(
        F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    distinct = located.select("host", "path").where("host != ''").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    asked = (
        distinct.select("host", "path", F.explode(parents).alias("r_host"))
        .where("r_host != ''")
        .select("host", "path", "r_host", F.explode(prefixes).alias("r_path"))
        .withColumn("key", F.concat("r_host", "r_path"))
        .withColumn("block", _block(F.col("key"), n_blocks))
    )
    all_set = F.lit(True)
    for i in range(WORDS):
        bit = _bit(F.col("key"), i)
        all_set = all_set & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    passed = asked.join(F.broadcast(filter_rows), "block").where(all_set)
    exact = passed.join(listed.drop("key"), ["r_host", "r_path"])
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"))
    best = written(
        exact.groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("v")), rank).alias("b"))
        .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("v"))
    )
    return located.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict")
    )
