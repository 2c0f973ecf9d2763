from pyspark.sql import functions as F

from scriptorium.llm import queries, url_filter
from tests.llm.helpers import frame

URLS = [
    None, "", "no scheme", "http://", "://x.com/", "http://EXAMPLE.com/en/1", "https://www.Example.COM/en/?q=1", "http://a.www.example.com/en/x",
    "http://b.example.com/fr/", "http://example.com", "http://example.com?x=/en/", "http://x.net/es/1#f", "http://net/fr/", "http://x.net/es",
    "http://notexample.com/en/", "http://a.org/en/", "http://x.com/http://y.net/es/", "http://com/", "http://..com/", "http://x.net/fr/\n/y", "http://x.net/es/1#f",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h, p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    h, p, v = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])))
    return host, path, h + p, v


def test_matches_brute_force(spark):
    pages = frame(spark, list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("verdict", F.lit(1))
    for blocks in (1 << 16, 1):
        got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages, queries.url_rules(spark), max_blocks=blocks).collect()}
        assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_filter_passes_all_listed(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host"), "id", F.lit("/p")).alias("key"))
    rows, n = url_filter.blocked_filter(keys, "key", 64)
    assert n == 64 and rows.count() <= 64
    bits = {r["block"]: tuple(r)[1:] for r in rows.collect()}
    asked = keys.select(url_filter._block(F.col("key"), n).alias("b"), *[url_filter._bit(F.col("key"), i).alias(f"m{i}") for i in range(8)])
    for row in asked.collect():
        assert all(bits[row["b"]][i] & row[f"m{i}"] == row[f"m{i}"] for i in range(8))


def test_empty_rules_and_pages(spark):
    pages = frame(spark, [(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("a.com", None, "block")], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judge_urls(pages, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_filter.judge_urls(pages.where(F.lit(False)), queries.url_rules(spark)).count() == 0
