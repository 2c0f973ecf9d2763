"""Times the headline jobs and prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from scriptorium.operators import buckets, chunking, graph, index as ix, media, search, tagging  # noqa: E402
from scriptorium.plans import jobs  # noqa: E402
from scriptorium.session import local_session, shared_folder, written  # noqa: E402
from workloads import assets, fixtures as fx, graphs, labels, refreshing  # noqa: E402


def run(df: DataFrame) -> None:
    """Compute every row and column, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark: SparkSession = local_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark.range(1000))

    posts = written(fx.posts(spark, sf_dir)).repartition(int(cpus) if cpus.isdigit() else 8).persist()
    posts.count()
    dictionary = fx.dictionary(spark)
    results: dict[str, float] = {}

    results["make_chunks"] = timed(lambda: run(chunking.make_chunks(posts)))
    results["tag_entities"] = timed(lambda: run(tagging.tag_entities(posts, dictionary)))
    results["classify_corpus"] = timed(lambda: run(labels.classify.classify_corpus(posts, dictionary, fx.classification_rules(spark))))

    stored: dict[str, DataFrame] = {}

    def ingest() -> None:
        stored["index"] = written(ix.ingest_posts(posts, dictionary)[0])

    results["ingest_posts"] = timed(ingest)
    index = stored["index"]

    # A thousand queries: all benchmark texts, then conversation turns.
    own = fx.queries(spark, sf_dir)
    turns = fx.asked(spark, sf_dir).select((F.col("query_id") + 1_000_000).alias("query_id"), "query")
    many = written(search.embed_queries(own.unionByName(turns).orderBy("query_id").limit(1000)))
    results["hybrid_search_1000"] = timed(lambda: run(search.hybrid_search(many, index)))

    results["near_duplicate_groups"] = timed(lambda: run(media.near_duplicate_groups(assets.fingerprints(spark, sf_dir))))

    def related() -> None:
        nodes = graphs.nodes(spark, sf_dir)
        run(graph.related_entities(nodes.select("id"), nodes, graphs.edges(spark, sf_dir)))

    results["related_entities"] = timed(related)

    # The index as it lies on disk before the refresh.
    layout = buckets.Layout(f"{shared_folder(spark)}/bench_index", by="source_document")
    buckets.create_index(index, layout)

    def refresh() -> None:
        new_posts, _ = jobs.refresh_stored(posts, layout, refreshing.incoming(spark, sf_dir), dictionary, order=refreshing._order())
        run(new_posts)

    results["refresh_corpus"] = timed(refresh)

    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline jobs",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": float(scale.group(1)) if scale else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
