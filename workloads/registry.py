"""All registered queries. A module lists them as ``name -> (query, sql or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workloads import assets, chunks, corpus, drafts, graphs, labels, refreshing, roundtrips, searching

_MODULES = (corpus, chunks, labels, searching, graphs, drafts, assets, refreshing, roundtrips)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
