"""What stored tables leave behind."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch
from scriptorium.session import CLEANUP_KEY, written


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for folder in folders for f in Path(folder).rglob("shuffle_*.data")}


@pytest.mark.parametrize("store", [lambda df: written(df), lambda df: Scratch(df.sparkSession).written(df)])
def test_shuffles_go_when_their_table_is_stored(spark, store):
    before = shuffle_files(spark)
    table = store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert table.count() == 7
    assert spark.conf.get(CLEANUP_KEY, "false") == "false"
