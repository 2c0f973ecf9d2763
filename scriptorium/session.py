"""Session settings and the few decisions that depend on the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Stored bytes of an input that one task takes; chunking and tagging them takes about half a minute.
TASK_BYTES = 8 * 1024 * 1024
# Spark deletes the shuffle files of a query when it ends, not when the driver next collects its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app_name: str = "scriptorium", cpus: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that every executor reaches.

    It is the one the cluster names in ``spark.checkpoint.dir`` (or that was set
    on the context). Only a session whose executors share the driver's machine
    may go without: it gets a temporary folder. Anywhere else results written to
    a machine's own disk would be lost, so this raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get(CHECKPOINT_KEY, None)
        if named is None and not runs_in_one_process(context.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return (spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()).rstrip("/")


def runs_in_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for an input that arrives in fewer partitions than cores, or in larger ones than a task should take.

    A file is read in splits of up to 128 MB, however long a task works on one,
    and a row group by one task. So that tasks stay equally long whatever the
    input's size, a corpus in too few splits is dealt out; one that has enough
    of them is returned unchanged.
    """
    scan_bytes = _size_in_bytes(df)
    wanted = tasks_for(df)
    if scan_bytes is not None and scan_bytes > TASK_BYTES and df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)


def tasks_for(df: DataFrame) -> int:
    """How many tasks of one length ``df`` makes, one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(_size_in_bytes(df) or 0) // TASK_BYTES))


def _size_in_bytes(df: DataFrame) -> int | None:
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:
        return None


def stored(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a parquet table at ``path``; what was shuffled for it is deleted, as nobody reads it again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_KEY, None)
    conf.set(CLEANUP_KEY, "true")
    try:
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP_KEY)
        else:
            conf.set(CLEANUP_KEY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a parquet table in the shared checkpoint folder.

    For results that are read several times: the plan that made them is cut off,
    readers still prune columns and push filters, and a lost executor costs nothing.
    """
    return stored(df, f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}", partition_by)
