"""Session helpers: settings for local runs, table reads and lineage cuts."""
from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 1_000_000
LOCAL_SETTINGS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


def local_session(cpus: int | str = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("colsmith")
    for key, value in {**LOCAL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. Only a local master may name none: elsewhere executors would not see a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="run-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str, folder: str | None = None) -> str:
    """Write ``df`` as a Parquet table in ``folder`` (default: the shared one) and return its path."""
    path = f"{(folder or shared_folder(df.sparkSession)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core before an iterative fit; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded(df: DataFrame, rows: int, most: int = ROWS_PER_TASK) -> DataFrame:
    """Partitions of about ``most`` of the ``rows`` at most before an iterative fit, which reads whole partitions again and again.

    A split of a file may hold millions of rows, as its size is that of the compressed columns; smaller inputs stay as they are.
    """
    parts = math.ceil(rows / most)
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_counted: dict[SparkSession, tuple[int, str | None]] = {}
_counting = threading.Lock()


@contextmanager
def batches_by_count(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of jobs in this block are cut by their number of rows alone: for narrow rows.

    With a byte limit Spark works the size of the batch out again at every row, which costs ten times what sending two
    numbers does. The setting is the session's and is put back when the last thread leaves.
    """
    with _counting:
        users, before = _counted.get(spark, (0, None))
        if not users:
            before = spark.conf.get(BATCH_BYTES, None)
            spark.conf.set(BATCH_BYTES, str((1 << 31) - 1))
        _counted[spark] = users + 1, before
    try:
        yield
    finally:
        with _counting:
            users, before = _counted.pop(spark)
            if users > 1:
                _counted[spark] = users - 1, before
            elif before is None:
                spark.conf.unset(BATCH_BYTES)
            else:
                spark.conf.set(BATCH_BYTES, before)
