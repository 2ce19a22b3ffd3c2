"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# The state of streams lives on disk, and the stores of an executor share their memory.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """State on disk for streams that start within the block, whatever the session's own setting.

    Keyed state with lists, maps and timers needs it, and other state must not be held in memory.
    A session whose provider is on disk already keeps all its settings.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    changed = {} if spark.conf.get(provider, None) == DISK_STATE[provider] else DISK_STATE
    before = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def build_session(app_name: str = "docflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.worker.reuse": "true",
        # Python reaches stream state by a socket file, not a port.
        "spark.python.unix.domain.socket.enabled": "true",
        **DISK_STATE,
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, readable by all executors.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without: it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="docflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Folders that new_folder has named and remove_intermediate_tables has not removed.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a not yet existing folder below the shared folder."""
    _made.append(f"{shared_folder(spark)}/docflow-{uuid.uuid4().hex}")
    return f"{_made[-1]}/{name}"


def remove_intermediate_tables(spark: SparkSession) -> int:
    """Delete the tables this driver has stored so far; gives their number.

    To be called when no result that reads them is needed any more.
    """
    removed = 0
    while _made:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        removed += bool(store.delete(place, True))
    return removed


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table, by default in the shared folder, and read it back.

    Cuts the lineage with files that outlive any executor, runs the plan of
    ``df`` once for all later readers, and keeps column pruning for them.
    """
    path = path or new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_finished(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and broadcasts that no live plan needs any more.

    Spark does so when the driver's garbage is collected. A loop of many short jobs may go on
    for long before that happens by itself, and what it has left would take disk and memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def task_count(spark: SparkSession) -> int:
    """Number of partitions for an explicit repartition."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )

