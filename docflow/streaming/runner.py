"""Running a stream over what its source holds now."""

from __future__ import annotations

import datetime
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.session import disk_state, new_folder


def file_stream(
    spark: SparkSession,
    folder: str,
    schema,
    file_glob: str | None = None,
    max_files: int | None = None,
    max_bytes: str | None = None,
    format: str = "parquet",
) -> DataFrame:
    """Files of a folder as a stream. The limits bound what one trigger admits."""
    if max_files and max_bytes:
        raise ValueError("give max_files or max_bytes, not both")
    reader = spark.readStream.format(format).schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getFileStatus(place).isDirectory()


def table_stream(spark: SparkSession, path: str, schema=None, **limits) -> DataFrame:
    """A Parquet table as a stream, be it a folder of part files or one file.

    A file source reads folders only, so a single file is its parent folder
    with all other names left out.
    """
    schema = schema or spark.read.parquet(path).schema
    if is_folder(spark, path):
        return file_stream(spark, path, schema, **limits)
    parent, _, name = path.rstrip("/").rpartition("/")
    return file_stream(spark, parent, schema, name, **limits)


def run_updates_to_end(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Process all input that is there, in update mode; the last row of each key.

    A trigger writes the keys it changed below its own number, so a trigger
    that runs again after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    target = new_folder(spark, name)

    def upsert(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/trigger={trigger}")

    with disk_state(spark):
        running = (
            stream.writeStream.foreachBatch(upsert)
            .option("checkpointLocation", new_folder(spark, f"{name}_progress"))
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
    running.awaitTermination()
    if not any(progress["numInputRows"] for progress in running.recentProgress):
        return spark.createDataFrame([], stream.schema)
    changes = spark.read.option("basePath", target).parquet(f"{target}/trigger=*")
    values = [c for c in stream.columns if c not in keys]
    return (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "trigger").alias("_last"))
        .select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in stream.columns])
    )


def run_until_idle(stream: DataFrame, name: str, wait_ms: int, every_ms: int = 100) -> DataFrame:
    """Process all input that is there and let every timer of ``wait_ms`` run out; the output.

    For streams that hold rows until a processing-time timer ends.
    """
    spark = stream.sparkSession
    target = new_folder(spark, name)
    with disk_state(spark):
        running = (
            stream.writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", new_folder(spark, f"{name}_progress"))
            .outputMode("append")
            .trigger(processingTime=f"{every_ms} milliseconds")
            .start()
        )
    try:
        _let_timers_end(running, wait_ms / 1000)
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(target)


def _let_timers_end(running, wait_s: float) -> None:
    """Wait for a trigger without input, which has read everything, and then for one that began after all timers' end."""
    ends = None
    while running.isActive:
        last = running.lastProgress
        if last is not None and last["numInputRows"] == 0:
            began = datetime.datetime.fromisoformat(last["timestamp"].replace("Z", "+00:00")).timestamp()
            if ends is None:
                ends = began + wait_s
            elif began > ends:
                return
        time.sleep(0.1)
    if running.exception():
        raise running.exception()


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process all input that is there, in append mode, and read the output back."""
    spark = stream.sparkSession
    target = new_folder(spark, name)
    with disk_state(spark):
        running = (
            stream.writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", new_folder(spark, f"{name}_progress"))
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
