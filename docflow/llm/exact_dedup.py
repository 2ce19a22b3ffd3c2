"""Exact deduplication by a stateful stream.

The documents are read as a stream of files. A streaming aggregation in RocksDB
keeps, per digest of the normalised text and without any expiry, the stable
identifier and the content locator (file and row) of the row that stays, and
the number of rows seen. What a trigger changes is written once per batch, so a
replayed batch overwrites itself. Digests seen more than once are then checked
on their full bytes: texts that differ under one digest become classes of
their own.

Defined results:
- a null text counts as empty; all empty texts (and texts of white space only)
  are one class;
- of equal texts stays the row with the most code points, then the smallest
  doc_id (a null doc_id last), then the first locator, so of fully equal rows
  exactly one stays;
- an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.session import materialize
from docflow.streaming.runner import run_updates_to_end, table_stream

# The characters [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # No space set aside in advance: every partition has a store of its own.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All state stores of an executor share this much memory; the rest is on disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _keyed(rows: DataFrame, digest=sha256) -> DataFrame:
    """Digest, normalised text and rank of each row; the least rank stays."""
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.length(text).alias("chars"),
        F.translate(text, SPACE, "").alias("norm"),
    ).select(
        "norm",
        digest(F.col("norm")).alias("digest"),
        sha256(F.col("norm")).alias("text_sha256"),
        F.struct(
            (-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row"
        ).alias("rank"),
    )


def follow(spark: SparkSession, path: str, digest=sha256, max_bytes: int = 64 << 30) -> DataFrame:
    """Run the stream over all files of a table; its last state, one row per digest.

    ``max_bytes`` bounds what one trigger admits.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    with settings(spark, STATE_SETTINGS):
        source = table_stream(spark, path, schema, max_bytes=max_bytes)
        state = _keyed(source, digest).groupBy("digest").agg(
            F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")
        )
        return run_updates_to_end(state, "exact_dedup", ["digest"])


def exact_dedup(spark: SparkSession, path: str, digest=sha256, max_bytes: int = 64 << 30) -> DataFrame:
    """One row per row of the Parquet table at ``path``, with the row that stays.

    ``digest`` may be any string expression of the normalised text; a weak one
    costs time, not correctness.
    """
    state = materialize(follow(spark, path, digest, max_bytes), "state")
    rows = _keyed(spark.read.parquet(path), digest)
    # Full bytes of all hits: equal texts meet in the map tasks already, so a
    # large group of copies is a few rows after that.
    texts = (
        rows.select("digest", "norm")
        .join(state.filter("n > 1").select("digest"), "digest", "left_semi")
        .groupBy("digest", "norm")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    clashes = materialize(
        texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"),
        "clashes",
    )
    found = rows.drop("norm").join(state, "digest", "left")
    if not clashes.isEmpty():
        apart = rows.join(clashes, "digest", "left_semi")
        classes = apart.groupBy("digest", "norm").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))
        found = found.join(clashes, "digest", "left_anti").unionByName(
            apart.join(classes, ["digest", "norm"]).drop("norm")
        )
    return found.select(
        F.col("rank.doc_id").alias("doc_id"),
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("rank.file") == F.col("best.file")) & (F.col("rank.row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
    )
