"""Documents that are done while their pages still arrive, and their output in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docflow.operators.results import USAGE
from docflow.session import disk_state, new_folder

# Pages of one bitmap, and documents of one range of the frontier.
BITS = 1024
RANGE = 8192
_COLUMNS = ("page_index", "page_count", "input_tokens", "cached_tokens", "output_tokens", "error")


class Pages(StatefulProcessor):
    """Which pages of a document have come: a bitmap for every ``BITS`` pages, and sums."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bitmaps = handle.getMapState("bitmaps", "block bigint", "bits binary")
        self.sums = handle.getValueState(
            "sums", "done boolean, pages bigint, input_tokens bigint, cached_tokens bigint, output_tokens bigint"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, *sums = self.sums.get() or (False, 0, 0, 0, 0)
        if done:
            return
        # Few pages come at a time, for which columns as they are cost less than a frame's methods.
        parts = list(rows)
        columns = {name: [value for part in parts for value in part[name].tolist()] for name in _COLUMNS}
        order = np.argsort(np.array(columns["page_index"]), kind="stable").tolist()
        page_count = int(columns["page_count"][order[0]])
        failed = next((i for i in order if not pd.isna(columns["error"][i])), None)
        if failed is not None:
            yield self._finished(key, page_count, columns["error"][failed], [0, 0, 0])
        else:
            fresh = self._new(np.array(columns["page_index"])[order].astype(np.int64), order)
            usage = [sum(columns[name][i] for i in fresh if not pd.isna(columns[name][i])) for name in USAGE[:3]]
            sums = [sums[0] + len(fresh), *(n + int(more) for n, more in zip(sums[1:], usage))]
            if sums[0] < page_count:
                self.sums.update((False, *sums))
                return
            yield self._finished(key, page_count, None, sums[1:])
        # Nothing but the mark is kept; pages that still come are passed over.
        self.bitmaps.clear()
        self.sums.update((True, 0, 0, 0, 0))

    def _new(self, pages: np.ndarray, rows: list[int]) -> list[int]:
        """The rows of the pages that have not come before, each page once."""
        pages, first = np.unique(pages, return_index=True)
        blocks = pages // BITS
        fresh = np.ones(len(pages), bool)
        for block in np.unique(blocks).tolist():
            own = np.flatnonzero(blocks == block)
            stored = self.bitmaps.getValue((block,))
            bits = np.frombuffer(stored[0], np.uint8).copy() if stored else np.zeros(BITS // 8, np.uint8)
            at = pages[own] % BITS
            fresh[own] = (bits[at // 8] >> (at % 8)) & 1 == 0
            np.bitwise_or.at(bits, at // 8, (1 << (at % 8)).astype(np.uint8))
            self.bitmaps.updateValue((block,), (bits.tobytes(),))
        return [rows[i] for i in first[fresh].tolist()]

    @staticmethod
    def _finished(key, page_count: int, error: str | None, sums: list[int]) -> pd.DataFrame:
        values = (key[0], "ok" if error is None else "failed", error, page_count, *sums, sums[0] + sums[2])
        names = ("document_index", "status", "error", "page_count", *USAGE)
        return pd.DataFrame({name: [value] for name, value in zip(names, values)})

    def close(self) -> None:
        pass


def complete_documents(pages: DataFrame) -> DataFrame:
    """A row for a document as soon as its last page, or a failed one, has come.

    ``pages`` is a stream of page results with ``document_index``, ``page_index``,
    ``page_count``, the token counts and ``error``; texts are not read. Pages may come in any order
    and more than once. Gives status, error, page count and usage, zero if failed. Of pages that
    fail in one trigger the first one's error counts. The state of an open document is a bit for
    each page, of a finished one a mark.
    """
    zero = F.lit(0).cast("bigint")
    columns = [F.col(name) if name in pages.columns else zero.alias(name) for name in _COLUMNS]
    usage = ", ".join(f"{name} bigint" for name in USAGE)
    return (
        pages.select("document_index", *columns)
        .groupBy("document_index")
        .transformWithStateInPandas(
            Pages(), f"document_index bigint, status string, error string, page_count bigint, {usage}", "append", "none"
        )
    )


def _frontier(spark: SparkSession, folder: str, trigger: int) -> int:
    """Where the output stood after a trigger."""
    if trigger < 0:
        return 0
    return spark.read.schema("value long").json(f"{folder}/frontier/{trigger}").first()["value"]


def _advanced(arrived: DataFrame, start: int, index: str, size: int) -> int:
    """The least number from ``start`` on that has not arrived.

    Two levels: whole ranges are known by their counts, a row for ``size`` documents, and only
    the range in which the first one is missing is looked at closely.
    """
    ahead = arrived.filter(F.col(index) >= start).select(F.col(index).alias("i")).distinct()
    spark = arrived.sparkSession
    first = start // size
    expected = F.when(F.col("range") == first, (first + 1) * size - start).otherwise(size)
    whole = ahead.groupBy(F.expr(f"i div {size}").alias("range")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == expected)
    order = Window.orderBy("range")
    unbroken = whole.withColumn("_row", F.row_number().over(order)).filter(F.col("range") == F.lit(first) + F.col("_row") - 1)
    open_range = first + unbroken.count()
    low = max(start, open_range * size)
    own = ahead.filter(F.col("i").between(low, (open_range + 1) * size - 1))
    rows = own.withColumn("_row", F.row_number().over(Window.orderBy("i")))
    return low + rows.filter(F.col("i") == F.lit(low) + F.col("_row") - 1).count()


def emit_in_order(
    finished: DataFrame, folder: str, write: Callable[[DataFrame, str], None] | None = None, index: str = "document_index", size: int = RANGE
):
    """A started stream writer that lets a row out only when all before it are out.

    ``index`` numbers the rows 0, 1, 2 … without gaps. Each trigger stores what has arrived, finds how
    far the output can go, and writes the rows up to there as ``folder``/emitted/trigger=N with
    ``write`` (by default sorted Parquet files). A trigger that runs again after a failure
    replaces what it wrote. Rows that wait are read by their index alone until they leave.
    """

    def parquet(rows: DataFrame, path: str) -> None:
        rows.repartitionByRange(index).sortWithinPartitions(index).write.mode("overwrite").parquet(path)

    def step(rows: DataFrame, trigger: int) -> None:
        spark = rows.sparkSession
        rows.sortWithinPartitions(index).write.mode("overwrite").parquet(f"{folder}/arrived/{trigger}")
        start = _frontier(spark, folder, trigger - 1)
        arrived = spark.read.schema(rows.schema).parquet(*[f"{folder}/arrived/{t}" for t in range(trigger + 1)])
        end = _advanced(arrived, start, index, size)
        if end > start:
            # A row that came twice leaves once.
            leaving = arrived.filter((F.col(index) >= start) & (F.col(index) < end)).dropDuplicates([index])
            (write or parquet)(leaving, f"{folder}/emitted/trigger={trigger}")
        spark.createDataFrame([(end,)], "value long").coalesce(1).write.mode("overwrite").json(f"{folder}/frontier/{trigger}")

    return (
        finished.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode("append")
    )


def run_in_order(finished: DataFrame, name: str, size: int = RANGE) -> DataFrame:
    """Process all input that is there; the rows with the ``trigger`` in which each left."""
    spark = finished.sparkSession
    folder = new_folder(spark, name)
    with disk_state(spark):
        running = emit_in_order(finished, folder, size=size).trigger(availableNow=True).start()
    running.awaitTermination()
    schema = finished.schema.add("trigger", "long")
    try:
        return spark.read.schema(schema).option("basePath", f"{folder}/emitted").parquet(f"{folder}/emitted")
    except Exception as missing:  # noqa: BLE001 - nothing has left
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)
