"""Time-or-count bounded batches on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docflow import constants as C
from docflow.streaming.runner import run_to_end, table_stream


def stream_bounded_batches(
    arrivals: DataFrame,
    key: str,
    time: str,
    tie: str,
    max_wait: int,
    max_rows: int = C.DEFAULT_BATCH_PAGES,
) -> DataFrame:
    """Give every arrival the opening of its batch, as the batch operator does.

    ``time`` is in microseconds. No arrival is dropped: one that comes after a
    later one joins the batch open then. The state of a queue is its open batch
    only, three numbers, kept without expiry by the session's state store. One
    trigger holds no more rows of a queue than the source admits, see
    ``file_stream``.
    """
    if max_rows < 1 or max_wait < 0:
        raise ValueError("max_rows must be at least 1 and max_wait at least 0")
    names = [key, time, tie, "opened_at", "opened_by"]

    def assign(
        group: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        rows = np.concatenate([part[[time, tie]].to_numpy(dtype=np.int64) for part in parts])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        times, ties = rows[:, 0], rows[:, 1]
        opened_at, opened_by = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        at, by, count = state.get if state.exists else (0, 0, max_rows)
        i = 0
        while i < len(rows):
            if count >= max_rows or times[i] >= at + max_wait:
                at, by, count = int(times[i]), int(ties[i]), 0
            end = min(i + max_rows - count, int(np.searchsorted(times, at + max_wait, "left")))
            end = max(end, i + 1)
            opened_at[i:end], opened_by[i:end] = at, by
            count += end - i
            i = end
        state.update((at, by, count))
        yield pd.DataFrame(dict(zip(names, (group[0], times, ties, opened_at, opened_by))))

    fields = {f.name: f.dataType.simpleString() for f in arrivals.schema}
    return (
        arrivals.groupBy(key)
        .applyInPandasWithState(
            assign,
            f"{key} {fields[key]}, {time} bigint, {tie} bigint, opened_at bigint, opened_by bigint",
            "opened_at bigint, opened_by bigint, taken int",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def run_on_table(spark: SparkSession, folder: str, max_wait: int, max_rows: int) -> DataFrame:
    """The events table as a stream of arrivals, a queue per user."""
    arrivals = table_stream(spark, f"{folder}/events.parquet", max_files=1).select(
        "event_id",
        "user_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("queued_us"),
    )
    batches = stream_bounded_batches(arrivals, "user_id", "queued_us", "event_id", max_wait, max_rows)
    return run_to_end(batches, "stream_bounded_batches")
