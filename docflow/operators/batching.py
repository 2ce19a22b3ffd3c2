"""Grouping pages and arrivals into batches for a model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow import constants as C
from docflow.operators.ordering import dense_position, join_by_block, running_offset
from docflow.session import materialize

# Arrivals handled by one task at a time.
ARRIVAL_BLOCK = 65536
# Block summaries combined by one task at a time.
SUMMARY_GROUP = 4096


def page_batches(pages: DataFrame, docs: DataFrame, batch_pages: int = C.DEFAULT_BATCH_PAGES) -> DataFrame:
    """Add ``batch_id``: fixed-size batches in (document, page) order.

    Batches cross documents. A page's position is the page count of all earlier
    documents plus its own index, so pages are never sorted; ``docs`` carries
    ``page_count``.
    """
    if batch_pages < 1:
        raise ValueError("batch_pages must be at least 1")
    starts = running_offset(
        docs.filter("page_count > 0").select("document_index", "page_count"),
        "document_index",
        "page_count",
        out="first_position",
    )
    joined = join_by_block(pages, starts)
    return joined.withColumn(
        "batch_id", F.expr(f"(first_position + page_index) div {batch_pages}")
    ).drop("first_position")


def _next_starts(keys: np.ndarray, times: np.ndarray, max_wait: int, max_rows: int) -> np.ndarray:
    """For every row, if it opened a batch, the row that would open the next."""
    n = len(times)
    here = np.arange(n)
    change = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    key_end = np.append(change[1:], n)[np.searchsorted(change, here, "right") - 1]
    timeout = np.empty(n, dtype=np.int64)
    for begin, end in zip(change, np.append(change[1:], n)):
        timeout[begin:end] = begin + np.searchsorted(times[begin:end], times[begin:end] + max_wait, "left")
    return np.maximum(here + 1, np.minimum.reduce([here + max_rows, key_end, timeout]))


def bounded_batches(
    df: DataFrame,
    time: str,
    tie: str,
    max_wait: int = C.DEFAULT_MAX_WAIT_MS,
    max_rows: int = C.DEFAULT_BATCH_PAGES,
    key: str | None = None,
    block: int = ARRIVAL_BLOCK,
) -> DataFrame:
    """Batches that close by time or by count.

    A batch opens at its first arrival, and the first arrival at or after
    ``max_wait`` later, or beyond ``max_rows``, opens the next. ``time`` is an
    integer column, ``tie`` makes the order unique, ``key`` gives each value a
    queue of its own. Adds ``batch_id`` (dense, in order of key and time) and
    ``opened_at``.

    Which row opens a batch depends on all rows before it, yet one queue may
    hold any number of rows. So the ordered rows are cut into blocks. Each
    block is summarised for every possible place of its first opening, which
    is one of ``max_rows``; the summaries are chained, and then each block is
    numbered with its known first opening.
    """
    if max_rows < 1 or max_wait < 0:
        raise ValueError("max_rows must be at least 1 and max_wait at least 0")
    if block < max_rows:
        raise ValueError("block must be at least max_rows")

    order = ([key] if key else []) + [time, tie]
    placed = dense_position(df.select(*dict.fromkeys(order)), order, "position")
    placed = placed.withColumn("queue", F.col(key).cast("string") if key else F.lit(""))
    placed = placed.withColumn("block", F.expr(f"position div {block}"))
    # The first rows of a block are also shown to the block before it.
    head = F.expr(f"block > 0 and position % {block} < {max_rows}")
    seen = placed.withColumn(
        "block", F.explode(F.when(head, F.array("block", F.col("block") - 1)).otherwise(F.array("block")))
    )

    def openings(rows: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
        rows = rows.sort_values("position", ignore_index=True)
        own = int((rows["position"] // block == rows["block"]).sum())
        following = _next_starts(
            rows["queue"].to_numpy(), rows[time].to_numpy(dtype=np.int64), max_wait, max_rows
        )
        return rows, own, following

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        rows, own, following = openings(rows)
        exits = [0] * own + list(range(max_rows))
        counts = [0] * (own + max_rows)
        following = following.tolist()
        for i in range(own - 1, -1, -1):
            exits[i] = exits[following[i]]
            counts[i] = counts[following[i]] + 1
        return pd.DataFrame({
            "block": [rows["block"].iloc[0]],
            "exits": [exits[:max_rows]],
            "counts": [counts[:max_rows]],
        })

    def chain(summaries: pd.DataFrame) -> pd.DataFrame:
        entry = np.arange(max_rows)
        opened = np.zeros(max_rows, dtype=np.int64)
        for exits, counts in _in_block_order(summaries):
            opened += counts[entry]
            entry = exits[entry]
        return pd.DataFrame({
            "block": [summaries["block"].iloc[0] // SUMMARY_GROUP], "exits": [entry], "counts": [opened],
        })

    def walk(summaries: pd.DataFrame) -> pd.DataFrame:
        entry, opened = int(summaries["entry"].iloc[0]), int(summaries["opened"].iloc[0])
        rows = []
        ordered = summaries.sort_values("block")
        for number, exits, counts in zip(ordered["block"], ordered["exits"], ordered["counts"]):
            rows.append((number, entry, opened))
            entry, opened = int(exits[entry]), opened + int(counts[entry])
        return pd.DataFrame(rows, columns=["block", "entry", "opened"])

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        entry, opened = int(rows["entry"].iloc[0]), int(rows["opened"].iloc[0])
        rows, own, following = openings(rows)
        opens = np.zeros(own, dtype=np.int64)
        i = entry
        while i < own:
            opens[i] = 1
            i = int(following[i])
        return rows.iloc[:own].assign(batch_id=opened + np.cumsum(opens) - 1)[[*fields, "batch_id"]]

    table = "block bigint, exits array<bigint>, counts array<bigint>"
    # Read twice below, and one row stands for a whole block: kept as a table.
    summaries = materialize(seen.groupBy("block").applyInPandas(summarise, table), "summaries")
    groups = summaries.groupBy(F.expr(f"block div {SUMMARY_GROUP}").alias("group"))
    top = (
        groups.applyInPandas(chain, table)
        .withColumn("entry", F.lit(0).cast("bigint"))
        .withColumn("opened", F.lit(0).cast("bigint"))
    )
    # One row per SUMMARY_GROUP blocks: far below one in 10^8 of the arrivals.
    entry_schema = "block bigint, entry bigint, opened bigint"
    group_entries = top.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(walk, entry_schema)
    entries = (
        summaries.withColumn("group", F.expr(f"block div {SUMMARY_GROUP}"))
        .join(group_entries.withColumnRenamed("block", "group"), "group")
        .groupBy("group")
        .applyInPandas(walk, entry_schema)
    )
    fields = list(dict.fromkeys(order))
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*fields).schema] + ["batch_id bigint"]
    )
    numbered = seen.join(entries, "block").groupBy("block").applyInPandas(number, schema)
    opened_at = Window.partitionBy("batch_id")
    return numbered.withColumn("opened_at", F.min(time).over(opened_at))


def _in_block_order(summaries: pd.DataFrame):
    ordered = summaries.sort_values("block")
    return [(np.asarray(e), np.asarray(c)) for e, c in zip(ordered["exits"], ordered["counts"])]


def batch_wait_stats(
    batches: DataFrame, time: str, request: str, max_wait: int, max_rows: int = C.DEFAULT_BATCH_PAGES
) -> DataFrame:
    """Per batch: rows, requests, and the waits until it closed.

    A full batch closes at its last arrival, any other when its wait is over.
    The median is the upper one. A batch has at most ``max_rows`` rows.
    """
    closed_at = F.when(F.col("rows") >= max_rows, F.col("last")).otherwise(F.col("opened_at") + max_wait)
    grouped = batches.groupBy("batch_id", "opened_at").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(request).alias("requests"),
        F.max(time).alias("last"),
        F.array_sort(F.collect_list(F.col(time))).alias("times"),
    )
    # Waits fall as arrival times rise, so the upper median wait is the
    # lower-middle arrival.
    middle = F.get("times", F.expr("cast(rows as int) - 1 - cast(rows as int) div 2").cast("int"))
    return grouped.select(
        "batch_id",
        "rows",
        "requests",
        (closed_at - middle).alias("wait_p50"),
        (closed_at - F.col("opened_at")).alias("wait_max"),
    )
