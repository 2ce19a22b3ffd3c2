"""Positions and running totals without a one-task sort of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.session import materialize, task_count

# Rows of one window group. Totals of a group are 1/BUCKET_ROWS of the input.
BUCKET_ROWS = 8192
# Pages of one document that may go to one task, and into one output row.
PAGE_BLOCK = 1024


def running_offset(
    df: DataFrame,
    order: str,
    value: str,
    keys: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
    out: str = "offset",
    keep_bucket: str | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same ``keys``.

    ``order`` is a non-negative integer, unique within ``keys``. Rows are
    summed per bucket of ``bucket_rows`` consecutive order values, the bucket
    sums get a running total, and each bucket adds its own rows on top, so
    no window group holds more than ``bucket_rows`` input rows. With
    ``keep_bucket`` the bucket number stays as a column of that name, and later
    grouping by ``keys`` and that column needs no further shuffle.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", F.expr(f"`{order}` div {bucket_rows}"))
    earlier_buckets = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.sum(value).alias("_total"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_total").over(earlier_buckets), F.lit(0)).alias("_start"),
        )
    )
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Asked for explicitly: rows that happen to be partitioned by the keys alone
    # would satisfy the window as they are, with a large key in one task.
    result = (
        bucketed.repartition(*keys, "_bucket")
        .withColumn("_inner", F.coalesce(F.sum(value).over(in_bucket), F.lit(0)))
        .join(starts, [*keys, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_inner")).cast("bigint"))
        .drop("_inner", "_start")
    )
    if keep_bucket:
        return result.withColumnRenamed("_bucket", keep_bucket)
    return result.drop("_bucket")


def dense_position(
    df: DataFrame,
    order_by: Sequence[Column | str],
    out: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """Number all rows 0, 1, 2 … in the order of any sortable columns.

    Range partitioning splits a hot leading key as long as ``order_by`` is
    unique. The sorted rows are written once, since range bounds are sampled
    and a second run may cut elsewhere. The offsets are one row per partition.
    """
    sorted_rows = (
        df.repartitionByRange(partitions or task_count(df.sparkSession), *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    stored = materialize(sorted_rows, "sorted")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    # One row per range partition: a fixed, small number, so safe to broadcast.
    return (
        stored.join(F.broadcast(starts), "_part")
        .withColumn(out, (F.col("_start") + F.col("_row")).cast("bigint"))
        .drop("_part", "_row", "_start")
    )


def page_block(page_index: str = "page_index", block: int = PAGE_BLOCK) -> Column:
    """Number of the block of consecutive pages that holds a page."""
    return F.expr(f"`{page_index}` div {block}")


def document_blocks(docs: DataFrame, block: int = PAGE_BLOCK, out: str = "part_index") -> DataFrame:
    """One row per document and page block; one row if there are no pages."""
    last = F.expr(f"greatest(page_count - 1, 0L) div {block}")
    return docs.withColumn(out, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))


def join_by_block(
    pages: DataFrame,
    docs: DataFrame,
    how: str = "inner",
    key: str = "document_index",
    block: int = PAGE_BLOCK,
) -> DataFrame:
    """Join pages to one row per document, spreading large documents.

    The join key is (document, page block), so the pages of one large document
    are spread over many tasks; the document row is repeated once per block.
    ``docs`` must carry ``page_count``.
    """
    blocks = document_blocks(docs, block, "_block")
    if how not in ("left_semi", "left_anti"):
        shared = [c for c in docs.columns if c in pages.columns and c != key]
        blocks = blocks.drop(*shared)
    return (
        pages.withColumn("_block", page_block("page_index", block))
        .join(blocks, [key, "_block"], how)
        .drop("_block")
    )
