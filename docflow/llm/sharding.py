"""Sharding by a minimax contiguous partition of atomic groups.

Rows of equal text form a group that no cut divides. The groups are ordered by
size, largest first, then by digest. The smallest feasible capacity of a shard
is found by binary search; a capacity is checked greedily, filling shard after
shard in order. Then the order is cut there. A group that alone sets the
capacity gets a shard of its own, and the rest is partitioned again among the
other shards, so that the sizes come out as equal as the groups allow.

The order by size makes the search exact on a small table: it needs only how
many groups there are of each size. Groups of n different sizes hold at least
n * (n + 1) / 2 bytes, so this table has at most sqrt(2 * total) rows: 45,000
for a GB, 14 million (220 MB) for 100 TB; on real texts far fewer.

Defined results: a null text counts as an empty one; a table with fewer groups
than shards leaves the last shards empty; rows of equal doc_id and text are
rows of their own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordering import dense_position
from docflow.session import materialize

OVERHEAD = 8


def row_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a digest of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("_digest"),
    )


def fill(sizes: np.ndarray, counts: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Greedy cuts at this capacity, as numbers of groups; None if it doesn't suffice.

    ``counts[i]`` groups of ``sizes[i]`` follow each other, for each i in turn.
    """
    starts = np.concatenate([[0], np.cumsum(counts)])
    bytes_before = np.concatenate([[0], np.cumsum(counts * sizes)])
    cuts, done, at = [], 0, 0
    for _ in range(shards):
        run = int(np.searchsorted(bytes_before, done + capacity, side="right")) - 1
        if run >= len(sizes):
            at, done = int(starts[-1]), int(bytes_before[-1])
        else:
            more = int((done + capacity - bytes_before[run]) // sizes[run])
            more = min(more, int(counts[run]))
            if int(starts[run]) + more < at:
                return None
            at = int(starts[run]) + more
            done = int(bytes_before[run]) + more * int(sizes[run])
        cuts.append(at)
        if at == int(starts[-1]):
            return cuts
    return None


def minimax_cuts(sizes: np.ndarray, counts: np.ndarray, shards: int) -> list[int]:
    """Group numbers at which shards end, by the smallest feasible capacity."""
    if not len(sizes):
        return []
    if shards == 1:
        return [int(counts.sum())]
    total = int((sizes * counts).sum())
    low, high = max(-(-total // shards), int(sizes[0])), total
    if low == int(sizes[0]) and fill(sizes, counts, shards, low) is not None:
        # One group alone sets the capacity.
        rest = counts.copy()
        rest[0] -= 1
        kept = slice(0 if rest[0] else 1, None)
        return [1] + [1 + cut for cut in minimax_cuts(sizes[kept], rest[kept], shards - 1)]
    while low < high:
        middle = (low + high) // 2
        if fill(sizes, counts, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return fill(sizes, counts, shards, low)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, the place within the shard."""
    rows = materialize(row_sizes(docs), "rows")
    groups = rows.groupBy("_digest").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    placed = materialize(dense_position(groups, [F.col("_bytes").desc(), F.col("_digest")], "_group"), "groups")
    runs = placed.groupBy("_bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("_bytes").desc()).toPandas()
    cuts = minimax_cuts(
        runs["_bytes"].to_numpy(dtype="int64"), runs["n"].to_numpy(dtype="int64"), shards
    )
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("_group") >= cut).cast("int")
    placed = placed.withColumn("shard", number)
    # Rows in earlier shards: one row per shard.
    first = placed.groupBy("shard").agg(F.sum("_rows").alias("n")).orderBy("shard").collect()
    starts, before = {}, 0
    for row in first:
        starts[row["shard"]] = before
        before += row["n"]
    # One row per group on one side, so a large group is split by the skew join.
    joined = rows.join(placed.select("_digest", "_group", "shard"), "_digest").drop("_digest")
    numbered = dense_position(joined, ["_group", "doc_id"], "_at")
    start = F.lit(0).cast("bigint")
    for index, value in starts.items():
        start = F.when(F.col("shard") == index, F.lit(value).cast("bigint")).otherwise(start)
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_at") - start).alias("slot")
    )
