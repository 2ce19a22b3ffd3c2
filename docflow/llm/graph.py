"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.session import materialize, release_finished


def components(edges: DataFrame) -> DataFrame:
    """id and root, the smallest id that can be reached, for every id in ``a`` or ``b``.

    Each round links the neighbours of a node to the least of them, in two
    steps: first the larger neighbours, then the smaller ones. Least values are
    aggregated before they are joined, so no list of neighbours is ever built;
    a node with very many of them is split by the skew join. Rounds are
    logarithmic in the length of a path. Rows between a node and itself count.
    """
    links = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while True:
        # Larger neighbours: v of u goes to the least of u and its neighbours.
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = both.filter("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Smaller neighbours: all of them and u itself go to the least.
        small = large.distinct()
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        moved = small.join(least, "u").select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        )
        after = materialize(
            moved.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).distinct(), "links"
        )
        release_finished(edges.sparkSession)
        # Done when every node has one row, and every root points to itself: one pass over the nodes.
        ends = after.select(
            F.explode(
                F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.lit(None).cast("bigint").alias("v")))
            ).alias("e")
        ).select("e.u", "e.v")
        nodes = ends.groupBy("u").agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("is_root")
        )
        moving = nodes.filter("low is null or low < high or (is_root and low <> u)").agg(F.count(F.lit(1))).first()[0]
        if not moving:
            return after.select(F.col("u").alias("id"), F.col("v").alias("root"))
        links = after
