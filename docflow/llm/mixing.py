"""Mixing sources to target weights: capped water-filling, then seeded copies.

Targets: every source gets its share of all words by weight; a source whose
share is above ``max_epochs`` times its size is clamped there, and what it
leaves is shared among the others by weight, round by round, until no source is
above its clamp. A round is one aggregate over the table of sources.

Copies: with r = target / size of its source, every document is taken
floor(r) times. The rest of the target goes to whole documents in a seeded
order, and the one document at the edge gives the words still missing, a
fractional copy, so a source meets its target to the word. The order is cut in
4096 ranges of the seeded hash; running totals are taken over the ranges, and
only the range at the edge is numbered by document, so a source with a third of
all rows is never sorted as a whole.

Defined results: null and empty texts have size 0 and are taken 0 times; a
source without words has target 0; the null source is a source of its own and
comes last; equal hashes are ordered by doc_id; an empty table gives
no rows. Columns other than doc_id, text and source are not read by ``mix``, which carries
those it is told to keep; ``repeat_documents`` returns all columns as they are, and rows of one
doc_id, or of none, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.operators.ordering import dense_position
from docflow.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 4096
SEED = 17


def with_sizes(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, number of words, seeded hash; and the columns to keep."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        # 52 bits of a seeded hash, the same in any engine that has md5.
        F.conv(
            F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string"))), 1, 13), 16, 10
        ).cast("bigint").alias("draw"),
        *keep,
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3
) -> DataFrame:
    """source, source_size and target, by water-filling with clamps.

    Sources by code point, null last, weigh ``weights``, repeating.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_position(totals, [F.col("source").asc_nulls_last()], "_rank")
    shares = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(
        ranked.withColumn("_weight", F.element_at(shares, (F.col("_rank") % len(weights) + 1).cast("int"))),
        "sources",
    )
    top = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    level = float("inf")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        # Sources already at their clamp, and the weight of the others.
        clamped = top < F.col("_weight") * level if level < float("inf") else F.lit(False)
        taken, weight = table.agg(
            F.coalesce(F.sum(F.when(clamped, top)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("_weight"))), F.lit(0.0)),
        ).first()
        new = (total - taken) / weight if weight else float("inf")
        if level < float("inf") and new <= level or not weight:
            break
        level = new
    return table.select(
        "source",
        "source_size",
        F.least(top, F.col("_weight") * F.lit(level)).alias("target") if level < float("inf") else top.alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_epochs: int = 3,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, part and taken; and the columns to keep.

    ``copies`` whole copies and ``part`` words of one more make ``taken`` words. Documents of
    equal hash and id are ordered by the columns to keep.
    """
    sizes = materialize(with_sizes(docs, keep), "sizes")
    targets = materialize(source_targets(sizes, weights, max_epochs), "targets").withColumn(
        # Words left for the documents that get one copy more.
        "_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn(
        "_rest", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("bigint")
    )
    same = F.expr("source <=> _source")
    width = (1 << 52) // RANGES
    sizes = sizes.withColumn("_range", F.expr(f"draw div {width}L"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("source", "_range").agg(F.sum("size").alias("_words")).withColumn(
        "_start", F.coalesce(F.sum("_words").over(before), F.lit(0))
    )
    plan = ranges.join(targets.withColumnRenamed("source", "_source"), same).select(
        "_source",
        F.col("_range").alias("_r"),
        "source_size",
        "target",
        "_whole",
        (F.col("_rest") - F.col("_start")).alias("_left"),
        ((F.col("_rest") > F.col("_start")) & (F.col("_rest") < F.col("_start") + F.col("_words"))).alias("_edge"),
    )
    planned = sizes.join(plan, same & (F.col("_range") == F.col("_r"))).drop("_source", "_r")
    earlier = (
        Window.partitionBy("source", "_range")
        .orderBy("draw", "doc_id", *keep)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = planned.filter("_edge").withColumn(
        "_left", F.col("_left") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    )
    every = inner.unionByName(planned.filter("not _edge"))
    part = F.greatest(F.lit(0), F.least("size", "_left"))
    return every.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.col("_whole").cast("bigint").alias("copies"),
        part.cast("bigint").alias("part"),
        (F.col("_whole") * F.col("size") + part).cast("bigint").alias("taken"),
        *keep,
    )


def repeat_documents(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3
) -> DataFrame:
    """The mix as rows of ``docs``, each as often as it is taken.

    A text is never cut: the edge document of a source gives a whole copy if
    half of it or more is taken. Texts without words are kept once. ``docs`` is read
    twice and must give the same rows in the same partitions, as a stored table does.
    """
    keyed = docs.withColumn("_row_key", F.monotonically_increasing_id())
    plan = mix(keyed.select("doc_id", "text", "source", "_row_key"), weights, max_epochs, ["_row_key"])
    times = plan.select(
        "_row_key",
        F.when(F.col("size") == 0, 1)
        .otherwise(F.col("copies") + (2 * F.col("part") >= F.col("size")).cast("int"))
        .alias("_times"),
    ).filter("_times > 0")
    return (
        keyed.join(times, "_row_key")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times").cast("bigint"))))
        .select(*docs.columns)
    )
