"""All numbers of a run from one pass over its page results.

``page_facts`` adds up each document's pages of each batch. What comes of it has no texts and a
row per document and batch, and from it follow status, usage, batch metrics and totals, so page
results are read once however many numbers are wanted. It is a table and not a set of observed
metrics: those count the rows of a task twice if it runs again after its executor was lost.

A document without any page result has no facts; one without a batch number belongs to no batch
and its pages count as done only. Facts of the same document and batch from several runs over
different pages may be put together: every operator here adds them up again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators import metrics, results, scoring
from docflow.operators.results import USAGE


def page_facts(pages: DataFrame) -> DataFrame:
    """One row per document and batch: pages, pages done, their tokens, seconds, and the first error.

    A group holds at most the pages of one batch.
    """
    done = F.col("error").isNull()
    usage = [F.coalesce(F.sum(F.when(done, part)), F.lit(0)).cast("bigint").alias(name) for name, part in _usage(pages)]
    return pages.groupBy("document_index", "batch_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(done).alias("pages_done"),
        *usage,
        F.max("preprocess_s").alias("preprocess_s"),
        F.max("generate_s").alias("generate_s"),
        F.min_by("error", F.when(~done, F.col("page_index"))).alias("error"),
        F.min(F.when(~done, F.col("page_index"))).alias("page_index"),
    )


def _usage(pages: DataFrame) -> list[tuple[str, Column]]:
    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0)) if name in pages.columns else F.lit(0)

    both = count("total_tokens") if "total_tokens" in pages.columns else count("input_tokens") + count("output_tokens")
    return [(name, both if name == "total_tokens" else count(name)) for name in USAGE]


def document_status(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """As :func:`scoring.document_status`, from facts."""
    done = facts.groupBy("document_index").agg(F.sum("pages_done").alias("_done"))
    return scoring.status_of(docs, scoring.failed_batches_of(facts), done)


def document_summary(status: DataFrame, facts: DataFrame) -> DataFrame:
    """As :func:`results.document_summary`, from facts."""
    totals = facts.groupBy("document_index").agg(
        F.sum("pages_done").alias("pages_done"), *[F.sum(name).alias(name) for name in USAGE]
    )
    return results.summary_of(status, totals)


def generated(facts: DataFrame, status: DataFrame) -> DataFrame:
    """Facts of what was really generated: nothing of a document's first failed batch or a later one."""
    first = status.select("document_index", "first_failed_batch")
    return (
        facts.join(first, "document_index")
        .filter("first_failed_batch is null or batch_id < first_failed_batch")
        .drop("first_failed_batch")
    )


def batch_facts(facts: DataFrame) -> DataFrame:
    """One row per batch, with the number of its documents."""
    return facts.groupBy("batch_id").agg(
        F.sum("pages").alias("pages"),
        F.count_distinct("document_index").alias("documents"),
        *[F.sum(name).alias(name) for name in USAGE],
        F.max("preprocess_s").alias("preprocess_s"),
        F.max("generate_s").alias("generate_s"),
    )


def batch_metrics(facts: DataFrame) -> DataFrame:
    """As :func:`metrics.batch_metrics`, from facts."""
    return metrics.batch_rates(batch_facts(facts))


def generated_totals(facts: DataFrame) -> DataFrame:
    """As :func:`metrics.generated_totals`, from facts."""
    return facts.agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("generated_pages"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(f"generated_{name}") for name in USAGE],
    )
