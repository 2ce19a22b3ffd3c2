"""Corpus totals, rates, batch metrics and request timing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow import constants as C
from docflow.operators.results import USAGE, _usage_sums


def _sum_if(condition: Column, value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")


def corpus_totals(summary: DataFrame) -> DataFrame:
    """Document counts, and pages and tokens of successful documents."""
    ok = F.col("status") == "ok"
    return summary.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        _sum_if(ok, "page_count").alias("pages"),
        *[_sum_if(ok, name).alias(name) for name in USAGE],
    )


def generated_totals(generated: DataFrame) -> DataFrame:
    """Pages and tokens the model really produced, failed documents included."""
    totals = generated.agg(F.count(F.lit(1)).alias("generated_pages"), *_usage_sums(generated))
    return totals.select("generated_pages", *[F.col(name).alias(f"generated_{name}") for name in USAGE])


def rate(amount: Column, seconds: Column) -> Column:
    """Amount per second, 0 when no time has passed."""
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))


def throughput(totals: DataFrame, elapsed: str = "elapsed_s") -> DataFrame:
    """Rates of a one-row frame with corpus totals, generated totals and time."""
    seconds = F.col(elapsed)
    return totals.select(
        F.round(seconds, 6).alias("elapsed_s"),
        rate(F.col("pages"), seconds).alias("pages_per_second"),
        rate(F.col("total_tokens"), seconds).alias("tokens_per_second"),
        rate(F.col("generated_pages"), seconds).alias("generated_pages_per_second"),
        rate(F.col("generated_total_tokens"), seconds).alias("generated_tokens_per_second"),
    )


def batch_metrics(pages: DataFrame) -> DataFrame:
    """Per successful batch: pages, documents, seconds per stage, pages per second.

    Stage seconds are the same on all pages of a batch.
    """
    grouped = pages.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_distinct("document_index").alias("documents"),
        F.max("preprocess_s").alias("preprocess_s"),
        F.max("generate_s").alias("generate_s"),
    )
    return batch_rates(grouped)


def batch_rates(batches: DataFrame) -> DataFrame:
    """Rounded seconds, their total, and pages per second of each batch."""
    total = F.col("preprocess_s") + F.col("generate_s")
    return batches.select(
        "batch_id",
        "pages",
        "documents",
        F.round("preprocess_s", 6).alias("preprocess_s"),
        F.round("generate_s", 6).alias("generate_s"),
        F.round(total, 6).alias("total_s"),
        rate(F.col("pages"), total).alias("pages_per_second"),
    )


def stage_totals(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Seconds spent per stage over the whole corpus."""
    batches = pages.groupBy("batch_id").agg(
        F.max("preprocess_s").alias("preprocess_s"), F.max("generate_s").alias("generate_s")
    )
    stages = docs.select(
        F.col("render_s"), F.lit(0.0).alias("preprocess_s"), F.lit(0.0).alias("generate_s")
    ).unionByName(batches.select(F.lit(0.0).alias("render_s"), "preprocess_s", "generate_s"))
    inference = F.col("preprocess_s") + F.col("generate_s")
    return stages.agg(
        *[
            F.round(F.coalesce(F.sum(value), F.lit(0.0)), 6).alias(name)
            for name, value in (
                ("render_s", F.col("render_s")),
                ("preprocess_s", F.col("preprocess_s")),
                ("generate_s", F.col("generate_s")),
                ("inference_s", inference),
            )
        ]
    )


def inference_stats(pages: DataFrame) -> DataFrame:
    """Pages, tokens and token rates over the time spent generating."""
    batches = pages.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.max("generate_s").alias("generate_s"),
    )
    totals = batches.agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum("generate_s"), F.lit(0.0)), 6).alias("generate_s"),
    )
    seconds = F.col("generate_s")
    return totals.withColumn(
        "prompt_tokens_per_second", rate(F.col("prompt_tokens"), seconds)
    ).withColumn("output_tokens_per_second", rate(F.col("output_tokens"), seconds))


def _rounded(ms: Column) -> Column:
    """Whole milliseconds, halves to the even neighbour."""
    return F.bround(ms, 0).cast("bigint")


def request_timing(
    spans: DataFrame,
    totals: DataFrame | None = None,
    steps: Sequence[str] = C.TIMING_STEPS,
) -> DataFrame:
    """Time per request and step: ``total_ms`` and ``steps``, a map of milliseconds.

    ``spans`` has ``request_id``, ``step``, ``ms``. Negative spans count 0, spans
    of one step add up, and all default steps are present. ``totals`` has
    ``request_id`` and ``total_ms``; time not covered by any step is reported
    from half a millisecond on. Steps are summed before they are collected, so
    a request has one entry per step name.
    """
    per_step = spans.groupBy("request_id", "step").agg(
        F.sum(F.greatest(F.col("ms"), F.lit(0))).cast("double").alias("ms")
    )
    requests = per_step.groupBy("request_id").agg(
        F.sum("ms").alias("_accounted"),
        F.map_from_entries(F.collect_list(F.struct("step", "ms"))).alias("_steps"),
    )
    if totals is not None:
        requests = totals.select("request_id", F.col("total_ms").alias("_total")).join(
            requests, "request_id", "left"
        )
    else:
        requests = requests.withColumn("_total", F.col("_accounted"))
    return timing_of(requests, steps)


def timing_of(requests: DataFrame, steps: Sequence[str] = C.TIMING_STEPS) -> DataFrame:
    """Timing from ``_total``, ``_accounted`` and ``_steps``, the sums of a request's spans; the latter may be null."""
    defaults = F.create_map(*[F.lit(item) for step in steps for item in (step, 0.0)])
    empty = F.map_from_entries(F.filter(F.map_entries(defaults), lambda entry: F.lit(False)))
    rest = F.col("_total") - F.coalesce("_accounted", F.lit(0.0))
    unaccounted = F.when(
        rest >= C.UNACCOUNTED_MIN_MS, F.create_map(F.lit(C.UNACCOUNTED_STEP), rest)
    ).otherwise(empty)
    known = F.map_zip_with(
        defaults, F.coalesce("_steps", empty), lambda step, default, ms: F.coalesce(ms, default)
    )
    return requests.select(
        "request_id",
        _rounded(F.col("_total")).alias("total_ms"),
        F.transform_values(
            F.map_zip_with(known, unaccounted, lambda step, ms, extra: F.coalesce(ms, extra)),
            lambda step, ms: _rounded(ms),
        ).alias("steps"),
    )


def request_steps(timing: DataFrame) -> DataFrame:
    """Request timing in long form."""
    return timing.select("request_id", "total_ms", F.explode("steps").alias("step", "ms"))


def request_batch_timing(pages: DataFrame, request: str = "document_index") -> DataFrame:
    """Model time per request: longest queue wait, and each batch counted once.

    Of the pages a request has in one batch, the first gives the batch's times.
    """
    per_batch = pages.groupBy(request, "batch_id").agg(
        F.max("queue_wait_ms").alias("_wait"),
        F.min_by("gpu_ms", "page_index").alias("_gpu"),
        F.min_by("post_ms", "page_index").alias("_post"),
    )
    wait = F.max("_wait")
    return per_batch.groupBy(request).agg(
        F.when(wait > 0, wait).alias("gpu_queue_wait"),
        F.sum("_gpu").alias("gpu_generate"),
        F.sum("_post").alias("postprocess_cpu"),
        F.count("batch_id").alias("gpu_batches"),
    )
