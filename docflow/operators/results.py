"""Rolling pages up into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.operators.ordering import PAGE_BLOCK, document_blocks, page_block

USAGE = ("input_tokens", "cached_tokens", "output_tokens", "total_tokens")


def page_usage(df: DataFrame, prompt_ids: str = "prompt_token_ids", output_ids: str = "token_ids") -> DataFrame:
    """Token counts of a page from its token arrays; a missing array counts 0."""

    def count(ids: str) -> Column:
        return F.when(F.col(ids).isNull(), 0).otherwise(F.size(ids)).cast("bigint")

    return (
        df.withColumn("input_tokens", count(prompt_ids))
        .withColumn("cached_tokens", F.lit(0).cast("bigint"))
        .withColumn("output_tokens", count(output_ids))
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    )


def _usage_sums(df: DataFrame) -> list[Column]:
    """Sums of the four counters; absent columns and nulls count 0."""
    parts = {
        "input_tokens": F.coalesce("input_tokens", F.lit(0)),
        "cached_tokens": F.coalesce("cached_tokens", F.lit(0)) if "cached_tokens" in df.columns else F.lit(0),
        "output_tokens": F.coalesce("output_tokens", F.lit(0)),
    }
    parts["total_tokens"] = (
        F.coalesce("total_tokens", F.lit(0))
        if "total_tokens" in df.columns
        else parts["input_tokens"] + parts["output_tokens"]
    )
    return [F.coalesce(F.sum(part), F.lit(0)).cast("bigint").alias(name) for name, part in parts.items()]


def document_usage(pages: DataFrame) -> DataFrame:
    """Token counters per document, with their two other names."""
    return (
        pages.groupBy("document_index")
        .agg(*_usage_sums(pages))
        .withColumn("prompt_tokens", F.col("input_tokens"))
        .withColumn("completion_tokens", F.col("output_tokens"))
    )


def usage_struct() -> Column:
    """Usage as it stands in a document result."""
    return F.struct(
        *USAGE,
        F.col("input_tokens").alias("prompt_tokens"),
        F.col("output_tokens").alias("completion_tokens"),
        F.struct("cached_tokens").alias("input_tokens_details"),
    )


def document_summary(status: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document: status, usage (zero if failed) and pages done."""
    totals = pages.filter("error is null").groupBy("document_index").agg(
        F.count(F.lit(1)).alias("pages_done"), *_usage_sums(pages)
    )
    return summary_of(status, totals)


def summary_of(status: DataFrame, totals: DataFrame) -> DataFrame:
    """Status with the usage and pages done of each document, from their totals."""
    ok = F.col("status") == "ok"
    joined = status.join(totals, "document_index", "left")
    for name in USAGE:
        joined = joined.withColumn(name, F.when(ok, F.coalesce(name, F.lit(0))).otherwise(0))
    return joined.withColumn("pages_done", F.coalesce("pages_done", F.lit(0)))


def incomplete_documents(summary: DataFrame) -> DataFrame:
    """Documents that have not failed but lack a page result."""
    return summary.filter("status = 'ok' and pages_done < page_count")


def document_results(summary: DataFrame, pages: DataFrame, block: int = PAGE_BLOCK) -> DataFrame:
    """Finished documents with their page results in order.

    A failed document has no results and zero usage, but keeps its page count.
    A document of more than ``block`` pages comes in ``part_count`` rows, each
    with the next ``block`` pages and the same header, so no row and no task
    has to hold a whole large document. ``part_index`` counts from 0.
    """
    page = F.struct(
        "page_index",
        F.struct(
            "raw_text",
            "clean_text",
            F.transform(
                "detections",
                lambda d: F.struct(*[d[name].alias(name) for name in ("label", "bbox_norm", "bbox")]),
            ).alias("detections"),
            "has_eos",
            F.struct("width", "height").alias("image_size"),
        ).alias("result"),
    )
    collected = (
        pages.filter("error is null")
        .withColumn("part_index", page_block("page_index", block))
        .groupBy("document_index", "part_index")
        .agg(F.array_sort(F.collect_list(page)).alias("_pages"))
    )
    finished = summary.filter("status = 'failed' or pages_done = page_count")
    parts = document_blocks(
        finished.withColumn("part_count", F.expr(f"greatest(page_count - 1, 0L) div {block} + 1")), block
    )
    joined = parts.join(collected, ["document_index", "part_index"], "left")
    page_results = F.when(F.col("status") == "ok", F.transform("_pages", lambda p: p["result"]))
    empty = F.array().cast(joined.select(page_results).schema[0].dataType)
    # Failed documents need one row only, whatever their page count.
    return (
        joined.filter("status = 'ok' or part_index = 0")
        .withColumn("part_count", F.when(F.col("status") == "ok", F.col("part_count")).otherwise(1))
        .withColumn("results", F.coalesce(page_results, empty))
        .withColumn("usage", usage_struct())
        .drop("_pages")
    )


def result_lines(results: DataFrame) -> DataFrame:
    """Document results as JSON lines, with their sort columns.

    Null fields are left out, so ``error`` shows on failed documents only.
    """
    fields = [
        F.col("document_index"),
        F.col("document_path"),
        F.col("status"),
        F.col("error"),
        F.col("page_count"),
        F.col("part_index"),
        F.col("part_count"),
        F.col("results"),
        F.col("usage"),
    ]
    if "timings" in results.columns:
        fields.append(F.col("timings"))
    return results.select("document_index", "part_index", F.to_json(F.struct(*fields)).alias("value"))


def result_pieces(results: DataFrame) -> DataFrame:
    """Document results as pieces of JSON lines: the pieces of a document, put together, are its one line.

    The first piece has all that stands before the page results, every piece its part of them, and
    the last one what stands behind.
    """
    head = ["document_index", "document_path", "status", "error", "page_count"]
    tail = ["usage", *(["timings"] if "timings" in results.columns else [])]

    def inner(names: list[str]) -> Column:
        """The JSON of some fields without its braces."""
        text = F.to_json(F.struct(*names))
        return F.substring(text, F.lit(2), F.length(text) - 2)

    pages = F.to_json("results")
    first, last = F.col("part_index") == 0, F.col("part_index") == F.col("part_count") - 1
    piece = F.concat(
        F.when(first, F.concat(F.lit("{"), inner(head), F.lit(',"results":['))).otherwise(F.lit(",")),
        F.substring(pages, F.lit(2), F.length(pages) - 2),
        F.when(last, F.concat(F.lit("],"), inner(tail), F.lit("}\n"))).otherwise(F.lit("")),
    )
    return results.select("document_index", "part_index", piece.alias("piece"))


def request_responses(results: DataFrame, timing: DataFrame) -> DataFrame:
    """Responses to requests, a request being a document: status code, body and timing as JSON.

    The body holds page count, page results in order and usage, or the error as
    ``detail``. ``timing`` has ``request_id``, ``total_ms`` and ``steps``. A
    request of several parts has a row for each, like its results.
    """
    ok = F.col("status") == "ok"
    body = F.when(ok, F.to_json(F.struct("page_count", "results", "usage"))).otherwise(
        F.to_json(F.struct(F.col("error").alias("detail")))
    )
    spent = timing.select(
        F.col("request_id").alias("document_index"), F.to_json(F.struct("total_ms", "steps")).alias("timing")
    )
    return results.join(spent, "document_index", "left").select(
        F.col("document_index").alias("request_id"),
        "part_index",
        F.when(ok, 200).otherwise(500).alias("status_code"),
        body.alias("body"),
        "timing",
    )


def failures(status: DataFrame) -> DataFrame:
    """Failed documents with their error, in document order."""
    return (
        status.filter("status = 'failed'")
        .select("document_index", "document_path", "error")
        .orderBy("document_index")
    )
