"""A whole corpus run: pages in, documents, failures and metrics out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow import constants as C
from docflow.operators import batching, facts, metrics, results, scoring
from docflow.operators.ordering import PAGE_BLOCK
from docflow.plans import waves
from docflow.session import materialize
from docflow.sources import named_files, sinks


def score_corpus(
    pages: DataFrame,
    docs: DataFrame,
    scorer: scoring.Scorer,
    outputs: T.StructType,
    keep: list[str],
    batch_pages: int = C.DEFAULT_BATCH_PAGES,
    make_scorer: Callable[[], scoring.Scorer] | None = None,
) -> DataFrame:
    """Batch and score all pages. Costly, so the caller stores the result."""
    ready = batching.page_batches(pages, docs, batch_pages)
    return scoring.score_batches(ready, scorer, outputs, keep, make_scorer=make_scorer)


def finished_pages(scored: DataFrame, path: str | None = None) -> DataFrame:
    """Page results as a stored table, at ``path`` or in the shared folder.

    Status, usage and results read them, and the model must run only once.
    """
    return materialize(scoring.page_results(scored), "page_results", path)


def document_results(docs: DataFrame, scored: DataFrame, block: int = PAGE_BLOCK) -> DataFrame:
    """Scored pages to document results, of at most ``block`` pages each."""
    pages = finished_pages(scored)
    summary = results.document_summary(scoring.document_status(docs, pages), pages)
    return results.document_results(summary, pages, block)


def corpus_metrics(docs: DataFrame, pages: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    """Totals, generated totals, stage seconds and rates in one row, from one pass over the pages.

    Without ``elapsed_s`` the time is the sum of the stages.
    """
    return facts_metrics(docs, run_facts(pages), elapsed_s)


def run_facts(pages: DataFrame) -> DataFrame:
    """The facts of the pages as a stored table; a run without preprocessing times spent none there."""
    return materialize(facts.page_facts(_with_preprocessing(pages)), "page_facts")


def facts_metrics(docs: DataFrame, found: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    """As :func:`corpus_metrics`, from stored facts."""
    status = facts.document_status(docs, found)
    generated = facts.generated(found, status)
    # Three one-row frames with different columns, put side by side.
    rows = (
        metrics.corpus_totals(facts.document_summary(status, found))
        .unionByName(facts.generated_totals(generated), allowMissingColumns=True)
        .unionByName(metrics.stage_totals(docs, generated), allowMissingColumns=True)
    )
    row = rows.agg(*[F.max(name).alias(name) for name in rows.columns])
    elapsed = F.lit(elapsed_s) if elapsed_s is not None else F.col("render_s") + F.col("inference_s")
    timed = row.withColumn("elapsed_s", F.round(elapsed, 6))
    rates = [
        metrics.rate(F.col(amount), F.col("elapsed_s")).alias(name)
        for amount, name in (
            ("pages", "pages_per_second"),
            ("total_tokens", "tokens_per_second"),
            ("generated_pages", "generated_pages_per_second"),
            ("generated_total_tokens", "generated_tokens_per_second"),
        )
    ]
    return timed.select("*", *rates)


@dataclass
class CorpusOutput:
    """Folders written by :func:`run_corpus`."""

    page_results: str
    results: str
    metrics: str
    batches: str
    failures: str


def run_corpus(
    pages: DataFrame,
    docs: DataFrame,
    scorer: scoring.Scorer,
    outputs: T.StructType,
    keep: list[str],
    folder: str,
    batch_pages: int = C.DEFAULT_BATCH_PAGES,
    make_scorer: Callable[[], scoring.Scorer] | None = None,
    one_line: bool = False,
    first_wave: int | None = None,
    config: dict[str, object] | None = None,
) -> CorpusOutput:
    """Score a corpus and write page results, documents, metrics, batches and failures.

    ``docs`` has ``document_index``, ``document_path``, ``page_count``,
    ``render_s`` and optionally ``render_error``. Batches and failures grow
    with the corpus, so they are tables next to the metrics object and not
    lists inside it.

    With ``first_wave`` pages are scored in waves, of so many batches at first, that pass over the
    documents that failed, and a run that is started again goes on behind the last stored wave.
    With ``one_line`` each document is one JSON line however many pages it has.
    ``config`` holds settings of the run that stand in the metrics object as they are.
    """
    started = time.perf_counter()
    target = CorpusOutput(*[f"{folder}/{field.name}" for field in fields(CorpusOutput)])
    if first_wave is None:
        scored = score_corpus(pages, docs, scorer, outputs, keep, batch_pages, make_scorer)
        done = finished_pages(_with_preprocessing(scored), target.page_results)
    else:
        done = waves.score_in_waves(
            pages, docs, scorer, outputs, keep, target.page_results, batch_pages, first_wave, make_scorer
        )
        done = _with_preprocessing(done)
    found = run_facts(done)
    status = facts.document_status(docs, found)
    summary = facts.document_summary(status, found)
    write = named_files.write_result_lines if one_line else sinks.write_results
    write(results.document_results(with_timings(summary, found), done), target.results)
    results.failures(status).write.json(target.failures)
    facts.batch_metrics(facts.generated(found, status)).orderBy("batch_id").write.json(target.batches)
    elapsed = time.perf_counter() - started
    totals = facts_metrics(docs, found, elapsed)
    if config:
        totals = totals.withColumn("config", F.struct(*[F.lit(value).alias(key) for key, value in config.items()]))
    sinks.write_metrics(totals, target.metrics)
    return target


def _with_preprocessing(scored: DataFrame) -> DataFrame:
    return scored if "preprocess_s" in scored.columns else scored.withColumn("preprocess_s", F.lit(0.0))


def with_timings(summary: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``timings``: seconds to render, and with the document's batches in total.

    ``pages`` may be page results or their facts.
    """
    per_batch = pages.groupBy("document_index", "batch_id").agg(
        F.max(F.col("preprocess_s") + F.col("generate_s")).alias("_batch_s")
    )
    inference = per_batch.groupBy("document_index").agg(F.sum("_batch_s").alias("_inference_s"))
    total = F.col("render_s") + F.coalesce("_inference_s", F.lit(0.0))
    return (
        summary.join(inference, "document_index", "left")
        .withColumn(
            "timings",
            F.struct(F.round("render_s", 6).alias("render_s"), F.round(total, 6).alias("total_s")),
        )
        .drop("_inference_s")
    )
