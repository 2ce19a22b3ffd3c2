"""Running a model over page batches."""

from __future__ import annotations

import sys
import time
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from docflow import constants as C
from docflow.functions import markup
from docflow.operators.ordering import join_by_block
from docflow.session import task_count

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
# Integers with nulls stay integers on the way back to Spark.
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.bool_(): pd.BooleanDtype()}


def worker_object(name: str, build: Callable[[], Any], version: str = "") -> Any:
    """An object built once per Python worker and version, such as a loaded model.

    The package travels with the task, so its own globals start anew each
    time; the cache therefore lives in a module of the worker process. A worker
    outlives a job, so callers give a version; only the newest is kept.
    """
    cache = sys.modules.setdefault("_docflow_worker", types.ModuleType("_docflow_worker"))
    held = getattr(cache, name, None)
    if held is None or held[0] != version:
        held = (version, build())
        setattr(cache, name, held)
    return held[1]


def _call(rows: pd.DataFrame, scorer: Scorer, fields: list[tuple[str, pa.DataType]]) -> tuple[list[pa.Array] | None, str | None]:
    """The output columns of one batch in the declared types, or its error."""
    try:
        scored = scorer(rows)
        if len(scored) != len(rows):
            return None, C.COUNT_MISMATCH_ERROR.format(outputs=len(scored), inputs=len(rows))
        return [pa.Array.from_pandas(scored[name], type=kind) for name, kind in fields], None
    except Exception as exc:  # noqa: BLE001 - any model error is data here
        return None, f"missing output {exc}" if isinstance(exc, KeyError) else str(exc) or C.UNKNOWN_ERROR


def run_scorer(rows: pd.DataFrame, scorer: Scorer, outputs: T.StructType) -> pd.DataFrame:
    """Score one batch. Any error of the scorer or its outputs fails it as a whole.

    The outputs are converted to the declared types here, so a missing column
    or a wrong type is an error of this batch too.
    """
    return rows.reset_index(drop=True).assign(**run_scorer_on_each([rows], scorer, outputs))


def run_scorer_on_each(batches: Iterable[pd.DataFrame], scorer: Scorer, outputs: T.StructType) -> dict[str, Any]:
    """Score batches one after the other, each as by :func:`run_scorer`; the added columns, one below the other.

    A batch costs its call and no frame of its own, so that many small ones are cheap.
    """
    fields = [(field.name, field.type) for field in to_arrow_schema(outputs)]
    found: list[list[pa.Array]] = [[] for _ in fields]
    errors: list[str | None] = []
    seconds: list[float] = []
    for rows in batches:
        started, n = time.perf_counter(), len(rows)
        columns, error = _call(rows, scorer, fields)
        for i, (parts, (_, kind)) in enumerate(zip(found, fields)):
            values = pa.nulls(n, kind) if columns is None else columns[i]
            parts += values.chunks if isinstance(values, pa.ChunkedArray) else [values]
        errors += [error] * n
        seconds += [time.perf_counter() - started] * n
    # One array, since each chunk would be converted on its own.
    columns = {
        name: pa.chunked_array(parts, kind).combine_chunks().to_pandas(types_mapper=_NULLABLE.get)
        for parts, (name, kind) in zip(found, fields)
    }
    return columns | {"error": errors, "generate_s": seconds}


def _scored_schema(pages: DataFrame, keep: list[str], outputs: T.StructType) -> T.StructType:
    kept = [pages.schema[name] for name in keep]
    extra = [T.StructField("error", T.StringType()), T.StructField("generate_s", T.DoubleType())]
    return T.StructType(kept + list(outputs.fields) + extra)


def score_batches(
    pages: DataFrame,
    scorer: Scorer,
    outputs: T.StructType,
    keep: list[str],
    partitions: int | None = None,
    make_scorer: Callable[[], Scorer] | None = None,
) -> DataFrame:
    """Give each batch as a whole to ``scorer``; one group is one model call.

    ``scorer`` maps the pages of a batch to as many rows with the ``outputs``
    columns. ``keep`` names the page columns wanted in the result; payload
    columns are dropped right here. ``make_scorer`` builds the scorer once per
    Python worker. Adds ``error`` and the seconds of the call. A batch is
    bounded by its page count, and the number of partitions is set here so
    that small batches are not packed into few tasks. Rows come to Python sorted, in
    frames of many batches, as large as Spark's limits of Arrow batches allow, and each
    batch is cut from them; a task holds one frame and the batch that is open at its end.
    """
    schema = _scored_schema(pages, keep, outputs)
    names = schema.fieldNames()
    version = uuid.uuid4().hex
    whole = {field.name: field.dataType for field in pages.schema if isinstance(field.dataType, (T.IntegralType, T.BooleanType))}
    numpy_types = {name: np.dtype(to_arrow_type(kind).to_pandas_dtype()) for name, kind in whole.items()}

    def batches(rows: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        # A null makes a column of whole numbers another type, but only in its own batch.
        changed = [name for name, kind in numpy_types.items() if rows[name].dtype != kind]
        for start, end in zip(starts, [*starts[1:], len(rows)]):
            own = rows.iloc[start:end].reset_index(drop=True)
            back = [name for name in changed if not own[name].isna().any()]
            yield own.astype({name: numpy_types[name] for name in back}) if back else own

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = worker_object("scorer", make_scorer, version) if make_scorer else scorer

        def scored(rows: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
            return rows.assign(**run_scorer_on_each(batches(rows, starts), run, outputs))[names]

        waiting: pd.DataFrame | None = None
        for part in parts:
            rows = part if waiting is None else pd.concat([waiting, part], ignore_index=True)
            if rows.empty:
                continue
            number = rows["batch_id"]
            before = number.shift()
            starts = np.flatnonzero(~((number == before) | (number.isna() & before.isna())).to_numpy() | (np.arange(len(rows)) == 0))
            # The last batch may go on in the next frame.
            last = int(starts[-1])
            if last:
                yield scored(rows.iloc[:last].reset_index(drop=True), starts[:-1].tolist())
            waiting = rows.iloc[last:]
        if waiting is not None:
            yield scored(waiting.reset_index(drop=True), [0])

    return (
        pages.repartition(partitions or task_count(pages.sparkSession), "batch_id")
        .sortWithinPartitions("batch_id", F.asc_nulls_last("document_index"), F.asc_nulls_last("page_index"))
        .mapInPandas(score, schema)
    )


def score_stream_of_pages(
    pages: DataFrame,
    scorer: Scorer,
    outputs: T.StructType,
    keep: list[str],
    batch_pages: int = C.DEFAULT_BATCH_PAGES,
    make_scorer: Callable[[], Scorer] | None = None,
) -> DataFrame:
    """Score pages in the partitions they are in, in slices of ``batch_pages``.

    For throughput: there is no shuffle of page payloads, but batches follow
    the partitions and not the global page order. A failed slice fails alone.
    """
    if batch_pages < 1:
        raise ValueError("batch_pages must be at least 1")
    schema = _scored_schema(pages, keep, outputs)
    names = schema.fieldNames()
    version = uuid.uuid4().hex

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = worker_object("scorer", make_scorer, version) if make_scorer else scorer
        waiting: pd.DataFrame | None = None
        for part in parts:
            waiting = part if waiting is None else pd.concat([waiting, part], ignore_index=True)
            while len(waiting) >= batch_pages:
                yield run_scorer(waiting.iloc[:batch_pages], run, outputs)[names]
                waiting = waiting.iloc[batch_pages:]
        if waiting is not None and len(waiting):
            yield run_scorer(waiting, run, outputs)[names]

    return pages.mapInPandas(score, schema)


def attach_outputs(pages: DataFrame, outputs: DataFrame) -> DataFrame:
    """Pages with the model output that has the same document and page index."""
    return pages.join(outputs, ["document_index", "page_index"])


def unmatched_outputs(pages: DataFrame, outputs: DataFrame) -> DataFrame:
    """Pages without an output and outputs without a page; must be empty."""
    keys = ["document_index", "page_index"]
    left = pages.select(*keys, F.lit(True).alias("_page"))
    right = outputs.select(*keys, F.lit(True).alias("_output"))
    return (
        left.join(right, keys, "full_outer")
        .filter("_page is null or _output is null")
        .select(
            *keys,
            F.when(F.col("_page").isNull(), "page").otherwise("output").alias("missing"),
        )
    )


def page_results(scored: DataFrame) -> DataFrame:
    """Scored pages with clean text, boxes and end flag.

    A tag with readable but wrong boxes is an error of the page's batch, just
    like a model error.
    """
    raw = F.col("raw_text")
    tags = F.col("_tags")
    wrong = F.exists(tags, lambda tag: markup.wrong_boxes(tag["coords"]))
    return (
        # A column of its own, so that the text is searched for tags once.
        scored.withColumn("_tags", markup.ref_tags(raw))
        .withColumn("clean_text", markup.clean_text(raw))
        .withColumn("detections", markup.detections_of(tags, F.col("width"), F.col("height")))
        .withColumn("has_eos", markup.has_eos(raw))
        .withColumn(
            "error",
            F.coalesce("error", F.when(wrong, F.lit("detection box is not four numbers"))),
        )
        .drop("_tags")
    )


def batch_errors(scored: DataFrame) -> DataFrame:
    """One row per failed batch with its error, taken from its first failed page."""
    return (
        scored.filter("error is not null")
        .groupBy("batch_id")
        .agg(F.min_by("error", F.struct("document_index", "page_index")).alias("error"))
    )


def document_status(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """Documents with ``status``, ``error`` and ``first_failed_batch``.

    A document fails if it could not be rendered (``render_error``), has no
    pages, has a page in a batch where any page failed (then the first such
    batch counts), or lacks the result of a page. Only page keys are joined with the failed batches.
    """
    done = scored.filter("error is null").groupBy("document_index").agg(F.count(F.lit(1)).alias("_done"))
    return status_of(docs, failed_batches_of(scored), done)


def failed_batches_of(scored: DataFrame) -> DataFrame:
    """Per document with a page in a failed batch: the first such batch and its error."""
    return (
        scored.select("document_index", "batch_id")
        .join(batch_errors(scored), "batch_id")
        .groupBy("document_index")
        .agg(
            F.min("batch_id").alias("first_failed_batch"),
            F.min_by("error", "batch_id").alias("_batch_error"),
        )
    )


def status_of(docs: DataFrame, failed: DataFrame, done: DataFrame) -> DataFrame:
    """Status of the documents from their first failed batches and their numbers of pages done."""
    render_error = F.col("render_error") if "render_error" in docs.columns else F.lit(None).cast("string")
    no_pages = F.when(F.col("page_count") == 0, F.lit(C.ZERO_PAGES_ERROR))
    found = F.coalesce("_done", F.lit(0))
    missing = F.when(
        found < F.col("page_count"),
        F.format_string(C.MISSING_PAGES_ERROR, found.cast("bigint"), F.col("page_count").cast("bigint")),
    )
    return (
        docs.join(failed, "document_index", "left")
        .join(done, "document_index", "left")
        .withColumn("error", F.coalesce(render_error, no_pages, "_batch_error", missing))
        .withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
        .drop("_batch_error", "_done")
    )


def generated_pages(scored: DataFrame, status: DataFrame) -> DataFrame:
    """Pages that were really generated.

    A page of a document's first failed batch, or of a later batch, was not.
    """
    first = status.select("document_index", "page_count", "first_failed_batch")
    return (
        join_by_block(scored, first)
        .filter("first_failed_batch is null or batch_id < first_failed_batch")
        .drop("first_failed_batch")
    )


def active_pages(pages: DataFrame, status: DataFrame) -> DataFrame:
    """Pages of documents that have not failed."""
    failed = status.filter("status = 'failed'").select("document_index", "page_count")
    return join_by_block(pages, failed, "left_anti")


def dropped_pages(pages: DataFrame, status: DataFrame) -> DataFrame:
    """Pages of failed documents."""
    failed = status.filter("status = 'failed'").select("document_index", "page_count")
    return join_by_block(pages, failed, "left_semi")


def failed_documents(scored: DataFrame) -> DataFrame:
    """Sorted distinct documents with a page in a failed batch."""
    failed = scored.select("document_index", "batch_id").join(batch_errors(scored), "batch_id")
    return failed.select("document_index").distinct().orderBy("document_index")
