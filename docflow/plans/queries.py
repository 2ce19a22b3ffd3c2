"""Registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators import batching, facts, markup, metrics, pages, results, scoring
from docflow.operators.ordering import dense_position, document_blocks
from docflow.plans import corpus, inputs, waves
from docflow.session import new_folder, task_count
from docflow.sources import files, named_files, sinks
from docflow.streaming import batches as stream_batches
from docflow.streaming import completion
from docflow.streaming import deltas as stream_deltas
from docflow.streaming import microbatch, repetition, runner
from docflow.streaming import timing as stream_timing
from docflow.streaming import usage as stream_usage

Query = Callable[[SparkSession, str], DataFrame]

WAIT_US = 6 * 3600 * 1_000_000
QUEUE_ROWS = 5
SHARED_WAIT_US = 20 * 60 * 1_000_000
SHARED_ROWS = 6
IDLE_MS = 200
CONTEXT = 1200
REPEAT_N, REPEAT_WINDOW, REPEAT_WHITELIST = 3, 12, (2,)

_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


PAGE = ["document_index", "page_index"]


# -- sources and sinks -------------------------------------------------------


@query
def ext_filter(spark, folder):
    return files.filter_documents(inputs.files(spark, folder))


@query
def document_index(spark, folder):
    return files.document_index(inputs.files(spark, folder), tie="page_id")


@query
def limit_docs(spark, folder):
    return files.limit_documents(files.filter_documents(inputs.files(spark, folder)), 20)


@query
def decode_batch_requests(spark, folder):
    decoded = files.decode_requests(inputs.requests(spark, folder))
    return decoded.select("request_id", "page_index", "prompt", F.decode("payload", "UTF-8").alias("payload"))


@query
def rejected_requests(spark, folder):
    return files.rejected_requests(inputs.requests(spark, folder, gaps=True))


@query
def raw_requests(spark, folder):
    return files.check_raw_requests(inputs.raw_requests(spark, folder)).drop("body")


@query
def image_sizes(spark, folder):
    return files.payload_sizes(inputs.image_payloads(spark, folder), "payload").select(*PAGE, "width", "height", "error")


@query
def results_jsonl(spark, folder):
    return results.result_lines(_results(spark, folder)).select("document_index", "value")


@query
def metrics_json(spark, folder):
    return sinks.metrics_lines(_corpus_metrics(spark, folder))


@query
def markdown_sink(spark, folder):
    docs = document_blocks(inputs.documents(spark, folder).drop("text"))
    named = (
        markup.markdown_pages(inputs.ocr(spark, folder))
        .join(docs, ["document_index", "part_index"])
        .select(
            "document_index",
            "document_path",
            sinks.pdf_outputs(F.col("document_path"))["markdown"].alias("out_name"),
            "part_index",
            "markdown",
        )
    )
    target = new_folder(spark, "markdown")
    sinks.write_markdown(named, target)
    schema = "document_index bigint, document_path string, out_name string, part_index bigint, markdown string"
    return spark.read.schema(schema).json(target)


@query
def named_markdown_files(spark, folder):
    """Tagged markdown as a file of its own name for each document, read back."""
    docs = inputs.documents(spark, folder).drop("text")
    target = new_folder(spark, "named")
    named_files.write_named(sinks.markdown_files(inputs.ocr(spark, folder), docs, "tagged"), target, ["part_index"])
    read = named_files.read_named(spark, target)
    return read.select(F.concat_ws("/", F.slice(F.split("path", "/"), -3, 3)).alias("file"), F.col("value").alias("markdown"))


@query
def one_line_results(spark, folder):
    """Documents in parts of two pages, written as one JSON line each, read back."""
    docs = inputs.documents(spark, folder).drop("text")
    target = new_folder(spark, "lines")
    named_files.write_result_lines(corpus.document_results(docs, inputs.scored(spark, folder), block=2), target)
    return spark.read.schema("value string").text(target)


@query
def output_names(spark, folder):
    docs = inputs.documents(spark, folder)
    image = F.replace(F.col("document_path"), F.lit(".pdf"), F.expr("if(document_index % 2 = 0, '.jpg', '.png')"))
    return docs.select(
        "document_index", sinks.pdf_outputs(F.col("document_path")).alias("_n"), sinks.image_output(image).alias("image")
    ).select("document_index", "_n.tagged", "_n.markdown", "_n.layout", "image")


# -- pages -------------------------------------------------------------------


@query
def page_explode(spark, folder):
    return pages.explode_pages(inputs.documents(spark, folder)).select(*PAGE)


@query
def zero_page_docs(spark, folder):
    docs = inputs.documents(spark, folder).select("document_index", "document_path")
    return pages.zero_page_docs(docs, inputs.page_sizes(spark, folder, gaps=True))


@query
def prompt_check(spark, folder):
    prompts = """case document_index % 5 when 0 then '' when 1 then '<image>\\nFree OCR.'
      when 2 then 'Free OCR.' when 3 then '<image><image>' end"""
    return pages.check_prompts(
        inputs.documents(spark, folder).select("document_index", F.expr(prompts).alias("prompt"))
    )


@query
def page_pixels(spark, folder):
    points = inputs.page_sizes(spark, folder).select(
        *PAGE, F.expr("width / 3").alias("width_pt"), F.expr("height / 4").alias("height_pt")
    )
    return pages.page_pixels(points, 200).select(*PAGE, "width", "height")


@query
def eos_flag(spark, folder):
    return pages.flag_eos(inputs.ocr(spark, folder)).select(*PAGE, "has_eos")


@query
def drop_no_eos(spark, folder):
    return pages.drop_unfinished(pages.flag_eos(inputs.ocr(spark, folder))).select(*PAGE)


@query
def kept_page_index(spark, folder):
    kept = pages.drop_unfinished(pages.flag_eos(inputs.ocr(spark, folder))).select(*PAGE)
    return pages.number_kept_pages(kept).select(*PAGE, "kept_index")


@query
def over_budget_pages(spark, folder):
    return pages.over_budget(inputs.ocr(spark, folder), CONTEXT).select(*PAGE, "input_tokens", "output_tokens")


@query
def tile_plan(spark, folder):
    return pages.plan_tiles(inputs.page_sizes(spark, folder)).select(*PAGE, "width", "height", "tiles_w", "tiles_h")


@query
def tile_ratios(spark, folder):
    """Pages per tiling, the unused candidates included."""
    plan = pages.plan_tiles(inputs.page_sizes(spark, folder))
    return pages.tiling_usage(plan)


@query
def tile_boxes(spark, folder):
    boxes = pages.tile_boxes(pages.plan_tiles(inputs.page_sizes(spark, folder)))
    return boxes.select(*PAGE, "tile_index", "left", "top", "right", "bottom")


@query
def image_tokens(spark, folder):
    sized = inputs.page_sizes(spark, folder)
    plain = pages.plan_tokens(sized, crop_mode=False).withColumnRenamed("image_tokens", "uncropped_tokens")
    return pages.plan_tokens(plain.drop("tiles_w", "tiles_h")).select(*PAGE, "image_tokens", "uncropped_tokens")


# -- model output ------------------------------------------------------------


@query
def ref_tags(spark, folder):
    return markup.ref_tags(inputs.ocr(spark, folder)).drop("full")


@query
def detections(spark, folder):
    boxes = markup.detections(inputs.ocr(spark, folder))
    sides = ("x1", "y1", "x2", "y2")
    return boxes.select(
        *PAGE,
        "ref_index",
        "box_index",
        "label",
        *[F.col("bbox_norm")[i].alias(f"{side}_norm") for i, side in enumerate(sides)],
        *[F.col("bbox")[i].alias(side) for i, side in enumerate(sides)],
    )


@query
def wrong_detections(spark, folder):
    """Some boxes lose their last number."""
    shortened = inputs.ocr(spark, folder).withColumn(
        "raw_text",
        F.expr(r"if(document_index % 7 = 3, regexp_replace(raw_text, ', \\d+\\]\\]<', ']]<'), raw_text)"),
    )
    return markup.wrong_detections(shortened).select(*PAGE, "ref_index", "label", "coords")


@query
def clean_text(spark, folder):
    return markup.clean_text(inputs.ocr(spark, folder)).select(*PAGE, "clean_text")


@query
def markdown_with_tags(spark, folder):
    return markup.markdown_with_tags(inputs.ocr(spark, folder))


@query
def markdown_pages(spark, folder):
    return markup.markdown_pages(inputs.ocr(spark, folder))


@query
def image_markdown(spark, folder):
    return markup.image_markdown(inputs.formulas(spark, folder)).select(*PAGE, "markdown")


@query
def formula_tidy(spark, folder):
    return markup.tidy_formulas(inputs.formulas(spark, folder)).select(*PAGE, "raw_text")


@query
def eval_markdown(spark, folder):
    return markup.eval_markdown(inputs.formulas(spark, folder)).select(*PAGE, "markdown")


@query
def crop_manifest(spark, folder):
    return markup.crop_manifest(inputs.ocr(spark, folder))


@query
def layout_manifest(spark, folder):
    return markup.layout_manifest(inputs.ocr(spark, folder))


@query
def geometry_lines(spark, folder):
    return markup.geometry_lines(inputs.figures(spark, folder), "figure")


@query
def geometry_endpoints(spark, folder):
    return markup.geometry_endpoints(inputs.figures(spark, folder), "figure")


@query
def geometry_circles(spark, folder):
    return markup.geometry_circles(inputs.figures(spark, folder), "figure")


@query
def repeated_ngrams(spark, folder):
    return markup.repeated_ngrams(inputs.tokens(spark, folder), REPEAT_N, REPEAT_WINDOW, REPEAT_WHITELIST)


@query
def snapshot_deltas(spark, folder):
    deltas = markup.snapshot_deltas(inputs.snapshots(spark, folder), PAGE, "snapshot", "full_text")
    return deltas.select(*PAGE, "snapshot", "delta")


# -- batches and scoring -----------------------------------------------------


@query
def page_batches(spark, folder):
    return inputs.batched(spark, folder).select(*PAGE, "batch_id")


@query
def score_batches(spark, folder):
    return inputs.scored(spark, folder).select(*PAGE, "batch_id", "raw_text", "output_tokens", "error")


@query
def score_stream_of_pages(spark, folder):
    ready = inputs.ocr(spark, folder).withColumnRenamed("raw_text", "payload").drop("output_tokens")
    return scoring.score_stream_of_pages(
        ready, inputs.echo_model, inputs.MODEL_OUTPUT, PAGE, inputs.BATCH_PAGES
    ).select(*PAGE, "raw_text", "output_tokens", "error")


@query
def output_count_mismatch(spark, folder):
    """A model that loses the last output of every fifth batch."""

    model = inputs.echo_model

    def lossy(rows):
        lost = 1 if rows["batch_id"].iloc[0] % 5 == 2 else 0
        return model(rows).iloc[: len(rows) - lost]

    ready = inputs.batched(spark, folder).withColumnRenamed("raw_text", "payload").drop("output_tokens")
    scored = scoring.score_batches(ready, lossy, inputs.MODEL_OUTPUT, [*PAGE, "batch_id"])
    return scored.select(*PAGE, "batch_id", "output_tokens", "error")


@query
def wave_scoring(spark, folder):
    """Pages scored in waves; those of documents that failed in an earlier wave are not."""
    docs = inputs.documents(spark, folder).drop("text")
    kept = [*PAGE, "batch_id", "width", "height", "input_tokens"]
    pages = waves.score_in_waves(
        inputs.unscored(spark, folder),
        docs,
        inputs.rarely_failing_model,
        inputs.MODEL_OUTPUT,
        kept,
        new_folder(spark, "waves"),
        inputs.BATCH_PAGES,
    )
    return pages.select(*PAGE, F.col("wave").cast("long").alias("wave"), "batch_id", "output_tokens", "error")


def _status(spark, folder, scored=None, gaps=False):
    docs = inputs.documents(spark, folder, gaps).drop("text")
    return scoring.document_status(docs, inputs.outcome_keys(spark, folder) if scored is None else scored)


def _generated(spark, folder):
    scored = inputs.stored_outcomes(spark, folder)
    return scoring.generated_pages(scored, _status(spark, folder, scored))


@query
def document_status(spark, folder):
    return _status(spark, folder, gaps=True).select(
        "document_index", "status", "error", "page_count", "first_failed_batch"
    )


@query
def missing_page_status(spark, folder):
    """Some page results are missing; their documents fail."""
    scored = inputs.outcome_keys(spark, folder).filter("(document_index + page_index) % 31 <> 4")
    return _status(spark, folder, scored).select("document_index", "status", "error")


@query
def generated_pages(spark, folder):
    scored = inputs.outcome_keys(spark, folder)
    return scoring.generated_pages(scored, _status(spark, folder)).select(*PAGE, "batch_id")


@query
def active_pages(spark, folder):
    return scoring.active_pages(inputs.page_sizes(spark, folder), _status(spark, folder)).select(*PAGE)


@query
def dropped_pages(spark, folder):
    return scoring.dropped_pages(inputs.page_sizes(spark, folder), _status(spark, folder)).select(*PAGE)


@query
def failed_documents(spark, folder):
    return scoring.failed_documents(inputs.outcome_keys(spark, folder))


@query
def attach_outputs(spark, folder):
    outputs = inputs.ocr(spark, folder).select(*PAGE, "raw_text")
    return scoring.attach_outputs(inputs.page_sizes(spark, folder).select(*PAGE, "width", "height"), outputs)


@query
def unmatched_outputs(spark, folder):
    outputs = inputs.ocr(spark, folder).select(
        "document_index", F.expr("if(page_index % 13 = 5, page_index + 100000, page_index)").alias("page_index")
    )
    return scoring.unmatched_outputs(inputs.page_sizes(spark, folder), outputs)


@query
def bounded_batches(spark, folder):
    """A queue per user."""
    return batching.bounded_batches(
        inputs.arrivals(spark, folder), "queued_us", "event_id", WAIT_US, QUEUE_ROWS, key="user_id"
    )


def _shared_queue(spark, folder):
    arrivals = inputs.arrivals(spark, folder)
    batches = batching.bounded_batches(arrivals, "queued_us", "event_id", SHARED_WAIT_US, SHARED_ROWS)
    return batches.join(arrivals.select("event_id", "user_id"), "event_id")


@query
def shared_batches(spark, folder):
    """One queue for all users."""
    return _shared_queue(spark, folder)


@query
def batch_wait_stats(spark, folder):
    return batching.batch_wait_stats(
        _shared_queue(spark, folder), "queued_us", "user_id", SHARED_WAIT_US, SHARED_ROWS
    )


# -- documents and metrics ---------------------------------------------------


def _results(spark, folder):
    scored = inputs.scored(spark, folder)
    docs = inputs.documents(spark, folder).drop("text")
    return corpus.document_results(docs, scored)


@query
def document_results(spark, folder):
    """The whole way from pages to documents, with the Python scoring step."""
    return _results(spark, folder).select(
        "document_index",
        "document_path",
        "status",
        "error",
        "page_count",
        "part_index",
        "part_count",
        F.size("results").cast("bigint").alias("n_results"),
        F.array_join(F.transform("results", lambda r: r["clean_text"]), "|").alias("texts"),
        F.aggregate(
            "results", F.lit(0).cast("bigint"), lambda n, r: n + F.size(r["detections"]).cast("bigint")
        ).alias("n_detections"),
        "usage.input_tokens",
        "usage.cached_tokens",
        "usage.output_tokens",
        "usage.total_tokens",
        "usage.prompt_tokens",
        "usage.completion_tokens",
    )


@query
def document_parts(spark, folder):
    """Documents in parts of two pages."""
    docs = inputs.documents(spark, folder).drop("text")
    parts = corpus.document_results(docs, inputs.scored(spark, folder), block=2)
    return parts.select(
        "document_index", "part_index", F.col("part_count").cast("bigint").alias("part_count"),
        F.size("results").cast("bigint").alias("n_results"),
    )


@query
def incomplete_documents(spark, folder):
    """Some page results are missing."""
    scored = inputs.stored_outcomes(spark, folder)
    summary = results.document_summary(
        _status(spark, folder, scored), scored.filter("(document_index + page_index) % 31 <> 4")
    )
    return results.incomplete_documents(summary).select("document_index", "page_count", "pages_done")


@query
def page_usage(spark, folder):
    ids = inputs.tokens(spark, folder).withColumn(
        "prompt_token_ids", F.expr("if(page_index % 4 = 3, null, slice(token_ids, 1, 3))")
    )
    return results.page_usage(ids).select(*PAGE, *results.USAGE)


@query
def document_usage(spark, folder):
    return results.document_usage(inputs.ocr(spark, folder))


def _summary(spark, folder):
    scored = inputs.stored_outcomes(spark, folder)
    return results.document_summary(_status(spark, folder, scored), scored)


@query
def corpus_totals(spark, folder):
    return metrics.corpus_totals(_summary(spark, folder))


@query
def generated_totals(spark, folder):
    return metrics.generated_totals(_generated(spark, folder))


def _corpus_metrics(spark, folder):
    """All one-row metrics side by side; the time is that of the stages."""
    docs = inputs.documents(spark, folder).drop("text")
    return corpus.corpus_metrics(docs, inputs.stored_outcomes(spark, folder))


@query
def throughput(spark, folder):
    return _corpus_metrics(spark, folder).select(
        "elapsed_s",
        "pages_per_second",
        "tokens_per_second",
        "generated_pages_per_second",
        "generated_tokens_per_second",
    )


@query
def batch_metrics(spark, folder):
    return metrics.batch_metrics(_generated(spark, folder))


@query
def failures(spark, folder):
    return results.failures(_status(spark, folder, gaps=True))


def _facts(spark, folder):
    return corpus.run_facts(inputs.stored_outcomes(spark, folder))


@query
def page_facts(spark, folder):
    return _facts(spark, folder).drop("page_index")


@query
def facts_batch_metrics(spark, folder):
    found = _facts(spark, folder)
    status = facts.document_status(inputs.documents(spark, folder).drop("text"), found)
    return facts.batch_metrics(facts.generated(found, status))


@query
def facts_document_status(spark, folder):
    docs = inputs.documents(spark, folder).drop("text")
    found = _facts(spark, folder)
    summary = facts.document_summary(facts.document_status(docs, found), found)
    return summary.select("document_index", "status", "error", "first_failed_batch", "pages_done", *results.USAGE)


@query
def stage_totals(spark, folder):
    return metrics.stage_totals(inputs.documents(spark, folder), _generated(spark, folder))


@query
def inference_stats(spark, folder):
    return metrics.inference_stats(_generated(spark, folder))


@query
def request_timing(spark, folder):
    spans, totals = inputs.timed_requests(spark, folder)
    return metrics.request_steps(metrics.request_timing(spans, totals))


@query
def request_batch_timing(spark, folder):
    return metrics.request_batch_timing(inputs.outcome_keys(spark, folder))


@query
def request_responses(spark, folder):
    """Every document as a request, with its response and timing."""
    steps = ("gpu_queue_wait", "gpu_generate", "postprocess_cpu")
    pairs = ", ".join(f"'{step}', coalesce({step}, 0)" for step in steps)
    spans = metrics.request_batch_timing(inputs.outcome_keys(spark, folder)).select(
        F.col("document_index").alias("request_id"), F.expr(f"stack({len(steps)}, {pairs}) as (step, ms)")
    )
    return results.request_responses(_results(spark, folder), metrics.request_timing(spans))


# -- streams -----------------------------------------------------------------


def _decoded_stream(spark, folder):
    requests = inputs.as_files(inputs.requests(spark, folder), "requests")
    bodies = runner.file_stream(spark, requests, "request_id bigint, body string", max_files=4)
    return files.decode_requests(bodies).withColumn("payload", F.decode("payload", "UTF-8"))


@query
def stream_pages(spark, folder):
    """Request bodies read as a stream and decoded."""
    return runner.run_to_end(
        _decoded_stream(spark, folder).select("request_id", "page_index", "prompt", "payload"), "pages"
    )


@query
def stream_scored_pages(spark, folder):
    """Request bodies read as a stream, decoded and scored."""
    scored = scoring.score_stream_of_pages(
        _decoded_stream(spark, folder), inputs.echo_model, inputs.MODEL_OUTPUT, ["request_id", "page_index"]
    )
    return runner.run_to_end(scored.drop("generate_s"), "scored")


@query
def stream_snapshot_deltas(spark, folder):
    shots = inputs.snapshots(spark, folder)
    stream = runner.file_stream(spark, inputs.as_files(shots, "snapshots"), shots.schema)
    return runner.run_to_end(
        stream_deltas.stream_snapshot_deltas(stream, PAGE, "snapshot", "full_text"), "deltas"
    )


@query
def stream_bounded_batches(spark, folder):
    return stream_batches.run_on_table(spark, folder, WAIT_US, QUEUE_ROWS)


@query
def stream_usage_by_window(spark, folder):
    return stream_usage.run_on_table(spark, folder)


@query
def stream_request_timing(spark, folder):
    """Spans and responses arrive in any order; the last timing of every request."""
    spans, totals = (
        runner.file_stream(spark, inputs.as_files(rows.repartition(n, F.xxhash64(*rows.columns)), "timed"), rows.schema, max_files=2)
        for rows, n in zip(inputs.timed_requests(spark, folder), (6, 4))
    )
    timing = stream_timing.stream_request_timing(spans, totals)
    return metrics.request_steps(runner.run_updates_to_end(timing, "request_timing", ["request_id"]))


@query
def stream_repeated_ngrams(spark, folder):
    """Tokens of all pages arrive in pieces, out of order."""
    # Two triggers, each of half of the files; as many tasks write and read them as others do.
    half = max(2, task_count(spark) // 2)
    pieces = inputs.token_pieces(spark, folder).repartition(2 * half, "start", "document_index")
    arriving = runner.file_stream(spark, inputs.as_files(pieces, "pieces"), pieces.schema, max_files=half)
    found = repetition.stream_repeated_ngrams(arriving, REPEAT_N, REPEAT_WINDOW, REPEAT_WHITELIST)
    return runner.run_to_end(found, "repeated")


@query
def stream_closed_batches(spark, folder):
    """When and why the batches of every user's queue close; the last ones by a timer."""
    events = microbatch.close_events(
        inputs.arrival_stream(spark, folder), "user_id", "queued_us", "event_id", "request", WAIT_US, QUEUE_ROWS, IDLE_MS
    )
    return runner.run_until_idle(events, "closed_batches", IDLE_MS)


@query
def stream_microbatches(spark, folder):
    """Pages scored in the shared batches of their queue; the model is down for some users."""
    scored = microbatch.score_microbatches(
        inputs.arrival_stream(spark, folder), "user_id", "queued_us", "event_id", inputs.down_for_some, inputs.MODEL_OUTPUT,
        ["event_id", "request"], WAIT_US, QUEUE_ROWS, IDLE_MS,
    )
    return runner.run_until_idle(scored.drop("generate_s"), "microbatches", IDLE_MS)


@query
def stream_completed_documents(spark, folder):
    """Documents that are done while their pages arrive out of order."""
    pages = inputs.stored_outcomes(spark, folder).repartition(6, "page_index", "document_index")
    arriving = runner.file_stream(spark, inputs.as_files(pages, "arriving"), pages.schema, max_files=2)
    return runner.run_to_end(completion.complete_documents(arriving), "completed")


@query
def stream_documents_in_order(spark, folder):
    """Finished documents arrive in any order and leave in theirs."""
    done = _status(spark, folder, gaps=True).select("document_index", "document_path", "status", "error")
    arriving = inputs.as_files(done.repartition(5, F.xxhash64("document_index")), "finished")
    finished = runner.file_stream(spark, arriving, done.schema, max_files=1)
    left = completion.run_in_order(finished, "in_order")
    return dense_position(left, ["trigger", "document_index"], "sequence").drop("trigger")
