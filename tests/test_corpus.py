"""From pages to written documents, with a stand-in model."""

import glob
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.operators import batching, metrics, results, scoring
from docflow.plans import corpus

OUTPUT = T.StructType([
    T.StructField("raw_text", T.StringType()),
    T.StructField("output_tokens", T.LongType()),
])
KEEP = ["document_index", "page_index", "batch_id", "width", "height", "input_tokens"]


def labelled(spark, **page_counts):
    """Documents a.pdf, b.pdf … with pages a0, a1 …"""
    docs = spark.createDataFrame(
        [(i, f"{name}.pdf", count, 0.25) for i, (name, count) in enumerate(page_counts.items())],
        "document_index bigint, document_path string, page_count bigint, render_s double",
    )
    pages = docs.filter("page_count > 0").selectExpr(
        "document_index",
        "explode(sequence(0L, page_count - 1)) as page_index",
        "substr(document_path, 1, 1) as name",
        "16 as width",
        "16 as height",
        "3L as input_tokens",
    ).withColumn("label", F.concat("name", "page_index"))
    return docs, pages


def model(failing=(), shortfall=0):
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        batch = rows["batch_id"].iloc[0]
        if batch in failing:
            raise RuntimeError(f"fail batch {batch}")
        out = pd.DataFrame({"raw_text": "raw:" + rows["label"], "output_tokens": 2})
        return out.iloc[: len(out) - shortfall]

    return score


def run(spark, tmp_path, page_counts, batch_pages, scorer):
    docs, pages = labelled(spark, **page_counts)
    out = corpus.run_corpus(pages, docs, scorer, OUTPUT, KEEP, str(tmp_path / "out"), batch_pages)
    lines = []
    for path in sorted(glob.glob(f"{out.results}/part-*")):
        with open(path, encoding="utf-8") as file:
            lines += [json.loads(line) for line in file]
    (metrics_path,) = glob.glob(f"{out.metrics}/part-*")
    with open(metrics_path, encoding="utf-8") as file:
        totals = json.load(file)
    batches = [r.asDict() for r in spark.read.schema(
        "batch_id long, pages long, documents long, total_s double"
    ).json(out.batches).orderBy("batch_id").collect()]
    failed = [r.asDict() for r in spark.read.schema(
        "document_index long, document_path string, error string"
    ).json(out.failures).orderBy("document_index").collect()]
    return lines, totals, batches, failed


def test_documents_in_order_with_usage(spark, tmp_path):
    lines, totals, batches, failed = run(spark, tmp_path, {"a": 3, "b": 1}, 2, model())
    assert [line["document_path"] for line in lines] == ["a.pdf", "b.pdf"]
    assert [line["status"] for line in lines] == ["ok", "ok"]
    assert [r["raw_text"] for r in lines[0]["results"]] == ["raw:a0", "raw:a1", "raw:a2"]
    assert lines[1]["results"][0]["clean_text"] == "raw:b0"
    assert lines[0]["usage"] == {
        "input_tokens": 9, "cached_tokens": 0, "output_tokens": 6, "total_tokens": 15,
        "prompt_tokens": 9, "completion_tokens": 6, "input_tokens_details": {"cached_tokens": 0},
    }
    assert set(lines[0]) == {
        "document_index", "document_path", "status", "page_count", "part_index", "part_count", "results", "usage",
        "timings",
    }
    assert set(lines[0]["results"][0]) == {"raw_text", "clean_text", "detections", "has_eos", "image_size"}
    assert lines[0]["timings"]["render_s"] == 0.25
    assert lines[0]["timings"]["total_s"] >= 0.25
    assert [b["pages"] for b in batches] == [2, 2] and [b["documents"] for b in batches] == [1, 2]
    assert (totals["documents"], totals["succeeded"], totals["failed"]) == (2, 2, 0)
    assert (totals["pages"], totals["generated_pages"]) == (4, 4)
    assert (totals["total_tokens"], totals["generated_total_tokens"]) == (20, 20)
    assert list(totals) == sorted(totals) and failed == []


def test_failed_batch_fails_only_its_documents(spark, tmp_path):
    lines, totals, batches, failed = run(spark, tmp_path, {"a": 1, "b": 2, "c": 1}, 2, model({0}))
    assert [line["status"] for line in lines] == ["failed", "failed", "ok"]
    assert lines[0]["error"] == lines[1]["error"] == "fail batch 0"
    assert "error" not in lines[2]
    assert lines[1]["results"] == [] and lines[1]["page_count"] == 2
    assert lines[1]["usage"]["total_tokens"] == 0
    assert lines[2]["results"][0]["raw_text"] == "raw:c0"
    assert (totals["succeeded"], totals["failed"]) == (1, 2)
    assert (totals["pages"], totals["generated_pages"]) == (1, 1)
    assert [f["document_path"] for f in failed] == ["a.pdf", "b.pdf"]


def test_half_failed_document_does_not_count_as_success(spark, tmp_path):
    lines, totals, _, _ = run(spark, tmp_path, {"a": 2}, 1, model({1}))
    assert lines[0]["status"] == "failed" and lines[0]["results"] == []
    assert (totals["pages"], totals["total_tokens"]) == (0, 0)
    assert (totals["generated_pages"], totals["generated_total_tokens"]) == (1, 5)


def test_documents_without_pages_and_with_render_errors(spark):
    docs, pages = labelled(spark, a=1, b=0, c=0)
    docs = docs.withColumn("render_error", F.when(F.col("document_index") == 2, "broken file"))
    scored = corpus.score_corpus(pages, docs, model(), OUTPUT, KEEP)
    rows = scoring.document_status(docs, scored).orderBy("document_index").collect()
    assert [(r.status, r.error) for r in rows] == [
        ("ok", None), ("failed", "document produced zero pages"), ("failed", "broken file"),
    ]


def test_count_mismatch_fails_the_batch(spark):
    docs, pages = labelled(spark, a=2)
    scored = corpus.score_corpus(pages, docs, model(shortfall=1), OUTPUT, KEEP).collect()
    assert {r.error for r in scored} == {"Model returned 1 outputs for 2 inputs."}
    assert {r.raw_text for r in scored} == {None}


def test_wrong_boxes_fail_the_whole_batch(spark):
    docs, pages = labelled(spark, a=1, b=1, c=1)

    def score(rows):
        text = ["<|ref|>x<|/ref|><|det|>[[1]]<|/det|>" if label == "a0" else label for label in rows["label"]]
        return pd.DataFrame({"raw_text": text, "output_tokens": 1})

    scored = corpus.score_corpus(pages, docs, score, OUTPUT, KEEP, batch_pages=2)
    done = corpus.finished_pages(scored)
    rows = scoring.document_status(docs, done).orderBy("document_index").collect()
    assert [r.status for r in rows] == ["failed", "failed", "ok"]
    assert rows[0].error == rows[1].error


def test_batches_are_cut_whole_from_frames_of_many(spark):
    """A group and its frame for every batch made the scoring of small batches slow."""
    pages = spark.createDataFrame(
        [(d, p, (5 * d + p) // 4 if d < 8 else None, None if (d, p) == (3, 1) else 2**53 + 1) for d in range(9) for p in range(5)][::-1],
        "document_index bigint, page_index bigint, batch_id bigint, input_tokens bigint",
    )

    def seen(rows: pd.DataFrame) -> pd.DataFrame:
        places = [f"{d}.{p}" for d, p in zip(rows["document_index"], rows["page_index"])]
        assert list(rows.index) == list(range(len(rows)))
        return pd.DataFrame({"raw_text": [" ".join(places)] * len(rows), "output_tokens": [int(rows["input_tokens"].dtype == "int64")] * len(rows)})

    kept = ["document_index", "page_index", "batch_id"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 7, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            scored = scoring.score_batches(pages, seen, OUTPUT, kept, partitions=2)
            got = scored.collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert len(got) == 45 and all(r.error is None for r in got)
        by_batch = {}
        for r in got:
            by_batch.setdefault((r.batch_id, r.raw_text, r.output_tokens), []).append(f"{r.document_index}.{r.page_index}")
        assert len(by_batch) == 11 and all(text == " ".join(places) for (_, text, _), places in by_batch.items())
        assert {number for number, _, whole in by_batch if not whole} == {4}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_scorer_is_built_once_per_worker(spark, tmp_path):
    docs, pages = labelled(spark, a=40)
    log = str(tmp_path / "built")

    def build():
        import os

        with open(log, "a") as file:
            file.write(f"{os.getpid()}\n")
        return model()

    ready = batching.page_batches(pages, docs, 2)
    scored = scoring.score_batches(ready, None, OUTPUT, KEEP, make_scorer=build)
    assert scored.filter("error is null").count() == 40
    with open(log) as file:
        pids = file.read().split()
    assert len(pids) == len(set(pids)) <= 20


def test_slices_of_the_throughput_mode(spark):
    docs, pages = labelled(spark, a=10)
    sizes = pages.coalesce(1)

    def score(rows):
        if len(rows) == 2:
            raise RuntimeError("last slice")
        return pd.DataFrame({"raw_text": [str(len(rows))] * len(rows), "output_tokens": 1})

    rows = scoring.score_stream_of_pages(sizes, score, OUTPUT, ["page_index"], batch_pages=4).collect()
    assert [r.raw_text for r in rows] == ["4"] * 8 + [None] * 2
    assert rows[-1].error == "last slice"
    with pytest.raises(ValueError):
        scoring.score_stream_of_pages(sizes, score, OUTPUT, ["page_index"], batch_pages=0)


def test_large_document_in_parts(spark):
    docs, pages = labelled(spark, a=7, b=2)
    done = corpus.finished_pages(corpus.score_corpus(pages, docs, model(), OUTPUT, KEEP))
    summary = results.document_summary(scoring.document_status(docs, done), done)
    parts = results.document_results(summary, done, block=3).orderBy("document_index", "part_index").collect()
    assert [(p.document_index, p.part_index, p.part_count, len(p.results)) for p in parts] == [
        (0, 0, 3, 3), (0, 1, 3, 3), (0, 2, 3, 1), (1, 0, 1, 2),
    ]
    assert [r.raw_text for p in parts[:3] for r in p.results] == [f"raw:a{i}" for i in range(7)]
    assert {p.usage.total_tokens for p in parts[:3]} == {35}
    lines = results.result_lines(results.document_results(summary, done, block=3)).collect()
    assert [json.loads(line.value)["part_count"] for line in lines].count(3) == 3
    assert all("part_index" in json.loads(line.value) for line in lines)


def test_incomplete_documents_fail_visibly(spark):
    docs, pages = labelled(spark, a=3, b=1)
    whole = corpus.score_corpus(pages, docs, model(), OUTPUT, KEEP)
    done = corpus.finished_pages(whole.filter("page_index <> 1"))
    status = scoring.document_status(docs, done)
    summary = results.document_summary(status, done)
    rows = results.document_results(summary, done).orderBy("document_index").collect()
    assert [(r.status, r.error, len(r.results)) for r in rows] == [("failed", "2 of 3 pages", 0), ("ok", None, 1)]
    assert [r.error for r in results.failures(status).collect()] == ["2 of 3 pages"]
    totals = metrics.corpus_totals(summary).first()
    assert (totals.documents, totals.succeeded, totals.failed, totals.pages) == (2, 1, 1, 1)
    before = results.document_summary(scoring.document_status(docs, whole), done)
    assert [r.document_index for r in results.incomplete_documents(before).collect()] == [0]


def test_each_call_uses_its_own_scorer(spark):
    docs, pages = labelled(spark, a=4)
    ready = batching.page_batches(pages, docs, 2)
    for name in ("first", "second"):
        def build(name=name):
            return lambda rows: pd.DataFrame({"raw_text": [name] * len(rows), "output_tokens": 1})

        scored = scoring.score_batches(ready, None, OUTPUT, KEEP, make_scorer=build).collect()
        assert {r.raw_text for r in scored} == {name}


@pytest.mark.parametrize(
    "frame",
    [lambda n: pd.DataFrame({"output_tokens": [1] * n}), lambda n: pd.DataFrame({"raw_text": ["x"] * n, "output_tokens": ["y"] * n})],
)
def test_bad_outputs_fail_the_batch_only(spark, frame):
    docs, pages = labelled(spark, a=1, b=1)

    def score(rows):
        good = pd.DataFrame({"raw_text": rows["label"], "output_tokens": 1})
        return frame(len(rows)) if rows["label"].iloc[0] == "a0" else good

    scored = corpus.score_corpus(pages, docs, score, OUTPUT, KEEP, batch_pages=1).orderBy("document_index").collect()
    assert scored[0].error and scored[0].raw_text is None
    assert (scored[1].error, scored[1].raw_text) == (None, "b0")


def test_rates_without_time(spark):
    row = spark.createDataFrame(
        [(4, 20, 4, 20, 0.0)], "pages long, total_tokens long, generated_pages long, generated_total_tokens long, elapsed_s double"
    )
    assert set(metrics.throughput(row).first()) == {0.0}


def test_page_usage_counts_missing_arrays_as_zero(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2]), (None, None)], "prompt_token_ids array<int>, token_ids array<int>")
    rows = [tuple(r[name] for name in results.USAGE) for r in results.page_usage(df).collect()]
    assert rows == [(3, 0, 2, 5), (0, 0, 0, 0)]


def test_request_timing(spark):
    spans = spark.createDataFrame(
        [("r", "gpu_generate", 2.5), ("r", "gpu_generate", -7.0), ("r", "other", 3.5), ("s", "postprocess_cpu", 1.0)],
        "request_id string, step string, ms double",
    )
    totals = spark.createDataFrame([("r", 6.5), ("s", 1.25), ("t", 9.0)], "request_id string, total_ms double")
    rows = {r.request_id: r for r in metrics.request_timing(spans, totals).collect()}
    assert rows["r"].total_ms == 6
    assert rows["r"].steps["gpu_generate"] == 2 and rows["r"].steps["other"] == 4
    assert rows["r"].steps["unaccounted"] == 0
    assert "unaccounted" not in rows["s"].steps
    assert rows["t"].steps["unaccounted"] == 9 and len(rows["t"].steps) == 9


def test_batches_are_counted_once_per_request(spark):
    df = spark.createDataFrame(
        [(0, 0, 7, 0, 10, 1), (0, 1, 7, 0, 99, 99), (0, 2, 8, 0, 5, 2)],
        "document_index long, page_index long, batch_id long, queue_wait_ms long, gpu_ms long, post_ms long",
    )
    row = metrics.request_batch_timing(df).first()
    assert (row.gpu_queue_wait, row.gpu_generate, row.postprocess_cpu, row.gpu_batches) == (None, 15, 3, 2)
    assert metrics.request_batch_timing(df.limit(0)).count() == 0
