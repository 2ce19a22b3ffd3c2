"""Scoring in waves against a single process."""

import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docflow.operators import results, scoring
from docflow.plans import waves
from tests.test_corpus import OUTPUT, KEEP, labelled


def single_process(counts, batch_pages, failing):
    """Calls of one process that packs anew after every failure."""
    pending = [(d, p) for d, n in enumerate(counts) for p in range(n)]
    calls, failed = [], set()
    while pending:
        batch, pending = pending[:batch_pages], pending[batch_pages:]
        calls.append(batch)
        if failing(len(calls) - 1):
            failed |= {d for d, _ in batch}
            pending = [page for page in pending if page[0] not in failed]
    return calls, failed


def counting_model(folder, failing):
    """Writes a file for every call, which all workers share."""

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        batch = int(rows["batch_id"].iloc[0])
        with open(f"{folder}/{batch}-{os.urandom(4).hex()}", "w") as file:
            file.write(",".join(f"{d}:{p}" for d, p in zip(rows["document_index"], rows["page_index"])))
        if failing(batch):
            raise RuntimeError(f"fail call {batch}")
        return pd.DataFrame({"raw_text": "raw:" + rows["label"], "output_tokens": 2})

    return score


def calls_in(folder):
    found = {}
    for path in glob.glob(f"{folder}/*"):
        with open(path) as file:
            found.setdefault(int(os.path.basename(path).split("-")[0]), []).append(
                [tuple(map(int, page.split(":"))) for page in file.read().split(",")]
            )
    assert all(len(c) == 1 for c in found.values()), "a batch was scored twice"
    return [found[batch][0] for batch in sorted(found)]


def run(spark, tmp_path, counts, batch_pages, failing, first=1, name="out"):
    docs, pages = labelled(spark, **{chr(97 + i): n for i, n in enumerate(counts)})
    folder = tmp_path / "calls"
    folder.mkdir(exist_ok=True)
    done = waves.score_in_waves(
        pages, docs, counting_model(str(folder), failing), OUTPUT, KEEP, str(tmp_path / name), batch_pages, first
    )
    return docs, done, calls_in(folder)


@pytest.mark.parametrize(
    "counts, batch_pages, bad, pages_ok, generated",
    [((1, 2, 1), 2, {0}, 1, 1), ((2,), 1, {1}, 0, 1), ((5, 1, 4), 2, {0, 2}, 1, 2)],
)
def test_single_batches_make_the_calls_of_one_process(spark, tmp_path, counts, batch_pages, bad, pages_ok, generated, monkeypatch):
    # A wave that never grows.
    grow = waves.next_wave

    def fixed(*args):
        after = grow(*args)
        after.size = 1
        return after

    monkeypatch.setattr(waves, "next_wave", fixed)
    docs, done, calls = run(spark, tmp_path, counts, batch_pages, lambda b: b in bad)
    expected, failed = single_process(counts, batch_pages, lambda b: b in bad)
    assert calls == expected
    status = scoring.document_status(docs, done)
    got = {r.document_index: r.status for r in status.collect()}
    assert got == {d: "failed" if d in failed else "ok" for d in range(len(counts))}
    assert results.document_summary(status, done).selectExpr("sum(if(status = 'ok', pages_done, 0))").first()[0] == pages_ok
    assert scoring.generated_pages(done, status).count() == generated


def test_later_waves_leave_failed_documents_out(spark, tmp_path):
    counts = [3, 40, 2, 1, 30, 5]
    docs, done, calls = run(spark, tmp_path, counts, 2, lambda b: b in (3, 9), first=4)
    scored = [page for call in calls for page in call]
    assert len(scored) == len(set(scored)) == done.count()
    # Document 1 fails in the first wave, whose 8 pages end within it.
    assert [p for p in scored if p[0] == 1] == [(1, p) for p in range(5)]
    sizes = {r.wave: r.n for r in done.groupBy("wave").agg({"batch_id": "min"}).selectExpr("wave", "`min(batch_id)` as n").collect()}
    assert sizes[0] == 0 and sizes[1] == 4
    assert all(len(call) == 2 for call in calls[:-1])
    status = {r.document_index: r.status for r in scoring.document_status(docs, done).collect()}
    assert status[1] == "failed" and status[0] == status[2] == status[5] == "ok"


def test_a_resumed_run_scores_nothing_twice(spark, tmp_path):
    counts, bad = [3, 40, 2, 1, 30, 5], {3}
    _, whole, calls = run(spark, tmp_path, counts, 2, lambda b: b in bad, first=4)
    rows = sorted(tuple(r) for r in whole.select("document_index", "page_index", "wave", "batch_id", "raw_text").collect())
    # The last wave had not ended: its plan stands, its pages do not.
    last = max(r.wave for r in whole.select("wave").distinct().collect())
    os.remove(tmp_path / "out" / "pages" / f"wave={last}" / "_SUCCESS")
    redone = whole.filter(f"wave = {last}").select("batch_id").distinct().collect()
    for r in redone:
        for path in glob.glob(str(tmp_path / "calls" / f"{r.batch_id}-*")):
            os.remove(path)
    _, again, calls_again = run(spark, tmp_path, counts, 2, lambda b: b in bad, first=4)
    assert sorted(tuple(r) for r in again.select("document_index", "page_index", "wave", "batch_id", "raw_text").collect()) == rows
    assert calls_again == calls


def test_waves_of_nothing(spark, tmp_path):
    _, done, calls = run(spark, tmp_path, [0, 0], 2, lambda b: False)
    assert done.count() == 0 and calls == []
    with pytest.raises(ValueError):
        run(spark, tmp_path, [1], 0, lambda b: False)


def test_a_wave_reads_only_its_own_pages(spark, tmp_path):
    """Every wave went through the whole source for its pages."""
    docs, pages = labelled(spark, **{chr(97 + i): 50 for i in range(20)})
    reads = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(page):
        reads.add(1)
        return page

    read = pages.withColumn("page_index", seen.asNondeterministic()("page_index"))

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["batch_id"].iloc[0] % 2:
            raise RuntimeError("fail")
        return pd.DataFrame({"raw_text": "raw:" + rows["label"], "output_tokens": 2})

    done = waves.score_in_waves(read, docs, model, OUTPUT, KEEP, str(tmp_path / "out"), 10, 2)
    assert done.select("wave").distinct().count() > 10
    assert reads.value == 1000


def test_a_wave_is_two_jobs_whatever_fails(spark, tmp_path):
    """One for its shuffle and one for its pages; a failure took seven jobs."""
    docs, pages = labelled(spark, **{chr(97 + i): 6 for i in range(12)})
    jobs = spark.sparkContext.statusTracker()

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["batch_id"].iloc[0] % 2 == 0:
            raise RuntimeError("fail")
        return pd.DataFrame({"raw_text": "raw:" + rows["label"], "output_tokens": 2})

    spark.sparkContext.setJobGroup("waves", "waves")
    try:
        done = waves.score_in_waves(pages, docs, model, OUTPUT, KEEP, str(tmp_path / "out"), 3, 2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    number = done.select("wave").distinct().count()
    assert number == 12 and len(jobs.getJobIdsForGroup("waves")) <= 2 * number + 16


def test_only_a_document_with_pages_in_a_failed_batch_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(waves, "SPAN", 3)
    for seed in range(3):
        counts = [(7 * i + 3 * seed) % 11 for i in range(25)]
        _, done, _ = run(spark, tmp_path / str(seed), counts, 3, lambda b: b % 3 == 1, first=2, name="out") if (
            (tmp_path / str(seed)).mkdir() is None
        ) else None
        starts = [sum(counts[:i]) for i in range(len(counts))]
        position = {(d, p): starts[d] + p for d, n in enumerate(counts) for p in range(n)}
        rows = done.select("document_index", "page_index", "wave", "batch_id", "error").collect()
        expected, at, batch, wave, size = set(), 0, 0, 0, 2
        order = sorted(position, key=position.get)
        while at < len(order):
            own = {key: batch + (i // 3) for i, key in enumerate(order[at : at + 3 * size])}
            expected |= {(*key, wave, b) for key, b in own.items()}
            bad = {d for (d, _), b in own.items() if b % 3 == 1}
            at += 3 * size
            while bad and at < len(order) and order[at][0] in bad:
                at += 1
            batch, wave, size = batch + size, wave + 1, max(2, size // 2) if bad else 2 * size
        assert {(r.document_index, r.page_index, r.wave, r.batch_id) for r in rows} == expected
