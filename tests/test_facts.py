"""Numbers of a run from facts against the same from its page results."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from docflow.operators import facts, metrics, results, scoring
from docflow.plans import corpus

from tests.test_corpus import KEEP, OUTPUT, labelled, model

PAGES = (
    "document_index long, page_index long, page_count long, batch_id long, input_tokens long,"
    " output_tokens long, preprocess_s double, generate_s double, error string"
)
DOCS = "document_index long, document_path string, page_count long, render_s double, render_error string"


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).toPandas().astype(object).itertuples(index=False))


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    assert repr(rows(left.fillna(-1).fillna(""))) == repr(rows(right.fillna(-1).fillna("")))


@pytest.fixture
def run(spark):
    # Batches 0..5 of 3 pages; 1 and 4 fail, the first with two errors; page 17 has no result.
    counts = [4, 3, 0, 7, 2, 1]
    docs = [(i, f"d{i}.pdf", n, 0.5, "broken" if i == 4 else None) for i, n in enumerate(counts)]
    pages, at = [], 0
    for i, n in enumerate(counts):
        for p in range(n):
            batch = at // 3
            error = {4: "late", 3: "early", 12: "once"}.get(at)
            tokens = (None, None) if error else (p, 10 * i + p)
            if at != 16:
                pages.append((i, p, n, batch, *tokens, batch * 0.25, batch * 0.5, error))
            at += 1
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages, PAGES)


def check(docs, pages):
    found = facts.page_facts(pages)
    before, after = scoring.document_status(docs, pages), facts.document_status(docs, found)
    same(after, before)
    same(facts.document_summary(after, found), results.document_summary(before, pages))
    old, new = scoring.generated_pages(pages, before), facts.generated(found, after)
    same(facts.generated_totals(new), metrics.generated_totals(old))
    same(facts.batch_metrics(new), metrics.batch_metrics(old))
    same(metrics.stage_totals(docs, new), metrics.stage_totals(docs, old))
    same(corpus.with_timings(facts.document_summary(after, found), found).drop("timings"),
         results.document_summary(before, pages))


def test_facts_give_what_pages_give(run):
    check(*run)


def test_facts_of_a_run_that_was_cut_add_up(run):
    docs, pages = run
    halves = [facts.page_facts(pages.filter(F.col("page_index") % 2 == k)) for k in (0, 1)]
    both = halves[0].unionByName(halves[1])
    whole = facts.page_facts(pages)
    same(facts.document_status(docs, both), facts.document_status(docs, whole))
    same(facts.batch_metrics(both), facts.batch_metrics(whole))


def test_no_pages_and_no_documents(spark, run):
    docs, pages = run
    check(docs, pages.limit(0))
    check(docs.limit(0), pages.limit(0))


def test_one_scan_of_the_page_results(spark, run, tmp_path):
    docs, pages = run
    pages.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    plan = corpus.corpus_metrics(docs, stored)._jdf.queryExecution().executedPlan().toString()
    # The page results were read as the facts were stored; what is left reads the facts alone.
    assert str(tmp_path / "pages") not in plan
    assert plan.count("raw_text") == 0


def test_settings_stand_in_the_metrics(spark, tmp_path):
    docs, pages = labelled(spark, a=3, b=1)
    settings = {"batch_pages": 2, "dpi": 144, "crop_mode": True, "max_model_len": 8192}
    out = corpus.run_corpus(pages, docs, model(), OUTPUT, KEEP, str(tmp_path / "out"), 2, config=settings)
    (path,) = glob.glob(f"{out.metrics}/part-*")
    with open(path, encoding="utf-8") as file:
        totals = json.load(file)
    assert totals["config"] == settings
    assert totals["documents"] == 2 and totals["generated_pages"] == 4
