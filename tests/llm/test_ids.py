"""Ids beyond 2^53 beside a null one, and columns of the same names as an operator's."""

import pytest

from docflow.llm import decontamination, licenses, ngram_join, queries, suffix_dedup, toxicity

BIG = (1 << 60) + 1
TEXT = "released under the MIT License by people who write many words about nothing at all today"
ROWS = [(BIG, TEXT), (BIG + 1, TEXT), (None, "mit license " + "some other text " * 9), (None, None), (3, "x")]


def ids(frame):
    return sorted(r.doc_id for r in frame.collect() if r.doc_id is not None)


@pytest.fixture
def docs(make):
    return make(ROWS).coalesce(1)


def test_license_scan(docs):
    assert ids(licenses.scan(docs)) == [3, BIG, BIG + 1]
    found = {r.doc_id: r for r in licenses.scan(docs).filter("doc_id is not null").collect()}
    assert found[BIG].n_base == 1 and found[BIG].first_word == 3 and found[3].first_word is None


def test_suffix_dedup(docs):
    got = suffix_dedup.remove_repeated(docs)
    assert ids(got) == [3, BIG, BIG + 1]
    assert {r.doc_id: r.n_removed for r in got.collect() if r.doc_id} == {3: 0, BIG: 0, BIG + 1: len(TEXT)}


def test_ngram_join(docs):
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {BIG: BIG, BIG + 1: BIG, 3: 3, None: None}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(BIG + 7, "people who write many words about nothing"), (None, "some other text some other text")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(BIG, BIG + 7), (BIG + 1, BIG + 7), (None, None)}


def test_toxicity_keeps_columns_and_null_ids(spark, make):
    texts = [(i, "vile rotten scum" if i % 2 else "a calm day") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = make([*texts, (None, "a calm day"), (BIG, "a calm day"), (BIG + 1, "vile rotten scum")]).coalesce(1)
    kept = toxicity.keep_clean(docs, labels)
    rows = kept.collect()
    assert kept.columns == docs.columns
    assert {r.score for r in rows} == {-1.0}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, *range(0, 200, 2), BIG]
    empty = labels.limit(0)
    assert toxicity.keep_clean(docs, empty).count() == 203 and toxicity.keep_clean(make([]), labels).count() == 0


def test_toxicity_query_gives_no_null(spark, make, tmp_path):
    make([(None, "a"), (1, None), (2, "b")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op2_toxicity(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.held_out) for r in rows)[0] == (0, False)
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in rows)
