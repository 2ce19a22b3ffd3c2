"""Files under their own names, and one JSON line a document."""

import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docflow.operators import results
from docflow.plans import corpus, inputs
from docflow.sources import named_files, sinks
from tests.test_corpus import KEEP, OUTPUT, labelled, model


def files_in(folder):
    found = {}
    for path, _, names in os.walk(folder):
        for name in names:
            with open(os.path.join(path, name), encoding="utf-8", newline="") as file:
                found[os.path.relpath(os.path.join(path, name), folder)] = file.read()
    return found


def test_files_hold_their_pieces_in_order(spark, tmp_path):
    rows = [(f"d{i % 3}/é {i}.mmd", p, f"{i}:{p}\n") for i in range(20) for p in range(i % 4 + 1)]
    pieces = spark.createDataFrame(rows + [("empty.md", 0, None)], "file string, n int, piece string").repartition(7)
    folder = tmp_path / "out"
    (folder / "d0").mkdir(parents=True)
    (folder / "d0" / "é 0.mmd").write_text("old")
    named_files.write_named(pieces, str(folder), ["n"])
    expected = {"empty.md": ""}
    for name, _, piece in rows:
        expected[name] = expected.get(name, "") + piece
    assert files_in(folder) == expected


def test_a_task_that_is_run_again_leaves_each_file_once(spark, tmp_path):
    marker = str(tmp_path / "failed-once")

    def fail_once(parts):
        for part in parts:
            yield part
        # After the rows of this partition, so that its files are partly written.
        if not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("lost")

    writer = named_files._Writer(str(tmp_path / "out"))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"file": ["a.md", "a.md", "b.md"], "piece": ["1", "2", "3"]})
    with pytest.raises(RuntimeError):
        writer.write(fail_once([batch]))
    writer.commit([writer.write(fail_once([batch])), None])
    assert files_in(tmp_path / "out") == {"a.md": "12", "b.md": "3"}


def test_files_are_read_as_by_spark_in_few_tasks(spark, tmp_path):
    names = [f"d{i % 3}/x y%/é {i}[1].mmd" for i in range(400)] + ["top.md", "_hidden/a.md", "d0/.b.md", "d1/_c.md"]
    pieces = spark.createDataFrame([(name, 0, f"{name}\r\n\n") for name in names] + [("empty.md", 0, None)], "file string, n int, piece string")
    folder = str(tmp_path / "out")
    named_files.write_named(pieces, folder, ["n"])
    assert len(files_in(folder)) == 405
    own = named_files.read_named(spark, folder)
    assert own.rdd.getNumPartitions() <= 8
    text = spark.read.option("recursiveFileLookup", "true").schema("value string").text(folder, wholetext=True)
    shown = F.regexp_replace(F.input_file_name(), "^file:/+", "/")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, text.select(shown, "value").collect()))


def test_a_staged_write_is_moved_by_tasks(tmp_path):
    writer = named_files._Writer(str(tmp_path / "out"), "_staging-x")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"file": ["a.md", "b/c.md"], "piece": ["1", "2"]})
    lost, done = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([done])
    assert sorted(os.listdir(tmp_path / "out" / "_staging-x")) == [os.path.basename(done.folder)] and lost.folder != done.folder
    store, root = named_files.file_system(str(tmp_path / "out"))
    for _ in range(2):
        named_files._move(store, root, done.folder)
    assert sorted(f for f in files_in(tmp_path / "out")) == ["a.md", "b/c.md"]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("a.md", 0, "x"), ("../b.md", 0, "y")], "file string, n int, piece string")
    with pytest.raises(Exception, match="not a file name"):
        named_files.write_named(bad, str(tmp_path / "out"), ["n"], files=2)
    assert files_in(tmp_path / "out") == {}


def test_a_document_of_many_parts_is_one_line(spark, tmp_path):
    docs, pages = labelled(spark, a=3, b=1, c=2, d=0)
    pages = corpus.finished_pages(corpus.score_corpus(pages, docs, model(failing={2}), OUTPUT, KEEP, 2))
    from docflow.operators import scoring

    summary = results.document_summary(scoring.document_status(docs, pages), pages)
    parts = results.document_results(summary, pages, block=1)
    named_files.write_result_lines(parts, str(tmp_path / "out"), files=2)
    lines = [json.loads(line) for _, text in sorted(files_in(tmp_path / "out").items()) for line in text.splitlines()]
    whole = [json.loads(r.value) for r in results.result_lines(results.document_results(summary, pages)).orderBy("document_index").collect()]
    for line in whole:
        del line["part_index"], line["part_count"]
    assert lines == whole and [len(line["results"]) for line in lines] == [3, 1, 0, 0]


@pytest.mark.parametrize("kind, name", [("tagged", "a_det.mmd"), ("markdown", "a.mmd"), ("eval", "a.pdf"), ("result", "a.pdf/result.mmd"), ("original", "a.pdf/result_ori.mmd")])
def test_kinds_of_markdown(spark, tmp_path, kind, name):
    docs = spark.createDataFrame([(0, "x/a.pdf")], "document_index bigint, document_path string")
    text = "<|ref|>image<|/ref|><|det|>[[0, 0, 9, 9]]<|/det|>hi<｜end▁of▁sentence｜>"
    pages = spark.createDataFrame([(0, 0, 1, text, 10, 10)], "document_index bigint, page_index bigint, page_count bigint, raw_text string, width int, height int")
    named_files.write_named(sinks.markdown_files(pages, docs, kind), str(tmp_path / "out"), ["part_index"])
    [(file, body)] = files_in(tmp_path / "out").items()
    assert file == f"x/{name}" and "hi" in body
    with pytest.raises(ValueError):
        sinks.markdown_files(pages, docs, "other")
