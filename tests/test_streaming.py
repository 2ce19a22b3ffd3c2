import random
import uuid
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docflow.streaming import batches, deltas, runner, timing, usage
from tests.test_batching import arrivals, greedy

SCHEMA = "k bigint, t bigint, id bigint"


def as_files(spark, tmp_path, rows, count, shuffled=False):
    """Rows cut by time into parquet files, oldest first, or cut at random."""
    folder = tmp_path / f"in-{uuid.uuid4().hex}"
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    if shuffled:
        random.Random(1).shuffle(rows)
    size = -(-len(rows) // count)
    for i in range(count):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


@pytest.mark.parametrize("file_count", [1, 4])
def test_stream_batches_equal_table_batches(spark, tmp_path, file_count):
    # Microsecond times, 1 to 400 seconds apart.
    rows = [(k, t * 1_000_000, i) for k, t, i in arrivals(21, 400, 4, 40_000)]
    folder = as_files(spark, tmp_path, rows, file_count)
    stream = runner.file_stream(spark, folder, SCHEMA, max_files=1)
    wait = 600_000_000
    got = runner.run_to_end(
        batches.stream_bounded_batches(stream, "k", "t", "id", wait, 3), "batches"
    ).collect()
    expected = {
        (k, t, i): (batch[0][1], batch[0][2]) for batch in greedy(rows, wait, 3) for k, t, i in batch
    }
    assert {(r.k, r.t, r.id): (r.opened_at, r.opened_by) for r in got} == expected
    assert len(got) == len(rows)


def test_usage_by_window_counts_every_page(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), rng.randint(0, 20_000) * 1_000_000, i) for i in range(500)]
    folder = as_files(spark, tmp_path, rows, 4, shuffled=True)
    pages = runner.table_stream(spark, folder, max_files=1).select(
        F.timestamp_micros("t").alias("at"), F.lit(2).alias("input_tokens"), F.lit(3).alias("output_tokens")
    )
    got = runner.run_updates_to_end(
        usage.usage_by_window(pages, "at", "1 hour"), "usage", ["window_start_us"]
    ).collect()
    hour = 3600 * 1_000_000
    expected = {}
    for _, t, _ in rows:
        expected[t // hour * hour] = expected.get(t // hour * hour, 0) + 1
    assert {r.window_start_us: r.pages for r in got} == expected
    assert all(r.total_tokens == 5 * r.pages for r in got)


def test_no_arrival_is_lost_in_any_order(spark, tmp_path):
    rows = [(k, t * 1_000_000, i) for k, t, i in arrivals(22, 400, 4, 40_000)]
    folder = as_files(spark, tmp_path, rows, 4, shuffled=True)
    stream = runner.table_stream(spark, folder, max_files=1)
    got = runner.run_to_end(
        batches.stream_bounded_batches(stream, "k", "t", "id", 600_000_000, 3), "batches"
    ).collect()
    assert sorted((r.k, r.t, r.id) for r in got) == sorted(rows)


def test_a_table_of_one_file_and_one_of_many(spark, tmp_path):
    rows = [(0, i, i) for i in range(8)]
    folder = as_files(spark, tmp_path, rows, 4)
    one = next(str(p) for p in (tmp_path / folder).glob("part-*.parquet"))
    counts = [
        runner.run_to_end(runner.table_stream(spark, path, max_files=1), "table").count() for path in (folder, one)
    ]
    assert counts == [8, 2]


def test_admission_limits(spark, tmp_path):
    with pytest.raises(ValueError):
        runner.file_stream(spark, str(tmp_path), SCHEMA, max_files=1, max_bytes="1m")
    folder = as_files(spark, tmp_path, [(0, i, i) for i in range(8)], 4)
    stream = runner.file_stream(spark, folder, SCHEMA, max_files=1)
    query = (
        stream.writeStream.format("noop")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [2, 2, 2, 2]


@pytest.mark.parametrize("file_count", [1, 3])
def test_snapshot_deltas_carry_the_length_over(spark, tmp_path, file_count):
    folder = tmp_path / "snapshots"
    text, rows = {0: "", 1: ""}, []
    for step in range(12):
        for key in text:
            text[key] += f"é{key}{step}" * (step % 3)
            rows.append((key, step, text[key]))
    schema = "key bigint, step bigint, full string"
    for i in range(file_count):
        part = [r for r in rows if r[1] * file_count // 12 == i]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = runner.file_stream(spark, str(folder), schema, max_files=1)
    got = runner.run_to_end(deltas.stream_snapshot_deltas(stream, ["key"], "step", "full"), "deltas").collect()
    assert {(r.key, r.step): r.delta for r in got} == {
        (key, step): f"é{key}{step}" * (step % 3) for step in range(12) for key in text
    }


class CountingMap(dict):
    """Map state that counts how often it is asked."""

    asked = 0

    def iterator(self):
        self.asked += 1
        return iter([((k,), (v,)) for k, v in self.items()])

    def updateValue(self, key, value):
        self.asked += 1
        self[key[0]] = value[0]

    def exists(self):
        self.asked += 1
        return bool(self)

    def containsKey(self, key):
        self.asked += 1
        return key[0] in self

    def getValue(self, key):
        self.asked += 1
        return (self[key[0]],) if key[0] in self else None


def test_request_timing_reads_its_sums_once():
    """Every step was looked up, read and written on its own, and all were read again."""
    spans, stored = timing.Spans(), CountingMap(a=1, d=7)
    spans.sums = stored
    spans.total = SimpleNamespace(get=lambda: (5.0,), exists=lambda: True, update=lambda row: None)
    part = pd.DataFrame({"step": ["a", "b", "c", "a", None], "parts": [1, 2, 3, 4, 0], "total_ms": [None] * 5})
    given = list(spans.handleInputRows((3,), iter([part]), None))
    assert given[0].to_dict("records") == [{"request_id": 3, "total": 5.0, "sums": {"a": 6, "b": 2, "c": 3, "d": 7}}]
    assert dict(stored) == {"a": 6, "b": 2, "c": 3, "d": 7}
    assert stored.asked == 4


def test_snapshots_of_a_trigger_in_any_order(spark, tmp_path):
    rows = [(k, n, "abcdefgh"[: 2 * n]) for k in range(20) for n in (3, 1, 2)]
    folder = str(tmp_path / "shots")
    spark.createDataFrame(rows, "k long, n long, text string").write.parquet(folder)
    stream = runner.file_stream(spark, folder, "k long, n long, text string")
    got = runner.run_to_end(deltas.stream_snapshot_deltas(stream, ["k"], "n", "text"), "shots").collect()
    assert sorted(tuple(r) for r in got) == [(k, n, "abcdefgh"[2 * n - 2 : 2 * n]) for k in range(20) for n in (1, 2, 3)]
