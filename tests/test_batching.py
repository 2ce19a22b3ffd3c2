import random

import pytest

from docflow.operators import batching


def greedy(rows, max_wait, max_rows):
    """Batches of (key, time, id) rows, a queue per key, one row at a time."""
    batches, current = [], None
    for key, time, number in sorted(rows):
        full = current and (len(current) == max_rows or current[0][0] != key or time >= current[0][1] + max_wait)
        if current is None or full:
            current = []
            batches.append(current)
        current.append((key, time, number))
    return batches


def arrivals(seed, count, keys, spread, bursts=False):
    rng = random.Random(seed)
    times = [rng.randint(0, spread) // (50 if bursts else 1) * (50 if bursts else 1) for _ in range(count)]
    # Key 0 holds most of the rows.
    return [(0 if rng.random() < 0.6 else rng.randrange(keys), t, i) for i, t in enumerate(times)]


@pytest.mark.parametrize(
    "seed,count,keys,spread,bursts,max_wait,max_rows,block",
    [
        (1, 700, 5, 5000, False, 40, 4, 4),
        (2, 700, 1, 3000, False, 30, 6, 17),
        (3, 500, 40, 500, True, 100, 3, 8),
        (4, 300, 2, 0, False, 10, 7, 16),
        (5, 400, 3, 100000, False, 5, 5, 32),
        (6, 200, 3, 1000, False, 0, 5, 8),
        (7, 300, 3, 1000, False, 50, 1, 8),
        (8, 900, 3, 900, False, 10**6, 128, 128),
        (9, 100, 3, 900, False, 60, 9, 65536),
    ],
)
def test_bounded_batches_match_a_row_by_row_pass(spark, seed, count, keys, spread, bursts, max_wait, max_rows, block):
    rows = arrivals(seed, count, keys, spread, bursts)
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint")
    got = batching.bounded_batches(df, "t", "id", max_wait, max_rows, key="k", block=block).collect()
    expected = {
        (k, t, i): (number, batch[0][1])
        for number, batch in enumerate(greedy(rows, max_wait, max_rows))
        for k, t, i in batch
    }
    assert {(r.k, r.t, r.id): (r.batch_id, r.opened_at) for r in got} == expected
    assert len(got) == count


def test_one_queue_for_all(spark):
    rows = [(0, t, i) for _, t, i in arrivals(11, 400, 3, 4000)]
    df = spark.createDataFrame([(t, i) for _, t, i in rows], "t bigint, id bigint")
    got = batching.bounded_batches(df, "t", "id", 50, 6, block=16).collect()
    expected = {i: n for n, batch in enumerate(greedy(rows, 50, 6)) for _, _, i in batch}
    assert {r.id: r.batch_id for r in got} == expected


def test_many_groups_of_summaries(spark, monkeypatch):
    monkeypatch.setattr(batching, "SUMMARY_GROUP", 3)
    rows = arrivals(12, 600, 2, 3000)
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint")
    got = batching.bounded_batches(df, "t", "id", 25, 4, key="k", block=8).collect()
    expected = {i: n for n, batch in enumerate(greedy(rows, 25, 4)) for _, _, i in batch}
    assert {r.id: r.batch_id for r in got} == expected


def test_requests_share_a_batch(spark):
    rows = [("req-a", 0, 0), ("req-b", 1, 1), ("req-b", 2, 2), ("req-c", 3, 3)]
    df = spark.createDataFrame(rows, "request_id string, t bigint, id bigint")
    batches = batching.bounded_batches(df.drop("request_id"), "t", "id", 100, 10).join(df.drop("t"), "id")
    assert {r.batch_id for r in batches.collect()} == {0}
    stats = batching.batch_wait_stats(batches, "t", "request_id", 100, 10).collect()
    # Closes when its wait is over; waits are 100, 99, 98, 97, the upper median 99.
    assert [(s.rows, s.requests, s.wait_p50, s.wait_max) for s in stats] == [(4, 3, 99, 100)]


def test_large_request_is_split_by_count(spark):
    df = spark.createDataFrame([(0, i) for i in range(5)], "t bigint, id bigint")
    batches = batching.bounded_batches(df, "t", "id", 1, 2)
    rows = batches.orderBy("id").collect()
    assert [r.batch_id for r in rows] == [0, 0, 1, 1, 2]
    stats = batching.batch_wait_stats(batches.withColumnRenamed("id", "request"), "t", "request", 1, 2)
    assert sorted((s.batch_id, s.rows, s.wait_max) for s in stats.collect()) == [(0, 2, 0), (1, 2, 0), (2, 1, 1)]


def test_no_arrivals(spark):
    df = spark.createDataFrame([], "t bigint, id bigint")
    assert batching.bounded_batches(df, "t", "id", 10, 2).count() == 0


@pytest.mark.parametrize("wait,rows,block", [(-1, 1, 8), (1, 0, 8), (1, 9, 8)])
def test_bounded_batch_arguments(spark, wait, rows, block):
    with pytest.raises(ValueError):
        batching.bounded_batches(spark.range(1), "id", "id", wait, rows, block=block)


def test_page_batches_cross_documents(spark):
    docs = spark.createDataFrame([(0, 3), (1, 0), (2, 1), (5, 4)], "document_index bigint, page_count bigint")
    pages = docs.filter("page_count > 0").selectExpr(
        "document_index", "explode(sequence(0L, page_count - 1)) as page_index"
    )
    got = batching.page_batches(pages, docs, 2).orderBy("document_index", "page_index").collect()
    assert [r.batch_id for r in got] == [0, 0, 1, 1, 2, 2, 3, 3]
    with pytest.raises(ValueError):
        batching.page_batches(pages, docs, 0)
