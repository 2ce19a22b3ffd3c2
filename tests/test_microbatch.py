"""Queues that close by timers, shared scoring, and documents completed on a stream."""

import glob
import os
import random
import uuid
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.operators import batching, results, scoring
from docflow.streaming import completion, microbatch, runner
from tests.test_batching import arrivals

SCHEMA = "k bigint, t bigint, id bigint, request string, payload string"
OUT = T.StructType([T.StructField("raw_text", T.StringType())])


def stream(spark, tmp_path, parts, schema=SCHEMA):
    folder = str(tmp_path / f"in-{uuid.uuid4().hex}")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return runner.file_stream(spark, folder, schema, max_files=1)


def logging_model(folder, fail=False, lose=0):
    def score(rows: pd.DataFrame) -> pd.DataFrame:
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(",".join(rows["payload"]))
        if fail:
            raise RuntimeError("model down")
        return pd.DataFrame({"raw_text": "raw:" + rows["payload"]}).iloc[lose:]

    return score


def scored(spark, tmp_path, parts, wait_ms, max_rows, **kind):
    calls = tmp_path / "calls"
    calls.mkdir()
    frame = microbatch.score_microbatches(
        stream(spark, tmp_path, parts), "k", "t", "id", logging_model(str(calls), **kind), OUT,
        ["request", "id"], wait_ms * 1000, max_rows,
    )
    rows = runner.run_until_idle(frame, "scored", wait_ms).collect()
    return rows, [open(path).read().split(",") for path in glob.glob(f"{calls}/*")]


REQUESTS = [(0, 0, 0, "a", "a0"), (0, 1, 1, "b", "b0"), (0, 2, 2, "b", "b1"), (0, 3, 3, "c", "c0")]


def test_requests_share_a_call_and_get_their_own_results(spark, tmp_path):
    rows, calls = scored(spark, tmp_path, [REQUESTS], 100, 10)
    assert calls == [["a0", "b0", "b1", "c0"]]
    assert sorted((r.request, r.raw_text, r.error, r.batch_rows) for r in rows) == [
        ("a", "raw:a0", None, 4), ("b", "raw:b0", None, 4), ("b", "raw:b1", None, 4), ("c", "raw:c0", None, 4)]


def test_a_large_request_is_split_in_order(spark, tmp_path):
    rows, calls = scored(spark, tmp_path, [[(0, 0, i, "r", f"p{i}") for i in range(5)]], 1, 2)
    assert sorted(calls) == [["p0", "p1"], ["p2", "p3"], ["p4"]]
    assert [r.raw_text for r in sorted(rows, key=lambda r: r.id)] == [f"raw:p{i}" for i in range(5)]


@pytest.mark.parametrize("kind, message", [({"fail": True}, "model down"), ({"lose": 1}, "3 outputs for 4 inputs")])
def test_an_error_reaches_every_request_of_the_batch(spark, tmp_path, kind, message):
    rows, calls = scored(spark, tmp_path, [REQUESTS], 100, 10, **kind)
    assert len(calls) == 1 and len(rows) == 4
    assert all(message in r.error and r.raw_text is None for r in rows)


def test_close_events_equal_the_batch_operator(spark, tmp_path):
    rows = sorted(((k, t * 1_000_000, i, f"r{i % 5}", "") for k, t, i in arrivals(23, 300, 4, 30_000)), key=lambda r: r[1:3])
    wait = 600_000_000
    events = microbatch.close_events(stream(spark, tmp_path, [rows]), "k", "t", "id", "request", wait, 3, idle_ms=300)
    got = runner.run_until_idle(events, "events", 300).collect()
    table = spark.createDataFrame(rows, SCHEMA)
    batches = batching.bounded_batches(table, "t", "id", wait, 3, key="k").join(table.select("id", "request"), "id")
    stats = batching.batch_wait_stats(batches, "t", "request", wait, 3).join(batches.groupBy("batch_id").agg(F.min("k").alias("k"), F.min("opened_at").alias("opened_at")), "batch_id")
    expected = sorted((r.k, r.opened_at, r["rows"], r.requests, r.wait_p50, r.wait_max) for r in stats.collect())
    assert sorted((r.k, r.opened_at, r["rows"], r.requests, r.wait_p50, r.wait_max) for r in got) == expected
    last = {r.k: max(e.opened_at for e in got if e.k == r.k) for r in got}
    assert all((r.reason == "full") == (r["rows"] == 3) for r in got)
    assert all(r.opened_at == last[r.k] for r in got if r.reason == "idle")
    assert sum(r["rows"] for r in got) == len(rows)


def test_an_idle_queue_closes_by_its_timer_and_opens_anew(spark, tmp_path):
    folder = str(tmp_path / "in")
    one = spark.createDataFrame([(7, 5, 1, "a", "")], SCHEMA).coalesce(1)
    one.write.mode("append").parquet(folder)
    events = microbatch.close_events(runner.file_stream(spark, folder, SCHEMA), "k", "t", "id", "request", 500_000, 9)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def until_idle():
        running = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(
            processingTime="100 milliseconds").start()
        runner._let_timers_end(running, 0.5)
        running.stop()
        return sorted((r.k, r.opened_at, r.closed_at, r.reason, r["rows"]) for r in spark.read.parquet(out).collect())

    assert until_idle() == [(7, 5, 500_005, "idle", 1)]
    spark.createDataFrame([(7, 9, 2, "b", "")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert until_idle() == [(7, 5, 500_005, "idle", 1), (7, 9, 500_009, "idle", 1)]


def test_arguments_of_queues(spark, tmp_path):
    frame = stream(spark, tmp_path, [REQUESTS])
    for wait, rows in ((-1, 1), (1, 0)):
        with pytest.raises(ValueError):
            microbatch.close_events(frame, "k", "t", "id", "request", wait, rows)
    with pytest.raises(ValueError):
        microbatch.close_events(frame, "k", "payload", "id", "request")


def test_a_key_gives_its_closed_batches_together():
    """A frame for every closed batch made a key of many small batches slow."""
    rows = [((i, i, "r", f"p{i}"), (i, i, "r", None)) for i in range(4)]
    calls = []

    def score(part: pd.DataFrame) -> pd.DataFrame:
        calls.append(list(part.index))
        if part["payload"].iloc[0] == "p2":
            raise RuntimeError("model down")
        return pd.DataFrame({"raw_text": part["payload"], "tokens": [1, None]})

    outputs = OUT.add("tokens", "long")
    frames = [pd.DataFrame(list(pair), columns=["t", "id", "request", "payload"]) for pair in rows]
    found = scoring.run_scorer_on_each(frames, score, outputs)
    assert calls == [[0, 1]] * 4
    assert list(found["raw_text"]) == ["p0", None, "p1", None, None, None, "p3", None]
    assert [None if pd.isna(n) else n for n in found["tokens"]] == [1, None, 1, None, None, None, 1, None]
    assert found["error"] == [None] * 4 + ["model down"] * 2 + [None] * 2
    queue = microbatch.Queue(T.StructType().add("t", "long").add("id", "long"), "t", "id", 1, 5, 1, lambda key, done: done)
    queue.waiting = SimpleNamespace(get=lambda: iter(()), put=lambda left: None, clear=lambda: None)
    queue.handle = SimpleNamespace(registerTimer=lambda at: None, listTimers=lambda: iter(()), deleteTimer=lambda at: None)
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    given = list(queue.handleInputRows((7,), [pd.DataFrame({"t": [0, 5, 9], "id": [0, 1, 2]})], clock))
    assert given == [[([(0, 0)], "next", 1), ([(5, 1)], "next", 6)]]


def processor(kind, *arguments):
    """A stateful processor whose state and timers are kept here."""
    made, waiting, timers = kind(*arguments), [], set()

    def put(rows):
        waiting[:] = rows

    state = SimpleNamespace(get=lambda: iter(list(waiting)), put=put, clear=waiting.clear)
    made.init(SimpleNamespace(
        getListState=lambda name, schema: state, registerTimer=timers.add, deleteTimer=timers.discard, listTimers=lambda: iter(set(timers))))
    return made, timers


def trigger(made, timers, key, rows, names, now):
    """What a processor gives for the rows of a trigger, and then for the timers that have run out."""
    out, times = [], SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
    if rows:
        # Two frames, as from two Arrow batches.
        halves = [pd.DataFrame(part, columns=names) for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :])]
        out += [e for given in made.handleInputRows(key, halves, times) for e in given]
    for at in sorted(t for t in timers if t <= now):
        timers.discard(at)
        expired = SimpleNamespace(getExpiryTimeInMs=lambda: at)
        out += [e for given in made.handleExpiredTimer(key, times, expired) for e in given]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_queues_of_a_group_close_as_each_by_itself(seed):
    rng = random.Random(seed)
    schema = T.StructType().add("k", "long").add("t", "long").add("id", "long")
    names, keys, last = schema.names, [None] if seed == 3 else list(range(7)), 0
    group, group_timers = processor(microbatch.Queues, schema, "k", "t", "id", 15, 3, 20, lambda done: done)
    single = {k: processor(microbatch.Queue, T.StructType(schema.fields[1:]), "t", "id", 15, 3, 20, lambda key, done: [(key[0], *d) for d in done])
              for k in keys}
    together, apart, arrived = [], [], 0
    for now in range(0, 400, 8):
        rows = [(rng.choice(keys), last + rng.randrange(40) - 5, arrived + i) for i in range(rng.choice((0, 0, 1, 4, 30)))] if now < 300 else []
        last, arrived = last + 12, arrived + len(rows)
        together += [(q, [r[1:] for r in batch], *rest) for q, batch, *rest in trigger(group, group_timers, (0,), rows, names, now)]
        for k, (made, timers) in single.items():
            own = [r[1:] for r in rows if r[0] == k]
            apart += trigger(made, timers, (k,), own, names[1:], now)
    assert sorted(map(repr, together)) == sorted(map(repr, apart)) and {why for _, _, why, _ in apart} == {"full", "next", "idle"}
    assert sum(len(batch) for _, batch, _, _ in together) == arrived


def test_one_call_serves_the_queues_of_a_group():
    """A call for every queue made streams of many queues slow."""
    schema = T.StructType().add("k", "string").add("t", "long").add("id", "long")
    calls = []
    group, timers = processor(microbatch.Queues, schema, "k", "t", "id", 10, 2, 5, lambda done: calls.append(done) or done)
    rows = [(f"q{i}", t, 10 * i + t) for i in range(50) for t in (0, 1, 2)]
    trigger(group, timers, (0,), rows, schema.names, 0)
    assert len(calls) == 1 and [why for _, _, why, _ in calls[0]] == ["full"] * 50 and timers == {5}
    trigger(group, timers, (0,), [], schema.names, 5)
    assert len(calls) == 2 and [why for _, _, why, _ in calls[1]] == ["idle"] * 50


@pytest.mark.parametrize("kind", ["string", "decimal(5,0)"])
def test_close_events_of_keys_that_are_null_or_of_any_type(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(microbatch, "QUEUE_GROUPS", 3)
    rows = [(None if i % 9 == 8 else i % 9, 10 * i, i, None if i % 4 == 0 else f"r{i % 3}", "") for i in range(90)]
    arriving = stream(spark, tmp_path, [rows]).withColumn("k", F.col("k").cast(kind))
    got = runner.run_until_idle(microbatch.close_events(arriving, "k", "t", "id", "request", 1000, 4, idle_ms=300), "kinds", 300)
    assert got.schema["k"].dataType.simpleString() == kind
    found = sorted((str(r.k), r.opened_by, r.reason, r["rows"]) for r in got.collect())
    queues = [(str(k), [i for i in range(90) if (None if i % 9 == 8 else i % 9) == k]) for k in [None, *range(8)]]
    assert found == sorted((k, ids[s], "full" if s < 8 else "idle", len(ids[s : s + 4])) for k, ids in queues for s in (0, 4, 8))


# -- documents ---------------------------------------------------------------

PAGE = "document_index bigint, page_index bigint, page_count bigint, batch_id bigint, input_tokens bigint, output_tokens bigint, error string"


def page_rows():
    counts = [1, 3, 2500, 4, 2]
    rows = [(d, p, n, d, 3, p, "fail batch 3" if d == 3 and p == 2 else None) for d, n in enumerate(counts) for p in range(n)]
    return counts, [r for r in rows if (r[0], r[1]) != (4, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_complete_in_any_order_and_over_a_restart(spark, tmp_path, seed):
    counts, rows = page_rows()
    random.Random(seed).shuffle(rows)
    rows += rows[:40]  # pages that come twice
    cut = len(rows) // 3
    folder, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    pages = None
    for part in (rows[:cut], rows[cut:]):
        for half in (part[::2], part[1::2]):
            spark.createDataFrame(half, PAGE).coalesce(1).write.mode("append").parquet(folder)
        pages = runner.file_stream(spark, folder, PAGE, max_files=1)
        completion.complete_documents(pages).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    docs = spark.createDataFrame([(i, f"{i}.pdf", n, 0.0) for i, n in enumerate(counts)],
                                 "document_index bigint, document_path string, page_count bigint, render_s double")
    done = spark.createDataFrame([r for r in dict.fromkeys(rows)], PAGE)
    summary = results.document_summary(scoring.document_status(docs, done), done)
    names = ["document_index", "status", "error", "page_count", *results.USAGE]
    expected = [tuple(r) for r in summary.select(*names).orderBy("document_index").collect() if r.document_index != 4]
    assert [tuple(r) for r in spark.read.parquet(out).select(*names).orderBy("document_index").collect()] == expected


@pytest.mark.parametrize("size", [4, 100])
def test_output_goes_on_without_gaps(spark, tmp_path, size):
    numbers = list(range(30))
    random.Random(size).shuffle(numbers)
    numbers.remove(27)  # never comes
    parts = [[(n, f"d{n}") for n in numbers[i : i + 5]] for i in range(0, len(numbers), 5)]
    parts.append([(numbers[0], f"d{numbers[0]}")])  # comes again
    finished = stream(spark, tmp_path, parts, "document_index bigint, path string")
    got = completion.run_in_order(finished, "ordered", size).orderBy("trigger", "document_index").collect()
    assert [(r.document_index, r.path) for r in got] == [(n, f"d{n}") for n in range(27)]
    assert len({r.trigger for r in got}) > 1


def test_nothing_leaves_while_the_first_is_missing(spark, tmp_path):
    finished = stream(spark, tmp_path, [[(2, "c")], [(1, "b")]], "document_index bigint, path string")
    assert completion.run_in_order(finished, "ordered").count() == 0
