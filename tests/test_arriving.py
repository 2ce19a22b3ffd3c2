"""Repetition and request timing while their input arrives."""

import random
import uuid
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from docflow.operators import markup, metrics
from docflow.streaming import repetition, runner, timing

PIECES = "document_index bigint, page_index bigint, start bigint, token_ids array<int>"


def stream(spark, tmp_path, triggers, schema):
    """One file, and so one trigger, for each list of rows."""
    folder = str(tmp_path / f"in-{uuid.uuid4().hex}")
    for rows in triggers:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return runner.file_stream(spark, folder, schema, max_files=1)


def cut(rng, texts, longest):
    """Pieces of random lengths, each as (text, start, tokens)."""
    pieces = []
    for key, tokens in texts.items():
        at = 0
        while at < len(tokens):
            size = rng.randint(1, longest)
            pieces.append((*key, at, tokens[at : at + size]))
            at += size
    return pieces


@pytest.mark.parametrize("longest, order", [(1, "in order"), (7, "shuffled"), (40, "shuffled"), (5, "repeated")])
def test_repetition_is_the_same_however_tokens_are_cut(spark, tmp_path, longest, order):
    rng = random.Random(longest)
    texts = {(i, i % 2): [rng.randrange(3) for _ in range(rng.randrange(60))] for i in range(8)}
    pieces = cut(rng, texts, longest)
    if order == "repeated":
        # The same text again, cut otherwise: all of it is known, or overlaps.
        pieces += cut(rng, texts, 9)
    if order != "in order":
        rng.shuffle(pieces)
    triggers = [pieces[i::3] if order != "in order" else pieces[i * len(pieces) // 3 : (i + 1) * len(pieces) // 3] for i in range(3)]
    found = repetition.stream_repeated_ngrams(stream(spark, tmp_path, triggers, PIECES), 3, 12, (2,))
    got = sorted(tuple(r) for r in runner.run_to_end(found, "repeated").collect())
    whole = spark.createDataFrame([(*key, tokens) for key, tokens in texts.items()], "document_index bigint, page_index bigint, token_ids array<int>")
    expected = sorted(tuple(r) for r in markup.repeated_ngrams(whole, 3, 12, (2,)).collect())
    assert got == expected and (expected or longest < 3)


def test_pieces_without_tokens_or_start_are_left_out(spark, tmp_path):
    rows = [(0, 0, 0, [5, 6, 5, 6]), (0, 0, 4, []), (0, 0, 4, None), (0, 0, None, [5, 6]), (0, 0, 4, [5, 6]), (1, 0, 3, [5, 5, 5])]
    found = repetition.stream_repeated_ngrams(stream(spark, tmp_path, [rows[:2], rows[2:]], PIECES), 2, 20, ())
    # Text 1 lacks its first tokens: nothing is known of it yet.
    assert {tuple(r) for r in runner.run_to_end(found, "repeated").collect()} == {(0, 0, 3, 0), (0, 0, 4, 1), (0, 0, 5, 2)}
    with pytest.raises(ValueError):
        repetition.stream_repeated_ngrams(spark.createDataFrame([], PIECES), 0)


def test_texts_of_a_group_are_told_apart(spark, tmp_path, monkeypatch):
    """Each text had calls and a state of its own; few groups hold them now, also with nulls and large numbers in the keys."""
    monkeypatch.setattr(repetition, "TEXT_GROUPS", 2)
    rng = random.Random(12)
    ids = [(name, number) for name in ("a", "b", "", None) for number in (0, 1, (1 << 53) + 1, (1 << 53) + 2, None)]
    texts = {key: [rng.randrange(3) for _ in range(rng.randrange(50))] for key in ids}
    pieces = cut(rng, texts, 9) + cut(rng, texts, 4)
    rng.shuffle(pieces)
    schema = "name string, number bigint, start bigint, token_ids array<int>"
    arriving = stream(spark, tmp_path, [pieces[i::4] for i in range(4)], schema)
    found = repetition.stream_repeated_ngrams(arriving, 3, 12, (2,), keys=("name", "number"))
    got = runner.run_to_end(found, "repeated").collect()
    whole = spark.createDataFrame([(*key, tokens) for key, tokens in texts.items()], "name string, number bigint, token_ids array<int>")
    expected = markup.repeated_ngrams(whole.filter("number is not null"), 3, 12, (2,), keys=("name", "number")).collect()
    assert sorted(map(repr, (r for r in got if r.number is not None))) == sorted(map(repr, expected)) and expected
    nulls = markup.repeated_ngrams(whole.filter("number is null").withColumn("number", F.lit(7)), 3, 12, (2,), keys=("name", "number")).collect()
    assert sorted(repr((r.name, r.position, r.earlier_start)) for r in got if r.number is None) == sorted(repr((r.name, r.position, r.earlier_start)) for r in nulls)


def test_texts_of_other_keys_have_a_state_of_their_own(spark, tmp_path):
    rows = [(0.5, 0, [5, 6, 5]), (1.5, 0, [5, 6]), (0.5, 3, [6]), (1.5, 2, [5, 6])]
    arriving = stream(spark, tmp_path, [rows[:2], rows[2:]], "key double, start bigint, token_ids array<int>")
    found = repetition.stream_repeated_ngrams(arriving, 2, 20, (), keys=("key",))
    got = runner.run_to_end(found, "repeated").collect()
    assert sorted((str(r.key), r.position, r.earlier_start) for r in got) == [("0.5", 3, 0), ("1.5", 3, 0)]


SPANS, TOTALS = "request_id bigint, step string, ms decimal(18,2)", "request_id bigint, total_ms double"


def as_rows(rows):
    return {r.request_id: (r.total_ms, r.steps) for r in rows.collect()}


@pytest.mark.parametrize("first", ["spans", "responses", "mixed"])
def test_timing_is_the_same_whichever_comes_first(spark, tmp_path, first):
    rng = random.Random(4)
    spans = [(rng.randrange(20), rng.choice(["gpu_generate", "cpu_preprocess", "own"]), Decimal(rng.randrange(-500, 5000)) / 100) for _ in range(200)]
    totals = [(i, float(rng.randrange(900))) for i in range(2, 24)]
    empty = ([(-1, None, None)], [(None, None)])
    parts = {
        "spans": ([spans[:90], spans[90:], empty[0], empty[0]], [empty[1], empty[1], totals[:9], totals[9:]]),
        "responses": ([empty[0], empty[0], spans[:90], spans[90:]], [totals[:9], totals[9:], empty[1], empty[1]]),
        "mixed": ([spans[:50], spans[50:60], spans[60:]], [totals[:5], totals[5:20], totals[20:]]),
    }[first]
    live = timing.stream_request_timing(stream(spark, tmp_path, parts[0], SPANS), stream(spark, tmp_path, parts[1], TOTALS))
    got = as_rows(runner.run_updates_to_end(live, "timing", ["request_id"]))
    expected = as_rows(metrics.request_timing(spark.createDataFrame(spans, SPANS), spark.createDataFrame(totals, TOTALS)))
    assert got == expected and set(got) == set(range(2, 24))
