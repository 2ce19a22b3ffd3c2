"""Mixing, sharding and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from docflow.llm import mixing, sharding


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > epochs * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        open_ -= over
    return target


def sourced(seed, count):
    rng = random.Random(seed)
    rows = [(0, None, "b"), (1, "", None), (2, " ", "empty"), (3, "w " * 30_000, "a")]
    for doc_id in range(4, count):
        rows.append((doc_id, "w " * rng.randrange(60), rng.choice([None, "a", "b", "c", "ä", "B", "rare"] if rng.random() < 0.9 else ["c"])))
    return rows


def test_targets_and_taken_words(make):
    rows = sourced(1, 300)
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = water_fill(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix(make(rows).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(make([])).count() == 0


def test_documents_are_repeated(make):
    docs = make(sourced(2, 120))
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    rows = mixing.repeat_documents(docs)
    assert rows.columns == docs.columns
    counts = {}
    for r in rows.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    for doc_id, r in plan.items():
        times = counts.get(doc_id, 0)
        assert times == (1 if not r["size"] else r["copies"] + (2 * r["part"] >= r["size"]))


def test_cuts_are_minimax():
    rng = random.Random(3)

    def feasible(sizes, shards, capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    for _ in range(300):
        sizes = sorted((rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))), reverse=True)
        shards = rng.randrange(1, 8)
        values, counts = np.unique(-np.array(sizes), return_counts=True)
        cuts = sharding.minimax_cuts(-values, counts, shards)
        assert cuts[-1] == len(sizes) and len(cuts) <= shards and cuts == sorted(cuts)
        loads = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
        assert max(loads) == next(c for c in range(1, sum(sizes) + 1) if feasible(sizes, shards, c))


def test_shards(make):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, "x" * 100_000)] + [(i, rng.choice(["é" * 40, "same", "w" * rng.randrange(900)])) for i in range(3, 400)]
    rows += [(5, rows[5][1])]
    got = sharding.shard(make(rows), 6).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id) or ""
        assert (r["size"], r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
        texts.setdefault(text, set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    for shard in range(6):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard(make([])).count() == 0


def test_pipeline_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables)
        assert after.columns == columns, name
        docs = after.cache()
        assert 0 < docs.count() <= 3 * before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert last.count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
