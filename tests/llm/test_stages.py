"""The rows that each stage of the pipeline keeps, against brute force."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from docflow.llm import mixing, toxicity

BIG = (1 << 60) + 1
STAGES = dict(corpus_pipeline.STAGES)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([2, 6, 40, 90]))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 60):  # copies, some with one word changed, some repeated rows
        words = rng.choice(base).split()
        if rng.random() < 0.5 and len(words) > 30:
            words[0] = "changed"
        rows.append((i, " ".join(words)))
    rows += [rows[30], rows[30], (None, base[3]), (None, base[3]), (None, "only here " * 9), (None, None), (70, None), (71, ""), (BIG, base[5]), (BIG + 1, "one big id " * 7)]
    rng.shuffle(rows)
    return rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def without_copies(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc_id is None, doc_id or 0, text or ""))
    return sorted((none, doc_id) for none, doc_id, _ in map(min, groups.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_one_of_each_group_of_copies_stays(spark, make, seed, tmp_path):
    rows = texts(seed)
    make(rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = STAGES["ngram_jaccard_join"](spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == without_copies(rows)
    assert STAGES["ngram_jaccard_join"](spark, make([]), None).count() == 0


def test_leaks_go_and_everything_else_stays(spark, make, tmp_path):
    passage = "the quick brown fox jumps over the lazy dog near the river"
    rows = [(1, f"start {passage} end"), (2, "clean text"), (None, passage.upper()), (None, None), (BIG, "clean text"), (2, "clean text"),
            (3, passage.replace("fox", "fix")), (4, passage[:30])]
    spark.createDataFrame([(1, passage), (2, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = STAGES["benchmark_decontamination"](spark, make(rows), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([2, 2, None, BIG, 4])


def test_mixing_takes_every_row_on_its_own(spark, make, tmp_path):
    rng = random.Random(3)
    rows = [(i, "a b c " * rng.randint(1, 9), rng.choice(["s1", "s2", None])) for i in range(80)]
    rows += [(5, "x y", "s1"), (5, "x y", "s1"), (5, "longer " * 30, "s1"), (None, "n n", "s2"), (None, "n n n", "s2"), (None, None, "s2"), (90, "", "s3")]
    make(rows).repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = STAGES["mixing"](spark, docs, None).collect()
    plan = mixing.mix(docs).collect()
    # Copies per (id, source, size): whole ones for all rows alike, one more at and before the edge.
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in kept)
    expected = Counter()
    for p in plan:
        expected[p.doc_id, p.source, p.size] += 1 if p.size == 0 else p.copies + (2 * p.part >= p.size)
    assert got == +expected
    for source in ("s1", "s2", None):
        own = [p for p in plan if p.source == source]
        assert sum(p.taken for p in own) == pytest.approx(own[0].target, abs=1)
    assert STAGES["mixing"](spark, make([]), None).count() == 0


def test_toxicity_keeps_what_scores_below_the_limit(spark, make, tmp_path):
    rows = [(i, ("vile rotten scum " if i % 3 == 0 else "a calm day ") * (i % 5 + 1)) for i in range(150)] + [(None, None), (BIG, "a calm day"), (3, "a calm day"), (3, "a calm day")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = make(rows)
    scores = toxicity.score(docs, labels, keep=("text",)).collect()
    kept = STAGES["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in scores if r.score < 0.3)
    assert sum(r.score >= 0.3 for r in scores) == 50


def test_sharding_stage_places_every_row(spark, make):
    rows = texts(4)
    got = STAGES["sharding"](spark, make(rows), None).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
