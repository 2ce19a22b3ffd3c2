"""Toxicity, licences, token counts and decontamination."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docflow.llm import decontamination, licenses, token_counts, toxicity

LOWER = {i: i + 32 for i in range(65, 91)}


def test_toxicity_on_held_out_rows(spark, make):
    rng = random.Random(1)
    rows, labels = [], []
    for doc_id in range(900):
        own = [f"word{rng.randrange(200)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            own[rng.randrange(len(own))] = f"nasty{rng.randrange(50)}"
        rows.append((doc_id, " ".join(own)))
        labels.append((doc_id, int(toxic)))
    rows += [(9000, None), (9001, ""), (9002, "word1 " * 30_000), (9003, "word1 nasty777"), (None, "word2"), (0, rows[0][1])]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(make(rows), table, keep=("source",)).withColumn("held", toxicity.fold() == 2).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [(r.score >= 0.3, truth[r.doc_id]) for r in got if r.held and r.doc_id in truth]
    right = sum(a == bool(b) for a, b in held) / len(held)
    assert right > 0.9
    by_id = {r.doc_id: r for r in got}
    assert by_id[9003].score > 0.3 > by_id[9002].score
    assert by_id[9000].score == by_id[9001].score
    kept = toxicity.keep_clean(make(rows), table)
    assert kept.columns == make(rows).columns


def test_toxicity_without_labels_or_documents(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(make([(1, "a")]), none).collect()] == [0.0]
    assert toxicity.score(make([]), none).count() == 0
    ones = spark.createDataFrame([(1, 1), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(make([(i, "a") for i in range(5)]), ones).collect()} <= {0.0, 1.0}


def test_toxicity_learns_from_every_labelled_row(spark, make):
    ids = spark.range(12_000).withColumnRenamed("id", "doc_id").filter(toxicity.fold() != 2)
    order = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id")).collect()]
    # Label 1 only behind the first 8,000 rows by a hash of the id.
    assert len(order) > 8_300
    toxic = set(order[8_000:])
    docs = make([(i, "plain words here" + (" nasty" if i in toxic else "")) for i in order] + [(20_000, "some nasty words"), (20_001, "words")])
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in order], "doc_id long, toxic int")
    by_id = {r.doc_id: r.score for r in toxicity.score(docs, labels).filter("doc_id >= 20000").collect()}
    assert by_id[20_000] > 0.5 > by_id[20_001]


def test_toxicity_averages_what_the_parts_learnt(spark, make, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(100)}" for _ in range(20)) + (f" nasty{i % 9}" if i % 3 == 0 else "")) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    stored = toxicity.labelled(make(rows), labels)
    assert stored.select("part").distinct().count() > 4
    assert stored.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(900))
    got = toxicity.score(make(rows), labels).withColumn("held", toxicity.fold() == 2).filter("held").collect()
    assert sum((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in got) > 0.95 * len(got)


def test_toxicity_shuffles_no_text(spark, make):
    rows = [(i, f"w{i} nasty" if i % 3 else None) for i in range(200)] + [(5, "w5 again"), (None, "word")]
    known = [i for i in range(200) if i % 4 and zlib.crc32(str(i).encode()) % 4 != 2]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200) if i % 4] + [(7777, 1), (None, 1)], "doc_id long, toxic int")
    found = toxicity.labelled_rows(make(rows), labels)
    assert found.count() == len(known) + (5 in known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    # Nothing is shuffled between the texts and what makes numbers of them.
    assert "Exchange" not in plan[plan.index("MapInPandas") : plan.index("Scan")]


def places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                found.append(i)
                labels.add(label)
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def test_license_phrases_and_notices(make):
    rows = [
        (0, None), (1, ""), (2, "MIT License mit\nLICENSE; the General  Public-License"), (3, "mit licensé mit license"),
        (4, "general public"), (5, "x Licensed under CC BY-NC 4.0. y"), (6, "the " * 50_000 + "mit license"),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
        (8, "licensed under the stars"), (2, "mit license"), (9, "mit"), (10, "mit mit license license"),
    ]
    got = licenses.scan(make(rows)).collect()
    expected = sorted((doc_id, *places(text)) for doc_id, text in rows)
    as_key = lambda row: tuple(-1 if x is None else x for x in row)
    assert sorted(map(as_key, (tuple(r)[:6] for r in got))) == sorted(map(as_key, expected))
    labels = {r.doc_id: r.labels for r in got}
    assert (labels[5], labels[7], labels[8]) == ("cc-by-nc", "mit", "")
    assert all(0 <= r.score <= 1 for r in got)
    assert licenses.scan(make([])).count() == 0


def test_automaton_gives_matching_statistics():
    rng = random.Random(3)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        automaton = licenses.Automaton(sequences, [0])
        text = [rng.randrange(4) for _ in range(30)]
        text = [t for t in text if t < 3]
        for i, (state, length) in enumerate(automaton.statistics(text)):
            best = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in parts))
            assert length == best
            ends = {(n, e) for n, s in enumerate(sequences) for e in range(best, len(s) + 1) if s[e - best : e] == text[i + 1 - best : i + 1]}
            if best:
                assert automaton.ends[state] == ends


def changes(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, version string, tokens long, sign int")


def test_token_rollup_is_idempotent(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    first = changes(spark, [("a", "en", "v1", 5, 1), ("a", "en", "v1", 7, 1), (None, None, "v1", 2, 1)])
    assert rollup.commit(1, first) and not rollup.commit(1, first)
    assert rollup.commit(2, changes(spark, [("a", "en", "v1", 5, -1), ("a", "en", "v2", 6, 1), (None, None, "v1", 2, -1)]))
    assert rollup.commit(3, changes(spark, []))
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert got == {("a", "en", "v1"): (1, 7), ("a", "en", "v2"): (1, 6), (None, None, "v1"): (0, 0)}


def test_batches_that_were_not_committed_do_not_count(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    one = changes(spark, [("a", "en", "v1", 5, 1)])
    for batch in (7, 3, 5, 4):
        assert rollup.commit(batch, one)
    # What a writer that was lost before its rename has left.
    one.write.parquet(str(tmp_path / "rollup" / "work-lost" / "totals"))
    one.write.parquet(str(tmp_path / "rollup" / "batch=9"))
    again = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert [again.commit(batch, one) for batch in (3, 4, 5, 7)] == [False] * 4
    assert [tuple(r)[3:] for r in again.totals().collect()] == [(4, 20)]
    ranges = again._table(4, "batches", token_counts.RANGES).collect()
    assert sorted(map(tuple, ranges)) == [(3, 5), (7, 7)]
    assert again.drop_old() == 2 and again.versions() == [3, 4] and again.totals().first()["n_tokens"] == 20


def test_two_writers_of_one_version_both_count(spark, tmp_path, monkeypatch):
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    other = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    one = changes(spark, [("a", "en", "v1", 5, 1)])
    publish, taken = rollup._publish, []

    def late(work, version):
        # Another writer takes the version first.
        if not taken:
            taken.append(other.commit(2, one))
        return publish(work, version)

    monkeypatch.setattr(rollup, "_publish", late)
    assert rollup.commit(1, one) and taken == [True]
    assert [tuple(r)[3:] for r in rollup.totals().collect()] == [(2, 10)]
    assert not rollup.commit(2, one)


@pytest.mark.parametrize("empty", [False, True])
def test_token_counts_query_by_brute_force(spark, tmp_path, empty):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    from docflow.llm import queries

    coders = {}
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(f"{token_counts.TOKENIZER_FOLDER}/{name}.tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        coders[name] = tiktoken.Encoding(name, pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [
        (1, "one text", "en", "a"), (2, "one text", "en", "b"), (2, "one text", "en", "b"), (3, "ein Text, où", "de", "a"),
        (4, "ein Text, où", "fr", None), (5, None, "de", "a"), (6, None, None, "a"), (7, "", "de", "a"), (7, "zwei", "de", "a"),
        (7, "one text", "de", "b"), (None, "zwei", "de", "a"), (8, "lang " * 20_000, "de", "c"), (9, "allein", None, None),
    ]
    rows = [] if empty else rows
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "-1 as tokens", "'x' as version")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    expected = {}

    def add(sign, name, text, lang, source):
        sums = expected.setdefault((source, lang, name), [0, 0])
        sums[0] += sign
        sums[1] += sign * (len(coders[name].encode_ordinary(text)) if text else 0)

    for doc_id, text, lang, source in rows:
        add(1, "byte_bpe_50k", text, lang, source)
        least = min((d for d, t, *_ in rows if t == text and d is not None), default=None)
        if text is not None and doc_id is not None and least is not None and doc_id != least:
            add(-1, "byte_bpe_50k", text, lang, source)
        elif lang not in (None, "en"):
            add(-1, "byte_bpe_50k", text, lang, source)
            add(1, "byte_bpe_multi_50k", text, lang, source)
    got = queries.op6_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang, r.version): [r.n_docs, r.n_tokens] for r in got} == expected and len(got) == len(expected)


def test_tokens_of_texts(spark, make):
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    path = f"{token_counts.TOKENIZER_FOLDER}/byte_bpe_50k.tiktoken"
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(0, None), (1, ""), (2, "it's <|endoftext|> 12"), (3, "été " * 30_000)]
    got = {r.doc_id: r.n for r in make(rows).select("doc_id", token_counts.tokens(path)("text").alias("n")).collect()}
    assert got == {d: len(coder.encode_ordinary(t)) if t else 0 for d, t in rows}


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_distance():
    rng = random.Random(2)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        assert decontamination.myers(pattern, text)[0] == edits(pattern, text)


@pytest.mark.parametrize("block_bytes", [1, 4 << 20])
def test_leaks_against_the_full_distance(spark, make, block_bytes):
    rng = random.Random(7)
    alphabet = "abcdefgh  "
    items = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(15, 150)))) for i in range(8)]
    items += [(20, None), (21, ""), (22, "..."), (23, items[0][1].upper())]
    rows = [(100, None), (101, ""), (102, "xyz"), (103, "q " * 50_000)]
    for doc_id in range(60):
        item = list(items[rng.randrange(8)][1])
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice(["", rng.choice(alphabet), rng.choice(alphabet) * 2])
        rows.append((doc_id, "start " + "".join(item) + " end " + "".join(rng.choice(alphabet) for _ in range(40))))
    got = decontamination.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    expected = {}
    for item_id, item in items:
        pattern = decontamination.normalise(item)
        pattern = pattern if len(pattern) < decontamination.SHORT else pattern.strip()
        for doc_id, text in rows:
            if pattern and text and doc_id != 103:
                distance = edits(pattern, decontamination.normalise(text))
                if distance <= len(pattern) // decontamination.BYTES_PER_ERROR:
                    expected[doc_id, item_id] = distance
    assert {(r.doc_id, r.item_id): r.distance for r in got.collect()} == expected
    kept = decontamination.without_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in expected}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(make(rows), none).count() == 0
    assert decontamination.without_leaks(make([]), none).count() == 0


def test_chains_reach_back_over_many_short_matches():
    # 70 matches that fit no chain lie between two that do, all in the allowed gap.
    between = [(10 + i % 5, 3, 0) for i in range(70)]
    assert licenses.Scanner._chain(sorted([(0, 10, 5), *between, (18, 10, 20)])) == 20


def longest_chain(parts):
    """Most words covered by a chain, by trying every subset in order."""
    best = 0
    for mask in range(1, 1 << len(parts)):
        chain = [p for i, p in enumerate(parts) if mask >> i & 1]
        fits = all(
            0 <= b[0] - (a[0] + a[1]) <= licenses.MAX_GAP and a[2] + a[1] <= b[2] for a, b in zip(chain, chain[1:])
        )
        best = max(best, sum(p[1] for p in chain) if fits else 0)
    return best


def test_license_chain_covers_as_much_as_any_chain():
    rng = random.Random(5)
    for _ in range(300):
        # Of one text and one template: as matches end at different words, so do the parts.
        ends = sorted(rng.sample(range(6, 60), rng.randrange(1, 9)))
        parts = sorted((end - n, n, rng.randrange(30)) for end in ends for n in [rng.randrange(3, 7)])
        parts.sort(key=lambda p: p[0] + p[1])
        if any(a[0] > b[0] for a, b in zip(parts, parts[1:])):
            continue
        assert licenses.Scanner._chain(sorted(parts)) == longest_chain(sorted(parts))
