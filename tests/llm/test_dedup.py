"""Exact, near-equal and substring deduplication against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docflow.llm import compact_windows, exact_dedup, graph, ngram_join, suffix_dedup
from docflow.llm.suffix_sort import suffix_array

LOWER = {i: i + 32 for i in range(65, 91)}


def stored(df, tmp_path, parts=3):
    path = str(tmp_path / "docs")
    df.repartition(parts).write.parquet(path)
    return path


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# -- exact -------------------------------------------------------------------

TEXTS = [(0, "a b"), (1, "ab"), (2, " a\tb \n"), (3, None), (4, ""), (5, " "), (6, "x" * 200_000), (7, "x" * 200_000), (8, "é"), (9, "a b")]


def exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    return {
        doc_id: (min(group)[1], len(group), min(group)[1] == doc_id, hashlib.sha256(norm.encode()).hexdigest())
        for norm, group in groups.items()
        for _, doc_id in group
    }


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.substring(F.sha2(text, 256), 1, 1)])
def test_exact_dedup_even_with_a_weak_digest(spark, make, tmp_path, digest):
    path = stored(make(TEXTS), tmp_path)
    got = exact_dedup.exact_dedup(spark, path, digest, max_bytes=1).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == exact(TEXTS)


def test_exact_dedup_keeps_one_of_fully_equal_rows(spark, make, tmp_path):
    got = exact_dedup.exact_dedup(spark, stored(make([(1, "a"), (1, "a"), (None, "a"), (None, "b")]), tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.kept, r.group_size) for r in got) == [(-1, False, 3), (-1, True, 1), (1, False, 3), (1, True, 3)]
    empty = exact_dedup.exact_dedup(spark, stored(make([]), tmp_path / "empty", 1))
    assert empty.count() == 0


# -- components --------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.root for r in got} == root and len(got) == len(root)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- near-equal --------------------------------------------------------------


def jaccard(rows):
    sets = {}
    for doc_id, text in rows:
        w = split(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {d: (len(sets[d]), root[d]) for d in sets}


def near_copies(seed, count):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(50)}" for _ in range(rng.choice([4, 5, 40, 120]))] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a"), (5, "word " * 20_000), (6, "word " * 20_001)]
    for doc_id in range(7, count):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(9)}"
        rows.append((doc_id, " ".join(own) + ("" if rng.random() < 0.7 else " end of it")))
    return rows


@pytest.mark.parametrize("few,tile", [(32, 1 << 20), (1, 400)])
def test_jaccard_components(make, monkeypatch, few, tile):
    monkeypatch.setattr(ngram_join, "FEW_ROWS", few)
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", tile)
    rows = near_copies(3, 70)
    got = ngram_join.jaccard_components(make(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard(rows)
    assert len(got) == len(rows)


def test_jaccard_with_few_pairs_held_and_long_columns_in_bands(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW_ROWS", 3)
    monkeypatch.setattr(ngram_join, "BAND_ROWS", 5)
    monkeypatch.setattr(ngram_join, "HELD_PAIRS", 10)
    rows = near_copies(13, 70)
    got = ngram_join.jaccard_components(make(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard(rows)


def test_pairs_of_a_block_are_passed_on_a_few_at_a_time(monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(ngram_join, "HELD_PAIRS", 1000)
    # 100 groups of 32 rows that share 3 columns each: 49,600 pairs.
    row, column = (x.ravel() for x in np.meshgrid(np.arange(3200), np.arange(3), indexing="ij"))
    column = (row // 32 * 3 + column).astype(np.uint32)
    entries = row.astype(np.int64).tobytes() + column.tobytes() + np.full(len(row), 50, np.uint32).tobytes()
    found = list(ngram_join.candidates(80, 4)(iter([pd.DataFrame({"block": [7], "entries": [entries]})])))
    parts = [np.frombuffer(data, np.int64).reshape(-1, 3) for frame in found for data in frame["packed"]]
    assert max(sum(len(data) for data in frame["packed"]) for frame in found) <= 24 * (1000 + len(row))
    pairs = {(a, b) for a, b, run in np.concatenate(parts).tolist() if run == -1}
    assert pairs == {(a, b) for a in range(3200) for b in range(a + 1, a // 32 * 32 + 32)}
    packed = [pd.DataFrame({"packed": [data]}) for frame in found + found for data in frame["packed"]]
    assert sum(map(len, ngram_join.distinct_rows()(iter(packed)))) == len(pairs)


def test_sets_of_a_column_are_told_apart_whatever_their_sizes():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(14)
    rows = []
    for i, n in enumerate((200, 2400, 2500, 4000, 4700, 4800)):
        own = rng.integers(0, 1 << 63, n).astype(np.uint64)
        sets = [own] if i else [own, np.concatenate([own[:-1], own[:1] + np.uint64(1)])]
        for members in sets:
            wide = ngram_join.parities(members, ngram_join.WIDE_BITS) if n > ngram_join.WIDE_FROM else None
            rows.append((len(rows), 1, n, ngram_join.parities(members, ngram_join.SKETCH_BITS), wide))
    part = pd.DataFrame(rows, columns=["a", "run", "n", "sketch", "wide"])
    got = ngram_join.may_link(80)(part)
    assert list(zip(got["a"], got["b"])) == [(0, 1)]


def test_rows_whose_sizes_allow_a_link_share_a_part():
    import numpy as np

    rng = np.random.default_rng(15)
    for percent in (50, 80, 100):
        run, size = rng.integers(0, 3, 300), rng.integers(1, 60, 300)
        at, part = ngram_join.size_bands(run, size, percent)
        parts = {}
        for i, p in zip(at.tolist(), part.tolist()):
            parts.setdefault(p, set()).add(i)
        shared = {(i, j) for rows in parts.values() for i in rows for j in rows}
        assert all(run[i] == run[j] for i, j in shared)
        assert all(
            (i, j) in shared for i in range(300) for j in range(300)
            if run[i] == run[j] and size[i] <= size[j] and 100 * size[i] >= percent * size[j]
        )


def test_jaccard_of_nothing_and_of_repeated_rows(make):
    assert ngram_join.jaccard_components(make([])).count() == 0
    got = ngram_join.jaccard_components(make([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]


# -- suffix array ------------------------------------------------------------


def test_suffix_array_of_random_strings():
    rng = random.Random(4)
    for _ in range(500):
        data = bytes(rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(60)))
        assert suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])


def removed(rows):
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], doc_id)
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < doc_id:
                gone[i : i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("sizes", [(24 << 20, 2 << 20), (2000, 3000)])
def test_repeated_bytes_are_removed(make, monkeypatch, sizes):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(suffix_dedup, "BIN_BYTES", sizes[1])
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é") for _ in range(300)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a" * 5000), (3, "a" * 120), (4, "short"), (5, base[0]), (6, base[0])]
    for doc_id in range(7, 60):
        text = ""
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(250)
            text += base[rng.randrange(6)][at : at + rng.randrange(30, 140)] if rng.random() < 0.7 else "".join(
                rng.choice("ab é") for _ in range(rng.randrange(60))
            )
        rows.append((doc_id, text))
    got = suffix_dedup.remove_repeated(make(rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == removed(rows)


def test_repeated_bytes_of_nothing_and_of_repeated_rows(make):
    assert suffix_dedup.remove_repeated(make([])).count() == 0
    got = suffix_dedup.remove_repeated(make([(1, "x" * 60), (1, "x" * 60), (None, "x" * 60), (2, "x" * 60)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 0), (1, 0), (2, 60)]


# -- passages ----------------------------------------------------------------


def test_tree_windows_are_the_nodes_of_the_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(100):
        n, least = int(rng.integers(1, 80)), int(rng.integers(1, 8))
        values = rng.integers(0, 1 << 63, n).astype(np.uint64)
        expected = set()
        for c in range(n):
            a = b = c
            while a > 0 and values[a - 1] > values[c]:
                a -= 1
            while b < n - 1 and values[b + 1] > values[c]:
                b += 1
            if b - a + 1 >= least:
                expected.add((c, a, b))
        got = compact_windows.tree_windows(values, least)
        assert set(zip(*(x.tolist() for x in got))) == expected


def test_passages_of_fifty_words_are_found_and_clean_texts_are_not(make):
    rng = random.Random(6)

    def fresh(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    passage, other = fresh(60), fresh(49)
    rows = [(0, None), (1, ""), (2, " ".join(fresh(500)))]
    rows += [(10 + i, " ".join(fresh(rng.randrange(80)) + passage + fresh(rng.randrange(80)))) for i in range(8)]
    # One word of sixty changed: similarity 51/61 at the least. Min-hashes find most of them.
    edited = {30 + i: " ".join(fresh(20) + passage[: 5 * i + 6] + ["changed"] + passage[5 * i + 7 :] + fresh(30)) for i in range(8)}
    rows += list(edited.items())
    rows += [(40 + i, " ".join(fresh(70) + other + fresh(70))) for i in range(3)]
    rows += [(50, rows[2][1]), (50, rows[2][1]), (51, "short one"), (52, "short one")]
    got = compact_windows.near_duplicate_passages(make(rows)).collect()
    caught = {r.doc_id for r in got} | {r.other_id for r in got}
    assert caught - set(edited) == {2, 50, *range(10, 18)}
    assert len(caught & set(edited)) >= 6
    assert all(r.other_id < r.doc_id and r.similarity >= 0.8 for r in got)
    assert compact_windows.near_duplicate_passages(make([])).count() == 0


def test_passages_around_a_common_line_are_linked_to_each_other(make):
    rng = random.Random(7)

    def fresh(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    line = fresh(30)
    rows = [(i, " ".join(fresh(60) + line + fresh(60))) for i in range(20)]
    for i in range(20):
        passage = fresh(15) + line + fresh(15)
        rows += [(100 + i + 50 * k, " ".join(fresh(40) + passage + fresh(40))) for k in range(2)]
    got = compact_windows.near_duplicate_passages(make(rows)).collect()
    assert {(r.other_id, r.doc_id) for r in got} == {(100 + i, 150 + i) for i in range(20)}


def test_near_passages_around_a_common_line_are_linked_to_each_other(make):
    """Not only to the first of those that have the line, which is near none of them."""
    rng = random.Random(18)

    def fresh(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    line = fresh(36)
    rows = [(i, " ".join(fresh(60) + line + fresh(60))) for i in range(5)]
    for i in range(60):
        before, behind = fresh(12), fresh(8)
        rows.append((100 + i, " ".join(fresh(40) + before + line + behind + fresh(40))))
        before[8] = f"c{i}"
        rows.append((200 + i, " ".join(fresh(40) + before + line + behind + fresh(40))))
    got = compact_windows.near_duplicate_passages(make(rows)).collect()
    assert {(r.other_id, r.doc_id) for r in got} == {(100 + i, 200 + i) for i in range(60)}


def test_rows_of_a_class_are_linked_to_the_nearest():
    import numpy as np

    rng = np.random.default_rng(18)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        sketch = rng.integers(0, 1 << 12, (1, n)).astype(np.uint64)
        ends, others = (x[0].tolist() for x in compact_windows.nearest_trees(sketch))
        apart = np.bitwise_count(sketch[0][:, None] ^ sketch[0])
        # Least spanning tree, by Kruskal.
        root, total = list(range(n)), 0
        for d, i, j in sorted((int(apart[i, j]), i, j) for i in range(n) for j in range(i)):
            if root[i] != root[j]:
                total += d
                root = [root[j] if x == root[i] else x for x in root]
        assert sum(int(apart[i, j]) for i, j in zip(ends, others)) == total
        assert sorted(others) == list(range(1, n))
    # Class, document, place and parities: the first is far from two that are near each other; a class of its own; one document twice.
    rows = [(7, 1, 0, 0), (7, 2, 5, 0xFFFF00), (7, 3, 6, 0xFFFF01), (8, 4, 0, 1), (9, 5, 0, 1), (9, 5, 8, 1)]
    key, doc, begin, sketch = (np.array(x) for x in zip(*rows))
    a, b = compact_windows.linked_rows(key.astype(np.uint32), doc, begin, sketch.astype(np.uint64))
    assert sorted(zip(doc[a].tolist(), doc[b].tolist())) == [(1, 2), (2, 3)]


def test_each_passage_of_a_pair_is_found(make):
    rng = random.Random(8)

    def fresh(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    rows, places = [], {}
    for i in range(12):
        one, two, between = fresh(60), fresh(55), (25, 40, 60)[i % 3]
        rows += [(2 * i + k, " ".join(fresh(30) + one + fresh(between) + two + fresh(30))) for k in range(2)]
        places[2 * i + 1] = {(30, 89), (90 + between, 144 + between)}
    got = {}
    for r in compact_windows.near_duplicate_passages(make(rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.first_word, r.last_word))
        assert (r.first_word, r.last_word) == (r.other_first, r.other_last)
    assert got == places


def test_every_text_of_a_doc_id_is_compared(make):
    rng = random.Random(9)

    def fresh(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    one, two = fresh(70), fresh(70)
    rows = [(1, " ".join(fresh(20) + one)), (2, " ".join(fresh(20) + two)), (3, " ".join(fresh(20) + one)), (3, " ".join(fresh(20) + two))]
    got = compact_windows.near_duplicate_passages(make(rows + rows[:1])).collect()
    assert {(r.other_id, r.doc_id, r.first_word, r.last_word) for r in got} == {(1, 3, 20, 89), (2, 3, 20, 89)}


def test_passages_agree_with_brute_force(make):
    """Documents that share a passage are connected; links of equal passages are never lost, nine in ten of edited ones are found."""
    rng = random.Random(10)

    def fresh(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    passages = [fresh(rng.randrange(55, 120)) for _ in range(12)]
    texts, near = {}, {}
    for i in range(120):
        kind = i % 12
        passage = list(passages[kind])
        if i >= 84:
            # One word in sixty or fewer.
            for place in rng.sample(range(len(passage)), len(passage) // 60 or 1):
                passage[place] = f"changed{i}"
        texts[i] = fresh(rng.randrange(40)) + passage + fresh(rng.randrange(40))
    shingles = {i: {tuple(t[j : j + 5]) for j in range(len(t) - 4)} for i, t in texts.items()}
    for i in texts:
        near[i] = {j for j in range(i) if len(shingles[i] & shingles[j]) >= 46}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    rows += [(1000 + i, " ".join(fresh(200))) for i in range(20)]
    got = compact_windows.near_duplicate_passages(make(rows)).collect()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in got:
        assert r.other_id in near[r.doc_id]
        a, b = texts[r.doc_id][r.first_word : r.last_word + 1], texts[r.other_id][r.other_first : r.other_last + 1]
        a, b = ({tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in (a, b))
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 and r.similarity >= 0.8
        one, other = find(r.doc_id), find(r.other_id)
        root[max(one, other)] = min(one, other)
    assert all(find(i) == i % 12 for i in range(84))
    assert sum(find(i) == i % 12 for i in range(84, 120)) >= 0.9 * 36
