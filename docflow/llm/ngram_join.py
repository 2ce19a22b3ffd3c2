"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Equal
   sets form a class with one representative.
2. The incidence of representatives by shingles is cut into blocks of columns.
   By the size bound only the first n - ceil(t n) + 1 shingles of a set of n,
   in one order for all sets, need to be in it: two sets within the threshold
   t share one of them. The order is by how often a shingle's hash bucket
   occurs in the corpus, rarest first, so that frequent passages stay out.
3. Rows that share a column and whose sizes allow a link are compared by their
   sketches, the parities of a set's members in classes: two sets differ in at
   least as many members as their sketches in bits, so no link is lost. Columns
   of few rows give pairs, each of which is compared once; in the others rows
   are reached from one another, in a long column within bands of sizes. What may
   be linked makes clusters, outside of which no link exists. Pairs and sketches
   are held by the MB, whatever the number of pairs of a block.
4. In a cluster the product of whole rows is taken in tiles of about
   ``TILE_SHINGLES`` entries a side: one row at a time is multiplied with those
   not yet reached, overlaps are accumulated, pairs below the bound of their
   sizes are discarded, and what is linked is reached next. So the links of a
   tile come out as a spanning forest, never as all pairs of a group of copies.

Defined results: a text without words (or null) has an empty set, is linked
with nothing and is its own component; rows of one doc_id are one node; a null
doc_id is its own component, null. Extra columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm import words
from docflow.llm.graph import components
from docflow.session import materialize, release_finished

COUNT_BITS = 18
COUNT_PARTS = 64
BLOCK_ENTRIES = 1 << 20
TILE_SHINGLES = 1 << 20
# Classes of a sketch; larger sets have a wide one too.
SKETCH_BITS = 1024
WIDE_BITS = 16384
WIDE_FROM = 1500
# Columns of up to so many rows give pairs.
FEW_ROWS = 32
# Columns of more rows are dealt out by size.
BAND_ROWS = 4096
# Pairs that a task holds before it passes them on.
HELD_PAIRS = 1 << 20
BIN_BYTES = 8 << 20


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of the corpus fall in each of 2^18 hash buckets: 1 MB at any size."""
    size = 1 << COUNT_BITS
    step = size // COUNT_PARTS

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for part in parts:
            for _, group in words.chunks(part["text"].tolist()):
                hashes, _, _, bounds = words.words(group)
                found, _ = words.shingles(hashes, bounds)
                total += np.bincount((found >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=size)
        if total.any():
            total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
            yield pd.DataFrame(
                {"part": range(COUNT_PARTS), "counts": [total[i * step : (i + 1) * step].tobytes() for i in range(COUNT_PARTS)]}
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in rows["counts"])
        total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [total.tobytes()]})

    schema = "part int, counts binary"
    table = docs.select("text").mapInPandas(count, schema).groupBy("part").applyInPandas(add, schema)
    counts = np.zeros(size, np.uint32)
    for row in table.collect():
        counts[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["counts"], np.uint32)
    return counts


def parities(members: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of members in each of ``bits`` classes, as 64-bit values."""
    counts = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def feature_rows(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """doc_id, size of the set, its signature, its first shingles, and its sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    names = ["n", "sign", "sign2", "first", "sketch", "wide"]

    @F.pandas_udf("n long, sign long, sign2 long, first binary, sketch array<bigint>, wide array<bigint>")
    def features(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common = shared.value
        for part in parts:
            rows = []
            for _, group in words.chunks(part.tolist()):
                hashes, _, _, bounds = words.words(group)
                found, at = words.shingles(hashes, bounds)
                for i in range(len(group)):
                    own = np.unique(found[at[i] : at[i + 1]])
                    n = len(own)
                    keep = n - (percent * n + 99) // 100 + 1 if n else 0
                    order = np.argsort(common[own >> np.uint64(64 - COUNT_BITS)], kind="stable")[:keep]
                    sketches = parities(own, SKETCH_BITS), parities(own, WIDE_BITS) if n > WIDE_FROM else None
                    signs = own.sum(dtype=np.uint64), np.bitwise_xor.reduce(words.mix(own ^ np.uint64(n)))
                    rows.append((n, *(int(np.int64(s)) if s < 1 << 63 else int(s) - (1 << 64) for s in map(int, signs)), own[order].tobytes(), *sketches))
            yield pd.DataFrame(rows, columns=names)

    # Texts alone go to Python: a null among the ids would turn them into doubles there.
    return docs.select("doc_id", features("text").alias("_found")).select("doc_id", "_found.*")


def in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """The incidence as (block, entries): blocks of columns, packed by batch of rows."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            columns = [np.frombuffer(f, np.uint64) for f in part["first"]]
            lengths = [len(c) for c in columns]
            if not sum(lengths):
                continue
            found = np.concatenate(columns)
            block = (found % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            column = (found >> np.uint64(32)).astype(np.uint32)[order]
            row = np.repeat(part["rep"].to_numpy(np.int64), lengths)[order]
            size = np.repeat(part["n"].to_numpy(np.int64), lengths).astype(np.uint32)[order]
            used, starts = np.unique(block[order], return_index=True)
            ends = [*starts[1:], len(order)]
            yield pd.DataFrame(
                {
                    "block": used,
                    "entries": [b"".join(x[s:e].tobytes() for x in (row, column, size)) for s, e in zip(starts, ends)],
                }
            )

    return rows.mapInPandas(cut, "block long, entries binary")


def size_bands(run: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and a part of their run for each: rows whose sizes allow a link are in one part together.

    A part has the rows of two neighbouring bands of sizes, of which each is as wide as the bound.
    """
    edges = [1]
    while edges[-1] <= size.max(initial=0):
        edges.append(edges[-1] * 100 // percent + 1)
    step = len(edges) + 2
    band = run * step + np.searchsorted(edges, size, side="right")
    full = np.unique(band)
    # The part of a band and the next, unless the part before has all its rows.
    full = full[np.isin(full + 1, full) | ~np.isin(full - 1, full)]
    own, before = np.flatnonzero(np.isin(band, full)), np.flatnonzero(np.isin(band - 1, full))
    return np.concatenate([own, before]), np.concatenate([band[own], band[before] - 1])


def candidates(percent: int, blocks: int):
    """For each block: pairs (a, b) from columns of few rows, members (a, run) of the others.

    They are packed by groups of a: the same pair comes from many blocks.
    """

    def packed(a: np.ndarray, b: np.ndarray, run: np.ndarray) -> pd.DataFrame:
        made = np.stack([a, b, run], 1).astype(np.int64)
        group = (words.mix(made[:, 0].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        used, starts = np.unique(group[order], return_index=True)
        ends = [*starts[1:], len(order)]
        return pd.DataFrame({"rows": used, "packed": [made[order[s:e]].tobytes() for s, e in zip(starts, ends)]})

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, block = [], 0
        for part in parts:
            pieces += [(e, len(e) // 16) for e in part["entries"]]
            block = int(part["block"].iloc[0])
        row = np.concatenate([np.frombuffer(e, np.int64, m) for e, m in pieces])
        column = np.concatenate([np.frombuffer(e, np.uint32, m, 8 * m) for e, m in pieces])
        size = np.concatenate([np.frombuffer(e, np.uint32, m, 12 * m) for e, m in pieces]).astype(np.int64)
        del pieces
        order = np.lexsort((size, column))
        row, column, size = row[order], column[order], size[order]
        # Only rows with a neighbour that their size allows; columns split where none is.
        near = (column[1:] == column[:-1]) & (100 * size[:-1] >= percent * size[1:])
        run = np.concatenate([[0], np.cumsum(~near)]) if len(row) else np.zeros(0, np.int64)
        rows_of = np.bincount(run)[run] if len(row) else run
        few = (rows_of > 1) & (rows_of <= FEW_ROWS)
        # A pair as one number, from the places of its rows among all; never all pairs at once.
        ids, place = np.unique(row[few], return_inverse=True)
        o, s = run[few], size[few]
        held, count = [np.zeros(0, np.int64)], 0
        for apart in range(1, FEW_ROWS):
            pair = (o[apart:] == o[:-apart]) & (100 * s[:-apart] >= percent * s[apart:]) & (place[apart:] != place[:-apart])
            if not pair.any():
                break
            x, y = place[:-apart][pair], place[apart:][pair]
            held.append(np.minimum(x, y) * len(ids) + np.maximum(x, y))
            count += len(x)
            if count > HELD_PAIRS:
                held = [np.unique(np.concatenate(held))]
                count = len(held[0])
                if 2 * count > HELD_PAIRS:
                    yield packed(ids[held[0] // len(ids)], ids[held[0] % len(ids)], np.full(count, -1))
                    held, count = held[:0], 0
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *held]))
        if len(pairs):
            yield packed(ids[pairs // len(ids)], ids[pairs % len(ids)], np.full(len(pairs), -1))
        del held, pairs, ids, place, o, s
        members, part_of = np.flatnonzero((rows_of > FEW_ROWS) & (rows_of <= BAND_ROWS)), None
        long = np.flatnonzero((rows_of > FEW_ROWS) & (rows_of > BAND_ROWS))
        at, part_of = size_bands(run[long], size[long], percent)
        # Numbers of runs, and behind them those of parts.
        _, part_of, rows_in = np.unique(part_of, return_inverse=True, return_counts=True)
        at, part_of = at[rows_in[part_of] > 1], part_of[rows_in[part_of] > 1]
        members, runs = np.concatenate([members, long[at]]), np.concatenate([run[members], part_of + len(row)])
        for i in range(0, len(members), HELD_PAIRS):
            a = row[members[i : i + HELD_PAIRS]]
            yield packed(a, a, (block << 32) + runs[i : i + HELD_PAIRS])

    return find


def unique_rows(made: np.ndarray) -> np.ndarray:
    made = made[np.lexsort(made.T[::-1])]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]).any(1)
    return made[new]


def distinct_rows():
    """The pairs and members of a group, each once; those that come again are dropped as they are read."""

    def distinct(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, count = np.zeros((0, 3), np.int64), [], 0
        for part in parts:
            for data in part["packed"]:
                waiting.append(np.frombuffer(data, np.int64).reshape(-1, 3))
                count += len(waiting[-1])
                if count > max(HELD_PAIRS, len(held)):
                    held = unique_rows(np.concatenate([held, *waiting]))
                    waiting, count = [], 0
        held = unique_rows(np.concatenate([held, *waiting]))
        for i in range(0, len(held), HELD_PAIRS):
            yield pd.DataFrame(held[i : i + HELD_PAIRS], columns=["a", "b", "run"])

    return distinct


def may_link(percent: int):
    """For the members of columns: each with the one from which its sketch is reached."""

    def within(sketches: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        bits = np.bitwise_count(sketches ^ own).sum(1, dtype=np.int64)
        return (100 + percent) * bits <= (100 - percent) * sizes

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in part.groupby("run", sort=False):
            ids, sizes = rows["a"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
            sketches = np.stack(rows["sketch"].to_list()).view(np.uint64)
            # Wide sketches tell large sets apart; a set of another size is never linked.
            has_wide = rows["wide"].notna().to_numpy()
            wide = np.stack(rows["wide"][has_wide].to_list()).view(np.uint64) if has_wide.any() else sketches
            place = np.cumsum(has_wide) - 1
            alive = np.arange(len(ids))
            while len(alive):
                waiting, alive = [alive[0]], alive[1:]
                while waiting and len(alive):
                    u = waiting.pop()
                    n = sizes[alive]
                    hit = 100 * np.minimum(n, sizes[u]) >= percent * np.maximum(n, sizes[u])
                    hit[hit] = within(sketches[alive[hit]], sketches[u], n[hit] + sizes[u])
                    if has_wide[u]:
                        both = np.flatnonzero(hit & has_wide[alive])
                        hit[both] = within(wide[place[alive[both]]], wide[place[u]], n[both] + sizes[u])
                    out.extend((ids[u], ids[v]) for v in alive[hit])
                    waiting.extend(alive[hit])
                    alive = alive[~hit]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return walk


def reach(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Per set the place of the first set of its component, by products with one row each."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    root = np.full(len(sets), -1, np.int64)
    alive = np.arange(len(sets))
    columns, starts = flat, offsets[:-1]
    while len(alive):
        first = int(alive[0])
        root[first] = first
        waiting = [first]
        drop = np.zeros(len(alive), bool)
        drop[0] = True
        while True:
            if drop.any():
                kept = ~drop
                columns = columns[np.repeat(kept, sizes[alive])]
                alive = alive[kept]
                starts = np.concatenate([[0], np.cumsum(sizes[alive])])[:-1].astype(np.int64)
            if not waiting or not len(alive):
                break
            u = waiting.pop()
            own = flat[offsets[u] : offsets[u + 1]]
            mark[own] = 1
            overlap = np.add.reduceat(mark[columns], starts)
            mark[own] = 0
            drop = 100 * overlap >= percent * (sizes[u] + sizes[alive] - overlap)
            found = alive[drop]
            root[found] = first
            waiting.extend(found.tolist())
    return root


def linked(percent: int):
    """Links of the tiles in a bin, each node to the first node of its component."""

    def link(part: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, tile in part.groupby(["cluster", "i", "j"], sort=False):
            sets = []
            for _, group in words.chunks(tile["text"].tolist()):
                hashes, _, _, bounds = words.words(group)
                found, at = words.shingles(hashes, bounds)
                sets.extend(np.unique(found[at[k] : at[k + 1]]) for k in range(len(group)))
            ids = tile["doc_id"].to_numpy(np.int64)
            full = [k for k, s in enumerate(sets) if len(s)]
            if len(full) < 2:
                continue
            ids = ids[full]
            out_a.append(ids)
            out_b.append(ids[reach([sets[k] for k in full], percent)])
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return link


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    words.small_batches(docs.sparkSession)
    rows = materialize(feature_rows(docs, bucket_counts(docs), percent), "features")
    classes = materialize(
        rows.filter("n > 0 and doc_id is not null")
        .groupBy("sign", "sign2", "n")
        .agg(F.min("doc_id").alias("rep"), F.first("first").alias("first"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")),
        "classes",
    )
    entries = classes.agg(F.sum(F.octet_length("first") / 8)).first()[0] or 0
    blocks = int(entries // BLOCK_ENTRIES) + 1
    found = materialize(
        in_blocks(classes.select("rep", "n", "first"), blocks)
        .groupBy("block")
        .applyInPandas(candidates(percent, blocks), "rows long, packed binary")
        .groupBy("rows")
        .applyInPandas(distinct_rows(), "a long, b long, run long"),
        "candidates",
    )
    release_finished(docs.sparkSession)
    sketches = classes.select("rep", "n", "sketch", "wide")
    differing = "aggregate(zip_with({0}_a, {0}_b, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)"

    def within(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that this sketch does not rule out."""
        for side in "ab":
            pairs = pairs.join(sketches.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col(name).alias(f"{name}_{side}")), side)
        bits = F.expr(differing.format(name))
        return pairs.filter(bits * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b")

    # Wide sketches travel with what is left by the others only.
    close = materialize(within(found.filter("run < 0").select("a", "b"), "sketch"), "close")
    large = F.least("n_a", "n_b") > WIDE_FROM
    pairs = close.filter(~large).union(within(close.filter(large).select("a", "b"), "wide")).select("a", "b")
    members = found.filter("run >= 0").select("a", "run")
    # What a task gets of the sketches is bounded in bytes: of large sets they are many times longer.
    length = F.when(F.col("n") > WIDE_FROM, (SKETCH_BITS + WIDE_BITS) // 8).otherwise(SKETCH_BITS // 8)
    weight = members.join(sketches.select(F.col("rep").alias("a"), "n"), "a").agg(F.sum(length)).first()[0] or 0
    reached = (
        members.join(sketches.withColumnRenamed("rep", "a"), "a")
        .withColumn("_bin", F.expr(f"pmod(xxhash64(run), {blocks * 4 + weight // BIN_BYTES})"))
        .groupBy("_bin")
        .applyInPandas(may_link(percent), "a long, b long")
    )
    edges = pairs.union(reached)
    clusters = components(edges)
    sizes = (
        clusters.join(sketches.select("rep", "n"), F.col("id") == F.col("rep"))
        .groupBy("root")
        .agg(F.sum("n").alias("_entries"))
    )
    placed = (
        clusters.join(sizes, "root")
        .withColumn("_parts", F.ceil(F.col("_entries") / TILE_SHINGLES).cast("int"))
        .withColumn("_part", F.expr("cast(pmod(xxhash64(id), _parts) as int)"))
        # Every part meets every other part of its cluster in one tile.
        .withColumn("_other", F.explode(F.expr("sequence(0, _parts - 1)")))
        .select(
            F.col("id").alias("doc_id"),
            F.col("root").alias("cluster"),
            F.least("_part", "_other").alias("i"),
            F.greatest("_part", "_other").alias("j"),
            (F.col("_parts") > 1).alias("_alone"),
        )
    )
    tiles = materialize(placed.join(docs, "doc_id"), "tiles")
    bytes_ = tiles.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bins = int(bytes_ // BIN_BYTES) + 1
    links = (
        # A tile of a large cluster fills a bin by itself.
        tiles.withColumn("_bin", F.expr(f"xxhash64(cluster, i, j) % if(_alone, {1 << 62}, {bins})"))
        .groupBy("_bin")
        .applyInPandas(linked(percent), "a long, b long")
    )
    found = components(links).withColumnRenamed("root", "_found")
    by_class = classes.join(found, F.col("rep") == F.col("id"), "left").select(
        "sign", "sign2", "n", F.coalesce("_found", "rep").alias("_root")
    )
    return rows.join(by_class, ["sign", "sign2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id")).alias("component_id")
    )


def without_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns.

    Here every row is a node of its own, so of repeated rows and of equal texts without an id one
    stays too; a null doc_id comes last. ``docs`` is read several times and must give the same rows in
    the same partitions, as a stored table does.
    """
    keyed = docs.withColumn("_row_key", F.monotonically_increasing_id())
    found = jaccard_components(keyed.select(F.col("_row_key").alias("doc_id"), "text"), percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row_key")).alias("_least")
    first = (
        keyed.select("_row_key", "doc_id")
        .join(found.select(F.col("doc_id").alias("_row_key"), "component_id"), "_row_key")
        .groupBy("component_id")
        .agg(least)
        .select("_least._row_key")
    )
    return keyed.join(first, "_row_key", "left_semi").select(*docs.columns)
