"""Phrase collocation mining with Rabin-Karp fingerprints.

A phrase is a run of 2 to ``LONGEST`` words inside one piece of a text, pieces
ending at punctuation and line ends; words are lower-cased in A-Z. Everything is
counted per language.

Tasks hash the words of a MB of text and have the fingerprints of all runs of k
words as differences of one polynomial prefix sum. A phrase can only be frequent if the
runs inside it are, so the lengths are counted one after the other: a task sums up the
fingerprints of those runs whose parts are marked in a bitmap of the frequent ones, a
shuffle adds them, and what reaches the least count marks the next bitmap. A bitmap has
``FILTER_BITS`` bits whatever the input; a fingerprint or a bit that two phrases share
only lets more runs through.

The last pass verifies against the text: runs marked in the bitmaps are compared word by
word, by exact numbers, with the first of their fingerprint, and those that differ are
set apart. A shuffle brings the runs of a bucket of fingerprints together with a pointer
(document and place of an occurrence), and they are added up by the words themselves. Only
these runs are ever made into strings; the buckets grow in number with the corpus. Scores
are computed from the exact counts in decimal arithmetic.

Defined results: a null text is empty, a null language ``und``; a row counts as
often as it stands in ``docs``; a null doc_id gives pointers without document;
other columns are not read. No document or no frequent phrase gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm import words
from docflow.session import materialize

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
NO_LANG = "und"
FILTER_BITS = 26
# Fingerprints a task adds up before it passes them on.
HELD = 1 << 21
# Fingerprints it passes on at a time.
PASSED = 1 << 16
# Different runs a task holds in the last pass.
HELD_RUNS = 1 << 19
# Bytes of text whose marked runs meet in one bucket of the last shuffle.
BUCKET_BYTES = 16 << 20
# Bytes after which a piece ends; words are separated by these, space and tab.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
GAPS = ENDS.copy()
GAPS[[9, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BUCKET_BITS = 15  # bits of one bucket of Spark's bitmap functions


class Words:
    """The words of some texts of one language: hashes, pieces and prefix sums."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.hashes, self.starts, self.ends, bounds = words.words(texts, GAPS)
        self.first = bounds[:-1]
        self.n = len(self.hashes)
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        # Both rise from word to word, so the sum is equal only within a piece.
        self.piece = np.cumsum(ENDS[self.data])[self.starts] + text
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        powers, self.inverse = _powers(self.n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * powers[: self.n], dtype=np.uint64)])

    def dictionary(self) -> tuple[np.ndarray, pa.Array]:
        """Exact number of every word, and the words."""
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int32)
        letters = self.data[~GAPS[self.data]].tobytes()
        coded = pa.Array.from_buffers(
            pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
        ).dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary

    def prints(self, k: int) -> np.ndarray:
        """Fingerprint of the k words from every place that has so many behind it."""
        m = max(0, self.n - k + 1)
        return words.mix((self.sums[k : k + m] - self.sums[:m]) * self.inverse[:m] + self.seed + np.uint64(k))

    def whole(self, k: int) -> np.ndarray:
        """Whether the k words from each of these places are in one piece."""
        m = max(0, self.n - k + 1)
        return self.piece[k - 1 : k - 1 + m] == self.piece[:m]


_STORED_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _STORED_POWERS or len(_STORED_POWERS[0]) < n + 1:
        size = max(n, words.CHUNK_BYTES // 2)
        _STORED_POWERS[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)])
            for base in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _STORED_POWERS[0], _STORED_POWERS[1]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], pa.Array]]:
    """Texts of one language in groups of about a MB, with their doc_ids."""
    for batch in batches:
        ids, texts, langs = (batch.column(name) for name in ("doc_id", "text", "lang"))
        langs = langs.to_pylist()
        places: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            places.setdefault(NO_LANG if lang is None else lang, []).append(i)
        for lang, own in places.items():
            part, size = [], 0
            for i in own:
                part.append(i)
                size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
                if size >= words.CHUNK_BYTES or i == own[-1]:
                    group = [(t or "").encode().translate(words.LOWER) for t in texts.take(part).to_pylist()]
                    yield lang, group, ids.take(part)
                    part, size = [], 0


def _marked(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints >> np.uint64(64 - FILTER_BITS)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _inside(found: Words, k: int, bits: np.ndarray | None, part: int) -> np.ndarray:
    """Places where k words are in one piece and all runs of ``part`` words in them are marked."""
    if not part:
        return np.arange(found.n)
    marked = _marked(bits, found.prints(part))
    ok = found.whole(k)
    for j in range(k - part + 1):
        ok &= marked[j : j + len(ok)]
    return np.flatnonzero(ok)


def _add_up(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint once, with its sum. Empties the lists, so that nothing is held twice."""
    every, numbers = np.concatenate(prints), np.concatenate(counts)
    prints.clear()
    counts.clear()
    order = np.argsort(every)
    every = every[order]
    numbers = numbers[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[starts], np.add.reduceat(numbers, starts)


def _count_prints(lengths: tuple[int, ...], part: int, shared) -> Callable:
    """Sums of the fingerprints of runs whose parts of ``part`` words are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if part else None
        prints, counts, held = [], [], 0

        def out(found: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found), PASSED):
                part = slice(at, at + PASSED)
                yield pa.RecordBatch.from_arrays([pa.array(found[part].view(np.int64)), pa.array(n[part])], ["print", "n"])

        for lang, group, _ in _groups(batches):
            found = Words(lang, group)
            for k in lengths:
                own = found.prints(k)[_inside(found, k, bits, part)]
                if len(own):
                    prints.append(own)
                    counts.append(np.ones(len(own), np.int64))
                    held += len(own)
            if held >= HELD:
                both = _add_up(prints, counts)
                held = len(both[0])
                if held >= HELD // 2:
                    yield from out(*both)
                    held = 0
                else:
                    prints.append(both[0])
                    counts.append(both[1])
                del both
        if prints:
            yield from out(*_add_up(prints, counts))

    return run


RUN = {"lang": pa.string(), "phrase": pa.string(), "words": pa.int32(), "n": pa.int64(), "doc_id": pa.int64(), "place": pa.int64()}


def _runs_of(found: Words, lang: str, ids: pa.Array, marks: list[np.ndarray]) -> Iterator[pa.Table]:
    """Marked runs by their words, with their fingerprint, count and first pointer."""
    numbers, dictionary = found.dictionary()
    for k, bits in enumerate(marks, 1):
        prints = found.prints(k)
        at = np.flatnonzero(found.whole(k) & _marked(bits, prints))
        while len(at):
            _, first, which, counts = np.unique(prints[at], return_index=True, return_inverse=True, return_counts=True)
            model = at[first][which]
            same = np.ones(len(at), bool)
            for j in range(k):
                same &= numbers[at + j] == numbers[model + j]
            if not same.all():
                counts = np.bincount(which[same], minlength=len(first))
            starts = at[first]
            doc = np.searchsorted(found.first, starts, side="right") - 1
            parts = [dictionary.take(pa.array(numbers[starts + j])) for j in range(k)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if k > 1 else parts[0]
            rows = len(starts)
            yield pa.table(
                {
                    "lang": pa.repeat(pa.scalar(lang), rows),
                    "phrase": phrase.cast(pa.string()),
                    "words": pa.repeat(pa.scalar(k, pa.int32()), rows),
                    "n": pa.array(counts, pa.int64()),
                    "doc_id": ids.take(pa.array(doc)).cast(pa.int64()),
                    "place": pa.array(starts - found.first[doc], pa.int64()),
                    "print": pa.array(prints[starts]),
                }
            )
            # Other words under a fingerprint are counted on their own.
            at = at[~same]
    rows = {name: pa.nulls(1, kind) for name, kind in RUN.items()}
    rows |= {"lang": pa.array([lang]), "phrase": pa.array([""]), "words": pa.array([0], pa.int32()), "n": pa.array([found.n], pa.int64())}
    yield pa.table(rows | {"print": pa.array([int(found.seed)], pa.uint64())})


def _summed(runs: pa.Table) -> pa.Table:
    """One row for equal words of a language: counts added up, the first pointer."""
    out = runs.group_by(["lang", "phrase", "words"], use_threads=False).aggregate(
        [("n", "sum"), *((name, "first", pc.ScalarAggregateOptions(skip_nulls=False)) for name in runs.schema.names[4:])]
    )
    return pa.table({name: out[name if name in out.schema.names else "n_sum" if name == "n" else f"{name}_first"] for name in runs.schema.names})


def _verify(shared: list, buckets: int) -> Callable:
    """Marked runs by their words, packed by bucket: a row per bucket, with all runs as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held, rows = [bits.value for bits in shared], [], 0

        def out(runs: pa.Table) -> pa.RecordBatch:
            bucket = runs["print"].to_numpy() % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            runs, (own, starts) = runs.take(pa.array(order)).combine_chunks(), np.unique(bucket[order], return_index=True)
            offsets = pa.array(np.append(starts, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, runs[name].combine_chunks()) for name in RUN]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *lists], ["bucket", *RUN])

        for lang, group, ids in _groups(batches):
            for runs in _runs_of(Words(lang, group), lang, ids, marks):
                held.append(runs)
                rows += len(runs)
            if rows >= HELD_RUNS:
                held = [_summed(pa.concat_tables(held))]
                rows = len(held[0])
                if rows >= HELD_RUNS // 2:
                    yield out(held[0])
                    held, rows = [], 0
        if held:
            yield out(_summed(pa.concat_tables(held)))

    return run


def _bucket(least: int) -> Callable:
    """The runs of one bucket that stand often enough, and the words per language."""

    def add_up(packed: pa.Table) -> pa.Table:
        runs = pa.table({name: packed[name].combine_chunks().flatten() for name in RUN})
        # The least pointer comes first, rows without a document last.
        runs = runs.take(pc.sort_indices(runs, [("doc_id", "ascending"), ("place", "ascending")], null_placement="at_end"))
        runs = _summed(runs)
        return runs.filter(pc.or_(pc.greater_equal(runs["n"], least), pc.equal(runs["words"], 0)))

    return add_up


def _bitmap(spark, prints: DataFrame):
    """Broadcast bitmap of the fingerprints: 2^FILTER_BITS bits, made by Spark in buckets."""
    place = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    buckets = (
        prints.select(F.shiftright(place, _BUCKET_BITS).alias("bucket"), (place % (1 << _BUCKET_BITS)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    size = 1 << (_BUCKET_BITS - 3)
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in buckets.toLocalIterator():
        out[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All runs of up to ``longest`` words that stand ``least`` times, and the words per language.

    The first has lang, phrase, words, n, and doc_id and place of an occurrence (the
    least of those that tasks met first), the second lang and total.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be at least 1 and longest at least 2")
    spark = docs.sparkSession
    words.small_batches(spark)
    texts = docs.select("doc_id", "text", "lang")
    marks, bits = [], None
    # Runs of four and more words are counted in one pass: few have only frequent parts.
    for lengths in [(k,) for k in range(1, min(longest, 3) + 1)] + [tuple(range(4, longest + 1))] * (longest > 3):
        counted = (
            texts.mapInArrow(_count_prints(lengths, lengths[0] - 1, bits), "print long, n long")
            .groupBy("print")
            .agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least)
        )
        bits = _bitmap(spark, counted)
        marks += [bits] * len(lengths)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // BUCKET_BYTES) + 1
    columns = "lang string, phrase string, words int, n long, doc_id long, place long"
    lists = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split() for c in columns.split(", ")))
    runs = materialize(
        texts.mapInArrow(_verify(marks, buckets), f"bucket long, {lists}").groupBy("bucket").applyInArrow(_bucket(least), columns),
        "runs",
    )
    totals = runs.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    return runs.filter("words > 0"), totals


def _joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def collocations(
    docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score, and where one stands.

    A candidate has the score of its worst cut: 1000 times its count times all
    words, over the counts of both parts. It is left out if a phrase with one
    more word has it inside and stands as often; by then no longer one need be
    looked at, since counts only fall with length.
    """
    runs, totals = phrase_counts(docs, least, longest)
    own = runs.filter("words > 1").withColumn("_words", F.split("phrase", " "))
    counts = runs.select("lang", "phrase", "n")
    cut = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "cut",
        F.col("n").alias("a"),
        _joined(F.slice("_words", F.lit(1), F.col("cut"))).alias("_left"),
        _joined(F.slice("_words", F.col("cut") + 1, F.col("words") - F.col("cut"))).alias("_right"),
    )
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r"))
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {wide}) * cast(a as decimal(19,0)) * cast(total as decimal(19,0))) div (cast(l as {wide}) * r)")
    scored = (
        cut.join(left, ["lang", "_left"])
        .join(right, ["lang", "_right"])
        .join(totals, "lang")
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_cut"))
    )
    longer = (
        own.filter("words > 2")
        .select(
            "lang",
            F.col("n").alias("_n"),
            F.explode(
                F.array(
                    _joined(F.slice("_words", F.lit(1), F.col("words") - 1)), _joined(F.slice("_words", F.lit(2), F.col("words") - 1))
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("_n").alias("_longer"))
    )
    kept = (
        own.drop("_words")
        .join(scored, ["lang", "phrase"])
        .join(longer, ["lang", "phrase"], "left")
        .filter("_longer is null or _longer < n")
        .join(totals, "lang")
        .select("lang", "phrase", F.col("n").alias("a"), "_cut.l", "_cut.r", F.col("total").alias("n"), "_cut.score", "doc_id", "place")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are among the best of each of its parts, so none sorts alone.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = kept.withColumn("_part", F.row_number().over(parts)).filter(F.col("_part") <= top).drop("_part")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "doc_id", "place"
    )
