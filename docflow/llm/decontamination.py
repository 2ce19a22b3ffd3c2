"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: A-Z in lower case, every run of other ASCII
than letters and digits one space. An item of m bytes has an error budget of
m // ``BYTES_PER_ERROR`` edits (insertions, deletions, substitutions of bytes)
and is cut into budget + 1 pieces: a passage within the budget holds one of
them unchanged. All pieces of a block of items are found in one pass over a
text with an Aho-Corasick automaton, and the passage around a hit is verified
with Myers' bit-parallel distance.

Items are taken in blocks of at most ``BLOCK_BYTES``, each broadcast for one
pass over the whole corpus, so a benchmark of any size is never held as a whole
on the driver or an executor. The pass is row-local.

Defined results: null or wordless texts and items never match; an item shorter
than ``SHORT`` bytes must stand as whole words; items of equal normalised text
all match; rows of one doc_id are reported per row. An empty benchmark or corpus
gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm import words

BYTES_PER_ERROR = 20
SHORT = 20
BLOCK_BYTES = 4 << 20
_CLEAN = bytes(32 if words.NOT_ALNUM[b] else b for b in words.LOWER)


def normalise(text: str | None) -> str:
    """Lower-case words, one space before and after each; one character per byte."""
    data = b" ".join((text or "").encode().translate(_CLEAN).split())
    return f" {data.decode('latin-1')} " if data else ""


def pieces(item: str, per_error: int = BYTES_PER_ERROR) -> list[tuple[int, str]]:
    """The item in budget + 1 pieces, with their places."""
    count = len(item) // per_error + 1
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(s, item[s:e]) for s, e in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edits to turn the pattern into a substring of the text, and where that ends."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        if distance < best:
            best, end = distance, i + 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
    return best, end


class Matcher:
    """The items of one block."""

    def __init__(self, items: list[tuple[int, str]], per_error: int = BYTES_PER_ERROR):
        self.ids = defaultdict(list)
        for item_id, text in items:
            clean = normalise(text)
            if clean:
                self.ids[clean if len(clean) < SHORT else clean.strip()].append(item_id)
        self.patterns = list(self.ids)
        self.per_error = per_error
        found = defaultdict(list)
        for number, pattern in enumerate(self.patterns):
            for place, piece in pieces(pattern, per_error):
                found[piece].append((number, place + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, uses)
        if found:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) for every item in the text."""
        text = normalise(text)
        if not text or not self.patterns:
            return []
        starts = defaultdict(set)
        for end, uses in self.automaton.iter(text):
            for number, place in uses:
                starts[number].add(end + 1 - place)
        out = []
        for number, places in starts.items():
            pattern = self.patterns[number]
            budget = len(pattern) // self.per_error
            best, left, right = None, None, None
            # Neighbouring hits share one window.
            for place in [*sorted(places), None]:
                if left is not None and (place is None or place > right + 2 * budget + 1):
                    low = max(0, left - budget)
                    distance, end = myers(pattern, text[low : right + len(pattern) + budget])
                    if distance <= budget and (best is None or distance < best[0]):
                        best = distance, low + end
                    left = None
                    if best and not best[0]:
                        break
                if place is not None:
                    left, right = place if left is None else left, place
            if best:
                out.extend((item_id, *best) for item_id in self.ids[pattern])
        return out


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if row["text"]:
            block.append((row["item_id"], row["text"]))
            size += len(row["text"].encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(
    docs: DataFrame, benchmark: DataFrame, per_error: int = BYTES_PER_ERROR, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, item_id, distance and end: the benchmark items in each text."""
    words.small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, distance int, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        found = F.explode(_search(shared, per_error)("text"))
        out = out.unionByName(docs.select("doc_id", found.alias("_found")).select("doc_id", "_found.*"))
    return out


def _search(shared, per_error: int):
    """The items of the block in a text. Texts alone go to Python, so ids stay as they are."""

    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, per_error)
        for part in parts:
            yield pd.Series([matcher.find(text) for text in part], dtype=object)

    return F.pandas_udf(search, "array<struct<item_id bigint, distance int, end bigint>>")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, per_error: int = BYTES_PER_ERROR, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    words.small_batches(docs.sparkSession)
    out = docs
    for block in item_blocks(benchmark, block_bytes):
        out = out.filter(_clean(docs.sparkSession.sparkContext.broadcast(block), per_error)("text"))
    return out


def _clean(shared, per_error: int):
    """Whether a text holds no item of the block."""

    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, per_error)
        for part in parts:
            yield pd.Series(np.fromiter((not matcher.find(t) for t in part), bool, len(part)))

    return F.pandas_udf(clean, "boolean")
