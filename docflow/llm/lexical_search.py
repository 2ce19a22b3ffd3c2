"""Ranked lexical search with a length-stratified index.

A document of n terms has the normaliser m = 50 + (50 * n * N) div L, and its score
for a term depends on nothing but m, the term's occurrences tf and the term's weight.
So the index groups documents by equal m into strata, and the postings of a term in
a stratum by tf: an impact is computed once for each (stratum, term, tf) and serves all
documents below it. A stratum of very many postings, such as one that a group of
copies fills, is split into pieces of about ``PIECE_POSTINGS``, each a row of the index.

For a batch of strata and all items of a block, the bound of a stratum is the sum of
an item's weights times the impact of the largest tf that each term has there. Strata
are visited by falling bound; the visit ends when no bound reaches the score of
the item's worst document kept, which the task carries on to its next batch. Each task
passes on at most ``top`` documents an item, and a window over those gives the ranks.

Every document is indexed, with all its terms. Items are read in blocks of at most
``BLOCK_BYTES`` of terms and ``BLOCK_ITEMS`` items, each broadcast for one pass over the index. Terms are compared
as bytes, never by hash.

Defined results: a null text or one without terms is not found by anything and counts
for nothing; neither does an item without terms, or whose terms stand nowhere; rows of
one doc_id are documents of their own, rows of one item_id items of their own; a null
doc_id comes last among equal scores. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm import words
from docflow.session import materialize

TOP = 50
PIECE_POSTINGS = 1 << 19
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 4096
# Strata whose numbers of pieces may be broadcast, 16 bytes each.
SENT_STRATA = 1 << 16
_TERMS = bytes(32 if words.NOT_ALNUM[b] else b for b in words.LOWER)
_LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as bytes."""
    return (text or "").encode().translate(_TERMS).split()


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document with terms: their number, each once, and how often."""
    for batch in batches:
        counted = [Counter(terms(text.as_py())) for text in batch.column("text")]
        some = [i for i, c in enumerate(counted) if c]
        lengths = np.cumsum([0, *(len(counted[i]) for i in some)])
        flat = pa.array([t for i in some for t in counted[i]], pa.binary())
        often = pa.array([n for i in some for n in counted[i].values()], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(some, pa.int64())),
                pa.array([sum(counted[i].values()) for i in some], pa.int64()),
                pa.ListArray.from_arrays(lengths.astype(np.int32), flat),
                pa.ListArray.from_arrays(lengths.astype(np.int32), often),
            ],
            ["doc_id", "n", "terms", "often"],
        )


def _stratum(table: pa.Table) -> pa.Table:
    """The documents of one stratum or piece as one row of the index.

    ``docs`` are their ids in order. ``terms``, ``tf`` and ``counts`` have an entry
    for every term and tf, in this order; ``places`` are the documents of all entries
    one after the other, as places in ``docs``.
    """
    table = table.combine_chunks()
    ids = table["doc_id"].combine_chunks()
    by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    lists = table["terms"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    code, tf = coded.indices.to_numpy().astype(np.int64), table["often"].combine_chunks().flatten().to_numpy()
    own = np.repeat(place, sizes)
    order = np.lexsort((own, tf, code))
    code, tf, own = code[order], tf[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])]))

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.table(
        {
            "m": table["m"][:1],
            "docs": one(ids.take(pa.array(by_id))),
            "terms": one(coded.dictionary.take(pa.array(code[starts]))),
            "tf": one(pa.array(tf[starts], pa.int32())),
            "counts": one(pa.array(np.diff(np.append(starts, len(code))), pa.int32())),
            "places": one(pa.array(own, pa.int32())),
        }
    )


class Index:
    """A stored index: its rows, the documents with terms (N) and all their terms (L)."""

    def __init__(self, rows: DataFrame, documents: int, length: int):
        self.rows, self.documents, self.length = rows, documents, length


def build(docs: DataFrame, piece: int = PIECE_POSTINGS) -> Index:
    """Index all documents. Texts are read once."""
    spark = docs.sparkSession
    words.small_batches(spark)
    forward = materialize(
        docs.select("doc_id", "text").mapInArrow(
            _forward, "doc_id long, n long, terms array<binary>, often array<int>"
        ),
        "forward",
    )
    documents, length = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    placed = forward.withColumn("m", F.expr(f"50 + (50 * n * {documents}) div {max(1, length)}"))
    # Pieces of the strata that have several, dealt by id and place in the table. There is a
    # row for each m at most; only if these are few are they sent to all tasks.
    split = materialize(
        placed.groupBy("m").agg(F.sum(F.size("terms")).alias("_postings")).filter(F.col("_postings") > piece), "split"
    ).select("m", F.ceil(F.col("_postings") / F.lit(piece)).alias("_pieces"))
    split = F.broadcast(split) if split.count() <= SENT_STRATA else split
    dealt = F.xxhash64("doc_id", F.monotonically_increasing_id())
    rows = (
        placed.withColumn("_dealt", dealt)
        .join(split, "m", "left")
        .withColumn("piece", F.pmod("_dealt", F.coalesce("_pieces", F.lit(1))))
        .select("m", "piece", "doc_id", "terms", "often")
        # Asked for explicitly: rows dealt by m alone would do for the grouping.
        .repartition("m", "piece")
        .groupBy("m", "piece")
        .applyInArrow(
            _stratum, "m long, docs array<long>, terms array<binary>, tf array<int>, counts array<int>, places array<int>"
        )
    )
    return Index(materialize(rows, "index"), documents, length)


class _Items:
    """A block of items, by term: ``of`` numbers the items of each term, ``weight`` their weights."""

    def __init__(self, block: list[tuple[list[bytes], list[int]]]):
        self.count = len(block)
        known = sorted({t for own, _ in block for t in own})
        code = {t: i for i, t in enumerate(known)}
        self.known = pa.array(known, pa.binary())
        items = np.repeat(np.arange(len(block)), [len(own) for own, _ in block])
        codes = np.array([code[t] for own, _ in block for t in own], np.int64)
        weights = np.array([w for _, own in block for w in own], np.int64)
        order = np.argsort(codes, kind="stable")
        self.item, self.weight = items[order], weights[order]
        self.bounds = np.searchsorted(codes[order], np.arange(len(known) + 1))


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers starts[i] … starts[i] + counts[i] - 1 for every i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class _Best:
    """The best documents of an item so far."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach, if only by a smaller id."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[order], doc[order]


def _visit(batch: pa.RecordBatch, items: _Items, best: list[_Best]) -> None:
    """Strata of a batch for every item, by falling bound."""
    column = {name: batch.column(name) for name in batch.schema.names}
    m = column["m"].to_numpy()

    def flat(name: str) -> tuple[np.ndarray, pa.Array]:
        offsets = column[name].offsets.to_numpy()
        return offsets - offsets[0], column[name].flatten()

    entry_at, names = flat("terms")
    place_at, places = flat("places")
    doc_at, docs = flat("docs")
    docs = pc.fill_null(docs, _LAST).to_numpy()
    places, tf = places.to_numpy(), flat("tf")[1].to_numpy().astype(np.int64)
    counts = flat("counts")[1].to_numpy().astype(np.int64)
    stratum = np.repeat(np.arange(len(m)), np.diff(entry_at))
    starts = np.cumsum(counts) - counts
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[stratum])

    code = pc.fill_null(pc.index_in(names, value_set=items.known), -1).to_numpy().astype(np.int64)
    entry = np.flatnonzero(code >= 0)
    # A row for every entry and item that has its term.
    uses = items.bounds[code[entry] + 1] - items.bounds[code[entry]]
    use = _expand(items.bounds[code[entry]], uses)
    entry = np.repeat(entry, uses)
    item, value = items.item[use], items.weight[use] * impact[entry]
    pair = item * len(m) + stratum[entry]
    # The last entry of a term in a stratum has the largest tf.
    last = np.ones(len(entry), bool)
    if len(entry):
        ends = np.concatenate([np.flatnonzero((code[1:] != code[:-1]) | (stratum[1:] != stratum[:-1])), [len(code) - 1]])
        is_end = np.zeros(len(code), bool)
        is_end[ends] = True
        last = is_end[entry]
    bound = np.zeros(items.count * len(m), np.int64)
    np.add.at(bound, pair[last], value[last])
    bound = bound.reshape(items.count, len(m))
    order = np.argsort(pair, kind="stable")
    entry, value = entry[order], value[order]
    at = np.searchsorted(pair[order], np.arange(items.count * len(m) + 1))
    for number in np.flatnonzero(bound.any(1)).tolist():
        own = best[number]
        for s in np.argsort(-bound[number], kind="stable").tolist():
            if bound[number, s] < own.least:
                break
            chosen = slice(at[number * len(m) + s], at[number * len(m) + s + 1])
            entries = entry[chosen]
            sums = np.zeros(doc_at[s + 1] - doc_at[s], np.int64)
            np.add.at(sums, places[_expand(starts[entries], counts[entries])], np.repeat(value[chosen], counts[entries]))
            found = np.flatnonzero(sums >= own.least)
            if len(found) > own.top:
                # Ties are kept by place, which is the order of ids.
                found = found[np.argsort(-sums[found], kind="stable")[: own.top]]
            own.add(sums[found], docs[doc_at[s] + found])


def weigh(index: Index, items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct terms of each item that stand in a document, with their weights: a row an item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms(t.as_py()))) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_item"), batch.column("item_id"), pa.array(own, pa.list_(pa.binary()))], ["_item", "item_id", "terms"]
            )

    # Stored, so that an item's number stays the same in all that follows.
    own = materialize(
        items.select(F.monotonically_increasing_id().alias("_item"), F.col(item).alias("item_id"), F.col(text).alias("_text"))
        .mapInArrow(split, "_item long, item_id long, terms array<binary>")
        .select("_item", "item_id", F.explode("terms").alias("term")),
        "item_terms",
    )
    held = (
        index.rows.select(F.explode(F.arrays_zip("terms", "counts")).alias("e"))
        .select(F.col("e.terms").alias("term"), F.col("e.counts").alias("count"))
        .join(own.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("count").alias("df"))
    )
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    return own.join(held, "term").groupBy("_item", "item_id").agg(
        F.collect_list(F.struct("term", weight.alias("weight"))).alias("terms")
    )


def _blocks(weighed: DataFrame, limit: int) -> Iterator[list]:
    block, size = [], 0
    for row in weighed.toLocalIterator():
        block.append((row["item_id"], [bytes(t["term"]) for t in row["terms"]], [t["weight"] for t in row["terms"]]))
        size += sum(len(t) + 16 for t in block[-1][1])
        if size >= limit or len(block) == BLOCK_ITEMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(
    index: Index, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, item: str = "item_id", text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of every item."""
    spark = index.rows.sparkSession
    schema = "_row long, item_id long, doc_id long, score long"
    found = spark.createDataFrame([], schema)
    first = 0
    for block in _blocks(weigh(index, items, item, text), block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            block = shared.value
            own = _Items([(names, weights) for _, names, weights in block])
            best = [_Best(top) for _ in block]
            for batch in batches:
                if batch.num_rows:
                    _visit(batch, own, best)
            rows = [(first + i, block[i][0], d, s) for i, b in enumerate(best) for d, s in zip(b.doc.tolist(), b.score.tolist())]
            rows = [(i, name, None if d == _LAST else d, s) for i, name, d, s in rows]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_row", "item_id", "doc_id", "score"])

        found = found.unionByName(index.rows.mapInArrow(run, schema))
        first += len(block)
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
