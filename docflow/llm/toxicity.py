"""Toxicity: a convolutional text classifier, trained in numpy on all labelled texts.

Words are hashed to embeddings, each the sum of one for the word and one for its
first bytes, so that unseen endings are known by their stem; filters of several widths run over the whole
text, each gives its largest response (max pooling), and a logistic layer makes
the score. Language and source are never inputs of the score.

The classifier is fitted on every labelled row. The rows are dealt by a hash to parts of about
``PART_ROWS``; in each of 4 to ``EPOCHS`` rounds every part goes on from the same weights, in one pass
over its rows, and the weights are averaged: an embedding over the parts that have its word, by how
often they stepped it, all else by rows. A task holds the weights and a few MB of its rows; the sums
are made by ranges of embeddings, and only the averaged weights (4 MB) reach the driver. The first part
of an embedding starts as the log odds of the word in all these rows. A fifth of the rows is set
aside to calibrate one threshold per language, from counts of their scores.

Scoring is row-local: tasks multiply embeddings and filters, which are broadcast and of a
fixed size, out into one small table per filter offset, so that a text costs
look-ups, sums and a running maximum.

Defined results: null and empty texts get the score of a text without words; a
language without labelled rows has the threshold over all languages; labelled rows
without both labels give every text the share of label 1 in them (0 if there is
none). Other columns are not read, and rows come back as often as they go in.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm import words
from docflow.session import materialize

# Rows that one task learns from in a round, about.
PART_ROWS = 16_384
# Ranges of embeddings that are averaged apart.
SLICES = 8
VOCABULARY_BITS = 15
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
# Rounds over few rows; over more, as many as give a part the steps of EPOCHS rounds over FEW_ROWS.
EPOCHS = 8
FEW_ROWS = 8000
BATCH = 64
RATE = 0.05
SEED = 5
HEAD_BYTES = 4
# Bits that mark the labelled ids, whatever the input.
ID_BITS = 26
_BUCKET_BITS = 15  # bits of one bucket of Spark's bitmap functions
# Words come first, then heads, then the padding.
PAD = 2 << VOCABULARY_BITS
CHOICES = np.linspace(0.05, 0.95, 91)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4. Fold 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def encode(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first text of a group, numbers of word and head of its words; and where texts begin."""
    for first, group in words.chunks(texts):
        hashes, begin, end, bounds = words.words(group, words.NOT_ALNUM)
        both = np.stack([hashes, words.heads(group, begin, end, HEAD_BYTES)], 1)
        ids = (both >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int32)
        ids[:, 1] += 1 << VOCABULARY_BITS
        yield first, ids, bounds


def padded(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with padding after each text; and where texts begin."""
    gap = max(WIDTHS)
    counts = np.diff(bounds)
    starts = np.concatenate([[0], np.cumsum(counts + gap)])
    out = np.full((starts[-1], 2), PAD, np.int32)
    out[np.arange(len(ids)) + np.repeat(starts[:-1] - bounds[:-1], counts)] = ids
    return out, starts


def joined(numbers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of stored texts, one behind the other; and where texts begin."""
    ids = np.frombuffer(b"".join(numbers), np.uint16).reshape(-1, 2).astype(np.int32)
    return ids, np.concatenate([[0], np.cumsum([len(x) // 4 for x in numbers])]).astype(np.int64)


class Classifier:
    """Embeddings, filters and output weights; see the module.

    All but the embeddings are views of one vector, ``rest``; ``seen`` and ``rest_seen`` are
    the sums of Adagrad, and ``steps`` counts the steps of each embedding.
    """

    def __init__(self, embedding: np.ndarray, rest: np.ndarray, seen: np.ndarray, rest_seen: np.ndarray):
        self.embedding, self.rest, self.seen, self.rest_seen = embedding, rest, seen, rest_seen
        self.steps = np.zeros(len(embedding), np.int64)
        shapes = [(w, DIMENSIONS, FILTERS) for w in WIDTHS] + [(FILTERS,)] * len(WIDTHS) + [(len(WIDTHS) * FILTERS,), (1,)]
        ends = np.cumsum([int(np.prod(shape)) for shape in shapes])
        self.views = [slice(end - int(np.prod(shape)), end) for shape, end in zip(shapes, ends)]
        parts = [rest[view].reshape(shape) for shape, view in zip(shapes, self.views)]
        k = len(WIDTHS)
        self.filters, self.bias, (self.out, self.start) = parts[:k], parts[k : 2 * k], parts[2 * k :]

    @classmethod
    def initial(cls, rng: np.random.Generator, odds: np.ndarray) -> Classifier:
        embedding = rng.normal(0, 0.1, (PAD + 1, DIMENSIONS)).astype(np.float32)
        embedding[:PAD, 0] = odds
        embedding[PAD] = 0
        size = sum(WIDTHS) * DIMENSIONS * FILTERS + 2 * len(WIDTHS) * FILTERS + 1
        rest = np.zeros(size, np.float32)
        model = cls(embedding, rest, np.full(embedding.shape, 1e-3, np.float32), np.full(size, 1e-3, np.float32))
        for weights in model.filters:
            weights[:] = rng.normal(0, 0.1, weights.shape)
            weights[:, 0, : FILTERS // 2] += 0.5
        model.out[:] = rng.normal(0, 0.1, len(model.out))
        model.start[:] = -2
        return model

    def state(self) -> tuple[np.ndarray, ...]:
        return self.embedding, self.rest, self.seen, self.rest_seen

    def step(self, ids: np.ndarray, begins: np.ndarray, labels: np.ndarray) -> None:
        """One Adagrad step on a batch of padded texts."""
        pooled, places = [], []
        vectors = self.embedding[ids].sum(1)
        for k, width in enumerate(WIDTHS):
            n = len(ids) - width + 1
            response = sum(vectors[j : n + j] @ self.filters[k][j] for j in range(width)) + self.bias[k]
            top = np.stack([s + response[s : e - width + 1].argmax(0) for s, e in zip(begins[:-1], begins[1:])])
            places.append(top)
            pooled.append(np.take_along_axis(response, top, 0))
        pooled = np.concatenate(pooled, 1)
        active = np.maximum(pooled, 0)
        score = 1 / (1 + np.exp(-(active @ self.out + self.start[0])))
        error = ((score - labels) / len(labels)).astype(np.float32)
        back = error[:, None] * self.out[None, :] * (pooled > 0)
        rows, gradients, filters, bias = [], [], [], []
        for k, width in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            gradient = np.empty_like(self.filters[k])
            for j in range(width):
                at_word = vectors[places[k] + j]
                gradient[j] = np.einsum("bfd,bf->df", at_word, own)
                back_word = (own[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIMENSIONS)
                for part in range(ids.shape[1]):
                    rows.append(ids[places[k] + j, part].ravel())
                    gradients.append(back_word)
            filters.append(gradient.ravel())
            bias.append(own.sum(0))
        gradient = np.concatenate([*filters, *bias, active.T @ error, [error.sum()]]).astype(np.float32)
        self.rest_seen += gradient**2
        self.rest -= RATE * gradient / np.sqrt(self.rest_seen)
        rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(rows), DIMENSIONS), np.float32)
        np.add.at(total, inverse, np.concatenate(gradients))
        total *= (rows != PAD)[:, None]
        self.seen[rows] += total**2
        self.embedding[rows] -= RATE * total / np.sqrt(self.seen[rows])
        self.steps[rows] += 1

    def learn(self, numbers: list[bytes], labels: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over stored texts, in batches of random order."""
        order = rng.permutation(len(numbers))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            self.step(*padded(*joined([numbers[i] for i in chosen])), labels[chosen])

    def weights(self) -> dict:
        """What a task needs to make the tables."""
        names = ("embedding", "filters", "bias", "out")
        return {name: getattr(self, name) for name in names} | {"start": self.start[0]}


def tables_of(weights: dict) -> dict:
    """What scoring needs: responses by word, for every filter offset."""
    if "share" in weights:
        return weights
    responses = [[weights["embedding"] @ f[j] for j in range(len(f))] for f in weights["filters"]]
    return weights | {"responses": responses}


def scores_of(tables: dict, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Score of each padded text, from 0 to 1."""
    n = len(ids) - max(WIDTHS) + 1
    # Windows from each of a text's words and from the padding behind it.
    bounds = np.stack([starts[:-1], starts[1:] - max(WIDTHS) + 1], 1).ravel()
    bounds = bounds[:-1] if bounds[-1] == n else bounds
    pooled = []
    for responses, bias in zip(tables["responses"], tables["bias"]):
        total = np.zeros((n, FILTERS), np.float32)
        for j, response in enumerate(responses):
            for part in range(ids.shape[1]):
                total += response[ids[j : n + j, part]]
        pooled.append(np.maximum(np.maximum.reduceat(total, bounds, axis=0)[::2] + bias, 0))
    return 1 / (1 + np.exp(-(np.concatenate(pooled, 1).astype(float) @ tables["out"] + tables["start"])))


def scores(tables: dict, texts: list[str | None]) -> np.ndarray:
    """Score of each text, from 0 to 1."""
    out = np.empty(len(texts))
    for first, ids, bounds in encode(texts):
        out[first : first + len(bounds) - 1] = scores_of(tables, *padded(ids, bounds))
    return out


def labelled_ids(known: DataFrame):
    """Broadcast bitmap of the hashes of the labelled ids: 2^ID_BITS bits, made by Spark in buckets."""
    counted = (
        known.select(id_hash().alias("place"))
        .select(F.shiftright("place", _BUCKET_BITS).alias("bucket"), (F.col("place") % (1 << _BUCKET_BITS)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    size = 1 << (_BUCKET_BITS - 3)
    out = np.zeros(1 << (ID_BITS - 3), np.uint8)
    for row in counted.toLocalIterator():
        out[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return known.sparkSession.sparkContext.broadcast(out)


def id_hash() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << ID_BITS))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, key, toxic, lang, apart and the numbers of words of every labelled row outside the held-out fold.

    Texts become numbers where they are read, and only numbers are shuffled. Rows whose id is not
    in a bitmap of the labelled ones are not numbered; the join leaves out the few others that are
    not labelled. It is a merge join at every size, since neither side is bounded.
    """
    known = (
        labels.filter("toxic is not null and doc_id is not null")
        .filter(fold() != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("toxic"))
    )
    parts = known.count() // PART_ROWS + 1
    key = F.xxhash64("doc_id", "text")
    shared = labelled_ids(known)

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for frame in frames:
            place = frame["place"].to_numpy(dtype=np.int64)
            frame = frame[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0]
            if frame.empty:
                continue
            numbers: list[bytes] = []
            for _, ids, bounds in encode(frame["text"].tolist()):
                small = ids.astype(np.uint16)
                numbers.extend(small[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:]))
            yield frame[["doc_id", "part", "key", "lang"]].assign(
                apart=frame["doc_id"].to_numpy(dtype=np.int64) // 7 % 5 == 0, numbers=numbers
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.filter(fold() != 2)
        .select("doc_id", "text", "lang", key.alias("key"), F.pmod(key, F.lit(parts)).cast("int").alias("part"), id_hash().alias("place"))
        .mapInPandas(number, f"doc_id {kind}, part int, key long, lang string, apart boolean, numbers binary")
        .join(known.hint("merge"), "doc_id")
        .select("part", "key", "toxic", "lang", "apart", "numbers")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "key", "lang")
    )


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`labelled_rows`, stored. Rows of a part stand together, in the order of a hash."""
    return materialize(labelled_rows(docs, labels).select("part", "toxic", "lang", "apart", "numbers"), "labelled")


def log_odds(rows: DataFrame) -> np.ndarray:
    """Log odds of each number between texts with and without label 1; 0 of numbers in one text only."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, PAD), np.int64)
        texts = np.zeros(2, np.int64)
        for frame in frames:
            for data, toxic in zip(frame["numbers"], frame["toxic"]):
                total[int(toxic > 0), np.unique(np.frombuffer(data, np.uint16))] += 1
                texts[int(toxic > 0)] += 1
        label, number = np.nonzero(total)
        # The texts themselves stand at the number of the padding.
        yield pd.DataFrame({"label": [*label, 0, 1], "number": [*number, PAD, PAD], "n": [*total[label, number], *texts]})

    counted = rows.select("numbers", "toxic").mapInPandas(count, "label int, number int, n long")
    found = counted.groupBy("label", "number").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((2, PAD + 1))
    seen[found["label"].to_numpy(int), found["number"].to_numpy(int)] = found["n"].to_numpy(float)
    per_class, seen = np.maximum(1, seen[:, PAD]), seen[:, :PAD]
    odds = np.log((seen[1] + 0.2) / (per_class[1] + 1)) - np.log((seen[0] + 0.2) / (per_class[0] + 1))
    return np.clip(np.where(seen.sum(0) > 1, odds, 0), -2, 4).astype(np.float32) / 2


def learn_round(rows: DataFrame, state: tuple[np.ndarray, ...], turn: int) -> tuple[np.ndarray, ...]:
    """The weights after each part has learnt from all its rows, averaged."""
    shared = rows.sparkSession.sparkContext.broadcast(state)
    size = -(-len(state[0]) // SLICES)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def updates(part: int, model: Classifier, n: int) -> pd.DataFrame:
            found = []
            for i in range(SLICES):
                at = np.flatnonzero(model.steps[i * size : (i + 1) * size]) + i * size
                found.append((i, (at, model.steps[at].astype(float), model.embedding[at], model.seen[at])))
            found.append((SLICES, (np.zeros(1, np.int64), np.array([float(n)]), model.rest[None], model.rest_seen[None])))
            return pd.DataFrame([(i, part, n, pickle.dumps(own)) for i, own in found], columns=["slice", "part", "n", "entries"])

        part, model, n = None, None, 0
        for frame in frames:
            for number, own in frame.groupby("part", sort=False):
                if number != part:
                    if n:
                        yield updates(part, model, n)
                    part, model, n = number, Classifier(*(x.copy() for x in shared.value)), 0
                model.learn(own["numbers"].tolist(), own["toxic"].to_numpy(), np.random.default_rng((SEED, turn, int(number), n)))
                n += len(own)
        if n:
            yield updates(part, model, n)

    def average(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[np.ndarray]] = {}
        for frame in frames:
            for number, data in zip(frame["slice"].tolist(), frame["entries"]):
                at, weight, values, seen = pickle.loads(data)
                if number not in sums:
                    places = size if number < SLICES else 1
                    sums[number] = [np.zeros(places), *(np.zeros((places, values.shape[1])) for _ in range(2))]
                at = at - (number * size if number < SLICES else 0)
                for total, own in zip(sums[number], (weight, values * weight[:, None], seen * weight[:, None])):
                    total[at] += own
        for number, (weight, values, seen) in sums.items():
            at = np.flatnonzero(weight)
            weight = weight[at, None]
            entries = at + (number * size if number < SLICES else 0), (values[at] / weight).astype(np.float32), (seen[at] / weight).astype(np.float32)
            yield pd.DataFrame({"slice": [number], "entries": [pickle.dumps(entries)]})

    updates = rows.select("part", "toxic", "numbers").mapInPandas(learn, "slice int, part int, n long, entries binary")
    averaged = (
        updates.repartition(SLICES, "slice")
        .sortWithinPartitions("slice", "part", "n")
        .mapInPandas(average, "slice int, entries binary")
    )
    embedding, rest, seen, rest_seen = (x.copy() for x in state)
    for row in averaged.toLocalIterator():
        at, values, squares = pickle.loads(row["entries"])
        if row["slice"] < SLICES:
            embedding[at], seen[at] = values, squares
        else:
            rest[:], rest_seen[:] = values[0], squares[0]
    shared.unpersist()
    return embedding, rest, seen, rest_seen


def thresholds(rows: DataFrame, weights: dict) -> tuple[dict[str, float], float]:
    """Thresholds of the best F1 by language, and over all, of the rows set aside; over all rows if none is."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = tables_of(shared.value)
        for frame in frames:
            if len(frame):
                found = scores_of(tables, *padded(*joined(frame["numbers"].tolist())))
                above = np.searchsorted(CHOICES, found, side="right")
                yield frame[["lang", "toxic", "apart"]].assign(above=above)

    apart = rows.filter("apart")
    if apart.isEmpty():
        apart = rows
    counted = (
        apart.select("lang", "toxic", "apart", "numbers")
        .mapInPandas(place, "lang string, toxic double, apart boolean, above int")
        .groupBy("lang", "apart", "above")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
        .collect()
    )

    def best(own: list) -> float:
        """Threshold of the best F1."""
        flagged, right = np.zeros(len(CHOICES)), np.zeros(len(CHOICES))
        for row in own:
            flagged[: row["above"]] += row["n"]
            right[: row["above"]] += row["toxic"]
        quality = 2 * right / np.maximum(1, flagged + sum(row["toxic"] for row in own))
        top = np.flatnonzero(quality == quality.max())
        return float(CHOICES[top[len(top) // 2]])

    by_lang: dict[str, list] = {}
    for row in counted:
        if row["lang"] is not None and row["apart"]:
            by_lang.setdefault(row["lang"], []).append(row)
    return {name: best(own) for name, own in by_lang.items() if any(row["toxic"] for row in own)}, best(counted)


def rounds(rows: int) -> int:
    """Passes over all rows: a part of more rows makes more steps in each, so fewer do."""
    return max(4, min(EPOCHS, EPOCHS * FEW_ROWS // max(1, min(rows, PART_ROWS))))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict, dict[str, float], float]:
    """Weights, thresholds by language, and the threshold over all, from all labelled rows."""
    words.small_batches(docs.sparkSession)
    rows = labelled(docs, labels)
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.min("toxic").alias("low"), F.max("toxic").alias("high"), F.avg("toxic").alias("share")).first()
    if not known["n"] or known["low"] == known["high"]:
        return {"share": float(known["share"] or 0.0)}, {}, 0.5
    learnt = rows.filter("not apart")
    state = Classifier.initial(np.random.default_rng(SEED), log_odds(learnt)).state()
    for turn in range(rounds(known["n"])):
        state = learn_round(learnt, state, turn)
    weights = Classifier(*state).weights()
    return weights, *thresholds(rows, weights)


def scorer(docs: DataFrame, labels: DataFrame) -> tuple[Callable, Column]:
    """The score of a text column by a model of the labelled rows, and the threshold of a row's language."""
    weights, by_lang, overall = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = tables_of(shared.value)
        for part in parts:
            if "share" in tables:
                yield pd.Series(np.full(len(part), tables["share"]))
            else:
                yield pd.Series(scores(tables, part.tolist()))

    threshold = F.lit(overall)
    for name, value in sorted(by_lang.items()):
        threshold = F.when(F.col("lang") == name, F.lit(value)).otherwise(threshold)
    return F.pandas_udf(run, "double"), threshold


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, threshold of the language, flagged; and the columns to keep."""
    apply, threshold = scorer(docs, labels)
    return docs.select(
        "doc_id", *keep, apply("text").alias("score"), threshold.alias("threshold")
    ).withColumn("flagged", (F.col("score") >= F.col("threshold")).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the limit, with all their columns as they are."""
    apply, _ = scorer(docs, labels)
    return docs.filter(apply("text") < limit)
