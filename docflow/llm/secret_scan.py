"""Secret scans: fixed patterns, and character Markov models compared by likelihood.

Three patterns give the base spans: assigned values, access keys and long hex
strings. Beside them every token of ``MIN_LENGTH`` characters that keys are made of is
scored by two Markov models of its characters, one of random strings and one of
ordinary identifiers: the mean logarithm of the likelihood ratio of its transitions.
A token above the threshold that no base span touches is a span of kind ``markov``.

Both models are trained from labelled samples, tokens marked as secret or not. The
default labels are taken from the whole corpus: what the patterns find is labelled as secret
and all other tokens of ``IDENTIFIER`` characters as ordinary. Spark counts the transitions of distinct tokens; only
the two tables of counts, ``len(ALPHABET) + 1`` squared, reach the driver. Half of the ordinary
tokens, by a hash, are set apart from training and give the threshold: the share
``TOLERANCE`` of those long enough to be a span may lie above it. The scan itself is
row-local and reads each text once.

Defined results: null and empty texts have no spans; places are counted in code
points; rows come back as often as they go in, whatever their doc_id; without a secret
in the sample the random model is uniform, without an ordinary token nothing but base
spans is found. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm import words
from docflow.session import materialize

# The kinds in order, and the patterns of the base spans.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
MIN_LENGTH = 16
IDENTIFIER = 6
TOLERANCE = 0.0005
# Scores that are sorted in one place to find a quantile, and parts into which more of them are counted.
SORTED = 20_000
PARTS = 4096
# Share of the uniform distribution in both models.
UNIFORM = 0.25
_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(ACCESS)
# Runs that reach the least length are found at once; shorter ones would be dropped.
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_LENGTH)
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % IDENTIFIER)
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(1, len(ALPHABET) + 1)
_SIZE = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def outside(text: str, base: list[tuple[int, int, int]], pattern: re.Pattern) -> list[tuple[int, int]]:
    """Start and end of the pattern's matches that no base span touches."""
    spans = [m.span() for m in pattern.finditer(text)]
    return [(s, e) for s, e in spans if not any(s < b_end and b_start < e for b_start, _, b_end in base)] if base else spans


def _transitions(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of every transition, from before the first character on, and where tokens begin."""
    data = np.frombuffer("".join(tokens).encode("ascii", "replace"), np.uint8)
    codes = _CODE[data]
    starts = np.cumsum([0, *(len(t) for t in tokens)])[:-1]
    before = np.concatenate([[0], codes[:-1]])
    before[starts[starts < len(before)]] = 0
    return before * _SIZE + codes, starts


@dataclass
class Models:
    """Log ratio of each transition's likelihoods, and the mean above which a token is a secret."""

    ratio: np.ndarray
    threshold: float

    def score(self, tokens: list[str]) -> np.ndarray:
        """Mean log ratio of the transitions of each token."""
        if not tokens:
            return np.zeros(0)
        moves, starts = _transitions(tokens)
        return np.add.reduceat(self.ratio[moves], starts) / [len(t) for t in tokens]


def labelled_tokens(docs: DataFrame) -> DataFrame:
    """token and secret: the labelled tokens of all documents, see the module."""
    words.small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<token string, secret boolean>>")
    def label(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            base = base_spans(text or "")
            # A span's value is its last token.
            found = [(_IDENTIFIER.findall(text[s:e])[-1:], True) for s, _, e in base]
            found.append(([text[s:e] for s, e in outside(text or "", base, _IDENTIFIER)], False))
            out.append([(token, secret) for tokens, secret in found for token in tokens])
        return pd.Series(out)

    return docs.select(F.explode(label("text")).alias("_t")).select("_t.*")


def quantile(values: DataFrame, share: float) -> float | None:
    """The quantile of the one column, between two values by their distance; none of no values.

    Values are counted in ``PARTS`` parts of their range, and then of the part that holds the place,
    until ``SORTED`` are left or all are equal; only those are brought together.
    """
    name = values.columns[0]
    values = values.filter(F.col(name).isNotNull())
    n, low, high = values.agg(F.count(F.lit(1)), F.min(name), F.max(name)).first()
    if not n:
        return None
    place = (n - 1) * share

    def at(rank: int) -> float:
        below, least, most, count = 0, low, high, n
        while least < most and count > SORTED:
            own = values.filter(F.col(name).between(least, most))
            part = F.least(F.floor((F.col(name) - least) / (most - least) * PARTS), F.lit(PARTS - 1))
            counted = own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("least"), F.max(name).alias("most"))
            for row in sorted(counted.collect(), key=lambda r: r["part"]):
                if below + row["n"] > rank:
                    break
                below += row["n"]
            least, most, count = row["least"], row["most"], row["n"]
        if least == most:
            return least
        rest = values.filter(F.col(name).between(least, most)).orderBy(name).limit(rank - below + 1)
        return rest.agg(F.max(name)).first()[0]

    first = at(int(place))
    return first if place == int(place) else first + (at(int(place) + 1) - first) * (place - int(place))


def train(samples: DataFrame, tolerance: float = TOLERANCE) -> Models:
    """Both models and the threshold from labelled tokens, of which each counts once.

    A character outside the alphabet is one more symbol.
    """
    known = samples.filter("token <> '' and secret is not null").select("token", "secret").distinct()
    samples = materialize(known, "labelled_tokens")
    apart = ~F.col("secret") & (F.pmod(F.xxhash64("token"), F.lit(2)) == 0)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, _SIZE * _SIZE), np.int64)
        for part in parts:
            for secret in (False, True):
                own = part[part["secret"] == secret]
                tokens = own["token"].tolist()
                if tokens:
                    total[int(secret)] += np.bincount(_transitions(tokens)[0], minlength=_SIZE * _SIZE)
        label, move = np.nonzero(total)
        yield pd.DataFrame({"secret": label > 0, "move": move, "n": total[label, move]})

    counts = np.zeros((2, _SIZE * _SIZE))
    counted = samples.filter(~apart).select("token", "secret").mapInPandas(count, "secret boolean, move int, n long")
    for row in counted.groupBy("secret", "move").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[int(row["secret"]), row["move"]] = row["n"]
    by_state = counts.reshape(2, _SIZE, _SIZE)
    seen = by_state.sum(2, keepdims=True)
    uniform = 1 / len(ALPHABET)
    learnt = np.where(seen > 0, by_state / np.maximum(seen, 1), uniform)
    chance = (1 - UNIFORM) * learnt + UNIFORM * uniform
    models = Models((np.log(chance[1]) - np.log(chance[0])).ravel(), np.inf)

    @F.pandas_udf("double")
    def score(tokens: pd.Series) -> pd.Series:
        return pd.Series(models.score(tokens.tolist()))

    long = samples.filter(apart & (F.length("token") >= MIN_LENGTH)).select(score("token").alias("score"))
    limit = quantile(materialize(long, "scores"), 1 - tolerance)
    if counts[0].any():
        models.threshold = max(0.0, limit or 0.0)
    return models


def scan(docs: DataFrame, models: Models, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and ``found``: kind, start, end and score of every span, in order.

    Base spans have no score. Texts alone go to Python, so ids stay as they are.
    """
    words.small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind string, start int, end int, score double>>")
    def run(texts: pd.Series) -> pd.Series:
        out, tokens, places = [], [], []
        for i, text in enumerate(texts):
            text = text or ""
            base = base_spans(text)
            out.append([(s, kind, e, None) for s, kind, e in base])
            for s, e in outside(text, base, _TOKEN):
                tokens.append(text[s:e])
                places.append((i, s, e))
        scores = models.score(tokens)
        for at in np.flatnonzero(scores > models.threshold).tolist():
            i, s, e = places[at]
            out[i].append((s, len(KINDS) - 1, e, float(scores[at])))
        return pd.Series([[(KINDS[kind], s, e, score) for s, kind, e, score in sorted(own, key=lambda x: x[:2])] for own in out])

    return docs.select(*keep, run("text").alias("found"))


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
