"""Repetition found while tokens still arrive."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docflow import constants as C
from docflow.operators.markup import PAGE_KEYS, ROWS_AT_ONCE, repeats_of
from docflow.streaming.microbatch import GROUPED_KEYS

# Groups of texts whose last tokens are one list of state each.
TEXT_GROUPS = 4096


def add_piece(pieces: dict[int, np.ndarray], start: int, tokens: np.ndarray) -> None:
    """Of pieces that begin at one place the longest holds the others."""
    if start not in pieces or len(tokens) > len(pieces[start]):
        pieces[start] = np.asarray(tokens, np.int64)


def go_on(position: int, tail: np.ndarray, pieces: dict[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The end of a text and its tokens from ``tail`` on, as far as they are there; takes out the pieces that are used."""
    fresh = [tail]
    for start in sorted(pieces):
        if start > position:
            break
        new = pieces.pop(start)[position - start :]
        fresh.append(new)
        position += len(new)
    return position, np.concatenate(fresh)


class LastTokens(StatefulProcessor):
    """The last ``window`` tokens of a text, and pieces that came before those in front of them."""

    def __init__(self, keys: list[str], n: int, window: int, whitelist: frozenset[int]) -> None:
        self.keys, self.n, self.window, self.whitelist = keys, n, window, whitelist

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "position bigint, tokens binary")
        self.ahead = handle.getMapState("ahead", "start bigint", "tokens binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        position, tail = 0, np.zeros(0, np.int64)
        if before := self.tail.get():
            position, stored = before
            tail = np.frombuffer(stored, np.int64)
        old = {start: np.frombuffer(tokens, np.int64) for (start,), (tokens,) in self.ahead.iterator()}
        pieces, base = dict(old), position - len(tail)
        for part in rows:
            for start, tokens in zip(part["start"].tolist(), part["tokens"]):
                add_piece(pieces, start, tokens)
        position, ids = go_on(position, tail, pieces)
        for start in old.keys() - pieces.keys():
            self.ahead.removeKey((start,))
        for start, tokens in pieces.items():
            if start not in old or len(tokens) > len(old[start]):
                self.ahead.updateValue((start,), (tokens.tobytes(),))
        if len(ids) == len(tail):
            return
        self.tail.update((position, ids[-self.window :].tobytes()))
        if len(ids) > self.n:
            _, at, earlier = repeats_of([ids], self.n, self.window, self.whitelist)
            own = at >= len(tail)
            columns = dict(zip(self.keys, ([value] * int(own.sum()) for value in key)))
            yield pd.DataFrame({**columns, "position": at[own] + base, "earlier_start": earlier[own] + base})

    def close(self) -> None:
        pass


class LastTokensOfGroup(StatefulProcessor):
    """:class:`LastTokens` for a group of texts: a row of state for each text and each piece that waits.

    A call and the state of a text would cost more than what is done with its tokens.
    """

    def __init__(self, keys: T.StructType, n: int, window: int, whitelist: frozenset[int]) -> None:
        self.keys, self.n, self.window, self.whitelist = keys, n, window, whitelist

    def init(self, handle: StatefulProcessorHandle) -> None:
        fixed = [("start", T.LongType()), ("ahead", T.BooleanType()), ("tokens", T.BinaryType())]
        self.texts = handle.getListState("texts", T.StructType([*self.keys, *(T.StructField(*f) for f in fixed)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ends: dict[tuple, tuple[int, np.ndarray]] = {}
        pieces: dict[tuple, dict[int, np.ndarray]] = {}
        for *text, start, ahead, tokens in self.texts.get():
            ids = np.frombuffer(tokens, np.int64)
            if ahead:
                pieces.setdefault(tuple(text), {})[start] = ids
            else:
                ends[tuple(text)] = start, ids
        arrived = set()
        for part in rows:
            texts = [part[name].tolist() for name in self.keys.names]
            for *text, start, tokens in zip(*texts, part["start"].tolist(), part["tokens"]):
                arrived.add(tuple(text))
                add_piece(pieces.setdefault(tuple(text), {}), start, tokens)
        longer: list[tuple[tuple, np.ndarray, int, int]] = []
        for text in arrived:
            position, tail = ends.get(text, (0, np.zeros(0, np.int64)))
            end, ids = go_on(position, tail, pieces[text])
            if len(ids) > len(tail):
                ends[text] = end, ids[-self.window :]
                if len(ids) > self.n:
                    longer.append((text, ids, len(tail), position - len(tail)))
        state = [(*text, position, False, tail.tobytes()) for text, (position, tail) in ends.items()]
        state += [(*text, start, True, ids.tobytes()) for text, own in pieces.items() for start, ids in own.items()]
        if state:
            self.texts.put(state)
        for i in range(0, len(longer), ROWS_AT_ONCE):
            texts, ids, known, base = zip(*longer[i : i + ROWS_AT_ONCE])
            of, at, earlier = repeats_of(ids, self.n, self.window, self.whitelist)
            own = at >= np.array(known)[of]
            of, at, earlier = of[own], at[own], earlier[own]
            if len(of):
                columns = zip(*(texts[j] for j in of.tolist()))
                base = np.array(base)[of]
                yield pd.DataFrame({**dict(zip(self.keys.names, map(list, columns))), "position": at + base, "earlier_start": earlier + base})

    def close(self) -> None:
        pass


def stream_repeated_ngrams(
    pieces: DataFrame,
    n: int = C.REPETITION_SETTINGS["service"][0],
    window: int = C.REPETITION_SETTINGS["service"][1],
    whitelist: Collection[int] = C.REPETITION_WHITELIST,
    tokens: str = "token_ids",
    start: str = "start",
    keys: Collection[str] = PAGE_KEYS,
) -> DataFrame:
    """``repeated_ngrams`` on a stream of pieces of token arrays, as soon as the tokens are there.

    ``start`` is the position of a piece's first token. However the tokens are cut into pieces
    and triggers, the rows are those of the whole array. A piece that comes before the one in
    front of it waits; tokens that come again are passed over; empty and null pieces, and those
    without a start, are left out. The state of a key is its last ``window`` tokens and the
    pieces that wait, without expiry. Texts whose keys are whole numbers and strings share the
    state and the calls of one of ``TEXT_GROUPS`` groups; others have their own.
    """
    if n < 1 or window < 1:
        raise ValueError("n and window must be at least 1")
    keys = list(keys)
    # A single token is never a repeat.
    given = pieces.filter((F.size(tokens) > 0) & F.col(start).isNotNull() & F.lit(n > 1))
    fields = pieces.select(*keys).schema
    given = given.select(*keys, F.col(start).cast("bigint").alias("start"), F.col(tokens).cast("array<bigint>").alias("tokens"))
    found = [T.StructField("position", T.LongType()), T.StructField("earlier_start", T.LongType())]
    processor = n, window, frozenset(whitelist)
    if keys and all(f.dataType in GROUPED_KEYS for f in fields):
        # Among nulls pandas makes numbers doubles, so what is null is told by a number of its own.
        nulls = sum((F.col(key).isNull().cast("bigint") * (1 << i) for i, key in enumerate(keys)), F.lit(0).cast("bigint"))
        known = [F.coalesce(key, F.lit("" if f.dataType == T.StringType() else 0).cast(f.dataType)).alias(f"key{i}") for i, (key, f) in enumerate(zip(keys, fields))]
        # Plain names, since Python gets no others.
        inner = T.StructType([*(T.StructField(f"key{i}", f.dataType) for i, f in enumerate(fields)), T.StructField("nulls", T.LongType())])
        rows = (
            given.select(*known, nulls.alias("nulls"), "start", "tokens")
            .withColumn("_texts", F.pmod(F.xxhash64(*inner.names), F.lit(TEXT_GROUPS)))
            .groupBy("_texts")
            .transformWithStateInPandas(LastTokensOfGroup(inner, *processor), T.StructType([*inner, *found]), "append", "none")
        )
        there = [F.when(F.expr(f"nulls & {1 << i} = 0"), F.col(f"key{i}")).alias(key) for i, key in enumerate(keys)]
        return rows.select(*there, "position", "earlier_start")
    schema = T.StructType([*fields, *found])
    return given.groupBy(*keys).transformWithStateInPandas(LastTokens(keys, *processor), schema, "append", "none")
