"""Queues of page requests on a stream: batches that close by count, by time or by a timer.

The rows of an open batch wait in list state. A batch closes when it is full, when an
arrival comes at or after the end of its wait, or, if none comes, when a
processing-time timer runs out; so an idle queue never keeps a page. What is done with a
closed batch is up to the operator: :func:`close_events` tells its size and waits,
:func:`score_microbatches` hands it to a scorer and gives each request its results.

Sessions need ``spark.python.unix.domain.socket.enabled`` so that state is reached by a
socket file; :func:`docflow.session.build_session` sets it.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docflow import constants as C
from docflow.operators.scoring import Scorer, run_scorer_on_each, worker_object

FULL, NEXT, IDLE = "full", "next", "idle"
Closed = Callable[[tuple, list[tuple]], pd.DataFrame]
# Rows of closed batches that are handed over at a time.
OUT_ROWS = 10_000
# Groups of queues whose open batches are one list of state each.
QUEUE_GROUPS = 4096
# Keys whose values are equal in Python exactly if they are in Spark.
GROUPED_KEYS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.StringType())


def closed_batches(times: list[int], max_wait: int, max_rows: int) -> Iterator[tuple[int, int, str, int]]:
    """First row, end, reason and closing time of each batch of a queue that closes; the rest is open."""
    latest = list(accumulate(times, max))
    start = 0
    while start < len(times):
        # An arrival that came late belongs to the batch open now.
        limit, end = times[start] + max_wait, min(start + max_rows, len(times))
        if latest[end - 1] >= limit:
            end = max(start + 1, next((i for i in range(start, end) if times[i] >= limit), end))
        if end - start == max_rows:
            yield start, end, FULL, times[end - 1]
        elif end < len(times):
            yield start, end, NEXT, limit
        else:
            return
        start = end


class Queue(StatefulProcessor):
    """The open batch of one queue. ``closed`` gets the key and the batches that closed, and gives their rows.

    A batch is its rows as tuples, the reason and the closing time. Those of a trigger are handed
    over together, at most about ``OUT_ROWS`` rows at a time, since a frame for each would cost
    more than what is done with them.
    """

    def __init__(
        self,
        schema: T.StructType,
        time: str,
        tie: str,
        max_wait: int,
        max_rows: int,
        idle_ms: int,
        closed: Closed,
    ):
        self.schema, self.time, self.tie = schema, time, tie
        self.max_wait, self.max_rows, self.idle_ms, self.closed = max_wait, max_rows, idle_ms, closed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def _set_timer(self, now: int | None, waited: bool) -> None:
        """One timer, for the batch that is open; none if there is no such batch, nor was one if no row ``waited``."""
        for at in list(self.handle.listTimers()) if waited else ():
            self.handle.deleteTimer(at)
        if now is not None:
            self.handle.registerTimer(now + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(row) for row in self.waiting.get()]
        new = pd.concat(rows).sort_values([self.time, self.tie], kind="stable")
        batch = old + list(new[self.schema.names].itertuples(index=False, name=None))
        at = self.schema.names.index(self.time)
        times = [int(row[at]) for row in batch]
        start, changed, done, held = 0, not old, [], 0
        for begin, start, why, closed_at in closed_batches(times, self.max_wait, self.max_rows):
            done.append((batch[begin:start], why, closed_at))
            held += start - begin
            changed = True
            if held >= OUT_ROWS:
                yield self.closed(key, done)
                done, held = [], 0
        if done:
            yield self.closed(key, done)
        if start < len(batch):
            self.waiting.put(batch[start:])
        elif old:
            self.waiting.clear()
        if changed:
            self._set_timer(timerValues.getCurrentProcessingTimeInMs() if start < len(batch) else None, bool(old))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch = [tuple(row) for row in self.waiting.get()]
        if batch:
            opened = batch[0][self.schema.names.index(self.time)]
            self.waiting.clear()
            yield self.closed(key, [(batch, IDLE, int(opened) + self.max_wait)])

    def close(self) -> None:
        pass


class Queues(StatefulProcessor):
    """The open batches of a group of queues, as :class:`Queue` has that of one.

    A call of the processor and its calls to the state cost more than a queue's rows, so they are made once
    for the queues of a group. The state is one list, of the rows of a queue after each other, in their order, each with the
    time at which its batch is idle. One timer a trigger is set for the batches that it opened; a batch
    that has closed by then is not in the list any more.
    """

    def __init__(
        self,
        schema: T.StructType,
        key: str,
        time: str,
        tie: str,
        max_wait: int,
        max_rows: int,
        idle_ms: int,
        closed: Callable[[list[tuple]], pd.DataFrame],
    ):
        self.schema, self.key, self.time, self.tie = schema, key, time, tie
        self.max_wait, self.max_rows, self.idle_ms, self.closed = max_wait, max_rows, idle_ms, closed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([*self.schema, T.StructField("idle_at", T.LongType())]))

    def _open(self) -> dict[object, tuple[int, list[tuple]]]:
        """Of each queue with an open batch, when it is idle, and its rows."""
        at = self.schema.names.index(self.key)
        found: dict[object, tuple[int, list[tuple]]] = {}
        for *row, idle_at in self.waiting.get():
            found.setdefault(row[at], (idle_at, []))[1].append(tuple(row))
        return found

    def _keep(self, queues: dict[object, tuple[int, list[tuple]]]) -> None:
        rows = [(*row, idle_at) for idle_at, own in queues.values() for row in own]
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, queues = self.schema.names, self._open()
        new = pd.concat(rows).sort_values([self.time, self.tie], kind="stable")
        columns = [new[name].tolist() for name in names]
        if new[self.key].isna().any():
            # Null keys are a group of their own.
            columns[names.index(self.key)] = [None] * len(new)
        arrived: dict[object, list[tuple]] = {}
        for queue, row in zip(columns[names.index(self.key)], zip(*columns)):
            arrived.setdefault(queue, []).append(row)
        at, done, held, opened = names.index(self.time), [], 0, False
        idle_at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        for queue, own in arrived.items():
            until, old = queues.pop(queue, (idle_at, []))
            batch, start = old + own, 0
            for begin, start, why, closed_at in closed_batches([int(row[at]) for row in batch], self.max_wait, self.max_rows):
                done.append((queue, batch[begin:start], why, closed_at))
                held += start - begin
                if held >= OUT_ROWS:
                    yield self.closed(done)
                    done, held = [], 0
            if start < len(batch):
                # A batch that was open before keeps its time.
                stays = start == 0 and bool(old)
                queues[queue] = until if stays else idle_at, batch[start:]
                opened = opened or not stays
        if done:
            yield self.closed(done)
        self._keep(queues)
        if opened:
            self.handle.registerTimer(idle_at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, queues, done = expiredTimerInfo.getExpiryTimeInMs(), self._open(), []
        for queue in [queue for queue, (idle_at, _) in queues.items() if idle_at <= now]:
            batch = queues.pop(queue)[1]
            done.append((queue, batch, IDLE, int(batch[0][self.schema.names.index(self.time)]) + self.max_wait))
        if done:
            self._keep(queues)
            yield self.closed(done)

    def close(self) -> None:
        pass


def _idle_time(arrivals: DataFrame, time: str, tie: str, max_wait: int, max_rows: int, idle_ms: int | None) -> int:
    """``idle_ms`` or what it is by default, once the arguments are checked."""
    if max_rows < 1 or max_wait < 0 or (idle_ms or 0) < 0:
        raise ValueError("max_rows must be at least 1, max_wait and idle_ms at least 0")
    for name in (time, tie):
        if not isinstance(arrivals.schema[name].dataType, T.LongType):
            raise ValueError(f"{name} must be a bigint")
    return -(-max_wait // 1000) if idle_ms is None else idle_ms


def _queued(
    arrivals: DataFrame,
    key: str,
    time: str,
    tie: str,
    max_wait: int,
    max_rows: int,
    idle_ms: int | None,
    closed: Closed,
    schema: T.StructType,
) -> DataFrame:
    idle_ms = _idle_time(arrivals, time, tie, max_wait, max_rows, idle_ms)
    columns = T.StructType([field for field in arrivals.schema if field.name != key])
    return arrivals.groupBy(key).transformWithStateInPandas(
        Queue(columns, time, tie, max_wait, max_rows, idle_ms, closed), schema, "append", "processingTime"
    )


def close_events(
    arrivals: DataFrame,
    key: str,
    time: str,
    tie: str,
    request: str,
    max_wait: int = C.DEFAULT_MAX_WAIT_MS * 1000,
    max_rows: int = C.DEFAULT_BATCH_PAGES,
    idle_ms: int | None = None,
) -> DataFrame:
    """A row for every batch that closes: when it opened and closed and why, its size and its waits.

    Times are in microseconds. A batch without a next arrival closes ``idle_ms`` of real time after
    the trigger that opened it, by default after ``max_wait``. Columns: the key, opened_at, opened_by (the ``tie`` of the
    first row), closed_at, reason (``full``, ``next`` or ``idle``), rows, requests, wait_p50 (the
    upper median of the time from arrival to closing) and wait_max. A null request counts as none.
    """

    idle = _idle_time(arrivals, time, tie, max_wait, max_rows, idle_ms)
    # The state has no other columns.
    arrivals = arrivals.select(*dict.fromkeys([key, time, tie, request]))
    grouped = arrivals.schema[key].dataType in GROUPED_KEYS
    columns = [name for name in arrivals.columns if grouped or name != key]
    at, by, who = (columns.index(name) for name in (time, tie, request))

    def event(queue: object, rows: list[tuple], why: str, closed_at: int) -> tuple:
        waits = sorted(closed_at - int(row[at]) for row in rows)
        requests = len({row[who] for row in rows if row[who] is not None})
        opened = int(rows[0][at]), int(rows[0][by])
        return (queue, *opened, closed_at, why, len(rows), requests, waits[len(waits) // 2], waits[-1])

    numbers = ("opened_at", "opened_by", "closed_at", "reason", "rows", "requests", "wait_p50", "wait_max")
    schema = T.StructType(
        [arrivals.schema[key]]
        + [T.StructField(n, T.StringType() if n == "reason" else T.LongType()) for n in numbers]
    )

    def closed(batches: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([event(*batch) for batch in batches], columns=schema.names)

    if not grouped:
        return _queued(
            arrivals, key, time, tie, max_wait, max_rows, idle_ms,
            lambda group, batches: closed([(group[0], *batch) for batch in batches]), schema,
        )
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(QUEUE_GROUPS)).cast("int"))
    return (
        arrivals.withColumn("_queues", group)
        .groupBy("_queues")
        .transformWithStateInPandas(
            Queues(arrivals.schema, key, time, tie, max_wait, max_rows, idle, closed), schema, "append", "processingTime"
        )
    )


def score_microbatches(
    arrivals: DataFrame,
    key: str,
    time: str,
    tie: str,
    scorer: Scorer,
    outputs: T.StructType,
    keep: list[str],
    max_wait: int = C.DEFAULT_MAX_WAIT_MS * 1000,
    max_rows: int = C.DEFAULT_BATCH_PAGES,
    idle_ms: int | None = None,
    make_scorer: Callable[[], Scorer] | None = None,
) -> DataFrame:
    """Pages of many requests scored in shared batches; a row for every page of a closed batch.

    ``keep`` names the arrival columns that tell whose page it is; ``outputs`` are the scorer's
    columns. An error, also a wrong number of outputs, goes to every page of the batch and so to all
    its requests. Adds ``opened_at`` and ``opened_by``, which name the batch within its queue,
    ``batch_rows``, ``wait`` until it closed, ``error`` and ``generate_s``. The state holds the payloads
    of open batches, fewer than ``max_rows`` for each queue. ``idle_ms`` is as for
    :func:`close_events`.
    """
    fixed = [T.StructField(n, T.LongType()) for n in ("opened_at", "opened_by", "batch_rows", "wait")]
    schema = T.StructType(
        [arrivals.schema[key], *[arrivals.schema[name] for name in keep], *fixed, *outputs.fields]
        + [T.StructField("error", T.StringType()), T.StructField("generate_s", T.DoubleType())]
    )
    names = schema.fieldNames()
    version = str(clock.time_ns())

    columns = [name for name in arrivals.columns if name != key]
    at, by = columns.index(time), columns.index(tie)
    kept = [(name, columns.index(name), isinstance(arrivals.schema[name].dataType, T.LongType)) for name in keep if name != key]

    def frames(group: tuple, batches: list[list[tuple]], every: list[tuple]) -> Iterator[pd.DataFrame]:
        """A frame for each batch, cut from one of all rows; with nulls, the types of a column may differ by batch."""
        whole = pd.DataFrame(every, columns=columns).assign(**{key: group[0]})
        alike, start = not whole[columns].isna().any(axis=None), 0
        for rows in batches:
            yield (
                whole.iloc[start : start + len(rows)].reset_index(drop=True)
                if alike
                else pd.DataFrame(rows, columns=columns).assign(**{key: group[0]})
            )
            start += len(rows)

    def closed(group: tuple, batches: list[tuple]) -> pd.DataFrame:
        run = worker_object("scorer", make_scorer, version) if make_scorer else scorer
        every = [row for rows, _, _ in batches for row in rows]
        scored = run_scorer_on_each(frames(group, [rows for rows, _, _ in batches], every), run, outputs)
        out = {name: [row[i] for row in every] for name, i, _ in kept}
        # Integers with nulls stay integers.
        out |= {name: pd.array(out[name], dtype="Int64") for name, _, whole in kept if whole}
        out[key] = [group[0]] * len(every)
        out["opened_at"] = [int(rows[0][at]) for rows, _, _ in batches for _ in rows]
        out["opened_by"] = [int(rows[0][by]) for rows, _, _ in batches for _ in rows]
        out["batch_rows"] = [len(rows) for rows, _, _ in batches for _ in rows]
        out["wait"] = [closed_at - int(row[at]) for rows, _, closed_at in batches for row in rows]
        return pd.DataFrame(out | scored)[names]

    return _queued(arrivals, key, time, tie, max_wait, max_rows, idle_ms, closed, schema)
