"""Request timing while spans and responses arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docflow import constants as C
from docflow.operators.metrics import timing_of

# Spans are added up as whole parts of a millisecond, so their order does not matter.
PARTS = 1_000_000


class Spans(StatefulProcessor):
    """The sum of each step of a request, and its total once the response is there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "step string", "parts bigint")
        self.total = handle.getValueState("total", "ms double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The sums are read once, and each that changes is written once.
        sums = {step: parts for (step,), (parts,) in self.sums.iterator()}
        changed, totals = set(), []
        for part in rows:
            for step, parts, total in zip(part["step"].tolist(), part["parts"].tolist(), part["total_ms"].tolist()):
                if not pd.isna(step):
                    sums[step] = sums.get(step, 0) + int(parts)
                    changed.add(step)
                if not pd.isna(total):
                    totals.append(float(total))
        for step in changed:
            self.sums.updateValue((step,), (sums[step],))
        if totals:
            self.total.update((max(totals),))
        total = (max(totals),) if totals else self.total.get()
        if total:
            yield pd.DataFrame({"request_id": [key[0]], "total": [total[0]], "sums": [sums]})

    def close(self) -> None:
        pass


def stream_request_timing(
    spans: DataFrame, totals: DataFrame, steps: Sequence[str] = C.TIMING_STEPS
) -> DataFrame:
    """``request_timing`` of two streams, in update mode: a row whenever a request's timing changes.

    ``spans`` has ``request_id``, ``step``, ``ms``, and ``totals``, the responses, ``request_id`` and
    ``total_ms``. A span may come before, with or after its response; a request has a row from
    its response on. The last row of a request is that of ``request_timing`` on all rows. Spans
    without a step or time count nothing, and a null request_id is left out. The state of a request is one sum per step, without expiry.
    """
    parts = F.round(F.greatest(F.col("ms"), F.lit(0)) * PARTS).cast("bigint")
    nothing = F.lit(None)
    events = spans.filter("step is not null and ms is not null").select(
        F.col("request_id").cast("bigint").alias("request_id"), "step", parts.alias("parts"), nothing.cast("double").alias("total_ms")
    ).unionByName(
        totals.select(
            F.col("request_id").cast("bigint").alias("request_id"), nothing.cast("string").alias("step"),
            F.lit(0).cast("bigint").alias("parts"), F.col("total_ms").cast("double").alias("total_ms"),
        )
    )
    found = events.filter("request_id is not null").groupBy("request_id").transformWithStateInPandas(
        Spans(), "request_id bigint, total double, sums map<string, bigint>", "update", "none"
    )
    spent = F.aggregate(F.map_values("sums"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return timing_of(
        found.select(
            "request_id",
            F.col("total").alias("_total"),
            F.when(F.size("sums") > 0, spent / PARTS).alias("_accounted"),
            F.transform_values("sums", lambda step, n: n / PARTS).alias("_steps"),
        ),
        steps,
    )
