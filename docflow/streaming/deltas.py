"""New text of growing snapshots on a stream."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_snapshot_deltas(
    snapshots: DataFrame,
    keys: Collection[str],
    order: str,
    text: str,
) -> DataFrame:
    """Text of each snapshot beyond the length of the one before it.

    The state of a key is one length, kept without expiry by the session's
    state store. Within a trigger the snapshots of a key are
    put in order; from trigger to trigger they must come in order. None is
    dropped.
    """
    keys = list(keys)
    names = [*keys, order, "delta"]

    def cut(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given = [row for part in parts for row in zip(part[order].tolist(), part[text].tolist())]
        given.sort(key=lambda row: (row[0] != row[0], row[0]))
        lengths = [len(value) for _, value in given]
        starts = [state.get[0] if state.exists else 0, *lengths[:-1]]
        state.update((lengths[-1],))
        new = [value[start:] for (_, value), start in zip(given, starts)]
        columns = (*([value] * len(given) for value in group), [at for at, _ in given], new)
        yield pd.DataFrame(dict(zip(names, columns)))

    fields = {f.name: f.dataType.simpleString() for f in snapshots.schema}
    schema = ", ".join([f"{name} {fields[name]}" for name in names[:-1]] + ["delta string"])
    return (
        snapshots.groupBy(*keys)
        .applyInPandasWithState(cut, schema, "seen bigint", "append", GroupStateTimeout.NoTimeout)
    )
