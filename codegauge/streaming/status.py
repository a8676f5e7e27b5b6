"""Changes of a status in a stream, with the last status of each key kept as state across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Rows (key, order, status) at which a key's status changes; the first of each key counts, unless it is null. key and order: longs.

    Of a batch, a key's events are taken in order. An event that comes after one of its key with the same or a greater order, in an earlier batch or its
    own, is late or repeated, and is left out: what has been told isn't taken back. A null status is a status like any other; rows with a null key or order
    are left out. The state is two values a key, without expiry. Where each batch's events come after those before it, the result is that of
    a window with `lag` over all events.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")  # of one key and batch
        out = []
        for at, now in zip(rows[order].tolist(), rows[status].tolist(), strict=True):
            now = None if pd.isna(now) else now
            if last is not None and at <= last:
                continue
            if now != before:
                out.append((keys[0], at, now))
            last, before = at, now
        state.update((last, before))
        yield pd.DataFrame(out, columns=[key, order, status])

    rows = events.select(key, order, status).where(f"{key} IS NOT NULL AND {order} IS NOT NULL")
    schema = f"{key} long, {order} long, {status} string"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "last long, status string", "append", GroupStateTimeout.NoTimeout)
