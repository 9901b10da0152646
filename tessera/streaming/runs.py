"""Streaming forms of stateful interval operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_islands(events: DataFrame, key: str, at: str, *, gap: str, late: str) -> DataFrame:
    """key, s, e, n: runs of a key's events less than `gap` apart, each once it can't grow any more (append mode).

    Rows later than `late` behind the newest are dropped, as a watermark does.
    """
    runs = events.withWatermark(at, late).groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n")


def stream_role_changes(events: DataFrame, key: str, role: str, order: str) -> DataFrame:
    """key, from_role, to_role, at: each change of a key's role, in the order of `order` within a batch.

    State per key: its last role. events need (key long, role string, order timestamp). Use output mode append.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values(order, kind="stable").itertuples():
            now = getattr(r, role)
            if last is not None and now != last:
                out.append((k[0], last, now, getattr(r, order)))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "from_role", "to_role", "at"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, from_role string, to_role string, at timestamp", "role string", "append", "NoTimeout")
