"""Boxes followed from frame to frame as frames arrive; tracks end by event time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.folds import follow_frames

#: seen: JSON of [track, frame, x, y] of the tracks last seen
_STATE = "made long, seen string, upto long"


def stream_tracks(boxes: DataFrame, key: str, at: str, *, far: float, memory: int, late: str, idle: int = 60) -> DataFrame:
    """key, frame, item, track: what folds.track gives for the same frames in order, a micro-batch at a time. Output mode append.

    boxes: key (long), frame, item (long), x, y, area, and the event time `at`. State by key: the tracks of the last `memory` frames, the number of
    tracks made, the last frame done. Frames of one batch are done in order. A frame that isn't behind the last one done is late: its boxes come out with track -1 and
    change nothing; boxes of a frame must arrive in one batch. Boxes older than the watermark (`late`) are dropped by Spark. A key that has been silent for `idle` seconds of
    event time, beyond the watermark, is forgotten: its state goes, and later boxes begin at track 0.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made, seen, upto = 0, {}, -1
        if state.exists:
            made, kept, upto = state.get
            seen = {t: (f, x, y) for t, f, x, y in json.loads(kept)}
        rows = pd.concat(list(batches))
        fresh = rows[rows["frame"] > upto]
        out = [(f, i, -1) for f, i in rows.loc[rows["frame"] <= upto, ["frame", "item"]].itertuples(index=False)]
        if len(fresh):
            done, made, seen = follow_frames(fresh, made, seen, far=far, memory=memory)
            out += done
            upto = int(fresh["frame"].max())
        state.update((made, json.dumps([(t, int(f), float(x), float(y)) for t, (f, x, y) in seen.items()]), upto))
        newest = int(rows[at].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1000 * idle)
        made_rows = pd.DataFrame(out, columns=["frame", "item", "track"])
        made_rows[key] = k[0]
        yield made_rows[[key, "frame", "item", "track"]]

    rows = boxes.withWatermark(at, late).select(key, F.col("frame").cast("long").alias("frame"), F.col("item").cast("long").alias("item"), "x", "y", "area", at)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, frame long, item long, track long", _STATE, "append", "EventTimeTimeout")
