"""Envelopes and lags of sampled signals. Samples are rows; only short windows meet in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def envelope(df: DataFrame, keys: list[str], index: str, value: str, frame: int) -> DataFrame:
    """keys, frame, z: log1p(50 * RMS) of each frame, as a z-score (population deviation) within its key."""
    rms = df.groupBy(*keys, F.floor(F.col(index) / frame).alias("frame")).agg(F.log1p(50 * F.sqrt(F.avg(F.col(value) * F.col(value)))).alias("_v"))
    own = Window.partitionBy(*keys)
    sd = F.stddev_pop("_v").over(own)
    return rms.withColumn("z", F.when(sd > 1e-12, (F.col("_v") - F.avg("_v").over(own)) / sd).otherwise(0.0)).drop("_v")


def _samples(x) -> np.ndarray:
    """An array of doubles; none for null."""
    return np.zeros(0) if x is None else np.asarray(x, float)


def best_lag(probe: np.ndarray, target: np.ndarray) -> tuple[int, float]:
    """(lag, score): where the probe lies best in the target, by normalised cross-correlation; the first of equal ones."""
    n = len(probe)
    if n == 0 or len(target) < n:
        return 0, 0.0
    p = probe - probe.mean()
    windows = np.lib.stride_tricks.sliding_window_view(target, n)
    w = windows - windows.mean(1, keepdims=True)
    scale = np.sqrt((p**2).sum() * (w**2).sum(1))
    score = np.where(scale > 1e-12, w @ p / np.maximum(scale, 1e-12), 0.0)
    at = int(np.argmax(np.round(score, 12)))
    return at, float(score[at])


def lags(pairs: DataFrame) -> DataFrame:
    """pairs (probe, target: arrays of doubles, and other columns) with struct `match` (lag, score); null arrays are empty ones: lag 0, score 0."""

    def match(probe: pd.Series, target: pd.Series) -> pd.DataFrame:
        found = [best_lag(_samples(p), _samples(t)) for p, t in zip(probe, target, strict=True)]
        return pd.DataFrame(found, columns=["lag", "score"])

    return pairs.withColumn("match", F.pandas_udf(match, "lag int, score double")("probe", "target"))


def silent_runs(df: DataFrame, keys: list[str], frame: str, level: str, floor: float, least: int) -> DataFrame:
    """keys, s, e, n: runs of at least `least` frames in a row below the floor (frame numbers, e exclusive)."""
    order = Window.partitionBy(*keys).orderBy(frame)
    quiet = df.where(F.col(level) < floor).withColumn("_g", F.col(frame) - F.row_number().over(order))
    return quiet.groupBy(*keys, "_g").agg(F.min(frame).alias("s"), (F.max(frame) + 1).alias("e"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_g")


def transients(df: DataFrame, keys: list[str], frame: str, level: str, *, width: int) -> DataFrame:
    """keys, frame, rise: how far a frame's level is above the mean of the frames around it (`width` on either side), 0 where it isn't."""
    around = F.avg(level).over(Window.partitionBy(*keys).orderBy(frame).rowsBetween(-width, width))
    return df.select(*keys, frame, F.greatest(F.lit(0.0), F.col(level) - around).alias("rise"))


def active_span(df: DataFrame, keys: list[str], frame: str, level: str, *, share: float, floor: float) -> DataFrame:
    """keys, first, last, active: the frames at or above the larger of a percentile of the key's levels and a floor; no row where none is."""
    bound = df.groupBy(*keys).agg(F.greatest(F.percentile(level, share), F.lit(floor)).alias("_bound"))
    loud = df.join(bound, keys).where(F.col(level) >= F.col("_bound"))
    return loud.groupBy(*keys).agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("active"))


def quietest(points: DataFrame, frames: DataFrame, keys: list[str], ident: str, *, before: int, behind: int) -> DataFrame:
    """keys, ident, at: for each point (keys, ident, s) the quietest frame (keys, at, level) from `before` ahead of it to `behind` after it; ties to the nearer, then earlier."""
    from tessera.operators.intervals import overlap_join

    left = points.select(*keys, ident, F.col("s").alias("_at"), (F.col("s") - before).alias("ls"), (F.col("s") + behind + 1).alias("le"))
    right = frames.select(*keys, "level", F.col("at").alias("rs"), (F.col("at") + 1).alias("re"))
    rank = F.struct("level", F.abs(F.col("rs") - F.col("_at")).alias("d"), F.col("rs").alias("at"))
    return overlap_join(left, right, keys).groupBy(*keys, ident).agg(F.min(rank).alias("b")).select(*keys, ident, "b.at")


def window_lags(pairs: DataFrame, *, window: int, hop: int, flat: float = 0.05) -> DataFrame:
    """pairs (probe, target) with struct `match` (start, lag, score): the best place in the target of any window of the probe.

    Windows begin every `hop` samples; those whose deviation is below `flat` are skipped. lag is where the window lies in the
    target less where it begins; ties to the first window. Nulls where every window is flat or too long.
    """

    def match(probe: pd.Series, target: pd.Series) -> pd.DataFrame:
        rows = []
        for p, t in zip(probe, target, strict=True):
            p, t, best = _samples(p), _samples(t), (None, None, None)
            for start in range(0, len(p) - window + 1, hop):
                part = p[start : start + window]
                if part.std() < flat or len(t) < window:
                    continue
                lag, score = best_lag(part, t)
                if best[2] is None or score > best[2]:
                    best = (start, lag - start, score)
            rows.append(best)
        return pd.DataFrame(rows, columns=["start", "lag", "score"]).astype({"start": "Int32", "lag": "Int32", "score": "float64"})

    return pairs.withColumn("match", F.pandas_udf(match, "start int, lag int, score double")("probe", "target"))
