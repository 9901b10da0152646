"""Long signals: correlation over many lags by FFT in blocks, refinement of a lag, drift along a recording, spectra of frames.

Samples are rows (keys, i, x). A block and what its lags reach of the other signal meet in one task; nothing longer does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _dense(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Samples at their places; what is missing is 0, of repeated places the values add up."""
    return np.bincount(at, weights=values, minlength=size)


def lag_sums(left: DataFrame, right: DataFrame, keys: list[str], *, lags: tuple[int, int], block: int = 1 << 14) -> DataFrame:
    """keys, lag, total: sums of x[i] * y[i + lag] over all samples, for each lag from the first to the last of `lags`.

    left: keys, i, x; right: keys, i, y. Missing and null samples are 0. Overlap-save: the left signal is cut into blocks, the right one into what
    the lags reach from there, one FFT product a block; sums by lag meet afterwards. A block is no shorter than the range of lags, so that a
    right sample goes to three blocks at most. Whole numbers (of types that hold only such) give exact longs as long as a block's sums stay below 2^50.
    Keys that only one side has give no row.
    """
    low, high = lags
    block = max(block, high - low + 1)
    whole = all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for df, c in ((left, "x"), (right, "y")))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    a = left.where("x is not null").select(*keys, F.floor(F.col("i") / block).alias("b"), F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("v"), F.lit(0).alias("side"))
    # right sample j serves the lags of blocks b with b * block + low <= j < (b + 1) * block + high
    first, last = F.floor((F.col("i") - high) / block), F.floor((F.col("i") - low) / block)
    b = right.where("y is not null").select(*keys, F.explode(F.sequence(first, last)).alias("b"), F.col("i").cast("long").alias("i"), F.col("y").cast("double").alias("v"), F.lit(1).alias("side"))

    def correlate(rows: pd.DataFrame) -> pd.DataFrame:
        start, own = int(rows["b"].iloc[0]) * block, rows["side"] == 0
        x = _dense(rows["i"][own].to_numpy() - start, rows["v"][own].to_numpy(), block)
        at = rows["i"][~own].to_numpy() - start - low
        there = (at >= 0) & (at < block + high - low)
        y = _dense(at[there], rows["v"][~own].to_numpy()[there], block + high - low)
        size = 1 << (len(x) + len(y) - 1).bit_length()
        product = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)[: high - low + 1]
        out = pd.DataFrame({"lag": np.arange(low, high + 1), "total": np.rint(product) if whole else product})
        for key in keys:
            out[key] = rows[key].iloc[0]
        return out[[*keys, "lag", "total"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "lag long", "total double"])
    both = [*keys, "b"]
    met = a.join(b.select(*both).distinct(), both, "left_semi").unionByName(b.join(a.select(*both).distinct(), both, "left_semi"))
    sums = met.groupBy(*both).applyInPandas(correlate, schema)
    total = F.sum(F.col("total").cast("long")) if whole else F.sum("total")
    return sums.groupBy(*keys, "lag").agg(total.alias("total"))


def best_lags(sums: DataFrame, keys: list[str], *, signless: bool = False) -> DataFrame:
    """keys, lag, total: the lag of the largest total (of the largest absolute one if signless); ties to the lag nearest to 0, then the smaller."""
    size = F.abs("total") if signless else F.col("total")
    best = sums.groupBy(*keys).agg(F.min(F.struct((-size).alias("t"), F.abs("lag").alias("d"), "lag", "total")).alias("b"))
    return best.select(*keys, "b.lag", "b.total")


def refined_lags(left: DataFrame, right: DataFrame, coarse: DataFrame, keys: list[str], *, step: int, radius: int, block: int = 1 << 14) -> DataFrame:
    """keys, lag, total: the best lag within `radius` samples of step * coarse lag, for signals `step` times finer than those the coarse lag (keys, lag) was found on.

    The left signal is shifted by the coarse lag first, so that all keys share one short range of lags.
    """
    at = coarse.select(*keys, (F.col("lag") * step).alias("_c"))
    shifted = left.join(at, keys).select(*keys, (F.col("i") + F.col("_c")).alias("i"), "x")
    near = best_lags(lag_sums(shifted, right, keys, lags=(-radius, radius), block=block), keys)
    return near.join(at, keys).select(*keys, (F.col("lag") + F.col("_c")).alias("lag"), "total")


def local_lags(left: DataFrame, right: DataFrame, keys: list[str], *, window: int, lags: tuple[int, int]) -> DataFrame:
    """keys, part, lag, total: the best lag of each stretch of `window` samples of the left signal by itself."""
    parts = left.withColumn("part", F.floor(F.col("i") / window))
    low, high = lags
    reach = F.explode(F.sequence(F.floor((F.col("i") - high) / window), F.floor((F.col("i") - low) / window)))
    return best_lags(lag_sums(parts, right.withColumn("part", reach), [*keys, "part"], lags=lags, block=window), [*keys, "part"])


def drift(probes: DataFrame, keys: list[str], *, window: int) -> DataFrame:
    """keys, slope, start, n, off: a robust line through local lags (keys, part, lag).

    slope: samples of lag a sample, the median over the pairs of parts that are half of all parts apart; start: the median of what is left at sample 0;
    off: the median distance from the line. Null slope where there is one part only.
    """
    at = F.col("part") * window
    ordered = Window.partitionBy(*keys).orderBy("part")
    rows = probes.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).withColumn("_k", F.row_number().over(ordered))
    half = rows.select(*keys, (F.col("_k") - F.floor(F.col("_n") / 2)).alias("_k"), F.col("part").alias("_p"), F.col("lag").alias("_l")).where("_k >= 1")
    pairs = rows.where("_n > 1").join(half, [*keys, "_k"]).where(F.col("_p") > F.col("part"))
    slopes = pairs.groupBy(*keys).agg(F.percentile((F.col("_l") - F.col("lag")) / ((F.col("_p") - F.col("part")) * window), 0.5).alias("slope"))
    lines = rows.join(slopes, keys, "left").withColumn("_r", F.col("lag") - F.coalesce("slope", F.lit(0.0)) * at)
    starts = lines.groupBy(*keys).agg(F.percentile("_r", 0.5).alias("start"), F.count("*").alias("n"))
    return lines.join(starts, keys).groupBy(*keys, "slope", "start", "n").agg(F.percentile(F.abs(F.col("_r") - F.col("start")), 0.5).alias("off"))


#: Upper edges of the bands whose shares of the energy are returned, in Hz
BANDS = (300.0, 1000.0, 3000.0)


def frame_features(samples: DataFrame, keys: list[str], *, rate: int, frame: int) -> DataFrame:
    """keys, frame, rms, zcr, centroid, rolloff, flatness, bands: features of each whole frame of `frame` samples.

    samples: keys, i (from 0, no gaps), x. zcr: sign changes a sample; centroid: mean frequency by magnitude of the Hann-windowed spectrum; rolloff: the
    frequency below which 85 % of the energy lies; flatness: geometric over arithmetic mean of the energy; bands: shares of the energy
    below each of BANDS and above the last. A silent frame has rms 0 and nulls. Null samples are 0. A frame that isn't whole is left out.
    """
    rows = samples.select(*keys, F.floor(F.col("i") / frame).alias("frame"), "i", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"))
    frames = rows.groupBy(*keys, "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x")).where(F.size("x") == frame)
    window, frequency = np.hanning(frame), np.fft.rfftfreq(frame, 1 / rate)

    def features(arrays: pd.Series) -> pd.DataFrame:
        out = []
        for x in arrays:
            rms = float(np.sqrt(np.mean(x * x)))
            if rms == 0:
                out.append((0.0, None, None, None, None, None))
                continue
            zcr = float(np.mean(np.signbit(x[1:]) != np.signbit(x[:-1])))
            magnitude = np.abs(np.fft.rfft(x * window))
            energy = magnitude**2
            upto = np.cumsum(energy) / energy.sum()
            edges = np.searchsorted(frequency, BANDS)
            shares = np.diff(np.concatenate(([0], upto[edges - 1], [1])))
            out.append((rms, zcr, float((frequency * magnitude).sum() / magnitude.sum()), float(frequency[np.searchsorted(upto, 0.85)]), float(np.exp(np.mean(np.log(energy + 1e-20))) / energy.mean()), shares.tolist()))
        return pd.DataFrame(out, columns=["rms", "zcr", "centroid", "rolloff", "flatness", "bands"]).astype({c: "float64" for c in ("rms", "zcr", "centroid", "rolloff", "flatness")})

    kind = "rms double, zcr double, centroid double, rolloff double, flatness double, bands array<double>"
    made = frames.select(*keys, "frame", F.pandas_udf(features, kind)("x").alias("f"))
    return made.select(*keys, "frame", "f.*")


def stereo_levels(samples: DataFrame, keys: list[str], spans: DataFrame, ident: str) -> DataFrame:
    """keys, ident, n, rms_left, rms_right, lr_db, mono_db, crest, agreement: levels of two channels within each span.

    samples: keys, i, left, right; spans: keys, ident, s, e (samples, e exclusive; as short as captions are). lr_db: left over right; mono_db: of their mean; crest: peak over
    RMS of the mean; agreement: correlation of the channels, null without variance. Silence counts as 1e-12. Spans without samples have no row.
    """
    from tessera.operators.intervals import overlap_join

    points = samples.select(*keys, "left", "right", F.col("i").alias("rs"), (F.col("i") + 1).alias("re"))
    inside = overlap_join(spans.select(*keys, ident, F.col("s").alias("ls"), F.col("e").alias("le")), points, keys, width=1 << 14)
    mono = (F.col("left") + F.col("right")) / 2

    def rms(x):
        return F.sqrt(F.avg(x * x))

    def db(x):
        return 20 * F.log10(F.greatest(x, F.lit(1e-12)))

    level = inside.groupBy(*keys, ident).agg(
        F.count("*").alias("n"), rms(F.col("left")).alias("rms_left"), rms(F.col("right")).alias("rms_right"), rms(mono).alias("_mono"), F.max(F.abs(mono)).alias("_peak"),
        F.when((F.stddev_pop("left") > 1e-12) & (F.stddev_pop("right") > 1e-12), F.try_divide(F.covar_pop("left", "right"), F.stddev_pop("left") * F.stddev_pop("right"))).alias("agreement"),
    )
    lr = db(F.col("rms_left")) - db(F.col("rms_right"))
    return level.select(*keys, ident, "n", "rms_left", "rms_right", lr.alias("lr_db"), db(F.col("_mono")).alias("mono_db"), F.try_divide("_peak", "_mono").alias("crest"), "agreement")


def speaker_roles(features: DataFrame, keys: list[str], ident: str, columns: list[str], anchors: DataFrame, *, sure: float, smooth: float) -> DataFrame:
    """keys, ident, role, confidence, reason: the role of each caption by its features, from captions whose role is known.

    features: keys, ident, s, e and numeric columns; anchors: keys, ident, role. Columns are brought to mean 0 and deviation 1 within a key;
    the profile of a role is the mean of its anchors. A caption takes the role of the nearest profile (ties to the smaller name); confidence is
    1 - nearest / (nearest + second), `anchor` is 1. Below `sure` it is `ambiguous` and keeps the nearest role, unless, below `smooth`, the
    captions before and behind it agree on another: then it takes theirs (`neighbours`). Keys without anchors have no row.
    """
    whole = Window.partitionBy(*keys)

    def unit(c: str):
        sd = F.stddev_pop(c).over(whole)
        return F.when(sd > 1e-12, (F.coalesce(F.col(c), F.avg(c).over(whole)) - F.avg(c).over(whole)) / sd).otherwise(0.0)

    scaled = features.select(*keys, ident, "s", "e", F.array(*(F.coalesce(unit(c), F.lit(0.0)) for c in columns)).alias("z"))
    known = anchors.select(*keys, ident, "role").where("role is not null").groupBy(*keys, ident).agg(F.min("role").alias("known"))
    marked = scaled.join(known, [*keys, ident], "left")
    means = marked.where("known is not null").groupBy(*keys, F.col("known").alias("role")).agg(F.array(*(F.avg(F.col("z")[i]) for i in range(len(columns)))).alias("m"))
    profiles = means.groupBy(*keys).agg(F.collect_list(F.struct("role", "m")).alias("profiles"))  # as many as there are roles
    d = F.transform("profiles", lambda p: F.struct(F.round(F.sqrt(F.aggregate(F.zip_with("z", p["m"], lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, y: a + y)), 9).alias("d"), p["role"].alias("role")))
    near = marked.join(profiles, keys).withColumn("d", F.array_sort(d))
    first, second = F.element_at("d", 1), F.try_element_at("d", F.lit(2))
    own = F.round(F.when(second.isNull(), 1.0).when(first["d"] + second["d"] == 0, 0.5).otherwise(1 - first["d"] / (first["d"] + second["d"])), 6)
    rows = near.withColumn("_role", F.coalesce("known", first["role"])).withColumn("confidence", F.when(F.col("known").isNotNull(), 1.0).otherwise(own))
    order = Window.partitionBy(*keys).orderBy("s", "e", ident)
    before, behind = F.lag("_role").over(order), F.lead("_role").over(order)
    agree = (F.col("confidence") < smooth) & (before == behind) & (before != F.col("_role")) & F.col("known").isNull()
    role = F.when(F.coalesce(agree, F.lit(False)), before).otherwise(F.col("_role"))
    reason = F.when(F.col("known").isNotNull(), "anchor").when(F.coalesce(agree, F.lit(False)), "neighbours").when(F.col("confidence") < sure, "ambiguous").otherwise("profile")
    return rows.select(*keys, ident, role.alias("role"), "confidence", reason.alias("reason"))
