"""Robust and tie-exact aggregates: percentiles, trimmed means, robust z-scores, modes, profiles, centroids."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import checkpointed

#: Stretches of values that a key's rows are dealt into
_STRETCHES = 64


def _tally(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """_key, the value and how often it is there, cut from the input: what follows reads it several times."""
    # a struct of keys, so that null keys meet in joins too
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(value).alias("_v"))
    return checkpointed(rows.groupBy("_key", "_v").agg(F.count("*").alias("_c")))


def _picked(counts: DataFrame, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """_key, n and a column for each place, of tallied values."""
    bounds = counts.agg(F.percentile_approx(F.col("_v").cast("double"), [i / _STRETCHES for i in range(1, _STRETCHES)], 1000)).first()[0] or []
    bounds = F.array(*(F.lit(float(x)) for x in sorted(set(bounds)))).cast("array<double>")
    stretch = F.size(F.filter(bounds, lambda x: F.col("_v").cast("double") >= x))
    rows = counts.withColumn("_b", stretch)
    own = Window.partitionBy("_key")
    ahead = own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_key", "_b").agg(F.sum("_c").alias("_s")).select("_key", "_b", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_base"), F.sum("_s").over(own).alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy("_key", "_b").orderBy("_v")) + F.col("_base")
    placed = rows.join(sums, ["_key", "_b"]).withColumn("_to", upto)
    picks = [F.max(F.when((place(F.col("_n")) < F.col("_to")) & (place(F.col("_n")) >= F.col("_to") - F.col("_c")), F.col("_v"))).alias(name) for name, place in places.items()]
    return placed.groupBy("_key").agg(F.max("_n").alias("n"), *picks)


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n and a column for each place: the value that stands there (from 0) among the key's sorted values; places: functions of n.

    Equal values are counted first, and dealt by key and stretch of values, so that a key that holds most rows spreads over
    tasks; only counts by stretch meet. The stretches' bounds are approximate percentiles of all values: 63 numbers at most.
    Nulls don't count; a key without values has no row; a null key is a key.
    """
    found = _picked(_tally(df, keys, value), places)
    return found.select(*(F.col(f"_key.{k}").alias(k) for k in keys), "n", *places)


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and a column for each share: the value at place round((n - 1) * share), halves to even, of the sorted values."""
    return order_statistics(df, keys, value, {name: partial(lambda p, n: F.bround((n - 1) * F.lit(p)), p) for name, p in shares.items()})


def _linear(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """_key, n and the percentiles of tallied values, with linear interpolation."""
    places = {}
    for name, p in shares.items():
        places[f"_low_{name}"] = partial(lambda p, n: F.floor((n - 1) * F.lit(p)), p)
        places[f"_high_{name}"] = partial(lambda p, n: F.ceil((n - 1) * F.lit(p)), p)

    def between(name: str, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"_low_{name}").cast("double"), F.col(f"_high_{name}").cast("double")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return _picked(counts, places).select("_key", "n", *(between(name, p) for name, p in shares.items()))


def linear_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return _linear(_tally(df, keys, value), shares).select(*(F.col(f"_key.{k}").alias(k) for k in keys), *shares)


def trimmed_mean(df: DataFrame, keys: list[str], value: str, *, low: float = 0.08, high: float = 0.92, least: int = 64) -> DataFrame:
    """keys, n, kept, mean: of at least `least` values only those within the two percentiles (inclusive) count. A null key is a key."""
    counts = _tally(df, keys, value)
    near = counts.join(_linear(counts, {"_low": low, "_high": high}), "_key").where((F.col("n") < least) | F.col("_v").between(F.col("_low"), F.col("_high")))
    kept = near.groupBy("_key").agg(F.max("n").alias("n"), F.sum("_c").alias("kept"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))
    return kept.select(*(F.col(f"_key.{k}").alias(k) for k in keys), "n", "kept", "mean")


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with `z`: distance from the key's median in units of 1.4826 times the median absolute deviation.

    Where that is 0, the population deviation serves; where that is 0 too, 1e-6. Rows of keys without values are left out;
    a null key is a key. Median and deviation come from counted values; the rows are read for the counts and once more for z.
    """
    counts = _tally(df, keys, value)
    weight, v = F.sum("_c"), F.col("_v").cast("double")
    middle = counts.groupBy("_key").agg((F.sum(v * F.col("_c")) / weight).alias("_mu"))
    centred = counts.join(_linear(counts, {"_m": 0.5}).select("_key", "_m"), "_key").join(middle, "_key")
    apart = checkpointed(centred.select("_key", "_m", "_c", (v - F.col("_mu")).alias("_o"), F.abs(v - F.col("_m")).alias("_v")))
    spread = apart.groupBy("_key").agg(F.max("_m").alias("_m"), F.sqrt(F.sum(F.col("_o") * F.col("_o") * F.col("_c")) / weight).alias("_sd"))
    units = spread.join(_linear(apart.groupBy("_key", "_v").agg(F.sum("_c").alias("_c")), {"_mad": 0.5}).select("_key", "_mad"), "_key")
    unit = F.when(F.col("_mad") > 0, 1.4826 * F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1e-6))
    near = df.withColumn("_key", F.struct(*keys)).join(units, "_key")
    return near.withColumn("z", (F.col(value) - F.col("_m")) / unit).drop("_key", "_m", "_sd", "_mad")


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, mode, n, total: the most frequent value, ties to the one seen first by `order`."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("c"), -F.col("_first"))).alias("mode"), F.max("c").alias("n"), F.sum("c").alias("total"))


def dominant(df: DataFrame, keys: list[str], value: str, thresholds: dict[str, tuple[int, int]], default: tuple[int, int], other: str = "mixed") -> DataFrame:
    """keys, dominant: the value with the largest count if its share reaches its threshold (a fraction), else `other`."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    top = counts.groupBy(*keys).agg(F.max(F.struct("c", value)).alias("t"), F.sum("c").alias("total"))
    need = F.lit(False)
    for v, (num, den) in thresholds.items():
        need = need | ((F.col(f"t.{value}") == v) & (F.col("t.c") * den >= F.col("total") * num))
    rest = ~F.col(f"t.{value}").isin(*thresholds) & (F.col("t.c") * default[1] >= F.col("total") * default[0])
    return top.select(*keys, F.when(need | rest, F.col(f"t.{value}")).otherwise(other).alias("dominant"), F.col("t.c").alias("n"), "total")


def weighted_profile(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, profile: mean by weight over the rows that have the value; null where their weights are all 0."""
    there = F.col(value).isNotNull()
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.when(there, F.col(value) * F.col(weight))), F.sum(F.when(there, F.col(weight)))).alias("profile"))


def pearson(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, r: correlation over complete pairs; null below two pairs or without variance."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    # corr itself fails where there is no variance
    r = F.when((F.count("*") >= 2) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), r.alias("r"))


def peak_bins(df: DataFrame, keys: list[str], at: Column, value: str, width: int) -> DataFrame:
    """keys, bin, peak, share: the largest absolute value of each bin, and that over the key's largest; null where that is 0."""
    bins = df.groupBy(*keys, F.floor(at / width).alias("bin")).agg(F.max(F.abs(value)).alias("peak"))
    return bins.withColumn("share", F.try_divide("peak", F.max("peak").over(Window.partitionBy(*keys))))


def vector_parts(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, i, x: the components of each vector."""
    return df.select(*keys, F.posexplode(vector).alias("i", "x"))


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, i, x, n: component-wise means; nulls don't count."""
    return vector_parts(df, keys, vector).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("x").alias("n"))


def median_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, i, x: component-wise medians."""
    return vector_parts(df, keys, vector).groupBy(*keys, "i").agg(F.percentile(F.col("x").cast("double"), 0.5).alias("x"))


#: Classes whose means fit a literal array; more go through a join on the component
_FEW_CLASSES = 512


def nearest_class(df: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """ident, nearest, distance: the class whose mean vector is nearest by Euclid; ties to the smaller label.

    The means of up to 512 classes are counted and then sent to all tasks, so that vectors stay where they are.
    """
    means = mean_vectors(df, [label], vector)
    arrays = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"))
    if df.select(label).distinct().limit(_FEW_CLASSES + 1).count() <= _FEW_CLASSES:
        classes = arrays.agg(F.collect_list(F.struct(F.col(label).alias("label"), "m")).alias("classes"))
        rows = df.select(ident, vector).crossJoin(F.broadcast(classes))  # one row
        d = F.transform("classes", lambda c: F.struct(F.round(F.sqrt(F.aggregate(F.zip_with(vector, c["m"], lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, y: a + y)), 9).alias("d"), c["label"].alias("label")))
        return rows.select(ident, F.array_min(d).alias("b")).select(ident, F.col("b.label").alias("nearest"), F.col("b.d").alias("distance"))
    parts = vector_parts(df, [ident], vector)
    far = parts.join(means.select(label, "i", F.col("x").alias("m")), "i").groupBy(ident, label).agg(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))).alias("d"))
    best = far.groupBy(ident).agg(F.min(F.struct(F.round("d", 9).alias("d"), label)).alias("b"))
    return best.select(ident, F.col(f"b.{label}").alias("nearest"), F.col("b.d").alias("distance"))


def raster_cover(df: DataFrame, keys: list[str], *, columns: int, rows: int) -> DataFrame:
    """keys, covered: the share of a raster's cells that any box (x1, y1, x2, y2, in ratios) of the key meets."""

    def cells(low: str, high: str, many: int) -> Column:
        first, last = F.floor(F.col(low) * many).cast("int"), (F.ceil(F.col(high) * many) - 1).cast("int")
        return F.explode(F.when(last >= first, F.sequence(first, last)))

    spread = df.select(*keys, "y1", "y2", cells("x1", "x2", columns).alias("_i")).select(*keys, "_i", cells("y1", "y2", rows).alias("_j")).distinct()
    return spread.groupBy(*keys).agg((F.count("*") / (columns * rows)).alias("covered"))


def attribute(df: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """ident, nearest, score, margin: the class whose mean is nearest after each component is brought to mean 0 and deviation 1.

    score is 1 / (1 + distance); margin is what it is ahead of the second class, null where there is only one. At most 512 classes.
    Components without spread count as 0; vectors hold no nulls and are of one length.
    """
    parts = vector_parts(df, [label], vector)
    scale = parts.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("mu"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x")).join(scale, "i")
    unit = F.when(F.col("sd") > 1e-12, 1 / F.col("sd")).otherwise(0.0)
    arrays = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct(F.col("x").alias("x"), unit.alias("u")).alias("c")))), lambda p: p["c"]).alias("m"))
    if arrays.limit(_FEW_CLASSES + 1).count() > _FEW_CLASSES:
        raise ValueError(f"more than {_FEW_CLASSES} classes")
    classes = arrays.agg(F.collect_list(F.struct(F.col(label).alias("label"), "m")).alias("classes"))

    def far(c: Column) -> Column:
        squares = F.zip_with(vector, c["m"], lambda x, m: (x - m["x"]) * m["u"] * (x - m["x"]) * m["u"])
        return F.struct(F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, y: a + y)), 9).alias("d"), c["label"].alias("label"))

    rows = df.select(ident, vector).crossJoin(F.broadcast(classes)).select(ident, F.array_sort(F.transform("classes", far)).alias("d"))  # classes: one row
    score = [1 / (1 + F.try_element_at("d", F.lit(k))["d"]) for k in (1, 2)]
    return rows.select(ident, F.try_element_at("d", F.lit(1))["label"].alias("nearest"), F.round(score[0], 6).alias("score"), F.round(score[0] - score[1], 6).alias("margin"))
