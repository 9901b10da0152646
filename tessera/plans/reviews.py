"""Reviews of finished work: profiles across files, quality scores, findings around cuts, captions to prune, editorial scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators.intervals import nearest, overlap_join
from tessera.operators.relations import first_rule


def finite(x: Column) -> Column:
    """The value as a double; null for NaN and infinities."""
    v = x.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def summaries(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and for each column c: c_n, c_mean, c_max, c_min over its finite values; nulls, NaN and infinities don't count. A key without any has nulls."""
    parts = []
    for c in columns:
        v = finite(F.col(c))
        parts += [F.count(v).alias(f"{c}_n"), F.avg(v).alias(f"{c}_mean"), F.max(v).alias(f"{c}_max"), F.min(v).alias(f"{c}_min")]
    return df.groupBy(*keys).agg(*parts)


def profile(df: DataFrame, keys: list[str], order: str, *, means: list[str], labels: list[str]) -> DataFrame:
    """keys, n, the mean of each of `means`, and for each label its most frequent value, `<label>_top`, and `<label>_counts`: all frames of a profile's files as one.

    Ties of a label go to the value seen first by `order`. Counts are text, `value:n` in the order of values; a null label counts as `unknown`.
    Labels are few words by nature (positions, sizes, directions): their counts are the size of the result, their rows meet as counts only.
    """
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(finite(F.col(c))).alias(c) for c in means))
    for label in labels:
        counts = df.groupBy(*keys, F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("_v")).agg(F.count("*").alias("_c"), F.min(order).alias("_first"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_v", "_c"))), lambda x: F.concat_ws(":", x["_v"], x["_c"].cast("string"))), ",")
        top = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), "_first", "_v")).alias("_t"), listed.alias(f"{label}_counts"))
        top = top.select(*keys, F.col("_t._v").alias(f"{label}_top"), f"{label}_counts")
        both = out.alias("o").join(top.alias("t"), [F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]) if keys else out.crossJoin(top)  # one row each
        out = both.select(*(F.col(f"o.{c}") for c in out.columns), f"t.{label}_top", f"t.{label}_counts") if keys else both
    return out


# Fixed values of quality scores: name, weight, and the value at which a measure counts in full (best: the brightness that does).
FRAME_PARTS = {"brightness": (0.22, 0.50), "saturation": (0.15, 0.36), "sharpness": (0.20, 900.0), "faces": (0.24, 5.0), "face_area": (0.12, 0.12), "motion": (0.07, 0.18)}
SAMPLE_PARTS = {"faces": (0.34, 7.0), "face_area": (0.17, 0.14), "camera_motion": (0.20, 0.045), "scene_motion": (0.08, 0.20), "sharpness": (0.11, 900.0), "brightness": (0.06, 0.50), "saturation": (0.04, 0.36)}


def quality(parts: dict[str, tuple[float, float]]) -> Column:
    """Sum of weighted shares, 5 digits: brightness by how near it is to its best, camera_motion and scene_motion by how little there is, the others by how much, up to their full value.

    Measures are columns of these names; a null one counts as 0.
    """
    total = F.lit(0.0)
    for name, (weight, full) in parts.items():
        x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        if name == "brightness":
            share = 1 - F.least(F.abs(x - full) / full, F.lit(1.0))
        else:
            share = F.least(x / full, F.lit(1.0))
            share = 1 - share if name in ("camera_motion", "scene_motion") else share
        total = total + weight * share
    return F.round(total, 5)


def cut_findings(segments: DataFrame, cuts: DataFrame, keys: list[str], *, near: int, align: int, short: int) -> DataFrame:
    """keys, finding, s, e, distance: what looks wrong where material was cut out.

    segments: keys, s, e, role, of a plan; cuts: keys, s (times). short_near_cut: a segment [s, e] shorter than `short`, one of whose ends is at most `near` from a cut (distance);
    not_aligned: a change of role at s that misses a cut at e by more than `align` and at most `near`; clustered: changes of role at s and at e, at most `short`
    apart, one of them at most `near` from a cut.
    """
    order = Window.partitionBy(*keys).orderBy("s", "e", "role")
    rows = segments.select(*keys, "s", "e", "role", F.row_number().over(order).alias("i"), F.lead("role").over(order).alias("_next"))
    points = cuts.select(*keys, "s").distinct().withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("s")))

    def close(df: DataFrame) -> DataFrame:
        """df (keys, i, s, e) with `distance`: from the nearest cut to the nearer of both ends; keys without cuts are left out."""
        ends = df.select(*keys, "i", F.explode(F.array("s", "e")).alias("s"))
        ends = ends.withColumn("j", F.concat_ws("-", F.col("i").cast("string"), F.col("s").cast("string"))).dropDuplicates([*keys, "j"])
        found = nearest(ends.select(*keys, F.col("j").alias("i"), "s"), points.select(*keys, F.col("i").cast("string").alias("i"), "s"), keys, "i").withColumnRenamed("i", "j")
        best = ends.join(found.select(*keys, "j", "distance"), [*keys, "j"]).groupBy(*keys, "i").agg(F.min("distance").alias("distance"))
        return df.join(best, [*keys, "i"])

    brief = close(rows.where(F.col("e") - F.col("s") < short).select(*keys, "i", "s", "e")).where(F.col("distance") <= near)
    changes = rows.where("role <> _next").select(*keys, "i", F.col("e").alias("s"))
    left = changes.select(*keys, F.col("s").alias("_t"), (F.col("s") - near).alias("ls"), (F.col("s") + near + 1).alias("le"))
    met = overlap_join(left, points.select(*keys, F.col("s").alias("rs"), (F.col("s") + 1).alias("re")), keys)
    missed = met.select(*keys, F.col("_t").alias("s"), F.col("rs").alias("e"), F.abs(F.col("_t") - F.col("rs")).alias("distance")).where(F.col("distance") > align)
    pairs = changes.withColumn("e", F.lead("s").over(Window.partitionBy(*keys).orderBy("i"))).where(F.col("e") - F.col("s") <= short)
    crowded = close(pairs.select(*keys, "i", "s", "e")).where(F.col("distance") <= near)
    out = None
    for name, found in (("short_near_cut", brief), ("not_aligned", missed), ("clustered", crowded)):
        found = found.select(*keys, F.lit(name).alias("finding"), "s", "e", "distance")
        out = found if out is None else out.union(found)
    return out


def prune_reason(x: Column, rules: list[tuple[str, str]], *, least: int) -> Column:
    """Why a caption goes: `empty`, `short` (fewer than `least` letters once punctuation is gone), else the name of the first rule (name, regular expression) it matches; null if it stays."""
    plain = text.normalized(F.coalesce(x, F.lit("")))
    checks = [(plain == "", "empty"), (F.length(plain) < least, "short"), *((x.rlike(pattern), name) for name, pattern in rules)]
    named = first_rule(checks, "")
    return F.when(named != "", named)


def editorial_score(x: Column, groups: dict[str, tuple[float, list[str]]], *, base: float = 0.0) -> Column:
    """`base` and the weights of all groups (weight, keywords) of which the text holds a keyword, from 0 to 1."""
    total = F.lit(base)
    for weight, words in groups.values():
        total = total + F.when(text.holds_any(x, words), weight).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
