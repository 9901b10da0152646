"""Lookups, integrity checks, overrides, snapshot differences, reuse plans, ordered distinct and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: keys that stand on several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def missing_references(df: DataFrame, references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """reference, value, n: values of a column of df that the column of another frame doesn't hold; null refers to nothing."""
    out = None
    for column, (there, key) in references.items():
        lost = df.where(F.col(column).isNotNull()).join(there.select(F.col(key).alias(column)), column, "left_anti")
        found = lost.groupBy(F.lit(column).alias("reference"), F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
        out = found if out is None else out.union(found)
    return out


def override(df: DataFrame, changes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """df with `value` replaced by the last change of its key, and `changed`: whether that made a difference."""
    last = changes.groupBy(key).agg(F.max_by(value, order).alias("_v"))
    joined = df.join(last, key, "left")
    new = F.coalesce("_v", value)
    return joined.withColumn("changed", ~new.eqNullSafe(F.col(value))).withColumn(value, new).drop("_v")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: added, removed or changed, comparing all shared columns; equal rows are left out."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    a, b = before.select(key, F.struct(*columns).alias("_a")), after.select(key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of canonical JSON of the columns, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def reuse_plan(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """key, reason: why a segment can (`reused`) or can't be taken from a cache; the first failing check names it.

    wanted: key, version, print; cached: key, version, print, size.
    """
    joined = wanted.join(cached.select(key, F.col("version").alias("_v"), F.col("print").alias("_p"), F.col("size").alias("_s")), key, "left")
    reason = (
        F.when(F.col("_v").isNull(), "missing")
        .when(F.col("_v") != F.col("version"), "version")
        .when(F.coalesce("_s", F.lit(0)) <= 0, "empty")
        .when(~F.col("_p").eqNullSafe(F.col("print")), "changed")
        .otherwise("reused")
    )
    return joined.select(key, reason.alias("reason"))


def ordered_distinct(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*")


def top_by_key(df: DataFrame, groups: list[str], key: Column, score: str, order: str, many: int) -> DataFrame:
    """The `many` best rows of each group by score, after only the best row of each key in it stays; ties to the first by order."""
    best = df.withColumn("_k", key).groupBy(*groups, "_k").agg(F.max_by(F.struct(*[c for c in df.columns if c not in groups]), F.struct(F.col(score), -F.col(order))).alias("_r"))
    rows = best.select(*groups, "_r.*")
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), order))
    return rows.withColumn("place", place).where(F.col("place") <= many)


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(None).cast("string")
    for condition, label in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(label)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def flags(rules: list[tuple[Column, str]]) -> Column:
    """Names of all the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for condition, name in rules)))
