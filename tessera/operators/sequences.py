"""Ordered rows: sliding windows, even samples, natural order, rotation, fixed picks by hash, signatures, key sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sliding_windows(df: DataFrame, keys: list[str], order: str, value: str, sizes: list[int], *, joiner: str = " ", least: int = 0) -> DataFrame:
    """keys, first, size, joined: every run of `size` rows in a row whose joined text has at least `least` characters."""
    by = Window.partitionBy(*keys).orderBy(order)
    out = None
    for size in sizes:
        run = by.rowsBetween(0, size - 1)
        rows = df.withColumn("_n", F.count("*").over(run)).withColumn("joined", F.array_join(F.collect_list(value).over(run), joiner))
        rows = rows.where((F.col("_n") == size) & (F.length("joined") >= least)).select(*keys, F.col(order).alias("first"), F.lit(size).alias("size"), "joined")
        out = rows if out is None else out.union(rows)
    return out


def even_sample(df: DataFrame, keys: list[str], order: list[str], many: int) -> DataFrame:
    """At most `many` rows of a key, spread evenly from the first to the last."""
    by = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    # row i stays if some j has floor(j * (n - 1) / (many - 1)) = i
    last = many - 1
    j = F.ceil(F.col("_i") * last / F.greatest(F.col("_n") - 1, F.lit(1)))
    chosen = F.floor(j * (F.col("_n") - 1) / last) == F.col("_i") if last else F.col("_i") == 0
    return rows.where((F.col("_n") <= many) | chosen).drop("_i", "_n")


def natural_key(x: Column) -> Column:
    """A text that sorts digit runs (up to 18 digits) by their value and letters without case."""
    marked = F.regexp_replace(F.lower(x), r"(\d+)", "\u0000$1\u0000")
    parts = F.split(marked, "\u0000")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 18, "0")).otherwise(p)), "")


def hash_pick(x: Column, many: int) -> Column:
    """A number in [0, many) fixed by the text: the first 12 hex digits of its SHA-256, modulo."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 12), 16, 10).cast("long") % many


def rotation(df: DataFrame, keys: list[str], order: list[str], roles: list[str], every: int) -> DataFrame:
    """df with `role`: the roles in turn, `every` rows each."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    turn = (F.floor(place / every) % len(roles) + 1).cast("int")
    return df.withColumn("role", F.element_at(F.array(*(F.lit(r) for r in roles)), turn))


def signatures(df: DataFrame, signature: list[Column], ident: str) -> DataFrame:
    """signature, n, first: how often each combination occurs, and the smallest ident that has it."""
    return df.groupBy(F.concat_ws("|", *signature).alias("signature")).agg(F.count("*").alias("n"), F.min(ident).alias("first"))


def key_errors(keys: Column, required: list[str], allowed: list[str]) -> tuple[Column, Column]:
    """(missing, unexpected): sorted names that an array of keys lacks, or holds beyond the allowed."""
    want, may = (F.array(*(F.lit(k) for k in ks)).cast("array<string>") for ks in (required, allowed))
    return F.array_sort(F.array_except(want, keys)), F.array_sort(F.array_except(keys, may))


def media_kind(path: Column, kinds: dict[str, list[str]], default: str = "other") -> Column:
    """The kind whose extensions hold that of a path or address (without query and fragment)."""
    extension = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(default)
    for kind, own in kinds.items():
        out = F.when(extension.isin(*own), kind).otherwise(out)
    return out


def truthy(x: Column) -> Column:
    """Whether a text says yes: 1, true, yes or on, in any case."""
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "on"), F.lit(False))


def number_or(x: Column, default: float) -> Column:
    """A finite double out of a text, or the default."""
    value = x.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value).otherwise(default)


#: Sampled keys that the driver holds to cut an order into stretches
_SAMPLE = 10_000


def global_rank(df: DataFrame, key: str, ties: list[str], into: str, *, stretches: int = 64) -> DataFrame:
    """df with `into`: the place (from 1) of each row in the order of `key`, then ties, nulls first; no task holds more than a stretch of it.

    The stretches are cut at rows (key and ties) of a bounded sample, fixed by hash, so that a key that most rows share is cut
    by its ties; their sizes are counted, and each row is ranked in its own.
    """
    many = df.count()
    every = max(1, many // _SAMPLE)
    whole = [key, *ties]
    sample = sorted((tuple(r) for r in df.where(F.pmod(F.xxhash64(*whole), F.lit(every)) == 0).select(*whole).limit(2 * _SAMPLE).collect()), key=lambda t: [(v is not None, v) for v in t])
    cuts = list(dict.fromkeys(sample[i * len(sample) // stretches] for i in range(1, stretches))) if sample else []
    kinds = [df.schema[c].dataType for c in whole]
    own = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(whole)))
    edges = [F.struct(*(F.lit(v).cast(kind).alias(f"c{i}") for i, (v, kind) in enumerate(zip(c, kinds, strict=True)))) for c in cuts]
    at = F.size(F.filter(F.array(*edges), lambda c: c <= own)) if edges else F.lit(0)
    rows = df.withColumn("_stretch", at)
    sizes = rows.groupBy("_stretch").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy(key, *ties))
    return rows.withColumn("_k", place).join(F.broadcast(base), "_stretch").withColumn(into, F.col("_k") + F.col("_base")).drop("_stretch", "_k", "_base")


def interleave(df: DataFrame, keys: list[str], kind: str, order: list[str]) -> DataFrame:
    """df with `place` (from 1): items of several kinds in one sequence of a key, each kind spread evenly; ties to the larger kind, then by order."""
    own = Window.partitionBy(*keys, kind)
    share = (2 * F.row_number().over(own.orderBy(*order)) - 1) / (2 * F.count("*").over(own))
    return df.withColumn("_at", share).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", F.desc(kind), *order))).drop("_at")


def merge_maps(left: Column, right: Column) -> Column:
    """Both maps' entries; where they share a key, the right one's."""
    kept = F.map_filter(left, lambda k, v: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(kept, right)


def unique_names(df: DataFrame, name: str, order: str, into: str = "unique") -> DataFrame:
    """df with `into`: the name, or with the first of _2, _3 and so on that no row before it, by `order`, has taken.

    Names that could take one another's numbers (equal but for numbers at their ends) meet in one task; all others don't. A null name is `item`.
    """
    kinds, columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), df.columns

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, following, out = set(), {}, []
        for base in (rows := pdf.sort_values(order))["_name"]:
            n, chosen = following.get(base, 2), base
            while chosen in taken:
                chosen, n = f"{base}_{n}", n + 1
            following[base] = n
            taken.add(chosen)
            out.append(chosen)
        rows[into] = out
        return rows[[*columns, into]]

    rows = df.withColumn("_name", F.coalesce(name, F.lit("item")))
    return rows.groupBy(F.regexp_replace("_name", r"(_\d+)+$", "").alias("_root")).applyInPandas(number, f"{kinds}, {into} string")
