"""Joins that pick one partner: scored anchors, best matches, key sets, prioritised lookups, removals, window searches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.intervals import interval_union, overlap_join
from tessera.session import checkpointed


def scored_anchor(planned: DataFrame, anchors: DataFrame, keys: list[str], ident: str, *, within: int, wanted: int, longest: int) -> DataFrame:
    """keys, ident, anchor, score: for each planned time the anchor with the least score within `within` of it.

    planned: keys, ident, s; anchors: keys, anchor, s, length. score = distance + 0.85 for each unit that the anchor is shorter than
    `wanted` - 0.16 for each unit of its length up to `longest`; ties to the nearer, then the longer, then the smaller anchor.
    """
    left = planned.select(*keys, ident, F.col("s").alias("_at"), (F.col("s") - within).alias("ls"), (F.col("s") + within + 1).alias("le"))
    right = anchors.select(*keys, "anchor", "length", F.col("s").alias("rs"), (F.col("s") + 1).alias("re"))
    distance = F.abs(F.col("rs") - F.col("_at"))
    score = distance + F.greatest(F.lit(0), wanted - F.col("length")) * 0.85 - F.least("length", F.lit(longest)) * 0.16
    rank = F.struct(score.alias("score"), distance.alias("d"), (-F.col("length")).alias("l"), "anchor")
    best = overlap_join(left, right, keys).groupBy(*keys, ident).agg(F.min(rank).alias("b"))
    return best.select(*keys, ident, "b.anchor", "b.score")


def best_match(left: DataFrame, right: DataFrame, ident: str, other: str, tokens: str, *, often: int = 64, block: int = 1_000_000) -> DataFrame:
    """ident, other, score: for each left row the right row of the largest Jaccard similarity of tokens above 0; ties to the smaller `other`.

    tokens: a column of arrays on both sides; a null one is empty, null tokens don't count; a row without ident has no match. Exact, whatever tokens are common:
    tokens that both sides have are numbered, both sides are dealt into blocks of about `block` tokens, and each pair of blocks meets in one
    task, which counts shared tokens and keeps each left row's best. Pairs of rows are never shuffled. `often`: from how many holders
    of a token on a left row of very many pairs is counted token by token.
    """
    held = F.coalesce(F.array_compact(F.array_distinct(tokens)), F.array().cast(left.schema[tokens].dataType))
    a = left.where(F.col(ident).isNotNull()).select(F.col(ident).alias("_id"), held.alias("_t")).select("_id", F.size("_t").alias("_n"), F.explode("_t").alias("_x"))
    b = right.where(F.col(ident).isNotNull()).select(F.col(ident).alias("_id"), held.alias("_t")).select("_id", F.size("_t").alias("_n"), F.explode("_t").alias("_x"))
    # the tokens of both sides, each with a number; only these meet again
    known = checkpointed(b.select("_x").distinct().join(a.select("_x"), "_x", "left_semi").withColumn("_k", F.monotonically_increasing_id()))
    a, b = (checkpointed(rows.join(known, "_x").select("_id", "_n", "_k")) for rows in (a, b))
    blocks = [max(1, -(-rows.count() // block)) for rows in (a, b)]
    own = [F.pmod(F.xxhash64("_id"), F.lit(n)).alias(c) for n, c in zip(blocks, ("_i", "_j"), strict=True)]
    met = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c) for n, c in zip(blocks, ("_i", "_j"), strict=True)]
    x = a.select(own[0].cast("int").alias("_i"), met[1], "*").groupBy("_i", "_j")
    y = b.select(own[1].cast("int").alias("_j"), met[0], "*").groupBy("_i", "_j")
    kinds = [left.schema[ident].dataType.simpleString(), right.schema[ident].dataType.simpleString()]

    def best(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _best_of_block(p, q, often)

    found = x.cogroup(y).applyInPandas(best, f"_id {kinds[0]}, _o {kinds[1]}, _s double")
    top = found.groupBy("_id").agg(F.min(F.struct((-F.col("_s")).alias("s"), "_o")).alias("_b"))
    return top.select(F.col("_id").alias(ident), F.col("_b._o").alias(other), (-F.col("_b.s")).alias("score"))


def _best_of_block(p: pd.DataFrame, q: pd.DataFrame, often: int, most: int = 1 << 21) -> pd.DataFrame:
    """_id, _o, _s: the best of q's rows for each of p's that shares a token with any (both: _id, _n, _k); at most about `most` pairs are held at once."""
    if not len(p) or not len(q):
        return pd.DataFrame({"_id": p["_id"][:0], "_o": q["_id"][:0], "_s": np.zeros(0)})
    rows, ids = pd.factorize(p["_id"])
    others, names = pd.factorize(q["_id"], sort=True)  # numbered by name, so that ties go to the smaller number
    na, nb = np.zeros(len(ids), np.int64), np.zeros(len(names), np.int64)
    na[rows], nb[others] = p["_n"], q["_n"]
    keys, of = q["_k"].to_numpy(), p["_k"].to_numpy()
    by = np.argsort(keys, kind="stable")
    keys, others = keys[by], others[by]
    by = np.argsort(rows, kind="stable")
    rows, of = rows[by], of[by]
    low, high = np.searchsorted(keys, of), np.searchsorted(keys, of, "right")
    first = np.searchsorted(rows, np.arange(len(ids) + 1))
    upto = np.concatenate([[0], np.cumsum(high - low)])[first]  # pairs of all rows before each
    out_row, out_other, out_score = [], [], []

    def keep(row, other, shared):
        score = shared / (na[row] + nb[other] - shared)
        by = np.lexsort((other, -score, row))
        head = by[np.concatenate([[True], row[by][1:] != row[by][:-1]])]
        out_row.append(row[head])
        out_other.append(other[head])
        out_score.append(score[head])

    at = 0
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        span = slice(first[at], first[end])
        lows, n = low[span], (high - low)[span]
        if end == at + 1 and n.max(initial=0) > often and upto[end] - upto[at] > most:
            # one row with more pairs than may be held: token by token
            shared = np.zeros(len(names), np.int64)
            for i, m in zip(lows, n, strict=True):
                shared[others[i : i + m]] += 1
            other = np.flatnonzero(shared)
            keep(np.full(len(other), at), other, shared[other])
        elif n.sum():
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lows, n)
            pair, shared = np.unique(np.repeat(rows[span], n) * len(names) + others[place], return_counts=True)
            keep(pair // len(names), pair % len(names), shared)
        at = end
    if not out_row:
        return pd.DataFrame({"_id": p["_id"][:0], "_o": q["_id"][:0], "_s": np.zeros(0)})
    return pd.DataFrame({"_id": np.asarray(ids)[np.concatenate(out_row)], "_o": np.asarray(names)[np.concatenate(out_other)], "_s": np.concatenate(out_score)})


def key_set_match(left: DataFrame, right: DataFrame, ident: str, other: str, keys: str) -> DataFrame:
    """ident, other, shared: for each left row the first right row (by `other`) whose array of keys meets its own, and how many they share.

    Only the first right row of each key meets the left rows of that key, so that a key that many rows share costs no pairs.
    """
    own = F.array_compact(F.array_distinct(keys))
    first = right.select(other, F.explode(own).alias("_k")).groupBy("_k").agg(F.min(other).alias(other))
    chosen = left.select(ident, F.explode(own).alias("_k")).join(first, "_k").groupBy(ident).agg(F.min(other).alias(other))
    pairs = chosen.join(left.select(ident, own.alias("_a")), ident).join(right.select(other, own.alias("_b")), other)
    return pairs.select(ident, other, F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared"))


def prioritised_lookup(df: DataFrame, there: DataFrame, rules: list[list[str]], values: list[str]) -> DataFrame:
    """df with `values` of the row of `there` that agrees with it on the first of the rules (lists of columns) that any row agrees on, and `rule` (from 1).

    Of several such rows the one with the smallest values counts; rule is null where none agrees.
    """
    out, picked, rule = df, F.lit(None), F.lit(None).cast("int")
    hits = []
    for i, columns in enumerate(rules):
        own = there.where(" and ".join(f"{c} is not null" for c in columns)).groupBy(*columns).agg(F.min(F.struct(*values)).alias(f"_v{i}"))
        out = out.join(own, columns, "left")
        hits.append(F.col(f"_v{i}"))
    for i in reversed(range(len(rules))):
        rule = F.when(hits[i].isNotNull(), F.lit(i + 1)).otherwise(rule)
    picked = F.coalesce(*hits)
    return out.select(*df.columns, *(picked[v].alias(v) for v in values), rule.alias("rule"))


def best_of_group(df: DataFrame, groups: list[Column], order: list[Column], ident: str) -> DataFrame:
    """kept, n, dropped: of each group the ident of the first row by order, and the others' idents in order."""
    named = [g.alias(f"_g{i}") for i, g in enumerate(groups)]
    ranked = F.array_sort(F.collect_list(F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.col(ident).alias("_id"))))
    rows = df.groupBy(*named).agg(F.transform(ranked, lambda x: x["_id"]).alias("_ids"))
    return rows.select(F.col("_ids")[0].alias("kept"), F.size("_ids").cast("long").alias("n"), F.array_join(F.transform(F.slice("_ids", 2, 1 << 30), lambda x: x.cast("string")), ",").alias("dropped"))


def without_roots(df: DataFrame, removed: DataFrame, root: Column, key: str) -> DataFrame:
    """Rows of df whose root isn't a key of `removed`."""
    return df.withColumn("_root", root).join(removed.select(F.col(key).alias("_root")).distinct(), "_root", "left_anti").drop("_root")


def best_window(df: DataFrame, keys: list[str], order: str, text: str, words: list[str], *, most: int, span: int) -> DataFrame:
    """keys, first, size, score: the run of at most `most` rows, no longer than `span` from its first start to its last end, that holds the most of the words.

    df: keys, order (whole numbers without gaps), s, e. Ties: the earlier first row, then the shorter run. A row that is longer
    than `span` by itself ends every run at it.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    found = None
    for size in range(1, most + 1):
        run = by.rowsBetween(0, size - 1)
        rows = df.select(*keys, F.col(order).alias("first"), F.lit(size).alias("size"), F.count("*").over(run).alias("_n"), (F.max("e").over(run) - F.col("s")).alias("_len"), F.array_join(F.collect_list(text).over(run), " ").alias("_t"))
        rows = rows.where((F.col("_n") == size) & (F.col("_len") <= span))
        score = F.lit(0)
        for w in words:
            score = score + F.contains("_t", F.lit(w)).cast("int")
        rows = rows.select(*keys, "first", "size", score.alias("score"))
        found = rows if found is None else found.union(rows)
    best = found.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("first")).alias("f"), (-F.col("size")).alias("z"))).alias("b"))
    return best.select(*keys, (-F.col("b.f")).alias("first"), (-F.col("b.z")).alias("size"), "b.score")


def near_text(df: DataFrame, anchors: DataFrame, keys: list[str], ident: str, text: str, *, within: int) -> DataFrame:
    """keys, ident, anchor: rows whose text holds an anchor's needle and that begin within `within` of the anchor's time (keys, anchor, s, needle)."""
    left = df.select(*keys, ident, text, F.col("s").alias("ls"), (F.col("s") + 1).alias("le"))
    right = anchors.select(*keys, "anchor", "needle", (F.col("s") - within).alias("rs"), (F.col("s") + within + 1).alias("re"))
    return overlap_join(left, right, keys).where(F.contains(text, F.col("needle"))).select(*keys, ident, "anchor")


def remap_ranges(df: DataFrame, keep: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, ident, piece, s, e: each interval's parts inside the keep ranges (keys, s, e), on the clock that runs in keep ranges only."""
    merged = interval_union(keep, keys).where("e > s")
    before = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranges = merged.select(*keys, F.col("s").alias("rs"), F.col("e").alias("re"), F.coalesce(F.sum(F.col("e") - F.col("s")).over(before), F.lit(0)).alias("_out"))
    hits = overlap_join(df.select(*keys, ident, F.col("s").alias("ls"), F.col("e").alias("le")), ranges, keys)
    place = F.row_number().over(Window.partitionBy(*keys, ident, "ls", "le").orderBy("rs")) - 1
    begin = F.greatest("ls", "rs") - F.col("rs") + F.col("_out")
    return hits.select(*keys, ident, place.alias("piece"), begin.alias("s"), (begin + F.col("overlap")).alias("e"))


def removal_ranges(silences: DataFrame, keys: list[str], *, duration: int, keep: int, edge: int) -> DataFrame:
    """keys, s, e: what of silences (keys, s, e) longer than `keep` goes: all but `keep` in the middle, at its end or its beginning.

    Inside, half of `keep` stays on either side; at the beginning (from `edge` or before) its end stays, at the
    end (to duration - edge or later) its beginning. What is no longer than `edge` stays.
    """
    half = F.lit(keep // 2)
    first, last = F.col("s") <= edge, F.col("e") >= duration - edge
    s = F.when(first, F.col("s")).when(last, F.least("e", F.col("s") + keep)).otherwise(F.col("s") + half)
    e = F.when(first, F.greatest("s", F.col("e") - keep)).when(last, F.col("e")).otherwise(F.col("e") - half)
    return silences.where(F.col("e") - F.col("s") > keep).select(*keys, s.alias("s"), e.alias("e")).where(F.col("e") - F.col("s") > edge)


def union_by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """key, the columns of the sources, and source (from 1): rules of all sources; where several have a key, the earliest source's stays."""
    everything = None
    for i, frame in enumerate(sources):
        own = frame.withColumn("source", F.lit(i + 1))
        everything = own if everything is None else everything.unionByName(own)
    rest = [c for c in everything.columns if c not in (key, "source")]
    best = everything.groupBy(key).agg(F.min(F.struct("source", *rest)).alias("b"))
    return best.select(key, *(f"b.{c}" for c in rest), "b.source")


def compare_sequences(before: DataFrame, after: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, missing, extra, moved: values that only one version of a key's sequence has, and how many stand elsewhere in it."""
    a = before.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("a"))
    b = after.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("b"))
    both = a.join(b, keys, "full_outer")
    none = F.expr(f"cast(array() as array<{before.schema[value].dataType.simpleString()}>)")
    x, y = (F.coalesce(F.transform(c, lambda p: p[value]), none) for c in ("a", "b"))
    rows = both.select(*keys, x.alias("x"), y.alias("y"))
    lost, new = F.array_sort(F.array_except("x", "y")), F.array_sort(F.array_except("y", "x"))
    moved = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p != q), lambda d: d))
    return rows.select(*keys, F.array_join(lost, ",").alias("missing"), F.array_join(new, ",").alias("extra"), moved.cast("long").alias("moved"))
