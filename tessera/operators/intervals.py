"""Interval algebra on microsecond columns: unions, gaps, differences, sweeps, range joins, nearest rows, remaps.

Frames carry key columns, a start and an end (whole microseconds, end exclusive). Everything is windows and
equi-joins: a range condition is turned into an equality on time buckets, with the exact condition beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR = 3_600_000_000


def interval_union(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", *, gap: int = 0, pad: int = 0, clamp: tuple[int, int] | None = None, min_len: int = 0, payload: str | None = None, members: str | None = None, span: int | None = None) -> DataFrame:
    """keys, island (from 1, in time order), start, end, n: intervals of a key merged where they touch within `gap`.

    payload: a column whose values each island lists in time order, joined by commas: for islands of few intervals. members: a column; then each
    interval has a row, with its island's start, end and n and its own value, so that no island's values meet in one task. span: a stretch of time that one task
    may hold of a key; without it a key's rows meet in one task. keys may be empty with it.

    Each interval first grows by `pad` on both sides and is cut to `clamp`; what is then shorter than `min_len`, or
    has an end before its start, is left out.
    """
    s, e = F.col(start) - pad, F.col(end) + pad
    if clamp:
        s, e = F.greatest(s, F.lit(clamp[0])), F.least(e, F.lit(clamp[1]))
    more = [F.col(payload or members).cast("string").alias("_p")] if payload or members else []
    rows = df.select(*keys, s.alias("_s"), e.alias("_e"), *more).where(F.col("_e") - F.col("_s") >= min_len)
    # within a key, or within a stretch of time of a key: what ended last before comes from the stretches ahead
    own = [*keys, "_b"] if span else keys
    if span:
        rows = rows.withColumn("_b", F.floor(F.col("_s") / span))
        ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*own).agg(F.max("_e").alias("_m")).withColumn("_carry", F.max("_m").over(ahead)).drop("_m")
        rows = rows.join(ends, own)
    order = Window.partitionBy(*own).orderBy("_s", "_e")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(reach, F.col("_carry")) if span else reach
    fresh = F.when(reach.isNull() | (F.col("_s") > reach + gap), 1).otherwise(0)
    islands = rows.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(order))
    if span:
        before = islands.groupBy(*own).agg(F.sum("_new").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
        islands = islands.join(before, own).withColumn("island", F.col("island") + F.col("_base"))
    if members:
        bounds = islands.groupBy(*keys, "island").agg(F.min("_s").alias(start), F.max("_e").alias(end), F.count("*").alias("n"))
        return islands.select(*keys, "island", F.col("_p").alias(members)).join(bounds, [*keys, "island"]).select(*keys, "island", start, end, "n", members)
    listed = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_e", "_p"))), lambda x: x["_p"]), ",").alias(payload)] if payload else []
    return islands.groupBy(*keys, "island").agg(F.min("_s").alias(start), F.max("_e").alias(end), F.count("*").alias("n"), *listed)


def interval_complement(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", *, min_len: int = 1, within: tuple[int, int] | None = None) -> DataFrame:
    """keys, start, end: the free ranges of at least `min_len` between a key's first start and last end, or in `within` from end to end.

    A key without rows has no row here either.
    """
    merged = interval_union(df, keys, start, end, clamp=within)
    if within:
        edges = df.select(*keys).distinct().select(*keys, F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias(start), F.lit(x).cast("long").alias(end)) for x in within))).alias("_x"))
        merged = merged.select(*keys, start, end).union(edges.select(*keys, f"_x.{start}", f"_x.{end}"))
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    free = merged.withColumn("_from", reach).where(F.col(start) - F.col("_from") >= min_len)
    return free.select(*keys, F.col("_from").alias(start), F.col(start).alias(end))


def buckets(start: Column, end: Column, width: int) -> Column:
    """Numbers of the time buckets that [start, end) meets; an empty interval meets that of its start."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], *, width: int = 6 * HOUR, min_overlap: int = 1) -> DataFrame:
    """Pairs of rows of equal keys whose intervals (ls, le) and (rs, re) overlap by `min_overlap`; each pair once.

    Both sides are dealt by keys and time bucket. A pair that meets in several buckets counts in the first of them.
    Choose `width` near a common interval's length: an interval is repeated for each bucket that it meets.
    """
    a = left.withColumn("_b", F.explode(buckets(F.col("ls"), F.col("le"), width)))
    b = right.withColumn("_b", F.explode(buckets(F.col("rs"), F.col("re"), width)))
    first = F.col("_b") == F.floor(F.greatest("ls", "rs") / width)
    overlap = F.least("le", "re") - F.greatest("ls", "rs")
    return a.join(b, [*keys, "_b"]).where(first & (overlap >= min_overlap)).withColumn("overlap", overlap).drop("_b")


def interval_difference(left: DataFrame, cuts: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, ident, s, e: what of each interval of left (keys, ident, s, e) no cut (keys, s, e) covers."""
    merged = interval_union(cuts, keys).select(*keys, F.col("s").alias("rs"), F.col("e").alias("re"))
    rows = left.select(*keys, ident, F.col("s").alias("ls"), F.col("e").alias("le"))
    hits = overlap_join(rows, merged, keys)
    order = Window.partitionBy(*keys, ident, "ls", "le").orderBy("rs")
    inside = hits.withColumn("_from", F.coalesce(F.lag("re").over(order), "ls")).withColumn("_last", F.lead("rs").over(order).isNull())
    before = inside.select(*keys, ident, F.col("_from").alias("s"), F.col("rs").alias("e"))
    after = inside.where("_last").select(*keys, ident, F.col("re").alias("s"), F.col("le").alias("e"))
    untouched = rows.join(hits.select(*keys, ident, "ls", "le").distinct(), [*keys, ident, "ls", "le"], "left_anti").select(*keys, ident, F.col("ls").alias("s"), F.col("le").alias("e"))
    return before.union(after).union(untouched).where("e > s")


def overlap_violations(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, ident, previous, overlap: rows that begin before the row ahead of them (by s, e, ident) has ended. Only neighbours count."""
    order = Window.partitionBy(*keys).orderBy("s", "e", ident)
    seen = df.withColumn("_e", F.lag("e").over(order)).withColumn("previous", F.lag(ident).over(order))
    return seen.where("s < _e").select(*keys, ident, "previous", (F.col("_e") - F.col("s")).alias("overlap"))


def sweep(df: DataFrame, keys: list[str], role: str, *, least: int = 2) -> DataFrame:
    """keys, s, e, roles: the atomic ranges in which at least `least` roles are active; neighbours aren't merged.

    A role's own overlapping intervals are merged first.
    """
    merged = interval_union(df, [*keys, role]).where("e > s")
    points = merged.select(*keys, F.explode(F.array("s", "e")).alias("s")).distinct()
    atoms = points.withColumn("e", F.lead("s").over(Window.partitionBy(*keys).orderBy("s"))).where("e is not null")
    left, right = atoms.select(*keys, F.col("s").alias("ls"), F.col("e").alias("le")), merged.select(*keys, role, F.col("s").alias("rs"), F.col("e").alias("re"))
    active = overlap_join(left, right, keys).groupBy(*keys, "ls", "le").agg(F.array_sort(F.collect_set(role)).alias("_roles"))
    return active.where(F.size("_roles") >= least).select(*keys, F.col("ls").alias("s"), F.col("le").alias("e"), F.array_join("_roles", ",").alias("roles"))


def role_runs(df: DataFrame, keys: list[str], role: str, ident: str, *, gap: int | None = None) -> DataFrame:
    """keys, run, role, s, e, n: consecutive rows of one role; a gap above `gap` to all that came before in the run also ends it."""
    order = Window.partitionBy(*keys).orderBy("s", "e", ident)
    rows = df.withColumn("_turn", F.sum(F.when(F.lag(role).over(order).eqNullSafe(F.col(role)), 0).otherwise(1)).over(order))
    if gap is not None:
        within = Window.partitionBy(*keys, "_turn").orderBy("s", "e", ident)
        reach = F.max("e").over(within.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_part", F.when(F.col("s") > reach + gap, 1).otherwise(0))
        rows = rows.withColumn("_cut", F.when(F.lag("_turn").over(order).eqNullSafe(F.col("_turn")), F.col("_part")).otherwise(1))
        rows = rows.withColumn("_turn", F.sum("_cut").over(order))
    return rows.groupBy(*keys, F.col("_turn").alias("run"), role).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


def gap_audit(df: DataFrame, keys: list[str], ident: str, *, slack: int = 0) -> DataFrame:
    """keys, ident, kind, size: gap or overlap between each row and the one ahead of it, beyond `slack`."""
    order = Window.partitionBy(*keys).orderBy("s", "e", ident)
    seen = df.withColumn("_d", F.col("s") - F.lag("e").over(order)).where(F.abs("_d") > slack)
    return seen.select(*keys, ident, F.when(F.col("_d") > 0, "gap").otherwise("overlap").alias("kind"), F.abs("_d").alias("size"))


def transitions(df: DataFrame, keys: list[str], role: str, ident: str) -> DataFrame:
    """from_role, to_role, n: how often one role follows another within a key."""
    order = Window.partitionBy(*keys).orderBy("s", "e", ident)
    pairs = df.withColumn("to_role", F.lead(role).over(order)).where("to_role is not null")
    return pairs.groupBy(F.col(role).alias("from_role"), "to_role").agg(F.count("*").alias("n"))


def adjacent_pairs(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, place (from 1), from_id, to_id, at: each row of a key, but its last, with the one that follows it and where that begins."""
    order = Window.partitionBy(*keys).orderBy("s", "e", ident)
    rows = df.select(*keys, F.row_number().over(order).alias("place"), F.col(ident).alias("from_id"), F.lead(ident).over(order).alias("to_id"), F.lead("s").over(order).alias("at"))
    return rows.where("to_id is not null")


def with_gaps(df: DataFrame, keys: list[str], ident: str, *, slack: int = 0) -> DataFrame:
    """keys, place (from 0), ident, s, length: rows in order, with a row without ident where more than `slack` is free ahead of one (from 0 on)."""
    order = Window.partitionBy(*keys).orderBy("s", "e", ident)
    reach = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.select(*keys, F.col(ident), "s", "e", reach.alias("_r"))
    gap = F.when(F.col("s") > F.col("_r") + slack, F.struct(F.lit(None).cast("long").alias("ident"), F.col("_r").alias("s"), (F.col("s") - F.col("_r")).alias("length")))
    clip = F.struct(F.col(ident).alias("ident"), F.col("s"), (F.col("e") - F.col("s")).alias("length"))
    parts = rows.select(*keys, F.col("s").alias("_s"), F.col("e").alias("_e"), F.col(ident).alias("_i"), F.posexplode(F.array_compact(F.array(gap, clip))).alias("_k", "_x"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_s", "_e", "_i", "_k")) - 1
    return parts.select(*keys, place.alias("place"), F.col("_x.ident").alias(ident), F.col("_x.s").alias("s"), F.col("_x.length").alias("length"))


def continue_captions(captions: DataFrame, events: DataFrame, keys: list[str], *, space: int, shortest: int) -> DataFrame:
    """keys, caption, event, s, e: captions shown until the next one of their key less `space` (but for `shortest` at least), one row for each event they meet.

    captions: keys, caption, s, e; events: keys, event, s, e. The last caption of a key keeps its own end.
    """
    following = F.min(F.col("s")).over(Window.partitionBy(*keys).orderBy("s").rangeBetween(1, Window.unboundedFollowing))
    shown = captions.select(*keys, "caption", F.col("s").alias("ls"), F.when(following.isNull(), F.col("e")).otherwise(F.greatest(F.col("s") + shortest, following - space)).alias("le"))
    there = events.select(*keys, "event", F.col("s").alias("rs"), F.col("e").alias("re"))
    return overlap_join(shown, there, keys).select(*keys, "caption", "event", F.greatest("ls", "rs").alias("s"), F.least("le", "re").alias("e"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], ident: str, at: str = "s") -> DataFrame:
    """keys, ident, near, distance: for each row of left the row of right nearest in time, either way; ties go to the earlier, then the smaller ident.

    Rows of a key are read once in time order, carrying the last row of right seen and, backwards, the next one.
    """
    both = left.select(*keys, ident, F.col(at).alias("_t"), F.lit(1).alias("_left")).union(right.select(*keys, ident, F.col(at).alias("_t"), F.lit(0).alias("_left")))
    mark = F.when(F.col("_left") == 0, F.struct("_t", ident))
    order = Window.partitionBy(*keys).orderBy("_t", "_left", F.col(ident).desc())
    # of several at one time the smallest ident stands last before, and the window behind begins with it as well
    back = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_left").desc(), F.col(ident).desc())
    seen = both.withColumn("_p", F.last(mark, True).over(order)).withColumn("_n", F.last(mark, True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d_p, d_n = F.col("_t") - F.col("_p._t"), F.col("_n._t") - F.col("_t")
    take_p = d_n.isNull() | (d_p <= d_n)
    rows = seen.where("_left = 1 and (_p is not null or _n is not null)")
    return rows.select(*keys, ident, F.when(take_p, F.col(f"_p.{ident}")).otherwise(F.col(f"_n.{ident}")).alias("near"), F.when(take_p, d_p).otherwise(d_n).alias("distance"))


def remap(df: DataFrame, cuts: DataFrame, keys: list[str], ident: str, at: str = "s") -> DataFrame:
    """keys, ident, at, mapped: times after the cuts (keys, s, e) are taken out; a time inside a cut maps to null. Cuts may overlap.

    One pass in time order: the length of the cuts that have ended so far, and the last cut begun.
    """
    merged = interval_union(cuts, keys)
    points = df.select(*keys, ident, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_len"), F.lit(None).cast("long").alias("_e"))
    begun = merged.select(*keys, F.lit(None).cast("long").alias(ident), F.col("s").alias("_t"), F.lit(0).alias("_k"), (F.col("e") - F.col("s")).alias("_len"), F.col("e").alias("_e"))
    order = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = points.union(begun).withColumn("_gone", F.sum("_len").over(order)).withColumn("_until", F.max("_e").over(order))
    mapped = F.when(F.col("_until").isNull() | (F.col("_t") >= F.col("_until")), F.col("_t") - F.col("_gone"))
    return seen.where("_k = 1").select(*keys, ident, F.col("_t").alias(at), mapped.alias("mapped"))


def tiles(df: DataFrame, keys: list[str], *, width: int) -> DataFrame:
    """keys, tile, s, e: each interval cut into tiles of `width` from its start; the last may be shorter."""
    starts = F.when(F.col("e") > F.col("s"), F.sequence(F.lit(0), F.floor((F.col("e") - F.col("s") - 1) / width)))
    cut = df.select(*keys, "s", "e", F.explode(starts).alias("tile"))
    begin = F.col("s") + F.col("tile") * width
    return cut.select(*keys, "tile", begin.alias("s"), F.least(begin + width, F.col("e")).alias("e"))


def ripple(df: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """df with `begin`: the sum of the lengths ahead of a row."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("begin", F.coalesce(F.sum(length).over(before), F.lit(0)))


def weighted_split(df: DataFrame, keys: list[str], order: list[str], weight: str, total: int) -> DataFrame:
    """df with `s` and `e`: [0, total) shared among a key's rows by weight (whole numbers), in order, gapless.

    Rows of a key whose weights are all 0 share evenly.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    own = F.when(F.sum(weight).over(whole) == 0, F.lit(1)).otherwise(F.col(weight))
    rows = df.withColumn("_w", own).withColumn("_done", F.sum("_w").over(upto)).withColumn("_all", F.sum("_w").over(whole))
    at = [F.floor(x * total / F.col("_all")).cast("long") for x in (F.col("_done") - F.col("_w"), F.col("_done"))]
    return rows.withColumn("s", at[0]).withColumn("e", at[1]).drop("_w", "_done", "_all")


def clamp_readable(df: DataFrame, keys: list[str], ident: str, *, shortest: int, space: int) -> DataFrame:
    """df with `e` moved to at least s + shortest, but not past the next start less `space`."""
    following = F.lead("s").over(Window.partitionBy(*keys).orderBy("s", "e", ident))
    wanted = F.greatest("e", F.col("s") + shortest)
    return df.withColumn("e", F.when(following.isNull(), wanted).otherwise(F.greatest(F.col("s"), F.least(wanted, following - space))))


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], ident: str, other: str) -> DataFrame:
    """keys, ident, other, overlap: for each left interval the right one that holds its midpoint, else overlaps it most; ties to the earlier, then smaller."""
    middle = (F.col("ls") + F.col("le")) / 2
    holds = (F.col("rs") <= middle) & (middle < F.col("re"))
    pairs = overlap_join(left, right, keys)
    rank = F.struct(holds.cast("int").alias("h"), F.col("overlap").alias("o"), (-F.col("rs")).alias("r"), (-F.col(other)).alias("i"))
    best = pairs.groupBy(*keys, ident).agg(F.max_by(F.struct(other, "overlap"), rank).alias("b"))
    return best.select(*keys, ident, f"b.{other}", "b.overlap")


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], ident: str, other: str) -> DataFrame:
    """keys, ident, other: the first range (by start, then `other`) that a point lies in; points outside all are left out."""
    left = points.select(*keys, ident, F.col("s").alias("ls"), (F.col("s") + 1).alias("le"))
    right = ranges.select(*keys, other, F.col("s").alias("rs"), F.col("e").alias("re"))
    return overlap_join(left, right, keys).groupBy(*keys, ident).agg(F.min_by(other, F.struct("rs", other)).alias(other))


def split_at(df: DataFrame, points: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, ident, piece, s, e: each interval cut at the points (keys, s) inside it."""
    left = df.select(*keys, ident, F.col("s").alias("ls"), F.col("e").alias("le"))
    cuts = points.select(*keys, F.col("s").alias("rs"), (F.col("s") + 1).alias("re")).distinct()
    inside = overlap_join(left, cuts, keys).where("rs > ls").select(*keys, ident, F.col("ls"), F.col("le"), F.col("rs").alias("s"))
    starts = left.where("le > ls").select(*keys, ident, "ls", "le", F.col("ls").alias("s")).union(inside)
    order = Window.partitionBy(*keys, ident, "ls", "le").orderBy("s")
    return starts.select(*keys, ident, (F.row_number().over(order) - 1).alias("piece"), "s", F.coalesce(F.lead("s").over(order), "le").alias("e"))


def overwrite(plan: DataFrame, windows: DataFrame, keys: list[str], ident: str, role: str, forced: str) -> DataFrame:
    """keys, ident, role, s, e: the plan with `forced` as role inside the windows (keys, s, e), its rows cut at their ends."""
    rest = interval_difference(plan, windows, keys, ident).join(plan.select(*keys, ident, role), [*keys, ident])
    merged = interval_union(windows, keys).select(*keys, F.col("s").alias("rs"), F.col("e").alias("re"))
    left = plan.select(*keys, ident, F.col("s").alias("ls"), F.col("e").alias("le"))
    inside = overlap_join(left, merged, keys).select(*keys, ident, F.greatest("ls", "rs").alias("s"), F.least("le", "re").alias("e"), F.lit(forced).alias(role))
    return rest.select(*keys, ident, role, "s", "e").union(inside.select(*keys, ident, role, "s", "e"))


def cut_audit(cuts: DataFrame, marks: DataFrame, keys: list[str], ident: str, *, near: int) -> DataFrame:
    """keys, ident, distance: cuts that miss the nearest mark, but by no more than `near`."""
    return nearest(cuts, marks, keys, ident).where((F.col("distance") > 0) & (F.col("distance") <= near)).select(*keys, ident, "distance")


def replace_ranges(df: DataFrame, cuts: DataFrame, keys: list[str], ident: str, at: str = "s") -> DataFrame:
    """keys, ident, at, mapped: times after each cut (keys, s, e, card) gives way to a card of another length; a time inside a cut falls on its card's start.

    Cuts don't overlap; one that begins before another has ended doesn't count.
    """
    before = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    good = cuts.withColumn("_reach", F.max("e").over(before)).where("_reach is null or s >= _reach")
    none = F.lit(None).cast("long")
    points = df.select(*keys, ident, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_shift"), none.alias("_s"), none.alias("_e"), F.lit(0).cast("long").alias("_own"))
    own = (F.col("card") - (F.col("e") - F.col("s"))).cast("long")
    begun = good.select(*keys, none.alias(ident), F.col("s").alias("_t"), F.lit(0).alias("_k"), own.alias("_shift"), F.col("s").alias("_s"), F.col("e").alias("_e"), own.alias("_own"))
    order = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_k") == 0, F.struct("_s", "_e", "_own")), True).over(order)
    seen = points.union(begun).withColumn("_sum", F.sum("_shift").over(order)).withColumn("_last", last).where("_k = 1")
    inside = F.coalesce(F.col("_t") < F.col("_last._e"), F.lit(False))
    mapped = F.when(inside, F.col("_last._s") + F.col("_sum") - F.col("_last._own")).otherwise(F.col("_t") + F.col("_sum"))
    return seen.select(*keys, ident, F.col("_t").alias(at), mapped.alias("mapped"))


def push_forward(df: DataFrame, keys: list[str], ident: str, *, length: int) -> DataFrame:
    """keys, ident, s, e: rows of one length in order of their planned start, each moved on to where the one ahead ends if that is later."""
    order = Window.partitionBy(*keys).orderBy("s", ident)
    rows = df.select(*keys, ident, "s", (F.row_number().over(order) * length).alias("_n"))
    begin = F.max(F.col("s") - F.col("_n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_n")
    return rows.select(*keys, ident, begin.alias("s"), (begin + length).alias("e"))
