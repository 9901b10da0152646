"""Camera plans: gapless normal form, source coverage with fallback, boundary snapping and pushing, layers, close-ups, holds.

A plan holds, for each key, rows (s, e, role, ident) in whole microseconds from 0 to `duration`. Whatever can be said by
windows over a key's rows or by bucketed range joins is; only the hold of a chosen camera, which depends on when
the last one was chosen, is folded row by row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.intervals import containing, interval_union, nearest


def _merged_roles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place (from 0), s, e, role: gapless rows with neighbours of one role merged."""
    order = Window.partitionBy(*keys).orderBy("s")
    turns = rows.withColumn("_turn", F.sum(F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1)).over(order))
    return turns.groupBy(*keys, (F.col("_turn") - 1).alias("place"), "role").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*keys, "place", "s", "e", "role")


def normalize(df: DataFrame, keys: list[str], *, duration: int, fallback: str, least: int = 1) -> DataFrame:
    """keys, place, s, e, role: a gapless plan over [0, duration).

    Rows are cut to the span, and go if less than `least` is left. In order of (s, e, ident) the later row of an overlap
    begins where all before it have ended, and goes if it ends before that; a gap belongs to the row ahead of it, a gap at the
    beginning to `fallback`; neighbours of one role merge. A key without rows that stay gets `fallback` throughout.
    """
    # one pass over df, dealt by keys once: each key's first row brings the fallback along
    cut = df.select(*keys, F.greatest(F.lit(0), F.least("s", F.lit(duration))).alias("_s"), F.greatest(F.lit(0), F.least("e", F.lit(duration))).alias("_e"), "role", "ident")
    good = cut.withColumn("_good", F.coalesce(F.col("_e") - F.col("_s") >= least, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy("_s", "_e", "ident")
    reach = F.coalesce(F.max(F.when(F.col("_good"), F.col("_e"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = good.withColumn("_reach", reach).withColumn("_first", F.row_number().over(order) == 1)
    # the fallback holds from 0 unless a row begins there
    begun = F.when(F.col("_good") & (F.col("_e") > F.col("_reach")), F.struct(F.greatest("_s", "_reach").cast("long").alias("s"), F.lit(1).alias("_own"), F.col("role").alias("role")))
    head = F.when(F.col("_first"), F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("_own"), F.lit(fallback).alias("role")))
    starts = seen.select(*keys, F.explode(F.filter(F.array(begun, head), lambda x: x.isNotNull())).alias("_x")).groupBy(*keys, F.col("_x.s").alias("s")).agg(F.max_by("_x.role", "_x._own").alias("role"))
    order = Window.partitionBy(*keys).orderBy("s")
    return _merged_roles(starts.withColumn("e", F.coalesce(F.lead("s").over(order), F.lit(duration))), keys)


def atoms(plan: DataFrame, cuts: DataFrame, keys: list[str], *, duration: int) -> DataFrame:
    """keys, s, e, role: the gapless plan cut at the points (keys, s) too; points outside it don't count."""
    inside = cuts.select(*keys, F.col("s").cast("long").alias("s")).where((F.col("s") > 0) & (F.col("s") < duration))
    points = plan.select(*keys, "s", "role").union(inside.select(*keys, "s", F.lit(None).cast("string"))).groupBy(*keys, "s").agg(F.max("role").alias("_r"))
    order = Window.partitionBy(*keys).orderBy("s")
    rows = points.withColumn("e", F.coalesce(F.lead("s").over(order), F.lit(duration))).withColumn("role", F.last("_r", True).over(order))
    return rows.where("role is not null").select(*keys, "s", "e", "role")


def cover(plan: DataFrame, windows: DataFrame, keys: list[str], *, duration: int, cameras: list[str]) -> DataFrame:
    """keys, s, e, role, from_role, reason: the plan's atoms, those outside their source's window given to another camera.

    windows: keys, role, ws, we, one row for a source whose span is known; the others cover everything. An atom is covered
    if its middle lies in [ws, we]. The first of `cameras` that covers it takes over (`outside source coverage`); if
    none does it keeps its role (`no covered fallback source`). reason is null where nothing is wrong.
    """
    cuts = windows.select(*keys, F.explode(F.array("ws", "we")).alias("s"))
    known = windows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct("ws", "we")))).alias("_w"))
    rows = atoms(plan, cuts, keys, duration=duration).join(known, keys, "left").withColumn("_mid", (F.col("s") + F.col("e")) / 2)

    def covers(role: Column) -> Column:
        window = F.try_element_at("_w", role)
        return F.coalesce((window["ws"] <= F.col("_mid")) & (F.col("_mid") <= window["we"]), F.lit(True))

    other = F.lit(None).cast("string")
    for camera in reversed(cameras):
        other = F.when(covers(F.lit(camera)), F.lit(camera)).otherwise(other)
    fine = covers(F.col("role"))
    reason = F.when(~fine, F.when(other.isNull(), "no covered fallback source").otherwise("outside source coverage"))
    return rows.select(*keys, "s", "e", F.when(fine, F.col("role")).otherwise(F.coalesce(other, "role")).alias("role"), F.col("role").alias("from_role"), reason.alias("reason"))


def snap(plan: DataFrame, points: DataFrame, keys: list[str], *, duration: int, fallback: str, most: int = 0) -> DataFrame:
    """keys, place, s, e, role: the plan with each inner boundary moved to the nearest point (keys, s, ident).

    A boundary whose nearest point is further than `most` (0: no bound) stays; one that would fall behind an earlier one
    collapses onto it, and the row between them goes.
    """
    inner = plan.where("s > 0").select(*keys, F.col("place").alias("ident"), "s")
    near = nearest(inner, points.select(*keys, "ident", "s"), keys, "ident").withColumnRenamed("ident", "place")
    at = points.select(*keys, F.col("ident").alias("near"), F.col("s").alias("_to")).groupBy(*keys, "near").agg(F.min("_to").alias("_to"))
    moved = plan.join(near.join(at, [*keys, "near"]).select(*keys, "place", "_to"), [*keys, "place"], "left")
    far = F.col("_to").isNull() | ((F.abs(F.col("_to") - F.col("s")) > most) if most else F.lit(False))
    order = Window.partitionBy(*keys).orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = moved.withColumn("_b", F.when(F.col("s") == 0, F.lit(0)).when(far, F.col("s")).otherwise(F.col("_to"))).withColumn("_b", F.max("_b").over(upto))
    rows = begun.withColumn("_end", F.coalesce(F.lead("_b").over(order), F.lit(duration))).select(*keys, F.col("_b").alias("s"), F.col("_end").alias("e"), "role", F.col("place").alias("ident"))
    return normalize(rows, keys, duration=duration, fallback=fallback)


def push_past(boundaries: DataFrame, captions: DataFrame, keys: list[str], ident: str, *, grace: int = 0) -> DataFrame:
    """keys, ident, s, moved: each boundary (keys, ident, s) that falls inside captions moved to where they end, but not past the next boundary.

    A caption is active from `grace` before its start; captions that overlap or touch hold a boundary together.
    """
    blocks = interval_union(captions.select(*keys, (F.col("s") - grace).alias("s"), "e"), keys).select(*keys, "island", "s", "e")
    inside = containing(boundaries, blocks, keys, ident, "island").join(blocks.select(*keys, "island", F.col("e").alias("_until")), [*keys, "island"])
    following = boundaries.withColumn("_next", F.lead("s").over(Window.partitionBy(*keys).orderBy("s", ident)))
    rows = following.join(inside.select(*keys, ident, "_until"), [*keys, ident], "left")
    return rows.select(*keys, ident, "s", F.least(F.coalesce("_until", "s"), F.coalesce("_next", "_until", "s")).alias("moved"))


def layered(plan: DataFrame, layers: list[tuple[str, DataFrame]], keys: list[str], *, duration: int) -> DataFrame:
    """keys, s, e, kind, ref: the plan's atoms under layers (kind, intervals with keys, s, e, ref), the first layer on top.

    kind is `camera` and ref the role where no layer covers the atom; of several intervals of a layer the first by (s, ref) counts.
    """
    cuts = None
    for _, frame in layers:
        own = frame.select(*keys, F.explode(F.array("s", "e")).alias("s"))
        cuts = own if cuts is None else cuts.union(own)
    rows = atoms(plan, cuts, keys, duration=duration)
    rows = rows.withColumn("_id", F.col("s"))
    kind, ref = F.lit("camera"), F.col("role")
    for name, frame in reversed(layers):
        found = containing(rows.select(*keys, "_id", "s"), frame.select(*keys, F.col("ref").alias(f"_{name}"), "s", "e"), keys, "_id", f"_{name}")
        rows = rows.join(found, [*keys, "_id"], "left")
        there = F.col(f"_{name}").isNotNull()
        kind, ref = F.when(there, F.lit(name)).otherwise(kind), F.when(there, F.col(f"_{name}").cast("string")).otherwise(ref)
    return rows.select(*keys, "s", "e", kind.alias("kind"), ref.alias("ref"))


def closeups_in_speech(plan: DataFrame, speech: DataFrame, keys: list[str], *, duration: int, master: str, least: int = 1) -> DataFrame:
    """keys, place, s, e, role: the plan with every other camera held to the speech ranges (keys, s, e); the rest is the master's."""
    ranges = interval_union(speech.dropna(subset=keys), keys).where("e > s")
    edges = ranges.select(*keys, F.explode(F.array(F.struct(F.col("s"), F.lit(True).alias("_in")), F.struct(F.col("e").alias("s"), F.lit(False).alias("_in")))).alias("_x")).select(*keys, "_x.s", "_x._in")
    begun = plan.select(*keys, "s", F.struct("e", "role", F.col("place").alias("ident")).alias("_row"))
    points = begun.withColumn("_in", F.lit(None).cast("boolean")).unionByName(edges, allowMissingColumns=True)
    # of several rows at one time the longest holds; a key's points are read once in time order, carrying row and speech
    points = points.groupBy(*keys, "s").agg(F.max("_row").alias("_own"), F.max("_in").alias("_in"))
    order = Window.partitionBy(*keys).orderBy("s")
    held = points.select(*keys, "s", F.last("_own", True).over(order).alias("_row"), F.col("_own").isNotNull().alias("_begins"), F.coalesce(F.last("_in", True).over(order), F.lit(False)).alias("_in"), F.lead("s").over(order).alias("_next"))
    whole = F.coalesce(F.col("_row.role") == master, F.lit(False))
    pieces = held.where((whole & F.col("_begins")) | (~whole & (F.col("s") < F.col("_row.e"))))
    end = F.when(whole, F.col("_row.e")).otherwise(F.least("_row.e", "_next"))
    rows = pieces.select(*keys, "s", end.alias("e"), F.when(whole | F.col("_in"), F.col("_row.role")).otherwise(F.lit(master)).alias("role"), F.col("_row.ident").alias("ident"))
    return normalize(rows, keys, duration=duration, fallback=master, least=least)


def delay_windows(runs: DataFrame, keys: list[str], *, before: str, after: str, delay: int) -> DataFrame:
    """keys, s, e: the first `delay` of each run of `after` that follows a run of `before` (runs: keys, run, role, s, e)."""
    previous = F.lag("role").over(Window.partitionBy(*keys).orderBy("run"))
    return runs.withColumn("_p", previous).where((F.col("_p") == before) & (F.col("role") == after)).select(*keys, "s", F.least("e", F.col("s") + delay).alias("e"))


def hold_round_robin(captions: DataFrame, keys: list[str], *, cameras: list[str], master: str, asks: str, hold: int) -> DataFrame:
    """keys, ident, s, e, role: captions (s, e, speaker, ident) with cameras in turn; a chosen one stays for `hold`, `asks` gets the master.

    A caption that begins when the hold has run out takes the next camera. One key's captions meet in one task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in captions.schema}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "e", "ident"])
        turn, until, active, roles = 0, 0, cameras[0], []
        for s, speaker in zip(pdf["s"], pdf["speaker"], strict=True):
            if speaker != asks and s >= until:
                active, turn, until = cameras[turn % len(cameras)], turn + 1, s + hold
            roles.append(master if speaker == asks else active)
        return pdf.assign(role=roles)[[*keys, "ident", "s", "e", "role"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"ident {kinds['ident']}", "s long", "e long", "role string"])
    return captions.groupBy(*keys).applyInPandas(choose, schema)


def smooth_neighbours(rows: DataFrame, keys: list[str], *, sure: float) -> DataFrame:
    """keys, ident, role, confidence, smoothed: a row less sure than `sure` takes the role that the row ahead (as smoothed) and the next one share.

    rows: keys, s, ident, role, confidence. Its confidence becomes 0.5 if it was less. One key's rows meet in one task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "ident"])
        roles, given = list(pdf["role"]), list(pdf["confidence"])
        for i in range(1, len(roles) - 1):
            if given[i] < sure and roles[i - 1] == roles[i + 1]:
                roles[i] = roles[i - 1]
        changed = [False, *(given[i] < sure and roles[i - 1] == pdf["role"].iat[i + 1] for i in range(1, len(roles) - 1)), False][: len(roles)]
        return pdf.assign(role=roles, confidence=[max(c, 0.5) if x else c for c, x in zip(given, changed, strict=True)], smoothed=changed)[[*keys, "ident", "role", "confidence", "smoothed"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"ident {kinds['ident']}", "role string", "confidence double", "smoothed boolean"])
    return rows.groupBy(*keys).applyInPandas(smooth, schema)


def absorb_short(runs: DataFrame, keys: list[str], *, least: int) -> DataFrame:
    """keys, place, s, e, role: runs (s, e, role) shorter than `least` joined to the run ahead of them; neighbours of one role merge.

    Short runs at the beginning join the first that is long enough; where all are short, the first one's role holds.
    """
    order = Window.partitionBy(*keys).orderBy("s", "e")
    long = F.col("e") - F.col("s") >= least
    upto, all_rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    role = F.coalesce(F.last(F.when(long, F.col("role")), True).over(upto), F.first(F.when(long, F.col("role")), True).over(all_rows), F.first("role").over(all_rows))
    return _merged_roles(runs.withColumn("role", role).select(*keys, "s", "e", "role"), keys)
