"""Timelines: validation with coded findings, changed regions between versions, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import interval_union, overlap_join, overlap_violations


def validate(clips: DataFrame, tracks: DataFrame, sources: DataFrame, duration: int, *, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """clip_id, code: what is wrong. clips: clip_id, track_id, source_id, s, e, allow_overlap; tracks: track_id; sources: source_id.

    Codes: duplicate_id, empty_range, before_start, after_end, unknown_track, unknown_source, overlap; with `kinds` (a clip's
    kind -> kinds of source that suit it; both frames have `kind`) also wrong_kind.
    Overlap is judged between neighbours of a track by (s, e, clip_id), after clips that allow it are left out.
    """
    twice = clips.groupBy("clip_id").agg(F.count("*").alias("n")).where("n > 1").select("clip_id", F.lit("duplicate_id").alias("code"))
    rules = F.array_compact(F.array(F.when(F.col("e") <= F.col("s"), "empty_range"), F.when(F.col("s") < 0, "before_start"), F.when(F.col("e") > duration, "after_end")))
    own = clips.select("clip_id", F.explode(rules).alias("code"))
    lost_track = clips.join(tracks, "track_id", "left_anti").select("clip_id", F.lit("unknown_track").alias("code"))
    lost_source = clips.where("source_id is not null").join(sources, "source_id", "left_anti").select("clip_id", F.lit("unknown_source").alias("code"))
    over = overlap_violations(clips.where("not coalesce(allow_overlap, false)"), ["track_id"], "clip_id").select("clip_id", F.lit("overlap").alias("code"))
    found = twice.union(own).union(lost_track).union(lost_source).union(over)
    if kinds:
        suits = F.lit(False)
        for kind, good in kinds.items():
            suits = suits | ((F.col("kind") == kind) & F.col("_kind").isin(*good))
        known = F.col("kind").isin(*kinds)
        pairs = clips.select("clip_id", "source_id", "kind").join(sources.select("source_id", F.col("kind").alias("_kind")).distinct(), "source_id")
        found = found.union(pairs.where(known & ~suits).select("clip_id", F.lit("wrong_kind").alias("code")))
    return found


def changed_regions(before: DataFrame | None, after: DataFrame, key: str, *, pad: int, duration: int, source: str | None = None, changed_sources: DataFrame | None = None, span: int = 86_400_000_000) -> DataFrame:
    """region, s, e, n, reason: merged ranges in which a version differs from the one before (rows: key, s, e, print); touching ranges merge.

    A changed row counts from the earlier of its starts to the later of its ends. A region has a row for each of its n reasons:
    `clip_added:key` and so on; of rows that are equal, those whose `source` is among changed_sources (a column of that name) count as
    `clip_source_changed`. Without a version before, all of [0, duration) is one region, `missing_previous_timeline`.
    span: the stretch of time that one task holds.
    """
    if before is None:
        spark = after.sparkSession
        return spark.sql(f"select 1L as region, 0L as s, cast({duration} as long) as e, 1L as n, 'missing_previous_timeline' as reason")
    fields = ["s", "e", "print"] + ([source] if source else [])
    a, b = before.select(key, F.struct(*fields).alias("a")), after.select(key, F.struct(*fields).alias("b"))
    both = a.join(b, key, "full_outer")
    reason = F.when(F.col("a").isNull(), "clip_added").when(F.col("b").isNull(), "clip_removed").when(~F.col("a").eqNullSafe(F.col("b")), "clip_changed")
    if source and changed_sources is not None:
        both = both.withColumn("_source", F.col(f"b.{source}")).join(changed_sources.select(F.col(source).alias("_source"), F.lit(True).alias("_new")).distinct(), "_source", "left")
        reason = F.coalesce(reason, F.when(F.col("_new"), "clip_source_changed"))
    found = both.select(F.least("a.s", "b.s").alias("s"), F.greatest("a.e", "b.e").alias("e"), F.concat(reason, F.lit(":"), F.col(key).cast("string")).alias("reason"))
    merged = interval_union(found.where("reason is not null and e > s"), [], pad=pad, clamp=(0, duration), min_len=1, members="reason", span=span)
    return merged.select(F.col("island").alias("region"), "s", "e", "n", "reason")


def slice_timeline(clips: DataFrame, sources: DataFrame, transitions: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clips, sources, transitions) of [start, end): clips cut and moved to begin at 0, sources still in use, transitions both of whose ends are left.

    transitions: from_id, to_id (null: no clip there), at. A transition outside the range goes too.
    """
    inside = slice_clips(clips, start, end)
    ids = inside.select(F.col("clip_id").alias("_id")).distinct()
    ended = transitions.where((F.col("at") >= start) & (F.col("at") < end))
    for side in ("from_id", "to_id"):
        ended = ended.join(ids.withColumnRenamed("_id", side).withColumn(f"_{side}", F.lit(True)), side, "left").where(F.col(side).isNull() | F.col(f"_{side}")).drop(f"_{side}")
    return inside, sources.join(inside.select("source_id"), "source_id", "left_semi"), ended.withColumn("at", F.col("at") - start)


def layout_audit(spoken: DataFrame, layouts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, utterance, layout: parts of utterances (keys, utterance, speaker, s, e) shown under a layout (keys, layout, visible, s, e) without their speaker."""
    left = spoken.select(*keys, "utterance", "speaker", F.col("s").alias("ls"), F.col("e").alias("le"))
    right = layouts.select(*keys, "layout", "visible", F.col("s").alias("rs"), F.col("e").alias("re"))
    return overlap_join(left, right, keys).where(~F.array_contains("visible", F.col("speaker"))).select(*keys, "utterance", "layout")


def slice_clips(clips: DataFrame, start: int, end: int) -> DataFrame:
    """Clips cut to [start, end) and moved to begin at 0, their source ranges shifted alike (s, e, source_in)."""
    begin, stop = F.greatest("s", F.lit(start)), F.least("e", F.lit(end))
    inside = clips.where((F.col("s") < end) & (F.col("e") > start))
    return inside.withColumn("source_in", F.col("source_in") + begin - F.col("s")).withColumn("_e", stop - start).withColumn("s", begin - start).withColumn("e", F.col("_e")).drop("_e")
