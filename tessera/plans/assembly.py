"""Timelines as documents out of relations, and findings about edit plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.intervals import adjacent_pairs, overlap_join


def _list(df: DataFrame, keys: list[str], name: str, order: list[str], fields: dict[str, str | Column]) -> DataFrame:
    """keys, name: one array of structs a key, in order."""
    value = F.struct(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))
    rows = F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"_{i}") for i, o in enumerate(order)), value.alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda r: r["_v"]).alias(name))


def timeline_documents(timelines: DataFrame, tracks: DataFrame, clips: DataFrame, sources: DataFrame, keys: list[str], *, joined: int = 0) -> DataFrame:
    """keys, document, dropped: a JSON timeline for each row of `timelines` (keys, duration), and how many clips it had to leave out.

    tracks: keys, track_id, kind, allow_overlap; clips: keys, clip_id, track_id, source_id, kind, s, e, source_in; sources: keys, source_id, kind, length.
    Clips are cut to the timeline; those left without length, without their track or source, or reaching behind their source's end are left out, as are
    repeated clip ids but the first. Sources that no clip uses are left out, tracks stay. Each clip carries where in its source it begins and
    ends. Transitions stand where a clip of a track ends and the next begins at most `joined` later. Arrays are in the order of ids, clips in that of tracks
    and time. Every reference is checked by one join a relation, then all relations meet once a key.
    """
    span = clips.join(timelines.select(*keys, "duration"), keys).withColumn("_s", F.greatest("s", F.lit(0))).withColumn("_e", F.least("e", "duration"))
    known = span.join(tracks.select(*keys, "track_id").distinct().withColumn("_track", F.lit(True)), [*keys, "track_id"], "left")
    known = known.join(sources.groupBy(*keys, "source_id").agg(F.max("length").alias("_length")), [*keys, "source_id"], "left")
    begin = F.col("source_in") + F.col("_s") - F.col("s")
    known = known.withColumn("_in", begin).withColumn("_out", begin + F.col("_e") - F.col("_s"))
    good = F.coalesce((F.col("_e") > F.col("_s")) & F.col("_track") & (F.col("_in") >= 0) & (F.col("_out") <= F.col("_length")), F.lit(False))
    first = F.row_number().over(Window.partitionBy(*keys, "clip_id").orderBy(F.desc("_good"), "_s", "_e", "track_id", "source_id"))
    rows = known.withColumn("_good", good).withColumn("_good", F.col("_good") & (first == 1))
    lost = rows.groupBy(*keys).agg(F.count_if(~F.col("_good")).alias("dropped"))
    kept = rows.where("_good").select(*keys, "clip_id", "track_id", "source_id", "kind", F.col("_s").alias("s"), F.col("_e").alias("e"), F.col("_in").alias("a"), F.col("_out").alias("z"))
    pairs = adjacent_pairs(kept, [*keys, "track_id"], "clip_id")
    ends = kept.select(*keys, F.col("clip_id").alias("from_id"), F.col("e").alias("_end"))
    starts = kept.select(*keys, F.col("clip_id").alias("to_id"), F.col("s").alias("at"))
    met = pairs.select(*keys, "from_id", "to_id").join(ends, [*keys, "from_id"]).join(starts, [*keys, "to_id"]).where((F.col("at") >= F.col("_end")) & (F.col("at") - F.col("_end") <= joined))
    used = sources.join(kept.select(*keys, "source_id").distinct(), [*keys, "source_id"], "left_semi").groupBy(*keys, "source_id").agg(F.min("kind").alias("kind"), F.max("length").alias("length"))
    lists = [
        _list(used, keys, "sources", ["source_id"], {"id": "source_id", "kind": "kind", "duration": "length"}),
        _list(tracks.dropDuplicates([*keys, "track_id"]), keys, "tracks", ["track_id"], {"id": "track_id", "kind": "kind", "allowOverlap": "allow_overlap"}),
        _list(kept, keys, "clips", ["track_id", "s", "e", "clip_id"], {"id": "clip_id", "trackId": "track_id", "sourceId": "source_id", "kind": "kind", "timelineStart": "s", "timelineEnd": "e", "sourceIn": "a", "sourceOut": "z"}),
        _list(met, keys, "transitions", ["at", "from_id", "to_id"], {"at": "at", "fromClipId": "from_id", "toClipId": "to_id"}),
    ]
    out = timelines.select(*keys, "duration").join(lost, keys, "left")
    for rows in lists:
        out = out.join(rows, keys, "left")
    parts = [F.coalesce(name, F.array().cast(out.schema[name].dataType)).alias(name) for name in ("sources", "tracks", "clips", "transitions")]
    document = F.to_json(F.struct(F.lit("1").alias("schemaVersion"), F.col("duration"), *parts))
    return out.select(*keys, document.alias("document"), F.coalesce("dropped", F.lit(0)).alias("dropped"))


def plan_findings(events: DataFrame, media: DataFrame, overlays: DataFrame, keys: list[str], *, window: tuple[int, int], styles: list[str], forbidden: list[str], slack: int = 1000, clash: tuple[str, str] = ("caption", "explainer")) -> DataFrame:
    """keys, event_id, code, level: what is wrong with an edit plan (level `error`), and what is only odd (`warning`).

    events: keys, event_id, s, e, media_id, source_in, source_out; media: media_id, length; overlays: keys, event_id, overlay_id, kind, style, text, s, e. Codes of events:
    empty_range, overlap, gap (warning), unknown_media, bad_source_range, beyond_media, outside_window; of overlays, under their event: unknown_style,
    forbidden_text, empty_overlay, overlay_outside, clash (overlays of the two kinds of `clash` of one event at one time), unknown_event. A code stands once an event.
    """
    own = [
        (F.col("e") <= F.col("s"), "empty_range"),
        (F.col("_length").isNull(), "unknown_media"),
        (F.col("_length").isNotNull() & ((F.col("source_in") < -slack) | (F.col("source_out") <= F.col("source_in"))), "bad_source_range"),
        (F.col("source_out") > F.col("_length") + slack, "beyond_media"),
        (F.col("_length").isNotNull() & ((F.col("source_in") < window[0] - slack) | (F.col("source_out") > window[1] + slack)), "outside_window"),
    ]
    known = events.join(media.groupBy("media_id").agg(F.max("length").alias("_length")), "media_id", "left")
    codes = F.array_compact(F.array(*(F.when(when, F.lit(code)) for when, code in own)))
    found = known.select(*keys, "event_id", F.explode(codes).alias("code"))
    order = Window.partitionBy(*keys).orderBy("s", "e", "event_id")
    before = events.withColumn("_e", F.lag("e").over(order))
    apart = F.when(F.col("s") < F.col("_e") - slack, "overlap").when(F.col("s") > F.col("_e") + slack, "gap")
    found = found.union(before.select(*keys, "event_id", apart.alias("code")).where("code is not null"))
    told = overlays.join(events.select(*keys, "event_id", F.col("s").alias("_s"), F.col("e").alias("_e")), [*keys, "event_id"], "left")
    says = F.lit(False)
    for word in forbidden:
        says = says | F.contains("text", F.lit(word))
    about = [
        (F.col("_s").isNull(), "unknown_event"), (F.col("style").isNotNull() & ~F.col("style").isin(*styles), "unknown_style"), (says, "forbidden_text"), (F.col("e") <= F.col("s"), "empty_overlay"),
        ((F.col("s") < F.col("_s") - slack) | (F.col("e") > F.col("_e") + slack), "overlay_outside"),
    ]
    codes = F.array_compact(F.array(*(F.when(when, F.lit(code)) for when, code in about)))
    found = found.union(told.select(*keys, "event_id", F.explode(codes).alias("code")))
    sides = [overlays.where(F.col("kind") == k).select(*keys, "event_id", F.col("s").alias(f"{side}s"), F.col("e").alias(f"{side}e")) for k, side in zip(clash, "lr", strict=True)]
    found = found.union(overlap_join(*sides, [*keys, "event_id"]).select(*keys, "event_id", F.lit("clash").alias("code")))
    return found.distinct().withColumn("level", F.when(F.col("code") == "gap", "warning").otherwise("error"))
