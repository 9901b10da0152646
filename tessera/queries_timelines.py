"""Registered queries of timelines, captions across cuts, summaries and signals, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import signals
from tessera.operators import aggregates, intervals
from tessera.plans import timeline
from tessera.queries import HOUR, MINUTE, query
from tessera.queries_plans import _LOCAL, _local
from tessera.session import table

DAY = 24 * HOUR


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir)
    return rows.select(F.col("event_id").alias("clip_id"), F.col("user_id").alias("track_id"), F.col("event_type").alias("source_id"), "s", "e", F.lit(0).cast("long").alias("source_in"))


_SLICE = f"""{_LOCAL}, c AS (SELECT event_id AS clip_id, user_id AS track_id, event_type AS source_id, greatest(s, {DAY}) - {DAY} AS s, least(e, {3 * DAY}) - {DAY} AS e, greatest(s, {DAY}) - s AS source_in FROM iv WHERE s < {3 * DAY} AND e > {DAY}),
t AS (SELECT user_id AS track_id, event_id AS from_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS to_id, lead(s) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS moment FROM iv)"""


@query(f"WITH {_SLICE} SELECT * FROM c")
def timeline_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir)
    return timeline.slice_timeline(clips, clips.select("source_id").distinct(), _transitions(spark, sf_dir), DAY, 3 * DAY)[0]


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.adjacent_pairs(_local(spark, sf_dir), ["user_id"], "event_id").withColumnRenamed("user_id", "track_id").drop("place")


@query(f"""WITH {_SLICE} SELECT track_id, from_id, to_id, moment - {DAY} AS "at" FROM t WHERE moment >= {DAY} AND moment < {3 * DAY} AND from_id IN (SELECT clip_id FROM c) AND to_id IN (SELECT clip_id FROM c)""")
def sliced_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of a slice both of whose clips are in it."""
    clips = _clips(spark, sf_dir)
    return timeline.slice_timeline(clips, clips.select("source_id").distinct(), _transitions(spark, sf_dir), DAY, 3 * DAY)[2]


@query(f"""WITH {_LOCAL} SELECT user_id, place, from_id, to_id, moment AS "at" FROM (SELECT user_id, row_number() OVER w AS place, event_id AS from_id, lead(event_id) OVER w AS to_id, lead(s) OVER w AS moment FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s, e, event_id)) WHERE to_id IS NOT NULL""")
def transition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.adjacent_pairs(_local(spark, sf_dir), ["user_id"], "event_id")


_TRACK = f"""{_LOCAL}, r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM iv),
x AS (SELECT user_id, s AS ks, e AS ke, event_id AS ki, 0 AS k, NULL AS event_id, reach AS s, s - reach AS length FROM r WHERE s > reach + 1000 UNION ALL SELECT user_id, s, e, event_id, 1, event_id, s, e - s FROM r),
track AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ks, ke, ki, k) - 1 AS place, event_id, s, length FROM x)"""


@query(f"WITH {_TRACK} SELECT * FROM track")
def track_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's clips with the gaps between them as rows, as exchange formats want them."""
    return intervals.with_gaps(_local(spark, sf_dir), ["user_id"], "event_id", slack=1000)


@query(f"""WITH {_TRACK}, b AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM track), n AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS source FROM (SELECT DISTINCT event_type FROM events))
SELECT b.user_id, b.event_id, b.begin AS s, b.length, n.source FROM b JOIN events e ON e.event_id = b.event_id JOIN n ON n.event_type = e.event_type""")
def track_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips out of a track of lengths only: each begins where all before it end; sources are numbered by name."""
    rows = intervals.with_gaps(_local(spark, sf_dir), ["user_id"], "event_id", slack=1000)
    begun = intervals.ripple(rows, ["user_id"], ["place"], "length").where("event_id is not null")
    kinds = table(spark, sf_dir, "events").select("event_type").distinct().withColumn("source", F.dense_rank().over(Window.orderBy("event_type")))
    named = table(spark, sf_dir, "events").select("event_id", "event_type").join(F.broadcast(kinds), "event_type")  # one row a kind of event
    return begun.join(named, "event_id").select("user_id", "event_id", F.col("begin").alias("s"), "length", F.col("source").cast("long").alias("source"))


@query(f"""WITH {_LOCAL}, c AS (SELECT event_id AS caption, user_id, s, e, min(s) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM iv WHERE event_type = 'view'),
h AS (SELECT caption, user_id, s, CASE WHEN nx IS NULL THEN e ELSE greatest(s + {MINUTE}, nx - {10 * MINUTE}) END AS e FROM c)
SELECT h.user_id, h.caption, v.event_id AS event, greatest(h.s, v.s) AS s, least(h.e, v.e) AS e FROM h JOIN iv v ON v.user_id = h.user_id AND v.event_type = 'error' AND v.s < h.e AND h.s < v.e AND v.e > v.s""")
def continued_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir)
    captions = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("caption"), "s", "e")
    events = rows.where("event_type = 'error'").select("user_id", F.col("event_id").alias("event"), "s", "e")
    return intervals.continue_captions(captions, events, ["user_id"], space=10 * MINUTE, shortest=MINUTE)


@query(f"""WITH {_LOCAL}, said AS (SELECT * FROM iv WHERE event_id % 2 = 0), lay AS (SELECT * FROM iv WHERE event_id % 2 = 1)
SELECT a.user_id, a.event_id AS utterance, b.event_id AS layout FROM said a JOIN lay b ON b.user_id = a.user_id AND a.s < b.e AND b.s < a.e AND least(a.e, b.e) - greatest(a.s, b.s) >= 1 WHERE NOT (b.event_type = a.event_type OR a.event_type = 'view')""")
def layout_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances under a layout that doesn't show their speaker."""
    rows = _local(spark, sf_dir)
    spoken = rows.where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("utterance"), F.col("event_type").alias("speaker"), "s", "e")
    layouts = rows.where("event_id % 2 = 1").select("user_id", F.col("event_id").alias("layout"), F.array(F.lit("view"), "event_type").alias("visible"), "s", "e")
    return timeline.layout_audit(spoken, layouts, ["user_id"])


@query(f"""WITH {_LOCAL}, o AS (SELECT *, lag(event_type) OVER w AS pt, lag(e) OVER w AS pe FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s, e, event_id)), f AS (SELECT *, CASE WHEN pt = event_type AND s <= pe + {6 * HOUR} THEN 0 ELSE 1 END AS fresh FROM o),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS block FROM f)
SELECT user_id, CAST(block AS BIGINT) AS block, event_type, min(s) AS s, arg_max(e, struct_pack(s := s, e := e, i := event_id)) AS e, count(*) AS n, greatest(arg_max(e, struct_pack(s := s, e := e, i := event_id)) - min(s), 1000) AS span FROM b GROUP BY user_id, block, event_type""")
def media_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one kind in blocks, as long as none begins long after the one ahead of it; a block ends with its last row."""
    order = Window.partitionBy("user_id").orderBy("s", "e", "event_id")
    joins = F.lag("event_type").over(order).eqNullSafe(F.col("event_type")) & (F.col("s") <= F.lag("e").over(order) + 6 * HOUR)
    rows = _local(spark, sf_dir).withColumn("fresh", F.when(joins, 0).otherwise(1)).withColumn("block", F.sum("fresh").over(order))
    last = F.max_by("e", F.struct("s", "e", "event_id"))
    return rows.groupBy("user_id", "block", "event_type").agg(F.min("s").alias("s"), last.alias("e"), F.count("*").alias("n"), F.greatest(last - F.min("s"), F.lit(1000)).alias("span"))


@query(f"""WITH {_LOCAL}, w AS (SELECT *, s // {DAY} AS day FROM iv), g AS (SELECT user_id, day, event_type, sum(value * value) AS wx, sum(value) AS x, count(*) AS n, min(s) AS first FROM w GROUP BY ALL)
SELECT user_id, CAST(day AS BIGINT) AS day, round(sum(wx) / sum(x), 6) AS mean, arg_max(event_type, struct_pack(x := round(x, 6), f := -first)) AS dominant, round(max(x) / sum(x), 6) AS share, max(x) / sum(x) >= 0.6 AS sure FROM g GROUP BY user_id, day HAVING sum(x) > 0""")
def window_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day the mean by weight, and the kind with the largest share of the weight."""
    rows = _local(spark, sf_dir).withColumn("day", F.floor(F.col("s") / DAY))
    kinds = rows.groupBy("user_id", "day", "event_type").agg(F.sum(F.col("value") * F.col("value")).alias("wx"), F.sum("value").alias("x"), F.min("s").alias("first"))
    share = F.max("x") / F.sum("x")
    top = F.max_by("event_type", F.struct(F.round("x", 6), -F.col("first")))
    found = kinds.groupBy("user_id", "day").agg(F.sum("x").alias("all"), F.sum("wx").alias("wx"), top.alias("dominant"), F.max("x").alias("most")).where("all > 0")
    return found.select("user_id", "day", F.round(F.col("wx") / F.col("all"), 6).alias("mean"), "dominant", F.round(F.col("most") / F.col("all"), 6).alias("share"), (F.col("most") / F.col("all") >= 0.6).alias("sure"))


@query(f"""WITH {_LOCAL}, c AS (SELECT user_id, event_type, count(*) AS n FROM iv GROUP BY ALL), t AS (SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r <= 3 GROUP BY user_id)
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, bool_or(value > 90) AS any_high, round(avg(value) FILTER (value < 90), 9) AS mean, max(value) FILTER (value < 90) AS most, min(s) AS s, greatest(max(e), min(s) + 1000) AS e, top FROM iv JOIN t USING (user_id) GROUP BY user_id, top""")
def asset_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, flags, means of the sound values, bounds and the most frequent kinds of each recording."""
    rows = _local(spark, sf_dir)
    kinds = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type"))), 1, 3)
    top = kinds.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["event_type"], (-x["m"]).cast("string"))), ",").alias("top"))
    sound = F.when(F.col("value") < 90, F.col("value"))
    found = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.bool_or(F.col("value") > 90).alias("any_high"), F.round(F.avg(sound), 9).alias("mean"), F.max(sound).alias("most"), F.min("s").alias("s"), F.greatest(F.max("e"), F.min("s") + 1000).alias("e"))
    return found.join(top, "user_id")


@query(f"""WITH {_LOCAL}, d AS (SELECT user_id, event_id, s, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY s, event_id)) AS d FROM iv), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, s, event_id) AS place FROM d WHERE d >= 20)
SELECT user_id, event_id, s, round(d, 6) AS d, place FROM t WHERE place <= 5""")
def scene_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest changes from one row to the next, above a threshold."""
    order = Window.partitionBy("user_id").orderBy("s", "event_id")
    d = F.abs(F.col("value") - F.lag("value").over(order))
    rows = _local(spark, sf_dir).withColumn("d", d).where("d >= 20")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("d"), "s", "event_id"))
    return rows.withColumn("place", place).where("place <= 5").select("user_id", "event_id", "s", F.round("d", 6).alias("d"), "place")


@query(f"""WITH {_LOCAL}, u AS (SELECT user_id, min(s) AS s, max(e) AS e FROM iv GROUP BY user_id) SELECT user_id, CAST(i AS INT) AS i, s + CAST(floor((e - s) * (i + 0.5::DOUBLE) / 8) AS BIGINT) AS at,
CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 + user_id % 5 WHEN 2 THEN 100 + user_id % 7 ELSE 200 END AS rank FROM (SELECT *, unnest(range(8)) AS i FROM u)""")
def candidate_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced times of each recording, and the rank of its role: master, cameras, externals, others."""
    bounds = _local(spark, sf_dir).groupBy("user_id").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    u = F.col("user_id")
    role = F.when(u % 4 == 0, "master").when(u % 4 == 1, F.concat(F.lit("camera"), (u % 5).cast("string"))).when(u % 4 == 2, F.concat(F.lit("external"), (u % 7).cast("string"))).otherwise("other")
    rows = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("role", role)
    number = F.regexp_extract("role", r"(\d+)$", 1).try_cast("int")
    rank = F.when(F.col("role") == "master", 0).when(F.col("role").startswith("camera"), 1 + number).when(F.col("role").startswith("external"), 100 + number).otherwise(200)
    return rows.select("user_id", "i", (F.col("s") + F.floor((F.col("e") - F.col("s")) * (F.col("i") + 0.5) / 8)).alias("at"), rank.cast("long").alias("rank"))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), m AS (SELECT conv_id, max(turn) FILTER (length(text) % 7 = 0) AS counted, max(turn) AS last FROM t GROUP BY conv_id),
b AS (SELECT t.conv_id, min(turn) AS first FROM t JOIN m USING (conv_id) WHERE turn > coalesce(counted, -1) AND length(text) % 5 <> 0 GROUP BY t.conv_id),
c AS (SELECT t.conv_id, min(turn) AS closing FROM t JOIN b USING (conv_id) WHERE turn > first AND length(text) % 11 = 0 GROUP BY t.conv_id)
SELECT m.conv_id, b.first, CASE WHEN b.first IS NOT NULL THEN coalesce(c.closing - 1, m.last) END AS last FROM m LEFT JOIN b USING (conv_id) LEFT JOIN c USING (conv_id)""")
def content_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first real turn behind the last countdown to the turn ahead of the first closing one."""
    n = F.length(F.coalesce("text", F.lit("")))
    own = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (n % 7 == 0).alias("count"), (n % 5 != 0).alias("real"), (n % 11 == 0).alias("closes"))
    rows = rows.withColumn("counted", F.coalesce(F.max(F.when(F.col("count"), F.col("turn"))).over(own), F.lit(-1)))
    rows = rows.withColumn("first", F.min(F.when((F.col("turn") > F.col("counted")) & F.col("real"), F.col("turn"))).over(own))
    closing = F.min(F.when((F.col("turn") > F.col("first")) & F.col("closes"), F.col("turn")))
    found = rows.groupBy("conv_id", "first").agg(closing.alias("closing"), F.max("turn").alias("end"))
    return found.select("conv_id", "first", F.when(F.col("first").isNotNull(), F.coalesce(F.col("closing") - 1, "end")).alias("last"))


# ---------------------------------------------------------------- signals


@query("""SELECT user_id, event_id, round(greatest(0.0, value - avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS rise FROM events""")
def transients(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.transients(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", width=3)
    return found.select("user_id", "event_id", F.round("rise", 6).alias("rise"))


@query("""WITH b AS (SELECT user_id, greatest(quantile_cont(value, 0.7), 25.0) AS bound FROM events GROUP BY user_id) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS active FROM events JOIN b USING (user_id) WHERE value >= bound GROUP BY user_id""")
def voice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.active_span(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", share=0.7, floor=25.0)


@query(f"""WITH {_LOCAL}, p AS (SELECT * FROM iv WHERE event_type = 'click'), f AS (SELECT * FROM iv WHERE event_type = 'view')
SELECT p.user_id, p.event_id, arg_min(f.s, struct_pack(l := f.value, d := abs(f.s - p.s), t := f.s)) AS at FROM p JOIN f ON f.user_id = p.user_id AND f.s >= p.s - {8 * HOUR} AND f.s <= p.s + {4 * HOUR} GROUP BY p.user_id, p.event_id""")
def quiet_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir)
    points = rows.where("event_type = 'click'").select("user_id", "event_id", "s")
    frames = rows.where("event_type = 'view'").select("user_id", F.col("s").alias("at"), F.col("value").alias("level"))
    return signals.quietest(points, frames, ["user_id"], "event_id", before=8 * HOUR, behind=4 * HOUR)


@query("""WITH series AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY user_id), pairs AS (SELECT a.user_id, a.v AS p, b.v AS t FROM series a JOIN series b ON b.user_id = a.user_id + 1),
st AS (SELECT user_id, p, t, unnest(range(0, len(p) - 11, 6)) AS start FROM pairs WHERE len(t) >= 12), k AS (SELECT *, unnest(range(0, len(t) - 11)) AS k FROM st), x AS (SELECT user_id, start, k, unnest(p[start + 1:start + 12]) AS x, unnest(t[k + 1:k + 12]) AS y FROM k),
c AS (SELECT user_id, start, k, CASE WHEN stddev_pop(y) > 1e-9 THEN corr(x, y) ELSE 0 END AS c FROM x GROUP BY ALL HAVING stddev_pop(x) >= 0.05), w AS (SELECT user_id, start, arg_max(k, struct_pack(c := round(c, 12), k := -k)) AS k, arg_max(c, struct_pack(c := round(c, 12), k := -k)) AS c FROM c GROUP BY user_id, start),
b AS (SELECT user_id, arg_max(struct_pack(start := start, lag := k - start, c := c), struct_pack(c := round(c, 12), s := -start)) AS b FROM w GROUP BY user_id)
SELECT pairs.user_id, CAST(b.start AS INT) AS start, CAST(b.lag AS INT) AS lag, round(b.c, 6) AS score FROM pairs LEFT JOIN b ON b.user_id = pairs.user_id""")
def window_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where any stretch of one recording's levels lies best in another's."""
    series = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    other = series.select((F.col("user_id") - 1).alias("user_id"), F.col("v").alias("target"))
    pairs = series.withColumnRenamed("v", "probe").join(other, "user_id")
    found = signals.window_lags(pairs, window=12, hop=6)
    return found.select("user_id", "match.start", "match.lag", F.round("match.score", 6).alias("score"))


@query("""WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM x GROUP BY i),
z AS (SELECT vec_id, label, x.i, CASE WHEN sd > 1e-12 THEN (x - mu) / sd ELSE 0 END AS z FROM x JOIN m ON m.i = x.i), c AS (SELECT label, i, avg(z) AS c FROM z GROUP BY label, i),
d AS (SELECT vec_id, c.label, round(sqrt(sum((z - c) * (z - c))), 9) AS d FROM z JOIN c ON c.i = z.i GROUP BY vec_id, c.label), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS k FROM d)
SELECT a.vec_id, a.label AS nearest, round(1 / (1 + a.d), 6) AS score, round(1 / (1 + a.d) - 1 / (1 + b.d), 6) AS margin FROM r a JOIN r b ON b.vec_id = a.vec_id AND a.k = 1 AND b.k = 2""")
def voice_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class whose mean is nearest once components are brought to one scale, its score, and how far ahead of the next it is."""
    return aggregates.attribute(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
