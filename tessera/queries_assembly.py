"""Registered queries of ordered edits, assembled documents and findings about plans, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import edits
from tessera.plans import assembly
from tessera.queries import HOUR, MINUTE, query
from tessera.queries_plans import _LOCAL, DAYS, _local
from tessera.session import table


@query("""WITH RECURSIVE own AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY ALL), line AS (SELECT l_orderkey, list(l_partkey ORDER BY n, l_partkey) AS l FROM own GROUP BY 1),
step AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, op, l_partkey, l_suppkey) AS k, op, CASE WHEN op[1:6] = 'insert' THEN l_suppkey + 1000000 ELSE l_partkey END AS ident, CASE WHEN op[1:6] = 'insert' THEN CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_partkey END WHEN op = 'swap' THEN before WHEN l_suppkey % 2 = 0 THEN before END AS anchor
  FROM (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before, ['insert_before', 'insert_after', 'move_before', 'move_after', 'swap', 'remove', 'rename'][l_partkey % 7 + 1] AS op FROM lineitem)),
w AS (SELECT l_orderkey, 0::BIGINT AS k, l, 0::BIGINT AS refused FROM line
  UNION ALL SELECT l_orderkey, k, CASE WHEN NOT fine THEN l WHEN op = 'swap' THEN list_transform(l, lambda x: CASE WHEN x = ident THEN anchor WHEN x = anchor THEN ident ELSE x END) WHEN op = 'remove' THEN m WHEN op[-6:] = 'before' THEN CASE WHEN anchor IS NULL THEN list_prepend(ident, m) ELSE list_append(m[1:pos - 1], ident) || m[pos:] END
    ELSE CASE WHEN anchor IS NULL THEN list_append(m, ident) ELSE list_append(m[1:pos], ident) || m[pos + 1:] END END, refused + CASE WHEN fine THEN 0 ELSE 1 END FROM (
    SELECT *, coalesce(list_position(m, anchor), 0) AS pos, coalesce(ident IS NOT NULL AND (anchor IS NULL OR (anchor <> ident AND list_contains(l, anchor))) AND CASE op WHEN 'insert_before' THEN NOT there WHEN 'insert_after' THEN NOT there WHEN 'swap' THEN there AND anchor IS NOT NULL WHEN 'rename' THEN false ELSE there END, false) AS fine
    FROM (SELECT s.l_orderkey, s.k, s.op, s.ident, s.anchor, w.l, w.refused, list_contains(w.l, s.ident) AS there, list_filter(w.l, lambda x: x <> s.ident) AS m FROM w JOIN step s ON s.l_orderkey = w.l_orderkey AND s.k = w.k + 1))),
last AS (SELECT l_orderkey, arg_max(l, k) AS l, max(refused) AS refused FROM w GROUP BY l_orderkey)
SELECT l_orderkey, unnest(l) AS part, generate_subscripts(l, 1)::BIGINT AS place, refused FROM last""")
def edited_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's parts after insertions, moves, swaps and removals in order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    before = F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    names = F.array(*(F.lit(n) for n in ("insert_before", "insert_after", "move_before", "move_after", "swap", "remove", "rename")))
    tasks = edits.tasks_for(2 * lines.count(), spark)
    rows = lines.repartition(tasks, "l_orderkey").withColumn("before", before).withColumn("op", F.element_at(names, (F.col("l_partkey") % 7 + 1).cast("int")))
    new = F.startswith("op", F.lit("insert"))
    anchor = F.when(new, F.when(F.col("l_suppkey") % 4 != 0, F.col("l_partkey"))).when((F.col("op") == "swap") | (F.col("l_suppkey") % 2 == 0), F.col("before"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "op", "l_partkey", "l_suppkey")
    steps = rows.select("l_orderkey", F.row_number().over(order).alias("step"), "op", F.when(new, F.col("l_suppkey") + 1_000_000).otherwise(F.col("l_partkey")).alias("part"), anchor.alias("anchor"))
    done = edits.apply_edits(lines.withColumnRenamed("l_partkey", "part"), steps, ["l_orderkey"], "part", "l_linenumber", tasks=tasks)
    return done.select("l_orderkey", "part", "place", "refused")


_KIND = "CASE WHEN length(event_type) > 5 THEN 'audio' ELSE 'video' END"


@query(f"""WITH {_LOCAL}, d AS (SELECT DISTINCT user_id FROM iv), t AS (SELECT DISTINCT user_id, event_type, {_KIND} AS kind, event_type = 'click' AS over FROM iv WHERE NOT (event_type = 'error' AND user_id % 7 = 0)),
src AS (SELECT DISTINCT user_id, event_type, CASE WHEN event_type = 'signup' THEN {HOUR} ELSE {1 << 50} END AS length FROM iv),
c AS (SELECT iv.user_id, event_id, iv.event_type, greatest(s, 0) AS cs, least(e, {DAYS}) AS ce, event_id % 1000 * 1000 + greatest(s, 0) - s AS a, event_id % 1000 * 1000 + greatest(s, 0) - s + least(e, {DAYS}) - greatest(s, 0) AS z, t.user_id IS NOT NULL AS track, length FROM iv LEFT JOIN t ON t.user_id = iv.user_id AND t.event_type = iv.event_type JOIN src ON src.user_id = iv.user_id AND src.event_type = iv.event_type),
k AS (SELECT *, coalesce(ce > cs AND track AND a >= 0 AND z <= length, false) AS good FROM c), g AS (SELECT * FROM k WHERE good),
m AS (SELECT user_id, event_id AS f, lead(event_id) OVER q AS o, lead(cs) OVER q AS since, ce FROM g WINDOW q AS (PARTITION BY user_id, event_type ORDER BY cs, ce, event_id)),
ls AS (SELECT user_id, list({{'id': event_type, 'kind': 'media', 'duration': length}} ORDER BY event_type) AS x FROM (SELECT DISTINCT g.user_id, g.event_type, g.length FROM g) GROUP BY 1), lt AS (SELECT user_id, list({{'id': event_type, 'kind': kind, 'allowOverlap': over}} ORDER BY event_type) AS x FROM t GROUP BY 1),
lc AS (SELECT user_id, list({{'id': event_id, 'trackId': event_type, 'sourceId': event_type, 'kind': 'clip', 'timelineStart': cs, 'timelineEnd': ce, 'sourceIn': a, 'sourceOut': z}} ORDER BY event_type, cs, ce, event_id) AS x FROM g GROUP BY 1),
lm AS (SELECT user_id, list({{'at': since, 'fromClipId': f, 'toClipId': o}} ORDER BY since, f, o) AS x FROM m WHERE o IS NOT NULL AND since >= ce AND since - ce <= {6 * HOUR} GROUP BY 1), n AS (SELECT user_id, count(*) FILTER (WHERE NOT good) AS dropped FROM k GROUP BY 1)
SELECT d.user_id, to_json({{'schemaVersion': '1', 'duration': {DAYS}, 'sources': coalesce(ls.x, []), 'tracks': coalesce(lt.x, []), 'clips': coalesce(lc.x, []), 'transitions': coalesce(lm.x, [])}})::VARCHAR AS document, coalesce(dropped, 0) AS dropped
FROM d LEFT JOIN ls ON ls.user_id = d.user_id LEFT JOIN lt ON lt.user_id = d.user_id LEFT JOIN lc ON lc.user_id = d.user_id LEFT JOIN lm ON lm.user_id = d.user_id LEFT JOIN n ON n.user_id = d.user_id""")
def timeline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline document for each user, with what it refers to checked."""
    rows = _local(spark, sf_dir)
    kind = F.when(F.length("event_type") > 5, "audio").otherwise("video")
    timelines = rows.select("user_id").distinct().withColumn("duration", F.lit(DAYS).cast("long"))
    tracks = rows.where("not (event_type = 'error' and user_id % 7 = 0)").select("user_id", F.col("event_type").alias("track_id"), kind.alias("kind"), (F.col("event_type") == "click").alias("allow_overlap")).distinct()
    sources = rows.select("user_id", F.col("event_type").alias("source_id"), F.lit("media").alias("kind"), F.when(F.col("event_type") == "signup", HOUR).otherwise(1 << 50).cast("long").alias("length")).distinct()
    clips = rows.select("user_id", F.col("event_id").alias("clip_id"), F.col("event_type").alias("track_id"), F.col("event_type").alias("source_id"), F.lit("clip").alias("kind"), "s", "e", (F.col("event_id") % 1000 * 1000).alias("source_in"))
    return assembly.timeline_documents(timelines, tracks, clips, sources, ["user_id"], joined=6 * HOUR)


@query(f"""WITH {_LOCAL}, ev AS (SELECT user_id, event_id, s, e, event_type AS media_id, event_id % 500 * {MINUTE} AS a, event_id % 500 * {MINUTE} + e - s AS z FROM iv), med AS (SELECT DISTINCT event_type AS media_id, length(event_type) * 100 * {MINUTE} AS length FROM iv WHERE event_type <> 'purchase'),
ov AS (SELECT user_id, event_id + CASE WHEN event_id % 13 = 0 THEN 100000000 ELSE 0 END AS event_id, CASE WHEN k = 0 THEN 'caption' ELSE 'explainer' END AS kind, CASE event_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'loud' WHEN 2 THEN 'odd' END AS style, event_type AS text, s + k * 10 * {MINUTE} AS s, s + 20 * {MINUTE} AS e FROM iv, (SELECT unnest([0, 1]) AS k) WHERE event_id % 2 = k OR event_id % 3 = 0),
x AS (SELECT ev.*, length FROM ev LEFT JOIN med ON med.media_id = ev.media_id), l AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS pe FROM ev), o AS (SELECT ov.*, ev.s AS es, ev.e AS ee FROM ov LEFT JOIN ev ON ev.user_id = ov.user_id AND ev.event_id = ov.event_id),
f AS (SELECT user_id, event_id, 'empty_range' AS code FROM x WHERE e <= s UNION SELECT user_id, event_id, 'unknown_media' FROM x WHERE length IS NULL UNION SELECT user_id, event_id, 'bad_source_range' FROM x WHERE length IS NOT NULL AND (a < -1000 OR z <= a) UNION SELECT user_id, event_id, 'beyond_media' FROM x WHERE z > length + 1000
  UNION SELECT user_id, event_id, 'outside_window' FROM x WHERE length IS NOT NULL AND (a < {30 * MINUTE} - 1000 OR z > {450 * MINUTE} + 1000) UNION SELECT user_id, event_id, 'overlap' FROM l WHERE s < pe - 1000 UNION SELECT user_id, event_id, 'gap' FROM l WHERE s > pe + 1000
  UNION SELECT user_id, event_id, 'unknown_event' FROM o WHERE es IS NULL UNION SELECT user_id, event_id, 'unknown_style' FROM o WHERE style NOT IN ('plain', 'loud') UNION SELECT user_id, event_id, 'forbidden_text' FROM o WHERE contains(text, 'rro') UNION SELECT user_id, event_id, 'empty_overlay' FROM o WHERE e <= s
  UNION SELECT user_id, event_id, 'overlay_outside' FROM o WHERE s < es - 1000 OR e > ee + 1000 UNION SELECT p.user_id, p.event_id, 'clash' FROM ov p JOIN ov q ON q.user_id = p.user_id AND q.event_id = p.event_id AND p.kind = 'caption' AND q.kind = 'explainer' AND p.s < q.e AND q.s < p.e)
SELECT user_id, event_id, code, CASE WHEN code = 'gap' THEN 'warning' ELSE 'error' END AS level FROM f""")
def plan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong or odd about each user's plan: its ranges, its media, its overlays."""
    rows = _local(spark, sf_dir)
    begin = F.col("event_id") % 500 * MINUTE
    events = rows.select("user_id", "event_id", "s", "e", F.col("event_type").alias("media_id"), begin.alias("source_in"), (begin + F.col("e") - F.col("s")).alias("source_out"))
    media = rows.where("event_type <> 'purchase'").select(F.col("event_type").alias("media_id"), (F.length("event_type") * F.lit(100 * MINUTE)).alias("length")).distinct()
    two = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where("event_id % 2 = k or event_id % 3 = 0")
    style = F.when(F.col("event_id") % 4 == 0, "plain").when(F.col("event_id") % 4 == 1, "loud").when(F.col("event_id") % 4 == 2, "odd")
    ident = F.col("event_id") + F.when(F.col("event_id") % 13 == 0, 100_000_000).otherwise(0)
    overlays = two.select("user_id", ident.alias("event_id"), F.col("event_id").alias("overlay_id"), F.when(F.col("k") == 0, "caption").otherwise("explainer").alias("kind"), style.alias("style"), F.col("event_type").alias("text"), (F.col("s") + F.col("k") * F.lit(10 * MINUTE)).alias("s"), (F.col("s") + 20 * MINUTE).alias("e"))
    return assembly.plan_findings(events, media, overlays, ["user_id"], window=(30 * MINUTE, 450 * MINUTE), styles=["plain", "loud"], forbidden=["rro"])
