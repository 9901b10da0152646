"""Registered queries of camera plans and timelines over the table events, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import folds, intervals
from tessera.plans import cameras
from tessera.queries import HOUR, MINUTE, event_intervals, hold_sql, query
from tessera.session import checkpointed

BEGIN = 1_704_067_200_000_000  # the first microsecond of 2024, where the events begin
DAYS = 40 * 24 * HOUR
CAMERAS = ["view", "click", "purchase", "signup", "error"]
_LOCAL = f"""iv AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) - {BEGIN} AS s, epoch_us(ts) - {BEGIN} + CAST(round(value * 60) * 1000000 AS BIGINT) AS e FROM events)"""


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user on a clock that begins with the year."""
    return event_intervals(spark, sf_dir).withColumn("s", F.col("s") - BEGIN).withColumn("e", F.col("e") - BEGIN)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir).select("user_id", "s", "e", F.col("event_type").alias("role"), F.col("event_id").alias("ident"))
    return cameras.normalize(rows, ["user_id"], duration=DAYS, fallback="view")


def _normal(source: str, name: str, fallback: str = "view") -> str:
    """CTEs that end in `name` (user_id, place, s, e, role): the normal form of source (user_id, s, e, role, ident)."""
    return f"""{name}_c AS (SELECT user_id, greatest(0, least(s, {DAYS})) AS s, greatest(0, least(e, {DAYS})) AS e, role, ident FROM {source}),
    {name}_r AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e, ident ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM {name}_c WHERE e > s),
    {name}_b AS (SELECT user_id, greatest(s, reach) AS s, role FROM {name}_r WHERE e > reach),
    {name}_h AS (SELECT * FROM {name}_b UNION ALL SELECT DISTINCT user_id, 0, '{fallback}' FROM {source} WHERE user_id NOT IN (SELECT user_id FROM {name}_b WHERE s = 0)),
    {name}_t AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY user_id ORDER BY s) = role THEN 0 ELSE 1 END AS fresh, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), {DAYS}) AS e FROM {name}_h),
    {name}_k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s) AS turn FROM {name}_t),
    {name} AS (SELECT user_id, CAST(turn - 1 AS BIGINT) AS place, min(s) AS s, max(e) AS e, role FROM {name}_k GROUP BY user_id, turn, role)"""


_PLAN = f"WITH {_LOCAL}, src AS (SELECT user_id, s, e, event_type AS role, event_id AS ident FROM iv), {_normal('src', 'plan')}"
_ATOMS = f"""points AS (SELECT user_id, s, max(role) AS r FROM (SELECT user_id, s, role FROM plan UNION ALL SELECT user_id, s, NULL FROM cuts WHERE s > 0 AND s < {DAYS}) GROUP BY user_id, s),
    atoms AS (SELECT user_id, s, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), {DAYS}) AS e, last_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS role FROM points)"""
_ATOMS_KNOWN = _ATOMS + ", held AS (SELECT * FROM atoms WHERE role IS NOT NULL)"


@query(_PLAN + " SELECT * FROM plan")
def camera_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


_COVER = f"""{_PLAN}, win AS (SELECT user_id, event_type AS role, min(s) AS ws, max(e) AS we FROM iv WHERE event_id % 3 = 0 GROUP BY ALL),
  cuts AS (SELECT user_id, ws AS s FROM win UNION ALL SELECT user_id, we FROM win), {_ATOMS_KNOWN},
  cams AS (SELECT unnest({CAMERAS}) AS role, unnest(range({len(CAMERAS)})) AS rank),
  able AS (SELECT h.user_id, h.s, min_by(c.role, c.rank) AS other, max(CASE WHEN c.role = h.role THEN 1 ELSE 0 END) AS fine FROM held h, cams c
    LEFT JOIN win w ON w.user_id = h.user_id AND w.role = c.role WHERE w.ws IS NULL OR (h.s + h.e) / 2 BETWEEN w.ws AND w.we GROUP BY h.user_id, h.s),
  covered AS (SELECT h.user_id, h.s, h.e, h.role AS from_role,
    coalesce(CASE WHEN coalesce(fine, 0) = 1 THEN h.role ELSE other END, h.role) AS role,
    CASE WHEN coalesce(fine, 0) = 1 THEN NULL WHEN other IS NULL THEN 'no covered fallback source' ELSE 'outside source coverage' END AS reason
    FROM held h LEFT JOIN able a ON a.user_id = h.user_id AND a.s = h.s)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _local(spark, sf_dir).where("event_id % 3 = 0")
    return known.groupBy("user_id", F.col("event_type").alias("role")).agg(F.min("s").alias("ws"), F.max("e").alias("we"))


@query(_COVER + " SELECT user_id, s, e, from_role, role, reason FROM covered WHERE reason IS NOT NULL")
def coverage_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cameras.cover(_plan(spark, sf_dir), _windows(spark, sf_dir), ["user_id"], duration=DAYS, cameras=CAMERAS)
    return found.where("reason is not null")


_SNAP = f"""pts AS (SELECT user_id, e AS s, event_id FROM iv WHERE event_id % 2 = 1),
  edges AS (SELECT user_id, place, s FROM base WHERE s > 0),
  near AS (SELECT d.user_id, d.place, arg_min(p.s, struct_pack(d := abs(p.s - d.s), t := p.s, i := p.event_id)) AS t FROM edges d JOIN pts p USING (user_id) GROUP BY ALL),
  moved AS (SELECT b.user_id, b.place, b.role, max(CASE WHEN b.s = 0 THEN 0 WHEN n.t IS NULL OR abs(n.t - b.s) > {2 * HOUR} THEN b.s ELSE n.t END) OVER (PARTITION BY b.user_id ORDER BY b.place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
    FROM base b LEFT JOIN near n ON n.user_id = b.user_id AND n.place = b.place),
  snapped AS (SELECT user_id, s, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY place), {DAYS}) AS e, role, place AS ident FROM moved), {_normal('snapped', 'snap')}"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir).where("event_id % 2 = 1").select("user_id", F.col("event_id").alias("ident"), F.col("e").alias("s"))


@query(f"{_PLAN}, base AS (SELECT * FROM plan), {_SNAP} SELECT * FROM snap")
def snapped_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras.snap(_plan(spark, sf_dir), _points(spark, sf_dir), ["user_id"], duration=DAYS, fallback="view", most=2 * HOUR)


@query(f"{_COVER}, fixed AS (SELECT user_id, s, e, role, s AS ident FROM covered), {_normal('fixed', 'base')}, {_SNAP} SELECT * FROM snap")
def camera_plan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, coverage with fallback, boundaries to captions' ends."""
    return _snapped(spark, sf_dir)


def _snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each step reads the plan several times, so that it is computed once
    covered = cameras.cover(checkpointed(_plan(spark, sf_dir)), _windows(spark, sf_dir), ["user_id"], duration=DAYS, cameras=CAMERAS)
    plan = cameras.normalize(covered.select("user_id", "s", "e", "role", F.col("s").alias("ident")), ["user_id"], duration=DAYS, fallback="view")
    return cameras.snap(checkpointed(plan), _points(spark, sf_dir), ["user_id"], duration=DAYS, fallback="view", most=2 * HOUR)


@query(f"{_COVER.replace('WITH ', 'WITH RECURSIVE ', 1)}, fixed AS (SELECT user_id, s, e, role, s AS ident FROM covered), {_normal('fixed', 'base')}, {_SNAP}, {hold_sql('snap', 'kept', 2 * HOUR)} SELECT * FROM kept")
def held_plan_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain, and no segment shorter than two hours at its end."""
    return folds.minimum_hold(_snapped(spark, sf_dir), ["user_id"], least=2 * HOUR)


_BLOCKS = f"""cap AS (SELECT user_id, s - {MINUTE} AS s, e FROM iv WHERE event_type <> 'error'),
  fresh AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM cap),
  blocks AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM fresh) GROUP BY user_id, k)"""


@query(f"""WITH {_LOCAL}, {_BLOCKS}, bounds AS (SELECT event_id, user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS following FROM iv WHERE event_type = 'error')
SELECT b.user_id, b.event_id, b.s, least(coalesce(k.e, b.s), coalesce(b.following, k.e, b.s)) AS moved FROM bounds b LEFT JOIN blocks k ON k.user_id = b.user_id AND k.s <= b.s AND b.s < k.e""")
def pushed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir)
    return cameras.push_past(rows.where("event_type = 'error'").select("user_id", "event_id", "s"), rows.where("event_type <> 'error'"), ["user_id"], "event_id", grace=MINUTE)


@query(f"""{_PLAN}, cards AS (SELECT * FROM iv WHERE event_id % 11 = 0), stills AS (SELECT * FROM iv WHERE event_id % 5 = 0),
cuts AS (SELECT user_id, unnest([s, e]) AS s FROM cards UNION ALL SELECT user_id, unnest([s, e]) FROM stills), {_ATOMS_KNOWN},
c AS (SELECT h.user_id, h.s, arg_min(x.event_id, struct_pack(s := x.s, i := x.event_id)) AS ref FROM held h JOIN cards x ON x.user_id = h.user_id AND x.s <= h.s AND h.s < x.e GROUP BY ALL),
t AS (SELECT h.user_id, h.s, arg_min(x.event_id, struct_pack(s := x.s, i := x.event_id)) AS ref FROM held h JOIN stills x ON x.user_id = h.user_id AND x.s <= h.s AND h.s < x.e GROUP BY ALL)
SELECT h.user_id, h.s, h.e, CASE WHEN c.ref IS NOT NULL THEN 'card' WHEN t.ref IS NOT NULL THEN 'still' ELSE 'camera' END AS kind, coalesce(c.ref::VARCHAR, t.ref::VARCHAR, h.role) AS ref
FROM held h LEFT JOIN c USING (user_id, s) LEFT JOIN t USING (user_id, s)""")
def layered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir).select("user_id", "s", "e", F.col("event_id").alias("ref"))
    return cameras.layered(checkpointed(_plan(spark, sf_dir)), [("card", rows.where("ref % 11 = 0")), ("still", rows.where("ref % 5 = 0"))], ["user_id"], duration=DAYS)


@query(f"""{_PLAN}, said AS (SELECT user_id, s, e FROM iv WHERE event_id % 4 = 1),
fresh AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM said),
speech AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM fresh) GROUP BY user_id, k),
cuts AS (SELECT user_id, unnest([s, e]) AS s FROM speech), {_ATOMS_KNOWN},
narrow AS (SELECT h.user_id, h.s, h.e, CASE WHEN h.role = 'view' OR EXISTS (SELECT 1 FROM speech p WHERE p.user_id = h.user_id AND p.s <= h.s AND h.s < p.e) THEN h.role ELSE 'view' END AS role, h.s AS ident FROM held h),
{_normal('narrow', 'out')} SELECT * FROM out""")
def closeups_in_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = _local(spark, sf_dir).where("event_id % 4 = 1").select("user_id", "s", "e")
    return cameras.closeups_in_speech(_plan(spark, sf_dir), speech, ["user_id"], duration=DAYS, master="view")


@query(f"""WITH RECURSIVE {_LOCAL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS i FROM iv),
w AS (SELECT user_id, event_id, s, e, i, CAST(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS BIGINT) AS turn, CASE WHEN event_type = 'view' THEN 0 ELSE s + {HOUR * 12} END AS until, event_type FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.s, o.e, o.i, CASE WHEN o.event_type <> 'view' AND o.s >= w.until THEN w.turn + 1 ELSE w.turn END, CASE WHEN o.event_type <> 'view' AND o.s >= w.until THEN o.s + {HOUR * 12} ELSE w.until END, o.event_type
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, event_id AS ident, s, e, CASE WHEN event_type = 'view' THEN 'master' ELSE 'camera' || ((turn - 1) % 3 + 2) END AS role FROM w""")
def held_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir).select("user_id", F.col("event_id").alias("ident"), "s", "e", F.col("event_type").alias("speaker"))
    return cameras.hold_round_robin(rows, ["user_id"], cameras=["camera2", "camera3", "camera4"], master="master", asks="view", hold=12 * HOUR)


_RUNS = f"""WITH {_LOCAL}, o AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY s, e, event_id) = event_type THEN 0 ELSE 1 END AS f FROM iv),
runs AS (SELECT user_id, run, event_type AS role, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS run FROM o) GROUP BY user_id, run, event_type)"""


@query(f"""{_RUNS} SELECT user_id, s, least(e, s + {30 * MINUTE}) AS e FROM (SELECT *, lag(role) OVER (PARTITION BY user_id ORDER BY run) AS p FROM runs) WHERE p = 'view' AND role = 'click'""")
def delay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = intervals.role_runs(_local(spark, sf_dir), ["user_id"], "event_type", "event_id").withColumnRenamed("event_type", "role")
    return cameras.delay_windows(runs, ["user_id"], before="view", after="click", delay=30 * MINUTE)


@query(f"""{_RUNS}, held AS (SELECT user_id, s, e, coalesce(
    last_value(CASE WHEN e - s >= {2 * HOUR} THEN role END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(CASE WHEN e - s >= {2 * HOUR} THEN role END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
    first_value(role) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS role FROM runs),
f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY user_id ORDER BY s) = role THEN 0 ELSE 1 END AS f FROM held)
SELECT user_id, CAST(k - 1 AS BIGINT) AS place, min(s) AS s, max(e) AS e, role FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s) AS k FROM f) GROUP BY user_id, k, role""")
def absorbed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = intervals.role_runs(_local(spark, sf_dir), ["user_id"], "event_type", "event_id").withColumnRenamed("event_type", "role")
    return cameras.absorb_short(runs, ["user_id"], least=2 * HOUR)


@query(f"""WITH RECURSIVE {_LOCAL}, o AS (SELECT user_id, event_id, event_type AS role, value / 50 AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i, lead(event_type) OVER (PARTITION BY user_id ORDER BY s, event_id) AS nx FROM iv),
w AS (SELECT user_id, event_id, role, confidence, false AS smoothed, i FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, CASE WHEN o.confidence < 0.45 AND o.nx = w.role THEN w.role ELSE o.role END, CASE WHEN o.confidence < 0.45 AND o.nx = w.role THEN greatest(o.confidence, 0.5) ELSE o.confidence END, coalesce(o.confidence < 0.45 AND o.nx = w.role, false), o.i
  FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, event_id AS ident, role, confidence, smoothed FROM w""")
def smoothed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir).select("user_id", F.col("event_id").alias("ident"), "s", F.col("event_type").alias("role"), (F.col("value") / 50).alias("confidence"))
    return cameras.smooth_neighbours(rows, ["user_id"], sure=0.45)
