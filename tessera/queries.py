"""Registered queries of the general operators over the given tables, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import signals, text
from tessera.operators import aggregates, folds, intervals, relations, sequences
from tessera.plans import timeline
from tessera.session import table
from tessera.sources import subtitles

QUERIES: dict = {}
SQL: dict[str, str] = {}

MINUTE, HOUR = 60_000_000, 3_600_000_000
_IV = "iv AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60) * 1000000 AS BIGINT) AS e FROM events)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of a user: value is its length in minutes."""
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    length = (F.round(F.col("value") * 60) * 1_000_000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", s.alias("s"), (s + length).alias("e"))


# ---------------------------------------------------------------- intervals


def _islands(keys: str, gap: int = 0, source: str = "iv", pad: int = 0) -> str:
    return f"""SELECT {keys}, island, min(s) AS s, max(e) AS e, count(*) AS n FROM (
      SELECT *, CAST(sum(fresh) OVER (PARTITION BY {keys} ORDER BY s, e) AS BIGINT) AS island FROM (
        SELECT *, CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END AS fresh FROM (
          SELECT {keys}, s - {pad} AS s, e + {pad} AS e, max(e + {pad}) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}))) GROUP BY {keys}, island"""


@query(f"WITH {_IV} {_islands('user_id')}")
def interval_union(spark, sf_dir):
    return intervals.interval_union(event_intervals(spark, sf_dir), ["user_id"])


@query(f"WITH {_IV} {_islands('user_id, event_type', 30 * MINUTE, pad=5 * MINUTE)}")
def interval_union_gap(spark, sf_dir):
    return intervals.interval_union(event_intervals(spark, sf_dir), ["user_id", "event_type"], gap=30 * MINUTE, pad=5 * MINUTE)


@query(f"WITH {_IV}, u AS ({_islands('user_id')}) SELECT user_id, before AS s, s AS e FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s) AS before FROM u) WHERE s - before >= {HOUR}")
def interval_complement(spark, sf_dir):
    return intervals.interval_complement(event_intervals(spark, sf_dir), ["user_id"], min_len=HOUR)


@query(
    f"""WITH {_IV}, l AS (SELECT * FROM iv WHERE event_type <> 'click'), c AS (SELECT * FROM iv WHERE event_type = 'click'), m AS ({_islands('user_id', source='c')}),
    hit AS (SELECT l.user_id, l.event_id, l.s AS ls, l.e AS le, m.s AS rs, m.e AS re FROM l JOIN m ON l.user_id = m.user_id AND least(l.e, m.e) - greatest(l.s, m.s) >= 1),
    piece AS (SELECT user_id, event_id, coalesce(lag(re) OVER w, ls) AS s, rs AS e FROM hit WINDOW w AS (PARTITION BY event_id ORDER BY rs)
      UNION ALL SELECT user_id, event_id, max(re), max(le) FROM hit GROUP BY user_id, event_id
      UNION ALL SELECT user_id, event_id, s, e FROM l WHERE event_id NOT IN (SELECT event_id FROM hit))
    SELECT * FROM piece WHERE e > s"""
)
def interval_difference(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    return intervals.interval_difference(iv.where("event_type <> 'click'"), iv.where("event_type = 'click'"), ["user_id"], "event_id")


@query(f"WITH {_IV} SELECT user_id, event_id, previous, pe - s AS overlap FROM (SELECT *, lag(e) OVER w AS pe, lag(event_id) OVER w AS previous FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s, e, event_id)) WHERE s < pe")
def overlap_violations(spark, sf_dir):
    return intervals.overlap_violations(event_intervals(spark, sf_dir), ["user_id"], "event_id")


@query(
    f"""WITH {_IV}, m AS ({_islands('user_id, event_type')}), x AS (SELECT * FROM m WHERE e > s),
    p AS (SELECT user_id, s FROM x UNION SELECT user_id, e FROM x), a AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS e FROM p)
    SELECT a.user_id, a.s, a.e, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS roles FROM a JOIN x ON a.user_id = x.user_id AND x.s <= a.s AND x.e >= a.e WHERE a.e IS NOT NULL GROUP BY ALL HAVING count(DISTINCT event_type) >= 2"""
)
def sweep_active_types(spark, sf_dir):
    return intervals.sweep(event_intervals(spark, sf_dir), ["user_id"], "event_type")


@query(
    f"""WITH {_IV} SELECT user_id, run, event_type, min(s) AS s, max(e) AS e, count(*) AS n FROM (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS BIGINT) AS run FROM (
    SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY s, e, event_id) = event_type THEN 0 ELSE 1 END AS f FROM iv)) GROUP BY ALL"""
)
def role_runs(spark, sf_dir):
    return intervals.role_runs(event_intervals(spark, sf_dir), ["user_id"], "event_type", "event_id")


@query(f"WITH {_IV} SELECT user_id, event_id, CASE WHEN d > 0 THEN 'gap' ELSE 'overlap' END AS kind, abs(d) AS size FROM (SELECT *, s - lag(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS d FROM iv) WHERE abs(d) > {MINUTE}")
def gap_audit(spark, sf_dir):
    return intervals.gap_audit(event_intervals(spark, sf_dir), ["user_id"], "event_id", slack=MINUTE)


@query(f"WITH {_IV} SELECT event_type AS from_role, nxt AS to_role, count(*) AS n FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS nxt FROM iv) WHERE nxt IS NOT NULL GROUP BY ALL")
def transitions(spark, sf_dir):
    return intervals.transitions(event_intervals(spark, sf_dir), ["user_id"], "event_type", "event_id")


@query(
    f"""WITH {_IV}, v AS (SELECT a.event_id, b.event_type, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type <> 'purchase' AND least(a.e, b.e) - greatest(a.s, b.s) >= 1 GROUP BY ALL)
    SELECT event_id, event_type AS winner, overlap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, event_type DESC) AS r FROM v) WHERE r = 1"""
)
def overlap_join_votes(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    left = iv.where("event_type = 'purchase'").select("user_id", "event_id", F.col("s").alias("ls"), F.col("e").alias("le"))
    right = iv.where("event_type <> 'purchase'").select("user_id", "event_type", F.col("s").alias("rs"), F.col("e").alias("re"))
    votes = intervals.overlap_join(left, right, ["user_id"]).groupBy("event_id", "event_type").agg(F.sum("overlap").alias("overlap"))
    best = votes.groupBy("event_id").agg(F.max(F.struct("overlap", "event_type")).alias("b"))
    return best.select("event_id", F.col("b.event_type").alias("winner"), "b.overlap")


@query(
    f"""WITH {_IV}, l AS (SELECT * FROM iv WHERE event_type = 'purchase'), r AS (SELECT * FROM iv WHERE event_type = 'view')
    SELECT user_id, event_id, near, distance FROM (SELECT l.user_id, l.event_id, r.event_id AS near, abs(l.s - r.s) AS distance, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.s - r.s), r.s, r.event_id) AS k FROM l JOIN r ON l.user_id = r.user_id) WHERE k = 1"""
)
def asof_nearest(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    return intervals.nearest(iv.where("event_type = 'purchase'"), iv.where("event_type = 'view'"), ["user_id"], "event_id")


@query(
    f"""WITH {_IV}, c AS (SELECT * FROM iv WHERE event_type = 'click'), m AS ({_islands('user_id', source='c')})
    SELECT i.user_id, i.event_id, i.s, CASE WHEN coalesce(max(CASE WHEN m.s <= i.s THEN m.e END), i.s) <= i.s THEN i.s - coalesce(sum(CASE WHEN m.s <= i.s THEN m.e - m.s END), 0) END AS mapped
    FROM iv i LEFT JOIN m ON i.user_id = m.user_id WHERE i.event_type <> 'click' GROUP BY i.user_id, i.event_id, i.s"""
)
def remap_cuts(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    return intervals.remap(iv.where("event_type <> 'click'"), iv.where("event_type = 'click'"), ["user_id"], "event_id")


@query(f"WITH {_IV} SELECT event_id, tile, s + tile * {HOUR} AS s, least(s + (tile + 1) * {HOUR}, e) AS e FROM (SELECT event_id, s, e, unnest(range(0, (e - s - 1) // {HOUR} + 1)) AS tile FROM iv WHERE e > s)")
def tile_ranges(spark, sf_dir):
    return intervals.tiles(event_intervals(spark, sf_dir), ["event_id"], width=HOUR)


@query(f"WITH {_IV} SELECT user_id, event_id, CAST(coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_us FROM iv")
def ripple(spark, sf_dir):
    rows = event_intervals(spark, sf_dir).withColumn("length", F.col("e") - F.col("s"))
    return intervals.ripple(rows, ["user_id"], ["s", "event_id"], "length").select("user_id", "event_id", F.col("begin").alias("begin_us"))


@query(
    """SELECT l_orderkey, l_linenumber, (done - q) * 1000000 // total AS s, done * 1000000 // total AS e FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q,
    CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM lineitem)"""
)
def weighted_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return intervals.weighted_split(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "q", 1_000_000).select("l_orderkey", "l_linenumber", "s", "e")


@query(f"WITH {_IV} SELECT event_id, CASE WHEN nxt IS NULL THEN greatest(e, s + {HOUR}) ELSE greatest(s, least(greatest(e, s + {HOUR}), nxt - {MINUTE})) END AS e FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS nxt FROM iv)")
def readable_ends(spark, sf_dir):
    return intervals.clamp_readable(event_intervals(spark, sf_dir), ["user_id"], "event_id", shortest=HOUR, space=MINUTE).select("event_id", "e")


_LR = "l AS (SELECT * FROM iv WHERE event_type = 'purchase'), r AS (SELECT * FROM iv WHERE event_type IN ('view', 'click'))"


def _sides(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    return iv.where("event_type = 'purchase'"), iv.where("event_type in ('view', 'click')")


@query(
    f"""WITH {_IV}, {_LR}, p AS (SELECT l.user_id, l.event_id, r.event_id AS other, least(l.e, r.e) - greatest(l.s, r.s) AS overlap, r.s AS rs, CASE WHEN r.s <= (l.s + l.e) / 2.0 AND (l.s + l.e) / 2.0 < r.e THEN 1 ELSE 0 END AS h FROM l JOIN r ON l.user_id = r.user_id AND least(l.e, r.e) - greatest(l.s, r.s) >= 1)
    SELECT user_id, event_id, other, overlap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY h DESC, overlap DESC, rs, other) AS k FROM p) WHERE k = 1"""
)
def best_overlap_pick(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    left = left.select("user_id", "event_id", F.col("s").alias("ls"), F.col("e").alias("le"))
    return intervals.best_overlap(left, right.select("user_id", F.col("event_id").alias("other"), F.col("s").alias("rs"), F.col("e").alias("re")), ["user_id"], "event_id", "other")


@query(f"WITH {_IV}, {_LR} SELECT user_id, event_id, other FROM (SELECT l.user_id, l.event_id, r.event_id AS other, row_number() OVER (PARTITION BY l.event_id ORDER BY r.s, r.event_id) AS k FROM l JOIN r ON l.user_id = r.user_id AND r.s <= l.s AND l.s < r.e) WHERE k = 1")
def point_in_interval(spark, sf_dir):
    points, ranges = _sides(spark, sf_dir)
    return intervals.containing(points, ranges.withColumnRenamed("event_id", "other"), ["user_id"], "event_id", "other")


@query(
    f"""WITH {_IV}, {_LR}, p AS (SELECT user_id, event_id, s, e, s AS t FROM r WHERE e > s UNION SELECT r.user_id, r.event_id, r.s, r.e, l.s FROM r JOIN l ON l.user_id = r.user_id AND l.s > r.s AND l.s < r.e)
    SELECT user_id, event_id, CAST(row_number() OVER w - 1 AS INT) AS piece, t AS s, coalesce(lead(t) OVER w, e) AS e FROM p WINDOW w AS (PARTITION BY event_id ORDER BY t)"""
)
def split_segments(spark, sf_dir):
    points, ranges = _sides(spark, sf_dir)
    return intervals.split_at(ranges, points, ["user_id"], "event_id")


@query(
    f"""WITH {_IV}, {_LR}, m AS ({_islands('user_id', source='l')}), hit AS (SELECT r.user_id, r.event_id, r.event_type, r.s AS ls, r.e AS le, m.s AS rs, m.e AS re FROM r JOIN m ON r.user_id = m.user_id AND least(r.e, m.e) - greatest(r.s, m.s) >= 1),
    piece AS (SELECT user_id, event_id, event_type, coalesce(lag(re) OVER w, ls) AS s, rs AS e FROM hit WINDOW w AS (PARTITION BY event_id ORDER BY rs)
      UNION ALL SELECT user_id, event_id, event_type, max(re), max(le) FROM hit GROUP BY ALL
      UNION ALL SELECT user_id, event_id, 'forced', greatest(ls, rs), least(le, re) FROM hit
      UNION ALL SELECT user_id, event_id, event_type, s, e FROM r WHERE event_id NOT IN (SELECT event_id FROM hit))
    SELECT * FROM piece WHERE e > s"""
)
def force_role(spark, sf_dir):
    windows, plan = _sides(spark, sf_dir)
    return intervals.overwrite(plan, windows, ["user_id"], "event_id", "event_type", "forced")


@query(
    f"""WITH {_IV}, {_LR}, d AS (SELECT l.user_id, l.event_id, min(abs(l.s - r.s)) AS distance FROM l JOIN r ON l.user_id = r.user_id GROUP BY ALL) SELECT * FROM d WHERE distance > 0 AND distance <= {HOUR}"""
)
def cut_audit(spark, sf_dir):
    cuts, marks = _sides(spark, sf_dir)
    return intervals.cut_audit(cuts, marks, ["user_id"], "event_id", near=HOUR)


# ---------------------------------------------------------------- ordered rows


@query(
    """SELECT conv_id, first, size, md5(joined) AS joined FROM (
    SELECT conv_id, turn AS first, 2 AS size, string_agg(text, ' ') OVER w AS joined, count(*) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)
    UNION ALL SELECT conv_id, turn, 3, string_agg(text, ' ') OVER w, count(*) OVER w FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = size AND length(joined) >= 200"""
)
def transcript_windows(spark, sf_dir):
    found = sequences.sliding_windows(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", [2, 3], least=200)
    return found.withColumn("joined", F.md5(F.col("joined").cast("binary")))


@query(
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    WHERE n <= 12 OR i IN (SELECT unnest(list_transform(range(0, 12), lambda j: (j * (n - 1)) // 11)))"""
)
def even_sample(spark, sf_dir):
    return sequences.even_sample(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 12).select("user_id", "event_id")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT), s_suppkey) AS place FROM supplier")
def natural_order(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").select("s_suppkey", sequences.natural_key(F.col("s_name")).alias("k"))
    return sequences.global_rank(named, "k", ["s_suppkey"], "place").select("s_suppkey", "place")


@query("SELECT o_orderkey, CAST(('0x' || substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12)) AS BIGINT) % 7 AS pick FROM orders")
def hash_pick(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sequences.hash_pick(F.col("o_orderkey").cast("string"), 7).alias("pick"))


@query("SELECT user_id, event_id, CASE ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4) % 3 WHEN 0 THEN 'master' WHEN 1 THEN 'camera2' ELSE 'camera3' END AS role FROM events")
def rotation_plan(spark, sf_dir):
    return sequences.rotation(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["master", "camera2", "camera3"], 4).select("user_id", "event_id", "role")


@query("SELECT l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS signature, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1")
def signature_groups(spark, sf_dir):
    return sequences.signatures(table(spark, sf_dir, "lineitem"), [F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber").cast("string")], "l_orderkey")


@query("SELECT event_id, CASE WHEN list_contains(json_keys(props), 'k') THEN '' ELSE 'k' END AS missing, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') AS unexpected FROM events")
def key_errors(spark, sf_dir):
    missing, unexpected = sequences.key_errors(F.json_object_keys("props"), ["k"], ["k"])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(missing, ",").alias("missing"), F.array_join(unexpected, ",").alias("unexpected"))


@query("SELECT page_id, CASE regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1) WHEN 'html' THEN 'page' WHEN 'htm' THEN 'page' WHEN 'com' THEN 'site' WHEN 'org' THEN 'site' ELSE 'other' END AS kind FROM pages")
def media_kinds(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sequences.media_kind(F.col("url"), {"page": ["html", "htm"], "site": ["com", "org"]}).alias("kind"))


@query("SELECT event_id, json_extract_string(props, '$.k') IN ('1', 'true', 'yes', 'on') AS yes, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS k FROM events")
def coerced_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", sequences.truthy(k).alias("yes"), sequences.number_or(k, -1.0).alias("k"))


# ---------------------------------------------------------------- relations


def _previous_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = F.when(F.col("o_orderkey") % 11 == 0, F.lit("?")).otherwise(F.col("o_orderstatus"))
    return orders, orders.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", status)


@query(
    """WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN '?' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0), c AS (SELECT * FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT coalesce(p.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN p.o_orderkey IS NULL THEN 'added' WHEN c.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM p FULL JOIN c ON p.o_orderkey = c.o_orderkey WHERE p.o_orderkey IS NULL OR c.o_orderkey IS NULL OR p.o_custkey <> c.o_custkey OR p.o_orderstatus <> c.o_orderstatus"""
)
def snapshot_diff(spark, sf_dir):
    now, before = _previous_orders(spark, sf_dir)
    return relations.snapshot_diff(before, now.where("o_orderkey % 13 <> 0"), "o_orderkey")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'version' WHEN o_orderkey % 17 = 0 THEN 'empty' WHEN o_orderkey % 11 = 0 THEN 'changed' ELSE 'reused' END AS reason FROM orders"""
)
def cache_reuse_plan(spark, sf_dir):
    now, before = _previous_orders(spark, sf_dir)
    mark = relations.fingerprint("o_custkey", "o_orderstatus")
    wanted = now.select("o_orderkey", F.lit(2).alias("version"), mark.alias("print"))
    old = before.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(2).alias("version"), mark.alias("print"), F.when(F.col("o_orderkey") % 17 == 0, 0).otherwise(9).alias("size"))
    return relations.reuse_plan(wanted, old, "o_orderkey")


@query("SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return relations.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_shipdate"])


@query(
    """SELECT 'l_partkey' AS reference, CAST(l_partkey AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY ALL
    UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL"""
)
def ref_integrity(spark, sf_dir):
    parts, suppliers = table(spark, sf_dir, "part").where("p_size > 5"), table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return relations.missing_references(table(spark, sf_dir, "lineitem"), {"l_partkey": (parts, "p_partkey"), "l_suppkey": (suppliers, "s_suppkey")})


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, sf_dir):
    return relations.last_wins(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def ordered_distinct(spark, sf_dir):
    return relations.ordered_distinct(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    """SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, CAST(floor(value / 5) AS BIGINT) ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1) WHERE place <= 5"""
)
def topk_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return relations.top_by_key(events, ["user_id"], F.floor(F.col("value") / 5), "value", "event_id", 5).select("user_id", "event_id", "place")


@query("SELECT c_custkey, CASE WHEN k.v IS NOT NULL THEN k.v ELSE c_mktsegment END AS c_mktsegment, k.v IS NOT NULL AND k.v <> c_mktsegment AS changed FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY ALL) k ON c_custkey = o_custkey")
def override_last(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return relations.override(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", "c_mktsegment", "o_orderkey")


# ---------------------------------------------------------------- aggregates


@query(
    """SELECT event_type, n, max(CASE WHEN i = CAST(round_even((n - 1) * 0.1, 0) AS BIGINT) THEN value END) AS p10, max(CASE WHEN i = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) THEN value END) AS p50, max(CASE WHEN i = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT) THEN value END) AS p90
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type, n"""
)
def nearest_rank_pct(spark, sf_dir):
    return aggregates.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY ALL")
def linear_pct(spark, sf_dir):
    found = aggregates.linear_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return found.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")))


@query(
    """WITH b AS (SELECT user_id, count(value) AS n, quantile_cont(value, 0.08) AS lo, quantile_cont(value, 0.92) AS hi FROM events GROUP BY ALL)
    SELECT user_id, n, count(*) AS kept, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events JOIN b USING (user_id) WHERE n < 64 OR value BETWEEN lo AND hi GROUP BY user_id, n"""
)
def trimmed_mean(spark, sf_dir):
    return aggregates.trimmed_mean(table(spark, sf_dir, "events"), ["user_id"], "value").select("user_id", "n", "kept", F.round(F.col("mean") * F.col("kept") * 100).cast("long").alias("cents"))


@query(
    """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY ALL), d AS (SELECT event_type, quantile_cont(abs(value - m), 0.5) AS mad FROM events JOIN m USING (event_type) GROUP BY ALL)
    SELECT event_id, round((value - m) / (1.4826 * mad), 6) AS z FROM events JOIN m USING (event_type) JOIN d USING (event_type)"""
)
def mad_z(spark, sf_dir):
    return aggregates.robust_z(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_id", F.round("z", 6).alias("z"))


@query(
    """SELECT user_id, event_type AS mode, c AS n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(c) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f) AS r FROM (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY ALL)) WHERE r = 1"""
)
def mode_first_seen(spark, sf_dir):
    return aggregates.mode_first_seen(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(
    """SELECT user_id, CASE WHEN event_type = 'view' AND c * 20 >= total * 5 THEN event_type WHEN event_type <> 'view' AND c * 4 >= total THEN event_type ELSE 'mixed' END AS dominant, c AS n, CAST(total AS BIGINT) AS total
    FROM (SELECT *, sum(c) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type DESC) AS r FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL)) WHERE r = 1"""
)
def dominant_share(spark, sf_dir):
    return aggregates.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type", {"view": (5, 20)}, (1, 4))


@query("SELECT l_suppkey, round(sum(CASE WHEN l_discount > 0.02 THEN l_extendedprice * l_quantity END) / sum(CASE WHEN l_discount > 0.02 THEN l_quantity END), 4) AS profile FROM lineitem GROUP BY ALL")
def weighted_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).alias("x"))
    return aggregates.weighted_profile(rows, ["l_suppkey"], "x", "l_quantity").withColumn("profile", F.round("profile", 4))


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY ALL")
def pearson(spark, sf_dir):
    return aggregates.pearson(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@query(f"SELECT event_type, bin, peak, round(peak / max(peak) OVER (PARTITION BY event_type), 6) AS share FROM (SELECT event_type, epoch_us(ts) // {6 * HOUR} AS bin, max(abs(value)) AS peak FROM events GROUP BY ALL)")
def peak_bins(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    return aggregates.peak_bins(iv, ["event_type"], F.col("s"), "value", 6 * HOUR).withColumn("share", F.round("share", 6))


_PARTS = "v AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"WITH {_PARTS} SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS x, count(x) AS n FROM v GROUP BY ALL")
def vector_mean_label(spark, sf_dir):
    return aggregates.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("x", F.round("x", 6))


@query(f"WITH {_PARTS} SELECT label, CAST(i AS INT) AS i, round(quantile_cont(x, 0.5), 6) AS x FROM v GROUP BY ALL")
def robust_centroid(spark, sf_dir):
    return aggregates.median_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("x", F.round("x", 6))


@query(
    f"""WITH {_PARTS}, m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL), d AS (SELECT vec_id, m.label, round(sqrt(sum((x - m) * (x - m))), 9) AS d FROM v JOIN m USING (i) GROUP BY ALL)
    SELECT vec_id, label AS nearest, round(d, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d) WHERE r = 1"""
)
def nearest_centroid(spark, sf_dir):
    return aggregates.nearest_class(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumn("distance", F.round("distance", 5))


# ---------------------------------------------------------------- text


@query(
    r"""SELECT doc_id, concat_ws(',', CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN regexp_matches(text, '!{2}') THEN 'shouting' END, CASE WHEN length(text) >= 5000 THEN 'long' END, CASE WHEN contains(text, '|') THEN 'table' END) AS flags FROM documents"""
)
def qa_flags(spark, sf_dir):
    x = F.col("text")
    rules = [(F.trim(x) == "", "empty"), (x.rlike("!{2}"), "shouting"), (F.length(x) >= 5000, "long"), (F.contains(x, F.lit("|")), "table")]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(relations.flags(rules), ",").alias("flags"))


@query(
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'labelled' WHEN quality = 0 THEN 'poor' WHEN n_chars < 200 THEN 'short' WHEN contains(text, 'License') THEN 'license' ELSE 'plain' END AS class FROM documents LEFT JOIN labels USING (doc_id)"""
)
def rule_priority(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [(F.col("toxic") == 1, "labelled"), (F.col("quality") == 0, "poor"), (F.col("n_chars") < 200, "short"), (F.contains("text", F.lit("License")), "license")]
    return docs.select("doc_id", relations.first_rule(rules, "plain").alias("class"))


_TERMS = {"rights": ["All rights reserved", "License"], "contact": ["@", "http"], "french": [" les ", " des "]}


@query("SELECT doc_id, " + ", ".join(" OR ".join(f"contains(text, '{p}')" for p in ps) + f" AS {t}" for t, ps in _TERMS.items()) + " FROM documents")
def glossary_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(text.holds_any(F.col("text"), ps).alias(t) for t, ps in _TERMS.items()))


@query("SELECT doc_id, md5(replace(replace(replace(text, 'the', 'a'), 'a ', 'an '), 'an', 'AN')) AS digest FROM documents")
def ordered_replace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.replace_in_order(F.col("text"), [("the", "a"), ("a ", "an "), ("an", "AN")]).cast("binary")).alias("digest"))


_PAIRS = "p AS (SELECT p_partkey, p_name AS a, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)"


@query(
    f"""WITH {_PAIRS}, g AS (SELECT p_partkey, g, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM (
      SELECT p_partkey, 0 AS side, unnest(list_transform(range(1, greatest(length(a) - 1, 1) + 1), lambda i: substring(a, i, 2))) AS g FROM p WHERE b IS NOT NULL
      UNION ALL SELECT p_partkey, 1, unnest(list_transform(range(1, greatest(length(b) - 1, 1) + 1), lambda i: substring(b, i, 2))) FROM p WHERE b IS NOT NULL) GROUP BY ALL)
    SELECT p_partkey, round(2.0 * sum(least(x, y)) / sum(x + y), 6) AS dice FROM g GROUP BY ALL"""
)
def ngram_dice(spark, sf_dir):
    from pyspark.sql.window import Window

    pairs = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).where("b is not null")
    return pairs.select("p_partkey", F.round(text.dice(F.col("p_name"), F.col("b")), 6).alias("dice"))


@query(
    f"""WITH {_PAIRS}, c AS (SELECT p_partkey, length(a) AS n, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y, contains(a, b) OR contains(b, a) AS inside FROM p WHERE b IS NOT NULL)
    SELECT p_partkey, round(least(1.0, len(list_intersect(x, y)) / least(len(x), len(y)) + CASE WHEN inside THEN 0.1 ELSE 0 END), 6) AS overlap FROM c"""
)
def set_overlap(spark, sf_dir):
    from pyspark.sql.window import Window

    pairs = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).where("b is not null")
    return pairs.select("p_partkey", F.round(text.set_overlap(F.col("p_name"), F.col("b")), 6).alias("overlap"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query(
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM pages"""
)
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_markup(F.col("html")).cast("binary")).alias("digest"))


@query(
    r"""SELECT doc_id, CAST(i AS INT) AS place, CAST(i + 1 AS INT) AS number, i * 2000000 AS s, i * 2000000 + 1500000 AS e, trim(line) AS text FROM (
    SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '<[^>]*>|[{}\\]|-->', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[^\s]')) AS lines FROM documents))"""
)
def srt_round_trip(spark, sf_dir):
    bare = F.regexp_replace("text", r"<[^>]*>|[{}\\]|-->", "")
    lines = F.filter(F.split(bare, "\n"), lambda x: x.rlike(r"[^\s]"))
    captions = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("number"), (F.col("i") * F.lit(2_000_000).cast("long")).alias("s"), (F.col("i") * F.lit(2_000_000).cast("long") + 1_500_000).alias("e"), "text")
    return subtitles.parse_srt(subtitles.srt_files(captions, ["doc_id"]), ["doc_id"])


# ---------------------------------------------------------------- folds, plans, signals (held against Python in the tests)


@query(
    """WITH RECURSIVE o AS (SELECT conv_id, turn // 3 % 2 AS role, text, turn * 1000000 AS s, turn * 1000000 + 900000 AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    w AS (SELECT conv_id, i, 0 AS place, s, e, role, text, 1 AS n FROM o WHERE i = 1
      UNION ALL SELECT conv_id, i, CASE WHEN fits THEN place ELSE place + 1 END, CASE WHEN fits THEN s ELSE xs END, CASE WHEN fits THEN greatest(e, xe) ELSE xe END, xrole, CASE WHEN fits THEN concat_ws(' ', text, xtext) ELSE xtext END, CASE WHEN fits THEN n + 1 ELSE 1 END
      FROM (SELECT w.conv_id, o.i, w.place, w.s, w.e, w.text, w.n, o.s AS xs, o.e AS xe, o.role AS xrole, o.text AS xtext, w.role IS NOT DISTINCT FROM o.role AND o.s - w.e <= 500000 AND length(concat_ws(' ', w.text, o.text)) <= 1500 AND greatest(w.e, o.e) - w.s <= 8000000 AS fits FROM w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1))
    SELECT conv_id, place, s, arg_max(e, i) AS e, role, arg_max(text, i) AS text, max(n) AS n FROM w GROUP BY conv_id, place, s, role"""
)
def caption_merge(spark, sf_dir):
    speaker = F.floor(F.col("turn") / 3) % 2
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ident"), speaker.alias("role"), "text", (F.col("turn") * F.lit(1_000_000)).alias("s"), (F.col("turn") * F.lit(1_000_000) + 900_000).alias("e"))
    return folds.merge_captions(turns, ["conv_id"], gap=500_000, chars=1500, length=8_000_000)


@query(
    f"""WITH RECURSIVE {_IV}, o AS (SELECT user_id, event_type AS role, s, e, row_number() OVER (PARTITION BY user_id ORDER BY s, e, event_id) AS i FROM iv),
    w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, -1 AS place, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(NULL AS VARCHAR) AS role FROM o
      UNION ALL SELECT user_id, i, CASE WHEN out THEN place WHEN role = xrole THEN place ELSE place + 1 END, CASE WHEN out OR role = xrole THEN s ELSE begin END, CASE WHEN out THEN e ELSE xe END, CASE WHEN out THEN role ELSE xrole END
      FROM (SELECT w.user_id, o.i, w.place, w.s, w.e, w.role, o.e AS xe, o.role AS xrole, greatest(o.s, coalesce(w.e, o.s)) AS begin, o.e - greatest(o.s, coalesce(w.e, o.s)) < {MINUTE} AS out FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)),
    g AS (SELECT user_id, place, s, arg_max(e, i) AS e, role FROM w WHERE place >= 0 GROUP BY user_id, place, s, role)
    SELECT user_id, place, s, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY place), e) AS e, role FROM g"""
)
def plan_normalize(spark, sf_dir):
    iv = event_intervals(spark, sf_dir).select("user_id", "s", "e", F.col("event_type").alias("role"), F.col("event_id").alias("ident"))
    return folds.normalize_plan(iv, ["user_id"], least=MINUTE)


def hold_sql(source: str, name: str, least: int) -> str:
    """Recursive CTEs that end in `name` (user_id, place, s, e, role): source (user_id, s, e, role), its shortest segments merged into longer neighbours."""
    return f"""{name}_w AS (SELECT user_id, 0 AS step, list(struct_pack(s := s, e := e, role := role) ORDER BY s, e) AS l FROM {source} GROUP BY user_id
      UNION ALL SELECT user_id, step + 1, m[1:a - 1] || [struct_pack(s := m[a].s, e := m[z].e, role := m[a].role)] || m[z + 1:] FROM (
        SELECT *, p - CASE WHEN p > 1 AND m[p - 1].role = m[p].role THEN 1 ELSE 0 END AS a, p + CASE WHEN p < len(m) AND m[p + 1].role = m[p].role THEN 1 ELSE 0 END AS z FROM (
          SELECT user_id, step, least(i, j) AS p, l[1:least(i, j) - 1] || [struct_pack(s := l[least(i, j)].s, e := l[greatest(i, j)].e, role := l[j].role)] || l[greatest(i, j) + 1:] AS m FROM (
            SELECT *, CASE WHEN i = 1 THEN 2 WHEN i = len(l) THEN i - 1 WHEN l[i + 1].e - l[i + 1].s > l[i - 1].e - l[i - 1].s THEN i + 1 ELSE i - 1 END AS j FROM (
              SELECT *, list_position(n, list_min(n)) AS i FROM (SELECT *, list_transform(l, lambda x: struct_pack(n := x.e - x.s, s := x.s)) AS n FROM {name}_w WHERE len(l) > 1) WHERE list_min(n).n < {least}))))),
    {name}_l AS (SELECT user_id, arg_max(l, step) AS l FROM {name}_w GROUP BY user_id),
    {name} AS (SELECT user_id, place::INT - 1 AS place, x.s AS s, x.e AS e, x.role AS role FROM (SELECT user_id, generate_subscripts(l, 1) AS place, unnest(l) AS x FROM {name}_l))"""


@query(f"WITH RECURSIVE given AS ({SQL['plan_normalize']}), {hold_sql('given', 'held', 2 * HOUR)} SELECT * FROM held")
def plan_minimum_hold(spark, sf_dir):
    return folds.minimum_hold(plan_normalize(spark, sf_dir), ["user_id"], least=2 * HOUR)


@query(
    f"""WITH RECURSIVE {_IV}, o AS (SELECT user_id, s, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, s) AS i FROM iv),
    w AS (SELECT user_id, i, [struct_pack(s := s, value := value)] AS taken FROM o WHERE i = 1
      UNION ALL SELECT w.user_id, o.i, CASE WHEN len(w.taken) < 5 AND len(list_filter(w.taken, lambda t: abs(t.s - o.s) < {24 * HOUR})) = 0 THEN list_append(w.taken, struct_pack(s := o.s, value := o.value)) ELSE w.taken END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1),
    f AS (SELECT user_id, arg_max(taken, i) AS taken FROM w GROUP BY user_id)
    SELECT user_id, CAST(generate_subscripts(taken, 1) AS INT) AS place, unnest(taken).s AS s, unnest(taken).value AS value FROM f"""
)
def nms_peaks(spark, sf_dir):
    return folds.suppress_peaks(event_intervals(spark, sf_dir), ["user_id"], "s", "value", apart=24 * HOUR, many=5)


@query()
def allocate(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_retailprice").alias("w"), F.col("p_size").alias("cap"))
    return folds.allocate(parts, ["p_brand"], "p_partkey", "w", "cap", total=500)


@query(
    f"""WITH {_IV}, bins AS (SELECT user_id, s // {HOUR} AS h, sum(value) AS v FROM iv GROUP BY ALL), series AS (SELECT user_id, list(v ORDER BY h) AS v FROM bins GROUP BY user_id),
    pairs AS (SELECT a.user_id, list_slice(a.v, greatest(len(a.v) // 3, 1), greatest(len(a.v) // 3, 1) + 11) AS p, b.v AS t FROM series a JOIN series b ON b.user_id = a.user_id + 1),
    places AS (SELECT *, unnest(range(0, greatest(len(t) - len(p) + 1, 0))) AS k FROM pairs), x AS (SELECT user_id, k, unnest(p) AS x, unnest(list_slice(t, k + 1, k + len(p))) AS y FROM places),
    c AS (SELECT user_id, k, CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN corr(x, y) ELSE 0 END AS c FROM x GROUP BY user_id, k), b AS (SELECT user_id, arg_max(k, struct_pack(c := round(c, 12), k := -k)) AS k, max(c) AS c FROM c GROUP BY user_id)
    SELECT pairs.user_id, CAST(coalesce(b.k, 0) AS INT) AS lag, round(coalesce(b.c, 0), 6) AS score FROM pairs LEFT JOIN b ON b.user_id = pairs.user_id"""
)
def ncc_lag(spark, sf_dir):
    """Where the middle of one user's hourly sums lies best in the next user's."""
    hour = F.floor(F.col("s") / HOUR)
    bins = event_intervals(spark, sf_dir).groupBy("user_id", hour.alias("h")).agg(F.sum("value").alias("v"))
    series = bins.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda x: x["v"]).alias("v"))
    probe = F.slice("v", F.greatest(F.floor(F.size("v") / 3).cast("int"), F.lit(1)), F.lit(12))
    other = series.select((F.col("user_id") - 1).alias("user_id"), F.col("v").alias("target"))
    pairs = series.select("user_id", probe.alias("probe")).join(other, "user_id")
    return signals.lags(pairs).select("user_id", "match.lag", F.round("match.score", 6).alias("score"))


@query(
    f"""WITH {_IV}, b AS (SELECT event_id, s, e, event_type AS p FROM iv WHERE event_id % 9 <> 0), a AS (SELECT event_id, s, e, CASE WHEN event_id % 10 = 0 THEN '?' ELSE event_type END AS p FROM iv WHERE event_id % 8 <> 0),
    d AS (SELECT event_id, b.s AS bs, b.e AS be, a.s AS as_, a.e AS ae, CASE WHEN b.s IS NULL THEN 'clip_added' WHEN a.s IS NULL THEN 'clip_removed' WHEN b.p <> a.p THEN 'clip_changed' WHEN a.p = 'error' THEN 'clip_source_changed' END AS why FROM b FULL JOIN a USING (event_id)),
    r AS (SELECT 1 AS k, least(coalesce(bs, as_), coalesce(as_, bs)) AS s, greatest(coalesce(be, ae), coalesce(ae, be)) AS e, why || ':' || event_id AS why FROM d WHERE why IS NOT NULL),
    f AS (SELECT *, CASE WHEN s > max(e) OVER (ORDER BY s, e, why ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM r WHERE e > s),
    g AS (SELECT *, 1 + CAST(sum(fresh) OVER (ORDER BY s, e, why) AS BIGINT) AS region FROM f)
    SELECT region, min(s) OVER w AS s, max(e) OVER w AS e, count(*) OVER w AS n, why AS reason FROM g WINDOW w AS (PARTITION BY region)"""
)
def changed_regions(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    before = iv.where("event_id % 9 <> 0").select("event_id", "s", "e", F.col("event_type").alias("print"), F.col("event_type").alias("source"))
    named = F.when(F.col("event_id") % 10 == 0, "?").otherwise(F.col("event_type"))
    after = iv.where("event_id % 8 <> 0").select("event_id", "s", "e", named.alias("print"), named.alias("source"))
    sources = iv.where("event_type = 'error'").select(F.col("event_type").alias("source"))
    return timeline.changed_regions(before, after, "event_id", pad=0, duration=1 << 60, source="source", changed_sources=sources, span=24 * HOUR)


@query(
    f"""WITH {_IV}, c AS (SELECT event_id AS clip_id, user_id AS track_id, event_type, s, e FROM iv)
    SELECT clip_id, 'empty_range' AS code FROM c WHERE e <= s UNION ALL SELECT clip_id, 'unknown_track' FROM c WHERE track_id % 10 = 0 UNION ALL SELECT clip_id, 'unknown_source' FROM c WHERE event_type = 'signup'
    UNION ALL SELECT clip_id, 'overlap' FROM (SELECT *, lag(e) OVER (PARTITION BY track_id ORDER BY s, e, clip_id) AS pe FROM c WHERE event_type <> 'click') WHERE s < pe
    UNION ALL SELECT clip_id, 'wrong_kind' FROM c WHERE event_type IN ('error', 'view') AND clip_id % 3 = 1 AND NOT (event_type = 'view' AND clip_id % 3 = 0)"""
)
def timeline_validation(spark, sf_dir):
    iv = event_intervals(spark, sf_dir)
    clips = iv.select(F.col("event_id").alias("clip_id"), F.col("user_id").alias("track_id"), F.col("event_type").alias("source_id"), "s", "e", (F.col("event_type") == "click").alias("allow_overlap"), F.when(F.col("event_id") % 3 == 1, "audio").when(F.col("event_id") % 3 == 2, "video").alias("kind"))
    tracks = iv.where("user_id % 10 <> 0").select(F.col("user_id").alias("track_id")).distinct()
    shown = F.when(F.col("event_type").isin("error", "view"), "image").otherwise("audio")
    sources = iv.where("event_type <> 'signup'").select(F.col("event_type").alias("source_id"), shown.alias("kind")).distinct()
    return timeline.validate(clips, tracks, sources, 1 << 60, kinds={"audio": ["audio"], "video": ["image", "audio"]})
