"""Registered queries of profiles, quality, cut findings and captions to prune, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans import reviews
from tessera.queries import HOUR, MINUTE, query
from tessera.queries_plans import _LOCAL, _PLAN, _local, _plan
from tessera.session import checkpointed, table


@query("""WITH f AS (SELECT l_returnflag AS k, l_orderkey * 10 + l_linenumber AS o, l_quantity AS q, l_discount AS d, l_linestatus AS a, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS b FROM lineitem),
a AS (SELECT k, a AS v, count(*) AS c, min(o) AS o FROM f GROUP BY ALL), b AS (SELECT k, coalesce(b::VARCHAR, 'unknown') AS v, count(*) AS c, min(o) AS o FROM f GROUP BY ALL)
SELECT m.k AS l_returnflag, m.n, round(q, 6) AS quantity, round(d, 9) AS discount, x.t AS status_top, x.l AS status_counts, y.t AS line_top, y.l AS line_counts FROM (SELECT k, count(*) AS n, avg(q) AS q, avg(d) AS d FROM f GROUP BY k) m
JOIN (SELECT k, arg_min(v, struct_pack(c := -c, o := o)) AS t, string_agg(v || ':' || c, ',' ORDER BY v) AS l FROM a GROUP BY k) x ON x.k = m.k JOIN (SELECT k, arg_min(v, struct_pack(c := -c, o := o)) AS t, string_agg(v || ':' || c, ',' ORDER BY v) AS l FROM b GROUP BY k) y ON y.k = m.k""")
def profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile for all frames of a kind of files: means, and labels with their counts."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_linestatus").alias("status"), F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("line"))
    out = reviews.profile(rows, ["l_returnflag"], "o", means=["quantity", "discount"], labels=["status", "line"])
    return out.withColumn("quantity", F.round("quantity", 6)).withColumn("discount", F.round("discount", 9))


_MEASURES = "SELECT l_orderkey, l_linenumber, l_discount * 10 AS brightness, l_tax * 5 AS saturation, l_partkey % 1200 AS sharpness, l_linenumber AS faces, l_quantity / 300 AS face_area, l_discount AS motion, l_tax / 2 AS camera_motion, l_quantity / 200 AS scene_motion FROM lineitem"


def _parts(parts: dict) -> str:
    def share(name: str, full: float) -> str:
        if name == "brightness":
            return f"(1 - least(abs({name} - {full}::DOUBLE) / {full}::DOUBLE, 1.0::DOUBLE))"
        more = f"least({name} / {full}::DOUBLE, 1.0::DOUBLE)"
        return f"(1 - {more})" if name in ("camera_motion", "scene_motion") else more

    return "round(" + " + ".join(f"{w}::DOUBLE * {share(n, full)}" for n, (w, full) in parts.items()) + ", 5)"


@query(f"WITH m AS ({_MEASURES}) SELECT l_orderkey, l_linenumber, {_parts(reviews.FRAME_PARTS)} AS frame, {_parts(reviews.SAMPLE_PARTS)} AS sample FROM m")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good a frame and a sample of a video are, by their measures."""
    c = F.col
    m = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("brightness"), (c("l_tax") * 5).alias("saturation"), (c("l_partkey") % 1200).alias("sharpness"), c("l_linenumber").alias("faces"), (c("l_quantity") / 300).alias("face_area"),
        c("l_discount").alias("motion"), (c("l_tax") / 2).alias("camera_motion"), (c("l_quantity") / 200).alias("scene_motion"),
    )
    return m.select("l_orderkey", "l_linenumber", reviews.quality(reviews.FRAME_PARTS).alias("frame"), reviews.quality(reviews.SAMPLE_PARTS).alias("sample"))


@query(f"""{_PLAN}, q AS (SELECT user_id, s, e, role, row_number() OVER w AS i, lead(role) OVER w AS following FROM plan WINDOW w AS (PARTITION BY user_id ORDER BY s, e, role)), c AS (SELECT DISTINCT user_id, e AS s FROM iv WHERE event_id % 3 = 1), t AS (SELECT user_id, i, e AS s FROM q WHERE role <> following),
k AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY i) AS e FROM t)
SELECT q.user_id, 'short_near_cut' AS finding, q.s, q.e, min(least(abs(c.s - q.s), abs(c.s - q.e))) AS distance FROM q JOIN c ON c.user_id = q.user_id WHERE q.e - q.s < {HOUR} GROUP BY q.user_id, q.i, q.s, q.e HAVING min(least(abs(c.s - q.s), abs(c.s - q.e))) <= {10 * MINUTE}
UNION ALL SELECT t.user_id, 'not_aligned', t.s, c.s, abs(t.s - c.s) FROM t JOIN c ON c.user_id = t.user_id AND abs(t.s - c.s) BETWEEN {MINUTE} + 1 AND {10 * MINUTE}
UNION ALL SELECT k.user_id, 'clustered', k.s, k.e, min(least(abs(c.s - k.s), abs(c.s - k.e))) FROM k JOIN c ON c.user_id = k.user_id WHERE k.e - k.s <= {HOUR} GROUP BY k.user_id, k.i, k.s, k.e HAVING min(least(abs(c.s - k.s), abs(c.s - k.e))) <= {10 * MINUTE}""")
def cut_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short segments near a cut, changes that miss one, changes close together near one."""
    cuts = _local(spark, sf_dir).where("event_id % 3 = 1").select("user_id", F.col("e").alias("s"))
    return reviews.cut_findings(checkpointed(_plan(spark, sf_dir)), cuts, ["user_id"], near=10 * MINUTE, align=MINUTE, short=HOUR)


@query(rf"""WITH t AS (SELECT conv_id, turn, x, lower(regexp_replace(coalesce(x, ''), '{text.PUNCTUATION}', '', 'g')) AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 9 = 8 THEN ' ...' WHEN turn % 9 = 7 THEN 'Oh!' ELSE text END AS x FROM conversations))
SELECT conv_id, turn, CASE WHEN p = '' THEN 'empty' WHEN length(p) < 4 THEN 'short' WHEN regexp_matches(x, '[0-9]{{3}}') THEN 'numbers' WHEN regexp_matches(x, '(?i)sch.*sch') THEN 'chatter' END AS reason,
CASE WHEN x IS NULL THEN 0.1 ELSE least(1.0, greatest(0.0, 0.1 + CASE WHEN contains(x, 'tion') OR contains(x, 'ment') THEN 0.45 ELSE 0 END + CASE WHEN contains(x, 'ing') THEN 0.3 ELSE 0 END + CASE WHEN contains(x, 'qu') OR contains(x, 'sch') THEN 0.25 ELSE 0 END)) END::DOUBLE AS score FROM t""")
def caption_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a caption would go, and how much its words make it worth."""
    x = F.when(F.col("turn") % 9 == 8, " ...").when(F.col("turn") % 9 == 7, "Oh!").otherwise(F.col("text"))
    reason = reviews.prune_reason(F.col("x"), [("numbers", "[0-9]{3}"), ("chatter", "(?i)sch.*sch")], least=4)
    groups = {"matter": (0.45, ["tion", "ment"]), "doing": (0.3, ["ing"]), "sound": (0.25, ["qu", "sch"])}
    return table(spark, sf_dir, "conversations").withColumn("x", x).select("conv_id", "turn", reason.alias("reason"), F.round(reviews.editorial_score(F.col("x"), groups, base=0.1), 9).alias("score"))


@query("""WITH v AS (SELECT user_id, CASE WHEN event_id % 10 = 3 THEN 'NaN'::DOUBLE WHEN event_id % 10 = 4 THEN 'Infinity'::DOUBLE WHEN event_id % 10 = 5 THEN NULL ELSE value END AS v FROM events), f AS (SELECT user_id, CASE WHEN isfinite(v) THEN v END AS v FROM v)
SELECT user_id, count(v) AS level_n, round(avg(v), 6) AS level_mean, max(v) AS level_max, min(v) AS level_min FROM f GROUP BY user_id""")
def finite_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, largest and smallest of what is a finite number."""
    i = F.col("event_id") % 10
    level = F.when(i == 3, float("nan")).when(i == 4, float("inf")).when(i != 5, F.col("value"))
    out = reviews.summaries(table(spark, sf_dir, "events").select("user_id", level.alias("level")), ["user_id"], ["level"])
    return out.withColumn("level_mean", F.round("level_mean", 6))
