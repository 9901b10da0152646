"""Registered queries of boxes, frame roll-ups and clocks, each with SQL. Line items stand in for boxes seen in frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clock, geometry
from tessera.operators import aggregates
from tessera.queries import query
from tessera.session import table

# a line item is a person's box in a frame of 400 x 300 (the order); corners come from its numbers, in whole units
_CORNERS = "l_partkey % 400 AS x1, l_suppkey % 300 AS y1, (l_partkey * 7 + l_linenumber * 31) % 400 AS x2, (l_suppkey * 3 + l_linenumber * 53) % 300 AS y2"
_BOXES = f"""raw AS (SELECT l_orderkey AS frame, l_linenumber AS item, l_returnflag, l_discount, l_tax, {_CORNERS} FROM lineitem),
box AS (SELECT frame, item, l_returnflag, l_discount, l_tax, least(x1, x2) / 400.0::DOUBLE AS x1, least(y1, y2) / 300.0::DOUBLE AS y1, greatest(x1, x2) / 400.0::DOUBLE AS x2, greatest(y1, y2) / 300.0::DOUBLE AS y2 FROM raw),
boxes AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM box)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("item"), "l_returnflag", "l_discount", "l_tax",
        geometry.box(F.col("l_partkey") % 400, F.col("l_suppkey") % 300, (F.col("l_partkey") * 7 + F.col("l_linenumber") * 31) % 400, (F.col("l_suppkey") * 3 + F.col("l_linenumber") * 53) % 300).alias("raw"),
    )
    return rows.withColumn("box", geometry.box_ratio(F.col("raw"), F.lit(400.0), F.lit(300.0))).withColumn("area", geometry.area(F.col("box")))


@query(f"""WITH {_BOXES} SELECT frame, item, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2,
CASE WHEN x2 > x1 AND y2 > y1 THEN round(greatest(0.0, x1 - (x2 - x1) * 0.08), 6) END AS gx1, CASE WHEN x2 > x1 AND y2 > y1 THEN round(greatest(0.0, y1 - (y2 - y1) * 0.16), 6) END AS gy1,
CASE WHEN x2 > x1 AND y2 > y1 THEN round(least(1.0, y2 + (y2 - y1) * 0.08), 6) END AS gy2, round(abs(cx - 0.618) + abs(cy - 0.382) * 0.65, 6) AS distance,
CASE WHEN cx < 0.38 THEN 'left' WHEN cx > 0.62 THEN 'right' ELSE 'center' END AS position, CASE WHEN area >= 0.38 THEN 'close' WHEN area >= 0.16 THEN 'medium' ELSE 'wide' END AS size FROM boxes""")
def box_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as ratios, grown, with their distance from a preferred point and labels of place and size."""
    b, grown = F.col("box"), F.col("grown")
    rows = _boxes(spark, sf_dir).withColumn("grown", geometry.expand_box(b)).withColumn("c", geometry.box_center(b))
    ratios = [F.round(b[c], 6).alias(c) for c in ("x1", "y1", "x2", "y2")]
    more = [F.round(grown[c], 6).alias(f"g{c}") for c in ("x1", "y1", "y2")]
    return rows.select("frame", "item", *ratios, *more, F.round(geometry.center_distance(b, 0.618), 6).alias("distance"), geometry.position_label(F.col("c.x")).alias("position"), geometry.size_label(F.col("area")).alias("size"))


@query(f"""WITH {_BOXES}, look AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'N' THEN 'right' ELSE 'front' END AS direction, CASE WHEN area >= 0.32 THEN 0.74 WHEN area >= 0.20 THEN 0.84 WHEN area >= 0.12 THEN 0.92 ELSE 1.0 END AS visible FROM boxes)
SELECT frame, item, CAST(CASE direction WHEN 'left' THEN 0.618 WHEN 'right' THEN 0.382 ELSE 0.5 END AS DOUBLE) AS target, CAST(visible AS DOUBLE) AS visible,
round(CAST(greatest(0.2, least(0.8, cx - (CASE direction WHEN 'left' THEN 0.618 WHEN 'right' THEN 0.382 ELSE 0.5 END - 0.5) * visible)) AS DOUBLE), 6) AS center,
CASE WHEN l_tax > 0 THEN round(greatest(0.8, least(1.25, 1 + (l_discount / l_tax - 1) * 0.5)), 6) ELSE 1.0 END AS gain,
CASE WHEN l_discount >= 0.08 THEN 'bright' WHEN l_discount <= 0.02 THEN 'dark' ELSE 'neutral' END AS exposure FROM look""")
def crop_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a crop's centre goes by the way the face looks, and a colour gain within bounds."""
    direction = F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "N", "right").otherwise("front")
    rows = _boxes(spark, sf_dir).withColumn("target", geometry.subject_target(direction)).withColumn("visible", geometry.visible_ratio(F.col("area")))
    center = geometry.crop_center(geometry.box_center(F.col("box"))["x"], F.col("target"), F.col("visible"))
    gain = geometry.channel_gain(F.col("l_discount"), F.col("l_tax"), 0.5, 0.8, 1.25)
    return rows.select("frame", "item", "target", "visible", F.round(center, 6).alias("center"), F.round(gain, 6).alias("gain"), geometry.level_label(F.col("l_discount"), 0.02, 0.08, ("dark", "neutral", "bright")).alias("exposure"))


@query(f"""WITH {_BOXES}, pairs AS (SELECT a.frame, a.item AS person, b.item AS face, b.area AS area, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / greatest(least(a.area, b.area), 1e-12) AS o,
b.cx BETWEEN a.x1 AND a.x2 AND b.cy BETWEEN a.y1 AND a.y2 AS inside FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.item <> b.item)
SELECT frame, person, arg_max(face, struct_pack(a := round(area, 9), i := -face)) FILTER (inside) AS face, round(max(o), 6) AS overlap FROM pairs GROUP BY frame, person""")
def faces_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box the largest other one whose centre lies in it, and the most it has in common with any other."""
    rows = _boxes(spark, sf_dir).select("frame", "item", "box", "area")
    other = rows.select("frame", F.col("item").alias("face"), F.col("box").alias("b"), F.col("area").alias("face_area"))
    pairs = rows.withColumnRenamed("item", "person").join(other, "frame").where("person <> face")
    rank = F.struct(F.round("face_area", 9), -F.col("face"))
    inside = geometry.holds_center(F.col("box"), F.col("b"))
    face = F.max_by(F.when(inside, F.col("face")), F.when(inside, rank))
    return pairs.groupBy("frame", "person").agg(face.alias("face"), F.round(F.max(geometry.overlap_ratio(F.col("box"), F.col("b"))), 6).alias("overlap"))


@query(f"""WITH {_BOXES}, m AS (SELECT *, max(area) OVER (PARTITION BY frame) AS largest, count(*) OVER (PARTITION BY frame) AS n FROM boxes)
SELECT frame, string_agg(item::VARCHAR, ',' ORDER BY item) AS kept, count(*) AS n_kept, max(n) AS n FROM m WHERE n <= 1 OR largest <= 0 OR area >= 0.18 OR area >= 0.42 * largest GROUP BY frame""")
def significant_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without the boxes that are small beside their largest."""
    frames = _boxes(spark, sf_dir).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("item", "area"))).alias("items"))
    kept = geometry.significant(F.col("items"))
    return frames.select("frame", F.array_join(F.transform(kept, lambda p: p["item"].cast("string")), ",").alias("kept"), F.size(kept).cast("long").alias("n_kept"), F.size("items").cast("long").alias("n"))


@query(f"""WITH {_BOXES}, f AS (SELECT frame % 500 AS video, frame, count(*) FILTER (area >= 0.05) AS people, max(area) AS main, avg(l_discount) AS brightness FROM boxes GROUP BY frame),
d AS (SELECT frame % 500 AS video, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS directions FROM boxes GROUP BY 1)
SELECT video, count(*) AS frames, count(*) FILTER (people > 0) AS present, round(count(*) FILTER (people > 0) / count(*), 6) AS ratio, max(people) AS most, round(avg(people), 6) AS mean_people, round(avg(main), 9) AS mean_main, round(avg(brightness), 6) AS brightness, directions
FROM f JOIN d USING (video) GROUP BY video, directions""")
def frame_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each video: frames with people, their number and size, and the ways they look."""
    boxes = _boxes(spark, sf_dir).withColumn("video", F.col("frame") % 500)
    frames = boxes.groupBy("video", "frame").agg(F.count_if(F.col("area") >= 0.05).alias("people"), F.max("area").alias("main"), F.avg("l_discount").alias("brightness"), F.collect_set("l_returnflag").alias("looks"))
    present = F.count_if(F.col("people") > 0)
    looks = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("looks")))), ",")
    return frames.groupBy("video").agg(F.count("*").alias("frames"), present.alias("present"), F.round(present / F.count("*"), 6).alias("ratio"), F.max("people").alias("most"), F.round(F.avg("people"), 6).alias("mean_people"), F.round(F.avg("main"), 9).alias("mean_main"), F.round(F.avg("brightness"), 6).alias("brightness"), looks.alias("directions"))


@query("""WITH m AS (SELECT user_id, value / 10000 AS x FROM events), r AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM m),
p AS (SELECT user_id, max(n) AS samples, max(CASE WHEN i = round_even((n - 1) * 0.5::DOUBLE, 0) THEN x END) AS median, max(CASE WHEN i = round_even((n - 1) * 0.9::DOUBLE, 0) THEN x END) AS p90 FROM r GROUP BY user_id)
SELECT user_id, samples, median, p90, CASE WHEN median <= 0.0011 AND p90 <= 0.004 THEN 'fixed' ELSE 'moving' END AS motion FROM p""")
def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a camera stands still, by the median and the ninth decile of its motion."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 10000).alias("x"))
    found = aggregates.nearest_rank(rows, ["user_id"], "x", {"median": 0.5, "p90": 0.9})
    still = (F.col("median") <= 0.0011) & (F.col("p90") <= 0.004)
    return found.select("user_id", F.col("n").alias("samples"), "median", "p90", F.when(still, "fixed").otherwise("moving").alias("motion"))


@query(f"""WITH {_BOXES}, c AS (SELECT frame % 200 AS video, unnest(range(CAST(floor(x1 * 40) AS INT), CAST(ceil(x2 * 40) AS INT))) AS i, y1, y2 FROM boxes),
g AS (SELECT DISTINCT video, i, unnest(range(CAST(floor(y1 * 30) AS INT), CAST(ceil(y2 * 30) AS INT))) AS j FROM c) SELECT video, count(*) / 1200 AS covered FROM g GROUP BY video""")
def covered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a raster of 40 x 30 cells that boxes cover."""
    boxes = _boxes(spark, sf_dir).select((F.col("frame") % 200).alias("video"), "box.*")
    return aggregates.raster_cover(boxes, ["video"], columns=40, rows=30)


@query("""WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(event_id % 90 AS VARCHAR) || '.5' WHEN 1 THEN CAST(event_id % 60 AS VARCHAR) || ':' || lpad(CAST(event_id % 59 AS VARCHAR), 2, '0') WHEN 2 THEN CAST(event_id % 12 AS VARCHAR) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':07,25'
  WHEN 3 THEN 'x:' || event_id WHEN 4 THEN ' 5:06.75 ' WHEN 5 THEN '1:2:3:4' ELSE '' END AS clock,
  CASE event_id % 5 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25' WHEN 2 THEN '1/0' WHEN 3 THEN 'a/b' ELSE CAST(event_id % 60 + 1 AS VARCHAR) || '/1' END AS rate FROM events),
p AS (SELECT *, string_split(replace(trim(clock), ',', '.'), ':') AS q, string_split(rate, '/') AS f FROM t),
n AS (SELECT *, list_transform(q, lambda x: CASE WHEN regexp_full_match(x, '[-+]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(x AS DOUBLE) END) AS d, list_transform(f, lambda x: TRY_CAST(x AS DOUBLE)) AS r FROM p)
SELECT event_id, CASE len(q) WHEN 1 THEN d[1] WHEN 2 THEN d[1] * 60 + d[2] WHEN 3 THEN d[1] * 3600 + d[2] * 60 + d[3] END AS seconds,
coalesce(CASE len(q) WHEN 1 THEN d[1] WHEN 2 THEN d[1] * 60 + d[2] WHEN 3 THEN d[1] * 3600 + d[2] * 60 + d[3] END, 0) AS or_zero,
CASE WHEN regexp_full_match(trim(clock), '\\d{1,2}:\\d{2}') THEN '0:' || lpad(q[1], 2, '0') || ':' || q[2] || '.00' WHEN regexp_full_match(trim(clock), '\\d{1,2}:\\d{2}\\.\\d+') THEN '0:' || lpad(q[1], 2, '0') || ':' || q[2] ELSE trim(clock) END AS whole,
round(coalesce(CASE WHEN coalesce(r[2], CASE WHEN len(r) = 1 THEN 1 END) <> 0 THEN r[1] / coalesce(r[2], 1) END, 30), 9) AS fps,
CAST(floor(event_id / 8 * coalesce(CASE WHEN coalesce(r[2], CASE WHEN len(r) = 1 THEN 1 END) <> 0 THEN r[1] / coalesce(r[2], 1) END, 30) + 0.5) AS BIGINT) AS frames FROM n""".replace("\\\\", "\\"))
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks and rates as people write them, read leniently and strictly."""
    i, e = F.col("event_id"), F.col("event_id").cast("string")

    def two(m: int):
        return F.lpad((i % m).cast("string"), 2, "0")

    text = (
        F.when(i % 7 == 0, F.concat((i % 90).cast("string"), F.lit(".5")))
        .when(i % 7 == 1, F.concat((i % 60).cast("string"), F.lit(":"), two(59)))
        .when(i % 7 == 2, F.concat((i % 12).cast("string"), F.lit(":"), two(60), F.lit(":07,25")))
        .when(i % 7 == 3, F.concat(F.lit("x:"), e)).when(i % 7 == 4, " 5:06.75 ").when(i % 7 == 5, "1:2:3:4").otherwise("")
    )
    rate = F.when(i % 5 == 0, "30000/1001").when(i % 5 == 1, "25").when(i % 5 == 2, "1/0").when(i % 5 == 3, "a/b").otherwise(F.concat((i % 60 + 1).cast("string"), F.lit("/1")))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("clock"), rate.alias("rate")).withColumn("fps", clock.fraction(F.col("rate"), 30.0))
    frames = clock.rational_time(F.col("event_id") / 8, F.col("fps"))["value"]
    return rows.select("event_id", clock.flexible_seconds(F.col("clock")).alias("seconds"), clock.clock_seconds(F.col("clock")).alias("or_zero"), clock.full_timestamp(F.col("clock")).alias("whole"), F.round("fps", 9).alias("fps"), frames.alias("frames"))


@query("""SELECT o_orderkey, CASE WHEN least(epoch_us(o_orderdate) + 864000000000, epoch_us(ts) + 1728000000000) > greatest(epoch_us(o_orderdate), epoch_us(ts)) THEN greatest(epoch_us(o_orderdate), epoch_us(ts)) END AS s,
CASE WHEN least(epoch_us(o_orderdate) + 864000000000, epoch_us(ts) + 1728000000000) > greatest(epoch_us(o_orderdate), epoch_us(ts)) THEN least(epoch_us(o_orderdate) + 864000000000, epoch_us(ts) + 1728000000000) END AS e,
epoch_us(o_orderdate) - CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 32400000000 END AS created, printf('%d:%02d:%02d.%02d', o_orderkey * 1234567 // 3600000000, o_orderkey * 1234567 // 60000000 % 60, o_orderkey * 1234567 // 1000000 % 60, o_orderkey * 1234567 // 10000 % 100) AS ass
FROM orders JOIN events ON event_id = o_orderkey""")
def wall_clock_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two recordings in common, creation times with and without a zone (UTC or Tokyo), and centisecond clocks."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("o_orderkey"), "ts"), "o_orderkey")
    day = 86_400_000_000
    s1, s2 = F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.unix_micros(F.col("ts").cast("timestamp"))
    both = clock.common_window(s1, s1 + 10 * day, s2, s2 + 20 * day)
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    made = clock.instant(F.when(F.col("o_orderkey") % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(text), "Asia/Tokyo")
    return orders.select("o_orderkey", both["s"].alias("s"), both["e"].alias("e"), F.unix_micros(made).alias("created"), clock.centisecond_clock(F.col("o_orderkey") * 1234567).alias("ass"))
