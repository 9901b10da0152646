"""Registered queries of sources, sinks, roles, proxies, inserts and comparisons, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import folds, intervals, relations, sequences
from tessera.queries import HOUR, MINUTE, query
from tessera.queries_frames import _boxes
from tessera.queries_plans import _LOCAL, _local
from tessera.session import table
from tessera.sources import subtitles


@query(r"""WITH k AS (SELECT page_id, CASE WHEN contains(url, 'example.com') THEN 'video' WHEN contains(url, 'example.net') THEN 'audio' ELSE 'other' END AS kind, (CASE WHEN contains(url, '//m.') THEN 3 ELSE 0 END) + (CASE WHEN contains(url, 'page=') THEN 2 ELSE 0 END) + (CASE WHEN contains(url, '#') THEN 1 ELSE 0 END) AS score FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, page_id) AS n FROM k)
SELECT page_id, kind, CASE WHEN kind = 'other' THEN 'unassigned' WHEN n = 1 AND kind = 'video' THEN 'master' WHEN kind = 'video' THEN 'camera' || n ELSE 'external' || n END AS role FROM r""")
def media_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by kind, and roles by how much their names say for them."""
    url = F.col("url")
    kind = relations.first_rule([(F.contains(url, F.lit("example.com")), "video"), (F.contains(url, F.lit("example.net")), "audio")], "other")
    score = F.lit(0)
    for part, points in (("//m.", 3), ("page=", 2), ("#", 1)):
        score = score + F.when(F.contains(url, F.lit(part)), points).otherwise(0)
    rows = table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), score.alias("score"))
    # places in one order of all files, by stretches; the places of a kind follow one another
    ranked = sequences.global_rank(rows.withColumn("less", -F.col("score")), "kind", ["less", "page_id"], "place")
    first = ranked.groupBy("kind").agg(F.min("place").alias("first"))
    rows = ranked.join(first, "kind").withColumn("n", F.col("place") - F.col("first") + 1)
    role = F.when(F.col("kind") == "other", "unassigned").when((F.col("kind") == "video") & (F.col("n") == 1), "master").when(F.col("kind") == "video", F.concat(F.lit("camera"), "n")).otherwise(F.concat(F.lit("external"), "n"))
    return rows.select("page_id", "kind", role.alias("role"))


@query("""WITH p AS (SELECT l_orderkey AS k, min(l_suppkey) AS sig, min(l_partkey) AS path FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN p.sig = o_custkey % 100 THEN p.path ELSE -o_orderkey END AS path, CASE WHEN p.k IS NULL THEN 'no_proxy' WHEN p.sig = o_custkey % 100 THEN 'proxy' ELSE 'stale' END AS reason,
coalesce(s.shipped, false) AS shipped, coalesce(s.returned, false) AS returned, CASE WHEN coalesce(s.shipped, false) AND coalesce(s.returned, false) THEN 'complete' WHEN s.k IS NULL THEN 'missing' ELSE 'partial' END AS status
FROM orders LEFT JOIN p ON p.k = o_orderkey LEFT JOIN (SELECT l_orderkey AS k, bool_or(l_linestatus = 'F') AS shipped, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) s ON s.k = o_orderkey""")
def proxy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in file where its signature is current, and which results exist for an item."""
    lines = table(spark, sf_dir, "lineitem")
    found = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("sig"), F.min("l_partkey").alias("own"), F.bool_or(F.col("l_linestatus") == "F").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    rows = table(spark, sf_dir, "orders").join(found, "o_orderkey", "left")
    current = F.coalesce(F.col("sig") == F.col("o_custkey") % 100, F.lit(False))
    shipped, returned = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    reason = F.when(F.col("sig").isNull(), "no_proxy").when(current, "proxy").otherwise("stale")
    status = F.when(shipped & returned, "complete").when(F.col("sig").isNull(), "missing").otherwise("partial")
    return rows.select("o_orderkey", F.when(current, F.col("own")).otherwise(-F.col("o_orderkey")).alias("path"), reason.alias("reason"), shipped.alias("shipped"), returned.alias("returned"), status.alias("status"))


@query(r"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, turn, text FROM conversations WHERE trim(coalesce(text, '')) <> '')
SELECT conv_id, number, printf('Dialogue: 0,0:%02d:%02d.00,0:%02d:%02d.50,%s,,0,0,0,,', turn // 60, turn % 60, turn // 60, turn % 60, 'Main') || replace(text, chr(10), '\N') AS ass, 'file ''' || conv_id || '''\''''/' || number || '''' AS line,
number || chr(10) || printf('00:%02d:%02d,000 --> 00:%02d:%02d,500', turn // 60, turn % 60, turn // 60, turn % 60) || chr(10) || text || chr(10) AS srt FROM c""")
def subtitle_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns numbered anew without empty ones, as SRT blocks, as Dialogue lines and as a list of files."""
    s = F.col("turn") * 1_000_000
    rows = subtitles.numbered(table(spark, sf_dir, "conversations").select("conv_id", s.alias("s"), (s + 500_000).alias("e"), "text"), ["conv_id"])
    path = F.concat(F.col("conv_id").cast("string"), F.lit("'/"), F.col("number").cast("string"))
    block = subtitles.srt_block(F.col("number"), F.col("s"), F.col("e"), F.col("text"))
    return rows.select("conv_id", "number", subtitles.ass_line(F.col("s"), F.col("e"), F.lit("Main"), F.col("text")).alias("ass"), subtitles.concat_line(path).alias("line"), block.alias("srt"))


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, event_id % 3600 * 1000000 AS s, event_id % 3600 * 1000000 + 1500000 AS e, event_type AS text FROM events""")
def transcripts_of_two_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written as JSON or as SRT, read back by one reader."""
    s = F.col("event_id") % 3600
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("start"), (s + 1.5).alias("end"), F.col("event_type").alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("event_id", "start", "end", "text")))
    both = rows.groupBy("user_id").agg(listed.alias("x"))
    as_json = F.to_json(F.struct(F.col("x").alias("segments")))
    block = F.transform("x", lambda r: subtitles.srt_block(r["event_id"], r["start"] * 1_000_000, r["start"] * 1_000_000 + 1_500_000, r["text"]))
    files = both.select("user_id", F.when(F.col("user_id") % 2 == 0, as_json).otherwise(F.array_join(block, "\n")).alias("value"))
    return subtitles.parse_segments(files, ["user_id"])


@query(f"""WITH {_LOCAL}, c AS (SELECT user_id, s, e, {10 * MINUTE} AS card FROM iv WHERE event_type = 'error'), g AS (SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c) WHERE reach IS NULL OR s >= reach),
p AS (SELECT user_id, event_id, s AS t FROM iv WHERE event_type <> 'error')
SELECT p.user_id, p.event_id, p.t AS s, CAST(coalesce((SELECT sum(card - (e - s)) FROM g WHERE g.user_id = p.user_id AND g.e <= p.t AND g.s <= p.t), 0) + coalesce((SELECT max(g.s) FROM g WHERE g.user_id = p.user_id AND g.s <= p.t AND p.t < g.e), p.t) AS BIGINT) AS mapped FROM p""")
def replaced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times after stretches have given way to cards of another length."""
    rows = _local(spark, sf_dir)
    cuts = rows.where("event_type = 'error'").select("user_id", "s", "e", F.lit(10 * MINUTE).alias("card"))
    return intervals.replace_ranges(rows.where("event_type <> 'error'"), cuts, ["user_id"], "event_id")


@query(f"""WITH RECURSIVE {_LOCAL}, o AS (SELECT user_id, event_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i FROM iv), w AS (SELECT user_id, event_id, s, i FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, greatest(o.s, w.s + {6 * HOUR}), o.i FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, event_id, s, s + {6 * HOUR} AS e FROM w""")
def pushed_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of one length, moved on where they would collide."""
    return intervals.push_forward(_local(spark, sf_dir), ["user_id"], "event_id", length=6 * HOUR)


@query("""WITH r AS (SELECT user_id, event_id, event_type = 'view' AS film, row_number() OVER (PARTITION BY user_id, event_type = 'view' ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type = 'view') AS many FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (n * 2 - 1) / (many * 2), film DESC, event_id) AS place FROM r""")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of items in one sequence, each spread evenly over it."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("film"))
    return sequences.interleave(rows, ["user_id"], "film", ["event_id"]).select("user_id", "event_id", "place")


@query("""WITH a AS (SELECT user_id, list(event_type ORDER BY event_id) AS x, list(CASE WHEN value > 50 THEN event_id END ORDER BY event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(['view', 'click', 'purchase', 'nothing', 'error'], lambda d: list_contains(x, d)), ',') AS known, coalesce(x[1], '-') AS first, list_last(list_filter(v, lambda i: i IS NOT NULL)) AS loud, NOT list_has_any(x, ['nothing', 'none']) AS apart,
array_to_string(list_transform(list_sort(list_distinct(x)), lambda k: k || '=' || CASE WHEN k = 'click' THEN 'new' ELSE 'old' END), ',') AS merged FROM a""")
def array_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays in the order of a fixed list, first and last matching elements, disjointness, and maps merged so that the right one wins."""
    listed = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(listed.alias("x"))
    kinds = F.transform("x", lambda p: p["event_type"])
    domain = F.array(*map(F.lit, ["view", "click", "purchase", "nothing", "error"]))
    loud = F.try_element_at(F.filter("x", lambda p: p["value"] > 50), F.lit(-1))["event_id"]
    left = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.lit("old"))))
    merged = sequences.merge_maps(left, F.create_map(F.lit("click"), F.lit("new")))
    pairs = F.transform(F.array_sort(F.map_keys(left)), lambda k: F.concat(k, F.lit("="), F.try_element_at(merged, k)))
    return rows.select("user_id", F.array_join(F.filter(domain, lambda d: F.array_contains(kinds, d)), ",").alias("known"), F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit("-")).alias("first"), loud.alias("loud"), (~F.arrays_overlap(kinds, F.array(F.lit("nothing"), F.lit("none")))).alias("apart"), F.array_join(pairs, ",").alias("merged"))


@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS k, c_custkey AS i, CAST(c_custkey * 37 % 4096 AS BIGINT) AS code, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer),
w AS (SELECT k, n, i, i AS leader, [struct_pack(i := i, code := code)] AS heads FROM c WHERE n = 1
  UNION ALL SELECT c.k, c.n, c.i, coalesce(list_first(list_filter(w.heads, lambda h: bit_count(xor(h.code, c.code)) <= 3)).i, c.i), CASE WHEN len(list_filter(w.heads, lambda h: bit_count(xor(h.code, c.code)) <= 3)) > 0 THEN w.heads ELSE list_append(w.heads, struct_pack(i := c.i, code := c.code)) END FROM w JOIN c ON c.k = w.k AND c.n = w.n + 1)
SELECT k AS c_nationkey, i AS c_custkey, leader FROM w""")
def leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that differ in three bits at most stand behind the best one."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") * 37 % 4096).alias("code"), "c_acctbal")
    return folds.leaders(rows, ["c_nationkey"], "c_custkey", "code", "c_acctbal", within=3)


@query(rf"""WITH p AS (SELECT a.conv_id, a.turn, regexp_replace(lower(a.text), '[\s.,!?]', '', 'g') AS x, regexp_replace(lower(b.text), '[\s.,!?]', '', 'g') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
x AS (SELECT conv_id, turn, c, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(x, '')) AS c FROM p) GROUP BY ALL), y AS (SELECT conv_id, turn, c, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(y, '')) AS c FROM p) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS common FROM x JOIN y USING (conv_id, turn, c) GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN length(x) > 0 THEN round(coalesce(common, 0) / length(x), 9) ELSE 0.0 END AS overlap FROM p LEFT JOIN o USING (conv_id, turn)""".replace("[\\s.,!?]", text.PUNCTUATION))
def char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a turn's characters the next turn holds, without space and punctuation, order aside."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.normalized(F.col("text")).alias("x"))
    pairs = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(text.char_overlap(F.col("x"), F.col("y")), 9).alias("overlap"))


@query()
def seq_ratio_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pairs of neighbouring turns of each conversation whose texts are most alike (no SQL: matching blocks of two texts)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # a pair costs about a millisecond: tasks follow the rows, not their bytes or the files' number
    tasks = 1 + turns.count() // 2000
    dealt = lambda df, into: df.repartition(tasks, "conv_id", "turn").select("conv_id", "turn", text.nfkc(F.col("text")).alias(into))
    pairs = dealt(turns, "x").join(dealt(turns.withColumn("turn", F.col("turn") - 1), "y"), ["conv_id", "turn"])
    scored = pairs.select("conv_id", "turn", F.round(text.sequence_ratio(F.col("x"), F.col("y")), 6).alias("ratio")).where("ratio is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("ratio"), "turn"))
    return scored.withColumn("place", place).where("place <= 3")


@query()
def tracked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes followed from frame to frame (no SQL: greedy choice among what is free)."""
    c = F.struct(((F.col("box.x1") + F.col("box.x2")) / 2).alias("x"), ((F.col("box.y1") + F.col("box.y2")) / 2).alias("y"))
    rows = _boxes(spark, sf_dir).select(F.floor(F.col("frame") / 200).alias("video"), (F.col("frame") % 200).alias("frame"), "item", "area", c.alias("c"))
    return folds.track(rows.select("video", "frame", "item", "area", "c.x", "c.y"), ["video"], far=0.2, memory=3)
