"""Registered queries of retiming, line breaking, synchronisation and long signals, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lines, spectra, text
from tessera.operators import intervals
from tessera.plans import retiming, sync
from tessera.queries import HOUR, _IV, event_intervals, query
from tessera.session import table

# ---------------------------------------------------------------- captions on the words that are spoken

_P = text.PUNCTUATION
_SPOKEN = rf"""ws AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '{_P}', '', 'g')) AS ws FROM conversations WHERE text IS NOT NULL),
words AS (SELECT conv_id, turn * 60000000 + (i - 1) * 200000 AS t, turn * 100000 + i AS n, ws[i] AS word FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM ws)),
placed AS (SELECT *, length(word) AS len, coalesce(sum(length(word)) OVER (PARTITION BY conv_id ORDER BY t, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS pos FROM words),
stream AS (SELECT conv_id, string_agg(word, '' ORDER BY t, n) AS st FROM words GROUP BY conv_id),
caps AS (SELECT conv_id, turn * 2 + k AS ident, turn % 2 AS role, turn * 60000000 + k * 2000000 AS s, turn * 60000000 + k * 2000000 + 1500000 AS e,
  CASE WHEN (turn * 2 + k) % 7 = 0 THEN 'zzzz' ELSE array_to_string(ws[4 + turn % 5 + CASE WHEN turn % 3 > 0 THEN 6 * k ELSE 0 END:9 + turn % 5 + CASE WHEN turn % 3 > 0 THEN 6 * k ELSE 0 END], '') END AS x FROM ws, (SELECT unnest([0, 1]) AS k))"""


def _captions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two captions a turn out of its words, too early for when they are spoken, and all the words."""
    split = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.transform(split, text.normalized).alias("ws"))
    words = rows.select("conv_id", "turn", F.posexplode("ws").alias("i", "word"))
    words = words.select("conv_id", (F.col("turn") * 60_000_000 + F.col("i") * 200_000).alias("t"), (F.col("turn") * 100_000 + F.col("i")).alias("n"), "word")
    two = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    ident, at = F.col("turn") * 2 + F.col("k"), F.col("turn") * 60_000_000 + F.col("k") * 2_000_000
    begin = 4 + F.col("turn") % 5 + F.when(F.col("turn") % 3 > 0, 6 * F.col("k")).otherwise(0)
    said = F.when(ident % 7 == 0, "zzzz").otherwise(F.array_join(F.slice("ws", begin.cast("int"), F.lit(6)), ""))
    return two.select("conv_id", ident.alias("ident"), (F.col("turn") % 2).alias("role"), at.alias("s"), (at + 1_500_000).alias("e"), said.alias("x"), F.array(said).alias("texts")), words


_MATCHED = f"""{_SPOKEN}, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, ident) AS k FROM (
    SELECT caps.conv_id, ident, s, e, x, coalesce(sum(len) FILTER (WHERE t < s - 350000), 0) + 1 AS low, coalesce(sum(len) FILTER (WHERE t < e + 8000000), 0) AS high, coalesce(sum(len) FILTER (WHERE t < e - 100000), 0) AS lim
    FROM caps LEFT JOIN placed ON placed.conv_id = caps.conv_id GROUP BY caps.conv_id, ident, s, e, x)),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 1::BIGINT AS cursor, NULL::BIGINT AS found, NULL::BIGINT AS size FROM c
  UNION ALL SELECT conv_id, k, CASE WHEN size IS NULL THEN cursor ELSE from_ - 1 + strpos(win, substr(x, 1, size)) + size END, from_ - 1 + strpos(win, substr(x, 1, size)), size FROM (
    SELECT *, list_max(list_filter(range(3, least(16, length(x)) + 1), lambda n: strpos(win, substr(x, 1, n)) > 0 AND from_ - 1 + strpos(win, substr(x, 1, n)) <= lim)) AS size FROM (
      SELECT c.conv_id, c.k, c.x, c.lim, f.cursor, greatest(c.low, f.cursor) AS from_, substr(st, greatest(c.low, f.cursor)::BIGINT, greatest(0, c.high - greatest(c.low, f.cursor) + 1)::BIGINT) AS win FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1 JOIN stream ON stream.conv_id = c.conv_id))),
m AS (SELECT c.conv_id, c.ident, f.size, f.found, max(p.t)::BIGINT AS spoken FROM c JOIN f ON f.conv_id = c.conv_id AND f.k = c.k LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.pos <= f.found AND p.len > 0 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_MATCHED} SELECT conv_id, ident, spoken, size::INT AS size, found::BIGINT AS place FROM m")
def spoken_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each caption's words are spoken; the next search begins where the last match ended."""
    captions, words = _captions(spark, sf_dir)
    return retiming.spoken_starts(captions, words, ["conv_id"], "ident")


def _held(source: str, ident: str) -> str:
    return f"""SELECT * EXCLUDE (e, following), greatest(s + 250000, CASE WHEN following IS NULL THEN greatest(e + 250000, s + 1350000) ELSE least(greatest(e + 250000, s + 1350000), greatest(s + 250000, following - 40000)) END) AS e
      FROM (SELECT *, lead(s) OVER (PARTITION BY conv_id ORDER BY s, e, {ident}) AS following FROM {source})"""


@query(f"""WITH RECURSIVE {_MATCHED},
w AS (SELECT caps.*, CASE WHEN spoken IS NULL THEN NULL WHEN spoken - s >= 700000 AND greatest(spoken - 350000 - s, 0) >= 50000 THEN greatest(spoken - 350000 - s, 0) ELSE 0 END AS mv FROM caps JOIN m USING (conv_id, ident)),
g AS (SELECT *, last_value(CASE WHEN mv IS NOT NULL THEN struct_pack(s := s, m := mv) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY s, e, ident ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(CASE WHEN mv IS NOT NULL THEN struct_pack(s := s, m := mv) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY s, e, ident ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM w),
moved AS (SELECT conv_id, ident, role, x, e, s + coalesce(mv, a.m + CASE WHEN z.s - a.s > 0 THEN floor((z.m - a.m) * (s - a.s) / (z.s - a.s))::BIGINT ELSE 0 END, 0) AS s FROM g),
h AS ({_held("moved", "ident")}), o AS (SELECT *, length(x) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, ident) AS i FROM h),
j AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, -1 AS place, NULL::BIGINT AS s, NULL::BIGINT AS e, NULL::BIGINT AS role, '' AS x, 0::BIGINT AS size, 0 AS n FROM o
  UNION ALL SELECT conv_id, i, CASE WHEN fits THEN place ELSE place + 1 END, CASE WHEN fits THEN s ELSE os END, CASE WHEN fits THEN greatest(e, oe) ELSE oe END, orole, CASE WHEN fits THEN x || ox ELSE ox END, CASE WHEN fits THEN size + osize ELSE osize END, CASE WHEN fits THEN n + 1 ELSE 1 END FROM (
    SELECT j.*, o.i AS oi, o.s AS os, o.e AS oe, o.role AS orole, o.x AS ox, o.size AS osize,
      coalesce(j.role = o.role AND o.s - j.e <= 350000 AND j.size + o.size <= 52 AND o.e - j.s <= 8500000 AND (j.e - j.s < 1650000 OR j.size <= 18 OR o.e - o.s < 1650000 OR o.size <= 18 OR o.s - j.e <= 120000), false) AS fits
    FROM j JOIN o ON o.conv_id = j.conv_id AND o.i = j.i + 1) AS q(conv_id, pi, place, s, e, role, x, size, n, i, os, oe, orole, ox, osize, fits)),
k AS (SELECT conv_id, place, arg_max(s, i) AS s, arg_max(e, i) AS e, arg_max(role, i) AS role, arg_max(x, i) AS x, arg_max(n, i) AS n FROM j WHERE place >= 0 GROUP BY conv_id, place)
SELECT conv_id, place, s, e, role, x AS text, n FROM ({_held("k", "place")})""")
def retimed_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions begun when they are spoken, those not found in between, held to be read, short ones joined and held again."""
    captions, words = _captions(spark, sf_dir)
    found = captions.join(retiming.spoken_starts(captions, words, ["conv_id"], "ident").select("conv_id", "ident", "spoken"), ["conv_id", "ident"])
    held = retiming.held_to_read(retiming.moved_starts(found, ["conv_id"], "ident"), ["conv_id"], "ident")
    joined = retiming.joined_short(held.select("conv_id", "ident", "s", "e", "role", F.col("x").alias("text"), F.length("x").alias("size")), ["conv_id"])
    return retiming.held_to_read(joined, ["conv_id"], "place").select("conv_id", "place", "s", "e", "role", "text", "n")


@query(f"""WITH {_IV}, c AS (SELECT user_id, event_id, s // {24 * HOUR} AS block, floor(value)::BIGINT AS weight FROM iv), b AS (SELECT user_id, s // {24 * HOUR} AS block, min(s) AS bs, max(e) AS be FROM iv WHERE event_type <> 'error' AND e > s GROUP BY ALL),
k AS (SELECT c.user_id, event_id, bs, be, count(*) OVER w AS n, row_number() OVER (w ORDER BY event_id) AS k, sum(weight) OVER w AS everything, sum(weight) OVER (w ORDER BY event_id) AS upto, weight FROM c LEFT JOIN b ON b.user_id = c.user_id AND b.block = c.block WINDOW w AS (PARTITION BY c.user_id, c.block)),
f AS (SELECT *, least({HOUR}, (be - bs) // n) AS least_, be - bs - n * least({HOUR}, (be - bs) // n) AS rest FROM k)
SELECT user_id, event_id, (bs + least_ * (k - 1) + CASE WHEN everything > 0 THEN floor(rest * (upto - weight)::DOUBLE / everything) ELSE floor(rest * (k - 1)::DOUBLE / n) END)::BIGINT AS s, (bs + least_ * k + CASE WHEN everything > 0 THEN floor(rest * upto::DOUBLE / everything) ELSE floor(rest * k::DOUBLE / n) END)::BIGINT AS e FROM f""")
def speech_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's events laid side by side into the time that the others of the day span, an hour each at least, the rest by weight."""
    rows = event_intervals(spark, sf_dir).withColumn("block", F.floor(F.col("s") / (24 * HOUR)))
    captions = rows.select("user_id", "block", "event_id", F.floor("value").alias("weight"))
    return retiming.speech_slots(captions, rows.where("event_type <> 'error'").select("user_id", "block", "s", "e"), ["user_id"], "event_id", least=HOUR)


@query(r"""WITH RECURSIVE o AS (SELECT conv_id, turn * 1000 AS s, turn * 1000 + 900 AS e, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
j AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, -1 AS place, NULL::BIGINT AS s, NULL::BIGINT AS e, '' AS x, 0 AS n FROM o
  UNION ALL SELECT conv_id, oi, CASE WHEN fits THEN place ELSE place + 1 END, CASE WHEN fits THEN s ELSE os END, CASE WHEN fits THEN greatest(e, oe) ELSE oe END, CASE WHEN fits THEN joined ELSE ox END, CASE WHEN fits THEN n + 1 ELSE 1 END FROM (
    SELECT *, coalesce(place >= 0 AND (regexp_matches(ox, '^(?:[aeiou]|th)') OR regexp_matches(x, '(?:[st]|on)\.?$') OR ox = '') AND os - e <= 500 AND length(joined) <= 4000, false) AS fits FROM (
      SELECT j.conv_id, o.i AS oi, j.place, j.s, j.e, j.x, j.n, o.s AS os, o.e AS oe, o.x AS ox, j.x || CASE WHEN j.x = '' OR o.x = '' THEN '' ELSE ' ' END || o.x AS joined FROM j JOIN o ON o.conv_id = j.conv_id AND o.i = j.i + 1)))
SELECT conv_id, place, s, arg_max(e, i) AS e, arg_max(x, i) AS text, arg_max(n, i) AS n FROM j WHERE place >= 0 GROUP BY conv_id, place, s""")
def dependent_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that begin with what can't begin one, or follow one that ends so, joined with the one before."""
    at = F.col("turn") * 1000
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ident"), at.alias("s"), (at + 900).alias("e"), text.clean(F.coalesce("text", F.lit(""))).alias("text"))
    return retiming.joined_dependent(rows, ["conv_id"], leading="[aeiou]|th", dangling=r"(?:[st]|on)\.?", gap=500, chars=4000)


# ---------------------------------------------------------------- lines

_NO_START = lines.BreakRules().no_start
_GOOD_END = lines.BreakRules().good_end


def _share(k: int, names: list[str]) -> str:
    even = " + ".join(f"10 * (length({x}) * {k} - n) * (length({x}) * {k} - n)" for x in names)
    return f"{even} + CASE WHEN n >= {4 * k} THEN 8000 * ({' + '.join(f'greatest(0, 4 - length({x}))' for x in names)}) ELSE 0 END"


@query(rf"""WITH s AS (SELECT conv_id, turn, generate_subscripts(q, 1) - 1 AS place, trim(regexp_replace(unnest(q), '\s+', ' ', 'g')) AS x FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.!?\n]') AS q FROM conversations WHERE text IS NOT NULL)),
t AS (SELECT *, length(x) AS n FROM s), b AS (SELECT *, 8000 - CASE WHEN contains('{_GOOD_END}', substr(x, i, 1)) THEN 8000 ELSE 0 END + CASE WHEN regexp_matches(substr(x, i, 2), '^[\p{{L}}\p{{N}}]{{2}}$') THEN 9000000 ELSE 0 END AS cost
  FROM (SELECT *, unnest(range(1, n)) AS i FROM t WHERE n BETWEEN 43 AND 128) WHERE NOT contains('{_NO_START}', substr(x, i + 1, 1))),
two AS (SELECT conv_id, turn, place, arg_min(l1 || '|' || l2, struct_pack(c := c, i := i)) AS lines FROM (SELECT *, cost + {_share(2, ["l1", "l2"])} AS c FROM (SELECT *, trim(substr(x, 1, i)) AS l1, trim(substr(x, i + 1)) AS l2 FROM b)
  WHERE length(l1) BETWEEN 1 AND 42 AND length(l2) BETWEEN 1 AND 42) GROUP BY ALL),
three AS (SELECT conv_id, turn, place, arg_min(l1 || '|' || l2 || '|' || l3, struct_pack(c := c, j := j, i := i)) AS lines FROM (SELECT *, cost + cost2 + {_share(3, ["l1", "l2", "l3"])} AS c FROM (
    SELECT a.*, z.i AS j, z.cost AS cost2, trim(substr(a.x, 1, a.i)) AS l1, trim(substr(a.x, a.i + 1, z.i - a.i)) AS l2, trim(substr(a.x, z.i + 1)) AS l3 FROM b a JOIN b z ON z.conv_id = a.conv_id AND z.turn = a.turn AND z.place = a.place AND z.i > a.i AND z.i <= a.i + 44 AND a.i <= 44)
  WHERE length(l1) BETWEEN 1 AND 42 AND length(l2) BETWEEN 1 AND 42 AND length(l3) BETWEEN 1 AND 42) GROUP BY ALL)
SELECT t.conv_id, t.turn, t.place::INT AS place, CASE WHEN n <= 42 THEN x ELSE coalesce(two.lines, three.lines) END AS lines FROM t LEFT JOIN two ON two.conv_id = t.conv_id AND two.turn = t.turn AND two.place = t.place LEFT JOIN three ON three.conv_id = t.conv_id AND three.turn = t.turn AND three.place = t.place""")
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences on one to three lines of at most 42 characters, cut where it costs least."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.posexplode(F.split("text", r"[.!?\n]")).alias("place", "x"))
    return rows.select("conv_id", "turn", "place", F.array_join(lines.break_lines(text.clean(F.col("x")), 42), "|").alias("lines"))


# ---------------------------------------------------------------- many sources on one clock

_CLOCK = """m AS (SELECT user_id, event_type AS b, lag(event_type) OVER w AS a, (floor(value) - lag(floor(value)) OVER w)::BIGINT * 1000000 AS off, event_id % 1000 AS score FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pairs AS (SELECT user_id, a, b, off, score FROM m WHERE a <> b AND off IS NOT NULL), half AS (SELECT user_id, least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a > b THEN -off ELSE off END AS off, score FROM pairs),
one AS (SELECT user_id, a, b, arg_min(off, struct_pack(s := -score, o := off)) AS off, max(score) AS score FROM half GROUP BY user_id, a, b), edges AS (SELECT user_id, a, b, off, 1001 - score AS doubt FROM one UNION ALL SELECT user_id, b, a, -off, 1001 - score FROM one),
src AS (SELECT user_id, event_type AS source, count(*) * 60000000 AS length FROM events GROUP BY ALL), ref AS (SELECT user_id, arg_min(source, struct_pack(r := source <> 'view', s := source)) AS source FROM src GROUP BY user_id),
p AS (SELECT user_id, source, 0::BIGINT AS doubt, 0 AS hops, [source] AS path, 0::BIGINT AS off FROM ref UNION ALL SELECT p.user_id, e.b, p.doubt + e.doubt, p.hops + 1, list_append(p.path, e.b), p.off + e.off FROM p JOIN edges e ON e.user_id = p.user_id AND e.a = p.source WHERE NOT list_contains(p.path, e.b)),
best AS (SELECT user_id, source, min(struct_pack(d := doubt, h := hops, p := path, o := off)) AS m FROM p GROUP BY user_id, source), clock AS (SELECT src.user_id, src.source, length, m.o AS off, m.h AS hops, m.d AS doubt FROM src LEFT JOIN best ON best.user_id = src.user_id AND best.source = src.source)"""


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Offsets between kinds of events as they follow one another, and the kinds themselves as sources."""
    from pyspark.sql.window import Window

    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    off = (F.floor("value") - F.lag(F.floor("value")).over(order)) * 1_000_000
    pairs = events.select("user_id", F.lag("event_type").over(order).alias("a"), F.col("event_type").alias("b"), off.alias("offset"), (F.col("event_id") % 1000).alias("score")).where("a <> b")
    sources = events.groupBy("user_id", F.col("event_type").alias("source")).agg((F.count("*") * 60_000_000).alias("length")).withColumn("reference", F.col("source") == "view")
    return pairs, sources


@query(f"WITH RECURSIVE {_CLOCK} SELECT user_id, source, off AS offset, hops, doubt FROM clock")
def common_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's offset against its user's reference, along the surest chain of measurements."""
    return sync.common_clock(*_measured(spark, sf_dir), ["user_id"])


@query(f"WITH RECURSIVE {_CLOCK} SELECT pairs.user_id, a, b, pairs.off AS offset, score, pairs.off - (y.off - x.off) AS off FROM pairs JOIN clock x ON x.user_id = pairs.user_id AND x.source = a JOIN clock y ON y.user_id = pairs.user_id AND y.source = b WHERE abs(pairs.off - (y.off - x.off)) > 10000000")
def clock_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements that contradict the common clock."""
    pairs, sources = _measured(spark, sf_dir)
    return sync.clock_conflicts(pairs, sync.common_clock(pairs, sources, ["user_id"]), ["user_id"], slack=10_000_000)


@query(f"""WITH RECURSIVE {_CLOCK}, r AS (SELECT user_id, source, -off AS s, length - off AS e FROM clock WHERE off IS NOT NULL AND length > 0), pts AS (SELECT DISTINCT user_id, unnest([s, e]) AS s FROM r), atoms AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS e FROM pts)
SELECT a.user_id, a.s, a.e, string_agg(source, ',' ORDER BY source) AS roles FROM atoms a JOIN r ON r.user_id = a.user_id AND r.s <= a.s AND r.e >= a.e GROUP BY ALL HAVING count(*) >= 2""")
def synced_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of the common clock in which two sources or more run."""
    pairs, sources = _measured(spark, sf_dir)
    ranges = sync.synced_ranges(sources, sync.common_clock(pairs, sources, ["user_id"]), ["user_id"])
    return intervals.sweep(ranges, ["user_id"], "source")


# ---------------------------------------------------------------- long signals


def _signals(spark: SparkSession, sf_dir: str, shift) -> tuple[DataFrame, DataFrame]:
    """A kind's values by event number, and the same moved."""
    v = F.floor("value") - 50
    rows = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("i"), v.alias("x"))
    return rows, rows.select("event_type", (F.col("i") + shift(rows)).alias("i"), F.col("x").alias("y"))


_LAGS = "l AS (SELECT event_type, event_id AS i, floor(value)::BIGINT - 50 AS x FROM events), r AS (SELECT event_type, event_id + 3 * length(event_type) AS i, {sign}(floor(value)::BIGINT - 50) AS y FROM events), t AS (SELECT l.event_type, r.i - l.i AS lag, sum(x * y)::BIGINT AS total FROM l JOIN r ON r.event_type = l.event_type AND r.i BETWEEN l.i - 60 AND l.i + 60 GROUP BY ALL)"


@query(f"WITH {_LAGS.format(sign='')}, g AS (SELECT event_type, unnest(range(-60, 61)) AS lag FROM (SELECT DISTINCT event_type FROM events)) SELECT g.event_type, g.lag, coalesce(total, 0) AS total FROM g LEFT JOIN t ON t.event_type = g.event_type AND t.lag = g.lag")
def lag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a signal and its moved copy, summed for every lag up to 60."""
    left, right = _signals(spark, sf_dir, lambda _: 3 * F.length("event_type"))
    return spectra.lag_sums(left, right, ["event_type"], lags=(-60, 60))


@query(f"WITH {_LAGS.format(sign='-')} SELECT event_type, arg_min(lag, struct_pack(t := -abs(total), d := abs(lag), l := lag)) AS lag, arg_min(total, struct_pack(t := -abs(total), d := abs(lag), l := lag)) AS total FROM t GROUP BY event_type")
def signless_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of the largest sum whatever its sign, of a signal and its moved and inverted copy."""
    left, right = _signals(spark, sf_dir, lambda _: 3 * F.length("event_type"))
    return spectra.best_lags(spectra.lag_sums(left, right.withColumn("y", -F.col("y")), ["event_type"], lags=(-60, 60)), ["event_type"], signless=True)


@query("""WITH l AS (SELECT event_type, event_id AS i, event_id // 2000 AS part, floor(value)::BIGINT - 50 AS x FROM events), r AS (SELECT event_type, event_id + event_id // 500 AS i, floor(value)::BIGINT - 50 AS y FROM events),
g AS (SELECT l.event_type, part, r.i - l.i AS lag, sum(x * y) AS total FROM l JOIN r ON r.event_type = l.event_type AND r.i BETWEEN l.i AND l.i + 256 GROUP BY ALL), b AS (SELECT event_type, part, arg_min(lag, struct_pack(t := -total, d := abs(lag), l := lag)) AS lag FROM g GROUP BY event_type, part),
k AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY part) AS k FROM b), s AS (SELECT x.event_type, quantile_cont((y.lag - x.lag) / ((y.part - x.part) * 2000), 0.5) AS slope FROM k x JOIN k y ON y.event_type = x.event_type AND y.k = x.k + x.n // 2 AND y.part > x.part WHERE x.n > 1 GROUP BY 1),
q AS (SELECT k.event_type, slope, lag - coalesce(slope, 0) * part * 2000 AS r FROM k LEFT JOIN s ON s.event_type = k.event_type), z AS (SELECT event_type, quantile_cont(r, 0.5) AS start, count(*) AS n FROM q GROUP BY 1)
SELECT q.event_type, round(slope, 9) AS slope, round(start, 6) AS start, n, round(quantile_cont(abs(r - start), 0.5), 6) AS off FROM q JOIN z ON z.event_type = q.event_type GROUP BY q.event_type, slope, start, n""")
def lag_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line through the lags of stretches by themselves, of a signal and its copy that runs slower."""
    left, right = _signals(spark, sf_dir, lambda rows: F.floor(F.col("i") / 500))
    probes = spectra.local_lags(left, right, ["event_type"], window=2000, lags=(0, 256))
    return spectra.drift(probes, ["event_type"], window=2000).select("event_type", F.round("slope", 9).alias("slope"), F.round("start", 6).alias("start"), "n", F.round("off", 6).alias("off"))


@query(f"""WITH {_IV}, f AS (SELECT user_id, event_id, s, e, value AS v, (event_id % 97)::DOUBLE AS w, CASE WHEN event_id % 5 = 0 THEN CASE WHEN value >= 50 THEN 'interviewer' ELSE 'onscreen' END END AS known FROM iv),
z AS (SELECT *, CASE WHEN stddev_pop(v) OVER p > 1e-12 THEN (v - avg(v) OVER p) / stddev_pop(v) OVER p ELSE 0 END AS zv, CASE WHEN stddev_pop(w) OVER p > 1e-12 THEN (w - avg(w) OVER p) / stddev_pop(w) OVER p ELSE 0 END AS zw FROM f WINDOW p AS (PARTITION BY user_id)),
m AS (SELECT user_id, known AS role, avg(zv) AS mv, avg(zw) AS mw FROM z WHERE known IS NOT NULL GROUP BY ALL), d AS (SELECT z.user_id, event_id, s, e, known, m.role, round(sqrt((zv - mv) * (zv - mv) + (zw - mw) * (zw - mw)), 9) AS d FROM z JOIN m ON m.user_id = z.user_id),
n AS (SELECT user_id, event_id, s, e, known, list(struct_pack(d := d, role := role) ORDER BY d, role) AS d FROM d GROUP BY ALL),
c AS (SELECT *, coalesce(known, d[1].role) AS r, CASE WHEN known IS NOT NULL THEN 1.0 WHEN len(d) < 2 THEN 1.0 WHEN d[1].d + d[2].d = 0 THEN 0.5 ELSE round(1 - d[1].d / (d[1].d + d[2].d), 6) END::DOUBLE AS confidence FROM n),
o AS (SELECT *, lag(r) OVER q AS before, lead(r) OVER q AS behind FROM c WINDOW q AS (PARTITION BY user_id ORDER BY s, e, event_id)), a AS (SELECT *, coalesce(confidence < 0.6 AND before = behind AND before <> r AND known IS NULL, false) AS agree FROM o)
SELECT user_id, event_id, CASE WHEN agree THEN before ELSE r END AS role, confidence, CASE WHEN known IS NOT NULL THEN 'anchor' WHEN agree THEN 'neighbours' WHEN confidence < 0.65 THEN 'ambiguous' ELSE 'profile' END AS reason FROM a""")
def speaker_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by profiles of what is known, smoothed where they are unsure."""
    rows = event_intervals(spark, sf_dir)
    features = rows.select("user_id", "event_id", "s", "e", "value", (F.col("event_id") % 97).cast("double").alias("w"))
    anchors = rows.where("event_id % 5 = 0").select("user_id", "event_id", F.when(F.col("value") >= 50, "interviewer").otherwise("onscreen").alias("role"))
    return spectra.speaker_roles(features, ["user_id"], "event_id", ["value", "w"], anchors, sure=0.65, smooth=0.6)
