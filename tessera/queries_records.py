"""Registered queries of matching, clean-up of spoken records and summaries, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import intervals, matching, relations
from tessera.queries import HOUR, MINUTE, query
from tessera.queries_plans import DAYS, _LOCAL, _local
from tessera.session import table


@query(f"""WITH {_LOCAL}, p AS (SELECT * FROM iv WHERE event_type = 'error'), a AS (SELECT *, e - s AS len FROM iv WHERE event_type = 'view'),
c AS (SELECT p.user_id, p.event_id, a.event_id AS anchor, abs(a.s - p.s) AS d, a.len, abs(a.s - p.s) + greatest(0, {10 * MINUTE} - a.len) * 0.85::DOUBLE - least(a.len, {45 * MINUTE}) * 0.16::DOUBLE AS score FROM p JOIN a ON a.user_id = p.user_id AND abs(a.s - p.s) <= {12 * HOUR})
SELECT user_id, event_id, arg_min(anchor, struct_pack(s := score, d := d, l := -len, a := anchor)) AS anchor, min(score) AS score FROM c GROUP BY user_id, event_id""")
def scored_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir)
    anchors = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("anchor"), "s", (F.col("e") - F.col("s")).alias("length"))
    return matching.scored_anchor(rows.where("event_type = 'error'").select("user_id", "event_id", "s"), anchors, ["user_id"], "event_id", within=12 * HOUR, wanted=10 * MINUTE, longest=45 * MINUTE)


_GRAMS = "CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) ELSE [] END"


@query(rf"""WITH t AS (SELECT conv_id * 1000 + turn AS id, role, regexp_split_to_array(lower(text), '\s+') AS ws FROM conversations WHERE text IS NOT NULL), g AS (SELECT id, role, {_GRAMS} AS tokens FROM t),
r AS (SELECT id, unnest(tokens) AS t FROM g WHERE role = 'assistant'), l AS (SELECT id, unnest(tokens) AS t FROM g WHERE role = 'user'),
near AS (SELECT DISTINCT l.id AS id, r.id AS other FROM l JOIN r USING (t)),
s AS (SELECT n.id, n.other, len(list_intersect(a.tokens, b.tokens)) / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) AS score FROM near n JOIN g a ON a.id = n.id JOIN g b ON b.id = n.other)
SELECT id, arg_max(other, struct_pack(s := score, o := -other)) AS other, round(max(score), 9) AS score, CASE WHEN max(score) >= 0.05 THEN 'strong' WHEN max(score) >= 0.01 THEN 'usable' ELSE 'weak' END AS class FROM s GROUP BY id""")
def transcript_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the answer that shares the most word runs with it, and how strong that is."""
    # the words are a lambda's variable, so that they are split once and not anew for each run
    runs = F.transform(F.array(F.split(F.lower("text"), r"\s+")), lambda w: F.when(F.size(w) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " ")))).otherwise(F.array().cast("array<string>")))
    rows = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", runs[0].alias("tokens"))
    best = matching.best_match(rows.where("role = 'user'").select("id", "tokens"), rows.where("role = 'assistant'").select("id", "tokens"), "id", "other", "tokens")
    return best.withColumn("score", F.round("score", 9)).withColumn("class", F.when(F.col("score") >= 0.05, "strong").when(F.col("score") >= 0.01, "usable").otherwise("weak"))


_URL_KEYS = r"list_distinct([regexp_replace(url, '[?#].*$', ''), regexp_extract(url, '^https?://([^/]+)', 1), regexp_extract(url, '/([0-9]+)', 1)])"


@query(rf"""WITH k AS (SELECT page_id, unnest({_URL_KEYS}) AS k FROM pages), s AS (SELECT a.page_id, b.page_id AS plan, count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.page_id % 2 = 0 AND b.page_id % 2 = 1 GROUP BY ALL)
SELECT page_id, min(plan) AS plan, arg_min(shared, plan) AS shared FROM s GROUP BY page_id""")
def key_set_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages matched to the first other one that shares its address, host or number."""
    keys = F.array(F.regexp_replace("url", r"[?#].*$", ""), F.regexp_extract("url", r"^https?://([^/]+)", 1), F.regexp_extract("url", r"/([0-9]+)", 1))
    rows = table(spark, sf_dir, "pages").select("page_id", keys.alias("keys"))
    return matching.key_set_match(rows.where("page_id % 2 = 0"), rows.where("page_id % 2 = 1").select(F.col("page_id").alias("plan"), "keys"), "page_id", "plan", "keys")


@query("""WITH t AS (SELECT p_partkey AS id, p_brand AS role, p_name AS path, p_size FROM part WHERE p_partkey % 3 = 0), w AS (SELECT p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 3 END AS id, p_brand AS role, p_name AS path, p_partkey FROM part),
a AS (SELECT id, role, path, min(p_size) AS v FROM t GROUP BY ALL), b AS (SELECT id, min(p_size) AS v FROM t GROUP BY ALL), c AS (SELECT role, path, min(p_size) AS v FROM t GROUP BY ALL)
SELECT w.p_partkey, coalesce(a.v, b.v, c.v) AS p_size, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 END AS rule FROM w LEFT JOIN a ON a.id = w.id AND a.role = w.role AND a.path = w.path LEFT JOIN b ON b.id = w.id LEFT JOIN c ON c.role = w.role AND c.path = w.path""")
def manifest_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value looked up by id, role and path, else by id, else by role and path."""
    part = table(spark, sf_dir, "part")
    there = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("role"), F.col("p_name").alias("path"), "p_size")
    mine = part.select("p_partkey", (F.col("p_partkey") + F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(3)).alias("id"), F.col("p_brand").alias("role"), F.col("p_name").alias("path"))
    return matching.prioritised_lookup(mine, there, [["id", "role", "path"], ["id"], ["role", "path"]], ["p_size"]).select("p_partkey", "p_size", "rule")


@query("""SELECT arg_min(l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_suppkey % 100, o) AS kept, count(*) AS n, substr(string_agg((l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_suppkey % 100)::VARCHAR, ',' ORDER BY o), length(arg_min(l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_suppkey % 100, o)::VARCHAR) + 2) AS dropped
FROM (SELECT *, struct_pack(q := l_quantity, d := l_discount, i := l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_suppkey % 100) AS o FROM lineitem) GROUP BY l_orderkey, l_returnflag""")
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's lines with one flag the first by quantity and discount, and the others listed."""
    ident = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100
    rows = table(spark, sf_dir, "lineitem").withColumn("line", ident)
    return matching.best_of_group(rows, [F.col("l_orderkey"), F.col("l_returnflag")], [F.col("l_quantity"), F.col("l_discount")], "line")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey - l_orderkey % 10 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def without_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose root order isn't a finished one."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return matching.without_roots(lines, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") - F.col("l_orderkey") % 10, "o_orderkey")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn * 4000 AS s, turn * 4000 + coalesce(length(text), 0) AS e FROM conversations),
w AS (SELECT conv_id, turn AS first, 1 AS size, turn AS last, s, e, text FROM t UNION ALL SELECT w.conv_id, w.first, w.size + 1, t.turn, w.s, greatest(w.e, t.e), w.text || ' ' || t.text FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.last + 1 WHERE w.size < 4),
g AS (SELECT *, contains(text, 'tion')::INT + contains(text, 'ing')::INT + contains(text, 'sch')::INT + contains(text, 'ón')::INT + contains(text, 'é')::INT AS score FROM w WHERE e - s <= 13000)
SELECT conv_id, arg_max(first, struct_pack(s := score, f := -first, z := -size)) AS first, arg_max(size, struct_pack(s := score, f := -first, z := -size)) AS size, max(score) AS score FROM g GROUP BY conv_id""")
def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the short run of turns that holds the most of five word parts."""
    s, said = F.col("turn") * 4000, F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text"), s.alias("s"), (s + F.length(said)).alias("e"))
    return matching.best_window(rows, ["conv_id"], "turn", "text", ["tion", "ing", "sch", "ón", "é"], most=4, span=13_000)


@query("""WITH t AS (SELECT conv_id, turn, turn * 1000 AS s, text FROM conversations WHERE text IS NOT NULL), a AS (SELECT conv_id, turn AS anchor, s, substr(text, 1, 3) AS needle FROM t WHERE turn % 2 = 0)
SELECT t.conv_id, t.turn, a.anchor FROM t JOIN a ON a.conv_id = t.conv_id AND abs(t.s - a.s) <= 2000 AND contains(t.text, a.needle)""")
def near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold the beginning of an even turn at most two turns away."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", (F.col("turn") * 1000).alias("s"), "text")
    anchors = rows.where("turn % 2 = 0").select("conv_id", F.col("turn").alias("anchor"), "s", F.substring("text", 1, 3).alias("needle"))
    return matching.near_text(rows, anchors, ["conv_id"], "turn", "text", within=2000)


_SILENCE = f"""{_LOCAL}, sil AS (SELECT user_id, s, e FROM iv WHERE event_type = 'error'),
gone AS (SELECT user_id, CASE WHEN s <= {MINUTE} THEN s WHEN e >= {DAYS - MINUTE} THEN least(e, s + {10 * MINUTE}) ELSE s + {5 * MINUTE} END AS s, CASE WHEN s <= {MINUTE} THEN greatest(s, e - {10 * MINUTE}) WHEN e >= {DAYS - MINUTE} THEN e ELSE e - {5 * MINUTE} END AS e FROM sil WHERE e - s > {10 * MINUTE}),
removal AS (SELECT * FROM gone WHERE e - s > {MINUTE}),
reach AS (SELECT user_id, s, e, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM removal),
keep AS (SELECT user_id, upto AS s, s AS e FROM reach WHERE s - upto >= {MINUTE} UNION ALL SELECT user_id, max(e), {DAYS} FROM removal GROUP BY user_id HAVING {DAYS} - max(e) >= {MINUTE})"""


@query(f"WITH {_SILENCE} SELECT 'removal' AS kind, user_id, s, e FROM removal UNION ALL SELECT 'keep', user_id, s, e FROM keep")
def silence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut out of silences, and what is kept from the beginning to the end."""
    removal = matching.removal_ranges(_local(spark, sf_dir).where("event_type = 'error'"), ["user_id"], duration=DAYS, keep=10 * MINUTE, edge=MINUTE)
    keep = intervals.interval_complement(removal, ["user_id"], min_len=MINUTE, within=(0, DAYS))
    return removal.select(F.lit("removal").alias("kind"), "user_id", "s", "e").union(keep.select(F.lit("keep").alias("kind"), "user_id", "s", "e"))


@query(f"""WITH {_SILENCE}, o AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keep),
h AS (SELECT i.user_id, i.event_id, greatest(i.s, o.s) AS s, least(i.e, o.e) AS e, o.s AS rs, o.before FROM iv i JOIN o ON o.user_id = i.user_id AND i.s < o.e AND o.s < i.e WHERE i.e > i.s)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_id ORDER BY rs) - 1 AS piece, CAST(s - rs + before AS BIGINT) AS s, CAST(e - rs + before AS BIGINT) AS e FROM h""")
def remapped_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the clock of what is kept, cut where it is."""
    rows = _local(spark, sf_dir)
    removal = matching.removal_ranges(rows.where("event_type = 'error'"), ["user_id"], duration=DAYS, keep=10 * MINUTE, edge=MINUTE)
    keep = intervals.interval_complement(removal, ["user_id"], min_len=MINUTE, within=(0, DAYS))
    return matching.remap_ranges(rows, keep, ["user_id"], "event_id")


@query("""WITH a AS (SELECT o_orderpriority AS k, o_orderstatus AS v, 1 AS source FROM orders), b AS (SELECT c_mktsegment, c_name, 2 FROM customer), c AS (SELECT p_type, p_brand, 3 FROM part),
d AS (SELECT upper(o_orderpriority), o_orderstatus, 4 FROM orders) SELECT k, arg_min(v, struct_pack(s := source, v := v)) AS v, min(source) AS source FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d) GROUP BY k""")
def union_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of four sources; the first that has a key decides."""
    orders = table(spark, sf_dir, "orders")
    sources = [
        orders.select(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("v")),
        table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k"), F.col("c_name").alias("v")),
        table(spark, sf_dir, "part").select(F.col("p_type").alias("k"), F.col("p_brand").alias("v")),
        orders.select(F.upper("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("v")),
    ]
    return matching.union_by_priority(sources, "k")


@query("""WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS x FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1), b AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS y FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
c AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(x, lambda v: NOT list_contains(y, v)))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(y, lambda v: NOT list_contains(x, v)))), ',') AS extra,
len(list_filter(range(1, greatest(len(x), len(y)) + 1), lambda i: i <= len(x) AND i <= len(y) AND x[i] <> y[i])) AS moved FROM c""")
def sequence_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of an order's list of parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return matching.compare_sequences(lines.where("l_returnflag <> 'A'"), lines.where("l_returnflag <> 'N'"), ["l_orderkey"], "l_linenumber", "l_partkey")


# ---------------------------------------------------------------- spoken records: checks and labels

_SAID = """said AS (SELECT conv_id, turn, role, text, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t, coalesce(length(text), 0) % 12 AS dur, (coalesce(length(text), 0) % 10) / 10 AS silent, -((coalesce(length(text), 0) % 17) / 10) AS logprob, (coalesce(length(text), 0) % 31) / 10 AS packed FROM conversations)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.length("text"), F.lit(0))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", "text", text.clean(F.coalesce("text", F.lit(""))).alias("t"), (n % 12).alias("dur"), (n % 10 / 10).alias("silent"), (-(n % 17 / 10)).alias("logprob"), (n % 31 / 10).alias("packed"))


@query(f"""WITH {_SAID}, ch AS (SELECT conv_id, turn, i, t[i] AS c FROM (SELECT conv_id, turn, t, unnest(range(1, length(t) + 1)) AS i FROM said)), isl AS (SELECT conv_id, turn, c, i - row_number() OVER (PARTITION BY conv_id, turn, c ORDER BY i) AS k FROM ch),
rep AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, c, k FROM isl GROUP BY ALL HAVING count(*) >= 8))
SELECT conv_id, turn, concat_ws(',', CASE WHEN t = '' THEN 'empty_text' END, CASE WHEN silent >= 0.6 THEN 'high_no_speech' END, CASE WHEN logprob <= -1.0 THEN 'low_avg_logprob' END, CASE WHEN packed >= 2.4 THEN 'high_compression' END,
CASE WHEN dur >= 8 THEN 'long_segment' END, CASE WHEN t <> '' AND dur > 0 AND length(t) / dur >= 18 THEN 'fast_reading' END, CASE WHEN rep.turn IS NOT NULL THEN 'repeated_character' END) AS issues,
NOT (t = '' OR (silent >= 0.6 AND logprob <= -1.0)) AS kept FROM said LEFT JOIN rep USING (conv_id, turn)""")
def caption_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven checks of a spoken segment, and whether it is kept or set aside as heard where nothing was said."""
    t, dur = F.col("t"), F.col("dur")
    rules = [
        (t == "", "empty_text"), (F.col("silent") >= 0.6, "high_no_speech"), (F.col("logprob") <= -1.0, "low_avg_logprob"), (F.col("packed") >= 2.4, "high_compression"),
        (dur >= 8, "long_segment"), ((t != "") & (dur > 0) & (F.length(t) / dur >= 18), "fast_reading"), (t.rlike(r"(.)\1{7,}"), "repeated_character"),
    ]
    aside = (t == "") | ((F.col("silent") >= 0.6) & (F.col("logprob") <= -1.0))
    return _said(spark, sf_dir).select("conv_id", "turn", F.array_join(relations.flags(rules), ",").alias("issues"), (~aside).alias("kept"))


@query(f"""WITH {_SAID} SELECT conv_id, turn, concat_ws('|', CASE WHEN regexp_matches(t, '[aeiou]{{3}}') THEN '[aeiou]{{3}}' END, CASE WHEN contains(t, '(un') THEN '(un' END, CASE WHEN regexp_matches(t, 'tion\\b') THEN 'tion\\b' END, CASE WHEN contains(t, '*la') THEN '*la' END) AS matched FROM said""")
def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a list of patterns a text holds; those that aren't regular expressions are looked for as they stand."""
    hits = text.pattern_hits(F.col("t"), ["[aeiou]{3}", "(un", r"tion\b", "*la"])
    return _said(spark, sf_dir).select("conv_id", "turn", F.array_join(hits, "|").alias("matched"))


@query(f"""WITH {_LOCAL}, b AS (SELECT event_id, user_id, s, value / 4 - 6 AS lr FROM iv)
SELECT event_id, CASE WHEN lr >= 2.0 THEN 'interviewer' WHEN lr <= -2.0 THEN 'onscreen' ELSE 'ambiguous' END AS role, floor(CASE WHEN abs(lr) >= 2.0 THEN least(0.98, 0.62 + abs(lr) / 12) ELSE greatest(0.2, abs(lr) / 2.0) END * 1000 + 0.5) / 1000 AS confidence,
round(20 * log10(greatest(abs(lr), 1e-12)), 6) AS db FROM b""")
def band_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role by two thresholds of a level, how sure that is, and the level in decibels."""
    lr = F.col("value") / 4 - 6
    role = F.when(lr >= 2.0, "interviewer").when(lr <= -2.0, "onscreen").otherwise("ambiguous")
    sure = F.when(F.abs(lr) >= 2.0, F.least(F.lit(0.98), 0.62 + F.abs(lr) / 12)).otherwise(F.greatest(F.lit(0.2), F.abs(lr) / 2.0))
    return table(spark, sf_dir, "events").select("event_id", role.alias("role"), (F.floor(sure * 1000 + 0.5) / 1000).alias("confidence"), F.round(20 * F.log10(F.greatest(F.abs(lr), F.lit(1e-12))), 6).alias("db"))


@query(f"""WITH {_LOCAL}, d AS (SELECT *, CASE WHEN value >= 60 THEN 'onscreen' WHEN value <= 5 THEN 'interviewer' END AS decided FROM iv)
SELECT event_id, user_id, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'onscreen') AS role,
'c' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY s, e, event_id))::VARCHAR, 4, '0') AS number FROM d""")
def carried_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that stay until the next row that decides, and numbered names in order."""
    decided = F.when(F.col("value") >= 60, "onscreen").when(F.col("value") <= 5, "interviewer")
    order = Window.partitionBy("user_id").orderBy("s", "event_id")
    role = F.coalesce(F.last(decided, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit("onscreen"))
    number = F.format_string("c%04d", F.row_number().over(Window.partitionBy("user_id").orderBy("s", "e", "event_id")))
    return _local(spark, sf_dir).select("event_id", "user_id", role.alias("role"), number.alias("number"))


@query("""WITH e AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS wave, max(CASE WHEN event_type = 'click' THEN value END) AS words, max(CASE WHEN event_type = 'error' THEN value END) AS mouth, min(CASE WHEN event_type = 'signup' THEN value END) AS clap, min(CASE WHEN event_type = 'purchase' THEN value END) AS tone FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN wave >= 65 THEN 'waveform' WHEN words >= 40 THEN 'transcript' WHEN mouth >= 35 THEN 'mouth' WHEN wave IS NOT NULL THEN 'waveform' WHEN words IS NOT NULL THEN 'transcript' WHEN mouth IS NOT NULL THEN 'mouth' ELSE 'default' END AS evidence,
coalesce(CASE WHEN wave >= 65 THEN wave WHEN words >= 40 THEN words WHEN mouth >= 35 THEN mouth ELSE coalesce(wave, words, mouth) END, 0) AS score,
CASE WHEN clap IS NOT NULL AND tone IS NOT NULL THEN CASE WHEN abs(clap - tone) <= 5 THEN 'confirmed' ELSE 'conflict' END WHEN clap IS NOT NULL THEN 'clap_only' WHEN tone IS NOT NULL THEN 'waveform_only' ELSE 'unconfirmed' END AS status FROM e""")
def sync_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several kinds of evidence decides, and whether two of them agree."""

    def of(kind: str, f=F.max):
        return f(F.when(F.col("event_type") == kind, F.col("value")))

    found = table(spark, sf_dir, "events").groupBy("user_id").agg(of("view").alias("wave"), of("click").alias("words"), of("error").alias("mouth"), of("signup", F.min).alias("clap"), of("purchase", F.min).alias("tone"))
    kinds = [("waveform", "wave", 65), ("transcript", "words", 40), ("mouth", "mouth", 35)]
    sure = [(F.col(c) >= least, name, c) for name, c, least in kinds]
    there = [(F.col(c).isNotNull(), name, c) for name, c, _ in kinds]
    evidence = relations.first_rule([(when, name) for when, name, _ in [*sure, *there]], "default")
    score = F.coalesce(*(F.when(when, F.col(c)) for when, _, c in [*sure, *there]), F.lit(0.0))
    agree = F.when(F.abs(F.col("clap") - F.col("tone")) <= 5, "confirmed").otherwise("conflict")
    status = F.when(F.col("clap").isNotNull() & F.col("tone").isNotNull(), agree).when(F.col("clap").isNotNull(), "clap_only").when(F.col("tone").isNotNull(), "waveform_only").otherwise("unconfirmed")
    return found.select("user_id", evidence.alias("evidence"), score.alias("score"), status.alias("status"))
