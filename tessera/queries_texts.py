"""Registered queries of text clean-up and JSON documents, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clock, documents, text
from tessera.operators import sequences
from tessera.queries import query
from tessera.session import table

_PUNCTUATION = text.PUNCTUATION


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text is not null")


@query(rf"""SELECT conv_id, turn, replace(replace(lower(regexp_replace(text, '{_PUNCTUATION}', '', 'g')), 'tion', ''), 'la', '') AS plain,
replace(CASE WHEN length(t) > 40 THEN rtrim(substr(t, 1, 37)) || '...' ELSE t END, '|', '\|') AS brief FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL)""")
def brief_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without punctuation and set phrases, and cut for a table."""
    t = F.col("text")
    return _turns(spark, sf_dir).select("conv_id", "turn", text.without_phrases(t, ["la", "tion"]).alias("plain"), text.ellipsis(t, 40).alias("brief"))


_PAIR = "p AS (SELECT a.conv_id, a.turn, lower(a.text) AS x, lower(b.text) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL)"


def _next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    behind = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("y"))
    return rows.select("conv_id", "turn", F.lower("text").alias("x")).join(behind, ["conv_id", "turn"])


@query(f"""WITH {_PAIR}, n AS (SELECT *, coalesce(list_max(list_filter(range(3, 15), lambda n: length(x) >= n AND len(list_filter(range(1, length(x) - n + 2), lambda i: contains(y, substr(x, i, n)))) > 0)), 0) AS run,
list_max(list_filter(range(3, 17), lambda n: length(x) >= n AND contains(y, substr(x, 1, n)))) AS size FROM p)
SELECT conv_id, turn, CAST(run AS INT) AS run, least(0.28::DOUBLE, run / 50) AS bonus, CAST(size AS INT) AS size, CASE WHEN size IS NOT NULL THEN CAST(instr(y, substr(x, 1, CAST(size AS INT))) AS INT) END AS place FROM n""")
def anchored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest piece of a turn, and its longest prefix, that the next turn holds."""
    rows = _next_turns(spark, sf_dir).withColumn("run", text.common_run(F.col("x"), F.col("y"), least=3, most=14)).withColumn("p", text.prefix_place(F.col("x"), F.col("y")))
    return rows.select("conv_id", "turn", "run", F.least(F.lit(0.28), F.col("run") / 50).alias("bonus"), "p.size", "p.place")


@query("""SELECT conv_id, turn, round((CASE WHEN contains(text, 'thing') THEN 1.0 WHEN contains(text, 'thi') THEN 0.4 ELSE 0 END + CASE WHEN contains(text, 'sch') THEN 1.0 WHEN contains(text, 'sc') THEN 0.4 ELSE 0 END + CASE WHEN contains(text, 'eaux') THEN 1.0 WHEN contains(text, 'ea') THEN 0.4 ELSE 0 END)::DOUBLE / 3, 9) AS score,
CASE WHEN contains(text, 'th') AND contains(text, 'ing') THEN 'english' WHEN contains(text, 'sch') AND contains(text, 'ein') THEN 'german' ELSE text END AS caption FROM conversations WHERE text IS NOT NULL""")
def keyword_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keywords a text holds, wholly or in part, and captions by keyword rules."""
    t = F.col("text")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(text.key_score(t, ["thing", "sch", "eaux"]), 9).alias("score"), text.rewrite_by_keywords(t, [(["th", "ing"], "english"), (["sch", "ein"], "german")]).alias("caption"))


@query(r"""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || CASE WHEN p_partkey % 5 = 0 THEN ' !!' ELSE '' END), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '_' || n END AS slug FROM n""")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names fit for files, numbered where several are alike."""
    rows = table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, " !!").otherwise(""))).alias("s"))
    return sequences.unique_names(rows, "s", "p_partkey", "slug").select("p_partkey", "slug")


@query(r"""WITH l AS (SELECT conv_id, turn, generate_subscripts(q, 1) - 1 AS line, unnest(q) AS t FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS q FROM conversations WHERE text IS NOT NULL))
SELECT conv_id, turn, CAST(line AS INT) AS line, CASE WHEN regexp_matches(t, '^[0-9]') THEN 'digit' WHEN regexp_matches(t, '^\p{Latin}') THEN 'latin' WHEN regexp_matches(t, '^\s') THEN 'space' ELSE 'other' END AS script, regexp_matches(t, '^[、。，．,.!！?？」』）)・…:：;；]') AS bad_start,
array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(t, '[,、]'), lambda x: trim(x)), lambda x: x <> ''))), '/') AS terms FROM l""")
def line_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of texts: script of the first character, bad beginnings, terms between commas."""
    lines = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    t = F.col("t")
    return lines.select("conv_id", "turn", "line", text.script_of(t).alias("script"), text.bad_line_start(t).alias("bad_start"), F.array_join(F.array_sort(text.terms(t)), "/").alias("terms"))


@query("SELECT event_id, unnest([0, 1]) AS place, unnest([event_id % 3600, 90.5 + event_id % 50]) AS s, unnest([event_id % 3600 + 20, 3600 + event_id % 60 + 100.25]) AS e, unnest([event_type, '']) AS reason FROM events")
def config_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges out of free text with comments and lines that aren't ranges."""
    i = F.col("event_id")
    minute = F.concat((F.floor(i % 3600 / 60)).cast("string"), F.lit(":"), F.lpad((i % 3600 % 60).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "events")
    text_of = F.concat(
        F.lit("# ranges\n"), minute, F.lit(" - "), (i % 3600 + 20).cast("string"), F.lit(" | "), F.col("event_type"), F.lit(" # note\nnothing here\n"),
        (i % 50 + 90).cast("string"), F.lit(".5 - 1:0"), F.lpad((i % 60 / 60).cast("int").cast("string"), 1, "0"), F.lit(":"), (i % 60 + 100).cast("string"), F.lit(".25\nx - y | z"),
    )
    found = text.time_ranges(text_of, clock.flexible_seconds)
    return rows.select("event_id", F.posexplode(found).alias("place", "r")).select("event_id", "place", "r.s", "r.e", "r.reason")


# ---------------------------------------------------------------- JSON documents

_SCHEMA = {
    "type": "object", "required": ["id", "clip"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 10},
        "clip": {"type": "object", "required": ["role"], "properties": {"role": {"type": "string", "enum": ["view", "click", "error"]}, "range": {"type": "array", "minItems": 2}}},
        "note": {"type": "string"},
    },
}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    clip = F.struct("event_type", F.when(i % 4 == 1, F.array(i)).when(i % 4 == 2, F.array(i, i + 1)).alias("range"))
    clip = F.struct(clip["event_type"].alias("role"), clip["range"].alias("range"))
    ident = F.when(i % 3 == 0, i.cast("string"))
    whole = F.to_json(F.struct(F.when(i % 5 != 0, clip).alias("clip"), F.when(i % 3 != 0, i).alias("id"), F.when(i % 7 == 0, F.lit("n")).alias("note"), F.when(i % 11 == 0, F.lit(1)).alias("zoom")))
    named = F.when(ident.isNotNull() & (i % 2 == 0), F.regexp_replace(whole, r"^\{", F.concat(F.lit('{"id":"'), ident, F.lit('",')))).otherwise(whole)
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.when(i % 101 == 0, "{broken").otherwise(F.regexp_replace(named, r",\}$", "}")).alias("document"))


@query("""WITH e AS (SELECT event_id AS i, event_type AS t, event_id % 5 <> 0 AS clip FROM events)
SELECT i AS event_id, CASE WHEN i % 101 = 0 THEN '$: not JSON' ELSE concat_ws('; ', CASE WHEN i % 3 = 0 AND i % 2 = 1 THEN '$.id: missing' END, CASE WHEN i % 3 = 0 AND i % 2 = 0 THEN '$.id: not integer' END, CASE WHEN i % 3 <> 0 AND i < 10 THEN '$.id: below 10' END,
CASE WHEN NOT clip THEN '$.clip: missing' END, CASE WHEN clip AND t NOT IN ('view', 'click', 'error') THEN '$.clip.role: not allowed' END, CASE WHEN clip AND i % 4 = 1 THEN '$.clip.range: fewer than 2 items' END, CASE WHEN i % 11 = 0 THEN '$: unexpected zoom' END) END AS errors FROM e""")
def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a nested schema, errors with their paths."""
    return _documents(spark, sf_dir).select("event_id", F.array_join(documents.schema_errors(F.col("document"), _SCHEMA), "; ").alias("errors"))


@query("""SELECT event_id, '{"a":{"list":[' || event_id || ',7,"x"]},"k":' || CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 1 || '}' AS document, sha256('{"k":' || regexp_extract(props, '[0-9]+') || '}') AS print FROM events""")
def patched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties after a JSON-pointer patch, and the fingerprint of what they were."""
    k = F.get_json_object("props", "$.k").cast("long")
    operations = F.concat(F.lit('[{"op":"replace","path":"/k","value":'), (k + 1).cast("string"), F.lit('},{"op":"add","path":"/a","value":{"list":['), F.col("event_id").cast("string"), F.lit(',8],"gone":1}},{"op":"add","path":"/a/list/-","value":"x"},{"op":"replace","path":"/a/list/1","value":7},{"op":"remove","path":"/a/gone"}]'))
    return table(spark, sf_dir, "events").select("event_id", documents.patched(F.col("props"), operations).alias("document"), documents.digest(F.col("props")).alias("print"))


@query("""WITH w AS (SELECT o_custkey AS k, o_orderkey % 4 AS base, o_orderstatus || o_orderkey::VARCHAR AS document FROM orders), s AS (SELECT c_custkey AS k, c_custkey % 4 AS revision, c_name AS document FROM customer), f AS (SELECT s.k, min(w.document) AS d FROM w JOIN s ON s.k = w.k AND w.base = s.revision GROUP BY s.k)
SELECT s.k, s.revision + CASE WHEN d IS NOT NULL THEN 1 ELSE 0 END AS revision, coalesce(d, s.document) AS document, CASE WHEN d IS NOT NULL THEN 1 ELSE 0 END AS accepted FROM s LEFT JOIN f ON f.k = s.k""")
def revision_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes taken only if they start from what is stored."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 4).alias("revision"), F.col("c_name").alias("document"))
    writes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 4).alias("base"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("document"))
    return documents.write_if_current(stored, writes, "k")


@query("""SELECT p_brand, sha256(string_agg(p_type || '|' || p_size || '|' || p_name, chr(10) ORDER BY p_type, p_size, p_name)) AS print, count(*) AS n FROM part GROUP BY p_brand""")
def manifest_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint for all that a manifest lists, in a fixed order."""
    listed = F.array_sort(F.collect_list(F.struct("p_type", "p_size", "p_name")))
    lines = F.transform(listed, lambda x: F.concat_ws("|", x["p_type"], x["p_size"].cast("string"), x["p_name"]))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("print"), F.count("*").alias("n"))


@query("""SELECT p_partkey, CAST(('0x' || substr(sha256(p_name || p_brand), 1, 16))::UHUGEINT AS DECIMAL(20, 0)) AS seed, '| ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' |' AS line FROM part""")
def stable_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds fixed by a text, and rows of a Markdown table."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", documents.seed(F.concat("p_name", "p_brand")).alias("seed"), documents.markdown_table(part, ["p_name", "p_brand", "p_size"]).alias("line"))
