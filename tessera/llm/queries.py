"""Queries over the given tables for the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann_ivfpq, host_rules, langid_kn, packing, quality_embed, tool_calls, toxicity_fm
from tessera.llm.common import fold
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.ngram_join import similar
from tessera.llm.phrases import collocations
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.whitening import whiten


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, rest: int):
    """Whether a row may not be learned from; a null doc_id is in no fold, has no label, and isn't held out."""
    return F.coalesce(fold("doc_id", modulus) == rest, F.lit(False))


def _scored(docs: DataFrame, held_out) -> DataFrame:
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return docs.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op1_quality_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = quality_embed.fit(docs, labels, "quality", learn=fold("doc_id", 3) != 1)
    return _scored(quality_embed.score(docs, model), _held_out(3, 1))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, 2048, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return host_rules.apply_rules(docs, host=F.col("source"), failed=failed)


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    model = toxicity_fm.fit(docs, labels, "toxic", learn=fold("doc_id", 5) != 0)
    return _scored(toxicity_fm.score(docs, model), _held_out(5, 0))


def op5_langid_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid_kn.fit(docs, learn=fold("doc_id", 4) != 2)
    found = langid_kn.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=400, shared_words=51)
    return found.select("doc_id", *(f"repeats.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=85)


def op8_ann_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_ivfpq.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, top=5)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mix_sources(_read(spark, sf_dir, "documents"), weights=[5, 2, 1])
    return documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots")


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.conversation_calls(_read(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.CONVERSATION_TOOLS)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(_read(spark, sf_dir, "documents"), width=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"), least=30, longest=4, most=2000)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_read(spark, sf_dir, "embeddings"), most=16)


QUERIES = {
    "op1_quality_embed": op1_quality_embed,
    "op2_packing": op2_packing,
    "op3_host_rules": op3_host_rules,
    "op4_toxicity_fm": op4_toxicity_fm,
    "op5_langid_kn": op5_langid_kn,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_ann_ivfpq": op8_ann_ivfpq,
    "op9_mixing": op9_mixing,
    "op10_tool_calls": op10_tool_calls,
    "op11_ngram_join": op11_ngram_join,
    "op12_phrases": op12_phrases,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {}

SQL["op3_host_rules"] = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT rid, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
stats AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM based GROUP BY source),
pooled AS (SELECT sum(n)::DOUBLE AS an, sum(k)::DOUBLE / sum(n) AS mean, count(*)::DOUBLE AS h, sum(k::DOUBLE * k / n) AS sq FROM hosts),
prior AS (SELECT mean, least(1e6, greatest(1.0, mean * (1 - mean) / greatest(sq / an - mean * mean - mean * (1 - mean) * h / an, 1e-9) - 1)) AS weight FROM pooled),
shrunk AS (SELECT source, n + weight AS total, mean, (k + mean * weight) / (n + weight) AS rate FROM hosts, prior),
bad AS (SELECT source, round(rate, 6) AS host_rate, rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 2 * mean AS bad FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept, host_rate
FROM based JOIN bad ON based.source IS NOT DISTINCT FROM bad.source
"""

SQL["op10_tool_calls"] = r"""
WITH RECURSIVE asked AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user'),
level AS (
  SELECT conv_id, turn, 0 AS level FROM asked a WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2 AND a.turn >= 2)
  UNION ALL SELECT a.conv_id, a.turn, l.level + 1 FROM asked a JOIN level l ON l.conv_id = a.conv_id AND l.turn = a.turn - 2),
answer AS (SELECT conv_id, turn - 1 AS turn, turn AS at, text AS content FROM conversations WHERE role = 'assistant'),
linked AS (
  SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.turn, r.turn) AS turn, coalesce(a.turn, r.at) AS seq, a.turn IS NOT NULL AS is_call, a.text, r.content, r.conv_id IS NOT NULL AS answered, l.level,
    p.turn IS NOT NULL AS known
  FROM asked a FULL JOIN answer r ON a.conv_id = r.conv_id AND a.turn = r.turn
  LEFT JOIN level l ON l.conv_id = a.conv_id AND l.turn = a.turn
  LEFT JOIN asked p ON p.conv_id = a.conv_id AND p.turn = a.turn - 2),
judged AS (
  SELECT *, conv_id || '-' || turn AS call_id,
    CASE WHEN NOT is_call THEN ['orphan_result'] ELSE list_sort(list_filter([
      CASE WHEN text IS NULL THEN 'missing:text' END, CASE WHEN text IS NULL THEN 'missing:words' END, CASE WHEN NOT answered THEN 'no_result' END,
      CASE WHEN turn >= 2 AND NOT known THEN 'unknown_reference:' || conv_id || '-' || (turn - 2) END], lambda e: e IS NOT NULL)) END AS wrong
  FROM linked)
SELECT conv_id, call_id, level::INT AS level, seq, len(wrong) = 0 AS valid, array_to_string(wrong, ',') AS errors,
  '{' || CASE WHEN is_call THEN '"arguments":{' || CASE WHEN turn >= 2 THEN '"context":{"$ref":"' || conv_id || '-' || (turn - 2) || '"},' ELSE '' END
      || CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text)::VARCHAR || ',' ELSE '' END || '"turn":' || turn
      || CASE WHEN text IS NOT NULL THEN ',"words":' || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ELSE '' END || '},' ELSE '' END
    || '"errors":[' || array_to_string(list_transform(wrong, lambda e: '"' || e || '"'), ',') || '],"id":"' || call_id || '"'
    || CASE WHEN level IS NOT NULL THEN ',"level":' || level ELSE '' END
    || CASE WHEN is_call THEN ',"name":"' || CASE WHEN turn >= 2 THEN 'continue_thread' ELSE 'open_thread' END || '"' ELSE '' END
    || CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content)::VARCHAR ELSE '' END || '}' AS record
FROM judged
"""

SQL["op6_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
blocks AS (SELECT rid, k, n, substring(h, 1600 * k + 1, 2400) AS b FROM (SELECT rid, h, len(h) // 2 AS n, unnest(range(0, len(h) // 1600 + 1)) AS k FROM d)),
windows AS (SELECT rid, 800 * k + j AS i, md5(substring(b, 2 * j + 1, 800)) AS m FROM (SELECT rid, k, b, unnest(range(0, least(800, n - 399 - 800 * k))) AS j FROM blocks)),
twice AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
hit AS (SELECT rid, i FROM windows WHERE m IN (SELECT m FROM twice)),
marked AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM hit),
spans AS (SELECT rid, min(i) AS s, max(i) + 400 AS e FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM marked) GROUP BY rid, k),
ahead AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM spans),
cut AS (SELECT rid, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS kept, max(e) AS last FROM ahead JOIN d USING (rid) GROUP BY rid),
phrases AS (SELECT rid, i, md5(array_to_string(ws[i:i + 50], chr(10))) AS m FROM (SELECT rid, ws, unnest(range(1, len(ws) - 49)) AS i FROM d)),
known AS (SELECT m FROM phrases GROUP BY m HAVING count(*) > 1),
said AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM phrases WHERE m IN (SELECT m FROM known)),
shared AS (SELECT rid, sum(CASE WHEN p IS NULL OR i - p >= 51 THEN 51 ELSE i - p END) AS n FROM said GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substring(h, 2 * last + 1), h))) AS kept_sha256,
  CAST(coalesce(n, 0) AS BIGINT) AS n_shared_words
FROM d LEFT JOIN cut USING (rid) LEFT JOIN shared USING (rid)
"""

SQL["op7_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, chr(10))] ELSE [] END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS r FROM edges UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.node),
classes AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN classes ON node = w.doc_id
"""

SQL["op12_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
totals AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 30),
inner_ AS (SELECT lang, f, g[i:i + k - 1] AS g FROM (SELECT lang, f, g, k, unnest(range(1, len(g) - k + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS k) WHERE k < len(g))),
longer AS (SELECT lang, g, max(f) AS f FROM inner_ GROUP BY lang, g),
kept AS (SELECT f.lang, f.g, f.f AS a FROM f LEFT JOIN longer o ON o.lang = f.lang AND o.g = f.g WHERE len(f.g) > 1 AND (o.f IS NULL OR 100 * o.f < 80 * f.f)),
cuts AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM kept) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]),
best AS (SELECT lang, g, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT r.lang, row_number() OVER (PARTITION BY r.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r.r, t.n::BIGINT AS n, score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang)
WHERE rank <= 2000
"""

SQL["op11_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], chr(10))) WHEN len(ws) > 0 THEN [array_to_string(ws, chr(10))] ELSE [] END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS r FROM edges UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.node),
classes AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN classes ON node = w.doc_id
"""
