"""Tool-call linking with DataFrame functions only: join by identifier, topological levels, schema checks, canonical JSON.

Calls and results meet in a hash join on (conversation, identifier). A call may refer to results of other calls of
its conversation, as {"$ref": "<identifier>"} anywhere in its arguments; levels follow these references: a call's
level is one more than the highest level it refers to. (level, seq, call_id) is a topological order of a conversation,
and no conversation needs to meet in one task for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialize

#: tool -> argument -> (type, required); types: string, integer, number, boolean, object, array
Schemas = dict[str, dict[str, tuple[str, bool]]]

_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*"}


def argument_types(arguments: Column) -> Column:
    """argument -> type as SQL names it, read once from a JSON string; null for null, broken JSON and JSON that isn't an object."""
    fields = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>")
    return F.transform_values(fields, lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))


def argument_errors(name: Column, types: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call: no_json, unknown_tool, missing:a, type:a, extra:a.

    types: as argument_types gives them; null is no_json. JSON null counts as a missing argument.
    """
    found = F.array(F.lit("unknown_tool"))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_element_at(types, F.lit(field))
            absent = value.isNull() | (value == "VOID")
            missing = F.when(absent, F.lit(f"missing:{field}")) if required else F.lit(None).cast("string")
            checks += [missing, F.when(~absent & ~value.rlike(f"^{_TYPES[kind]}$"), F.lit(f"type:{field}"))]
        extra = F.transform(F.array_except(F.map_keys(types), F.array(*(F.lit(f) for f in fields)).cast("array<string>")), lambda k: F.concat(F.lit("extra:"), k))
        found = F.when(name == tool, F.concat(F.array_compact(F.array(*checks).cast("array<string>")), extra)).otherwise(found)
    return F.array_sort(F.when(types.isNull(), F.array(F.lit("no_json"))).otherwise(found))


#: A reference in JSON without white space whose escapes are those that JSON needs; in a string value its quotes would be escaped
_REFERENCE = r'\{"\$ref":("(?:[^"\\]|\\.)*")\}'


def references(arguments: Column) -> Column:
    """Identifiers that the arguments (JSON) refer to, sorted; escapes are decoded. Null or broken JSON refers to nothing."""
    plain = F.to_json(F.try_parse_json(arguments))
    names = F.transform(F.regexp_extract_all(plain, F.lit(_REFERENCE), 1), lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string"))
    return F.array_sort(F.array_distinct(F.array_compact(names)))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, refs); no row for calls on or behind a cycle.

    References to calls that don't exist don't count. Chains of calls with one reference each are followed by doubling
    jumps, so that a long conversation takes a logarithm of its length in rounds; calls with several references settle
    round by round over what is left.
    """
    key = ["conv_id", "call_id"]
    ids = calls.select(*key)
    edges = calls.select(*key, F.explode("refs").alias("ref"))
    edges = materialize(edges.join(ids.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"]).select(*key, "ref"))
    fan = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("ref").alias("far"))
    hops = materialize(fan.where("n = 1").select(*key, "far", F.lit(1).alias("steps"), F.lit(True).alias("open")))
    before = -1
    while True:
        onward = hops.select("conv_id", F.col("call_id").alias("far"), F.col("far").alias("next"), F.col("steps").alias("more"))
        joined = hops.join(onward, ["conv_id", "far"], "left")
        hops = materialize(joined.select(*key, F.coalesce("next", "far").alias("far"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open")))
        left = hops.where("open").count()
        if left in (0, before):  # what stays open runs in a circle
            break
        before = left
    ended = hops.where("not open").select(*key, "far", "steps")
    several = edges.join(fan.where("n > 1").select(*key), key)
    behind = several.join(ended.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"], "left").select(*key, F.coalesce("far", "ref").alias("ref"), F.coalesce("steps", F.lit(0)).alias("steps"))
    waiting = materialize(behind)
    done = materialize(ids.join(fan.select(*key), key, "left_anti").withColumn("level", F.lit(0)))
    while not waiting.isEmpty():
        seen = waiting.join(done.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"], "left")
        state = seen.groupBy(*key).agg(F.max(F.col("level") + F.col("steps")).alias("top"), F.count_if(F.col("level").isNull()).alias("open"))
        ready = materialize(state.where("open = 0").select(*key, (F.col("top") + 1).alias("level")))
        if ready.isEmpty():
            break
        done = materialize(done.union(ready))
        waiting = materialize(waiting.join(ready.select(*key), key, "left_anti"))
    chained = ended.join(done.withColumnRenamed("call_id", "far"), ["conv_id", "far"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return done.union(chained)


def _first_of_each(rows: DataFrame, columns: list[str], again: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each identifier as struct `one`, the other rows with what is wrong: no_id or `again`)."""
    key = ["conv_id", "call_id"]
    # numbered and written, so that equal rows stay apart
    rows = materialize(rows.select(*key, *columns, F.monotonically_increasing_id().alias("n")))
    first = rows.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct(*columns, "n")).alias("one"))
    others = rows.join(first.select(*key, F.col("one.n").alias("first")), key, "left").where("first is null or n <> first")
    return first, others.withColumn("wrong", F.when(F.col("first").isNull(), "no_id").otherwise(again))


def _linked(rows: DataFrame, level: Column, name: Column, arguments: Column, result: Column) -> DataFrame:
    record = F.struct(F.try_parse_json(arguments).alias("arguments"), "errors", F.col("call_id").alias("id"), level.alias("level"), name.alias("name"), result.alias("result"))
    return rows.select("conv_id", "call_id", level.alias("level"), "seq", (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"), F.to_json(record).alias("record"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """conv_id, call_id, level, seq, valid, errors, record: one row for each call, and one for each result without a call.

    calls: conv_id, call_id, seq, name, arguments (JSON); results: conv_id, call_id, seq, content; other columns are
    ignored. Of several calls (results) with one identifier the first by seq, then by the other columns, is linked; each
    of the others gives a row of its own with the error duplicate_id (duplicate_result), and each row whose conv_id or
    call_id is null one with no_id: these are neither linked nor validated, and have no level. errors of the
    linked, sorted: those of argument_errors, unknown_reference:id, cycle, no_result, orphan_result. record: canonical
    JSON (keys sorted, no white space, absent parts left out) with arguments, errors, id, level, name and result;
    broken arguments are left out. Empty tables give no rows.
    """
    first, more_calls = _first_of_each(calls, ["seq", "name", "arguments"], "duplicate_id")
    calls = first.select("conv_id", "call_id", "one.seq", "one.name", "one.arguments")
    # what is read out of the arguments is written once, so that no later expression parses them again
    calls = calls.withColumn("refs", F.coalesce(references(F.col("arguments")), F.array().cast("array<string>")))
    calls = materialize(calls.withColumn("types", argument_types(F.col("arguments"))))
    first, more_results = _first_of_each(results, ["seq", "content"], "duplicate_result")
    results = first.select("conv_id", "call_id", F.col("one").alias("r"))
    known = calls.select("conv_id", F.col("call_id").alias("ref"))
    unknown = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).join(known, ["conv_id", "ref"], "left_anti")
    unknown = unknown.groupBy("conv_id", "call_id").agg(F.collect_set(F.concat(F.lit("unknown_reference:"), "ref")).alias("unknown"))
    both = calls.withColumn("is_call", F.lit(True)).join(results, ["conv_id", "call_id"], "full_outer").join(levels(calls), ["conv_id", "call_id"], "left").join(unknown, ["conv_id", "call_id"], "left")
    wrong = F.concat(
        argument_errors(F.col("name"), F.col("types"), schemas),
        F.coalesce("unknown", F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(F.col("level").isNull(), F.lit("cycle")), F.when(F.col("r").isNull(), F.lit("no_result")))),
    )
    errors = F.when(F.col("is_call"), F.array_sort(wrong)).otherwise(F.array(F.lit("orphan_result")))
    both = both.withColumn("errors", errors).withColumn("seq", F.coalesce("seq", "r.seq"))
    linked = _linked(both, F.col("level"), F.col("name"), F.col("arguments"), F.col("r.content"))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    more_calls = _linked(more_calls.withColumn("errors", F.array("wrong")), number, F.col("name"), F.col("arguments"), text)
    more_results = _linked(more_results.withColumn("errors", F.array("wrong")), number, text, text, F.col("content"))
    return linked.union(more_calls).union(more_results)


# ---------------------------------------------------------------- conversations as calls

CONVERSATION_TOOLS: Schemas = {
    "open_thread": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)},
    "continue_thread": {"context": ("object", True), "text": ("string", True), "turn": ("integer", True), "words": ("integer", True)},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of turns (conv_id, turn, role, text): user turns ask, the assistant's next turn answers.

    A user turn after the first two refers to the user turn two before it, as the context that it continues.
    """

    def name(turn):
        return F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))

    turn = F.col("turn")
    later = turn >= 2
    context = F.when(later, F.struct(name(turn - 2).alias("$ref")))
    words = F.regexp_count("text", F.lit(WORD))
    arguments = F.to_json(F.struct("turn", words.alias("words"), "text", context.alias("context")))
    tool = F.when(later, F.lit("continue_thread")).otherwise(F.lit("open_thread"))
    key = F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), name(turn))
    calls = turns.where("role = 'user'").select("conv_id", key.alias("call_id"), turn.alias("seq"), tool.alias("name"), arguments.alias("arguments"))
    answered = F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), name(turn - 1))
    results = turns.where("role = 'assistant'").select("conv_id", answered.alias("call_id"), turn.alias("seq"), F.col("text").alias("content"))
    return calls, results
