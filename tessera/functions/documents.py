"""JSON documents as columns: canonical text, fingerprints, schema errors with paths, pointer patches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str, *, strict: bool = True) -> DataFrame:
    """JSON documents, one a file, with their `path`; a broken one fails the read, or has nulls and its text in `broken` if not strict."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("multiLine", True)
    if strict:
        return reader.schema(shape).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_path").alias("path"))
    with_broken = StructType([*shape.fields, *StructType.fromDDL("broken string").fields])
    return reader.schema(with_broken).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path).select("*", F.col("_metadata.file_path").alias("path"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, size, modified, signature of all files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).drop("content")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    signature = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), signature.alias("signature"))


def canonical(x: Column) -> Column:
    """JSON text with keys sorted at every level and no white space; null for text that isn't JSON."""
    return F.to_json(F.try_parse_json(x))


def digest(x: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical(x), 256)


def seed(x: Column) -> Column:
    """A whole number of 64 bits fixed by a text: the first 16 hex digits of its SHA-256."""
    h = F.sha2(x, 256)
    return sum((F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") * F.lit(1 << (32 - 32 * i)).cast("decimal(20,0)") for i in range(2)), F.lit(0).cast("decimal(20,0)")).cast("decimal(20,0)")


_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*"}


def schema_errors(x: Column, schema: dict, path: str = "$") -> Column:
    """Array of errors `path: what` of a JSON text against a schema of nested dicts, compiled into one expression.

    Understood: type, required, properties, additionalProperties (false), items, enum, const, minimum, maximum, pattern, format (date-time, date, uri),
    minItems, maxItems, and $ref to a place in the same schema (`#/...`) that doesn't lead back to itself. Unreadable text
    gives `$: not JSON`. What lies inside a value of the wrong type isn't judged.
    """

    def judged(value: Column) -> Column:
        return F.when(value.isNull(), F.array(F.lit("$: not JSON"))).otherwise(_joined(_checks(value, schema, path, schema, ())))

    # a lambda's variable, so that each text is parsed once however many checks there are
    return F.element_at(F.transform(F.array(F.try_parse_json(x)), judged), 1)


_FORMATS = {"date-time": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$", "date": r"^\d{4}-\d{2}-\d{2}$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"}


def _joined(checks: list[tuple[bool, Column]]) -> Column:
    """One array of errors; checks: (whether it is an array of errors, a text or such an array), null where nothing is wrong."""
    none, parts, run = F.array().cast("array<string>"), [], []
    for many, check in [*checks, (True, none)]:
        if not many:
            run.append(check)
            continue
        if run:
            parts.append(F.array_compact(F.array(*run).cast("array<string>")))
            run = []
        parts.append(F.coalesce(check, none))
    return F.concat(*parts)


def _at(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _resolved(schema: dict, whole: dict, seen: tuple) -> tuple[dict, tuple]:
    """The schema that $ref leads to, and all references followed."""
    while "$ref" in schema:
        ref = schema["$ref"]
        if ref in seen or not ref.startswith("#"):
            raise ValueError(f"reference that leads back to itself or out of the schema: {ref}")
        seen, schema = (*seen, ref), whole
        for part in ref.split("/")[1:]:
            schema = schema[part]
    return schema, seen


def _checks(value: Column, schema: dict, path: str, whole: dict, seen: tuple) -> list[tuple[bool, Column]]:
    schema, seen = _resolved(schema, whole, seen)
    own = _at(value, path, "variant")
    there = own.isNotNull() & ~F.is_variant_null(own)
    right = there & F.schema_of_variant(own).rlike(f"^{_KINDS[schema['type']]}$") if "type" in schema else there
    # a lambda's variable, so that a value's kind is found once however many checks ask for it
    facts = F.array(F.struct(there.alias("there"), right.alias("right")))
    return [(True, F.element_at(F.transform(facts, lambda f: _joined(_own_checks(value, f["there"], f["right"], schema, path, whole, seen))), 1))]


def _own_checks(value: Column, there: Column, right: Column, schema: dict, path: str, whole: dict, seen: tuple) -> list[tuple[bool, Column]]:
    text, number = _at(value, path, "string"), _at(value, path, "double")
    out: list[tuple[bool, Column]] = []

    def wrong(when: Column, what: str) -> None:
        out.append((False, F.when(when, F.lit(f"{path}: {what}"))))

    if "type" in schema:
        wrong(there & ~right, f"not {schema['type']}")
    if "enum" in schema:
        wrong(right & ~text.isin(*schema["enum"]), "not allowed")
    if "const" in schema:
        wrong(right & (text != str(schema["const"])), f"not {schema['const']}")
    if "minimum" in schema:
        wrong(right & (number < schema["minimum"]), f"below {schema['minimum']}")
    if "maximum" in schema:
        wrong(right & (number > schema["maximum"]), f"above {schema['maximum']}")
    if "pattern" in schema:
        wrong(right & ~text.rlike(schema["pattern"]), "does not match")
    if schema.get("format") in _FORMATS:
        wrong(right & ~text.rlike(_FORMATS[schema["format"]]), f"not a {schema['format']}")
    if "minItems" in schema:
        wrong(right & (F.size(_at(value, path, "array<variant>")) < schema["minItems"]), f"fewer than {schema['minItems']} items")
    if "maxItems" in schema:
        wrong(right & (F.size(_at(value, path, "array<variant>")) > schema["maxItems"]), f"more than {schema['maxItems']} items")
    if "items" in schema:

        def item(element: Column, i: Column) -> Column:
            found = _joined(_checks(element, schema["items"], "$", whole, seen))
            return F.transform(found, lambda e: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"), F.substring(e, 2, 1 << 20)))

        out.append((True, F.when(right, F.flatten(F.transform(_at(value, path, "array<variant>"), item)))))
    for name, inner in schema.get("properties", {}).items():
        child = f"{path}.{name}"
        if name in schema.get("required", []):
            inside = _at(value, child, "variant")
            out.append((False, F.when(right & (inside.isNull() | F.is_variant_null(inside)), F.lit(f"{child}: missing"))))
        out += [(many, F.when(right, check)) for many, check in _checks(value, inner, child, whole, seen)]
    if schema.get("additionalProperties") is False:
        known = F.array(*(F.lit(n) for n in schema.get("properties", {}))).cast("array<string>")
        extra = F.array_sort(F.array_except(F.map_keys(_at(value, path, "map<string,variant>")), known))
        out.append((False, F.when(right & (F.size(extra) > 0), F.concat(F.lit(f"{path}: unexpected "), F.array_join(extra, ",")))))
    return out


def apply_patch(document: str, operations: str) -> str | None:
    """The document after JSON-pointer operations (add, replace, remove; `-` appends), as canonical text.

    Null if one can't be done, is another operation, or leaves neither an object nor a list.
    """
    try:
        root = {"": json.loads(document)}
        for op in json.loads(operations):
            if op["op"] not in ("add", "replace", "remove"):
                return None
            parts = ["", *(p.replace("~1", "/").replace("~0", "~") for p in op["path"].split("/")[1:])]
            node = root
            for p in parts[:-1]:
                node = node[int(p)] if isinstance(node, list) else node[p]
            last = parts[-1]
            if isinstance(node, list):
                i = len(node) if last == "-" else int(last)
                if i < 0 or i > len(node) - (op["op"] != "add"):
                    return None
                if op["op"] == "add":
                    node.insert(i, op["value"])
                elif op["op"] == "replace":
                    node[i] = op["value"]
                else:
                    del node[i]
            elif op["op"] == "remove":
                del node[last]
            elif op["op"] == "add" or last in node:
                node[last] = op["value"]
            else:
                return None
        if not isinstance(root.get(""), (dict, list)):
            return None
        return json.dumps(root[""], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (KeyError, ValueError, TypeError, IndexError):
        return None


def patched(document: Column, operations: Column) -> Column:
    """apply_patch by row; null in either stays null."""

    def run(documents: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or o is None else apply_patch(d, o) for d, o in zip(documents, many, strict=True)], dtype="object")

    return F.pandas_udf(run, "string")(document, operations)


def write_if_current(stored: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """key, revision, document, accepted: what is stored after writes (key, base, document), each taken only if its base is the stored revision.

    Of several writes to one key with the right base the smallest document is taken (null is the smallest), the others aren't. accepted: how many were.
    """
    fits = writes.join(stored.select(key, "revision"), key).where("base = revision").groupBy(key).agg(F.min(F.struct("document")).alias("_new"))
    rows = stored.join(fits, key, "left")
    took = F.col("_new").isNotNull()
    document = F.when(took, F.col("_new.document")).otherwise(F.col("document"))
    return rows.select(key, (F.col("revision") + took.cast("int")).alias("revision"), document.alias("document"), took.cast("int").alias("accepted"))


def markdown_table(df: DataFrame, columns: list[str]) -> Column:
    """A row of a Markdown table of the columns; pipes are escaped, nulls are empty."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
