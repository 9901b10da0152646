"""General operators on null keys and values, empty tables, repeated rows and columns of clashing names."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import documents, signals, text
from tessera.operators import aggregates, folds, matching, sequences
from tessera.plans import timeline

ROWS = "k string, i long, v double, w double, cap int, n long, z double, mean double, text string"


def frame(spark, rows):
    """Rows (k, i, v, w, cap) with more columns, whose names operators use."""
    return spark.createDataFrame([(*r, 9, 0.5, 0.5, "x") for r in rows], ROWS)


ODD = [(None, 1, 1.0, 1.0, 3), (None, 2, 5.0, None, None), ("a", 3, None, 2.0, 5), ("a", 4, 4.0, 0.0, 5), ("a", 4, 4.0, 0.0, 5), ("b", None, None, None, None)]

OPERATORS = {
    "nearest_rank": lambda d: aggregates.nearest_rank(d, ["k"], "v", {"p": 0.5}),
    "linear": lambda d: aggregates.linear_percentiles(d, ["k"], "v", {"p": 0.5}),
    "trimmed_mean": lambda d: aggregates.trimmed_mean(d, ["k"], "v"),
    "robust_z": lambda d: aggregates.robust_z(d.select("k", "i", "v", "text"), ["k"], "v"),
    "pearson": lambda d: aggregates.pearson(d, ["k"], "v", "w"),
    "mode": lambda d: aggregates.mode_first_seen(d, ["k"], "v", "i"),
    "allocate": lambda d: folds.allocate(d, ["k"], "i", "w", "cap", total=4),
    "leaders": lambda d: folds.leaders(d.withColumn("code", F.col("i")), ["k"], "i", "code", "w", within=1),
    "global_rank": lambda d: sequences.global_rank(d, "k", ["i"], "place"),
    "key_set_match": lambda d: matching.key_set_match(d.select("i", F.array("text", "k").alias("s")), d.select(F.col("i").alias("o"), F.array("k").alias("s")), "i", "o", "s"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(spark, name):
    operator = OPERATORS[name]
    assert operator(frame(spark, ODD)).collect() is not None
    assert operator(frame(spark, [])).collect() == []


def test_null_keys_are_keys(spark):
    rows = frame(spark, ODD)
    assert {(r["k"], r["n"], r["kept"], r["mean"]) for r in aggregates.trimmed_mean(rows, ["k"], "v").collect()} == {(None, 2, 2, 3.0), ("a", 2, 2, 4.0)}
    got = aggregates.robust_z(rows.select("k", "i", "v"), ["k"], "v").where("k is null").collect()
    assert sorted(round(r["z"], 6) for r in got) == [-0.674491, 0.674491]
    assert {r["k"]: r["p"] for r in aggregates.nearest_rank(rows, ["k"], "v", {"p": 0.5}).collect()} == {None: 1.0, "a": 4.0}


def test_null_weights_get_nothing(spark):
    got = {(r["k"], r["i"]): r["share"] for r in folds.allocate(frame(spark, ODD), ["k"], "i", "w", "cap", total=4).collect()}
    assert got[None, 1] == 3 and got[None, 2] == 0


def test_ranks_of_one_key_by_stretches(spark):
    df = spark.range(500).select(F.lit("same").alias("k"), (F.col("id") * 7919 % 500).alias("i"))
    got = sequences.global_rank(df, "k", ["i"], "place", stretches=16)
    assert all(r["place"] == r["i"] + 1 for r in got.collect())


def test_null_recordings(spark):
    df = spark.createDataFrame([(1, None, [1.0, 2.0]), (2, [1.0, 2.0], None), (3, None, None), (4, [1.0, 3.0], [0.0, 1.0, 3.0])], "i long, probe array<double>, target array<double>")
    assert {r["i"]: tuple(r["match"]) for r in signals.lags(df).collect()} == {1: (0, 0.0), 2: (0, 0.0), 3: (0, 0.0), 4: (0, pytest.approx(1.0))}
    assert {r["i"]: r["match"]["lag"] for r in signals.window_lags(df, window=2, hop=1).collect()}[1] is None


@pytest.mark.parametrize(
    ("operations", "want"),
    [
        ('[{"op":"test","path":"/a","value":2}]', None), ('[{"op":"move","path":"/b","from":"/a"}]', None), ('[{"op":"replace","path":"","value":3}]', None), ('[{"op":"remove","path":""}]', None),
        ('[{"op":"replace","path":"","value":{}}]', "{}"), ('[{"op":"add","path":"/l/-","value":5},{"op":"remove","path":"/l/0"}]', '{"a":1,"l":[5]}'), ('[{"op":"copy","path":"/l/0","value":1}]', None), ("[1]", None),
    ],
)
def test_patches_of_other_kinds(operations, want):
    assert documents.apply_patch('{"a":1,"l":[0]}', operations) == want


def test_a_write_of_null_is_a_write(spark):
    stored = spark.createDataFrame([("x", 1, "old"), ("y", 2, "old")], "k string, revision long, document string")
    writes = spark.createDataFrame([("x", 1, None), ("y", 1, "late")], "k string, base long, document string")
    assert sorted(map(tuple, documents.write_if_current(stored, writes, "k").collect())) == [("x", 2, None, 1), ("y", 2, "old", 0)]


def test_reasons_are_rows(spark):
    schema = "id long, s long, e long, print string"
    before = spark.createDataFrame([(i, 10 * i, 10 * i + 9, "p") for i in range(50)], schema)
    after = spark.createDataFrame([(i, 10 * i, 10 * i + 9, "q" if i in (3, 4, 30) else "p") for i in range(50) if i != 5], schema)
    got = timeline.changed_regions(before, after, "id", pad=1, duration=1000, span=20).orderBy("region", "reason").collect()
    assert [(r["region"], r["s"], r["e"], r["n"], r["reason"]) for r in got] == [(1, 29, 60, 3, "clip_changed:3"), (1, 29, 60, 3, "clip_changed:4"), (1, 29, 60, 3, "clip_removed:5"), (2, 299, 310, 1, "clip_changed:30")]


def test_unique_names_never_collide(spark):
    names = ["a", "a", "a_2", "a", "b_2", "b", "b", None, "item", "a_2"]
    df = spark.createDataFrame(list(enumerate(names)), "i long, s string")
    got = [r["unique"] for r in sequences.unique_names(df, "s", "i").orderBy("i").collect()]
    assert got == ["a", "a_2", "a_2_2", "a_3", "b_2", "b", "b_3", "item", "item_2", "a_2_3"]
    assert sequences.unique_names(df.limit(0), "s", "i").collect() == []


SCHEMA = {
    "type": "object", "required": ["clips"], "$defs": {"time": {"type": "number", "minimum": 0, "maximum": 9}, "clip": {"type": "object", "required": ["s"], "properties": {"s": {"$ref": "#/$defs/time"}, "tags": {"type": "array", "items": {"type": "string", "pattern": "^[a-z]+$"}}}}},
    "properties": {"clips": {"type": "array", "maxItems": 3, "items": {"$ref": "#/$defs/clip"}}, "at": {"type": "string", "format": "date-time"}, "v": {"const": 1}},
}


@pytest.mark.parametrize(
    ("document", "errors"),
    [
        ('{"clips":[{"s":1},{"s":9.5},{"x":1}],"v":2}', ["$.clips[1].s: above 9", "$.clips[2].s: missing", "$.v: not 1"]), ('{"clips":[]}', []), ('{"clips":[3,{"s":"x","tags":["ok","No",5]}],"at":"2024-01-01"}', ["$.clips[0]: not object", "$.clips[1].s: not number", "$.clips[1].tags[1]: does not match", "$.clips[1].tags[2]: not string", "$.at: not a date-time"]),
        ('{"clips":[{"s":0},{"s":0},{"s":0},{"s":-1}],"at":"2024-01-01T00:00:00Z"}', ["$.clips: more than 3 items", "$.clips[3].s: below 0"]), ("{}", ["$.clips: missing"]), ("oops", ["$: not JSON"]), (None, ["$: not JSON"]),
    ],
)
def test_schema_references_and_items(spark, document, errors):
    df = spark.createDataFrame([(document,)], "d string")
    assert df.select(documents.schema_errors(F.col("d"), SCHEMA).alias("e")).first()["e"] == errors


def test_references_in_a_circle_are_refused():
    with pytest.raises(ValueError, match="back to itself"):
        documents.schema_errors(F.lit("{}"), {"$ref": "#/a", "a": {"$ref": "#/a"}})


def test_word_boundaries_are_those_of_ascii_words(spark):
    """A letter beyond ASCII ends a word, as in the SQL; `\\b` in a class or behind a backslash stays what it is."""
    rows = spark.createDataFrame([("nation",), ("nationé",), ("nations",), ("étion",), ("ba\\b",)], "t string")
    got = [r[0] for r in rows.select(text.pattern_hits(F.col("t"), [r"tion\b", r"\Btion", r"a\\b"])).collect()]
    assert got == [[r"tion\b", r"\Btion"], [r"tion\b", r"\Btion"], [r"\Btion"], [r"tion\b"], [r"a\\b"]]
    assert text.ascii_bounds(r"[\b]\\b") == r"[\b]\\b"


@pytest.mark.parametrize("dense", [0, 1 << 40])
def test_tracks_of_many_boxes_equal_the_plain_choice(dense):
    """Full frames, boxes at one place, boxes without a place: the search from the box outwards takes what a look at every free track does."""
    rng = np.random.default_rng(4)
    n = 3000
    boxes = pd.DataFrame({"frame": rng.integers(0, 12, n), "item": np.arange(n), "x": rng.integers(0, 40, n) / 40, "y": rng.integers(0, 40, n) / 40, "area": rng.integers(0, 5, n) / 7})
    boxes.loc[rng.integers(0, n, 20), "x"] = np.nan
    want, seen, made = [], {}, 0
    for frame, rows in boxes.sort_values(["frame", "area", "item"], ascending=[True, False, True]).groupby("frame"):
        free = {t: v for t, v in seen.items() if frame - v[0] <= 1}
        seen = dict(free)
        for b in rows.itertuples():
            near = min(((d, t) for t, (_, x, y) in free.items() if (d := math.sqrt((b.x - x) * (b.x - x) + (b.y - y) * (b.y - y))) <= 0.06), default=None)
            t, made = (made, made + 1) if near is None else (near[1], made)
            free.pop(t, None)
            seen[t] = (frame, b.x, b.y)
            want.append((frame, b.item, t))
    got, count, _ = folds.follow_frames(boxes, 0, {}, far=0.06, memory=1, dense=dense)
    assert got == want and count == made


def test_a_full_frame_takes_no_square_of_time():
    """Two frames of 30,000 boxes: some nine hundred million pairs."""
    rng = np.random.default_rng(5)
    n = 30_000
    boxes = pd.DataFrame({"frame": np.repeat([0, 1], n), "item": np.arange(2 * n), "x": rng.random(2 * n), "y": rng.random(2 * n), "area": rng.random(2 * n)})
    began = time.perf_counter()
    out, *_ = folds.follow_frames(boxes, 0, {}, far=0.2, memory=3)
    assert len(out) == 2 * n and time.perf_counter() - began < 60


def test_common_runs_of_long_texts(spark):
    """Lengths at both bounds and beyond them, characters beyond ASCII; 300 pairs of 4,000 characters in little time."""
    rows = [("abc", "zabcz", 3), ("ab", "ab", 0), ("x" * 20, "x" * 20, 14), ("aé日本語b", "é日本語", 4), (None, "abc", 0), ("", "", 0), ("abcdefgh", "efgh abcd", 4)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    assert df.where(text.common_run(F.col("a"), F.col("b"), least=3, most=14) != F.col("n")).count() == 0
    rng = np.random.default_rng(6)
    long = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(300)]
    pairs = spark.createDataFrame(list(zip(long, long[1:], strict=False)), "a string, b string")
    began = time.perf_counter()
    got = pairs.select(text.common_run(F.col("a"), F.col("b"), least=3, most=14).alias("n")).collect()
    assert all(3 <= r["n"] < 14 for r in got) and time.perf_counter() - began < 12


def test_a_kind_is_found_once_a_value(spark):
    """The plan asks for a value's kind once, however many checks hang on it."""
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 3}, "b": {"type": "string", "pattern": "x", "enum": ["x"]}}}
    df = spark.createDataFrame([('{"a": 4, "b": "y"}',)], "d string").select(documents.schema_errors(F.col("d"), schema).alias("e"))
    assert df._jdf.queryExecution().analyzed().toString().count("schema_of_variant(") == 3
    assert df.first()["e"] == ["$.a: above 3", "$.b: not allowed", "$.b: does not match"]
