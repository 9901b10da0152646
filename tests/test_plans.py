"""Camera plans, matching, clocks, boxes, documents and signals on small cases: nulls, empty tables, ties, odd values."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import clock, documents, geometry, signals, text
from tessera.operators import aggregates, edits, intervals, matching, sequences
from tessera.plans import cameras, timeline


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def plan(spark, *segments):
    return spark.createDataFrame([("k", s, e, role, i) for i, (s, e, role) in enumerate(segments)], "k string, s long, e long, role string, ident long")


def fold_plan(segments, duration, fallback):
    """The normal form, one row after the other."""
    good = sorted((max(0, min(duration, s)), max(0, min(duration, e)), i, role) for i, (s, e, role) in enumerate(segments))
    out, cursor, previous = [], 0, fallback
    for s, e, _, role in good:
        if e <= s or e <= cursor:
            continue
        if s > cursor:
            out.append([cursor, s, previous])
        out.append([max(cursor, s), e, role])
        cursor, previous = e, role
    if cursor < duration:
        out.append([cursor, duration, previous])
    merged = []
    for s, e, role in out:
        if merged and merged[-1][2] == role:
            merged[-1][1] = e
        else:
            merged.append([s, e, role])
    return [tuple(m) for m in merged]


@pytest.mark.parametrize("seed", range(3))
def test_normal_plan_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    keys, want = [], []
    for k in range(12):
        own = [(rng.randrange(-20, 110), 0, rng.choice("abc")) for _ in range(rng.randrange(1, 9))]
        own = [(s, s + rng.randrange(-3, 40), r) for s, _, r in own]
        keys += [(k, s, e, r, i) for i, (s, e, r) in enumerate(own)]
        want += [(k, i, *x) for i, x in enumerate(fold_plan(own, 100, "m"))]
    df = spark.createDataFrame(keys, "k long, s long, e long, role string, ident long")
    got = cameras.normalize(df, ["k"], duration=100, fallback="m")
    assert rows(got, "k", "place", "s", "e", "role") == sorted(want)
    assert cameras.normalize(df.limit(0), ["k"], duration=100, fallback="m").collect() == []


def test_coverage_falls_back_to_the_master(spark):
    # the master lasts 30, camera2 10; the plan asks camera2 until 15
    p = cameras.normalize(plan(spark, (0, 15, "camera2"), (15, 30, "master")), ["k"], duration=30, fallback="master")
    windows = spark.createDataFrame([("k", "master", 0, 30), ("k", "camera2", 0, 10)], "k string, role string, ws long, we long")
    got = cameras.cover(p, windows, ["k"], duration=30, cameras=["master", "camera2"])
    assert rows(got.where("reason is not null"), "s", "e", "from_role", "role", "reason") == [(10, 15, "camera2", "master", "outside source coverage")]
    none = windows.where("role = 'camera2'").union(spark.createDataFrame([("k", "master", 0, 5)], windows.schema))
    got = cameras.cover(p, none, ["k"], duration=30, cameras=["master", "camera2"])
    assert rows(got.where("reason is not null"), "s", "e", "role", "reason") == [(10, 15, "camera2", "no covered fallback source"), (15, 30, "master", "no covered fallback source")]


def test_snap_collapses_and_keeps_far_boundaries(spark):
    p = cameras.normalize(plan(spark, (0, 10, "a"), (10, 14, "b"), (14, 50, "c"), (50, 100, "a")), ["k"], duration=100, fallback="a")
    points = spark.createDataFrame([("k", 1, 12), ("k", 2, 80)], "k string, ident long, s long")
    got = cameras.snap(p, points, ["k"], duration=100, fallback="a", most=20)
    assert rows(got, "place", "s", "e", "role") == [(0, 0, 12, "a"), (1, 12, 50, "c"), (2, 50, 100, "a")]


def test_pushes_layers_holds(spark):
    captions = spark.createDataFrame([("k", 10, 20), ("k", 20, 25), ("k", 40, 50)], "k string, s long, e long")
    bounds = spark.createDataFrame([("k", 1, 12), ("k", 2, 22), ("k", 3, 30), ("k", 4, 45)], "k string, i long, s long")
    assert rows(cameras.push_past(bounds, captions, ["k"], "i"), "i", "moved") == [(1, 22), (2, 25), (3, 30), (4, 50)]
    p = cameras.normalize(plan(spark, (0, 100, "a")), ["k"], duration=100, fallback="a")
    layer = spark.createDataFrame([("k", 10, 30, 7), ("k", 20, 40, 8)], "k string, s long, e long, ref long")
    card = spark.createDataFrame([("k", 25, 50, 1)], "k string, s long, e long, ref long")
    got = cameras.layered(p, [("card", card), ("still", layer)], ["k"], duration=100)
    assert rows(got, "s", "e", "kind", "ref") == [(0, 10, "camera", "a"), (10, 20, "still", "7"), (20, 25, "still", "7"), (25, 30, "card", "1"), (30, 40, "card", "1"), (40, 50, "card", "1"), (50, 100, "camera", "a")]
    said = spark.createDataFrame([("k", i, s, s + 1, who) for i, (s, who) in enumerate([(0, "x"), (5, "x"), (6, "q"), (12, "x"), (13, "x"), (25, "x")])], "k string, ident long, s long, e long, speaker string")
    got = cameras.hold_round_robin(said, ["k"], cameras=["c2", "c3"], master="m", asks="q", hold=12)
    assert [r[1] for r in rows(got, "ident", "role")] == ["c2", "c2", "m", "c3", "c3", "c2"]


def test_close_ups_only_while_someone_speaks(spark):
    p = cameras.normalize(plan(spark, (0, 20, "m"), (20, 60, "c"), (60, 100, "m")), ["k"], duration=100, fallback="m")
    speech = spark.createDataFrame([("k", 10, 30), ("k", 40, 45)], "k string, s long, e long")
    got = cameras.closeups_in_speech(p, speech, ["k"], duration=100, master="m")
    assert rows(got, "s", "e", "role") == [(0, 20, "m"), (20, 30, "c"), (30, 40, "m"), (40, 45, "c"), (45, 100, "m")]


def test_silences(spark):
    got = matching.removal_ranges(spark.createDataFrame([("a", 0, 5), ("b", 10, 16), ("c", 90, 100), ("d", 10, 12)], "k string, s long, e long"), ["k"], duration=100, keep=2, edge=0)
    assert rows(got, "k", "s", "e") == [("a", 0, 3), ("b", 11, 15), ("c", 92, 100)]
    cut = spark.createDataFrame([("k", 5, 10), ("k", 20, 30)], "k string, s long, e long")
    assert rows(intervals.interval_complement(cut, ["k"], within=(0, 50)), "s", "e") == [(0, 5), (10, 20), (30, 50)]
    assert rows(intervals.interval_complement(cut, ["k"]), "s", "e") == [(10, 20)]
    assert intervals.interval_complement(cut.limit(0), ["k"], within=(0, 50)).collect() == []


def test_union_over_stretches_equals_union(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), s, s + rng.randrange(30), str(i)) for i, s in enumerate(rng.randrange(1000) for _ in range(200))]
    df = spark.createDataFrame(data, "k string, s long, e long, p string")
    for keys in (["k"], []):
        plain = intervals.interval_union(df.withColumn("all", F.lit(1)), keys or ["all"], gap=2, payload="p")
        wide = intervals.interval_union(df, keys, gap=2, payload="p", span=50)
        columns = [*keys, "island", "s", "e", "n", "p"]
        assert rows(plain, *columns) == rows(wide, *columns)


def test_zero_weights(spark):
    df = spark.createDataFrame([("a", 1, 0, 0.0), ("a", 2, 0, 0.0), ("b", 1, 1, 2.0), ("b", 2, 3, -4.0)], "k string, i long, w long, x double")
    assert rows(intervals.weighted_split(df, ["k"], ["i"], "w", 100), "k", "i", "s", "e") == [("a", 1, 0, 50), ("a", 2, 50, 100), ("b", 1, 0, 25), ("b", 2, 25, 100)]
    assert rows(aggregates.weighted_profile(df, ["k"], "x", "w"), "k", "profile") == [("a", None), ("b", -2.5)]
    assert [r["share"] for r in aggregates.peak_bins(df, ["k"], F.col("i"), "x", 1).orderBy("k", "bin").collect()] == [None, None, 0.5, 1.0]


def test_changed_regions_without_a_version_before(spark):
    after = spark.createDataFrame([(1, 0, 5, "x")], "id long, s long, e long, print string")
    got = timeline.changed_regions(None, after, "id", pad=0, duration=2_968_465_500, span=10)
    assert rows(got, "region", "s", "e", "reason") == [(1, 0, 2_968_465_500, "missing_previous_timeline")]
    assert timeline.changed_regions(after, after, "id", pad=0, duration=100, span=10).collect() == []


def test_clocks(spark):
    cases = {"1.5": (1.5, 1.5, "1.5"), "2:03": (123.0, 123.0, "0:02:03.00"), "1:02:03,5": (3723.5, 3723.5, "1:02:03,5"), "01:02:03": (3723.0, 3723.0, "1:02:03.00"), "x": (None, 0.0, "x"), "": (None, 0.0, ""), "1:x": (None, 0.0, "1:x"), "1.5:20": (None, 110.0, "1.5:20")}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r["x"]: tuple(r)[1:] for r in df.select("x", clock.flexible_seconds(F.col("x")), clock.clock_seconds(F.col("x")), clock.full_timestamp(F.col("x"))).collect()}
    assert got == cases
    rates = {"30000/1001": 30000 / 1001, "25": 25.0, "1/0": None, "a": None, "1/2/3": None, None: None}
    df = spark.createDataFrame([(k,) for k in rates], "x string")
    assert {r[0]: r[1] for r in df.select("x", clock.fraction(F.col("x"))).collect()} == rates


def test_boxes(spark):
    df = spark.createDataFrame([(300.0, 250.0, -10.0, 50.0, 200.0), (0.0, 0.0, 0.0, 0.0, 200.0), (None, 1.0, 2.0, 3.0, 200.0), (1.0, 1.0, 2.0, 2.0, 0.0)], "a double, b double, c double, d double, w double")
    box = geometry.box_ratio(geometry.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")), F.col("w"), F.lit(500.0))
    got = [r[0] and tuple(r[0]) for r in df.select(box).collect()]
    assert got == [(0.0, 0.1, 1.0, 0.5), (0.0, 0.0, 0.0, 0.0), None, None]
    assert [r[0] and tuple(round(x, 4) for x in r[0]) for r in df.select(geometry.expand_box(box)).collect()] == [(0.0, 0.036, 1.0, 0.532), None, None, None]
    people = spark.sql("select array(named_struct('area', 0.5D), named_struct('area', 0.2D), named_struct('area', 0.1D)) a, array(named_struct('area', 0.01D)) b, array(named_struct('area', cast(null as double)), named_struct('area', 0D)) c")
    got = people.select(*(F.size(geometry.significant(F.col(c))) for c in "abc")).first()
    assert tuple(got) == (2, 1, 2)


def test_documents(spark, tmp_path):
    assert documents.apply_patch('{"a": [1, 2]}', '[{"op":"add","path":"/a/-","value":3},{"op":"remove","path":"/a/0"}]') == '{"a":[2,3]}'
    assert documents.apply_patch("{}", '[{"op":"replace","path":"/b","value":3}]') is None
    assert documents.apply_patch('{"a/b": {"~": 1}}', '[{"op":"replace","path":"/a~1b/~0","value":2}]') == '{"a/b":{"~":2}}'
    assert documents.apply_patch("[1]", '[{"op":"add","path":"/5","value":2}]') is None
    for name, body in {"a.json": '{"id": 1, "name": "x"}', "sub/b.json": '{"id": 2}', "c.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = documents.read_json(spark, str(tmp_path / "a.json"), "id long, name string")
    assert rows(got, "id", "name") == [(1, "x")]
    (tmp_path / "bad.json").write_text("{oops")
    assert rows(documents.read_json(spark, str(tmp_path / "bad.json"), "id long", strict=False), "id", "broken") == [(None, "{oops")]
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.read_json(spark, str(tmp_path / "bad.json"), "id long").collect()
    assert rows(documents.list_files(spark, str(tmp_path), "*.json"), "name", "size") == [("a.json", 22), ("b.json", 9), ("bad.json", 5)]
    df = spark.createDataFrame([('{"b":1, "a":{"d":[1, 2],"c":null}}',), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(documents.canonical(F.col("x"))).collect()][1:] == [None, None]
    assert json.loads(df.select(documents.canonical(F.col("x"))).first()[0]) == {"a": {"c": None, "d": [1, 2]}, "b": 1}
    seeds = spark.createDataFrame([("abc",)], "x string").select(documents.seed(F.col("x"))).first()[0]
    assert int(seeds) == int("ba7816bf8f01cfea", 16)


def test_texts(spark):
    df = spark.createDataFrame([("abc def", "xx abc"), ("", ""), (None, "a"), ("ab", "zzz")], "a string, b string")
    assert [r[0] for r in df.select(text.common_run(F.col("a"), F.col("b"), least=2, most=5)).collect()] == [3, 0, 0, 0]
    assert [r[0] and tuple(r[0]) for r in df.select(text.prefix_place(F.col("a"), F.col("b"))).collect()] == [(3, 4), None, None, None]
    assert text.pattern_hits(F.lit("a (b c"), ["(b", "a.*c", "x"]) is not None
    assert spark.range(1).select(text.pattern_hits(F.lit("a (b c"), ["(b", "a.*c", "x"])).first()[0] == ["(b", "a.*c"]
    got = spark.range(1).select(text.time_ranges(F.lit("1:00 - 2:00 | cut # why\n# 3 - 4\n5 - 6.5\n7 -"), clock.flexible_seconds)).first()[0]
    assert [tuple(r) for r in got] == [(60.0, 120.0, "cut"), (5.0, 6.5, "")]


def test_global_rank_equals_one_window(spark):
    rng = random.Random(8)
    data = [(rng.choice(["a", "b", "cc", "dd", None]) if i % 3 else f"k{rng.randrange(500)}", i) for i in range(700)]
    df = spark.createDataFrame(data, "k string, i long")
    got = {r["i"]: r["place"] for r in sequences.global_rank(df, "k", ["i"], "place").collect()}
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert got == {i: n + 1 for n, (_, i) in enumerate(want)}
    assert sequences.global_rank(df.limit(0), "k", ["i"], "place").collect() == []


def test_window_lags(spark):
    rng = np.random.default_rng(2)
    target = rng.normal(size=80)
    flat = np.ones(30)
    pairs = spark.createDataFrame([(1, np.concatenate((flat, target[40:60])).tolist(), target.tolist()), (2, flat.tolist(), target.tolist()), (3, target[:5].tolist(), [])], "i long, probe array<double>, target array<double>")
    got = {r["i"]: r["match"] for r in signals.window_lags(pairs, window=20, hop=10).collect()}
    assert (got[1]["start"], got[1]["lag"]) == (30, 10) and got[1]["score"] > 0.999
    assert got[2]["lag"] is None and got[3]["lag"] is None


def test_order_statistics_equal_sorted_lists(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.random() * 50])) for _ in range(900)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, x double")
    by = {}
    for k, x in data:
        if x is not None:
            by.setdefault(k, []).append(x)
    got = {r["k"]: (r["n"], r["a"], r["b"]) for r in aggregates.nearest_rank(df, ["k"], "x", {"a": 0.5, "b": 0.93}).collect()}
    assert got == {k: (len(v), sorted(v)[round((len(v) - 1) * 0.5)], sorted(v)[round((len(v) - 1) * 0.93)]) for k, v in by.items()}
    got = {r["k"]: (r["a"], r["b"]) for r in aggregates.linear_percentiles(df, ["k"], "x", {"a": 0.5, "b": 0.93}).collect()}
    assert got.keys() == by.keys() and all(np.allclose(got[k], np.quantile(by[k], [0.5, 0.93]), rtol=1e-12) for k in by)
    assert aggregates.nearest_rank(df.limit(0), ["k"], "x", {"a": 0.5}).collect() == []
    four = spark.createDataFrame([("k", float(i)) for i in (1, 2, 3, 4)], "k string, x double")
    assert aggregates.nearest_rank(four, ["k"], "x", {"a": 0.5}).first()["a"] == 3.0


def test_tracks_and_leaders(spark):
    from tessera.operators import folds

    boxes = [("v", 0, 1, 0.1, 0.1, 5.0), ("v", 0, 2, 0.9, 0.9, 4.0), ("v", 1, 1, 0.88, 0.9, 9.0), ("v", 1, 2, 0.12, 0.1, 1.0), ("v", 9, 1, 0.12, 0.1, 1.0)]
    df = spark.createDataFrame(boxes, "k string, frame long, item long, x double, y double, area double")
    assert rows(folds.track(df, ["k"], far=0.2, memory=3), "frame", "item", "track") == [(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 0), (9, 1, 2)]
    rng = random.Random(6)
    codes = [(i, (0b1111 << rng.randrange(4)) ^ (1 << rng.randrange(12)) ^ -(rng.random() < 0.3), rng.random()) for i in range(120)]
    got = dict(rows(folds.leaders(spark.createDataFrame([("k", *c) for c in codes], "k string, i long, code long, q double"), ["k"], "i", "code", "q", within=3), "i", "leader"))
    heads, want = [], {}
    for i, c, _ in sorted(codes, key=lambda c: (-c[2], c[0])):
        want[i] = next((h for h, x in heads if ((c ^ x) & (2**64 - 1)).bit_count() <= 3), i)
        if want[i] == i:
            heads.append((i, c))
    assert got == want


def test_cards_and_inserts(spark):
    cuts = spark.createDataFrame([("k", 10, 20, 3), ("k", 15, 30, 9), ("k", 40, 50, 0)], "k string, s long, e long, card long")
    times = spark.createDataFrame([("k", i, s) for i, s in enumerate([0, 10, 15, 20, 25, 39, 45, 60])], "k string, i long, s long")
    assert [r[1] for r in rows(intervals.replace_ranges(times, cuts, ["k"], "i"), "i", "mapped")] == [0, 10, 10, 13, 18, 32, 33, 43]
    assert [r[1] for r in rows(intervals.push_forward(times, ["k"], "i", length=12), "i", "s")] == [0, 12, 24, 36, 48, 60, 72, 84]


def naive_hold(plan, least):
    plan = [list(x) for x in plan]
    while len(plan) > 1:
        i = min(range(len(plan)), key=lambda j: (plan[j][1] - plan[j][0], j))
        if plan[i][1] - plan[i][0] >= least:
            break
        j = max((k for k in (i - 1, i + 1) if 0 <= k < len(plan)), key=lambda k: (plan[k][1] - plan[k][0], -k))
        plan[j] = [min(plan[i][0], plan[j][0]), max(plan[i][1], plan[j][1]), plan[j][2]]
        del plan[i]
        for k in reversed(range(1, len(plan))):
            if plan[k][2] == plan[k - 1][2]:
                plan[k - 1][1] = plan[k][1]
                del plan[k]
    return [tuple(x) for x in plan]


def test_minimum_hold_equals_the_loop():
    from tessera.operators.folds import _held

    rng = random.Random(11)
    for _ in range(300):
        at, plan = 0, []
        for _ in range(rng.randrange(1, 25)):
            role = rng.choice([r for r in "abc" if not plan or r != plan[-1][2]])
            plan.append((at, at := at + rng.randrange(1, 12), role))
        assert _held(plan, 8) == naive_hold(plan, 8)


def test_plans_are_read_once(spark):
    p = spark.range(200).selectExpr("id % 3 AS k", "id * 10 AS s", "id * 10 + 15 AS e", "if(id % 2 = 0, 'm', 'c') AS role", "id AS ident")
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    normal = cameras.normalize(p, ["k"], duration=3000, fallback="m")
    assert reads(normal) == 1
    assert reads(cameras.closeups_in_speech(normal, p.where("ident % 4 = 1"), ["k"], duration=3000, master="m")) == 2


def test_close_ups_of_keys_without_speech_or_key(spark):
    p = spark.createDataFrame([("a", 0, 0, 50, "c"), ("a", 1, 50, 90, "m"), ("b", 0, 0, 90, "c"), (None, 0, 0, 90, "c")], "k string, place long, s long, e long, role string")
    speech = spark.createDataFrame([("a", -5, 10), ("a", 10, 20), ("a", 30, 30), ("a", 40, 60), ("a", 80, 99), (None, 0, 90), ("z", 0, 90)], "k string, s long, e long")
    got = cameras.closeups_in_speech(p, speech, ["k"], duration=90, master="m")
    want = [(None, 0, 90, "m"), ("a", 0, 20, "c"), ("a", 20, 40, "m"), ("a", 40, 50, "c"), ("a", 50, 90, "m"), ("b", 0, 90, "m")]
    assert sorted(((r.k, r.s, r.e, r.role) for r in got.collect()), key=lambda r: (r[0] or "", r[1])) == want


def test_tasks_of_edits_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(edits, "SHARE", 10)
    lines = spark.range(100).selectExpr("id % 20 AS k", "id AS x", "id AS o")
    steps = lines.where("o < 20").selectExpr("k", "1 AS step", "'remove' AS op", "x", "cast(null AS long) AS anchor")
    got = edits.apply_edits(lines, steps, ["k"], "x", "o")
    assert got.rdd.getNumPartitions() == 12
    assert got.count() == 80
