"""General operators against plain Python versions and literal cases."""

import difflib
import random
import re
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from tessera import queries_media
from tessera.functions import signals, text
from tessera.operators import folds, intervals, relations
from tessera.plans import timeline
from tessera.sources import subtitles
from tessera.streaming import runs


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def random_intervals(seed, many=200):
    rng = random.Random(seed)
    return [(rng.randrange(5), i, s, s + rng.randrange(0, 40), rng.choice("abc")) for i in range(many) for s in [rng.randrange(400)]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, ident long, s long, e long, role string")


def islands(rows, gap=0):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def test_union_and_difference(spark):
    rows = random_intervals(1)
    for gap in (0, 7):
        got = rows_of(intervals.interval_union(frame(spark, rows), ["k"], gap=gap), "k", "s", "e")
        assert got == sorted((k, s, e) for k in range(5) for s, e in islands([(r[2], r[3]) for r in rows if r[0] == k], gap))
    left, cuts = rows[:80], rows[80:]
    got = intervals.interval_difference(frame(spark, left), frame(spark, cuts), ["k"], "ident")
    covered = {(r["ident"], t) for r in got.collect() for t in range(r["s"], r["e"])}
    want = {(i, t) for k, i, s, e, _ in left for t in range(s, e) if not any(c[0] == k and c[2] <= t < c[3] for c in cuts)}
    assert covered == want


def test_touching_gap_and_clamp(spark):
    df = spark.createDataFrame([(1, 0, 1_000_000), (1, 1_000_000, 2_000_000), (2, 0, 1_000_000), (2, 1_050_000, 2_000_000), (3, 0, 1_000_000), (3, 1_060_000, 2_000_000)], "k long, s long, e long")
    got = rows_of(intervals.interval_union(df, ["k"], gap=50_000, clamp=(500_000, 1_800_000)), "k", "s", "e", "n")
    assert got == [(1, 500_000, 1_800_000, 2), (2, 500_000, 1_800_000, 2), (3, 500_000, 1_000_000, 1), (3, 1_060_000, 1_800_000, 1)]


def test_overlap_join_meets_each_pair_once(spark):
    rows = random_intervals(2)
    a, b = frame(spark, rows[:100]).toDF("k", "i", "ls", "le", "x"), frame(spark, rows[100:]).toDF("k", "j", "rs", "re", "y")
    got = rows_of(intervals.overlap_join(a, b, ["k"], width=16), "i", "j", "overlap")
    assert got == sorted((p[1], q[1], min(p[3], q[3]) - max(p[2], q[2])) for p in rows[:100] for q in rows[100:] if p[0] == q[0] and min(p[3], q[3]) > max(p[2], q[2]))


def test_neighbours_only(spark):
    df = spark.createDataFrame([("t", 1, 0, 10), ("t", 2, 2, 3), ("t", 3, 5, 6)], "k string, ident long, s long, e long")
    assert rows_of(intervals.overlap_violations(df, ["k"], "ident"), "ident", "previous") == [(2, 1)]


def test_sweep(spark):
    df = spark.createDataFrame([(1, 0, 30, "master"), (1, 0, 10, "camera2"), (1, 5, 9, "camera2")], "k long, s long, e long, role string")
    assert rows_of(intervals.sweep(df, ["k"], "role"), "s", "e", "roles") == [(0, 10, "camera2,master")]


def test_role_runs_with_gap(spark):
    rows = random_intervals(3)
    got = rows_of(intervals.role_runs(frame(spark, rows), ["k"], "role", "ident", gap=3), "k", "s", "e", "role", "n")
    want = []
    for k in range(5):
        run = None
        for _, i, s, e, role in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[3], r[1])):
            if run and run[3] == role and s <= run[2] + 3:
                run[2], run[4] = max(run[2], e), run[4] + 1
            else:
                run = [k, s, e, role, 1]
                want.append(run)
    assert got == sorted(tuple(r) for r in want)


def test_nearest_and_remap(spark):
    rows = random_intervals(4)
    left, right = rows[:120], rows[120:]
    got = {r["ident"]: (r["near"], r["distance"]) for r in intervals.nearest(frame(spark, left), frame(spark, right), ["k"], "ident").collect()}
    assert got == {i: min(((abs(s - r[2]), r[2], r[1]) for r in right if r[0] == k))[2:0:-2] + (min(abs(s - r[2]) for r in right if r[0] == k),) for k, i, s, _, _ in left}
    got = {r["ident"]: r["mapped"] for r in intervals.remap(frame(spark, left), frame(spark, right), ["k"], "ident").collect()}
    for k, i, s, _, _ in left:
        cuts = islands([(r[2], r[3]) for r in right if r[0] == k])
        inside = any(a <= s < b for a, b in cuts)
        assert got[i] == (None if inside else s - sum(b - a for a, b in cuts if b <= s))


def test_caption_chain(spark):
    rows = [("c", 0, 900, "x", "a" * 25, 1), ("c", 1000, 1900, "x", "b" * 25, 2), ("c", 2000, 2900, "x", "c" * 20, 3), ("d", 0, 1, "x", "one", 1), ("d", 500, 900, "y", "two", 2)]
    got = folds.merge_captions(spark.createDataFrame(rows, "k string, s long, e long, role string, text string, ident long"), ["k"], gap=200, chars=52, length=10_000)
    assert rows_of(got, "k", "place", "s", "e", "n") == [("c", 0, 0, 1900, 2), ("c", 1, 2000, 2900, 1), ("d", 0, 0, 1, 1), ("d", 1, 500, 900, 1)]


def test_plan_has_no_gap_and_no_reversed_row(spark):
    plan = folds.normalize_plan(frame(spark, random_intervals(5)), ["k"]).collect()
    by = {}
    for r in sorted(plan, key=lambda r: (r["k"], r["place"])):
        assert r["s"] < r["e"]
        if r["k"] in by:
            assert by[r["k"]]["e"] == r["s"] and by[r["k"]]["role"] != r["role"]
        by[r["k"]] = r
    held = folds.minimum_hold(spark.createDataFrame(plan), ["k"], least=30).collect()
    for k in range(5):
        own = [r for r in held if r["k"] == k]
        assert len(own) == 1 or min(r["e"] - r["s"] for r in own) >= 30
        assert min(r["s"] for r in own) == min(r["s"] for r in plan if r["k"] == k) and max(r["e"] for r in own) == max(r["e"] for r in plan if r["k"] == k)


def test_greedy(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 4, 9.0), (1, 10, 9.0), (1, 30, 1.0)], "k long, at long, score double")
    assert rows_of(folds.suppress_peaks(df, ["k"], "at", "score", apart=6, many=3), "place", "at") == [(1, 4), (2, 10), (3, 30)]
    df = spark.createDataFrame([(1, 1, 1.0, 100), (1, 2, 1.0, 2), (1, 3, 1.0, 100)], "k long, i long, w double, cap long")
    assert rows_of(folds.allocate(df, ["k"], "i", "w", "cap", total=10), "i", "share") == [(1, 4), (2, 2), (3, 4)]
    df = spark.createDataFrame([(1, 1, 0b0000, 3), (1, 2, 0b0001, 5), (1, 3, -1, 4)], "k long, i long, code long, q long")
    assert rows_of(folds.leaders(df, ["k"], "i", "code", "q", within=2), "i", "leader") == [(1, 2), (2, 2), (3, 3)]


def test_text(spark):
    df = spark.createDataFrame([("night", "nacht"), ("a", "ab"), ("", ""), ("aa  b　c ", "x")], "a string, b string")
    got = df.select(text.dice(F.col("a"), F.col("b")).alias("d"), text.char_overlap(F.col("a"), F.col("b")).alias("c"), text.set_overlap(F.col("a"), F.col("b")).alias("s"), text.clean(F.col("a")).alias("x"), text.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [round(r["d"], 3) for r in got] == [0.25, 0.0, 0.0, 0.0]
    assert [r["c"] for r in got[:3]] == [0.6, 1.0, 0.0] and [round(r["s"], 3) for r in got[:3]] == [0.6, 1.0, 0.0]
    assert got[3]["x"] == "aa b c" and [r["r"] for r in got] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in (("night", "nacht"), ("a", "ab"), ("", ""), ("aa  b　c ", "x"))]
    df = spark.createDataFrame([("um, um, well then",), ("um ok",), (None,)], "a string")
    assert [r[0] for r in df.select(text.strip_fillers(F.col("a"), ["um", "well"])).collect()] == ["then", "um ok", None]
    assert spark.createDataFrame([("ＡＢ、c",)], "a string").select(text.nfkc(F.col("a"))).first()[0] == "abc"


def test_subtitles(spark):
    srt = "1\r\n00:00:01,500 --> 00:00:02,000\r\n<i>Hello</i>\r\nthere\r\n\r\n00:00:03.250 --> 00:00:04.000\nno number\n\n9\nbroken\n"
    got = subtitles.parse_srt(spark.createDataFrame([(1, srt)], "f long, value string"), ["f"])
    assert rows_of(got, "s", "e", "text") == [(1_500_000, 2_000_000, "Hello there"), (3_250_000, 4_000_000, "no number")]
    assert [r["number"] for r in got.orderBy("s").collect()] == [1, None]
    ass = "[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,Main,,0,0,0,,{\\b1}Hi, you\\Nthere\nComment: 0"
    assert rows_of(subtitles.parse_ass(spark.createDataFrame([(1, ass)], "f long, value string"), ["f"]), "s", "e", "style", "text") == [(1_500_000, 2_000_000, "Main", "Hi, you there")]


def test_vtt_short_times(spark):
    vtt = "WEBVTT\n\n00:01.500 --> 00:02.000 align:start\n<v Ann>short</v>\n\nname\n59:59.000 --> 01:00:00.250\nmixed\n\n01:00:01.000 --> 01:00:02.000\nlong\n\n01.500 --> 00:02\nbroken\n"
    got = subtitles.parse_srt(spark.createDataFrame([(1, vtt)], "f long, value string"), ["f"])
    assert rows_of(got, "s", "e", "text") == [(1_500_000, 2_000_000, "short"), (3_599_000_000, 3_600_250_000, "mixed"), (3_601_000_000, 3_602_000_000, "long")]
    codes = spark.createDataFrame([("1:02,5",), ("100:00:00.001",), ("1:2:3:4.5",), ("2.5",), ("",), (None,)], "a string")
    assert [r[0] for r in codes.select(text.timecode_us(F.col("a"))).collect()] == [62_500_000, 360_000_001_000, None, None, None, None]


def test_read_texts(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    assert subtitles.parse_srt(subtitles.read_texts(spark, str(tmp_path)), ["path"]).count() == 1


def test_timeline(spark):
    same = spark.createDataFrame([(1, 0, 5, "p")], "id long, s long, e long, print string")
    assert timeline.changed_regions(same, same, "id", pad=0, duration=9).collect() == []
    moved = spark.createDataFrame([(1, 1, 2, "p"), (2, 8, 12, "q")], "id long, s long, e long, print string")
    # a changed clip is one range, from the earlier of its starts to the later of its ends
    assert rows_of(timeline.changed_regions(same, moved, "id", pad=0, duration=9), "s", "e", "n", "reason") == [(0, 5, 1, "clip_changed:1"), (8, 9, 1, "clip_added:2")]
    apart = spark.createDataFrame([(1, 7, 8, "p")], "id long, s long, e long, print string")
    assert rows_of(timeline.changed_regions(same, apart, "id", pad=0, duration=9), "s", "e", "reason") == [(0, 8, "clip_changed:1")]
    assert rows_of(timeline.changed_regions(same, same.limit(0), "id", pad=0, duration=9), "s", "e", "reason") == [(0, 5, "clip_removed:1")]
    cut = timeline.slice_clips(spark.createDataFrame([(1, 0, 10, 100), (2, 20, 30, 0)], "id long, s long, e long, source_in long"), 4, 8)
    assert rows_of(cut, "id", "s", "e", "source_in") == [(1, 0, 4, 104)]
    clips = spark.createDataFrame([(1, "t", "a", 0, 10, False), (2, "t", "a", 2, 3, True), (3, "t", None, 5, 5, None), (3, "u", "b", -1, 99, None)], "clip_id long, track_id string, source_id string, s long, e long, allow_overlap boolean")
    found = timeline.validate(clips, spark.createDataFrame([("t",)], "track_id string"), spark.createDataFrame([("a",)], "source_id string"), 50)
    assert rows_of(found, "clip_id", "code") == sorted([(3, "duplicate_id"), (3, "empty_range"), (3, "before_start"), (3, "after_end"), (3, "unknown_track"), (3, "unknown_source"), (3, "overlap")])


def test_relations(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (3, "c", 1)], "id long, v string, at long")
    assert rows_of(relations.override(df, changes, "id", "v", "at"), "id", "v", "changed") == [(1, "a", False), (2, "b", False), (3, "c", True)]
    assert rows_of(relations.snapshot_diff(df, spark.createDataFrame([(1, "a"), (2, "z"), (4, None)], "id long, v string"), "id"), "id", "change") == [(2, "changed"), (3, "removed"), (4, "added")]


def test_signals(spark):
    rng = np.random.default_rng(2)
    target = rng.normal(size=200)
    assert signals.best_lag(target[37:90] * 3 + 5, target)[0] == 37
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 0, 0, 9, 9, 0, 0, 0, 0, 9])], "k long, f long, v double")
    assert rows_of(signals.silent_runs(df, ["k"], "f", "v", 1.0, 3), "s", "e", "n") == [(0, 3, 3), (5, 9, 4)]


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, m), r) for m, r in ((0, "a"), (1, "a"), (2, "b"), (30, "a"), (59, "b"))]
    spark.createDataFrame(rows, "user_id long, ts timestamp, role string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("user_id long, ts timestamp, role string").parquet(str(tmp_path / "in"))
    for name, df in (("isles", runs.stream_islands(source, "user_id", "ts", gap="5 minutes", late="1 minute")), ("turns", runs.stream_role_changes(source, "user_id", "role", "ts"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r["s"].minute, r["n"]) for r in spark.table("isles").orderBy("s").collect()] == [(0, 3), (30, 1)]
    assert [(r["from_role"], r["to_role"]) for r in spark.table("turns").orderBy("at").collect()] == [("a", "b"), ("b", "a"), ("a", "b")]


def test_ratio_is_that_of_difflib():
    rng = random.Random(3)
    texts = ["", "a", "ab" * 60, "日本😀" * 9, "a" * 199, "a" * 200, "ab" * 130]
    texts += ["".join(rng.choices(letters, k=rng.randrange(1, 230))) for letters in ("ab", "abcdeé😀", "abcdefghijklmnopqrst") for _ in range(12)]
    for a in texts:
        for b in texts:
            assert text._ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_seq_ratio_top_deals_turns_by_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i // 5, i % 5, "".join(rng.choices("abcd ,É", k=rng.randrange(30)))) for i in range(4001)] + [(900, 0, None), (900, 1, "x"), (901, 0, "Ab!"), (901, 1, "ab"), (901, 1, "b"), (None, 0, "x"), (None, 1, "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").repartition(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries_media.seq_ratio_top(spark, str(tmp_path))
    # three tasks a side whatever the file's bytes: the pairs of one small file don't all go to one
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(conv_id#\d+L?, turn#\d+L?, 3\), REPARTITION_BY_NUM", plan)) == 2
    found = [(r["conv_id"], r["turn"], r["ratio"], r["place"]) for r in got.collect() if r["conv_id"] is None or r["conv_id"] >= 900]
    assert sorted(found) == [(901, 0, round(2 / 3, 6), 2), (901, 0, 1.0, 1)]
