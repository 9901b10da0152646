"""Retiming, line breaking, common clocks, long signals, edits and assembled documents against plain versions, with nulls, ties and empty tables."""

import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import documents, lines, spectra
from tessera.operators import edits, matching
from tessera.plans import assembly, retiming, sync

CAPTIONS = "rec string, cap long, s long, e long, texts array<string>"
WORDS = "rec string, t long, n long, word string"


def test_three_chained_captions(spark):
    """One text said three times is found three times, each time behind the last; without the chain the third is found where the second is."""
    said = [("a", 100 * i, i, w) for i, w in enumerate(["one", "two", "x", "one", "two", "y", "one", "two"])]
    words = spark.createDataFrame([*said, ("a", None, 9, "one"), ("b", 5, 0, None)], WORDS)
    captions = spark.createDataFrame([("a", 1, 0, 900, ["onetwo"]), ("a", 2, 10, 900, ["onetwo"]), ("a", 3, 20, 900, [None, "umonetwo", "onetwo"]), ("a", 4, 30, 900, None), ("b", 5, 0, 900, ["one"]), ("c", 6, 0, 900, [])], CAPTIONS)
    how = {"before": 0, "after": 0, "margin": 0}
    got = {r["cap"]: (r["spoken"], r["size"], r["place"]) for r in retiming.spoken_starts(captions, words, ["rec"], "cap", **how).collect()}
    assert got == {1: (0, 6, 1), 2: (300, 6, 8), 3: (600, 6, 15), 4: (None,) * 3, 5: (None,) * 3, 6: (None,) * 3}
    free = {r["cap"]: r["spoken"] for r in retiming.spoken_starts(captions, words, ["rec"], "cap", **how, chained=False).collect()}
    assert [free[i] for i in (1, 2, 3)] == [0, 300, 300]
    assert retiming.spoken_starts(captions.limit(0), words, ["rec"], "cap").collect() == []


def test_moves_between_found_captions(spark):
    rows = spark.createDataFrame([("a", 1, 0, 10, 2_000_000), ("a", 2, 1_000_000, 10, None), ("a", 3, 2_000_000, 10, 2_100_000), ("a", 4, 3_000_000, 10, None)], "rec string, cap long, s long, e long, spoken long")
    got = {r["cap"]: (r["s"], r["moved"]) for r in retiming.moved_starts(rows, ["rec"], "cap").collect()}
    assert got == {1: (1_650_000, 1_650_000), 2: (1_825_000, 825_000), 3: (2_000_000, 0), 4: (3_000_000, 0)}
    assert {r["cap"]: r["moved"] for r in retiming.moved_starts(rows, ["rec"], "cap", fill=False).collect()}[2] == 0


def test_short_captions_join_by_what_was_joined(spark):
    rows = spark.createDataFrame([("a", i, i * 1000, i * 1000 + 900, "x" if i < 3 else None, "t" * 20, 20) for i in range(4)], "rec string, ident long, s long, e long, role string, text string, size int")
    got = [(r["place"], r["n"], r["size"]) for r in retiming.joined_short(rows, ["rec"], gap=200, chars=52, length=10_000, brief=1000, few=0, near=0).orderBy("place").collect()]
    assert got == [(0, 2, 40), (1, 1, 20), (2, 1, 20)]


def test_slots_fill_speech(spark):
    rng = random.Random(3)
    captions = [("a", b, 10 * b + i, rng.choice([None, 0, 1, 5, 40])) for b in range(6) for i in range(rng.randrange(1, 6))]
    speech = [("a", b, 1000 * b, 1000 * b + 7 * (b + 1)) for b in range(5)] + [("a", 5, 9, 9)]
    got = retiming.speech_slots(spark.createDataFrame(captions, "rec string, block long, cap long, weight int"), spark.createDataFrame(speech, "rec string, block long, s long, e long"), ["rec"], "cap", least=3).collect()
    at = {r["cap"]: (r["s"], r["e"]) for r in got}
    for b in range(6):
        own = [at[c] for _, blk, c, _ in captions if blk == b]
        if b == 5:
            assert own == [(None, None)] * len(own)
            continue
        assert own[0][0] == 1000 * b and own[-1][1] == 1000 * b + 7 * (b + 1) and all(x[1] == y[0] for x, y in itertools.pairwise(own))
        assert all(e - s >= min(3, 7 * (b + 1) // len(own)) for s, e in own)


def test_dependent_segments(spark):
    rows = spark.createDataFrame([("a", i, 10 * i, 10 * i + 9, t) for i, t in enumerate(["so we", "and then", "stop.", None, "Now", "far"])], "rec string, ident long, s long, e long, text string")
    got = [(r["text"], r["n"]) for r in retiming.joined_dependent(rows, ["rec"], leading="and", dangling="then|Now", gap=5, chars=20).orderBy("place").collect()]
    assert got == [("so we and then stop.", 4), ("Now far", 2)]


def cost_of(text, breaks, rules):
    n, total = len(text), int(lines.widths(text).sum())
    parts = [text[a:b].strip() for a, b in zip([0, *breaks], [*breaks, n], strict=True)]
    if not all(parts) or any(text[b] in rules.no_start for b in breaks):
        return None, parts
    cost = 0
    for p in parts:
        cost += rules.balance * (int(lines.widths(p).sum()) * len(parts) - total) ** 2 + (max(0, rules.least - len(p)) * rules.short if n >= rules.least * len(parts) else 0)
    for b in breaks:
        cost += rules.gain - (rules.gain if text[b - 1] in rules.good_end else 0) + sum(rules.cut for s, e in lines.unbreakable_spans(text, rules) if s < b < e)
    return cost, parts


def test_breaks_equal_exhaustive_search():
    rng, rules = random.Random(5), lines.BreakRules(phrases=("b c",))
    for _ in range(150):
        text = "".join(rng.choice("ab c. ,、アイ漢かっ") for _ in range(rng.randrange(2, 22))).strip() or "a"
        width = rng.randrange(4, 14)
        got = lines.broken(text, width, 3, rules)
        want = None
        for many in (1, 2, 3):
            found = []
            for breaks in itertools.combinations(range(1, len(text)), many - 1):
                cost, parts = cost_of(text, breaks, rules)
                if cost is not None and all(lines.widths(p).sum() <= width for p in parts):
                    found.append((cost, breaks[::-1], parts))
            if found:
                want = min(found)[2]
                break
        assert got == want, (text, width)


def test_lines_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "one two three four five"), (5, "x" * 100_000), (6, "カタカナ。漢字かな")], "i long, x string")
    got = {r["i"]: r["l"] for r in df.select("i", lines.break_lines(F.col("x"), 10).alias("l")).collect()}
    assert got[1] is None and got[2] == [""] and got[3] == [""] and got[4] == ["one two", "three", "four five"] and got[5] is None and got[6] == ["カタカナ。", "漢字かな"]
    assert [tuple(s) for s in df.where("i = 4").select(lines.script_spans(F.col("x")).alias("s")).first()["s"]] == [(0, 3), (4, 7), (8, 13), (14, 18), (19, 23)]


def test_common_clock(spark):
    """The surest chain counts; a measurement that disagrees is reported; what no chain reaches has no offset."""
    pairs = spark.createDataFrame([("g", "m", "a", 100, 900), ("g", "b", "a", 30, 950), ("g", "m", "b", 500, 200), ("g", "a", "m", 7, 100), ("g", "x", "y", 5, 900), ("g", "m", None, 5, 900), ("g", "m", "m", 5, 900), ("h", "p", "q", 1, 10)], "k string, a string, b string, offset long, score int")
    sources = spark.createDataFrame([("g", s, s == "m", 1000) for s in "mabxy"] + [("h", "q", None, 50), ("h", "p", False, 50), ("i", "z", True, 0)], "k string, source string, reference boolean, length long")
    clock = sync.common_clock(pairs, sources, ["k"])
    got = {(r["k"], r["source"]): (r["offset"], r["hops"]) for r in clock.collect()}
    assert got == {("g", "m"): (0, 0), ("g", "a"): (100, 1), ("g", "b"): (70, 2), ("g", "x"): (None, None), ("g", "y"): (None, None), ("h", "p"): (0, 0), ("h", "q"): (1, 1), ("i", "z"): (0, 0)}
    off = sorted((r["a"], r["b"], r["off"]) for r in sync.clock_conflicts(pairs, clock, ["k"], slack=50).collect())
    assert off == [("a", "m", 107), ("m", "b", 430)]
    assert {(r["source"], r["s"], r["e"]) for r in sync.synced_ranges(sources, clock, ["k"]).where("k = 'g'").collect()} == {("m", 0, 1000), ("a", -100, 900), ("b", -70, 930)}
    assert sync.common_clock(pairs.limit(0), sources.limit(0), ["k"]).collect() == []


@pytest.mark.parametrize("lags", [(-40, 40), (5, 300), (-7, -7)])
def test_lag_sums_equal_direct_sums(spark, lags):
    rng = np.random.default_rng(1)
    x, y = rng.integers(-9, 9, 700), rng.integers(-9, 9, 900)
    left = spark.createDataFrame([("a", i, int(v)) for i, v in enumerate(x) if i % 7] + [("a", 3, None), ("only", 0, 1)], "k string, i long, x int")
    right = spark.createDataFrame([("a", j, int(v)) for j, v in enumerate(y) if j % 11], "k string, i long, y int")
    x[::7], y[::11] = 0, 0
    got = {r["lag"]: r["total"] for r in spectra.lag_sums(left, right, ["k"], lags=lags, block=64).collect()}
    assert got == {d: sum(int(x[i]) * int(y[i + d]) for i in range(len(x)) if 0 <= i + d < len(y)) for d in range(lags[0], lags[1] + 1)}


def test_million_samples(spark):
    """A copy that lies 4321 samples behind, inverted: found in blocks, coarse first and then refined."""
    n, shift = 1_000_000, 4321
    noise = F.pmod(F.xxhash64("i"), F.lit(2001)) - 1000
    left = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i")).withColumn("x", noise)
    right = left.select("k", (F.col("i") + shift).alias("i"), (-F.col("x")).alias("y"))
    best = spectra.best_lags(spectra.lag_sums(left, right, ["k"], lags=(-8000, 8000)), ["k"], signless=True).first()
    assert best["lag"] == shift and best["total"] < 0
    coarse = spark.createDataFrame([(1, 43)], "k int, lag long")
    assert spectra.refined_lags(left.where("i < 50000"), right.withColumn("y", -F.col("y")), coarse, ["k"], step=100, radius=60).first()["lag"] == shift


def test_planted_drift(spark):
    left = spark.range(60_000).select(F.lit("a").alias("k"), F.col("id").alias("i")).withColumn("x", F.pmod(F.xxhash64("i"), F.lit(201)) - 100)
    right = left.select("k", (F.col("i") + 30 + F.floor(F.col("i") / 1000)).alias("i"), F.col("x").alias("y"))
    probes = spectra.local_lags(left, right, ["k"], window=1000, lags=(0, 128))
    assert {r["part"]: r["lag"] for r in probes.collect()} == {p: 30 + p for p in range(60)}
    line = spectra.drift(probes, ["k"], window=1000).first()
    assert abs(line["slope"] - 0.001) < 1e-12 and abs(line["start"] - 30) < 1e-9 and line["n"] == 60 and line["off"] < 1e-9
    one = spectra.drift(probes.where("part = 5"), ["k"], window=1000).first()
    assert one["slope"] is None and one["start"] == 35


def test_features_of_sines(spark):
    rate, frame = 8000, 800
    i = np.arange(3 * frame - 5)
    wave = np.where(i < frame, np.sin(2 * np.pi * 400 * i / rate), np.where(i < 2 * frame, 0.0, 1.0))
    df = spark.createDataFrame([("a", int(j), float(v)) for j, v in zip(i, wave, strict=True)], "k string, i long, x double")
    got = {r["frame"]: r for r in spectra.frame_features(df, ["k"], rate=rate, frame=frame).collect()}
    assert sorted(got) == [0, 1] and got[1]["rms"] == 0 and got[1]["bands"] is None
    f = got[0]
    assert abs(f["rms"] - 0.5**0.5) < 1e-6 and abs(f["zcr"] - 0.1) < 0.002 and abs(f["centroid"] - 400) < 5 and abs(f["rolloff"] - 400) <= 10 and f["flatness"] < 1e-3
    assert f["bands"][1] > 0.999 and abs(sum(f["bands"]) - 1) < 1e-9


def test_levels_of_two_channels(spark):
    rows = [("a", i, float((-1) ** i), 0.1 * (-1) ** i) for i in range(100)] + [("a", 100 + i, 0.0, 0.0) for i in range(10)]
    got = spectra.stereo_levels(spark.createDataFrame(rows, "k string, i long, left double, right double"), ["k"], spark.createDataFrame([("a", 1, 0, 100), ("a", 2, 100, 110), ("a", 3, 500, 600)], "k string, cap long, s long, e long"), "cap")
    by = {r["cap"]: r for r in got.collect()}
    assert sorted(by) == [1, 2] and abs(by[1]["lr_db"] - 20) < 1e-9 and abs(by[1]["crest"] - 1) < 1e-9 and abs(by[1]["agreement"] - 1) < 1e-9 and by[2]["lr_db"] == 0 and by[2]["crest"] is None


def test_edits_equal_a_list_program(spark):
    rng = random.Random(7)
    rows, steps, want = [], [], {}
    for k in range(25):
        line = [f"r{i}" for i in rng.sample(range(40), rng.randrange(12))]
        rows += [(k, x, i) for i, x in enumerate(line)]
        refused = 0
        for step in range(30):
            op = rng.choice(["insert_before", "insert_after", "move_before", "move_after", "swap", "remove", "what", None])
            x, a = rng.choice([*line, "n" + str(step), None]), rng.choice([*line, "gone", None])
            steps.append((k, step, op, x, a))
            there = x in line
            if x is None or x == a or (a is not None and a not in line) or op in ("what", None) or (op.startswith("insert") if there else not op.startswith("insert")) or (op == "swap" and a is None):
                refused += 1
            elif op == "swap":
                i, j = line.index(x), line.index(a)
                line[i], line[j] = a, x
            else:
                line = [y for y in line if y != x]
                if op != "remove":
                    at = (len(line) if op.endswith("after") else 0) if a is None else line.index(a) + op.endswith("after")
                    line.insert(at, x)
        want[k] = (line, refused)
    got = edits.apply_edits(spark.createDataFrame([*rows, (99, None, 0)], "k long, x string, o long"), spark.createDataFrame(steps, "k long, step long, op string, x string, anchor string"), ["k"], "x", "o").collect()
    for k, (line, refused) in want.items():
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["place"])
        assert [r["x"] for r in own] == line and all(r["refused"] == refused for r in own)
        assert [r["order_key"] for r in own] == sorted(r["order_key"] for r in own)


def test_key_between_many_times():
    low, high = edits.first_keys(40)[3:5]
    for _ in range(200):
        mid = edits.key_between(low, high)
        assert low < mid < high
        low, high = (mid, high) if len(mid) % 2 else (low, mid)
    assert edits.key_between("", None) > "" and edits.key_between("", "1") < "1"


def test_documents_pass_their_schema(spark):
    timelines = spark.createDataFrame([("t", 100), ("empty", 5)], "k string, duration long")
    tracks = spark.createDataFrame([("t", "v", "video", False), ("t", "a", "audio", True)], "k string, track_id string, kind string, allow_overlap boolean")
    sources = spark.createDataFrame([("t", "s1", "media", 60), ("t", "unused", "media", 9)], "k string, source_id string, kind string, length long")
    rows = [("c1", "v", "s1", -5, 20, 0), ("c2", "v", "s1", 20, 50, 10), ("c3", "v", "s1", 50, 99, 30), ("c4", "zz", "s1", 0, 9, 0), ("c5", "a", "gone", 0, 9, 0), ("c6", "a", "s1", 120, 130, 0), ("c2", "v", "s1", 60, 70, 0), ("c7", None, "s1", 0, 5, 0)]
    clips = spark.createDataFrame([("t", *r[:3], "clip", *r[3:]) for r in rows], "k string, clip_id string, track_id string, source_id string, kind string, s long, e long, source_in long")
    made = assembly.timeline_documents(timelines, tracks, clips, sources, ["k"])
    got = {r["k"]: (json.loads(r["document"]), r["dropped"]) for r in made.collect()}
    doc, dropped = got["t"]
    assert dropped == 6 and [c["id"] for c in doc["clips"]] == ["c1", "c2"] and doc["clips"][0]["timelineStart"] == 0 and doc["clips"][0]["sourceIn"] == 5 and [s["id"] for s in doc["sources"]] == ["s1"]
    assert doc["transitions"] == [{"at": 20, "fromClipId": "c1", "toClipId": "c2"}] and [t["id"] for t in doc["tracks"]] == ["a", "v"]
    assert got["empty"] == ({"schemaVersion": "1", "duration": 5, "sources": [], "tracks": [], "clips": [], "transitions": []}, 0)
    items = lambda *names: {"type": "array"}  # noqa: E731, ARG005
    schema = {"type": "object", "required": ["schemaVersion", "duration", "clips"], "additionalProperties": False, "properties": {"schemaVersion": {"type": "string"}, "duration": {"type": "integer", "minimum": 0}} | {n: items() for n in ("sources", "tracks", "clips", "transitions")}}
    assert made.select(documents.schema_errors(F.col("document"), schema).alias("e")).where("size(e) > 0").count() == 0


def test_plan_findings(spark):
    events = spark.createDataFrame([("p", 1, 0, 10_000, "m", 5_000, 15_000), ("p", 2, 5_000, 4_000, "m", 0, 99_000), ("p", 3, 50_000, 60_000, "zz", 1, 0)], "k string, event_id long, s long, e long, media_id string, source_in long, source_out long")
    media = spark.createDataFrame([("m", 50_000)], "media_id string, length long")
    overlays = spark.createDataFrame([("p", 1, 1, "caption", "plain", "fine", 0, 5_000), ("p", 1, 2, "explainer", None, None, 4_000, 9_000), ("p", 9, 3, "caption", "wild", "secret", 7, 7)], "k string, event_id long, overlay_id long, kind string, style string, text string, s long, e long")
    got = {(r["event_id"], r["code"], r["level"]) for r in assembly.plan_findings(events, media, overlays, ["k"], window=(2_000, 80_000), styles=["plain"], forbidden=["secret"]).collect()}
    want = {1: ["clash"], 2: ["empty_range", "overlap", "beyond_media", "outside_window"], 3: ["unknown_media"], 9: ["unknown_event", "unknown_style", "forbidden_text", "empty_overlay"]}
    assert got == {(i, c, "error") for i, codes in want.items() for c in codes} | {(3, "gap", "warning")}


def brute_best(left, right):
    out = {}
    for i, a in left:
        found = []
        for j, b in right:
            x, y = {t for t in a or [] if t}, {t for t in b or [] if t}
            if x & y:
                found.append((-len(x & y) / len(x | y), j))
        if found:
            out[i] = min(found)[::-1]
    return out


@pytest.mark.parametrize("often", [1, 3, 64])
def test_best_match_without_a_cap(spark, often):
    """Tokens that many rows hold bring their pairs too: 201 holders of one token, and random rows with common and rare tokens."""
    rng = random.Random(often)
    right = [(f"r{i:03}", ["common"] + [f"t{rng.randrange(30)}" for _ in range(rng.randrange(4))]) for i in range(201)] + [("none", None), ("empty", [])]
    left = [("only", ["common"]), ("null", None), ("nothing", ["zz"]), ("holed", [None, "common"])] + [(f"l{i}", rng.sample(["common", *(f"t{j}" for j in range(34))], 4)) for i in range(60)]
    schema = "id string, tokens array<string>"
    got = {r["id"]: (r["other"], -r["score"]) for r in matching.best_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "id", "other", "tokens", often=often).collect()}
    want = brute_best(left, right)
    assert got.keys() == want.keys() and "only" in got
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def test_best_match_meets_in_blocks(spark):
    """Many small blocks give what brute force gives; a row with more pairs than may be held is counted token by token, and no rows of pairs are shuffled."""
    rng = random.Random(8)
    right = [(i, [f"t{rng.randrange(40)}" for _ in range(rng.randrange(9))]) for i in range(150)]
    left = [(i, [f"t{rng.randrange(50)}" for _ in range(rng.randrange(12))]) for i in range(90)] + [(None, ["t1"])]
    schema = "id long, tokens array<string>"
    found = matching.best_match(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "id", "other", "tokens", block=100)
    got = {r["id"]: (r["other"], -r["score"]) for r in found.collect()}
    assert got == brute_best(left[:-1], right)
    rows = [pd.DataFrame([(i, len(set(ts)), int(t[1:])) for i, ts in side for t in sorted(set(ts))], columns=["_id", "_n", "_k"]) for side in (left[:-1], right)]
    for most in (1, 50, 10_000):
        assert {r[0]: (r[1], -r[2]) for r in matching._best_of_block(*rows, 1, most).itertuples(index=False)} == got
