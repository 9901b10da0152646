"""Profiles, quality, cut findings and pruning on small cases with nulls, ties and empty tables."""

from pyspark.sql import functions as F

from tessera.plans import reviews


def test_profile(spark):
    rows = [("p", 3, 1.0, "left"), ("p", 1, None, "right"), ("p", 2, float("nan"), "left"), ("p", 4, 3.0, "right"), (None, 5, None, None)]
    df = spark.createDataFrame(rows, "k string, o long, area double, side string")
    got = {r["k"]: tuple(r)[1:] for r in reviews.profile(df, ["k"], "o", means=["area"], labels=["side"]).collect()}
    assert got == {"p": (4, 2.0, "right", "left:2,right:2"), None: (1, None, "unknown", "unknown:1")}
    assert reviews.profile(df, [], "o", means=["area"], labels=["side"]).first()["n"] == 5
    assert reviews.profile(df.limit(0), ["k"], "o", means=["area"], labels=["side"]).collect() == []


def test_quality(spark):
    df = spark.createDataFrame([(0.5, 0.36, 900.0, 5, 0.12, 0.18, 0.0, 0.0), (None,) * 8, (0.0, 9.9, 0.0, 0, 0.0, 0.0, 1.0, 1.0)], "brightness double, saturation double, sharpness double, faces int, face_area double, motion double, camera_motion double, scene_motion double")
    got = df.select(reviews.quality(reviews.FRAME_PARTS).alias("f"), reviews.quality(reviews.SAMPLE_PARTS).alias("s")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.87857), (0.0, 0.28), (0.15, 0.04)]


def test_cut_findings(spark):
    plan = [("a", 0, 100, "m"), ("a", 100, 108, "c"), ("a", 108, 200, "m"), ("a", 200, 300, "m"), ("b", 0, 5, "m")]
    got = reviews.cut_findings(spark.createDataFrame(plan, "k string, s long, e long, role string"), spark.createDataFrame([("a", 104), ("a", 104), ("a", 300)], "k string, s long"), ["k"], near=5, align=3, short=10)
    assert sorted(map(tuple, got.collect())) == [("a", "clustered", 100, 108, 4), ("a", "not_aligned", 100, 104, 4), ("a", "not_aligned", 108, 104, 4), ("a", "short_near_cut", 100, 108, 4)]


def test_pruning(spark):
    df = spark.createDataFrame([(1, None), (2, " ..!"), (3, "Hm!"), (4, "order 66 now"), (5, "a fine text")], "i long, x string")
    got = {r["i"]: (r["r"], r["s"]) for r in df.select("i", reviews.prune_reason(F.col("x"), [("numbers", "[0-9]+")], least=3).alias("r"), reviews.editorial_score(F.col("x"), {"a": (0.7, ["fine", "order"]), "b": (0.6, ["text"])}, base=0.1).alias("s")).collect()}
    assert {i: r for i, (r, _) in got.items()} == {1: "empty", 2: "empty", 3: "short", 4: "numbers", 5: None}
    assert got[5][1] == 1.0 and abs(got[4][1] - 0.8) < 1e-12


def test_summaries(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("inf")), ("a", 3.0), ("b", float("nan"))], "k string, v double")
    assert sorted(map(tuple, reviews.summaries(df, ["k"], ["v"]).collect())) == [("a", 2, 2.0, 3.0, 1.0), ("b", 0, None, None, None)]
