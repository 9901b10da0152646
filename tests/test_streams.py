"""Streams against batches: tracks, upserts that can be done again, changes, progress."""

import random
import time

from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.streaming import tracks, upserts

BOXES = "video long, frame long, item long, x double, y double, area double, at timestamp"


def boxes(spark, frames):
    rng = random.Random(4)
    rows = [(v, f, i, rng.random(), rng.random(), rng.random()) for v in range(3) for f in frames for i in range(4)]
    return spark.createDataFrame([(*r, None) for r in rows], BOXES).withColumn("at", F.timestamp_seconds(F.col("frame") + 1_000_000))


def run(spark, folder, out, state, how):
    stream = spark.readStream.schema(BOXES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    query = how(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(240) and query.exception() is None


def test_tracks_as_a_stream_equal_those_of_a_batch(spark, tmp_path):
    """Batches of frames in order give the batch's tracks, also over a restart; a frame that comes again is late."""
    whole = boxes(spark, range(12))
    how = lambda s: tracks.stream_tracks(s, "video", "at", far=0.3, memory=2, late="1 hour")
    for i, (low, high) in enumerate([(0, 4), (4, 9)]):
        whole.where(f"frame >= {low} and frame < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(1.1)  # files are read in the order of their times
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", how)
    whole.where("frame = 3 or frame >= 9").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", how)
    got = spark.read.parquet(f"{tmp_path}/out")
    want = folds.track(whole, ["video"], far=0.3, memory=2)
    columns = ["video", "frame", "item", "track"]
    assert sorted(map(tuple, got.where("track >= 0").select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    late = got.where("track < 0").collect()
    assert len(late) == 12 and {r["frame"] for r in late} == {3}


SCHEMA = "id long, v long, text string"


def test_upserts_done_again_change_nothing(spark, tmp_path):
    path, changes = f"{tmp_path}/table", f"{tmp_path}/changes"
    schema = f"{SCHEMA}, removed boolean"

    def put(batch, rows):
        upserts.upsert(spark.createDataFrame(rows, schema), batch, path, "id", "v", changes=changes, buckets=4)

    def now():
        return sorted(map(tuple, upserts.current(spark, path, SCHEMA).collect()))

    assert now() == []
    first = [(1, 1, "a", None), (2, 1, "b", False), (2, 2, "b2", None), (None, 9, "x", None)]
    second = [(1, 5, "a5", None), (1, 4, "a4", None), (2, 9, None, True), (3, 1, None, None), (7, 1, "gone before it came", True)]
    put(0, first)
    assert now() == [(1, 1, "a"), (2, 2, "b2")]
    put(1, second)
    after = now()
    assert after == [(1, 5, "a5"), (3, 1, None)]
    put(2, [(2, 8, "too old", None), (1, 5, "a6", None)])
    assert now() == after
    # the last batches again, as after a lost driver: the same table and the same changes
    put(1, second)
    put(2, [(2, 8, "too old", None), (1, 5, "a6", None)])
    assert now() == after
    put(3, [])
    found = sorted((r["batch"], r["id"], r["change"]) for r in spark.read.parquet(changes).collect())
    assert found == [(0, 1, "added"), (0, 2, "added"), (1, 1, "changed"), (1, 2, "removed"), (1, 3, "added")]


def test_a_restarted_stream_goes_on(spark, tmp_path):
    log = upserts.ProgressLog(most=50)
    spark.streams.addListener(log)
    schema = f"{SCHEMA}, removed boolean"
    try:
        for i in range(3):
            spark.createDataFrame([(k, i, f"{k}-{i}", k == 4 and i == 2) for k in range(i, 6)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
            query = upserts.stream_upserts(stream, f"{tmp_path}/table", f"{tmp_path}/state", "id", "v", buckets=3)
            assert query.awaitTermination(240) and query.exception() is None
        assert sorted(map(tuple, upserts.current(spark, f"{tmp_path}/table", SCHEMA).collect())) == [(0, 0, "0-0"), (1, 1, "1-1"), (2, 2, "2-2"), (3, 2, "3-2"), (5, 2, "5-2")]
        for _ in range(50):
            if sum(r[2] for r in log.rows) == 15:
                break
            time.sleep(0.2)
        assert spark.createDataFrame(log.rows, upserts.ProgressLog.SCHEMA).agg(F.sum("rows")).first()[0] == 15
    finally:
        spark.streams.removeListener(log)
