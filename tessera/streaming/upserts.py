"""A table kept up to date by a stream: each micro-batch writes a version of the parts it touches; a batch done again changes nothing.

Layout: path/v=<batch id>/bucket=<b>/*.parquet. Rows belong to a bucket by the hash of their key; a batch rewrites the buckets it touches, so
that the work of a batch follows its keys, not the table. A version counts once its folder has _SUCCESS, which the
writer adds last; the newest such version of each bucket is the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return [s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix)]


def _done(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _newest(spark: SparkSession, path: str, before: int | None) -> dict[int, str]:
    """The folder of the newest version of each bucket, of batches before `before` if that is given."""
    found: dict[int, tuple[int, str]] = {}
    for version in _folders(spark, path, "v="):
        batch = int(version.rsplit("v=", 1)[1])
        if (before is None or batch < before) and _done(spark, version):
            for folder in _folders(spark, version, "bucket="):
                bucket = int(folder.rsplit("bucket=", 1)[1])
                found[bucket] = max(found.get(bucket, (-1, "")), (batch, folder))
    return {b: folder for b, (_, folder) in found.items()}


def stored_rows(spark: SparkSession, path: str, schema: str, *, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """All rows, removed ones too, as the batches done so far have left them; of some buckets only, or before a batch."""
    folders = [f for b, f in _newest(spark, path, before).items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table (columns of schema) as the batches done so far have left it."""
    return stored_rows(spark, path, f"{schema}, removed boolean").where("not removed").drop("removed")


def upsert(batch: DataFrame, batch_id: int, path: str, key: str, order: str, *, changes: str | None = None, buckets: int = 64) -> None:
    """Puts the newest row (by `order`) of each key of the batch in place of the stored one, unless that is as new or newer.

    batch: the table's columns and `removed` (boolean: the key goes; a null is no). Done twice, a batch reads the same versions before it and overwrites its own. changes: a
    folder that gets key, change (added, changed, removed) and batch for each key whose row differs, under batch=<id>, overwritten likewise. Rows with a null key
    don't count; ties of `order` go to the largest row. A removed key keeps a row (removed = true), so that an older row that arrives later doesn't bring it back;
    readers leave those out.
    """
    columns = [c for c in batch.columns if c != "removed"]
    kept = [*columns, "removed"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.select(kept).schema)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = batch.where(F.col(key).isNotNull()).select(*columns, F.coalesce("removed", F.lit(False)).alias("removed"))
    whole = F.struct(order, *[c for c in kept if c not in (order, key)])
    # the batch is read once: it comes from the stream's sources
    newest = rows.groupBy(key).agg(F.max(whole).alias("_new")).withColumn("bucket", bucket).persist()
    try:
        touched = [r["bucket"] for r in newest.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if touched:
            _put(newest, batch_id, path, key, order, schema, touched, changes, kept, whole, bucket)
    finally:
        newest.unpersist()


def _put(newest: DataFrame, batch_id: int, path: str, key: str, order: str, schema: str, touched: list[int], changes: str | None, kept: list[str], whole, bucket) -> None:
    stored = stored_rows(newest.sparkSession, path, schema, buckets=touched, before=batch_id).select(key, whole.alias("_old"))
    both = stored.join(newest.drop("bucket"), key, "full_outer")
    newer = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col(f"_new.{order}") > F.col(f"_old.{order}")))
    row = F.when(newer, F.col("_new")).otherwise(F.col("_old"))
    after = both.select(key, "_old", row.alias("_row")).persist()
    try:
        out = after.select(*(F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in kept)).withColumn("bucket", bucket)
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
        if changes:
            was, is_ = F.col("_old").isNotNull() & ~F.col("_old.removed"), ~F.col("_row.removed")
            change = F.when(was & ~is_, "removed").when(~was & is_, "added").when(was & is_ & (F.col("_old") != F.col("_row")), "changed")
            after.select(key, change.alias("change")).where("change is not null").write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")
    finally:
        after.unpersist()


def stream_upserts(events: DataFrame, path: str, checkpoint: str, key: str, order: str, *, changes: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Starts a query that upserts what is there and ends; started again, it goes on behind the last batch that was done."""

    def put(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, path, key, order, changes=changes, buckets=buckets)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressLog(StreamingQueryListener):
    """Rows of the progress of all queries of a session, for spark.createDataFrame(log.rows, ProgressLog.SCHEMA); the last `most` of them."""

    SCHEMA = "query string, batch long, rows long, seconds double"

    def __init__(self, most: int = 10_000):
        self.rows: list[tuple] = []
        self.most = most

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows = [*self.rows, (str(p.id), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
