"""What the corpus operators share: scratch tables, bounded word caches, hash mixing, ranks without hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of every operator here: maximal runs without ASCII white space. bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: The folder of this driver where the cluster names none
_OWN_ROOT: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a local one only where that is unset on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append(f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}")
        root = _OWN_ROOT[0]
    return root


#: Spark's setting that removes a query's shuffle files when the query has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, *done: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, keeps column pruning.

    by: columns that name folders; a filter on them reads only its own.
    Its shuffle files go once it is written. The table stays until the driver ends, as the frames that read it are
    lazy, unless it is named in a later call's `done`: tables that nothing will read any more, deleted after the write.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for table in done:
        _drop(spark, table._scratch)
    return out


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended: nothing is left to tidy with
        return


def drop_table(table: DataFrame, folder: str = "") -> None:
    """Deletes a materialized table, or one folder of it, that nothing reads any more."""
    _drop(table.sparkSession, f"{table._scratch}/{folder}".rstrip("/"))


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo: the splits into learned and held-out rows; null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string")) % modulus


def hash_share(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the row's values: sampling and shuffling that reruns repeat."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


# ---------------------------------------------------------------- hashing in numpy

_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over the whole word."""
    x = x ^ (x >> _S)
    x = x * _A
    x ^= x >> _S
    x *= _B
    x ^= x >> _S
    return x


class WordCache:
    """Rows of numbers by word, computed for many new words at once and kept up to a bound.

    compute(list of new words) returns an array with a row for each. A full cache starts anew, so memory
    stays bounded whatever the vocabulary; results don't depend on what it holds.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], limit: int = 400_000, longest: int = 200):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.index: dict = {}
        self.rows: np.ndarray | None = None
        self.used = 0

    def rows_of(self, documents: list[list]) -> list[np.ndarray]:
        """For each document (a list of words), the row numbers of its words in self.rows."""
        if len(self.index) > self.limit:
            self.index, self.rows, self.used = {}, None, 0
        new = list(set().union(*documents).difference(self.index))
        if new or self.rows is None:
            values = np.asarray(self.compute(new))
            if self.rows is None:
                self.rows = np.zeros((max(1024, len(new)),) + values.shape[1:], values.dtype)
            if self.used + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), self.used + len(new)),) + values.shape[1:], values.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : self.used + len(new)] = values
            self.index.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        at = self.index.__getitem__
        found = [np.fromiter(map(at, words), np.int64, len(words)) for words in documents]
        for word in new:
            if len(word) > self.longest:  # long words stay out of the cache; their rows go when it starts anew
                del self.index[word]
        return found


def groups_of(items: Iterable, weight: Callable, most: int = 1 << 20, rows: int = 256) -> Iterable[list]:
    """Consecutive items in lists of bounded total weight, one item at least."""
    part, total = [], 0
    for item in items:
        part.append(item)
        total += weight(item)
        if total >= most or len(part) >= rows:
            yield part
            part, total = [], 0
    if part:
        yield part


# ---------------------------------------------------------------- ranks and running sums without hot keys


def running_start(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, into: str, ties: tuple[str, ...] = (), per_bucket: int = 2048) -> DataFrame:
    """Adds `into`: the sum of `value` over the rows of the same keys that come earlier in a fixed shuffled order.

    The order is by hash of `order`, then `order`, then `ties`. Rows are dealt by keys and hash range, so that even one
    key with most rows spreads over many tasks; only sums by range meet under a key. `keys` hold no nulls.
    df is read twice: pass a materialized frame. rows: its count, which sets the number of ranges.
    """
    buckets = max(1, rows // per_bucket)
    at = df.withColumn("_h", F.pmod(F.xxhash64(F.lit(17), *order), F.lit(1 << 40))).withColumn("_b", F.floor(F.col("_h") * buckets / F.lit(1 << 40)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*keys, "_b").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*keys, "_b").orderBy("_h", *order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    local = at.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(sums, [*keys, "_b"]).withColumn(into, F.col("_base") + F.col("_local")).drop("_h", "_b", "_base", "_local")


# ---------------------------------------------------------------- words of many texts at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): hashes of the words of all texts in a row, and where each text's words begin, with the end last.

    lower: A to Z count as a to z. Equal words have equal hashes, in every process.
    """
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    space = _SPACE[data]
    at = np.flatnonzero(~space)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    begins = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1))
    sizes = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, sizes)
    letters = _LOWER[data[at]] if lower else data[at]
    points = (place.astype(np.uint64) << np.uint64(8)) | letters
    hashes = mix(np.add.reduceat(mix(points * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), begins))
    first = np.concatenate(([0], np.searchsorted(at[begins], ends)))
    return hashes, first
