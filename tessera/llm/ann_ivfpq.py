"""Approximate nearest neighbours by cosine: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Vectors are scaled to length 1. Coarse centroids and the codebooks of the residuals are learned on a bounded sample;
every distinct vector is indexed under its nearest centroid as a few bytes. A query visits its nearest lists
with a table of distances from its residual to each codeword (asymmetric distances), keeps the best classes
over all its lists, and these are ranked anew by the exact measure on the original vectors. How many lists are
visited is fitted on the sample, by exact search in it.

Equal vectors form one class in the index, with as many of its smallest ids as an answer can need: thousands of
copies neither fill one list nor crowd other candidates out. Lists are dealt into shards, shards cut into blocks of
vectors; a query is sent once to each shard that has a list for it, and a block of vectors meets each block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import hash_share, materialize


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centroids; an empty one starts anew at a random row."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        sums = np.column_stack([np.bincount(near, column, k) for column in x.T])
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(((centres**2).sum(1)) - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.zeros(0, int)


class IvfPq:
    """coarse: list centroids; books[j]: codewords of the j-th part of a residual."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, words: int = 256, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.parts, self.dim = parts, sample.shape[1]
        self.width = -(-self.dim // parts)
        self.coarse = kmeans(sample, lists, 12, rng)
        rest = self._split(sample - self.coarse[nearest(sample, self.coarse)])
        self.books = [kmeans(rest[:, j], words, 12, rng) for j in range(parts)]

    def _split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * self.width), x.dtype)
        padded[:, : self.dim] = x
        return padded.reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of unit vectors."""
        at = nearest(x, self.coarse)
        rest = self._split(x - self.coarse[at])
        return at, np.column_stack([nearest(rest[:, j], book) for j, book in enumerate(self.books)]).astype(np.uint8)

    def probes(self, x: np.ndarray, many: int) -> np.ndarray:
        far = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        return np.argsort(far, axis=1, kind="stable")[:, :many]

    def reach(self, sample: np.ndarray, top: int, share: float, asks: int = 256, seed: int = 5) -> int:
        """How many lists must be visited to find this share of the nearest sampled vectors of sampled queries."""
        rng, at = np.random.default_rng(seed), nearest(sample, self.coarse)
        own = rng.choice(len(sample), min(asks, len(sample)), replace=False)
        near = sample[own] @ sample.T
        near[np.arange(len(own)), own] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, : min(top, len(sample) - 1)]
        place = np.argsort(self.probes(sample[own], len(self.coarse)), axis=1)  # of each list in a query's order of visits
        ranks = np.take_along_axis(place, at[best], 1).ravel() + 1
        return int(np.ceil(np.quantile(ranks, share))) if len(ranks) else 1

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to the coded vectors of list `at`."""
        rest = self._split(queries - self.coarse[at])
        out = np.zeros((len(queries), len(codes)), np.float32)
        for j, book in enumerate(self.books):
            table = ((rest[:, j, None, :] - book[None]) ** 2).sum(2).astype(np.float32)
            out += table[:, codes[:, j]]
        return out

    def closest(self, queries: np.ndarray, visits: list[np.ndarray], lists: np.ndarray, codes: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the `keep` nearest coded rows of each query among those in lists that it visits; rows are sorted by list."""
        far = np.full((len(queries), len(codes)), np.inf, np.float32)
        owner, wanted = np.repeat(np.arange(len(queries)), [len(v) for v in visits]), np.concatenate(visits)
        order = np.argsort(wanted, kind="stable")
        owner, wanted = owner[order], wanted[order]
        for at in np.unique(lists):
            asking = owner[np.searchsorted(wanted, at) : np.searchsorted(wanted, at, side="right")]
            here = slice(np.searchsorted(lists, at), np.searchsorted(lists, at, side="right"))
            if len(asking):
                far[asking, here] = self.distances(queries[asking], int(at), codes[here])
        some = np.argpartition(far, keep - 1, axis=1)[:, :keep] if keep < far.shape[1] else np.broadcast_to(np.arange(far.shape[1]), far.shape)
        value = np.take_along_axis(far, some, 1)
        query, place = np.nonzero(np.isfinite(value))
        return query, some[query, place], value[query, place]


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, queries: Column, top: int = 5, lists: int | None = None, probes: int | None = None, parts: int = 16, keep: int | None = None, sample: int = 20_000, block: int = 16_384, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) where `queries` holds, its nearest other rows.

    score: cosine in double precision on the original vectors; nearest first, ties to the smaller vec_id.
    All candidates if there are fewer than `top`. Rows whose id or embedding is null, or whose embedding holds a null or
    non-finite number, is all zeros, or hasn't the most frequent length, take no part. Repeated rows of an id count once.
    Other columns are ignored. Defaults: 2 * sqrt(rows) lists, as far as the sample holds 20 rows a list; as many of them
    are visited as 0.95 of the nearest sampled vectors need, 24 at least; 100 classes are ranked anew, more as the fourth
    root of the rows above 2000. `sample` bounds what the driver learns from, and so the model that is sent to the tasks.
    """
    spark = vectors.sparkSession
    fine = vectors.where("vec_id is not null").where(_usable(F.col("embedding")))
    sizes = fine.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = sizes[0]["d"], sizes[0]["n"]
    fine = fine.where(F.size("embedding") == dim).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks"))
    fine = fine.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    fine = materialize(fine)
    # the smallest ids of each class, first among a slice of it, so that no class meets in one task
    salted = Window.partitionBy("h", "g", "slice").orderBy("vec_id")
    some = fine.select("vec_id", "h", "g", "v").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.dense_rank().over(salted)).where(F.col("r") <= top + 1).dropDuplicates(["vec_id", "h", "g"])
    members = some.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    members = materialize(members.select("vec_id", "h", "g", "r", "v"))
    reps = members.where("r = 1").select(F.col("vec_id").alias("rep"), "v")
    distinct = reps.count()
    learned = reps.where(hash_share("rep", seed=8) < min(1.0, sample / distinct)).select("v", "rep").toPandas().sort_values("rep")
    if len(learned) == 0:
        learned = reps.limit(sample).toPandas()
    lists = lists or max(1, min(round(2 * math.sqrt(distinct)), len(learned) // 20 or 1))
    units = _unit(learned["v"])
    model = IvfPq(units, lists, min(parts, dim))
    lists = len(model.coarse)
    probes = min(lists, probes or max(24, model.reach(units, top, 0.95)))
    keep = keep or math.ceil(100 * max(1.0, distinct / 2000) ** 0.25)
    shards = -(-distinct // block)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                at, codes = shared.value.encode(_unit(b["v"]))
                yield pd.DataFrame({"list": at, "rep": b["rep"], "codes": [c.tobytes() for c in codes]})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = shared.value.probes(_unit(b["v"]), probes)
                rows = []
                for query, v, own in zip(b["vec_id"], b["v"], near, strict=True):
                    shard = own % shards
                    rows += [(x, query, v, own[shard == x]) for x in np.unique(shard)]
                yield pd.DataFrame(rows, columns=["shard", "query_id", "q", "visits"])

    index = materialize(reps.mapInPandas(encode, "list int, rep long, codes binary"))
    asked = fine.where("asks").select("vec_id", "v", "h", "g").dropDuplicates(["vec_id"])
    asked = materialize(asked)
    # equal queries are answered once, as their class
    classes = asked.join(members.where("r = 1").select("h", "g", F.col("vec_id").alias("rep")), ["h", "g"]).select("vec_id", "rep", "v")
    classes = materialize(classes)
    visits = materialize(classes.dropDuplicates(["rep"]).select(F.col("rep").alias("vec_id"), "v").mapInPandas(visit, "shard int, query_id long, q array<double>, visits array<int>"))
    index = index.withColumn("shard", F.col("list") % shards)
    held = index.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    waiting = visits.groupBy("shard").agg(F.ceil(F.count("*") / query_block).cast("int").alias("groups"))
    cut = held.join(waiting, "shard")

    def pick(many: Column, by: str) -> Column:
        return F.pmod(F.xxhash64(by), many).cast("int")

    left = index.join(cut, "shard").select("shard", pick(F.col("blocks"), "rep").alias("b"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "list", "rep", "codes")
    right = visits.join(cut, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), pick(F.col("groups"), "query_id").alias("g"), "query_id", "q", "visits")

    def meet(coded: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(coded) or not len(asking):
            return pd.DataFrame({"query_id": [], "rep": [], "far": []})
        coded = coded.sort_values(["list", "rep"])
        codes = np.frombuffer(b"".join(coded["codes"]), np.uint8).reshape(len(coded), -1)
        query, row, far = shared.value.closest(_unit(asking["q"]), list(asking["visits"]), coded["list"].to_numpy(), codes, keep)
        return pd.DataFrame({"query_id": asking["query_id"].to_numpy()[query], "rep": coded["rep"].to_numpy()[row], "far": far.astype(np.float64)})

    key = ["shard", "b", "g"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, rep long, far double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "rep"))).where(F.col("r") <= keep)
    best = materialize(best.select(F.col("query_id").alias("q_rep"), "rep"))
    # exact measure between classes, then their members
    by_rep = reps.select("rep", "v")
    scored = best.join(by_rep.toDF("rep", "x"), "rep").join(by_rep.toDF("q_rep", "y"), "q_rep").select("q_rep", "rep", cosine(F.col("x"), F.col("y")).alias("score"))
    first = Window.partitionBy("q_rep").orderBy(F.desc("score"), "rep")
    scored = scored.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top + 1).select("q_rep", "rep", "score")
    named = members.select("h", "g", F.col("vec_id").alias("id")).join(members.where("r = 1").select("h", "g", F.col("vec_id").alias("rep")), ["h", "g"]).select("rep", "id")
    answers = scored.join(named, "rep").withColumn("r", F.row_number().over(Window.partitionBy("q_rep").orderBy(F.desc("score"), "id"))).where(F.col("r") <= top + 1)
    answers = materialize(answers.select("q_rep", "id", "score"))
    out = classes.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q_rep")).join(answers, "q_rep").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
