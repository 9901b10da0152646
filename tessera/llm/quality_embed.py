"""Quality classifier: supervised subword embeddings, averaged over a document, with a softmax on top.

Features are hashed into a table of learned vectors: words (runs without ASCII white space, case kept), their character
3- to 5-grams between marks, pairs of neighbouring words, and for three words in a row which of them are equal: a
word n-gram without its words, since what a text repeats need not occur in any learned row. Each feature counts once.
Vectors and output weights are trained by stochastic gradient descent in numpy. For scoring, each bucket's vector is
folded with the output weights into one number, so that a document needs sums of numbers only, most of them
cached by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordCache, groups_of, hash_share, materialize, mix

#: Buckets kept for three words in a row: all differ, the last two equal, the first two, the outer two, all equal
PATTERNS = 5
_EXACT = np.uint64((1 << 50) - 1)  # names that a double holds exactly


def features(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, name): every feature of single words with the place of its word, and a number that names each word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    plain = [w.decode() for w in words]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
    data = np.frombuffer(("<" + "><".join(plain) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(plain)), sizes)
    place_left = (first + sizes)[owner] - np.arange(len(data))
    out, of = [], []
    for n in (3, 4, 5):
        count = len(data) - n + 1
        if count <= 0:
            break
        name = np.full(count, n, np.uint64)
        for j in range(n):
            name = name * np.uint64(0x100000001B3) + data[j : j + count] + np.uint64(1)
        ok = place_left[:count] >= n
        out.append(mix(name[ok]))
        of.append(owner[:count][ok])
    # the whole word: a position-weighted sum of its characters
    power = mix(np.arange(len(data), dtype=np.uint64) - first[owner].astype(np.uint64))
    whole = np.add.reduceat(mix(data + power), first)
    out.append(mix(whole + np.uint64(77)))
    of.append(np.arange(len(plain)))
    return (np.concatenate(out) % np.uint64(buckets - PATTERNS)).astype(np.int64) + PATTERNS, np.concatenate(of), whole & _EXACT


def neighbours(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each pair of neighbouring words, how often each pattern of three words occurs), from the words' names."""
    left, right = names[:-1], names[1:]
    pairs = (mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right)) % np.uint64(buckets - PATTERNS)).astype(np.int64) + PATTERNS
    same = (left == right).astype(np.int64)
    outer = (names[:-2] == names[2:]).astype(np.int64)
    kind = np.where(same[:-1] & same[1:], 4, np.where(outer, 3, same[:-1] * 2 + same[1:])) if len(names) > 2 else same[:0]
    return pairs, np.bincount(kind, minlength=PATTERNS)


class QualityModel:
    """Folded model: weights[b] is the log-odds that bucket b adds before averaging; bias stands alone."""

    def __init__(self, texts: list[str | None], labels: list[int], buckets: int = 1 << 18, dim: int = 8, epochs: int | None = None, rate: float = 0.6, seed: int = 7):
        self.buckets = buckets
        epochs = epochs or max(6, min(60, 12_000 // max(1, len(texts))))  # few rows are gone through more often
        bags = [self._bag((t or "").encode().split()) for t in texts]
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        out = np.zeros((2, dim), np.float32)
        share = float(np.clip(np.mean(labels), 0.01, 0.99)) if labels else 0.5
        self.bias = float(np.log(share / (1 - share)))
        prior = np.array([0.0, self.bias])
        steps, done = max(1, epochs * len(bags)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                at, weight = bags[i]
                lr = rate * (1 - done / steps)
                done += 1
                if not len(at):
                    continue
                hidden = weight @ vectors[at]
                z = out @ hidden + prior
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                grad = (p @ out).astype(np.float32)
                out -= lr * np.outer(p, hidden).astype(np.float32)
                # the mean shares the gradient among its features by weight; scaled up, as most are rare
                vectors[at] -= (lr * 8) * weight[:, None] * grad
        self.weights = (vectors @ (out[1] - out[0])).astype(np.float64)

    def _bag(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at, _, names = features(words, self.buckets)
        pairs, patterns = neighbours(names, self.buckets)
        keys, counts = np.unique(np.concatenate((at, pairs, np.repeat(np.arange(PATTERNS), patterns))), return_counts=True)
        return keys, counts.astype(np.float32) / max(1.0, counts.sum())

    def table(self, words: list[bytes]) -> np.ndarray:
        """For each word: sum of its features' weights, their number, and the word's name."""
        at, of, names = features(words, self.buckets)
        return np.column_stack([np.bincount(of, self.weights[at], len(words)), np.bincount(of, minlength=len(words)), names.astype(np.float64)])

    def score(self, rows: np.ndarray) -> float:
        """The probability of label 1 for a document, from the rows of table() of its words in order."""
        if not len(rows):
            return float(1 / (1 + np.exp(-self.bias)))
        pairs, patterns = neighbours(rows[:, 2].astype(np.uint64), self.buckets)
        total = rows[:, 0].sum() + self.weights[pairs].sum() + patterns @ self.weights[:PATTERNS]
        return float(1 / (1 + np.exp(-self.bias - total / (rows[:, 1].sum() + len(pairs) + patterns.sum()))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, most_chars: int, longest: int = 1_000_000) -> tuple[list[str], list[int]]:
    """Texts and 0/1 labels of about `most` labelled rows and `most_chars` characters at the most, fixed by a hash of doc_id.

    learn: a condition on doc_id. Rows with a null label, or one that isn't 0 or 1, aren't used, nor are texts of more than
    `longest` characters. The sampled ids, of rows that exist, go to every scanning task; all bounds are parameters, so
    that this and the driver's memory are bounded.
    """
    marked = labels.where(F.col(label).isin(0, 1)).where(learn).select("doc_id", F.col(label).cast("int").alias("y"))
    chars = F.coalesce(F.length("text"), F.lit(0))
    known = docs.select("doc_id", chars.alias("chars")).where(F.col("chars") <= longest).join(marked, "doc_id")
    known = materialize(known.groupBy("doc_id", "y").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")))
    sizes = known.agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    if not sizes["n"]:
        return [], []
    share = min(1.0, most / sizes["n"], most_chars / max(1, sizes["chars"]))
    taken = F.broadcast(known.where(hash_share("doc_id", seed=3) < share).select("doc_id", "y"))
    rows = docs.select("doc_id", "text").where(chars <= longest).join(taken, "doc_id").toLocalIterator()
    rows = sorted((r["doc_id"], r["y"], r["text"] or "") for r in rows)
    return [r[2] for r in rows], [r[1] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = 4000, most_chars: int = 16_000_000) -> QualityModel:
    """Learns from a bounded sample of labelled rows (see labelled_sample)."""
    return QualityModel(*labelled_sample(docs, labels, label, learn, most, most_chars))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with double column `score`: the probability of label 1, for every row, from the whole text alone.

    Null, empty and blank texts have no feature and get the learned rows' share of label 1. A model
    learned from no rows answers 0.5. Other columns pass through; one named `score` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        cache = WordCache(own.table)
        for texts in batches:
            out = []
            for part in groups_of(texts, lambda t: len(t or "")):
                split = [t.encode().split() if t else [] for t in part]
                out += [own.score(cache.rows[at]) for at in cache.rows_of(split)]
            yield pd.Series(out, dtype="float64")

    return docs.withColumn("score", F.pandas_udf(scores, "double")("text"))
