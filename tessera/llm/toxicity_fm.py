"""Toxicity: a factorization machine over hashed terms, so that pairs of terms count beyond their sum.

Stems of a text are its words (runs of letters, lower-cased) and their first 4 to 7 letters. A stem gives up to four
hashed terms: that it occurs, that it occurs twice, and that it does so at least once in 128 or in 64 words, since one
chance hit in a long text says less than a dense run. Each term that at least two learned rows hold is an input of
the machine, however many rows or terms there are. An input's value is how strongly it goes with the label, or its
share of rows if that is more: so the many rare terms that say nothing can't learn the rows by heart, while a word of a
few rows, all toxic, counts in full, and so do common words that matter in pairs only.
log-odds = bias + sum of w_i * x_i + sum over pairs of <v_i, v_j> * x_i * x_j. Trained by AdaGrad over
mini-batches in numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordCache, groups_of
from tessera.llm.quality_embed import labelled_sample

WORDS = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)
LEVELS = 4
LEAST = 2  # rows that hold a term; a term of one row tells that row only
STRONG = 25.0  # chi square from which a term's value is 1: five deviations


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def stems(words: list[str]) -> np.ndarray:
    """For each word, the hashes of its stems; 0 where the word is too short for one."""
    name = xxhash.xxh3_64_intdigest
    rows = [[name(w), *(name(w[:n] + "*") if len(w) > n else 0 for n in STEMS)] for w in words]
    return np.array(rows, np.uint64).reshape(-1, 1 + len(STEMS))


def levels(counts: np.ndarray, words: int) -> np.ndarray:
    """For each stem's count, which of its terms hold: occurs, twice, once in 128 words, once in 64."""
    twice = counts >= 2
    return np.column_stack([counts >= 1, twice, twice & (128 * counts >= words), twice & (64 * counts >= words)])


class ToxicityModel:
    """names: sorted hashes of the stems in use; inputs[stem, level]: input number or -1; weights and factors by input, times its value."""

    def __init__(self, texts: list[str], labels: list[int], dim: int = 4, epochs: int = 12, rate: float = 0.1, decay: float = 2e-3, seed: int = 11):
        y = np.array(labels, float)
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.bias, self.names = float(np.log(share / (1 - share))), np.zeros(0, np.uint64)
        self.inputs, self.weights, self.factors = np.zeros((0, LEVELS), np.int64), np.zeros(0), np.zeros((0, dim))
        if not len(y):
            return
        cache, bags = WordCache(stems), []
        for text in texts:
            counted = Counter(words_of(text))
            at = cache.rows_of([list(counted)])[0]
            names, back = np.unique(cache.rows[at].ravel(), return_inverse=True)
            times = np.bincount(back, np.repeat(np.fromiter(counted.values(), float, len(counted)), 1 + len(STEMS)), len(names)) if len(names) else np.zeros(0)
            bags.append((names[names > 0], times[names > 0], sum(counted.values())))
        names, df = np.unique(np.concatenate([b[0] for b in bags]), return_counts=True)
        names = names[df >= LEAST]
        if not len(names):
            return
        flags, owner = [], []
        for i, (own, times, words) in enumerate(bags):
            at = np.searchsorted(names, own)
            known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == own)
            terms = (at[known, None] * LEVELS + np.arange(LEVELS))[levels(times[known], words)]
            flags.append(terms)
            owner.append(np.full(len(terms), i))
        terms, owner = np.concatenate(flags), np.concatenate(owner)
        df = np.bincount(terms, minlength=len(names) * LEVELS)
        expected = df * share
        spread = np.maximum(expected * (1 - share) * (1 - df / (len(y) + 1)), 1e-9)
        chi = (np.bincount(terms, y[owner], len(df)) - expected) ** 2 / spread
        good = np.flatnonzero(df >= LEAST)
        value = np.maximum(np.minimum(1, chi[good] / STRONG), df[good] / len(y))
        number = np.full(len(df), -1)
        number[good] = np.arange(len(good))
        used = np.unique(good // LEVELS)
        self.names, self.inputs = names[used], number.reshape(-1, LEVELS)[used]
        self._train([number[t][number[t] >= 0] for t in flags], y, value, dim, epochs, rate, decay, seed)

    def _train(self, bags: list[np.ndarray], y: np.ndarray, value: np.ndarray, dim: int, epochs: int, rate: float, decay: float, seed: int) -> None:
        rng, n = np.random.default_rng(seed), len(value)
        w, v, b = np.zeros(n), rng.normal(0, 0.01, (n, dim)), self.bias
        gw, gv, gb = np.full(n, 1e-3), np.full((n, dim), 1e-3), 1e-3
        # rows are dealt to batches once, so that what a batch holds is found once: its inputs, and its rows' places among them
        order, batches = rng.permutation(len(bags)), []
        for start in range(0, len(order), 64):
            chosen = order[start : start + 64]
            at, slot = np.unique(np.concatenate([bags[i] for i in chosen]), return_inverse=True)
            row = np.repeat(np.arange(len(chosen), dtype=np.int32), [len(bags[i]) for i in chosen])
            batches.append((chosen, at, slot.astype(np.int32), row))
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                chosen, at, slot, row = batches[k]
                x = value[at]
                own = v[at] * x[:, None]
                sums = np.column_stack([np.bincount(row, own[slot, d], len(chosen)) for d in range(dim)])
                single = w[at] * x - 0.5 * (own**2).sum(1)
                z = b + np.bincount(row, single[slot], len(chosen)) + 0.5 * (sums**2).sum(1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
                total = np.bincount(slot, error[row], len(at))
                pull = np.column_stack([np.bincount(slot, (error * sums[:, d])[row], len(at)) for d in range(dim)])
                dw = x * total + decay * w[at] / 64
                dv = x[:, None] * (pull - total[:, None] * own) + decay * v[at] / 64
                gw[at] += dw**2
                gv[at] += dv**2
                gb += error.sum() ** 2
                w[at] -= rate * dw / np.sqrt(gw[at])
                v[at] -= rate * dv / np.sqrt(gv[at])
                b -= rate * error.sum() / np.sqrt(gb)
        self.weights, self.factors, self.bias = w * value, v * value[:, None], float(b)

    def places(self, words: list[str]) -> np.ndarray:
        """For each word, the numbers of its stems in use; the number of stems for the others."""
        wanted = stems(words)
        if not len(self.names):
            return np.zeros(wanted.shape, np.int64)
        at = np.minimum(np.searchsorted(self.names, wanted), len(self.names) - 1)
        return np.where(self.names[at] == wanted, at, len(self.names))

    def score(self, places: np.ndarray, words: int) -> float:
        """places: those of all words of a text."""
        own, counts = np.unique(places, return_counts=True)
        known = own < len(self.names)
        found = self.inputs[own[known]][levels(counts[known], words)]
        found = found[found >= 0]
        v = self.factors[found]
        z = self.bias + self.weights[found].sum() + 0.5 * float((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = 8000, most_chars: int = 30_000_000) -> ToxicityModel:
    """Learns from a bounded sample of labelled rows (see labelled_sample).

    The driver holds the sample's terms: about 30 bytes for each of a row's distinct terms, of which `most_chars` characters have at most some 20 million.
    """
    return ToxicityModel(*labelled_sample(docs, labels, label, learn, most, most_chars))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with double column `score`: the probability of label 1, for every row, from the whole text alone.

    Null, empty and blank texts have no term and get the bias alone. A model learned from no rows answers 0.5.
    Other columns pass through; one named `score` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        cache = WordCache(own.places)
        for texts in batches:
            out = []
            for part in groups_of(texts, lambda t: len(t or "")):
                for at in cache.rows_of([words_of(t) for t in part]):
                    out.append(own.score(cache.rows[at], len(at)))
            yield pd.Series(out, dtype="float64")

    return docs.withColumn("score", F.pandas_udf(scores, "double")("text"))
