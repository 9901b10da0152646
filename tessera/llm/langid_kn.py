"""Language identification: an interpolated Kneser-Ney character model per language in sorted hash arrays.

A text's letters, lower-cased, are read word by word with a mark before and after each word; contexts don't
cross words, so that a word's log-probability is computed once and kept in a bounded cache. The model with
the lowest cross-entropy per character wins. A share of the learned rows is left out of the counts and
calibrates a temperature (for the score) and each language's range of entropies (for rejection).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordCache, groups_of, hash_share, mix

LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"
_START, _END = 2, 3
#: Nats a character by which a text may be stranger than a language's own held-back texts before it is rejected
MARGIN = 1.0


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower()) if text else []


class Marked:
    """Words as rows of marked code points: the gram names that end at each point."""

    def __init__(self, words: list[str], order: int):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(words)), sizes)
        self.place = np.arange(len(self.owner)) - first[self.owner]  # in its word; the start mark is at 0
        points = np.full(len(self.owner), _START, np.uint64)
        points[first + sizes - 1] = _END
        inner = (self.place > 0) & (self.place < sizes[self.owner] - 1)
        points[inner] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        #: tails[n][i]: name of the n+1 points that end at i; 0 where they would begin before the word
        self.tails = [mix(points + np.uint64(0x51ED270B))]
        for n in range(1, order):
            name = np.zeros(len(points), np.uint64)
            name[1:] = mix(self.tails[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + points[1:])
            name[self.place < n] = 0
            self.tails.append(name)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """grams[n], contexts[n]: sorted names of n+1-grams with log-probabilities, of their contexts with log back-off weights."""

    def __init__(self, counts: Counter, order: int = 5, discount: float = 0.75):
        words, weight = list(counts), np.fromiter(counts.values(), float, len(counts))
        text = Marked(words, order)
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = -float(np.log(len(np.unique(text.tails[0])) + 1000))  # the uniform share of a point, seen or not
        for n in range(order):
            ends = np.flatnonzero((text.place > 0) & (text.place >= n))
            keys, at, back = np.unique(text.tails[n][ends], return_index=True, return_inverse=True)
            count, last = np.bincount(back, weight[text.owner[ends]], len(keys)), ends[at]
            if n + 1 < order:
                # below the highest order: in how many longer grams it ends; a gram from a word's start has none, and keeps its count
                longer = np.flatnonzero(text.place > n)
                _, once = np.unique(text.tails[n + 1][longer], return_index=True)
                tails, kinds = np.unique(text.tails[n][longer[once]], return_counts=True)
                if len(tails):
                    at, hit = _find(tails, keys)
                    count = np.where(hit, kinds[at], count)
            context = text.tails[n - 1][last - 1] if n else np.zeros(len(keys), np.uint64)
            names, group = np.unique(context, return_inverse=True)
            off = np.minimum(discount, count)
            total = np.bincount(group, count)
            share = np.bincount(group, off) / total
            lower = np.exp(self._score(text, last))
            self.grams.append((keys, np.log((count - off) / total[group] + share[group] * lower) if len(keys) else np.zeros(0)))
            self.contexts.append((names, np.log(share)))

    def _score(self, text: Marked, at: np.ndarray) -> np.ndarray:
        """Log-probability of the points at `at` by the orders there are."""
        out = np.full(len(at), self.floor)
        for n, ((keys, logs), (contexts, weights)) in enumerate(zip(self.grams, self.contexts, strict=True)):
            if not len(keys):  # no learned word is long enough for this order
                continue
            context = text.tails[n - 1][at - 1] if n else np.zeros(len(at), np.uint64)
            c, known = _find(contexts, context)
            known &= text.place[at] >= n
            g, seen = _find(keys, text.tails[n][at])
            out = np.where(known, np.where(seen, logs[g], weights[c] + out), out)
        return out

    def words(self, text: Marked, many: int) -> tuple[np.ndarray, np.ndarray]:
        """For each word: the sum of its points' log-probabilities, and of their squares."""
        at = np.flatnonzero(text.place > 0)
        p = self._score(text, at)
        return np.bincount(text.owner[at], p, many), np.bincount(text.owner[at], p * p, many)


class LanguageModel:
    """Per-language models with calibration: langs, temperature, mean and deviation of a character's surprise."""

    def __init__(self, rows: list[tuple[str, str]], order: int = 5, calibration: int = 5):
        """rows: (lang, text). Every calibration-th text of a language stays out of its counts, if there are as many."""
        by: dict[str, list[Counter]] = {}
        for lang, text in sorted(rows):
            if words := words_of(text):
                by.setdefault(lang, []).append(Counter(words))
        self.order, self.langs, self.models, aside = order, sorted(by), [], []
        for i, lang in enumerate(self.langs):
            texts = by[lang]
            out = texts[::calibration] if len(texts) >= 2 * calibration else []
            counted: Counter = Counter()
            for j, c in enumerate(texts):
                if not out or j % calibration:
                    counted.update(c)
            self.models.append(KneserNey(counted, order))
            aside += [(i, c) for c in out or texts]
        self.temperature, self.usual = 1.0, [(-model.floor, 1.0) for model in self.models]
        if aside:
            self._calibrate(aside)

    def table(self, words: list[str]) -> np.ndarray:
        """For each word: points, then per language the sums of log-probabilities, then those of squares."""
        if not words:
            return np.zeros((0, 1 + 2 * len(self.langs)))
        text = Marked(words, self.order)
        sums = [m.words(text, len(words)) for m in self.models]
        return np.column_stack([np.bincount(text.owner, minlength=len(words)) - 1, *(s for s, _ in sums), *(s for _, s in sums)])

    def _calibrate(self, aside: list[tuple[int, Counter]]) -> None:
        n, entropies, truth = len(self.langs), [], []
        own: list[list[np.ndarray]] = [[] for _ in self.langs]
        for lang, counts in aside:
            total = (self.table(list(counts)) * np.fromiter(counts.values(), float)[:, None]).sum(0)
            entropies.append(-total[1 : 1 + n] / total[0])
            truth.append(lang)
            own[lang].append(np.array([total[0], total[1 + lang], total[1 + n + lang]]))
        h, truth_at = np.array(entropies), np.array(truth)
        losses = {}
        for t in (1, 2, 4, 8, 16, 32):
            z = -h * t
            z -= z.max(1, keepdims=True)
            losses[t] = float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(h)), truth_at]))
        self.temperature = float(min(losses, key=losses.get))
        for i, parts in enumerate(own):
            if parts:
                points, s, squares = np.sum(parts, 0)
                per_text = [-x[1] / x[0] for x in parts]
                self.usual[i] = (max(-s / points, float(np.quantile(per_text, 0.999))), float(np.sqrt(max(squares / points - (s / points) ** 2, 1e-6))))

    def decide(self, total: np.ndarray) -> tuple[str, float, float, bool]:
        """(language, score, cross-entropy, rejected) from the summed rows of a text's words."""
        if not total[0] or not self.langs:
            return UND, 0.0, 0.0, True
        h = -total[1 : 1 + len(self.langs)] / total[0]
        best = int(h.argmin())
        z = np.exp(-(h - h[best]) * self.temperature)
        mean, deviation = self.usual[best]
        # MARGIN nats (a fixed choice, not fitted) and six deviations of a mean over so many characters above what this language's own texts reach
        return self.langs[best], float(1 / z.sum()), float(h[best]), bool(h[best] > mean + MARGIN + 6 * deviation / np.sqrt(total[0]))


def fit(docs: DataFrame, learn, chars_per_lang: int = 1_500_000, order: int = 5, most_chars: int = 60_000_000, longest: int = 1_000_000) -> LanguageModel:
    """Learns from rows of docs (text, lang) where the column `learn` holds and lang isn't null.

    Bounded sample: from each language, the share of rows (fixed by a hash of doc_id) that holds about
    chars_per_lang characters, all of them if there are fewer; with very many languages less, so that all together hold
    about most_chars. Texts of more than `longest` characters aren't learned from. The driver holds these texts and the model.
    """
    rows = docs.where(learn).where("lang is not null").where(F.length("text") <= longest).select("lang", "text", hash_share("doc_id", seed=5).alias("u"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("text").alias("texts")).collect()
    each = min(chars_per_lang, most_chars / max(1, len(sizes)))
    # at least some 20 texts, since the calibration compares texts
    share = {r["lang"]: min(1.0, max(each, min(20 * r["chars"] / r["texts"], 4 * each)) / r["chars"]) for r in sizes if r["chars"]}
    if not share:
        return LanguageModel([], order)
    take = F.lit(False)
    for lang, part in share.items():
        take = take | ((F.col("lang") == lang) & (F.col("u") < part))
    return LanguageModel([(r["lang"], r["text"]) for r in rows.where(take).select("lang", "text").toLocalIterator()], order)


PREDICTION = "lang_pred string, score double, entropy double, rejected boolean"


def predictor(spark, model: LanguageModel):
    """A column function of the text: struct (lang_pred, score, entropy, rejected)."""
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        cache = WordCache(own.table, limit=200_000)
        for texts in batches:
            out = []
            for part in groups_of(texts, lambda t: len(t or "")):
                for at in cache.rows_of([words_of(t) for t in part]):
                    out.append(own.decide(cache.rows[at].sum(0)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "entropy", "rejected"])

    return F.pandas_udf(predict, PREDICTION)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with struct column `language` (lang_pred, score, entropy, rejected), one row for each row of docs.

    Null text, empty text and text without a letter: lang_pred `und`, score 0, rejected. Otherwise lang_pred is a
    learned language, ties to the first by name; rejected where the text's cross-entropy is beyond what that
    language's own texts reach. Whole texts are read. Other columns pass through; one named `language` is replaced.
    A model learned from no rows answers `und`.
    """
    return docs.withColumn("language", predictor(docs.sparkSession, model)("text"))
