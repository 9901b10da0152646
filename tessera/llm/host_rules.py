"""Host-level quality rules: failures counted by host, rates shrunk with an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import groups_of, materialize, mix, word_hashes

_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more, given their hashes."""
    count = len(words) - width + 1
    if count < 2:
        return 0
    windows = np.zeros(count, np.uint64)
    for j in range(width):
        windows = mix(windows * np.uint64(0x9E3779B97F4A7C15) + words[j : j + count])
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[back] > 1)
    inside = np.zeros(len(words), bool)
    for j in range(width):
        inside[starts + j] = True
    return int(inside.sum())


def _measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for part in groups_of(texts, lambda t: len(t or "")):
            words, first = word_hashes([(t or "").encode() for t in part], lower=False)
            for text, start, end in zip(part, first[:-1], first[1:], strict=True):
                text = text or ""
                lines = [x for x in text.split("\n") if x.strip(_SPACES)]
                rows.append((end - start, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words[start:end])))
        yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")


def text_stats(text: str = "text") -> Column:
    """Struct of counts over a whole text; null and empty text: zeros."""
    return F.pandas_udf(_measure, STATS)(text)


def host_verdicts(failures: DataFrame, excess: float = 2.0, deviations: float = 2.0) -> DataFrame:
    """host, n, k, rate, bad: failures (host, failed) by host; rate is the posterior mean under a beta prior fitted to all hosts.

    The prior's mean is the pooled rate. Its weight comes from moments: the spread of hosts' rates around the mean,
    weighted by size, less what binomial chance explains; between 1 and a million rows' worth. A host with
    few rows so stays near the mean, and where hosts differ by chance alone all of them do. bad: even `deviations` standard
    deviations of its posterior below the rate, the host fails more than `excess` times as often as all rows together
    (never, if all rows fail). One row a host; null is a host of its own.
    """
    hosts = failures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    pooled = hosts.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.count("*").alias("hosts"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("squares"))
    mean = F.col("all_k") / F.col("all_n")
    chance = mean * (1 - mean)
    between = F.col("squares") / F.col("all_n") - mean * mean - chance * F.col("hosts") / F.col("all_n")
    weight = F.least(F.lit(1e6), F.greatest(F.lit(1.0), chance / F.greatest(between, F.lit(1e-9)) - 1))
    prior = pooled.select(mean.alias("mean"), weight.alias("weight")).first()
    m, w = (F.lit(x).cast("double") for x in (prior["mean"], prior["weight"]))
    rate = (F.col("k") + m * w) / (F.col("n") + w)
    spread = F.sqrt(rate * (1 - rate) / (F.col("n") + w + 1))
    return hosts.select("host", "n", "k", rate.alias("rate"), (rate - deviations * spread > excess * m).alias("bad"))


#: Hosts are the named ones of a crawl; verdicts of more of them than this are joined by a shuffle
_FEW_HOSTS = 100_000


def apply_rules(docs: DataFrame, host: Column, failed: Column, excess: float = 2.0, deviations: float = 2.0) -> DataFrame:
    """doc_id, the counts of text_stats, base_failed, kept and host_rate: one row for each row of docs (doc_id, text, and what `host` reads).

    failed: the base rule, a condition on the counts. kept is false if it holds or the host is bad (see host_verdicts).
    host_rate: the host's shrunk failure rate, to six places. Null text counts as empty; rows without a host share one
    verdict; doc_id may be null or repeat. An empty table gives no rows. Other columns are ignored.
    """
    counted = docs.select("doc_id", host.alias("host"), text_stats("text").alias("s")).select("doc_id", "host", "s.*")
    counted = materialize(counted.withColumn("base_failed", failed))
    verdicts = host_verdicts(counted.select("host", F.col("base_failed").alias("failed")), excess, deviations)
    verdicts = materialize(verdicts.select(F.col("host").alias("_host"), F.round("rate", 6).alias("host_rate"), "bad"))
    if verdicts.count() <= _FEW_HOSTS:  # else both sides are shuffled, and Spark splits large hosts
        verdicts = F.broadcast(verdicts)
    joined = counted.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    kept = ~F.col("base_failed") & ~F.col("bad")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")
