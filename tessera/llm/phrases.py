"""Phrases by dynamic itemset counting: lengths interleaved in cyclic scans over shards of the corpus.

1. Documents are dealt to a few shards. Step t scans shard t mod shards; words are counted from step 0 on.
2. A phrase becomes active at the step after both of its subphrases (without the last, without the first word) have
   reached the threshold in what was counted so far, and stays active for one full cycle: each shard counts it once.
   Longer phrases so start while shorter ones are still being counted; the scans end when no phrase is active.
3. Tasks know the step at which a phrase reached the threshold from one table of a fixed size, indexed by the phrase's
   hash. Phrases of one slot share the earliest step. The slot's value never changes afterwards, so that every phrase has one
   first step, not later than its subphrases ask for: a shared slot costs counting, never a count.
4. Phrases are told apart by the 64-bit hashes of their words, not by a hash of the whole. Two words of one hash are seen by
   their spelling, and all is counted again with another seed.
5. Counts of phrases meet by hash range, as sorted arrays: a task's count of a range is one row, not one for each phrase.
   Ranges are as many as the corpus asks for, so that a range's phrases fit a task; no phrase, however frequent, has more than one entry a
   task's count. Words meet as rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import drop_table, hash_share, materialize, mix

SHARDS = 3
#: Slots of the table of steps: one byte each, in every Python worker and on the driver
SLOTS = 1 << 24
#: Steps that fit a slot; the last means: not reached
NEVER = 255
#: Bytes of one language's texts that a task counts together
PART_BYTES = 8 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: 0: letter, 1: between words, 2: between pieces
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text for each range of phrase hashes
RANGE_BYTES = 16 << 20
_COUNTS = "lang string, k int, first int, range long, data binary"


def _salt(text: str, seed: int) -> np.uint64:
    return mix(np.array([int.from_bytes(text.encode()[:7], "little") + 1 + (seed << 56)], np.uint64) * _GOLDEN)[0]


def _words(texts: list[bytes], seed: int) -> tuple[np.ndarray, ...]:
    """hash, second hash, piece, begin, size of all words of the texts, and the lower-cased bytes that the last two point into."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _CLASS[data]
    at = np.flatnonzero(kind == 0)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, data
    heads = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1))
    sizes = np.diff(np.append(heads, len(at)))
    begins = at[heads]
    place = (at - np.repeat(begins, sizes)).astype(np.uint64)
    letters = mix(((place << np.uint64(8)) | data[at]) * _GOLDEN + np.uint64(2 * seed + 1))
    hashes, second = mix(np.add.reduceat(letters, heads)), np.bitwise_xor.reduceat(letters, heads)
    pieces = np.cumsum(kind == 2)[begins]
    return hashes, second, pieces, begins, sizes, data


def _strings(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes)
    gathered = data[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(gathered.tobytes())).cast(pa.string())


def _runs(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows of columns together, and where in it each distinct row begins. key: a hash of the columns, which the order follows."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    differ = np.zeros(len(same), bool)
    for c in columns:
        differ |= c[order][1:] != c[order][:-1]
    if (same & differ).any():  # two rows of one hash
        order = np.lexsort((*columns, key))
        same, differ = key[order][1:] == key[order][:-1], np.zeros(len(same), bool)
        for c in columns:
            differ |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), ~same | differ)))


def _keys(words: list[np.ndarray], salt: np.uint64) -> np.ndarray:
    """Hashes of phrases, one array for each word."""
    key = mix(words[0] ^ salt)
    for w in words[1:]:
        key = mix(key * _GOLDEN + w)
    return key


def _written(words: list[np.ndarray], counts: np.ndarray) -> bytes:
    return b"".join([*(w.tobytes() for w in words), counts.astype(np.int64).tobytes()])


def _read(blobs: list[bytes], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words and counts of all phrases of k words in the blobs."""
    parts = [np.frombuffer(b, np.uint64).reshape(k + 1, -1) for b in blobs]
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((k + 1, 0), np.uint64)
    return list(whole[:k]), whole[k].view(np.int64)


def _scan(texts: list[bytes], lang: str, steps: np.ndarray, step: int, shards: int, longest: int, ranges: int, seed: int) -> Iterator[tuple]:
    """(lang, k, first, range, blob) of the active phrases of some texts of one language."""
    words, _, pieces, *_ = _words(texts, seed)
    salt, slots, n = _salt(lang, seed), np.uint64(len(steps) - 1), len(words)
    key = mix(words ^ salt)
    for k in range(2, longest + 1):
        if n < k:
            return
        # step at which the phrase of k - 1 words that begins here has reached the threshold; NEVER: it hasn't, or no such phrase
        reached = steps[key & slots]
        first = np.maximum(reached[:-1], reached[1:]).astype(np.int64) + 1
        alive = (pieces[: n - k + 1] == pieces[k - 1 :]) & (first <= step)
        key = mix(key[:-1] * _GOLDEN + words[k - 1 :])
        open_ = alive & (step < first + shards)
        for g in range(max(1, step - shards + 1), step + 1):
            at = np.flatnonzero(open_ & (first == g))
            if not len(at):
                continue
            order, heads = _runs(key[at], [words[at + j] for j in range(k)])
            many, own = np.diff(np.append(heads, len(at))), at[order[heads]]
            place = ((key[own] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)  # follows the order of keys
            cuts = np.flatnonzero(np.diff(place)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(own)], strict=True):
                yield lang, k, g, int(place[low]), _written([words[own[low:high] + j] for j in range(k)], many[low:high])
        if not alive.any():
            return


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, up to PART_BYTES of them at once."""
    waiting: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw = text.encode()
            waiting.setdefault(lang, []).append(raw)
            held[lang] = held.get(lang, 0) + len(raw)
            if held[lang] >= PART_BYTES or sum(held.values()) >= 4 * PART_BYTES:
                fullest = max(held, key=held.get)
                yield fullest, waiting.pop(fullest)
                del held[fullest]
    yield from waiting.items()


def _word_counts(part: DataFrame, seed: int) -> DataFrame:
    """lang, word, h, f: the words of a shard by task."""

    def count(batches):
        for lang, texts in _batches(batches):
            words, second, _, begins, sizes, data = _words(texts, seed)
            if len(words):
                order, heads = _runs(words, [second])  # two spellings of one hash give two rows
                at = order[heads]
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(at), np.int32))), _strings(data, begins[at], sizes[at]), pa.array(words[at].view(np.int64)), pa.array(np.diff(np.append(heads, len(words))).astype(np.int64))], ["lang", "word", "h", "f"])

    return part.mapInArrow(count, "lang string, word string, h long, f long")


def _phrase_counts(part: DataFrame, known, step: int, shards: int, longest: int, ranges: int, seed: int) -> DataFrame:
    def count(batches):
        rows, size = [], 0
        for lang, texts in _batches(batches):
            for row in _scan(texts, lang, known.value, step, shards, longest, ranges, seed):
                rows.append(row)
                size += len(row[4])
                if size >= 8 << 20:
                    yield _record(rows)
                    rows, size = [], 0
        if rows:
            yield _record(rows)

    return part.mapInArrow(count, _COUNTS)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "k", "first", "range", "data"])


def _merger(step: int, shards: int, least: int, slots: int, seed: int):
    """Adds up a range's counts: those of the steps before (old) and of this one."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        lang, k, first = pdf["lang"].iloc[0], int(pdf["k"].iloc[0]), int(pdf["first"].iloc[0])
        before = _read(pdf["data"][pdf["old"]].tolist(), k)
        now = _read(pdf["data"][~pdf["old"]].tolist(), k)
        words = [np.concatenate(c) for c in zip(before[0], now[0], strict=True)]
        counts = np.concatenate((before[1], now[1]))
        earlier = np.concatenate((before[1], np.zeros(len(now[1]), np.int64)))
        key = _keys(words, _salt(lang, seed))
        order, heads = _runs(key, words)
        counts, earlier = (np.add.reduceat(c[order], heads) if len(heads) else c for c in (counts, earlier))
        own = order[heads]
        new = np.unique(key[own][(counts >= least) & (earlier < least)] & np.uint64(slots - 1)).astype(np.int64)
        ended = first == step - shards + 1
        kept = counts >= least if ended else np.ones(len(counts), bool)
        data = _written([w[own[kept]] for w in words], counts[kept])
        return pd.DataFrame({"lang": [lang], "k": [k], "first": [first], "range": [pdf["range"].iloc[0]], "data": [data], "slots": [new.tolist()], "state": ["done" if ended else "active"]})

    return merge


def _cycles(spark: SparkSession, parts: list[DataFrame], least: int, longest: int, slots: int, ranges: int, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """(lang, words, f, word of all with f >= least; lang, n of all words). None: two words share a hash."""
    shards, steps = len(parts), np.full(slots, NEVER, np.uint8)
    words, table, found, step, fresh, totals = None, None, [], 0, 0, None
    # phrases that reach the threshold at step s make longer ones active from s + 1 to s + shards
    while step < shards or step <= fresh + shards:
        if step == NEVER:
            raise RuntimeError("more steps than the table of steps can hold")
        new = []
        if step < shards:
            counted = _word_counts(parts[step], seed).withColumn("before", F.lit(0).cast("long"))
            if words is not None:
                counted = counted.unionByName(words.select("lang", "word", "h", "f", F.col("f").alias("before")))
            counted = counted.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"), F.sum("before").alias("before"))
            words = materialize(counted, *([] if words is None else [words]))
            new.append(_word_slots(words.where((F.col("f") >= least) & (F.col("before") < least)), slots, seed))
        if step:
            known = spark.sparkContext.broadcast(steps)
            counted = _phrase_counts(parts[step % shards], known, step, shards, longest, ranges, seed).withColumn("old", F.lit(False))
            if table is not None:
                counted = counted.unionByName(table.where("state = 'active'").select("lang", "k", "first", "range", "data", F.lit(True).alias("old")))
            merged = counted.groupBy("lang", "k", "first", "range").applyInPandas(_merger(step, shards, least, slots, seed), f"{_COUNTS}, slots array<long>, state string")
            before, table = table, materialize(merged, by=("state",))
            if before is not None:
                drop_table(before, "state=active")
            known.unpersist()
            new.append(table.where(F.col("k") < longest).select(F.explode("slots").alias("slot")))
            found.append(table.where("state = 'done'").select("lang", "k", "data"))
        reached = functools.reduce(DataFrame.union, new).distinct().toPandas()["slot"].to_numpy(np.int64)
        reached = reached[steps[reached] == NEVER]
        if len(reached):
            steps = steps.copy()
            steps[reached], fresh = step, step
        if step == shards - 1:
            if not words.groupBy("lang", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
                return None
            totals = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")))
            single = words.where(F.col("f") >= least).select("lang", F.array("h").alias("words"), "f", "word")
            words = materialize(single, words)
        step += 1

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, k, data in zip(*(b.column(c).to_pylist() for c in ("lang", "k", "data")), strict=True):
                own, counts = _read([data], k)
                if n := len(counts):
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(np.array(own).view(np.int64).T.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), listed, pa.array(counts), pa.nulls(n, pa.string())], ["lang", "words", "f", "word"])

    out = words
    if found:
        longer = functools.reduce(DataFrame.union, found).mapInArrow(phrases, "lang string, words array<long>, f long, word string")
        out = materialize(words.union(longer))
    return out, totals


def _word_slots(rows: DataFrame, slots: int, seed: int) -> DataFrame:
    """The slots of words (lang, h)."""

    def find(batches):
        for b in batches:
            salts = {lang: _salt(lang, seed) for lang in b.column("lang").unique().to_pylist()}
            key = mix(b.column("h").to_numpy().view(np.uint64) ^ np.array([salts[x] for x in b.column("lang").to_pylist()], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((key & np.uint64(slots - 1)).astype(np.int64))], ["slot"])

    return rows.select("lang", "h").mapInArrow(find, "slot long")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(lang, words array<long>, f, word) for every phrase of 1 to `longest` words with f >= least, and (lang, n).

    `word`: its spelling, of single words. docs: doc_id, text, lang; null language: und; null text: empty. Exact at any
    number of shards and slots. slots: a power of two, of the order of the number of frequent phrases or more.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), F.floor(hash_share("doc_id", "text", seed=12) * shards).cast("int").alias("shard"))
    dealt = materialize(rows, by=("shard",))
    parts = [dealt.where(F.col("shard") == s).select("lang", "text") for s in range(shards)]
    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    seed, got = 0, None
    while got is None:
        got = _cycles(docs.sparkSession, parts, least, longest, slots, 1 + size // RANGE_BYTES, seed)
        seed += 1
    return got


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, scale: int = 2_000_000, within: int = 80, most: int = 2000, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to `longest` words of each language.

    docs: doc_id, text, lang; other columns are ignored. Repeated rows count as often as they are there, null doc_id
    too. Letters A to Z are lower-cased. Empty table: no rows. Score: that of the cut with the least
    floor(scale * a / (l + r)), the first such cut. Phrases inside a longer one with `within` percent of their
    occurrences are dropped. Ties: larger a, then phrase by its UTF-8 bytes.
    """
    counted, totals = frequent_phrases(docs, least, longest, **how)
    size = F.size("words")
    phrases = counted.where(size > 1).select("lang", "words", F.col("f").alias("a"))
    whole = F.col("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice(whole, i, k))))
    longer = phrases.where(size > 2).select("lang", F.explode(inner).alias("words"), F.col("a").alias("longer")).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    left = phrases.join(longer, ["lang", "words"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * within)).select("lang", "words", "a")
    cuts = left.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("head"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("tail"))
    parts = counted.select("lang", "words", "f")
    cuts = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(20, 0)) * cast({scale} as decimal(12, 0))) div cast(l + r as decimal(20, 0))")
    best = cuts.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # those that can be among the first `most`, ties at the end included, then their spelling
    order = [F.desc("cut.score"), F.desc("a")]
    first = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= most).drop("place")
    spelled = counted.where(size == 1).select("lang", F.element_at("words", 1).alias("w"), "word")
    named = first.select("lang", "words", "a", "cut", F.posexplode("words").alias("i", "w")).join(spelled, ["lang", "w"])
    named = named.groupBy("lang", "words", "a", "cut").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= most)
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return ranked.join(totals, "lang").select("lang", long("rank", "rank"), "phrase", long("a", "a"), long("cut.l", "l"), long("cut.r", "r"), long("n", "n"), long("cut.score", "score"))
