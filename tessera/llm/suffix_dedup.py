"""Removal of strings that occur more than once: distributed prefix doubling over bytes or words.

Spark ranks positions at growing lengths, three quarters, a half at single windows, the whole of `length`, where the rank of the
whole is the pair (rank of the half, rank of the half that begins half a window behind); a position leaves as soon as
its rank is unique.

1. Prefixes are ranked inside the text, by content (64 bits, doubled from single symbols on), so that no sort is needed for that.
2. Which positions enter: every window of `length` symbols designates the position, among those whose prefix of three
   quarters (of words: two) lies in the window, whose quarter prefix ranks lowest (ties: leftmost). Equal windows
   designate the same place in themselves, so the designated position of a repeated window has a repeated prefix. Spark
   sorts the ranks of designated positions' prefixes, about one position in length/8; a unique one leaves and takes the
   windows that designate it along.
3. The windows that designate one position are a run. Runs that are equal as a whole (copies of documents, the inside
   of shared passages) are repeated as a whole, and one of them stands for all in what follows.
4. The other windows are doubled one by one: ranks of half windows are sorted and numbered anew, unique positions leave;
   pairs of them (at a position and half a window behind it) are sorted; a pair met twice is a repeated window.

Ranks of prefixes and halves are content hashes of 64 bits, those of pairs of halves are numbers of distinct pairs. Two
different runs pass as equal only if the names of both prefix and run collide, two different windows only if two different
halves share a name and the other halves are equal or do too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import groups_of, materialize, mix, word_hashes

_BITS = np.uint64(21)  # of a position in a segment of at most 2**20 windows
_SEGMENT = 1 << 20
_SIZE_BITS = 24
_WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_M = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def prefix_names(data: np.ndarray, length: int) -> np.ndarray:
    """The name of the string of `length` symbols (bytes, or hashes of words) from each position, by doubling; the last step may overlap."""
    names, now = _BYTE_NAMES[data] if data.dtype == np.uint8 else data, 1
    while now < length:
        step = min(now, length - now)
        if len(names) <= step:
            return names[:0]
        names = names[: len(names) - step] * _M[0] + (names[step:] ^ (names[step:] >> np.uint64(29))) * _M[1]
        now += step
    return mix(names)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _M[2] + mix(y + _M[3]))


class _Search:
    """Windows of `length` symbols: their half and quarter prefixes, where the second parts of these begin (they may overlap), and `prefix`.

    prefix is how much of a window the first round in Spark compares: a quarter and what follows of two or three.
    """

    def __init__(self, length: int, unit: str):
        self.length, self.unit = length, unit
        self.half = -(-length // 2)
        self.quarter = -(-self.half // 2)
        self.to_half, self.to_quarter = length - self.half, self.half - self.quarter
        # three quarters of bytes: half would let many windows in that differ behind it; words are few as it is
        self.rest = [self.to_quarter, self.to_half] if unit == "bytes" else [self.to_quarter]
        self.prefix = self.rest[-1] + self.quarter
        self.reach = length - self.prefix + 1

    def window_names(self, quarter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Names of whole windows from `at`, from the names of quarters at every position."""
        behind = at + self.to_half
        return _pair(_pair(quarter[at], quarter[at + self.to_quarter]), _pair(quarter[behind], quarter[behind + self.to_quarter]))

    def prefix_names(self, quarter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Names of the prefixes from `at`, from those of their quarters."""
        names = quarter[at]
        for step in self.rest:
            names = _pair(names, quarter[at + step])
        return names


def designated(quarter: np.ndarray, windows: int, reach: int) -> np.ndarray:
    """For each of `windows` starts, the position in its first `reach` with the smallest name (leftmost)."""
    need = windows + reach - 1
    ranked = np.full(-(-need // reach) * reach, np.uint64(2**64 - 1))
    ranked[:need] = ((quarter[:need] >> _BITS) << _BITS) | np.arange(need, dtype=np.uint64)
    blocks = ranked.reshape(-1, reach)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(down[:windows], up[reach - 1 : reach - 1 + windows])
    return (low & np.uint64((1 << 21) - 1)).astype(np.int64)


def _symbols(column: pa.Array, unit: str) -> list[np.ndarray]:
    """The UTF-8 bytes of each text, or the hashes of its words; null is empty."""
    if unit == "bytes":
        return [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in column.cast(pa.large_binary())]
    out = []
    for part in groups_of(column.cast(pa.large_binary()), lambda x: len(x.as_buffer()) if x.is_valid else 1, most=1 << 20, rows=4096):
        hashes, first = word_hashes([x.as_py() or b"" for x in part], lower=False)
        out += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _segments(docs: list[np.ndarray], length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for i, data in enumerate(docs):
        for start in range(0, len(data) - length + 1, _SEGMENT):
            yield i, start, data[start : start + _SEGMENT + length - 1]


_SPOTS = "doc_id long, k long, way int, lo int, span int, r long, run long"
_SPOT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("way", pa.int32()), ("lo", pa.int32()), ("span", pa.int32()), ("r", pa.int64()), ("run", pa.int64())])


def _spots(searches: list[_Search]):
    """Designated positions of each text, by search (way): their run of windows [lo, lo + span], rank of the prefix, name of the run."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for way, z in enumerate(searches):
                docs = _symbols(batch.column("text"), z.unit)
                for part in groups_of(_segments(docs, z.length), lambda s: len(s[2]), most=1 << 18, rows=4096):
                    yield _spots_of(z, way, batch, part)

    return find


def _spots_of(z: _Search, way: int, batch: pa.RecordBatch, part: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    data = np.concatenate([s[2] for s in part]) if len(part) > 1 else part[0][2]
    size = np.array([len(s[2]) for s in part])
    first = np.cumsum(size) - size
    windows = len(data) - z.length + 1
    quarter = prefix_names(data, z.quarter)
    best = designated(quarter, windows, z.reach)
    owner = np.repeat(np.arange(len(part)), size)[:windows]
    w = np.flatnonzero(np.arange(windows) + z.length <= (first + size)[owner])
    chosen = best[w]
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[w][1:] != owner[w][:-1]))))
    lo, a = w[new], chosen[new]
    hi = w[np.append(new[1:], len(w)) - 1]
    own = owner[lo]
    run = _pair(_pair(z.window_names(quarter, lo), z.window_names(quarter, hi)), ((a - lo) * 4096 + (hi - lo)).astype(np.uint64))
    row = pa.array(np.array([s[0] for s in part])[own])
    start = np.array([s[1] for s in part])[own] + lo - first[own]
    numbers = [np.full(len(own), way, np.int32), start.astype(np.int32), (hi - lo).astype(np.int32), *(x.view(np.int64) for x in (z.prefix_names(quarter, a), run))]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("k").take(row), *map(pa.array, numbers)], schema=_SPOT_SCHEMA)


def _places(runs: list[dict], size: int, behind: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the runs and the places `behind` each, once and in order; and which are windows of open runs."""
    start, is_open = np.zeros(size, bool), np.zeros(size, bool)
    for r in runs:
        own = slice(r["lo"], r["lo"] + r["span"] + 1)
        start[own] = True
        is_open[own] = r["open"]
    start[behind:] |= start[: size - behind].copy()
    at = np.flatnonzero(start)
    return at, is_open[at]


_PLACE_SCHEMA = pa.schema([("d", pa.int64()), ("at", pa.int32()), ("open", pa.bool_()), ("r", pa.int64())])


def _halves(searches: list[_Search]):
    """Ranks by content of the half windows at the windows of the given runs (arrays way, lo, span, open) and half a window behind them; d becomes 2 * d + way."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, many = None, [], 0
        for batch in batches:
            symbols = [_symbols(batch.column("text"), z.unit) for z in searches]
            for i, (runs, d) in enumerate(zip(batch.column("runs").to_pylist(), batch.column("d").to_pylist(), strict=True)):
                if d == last:  # a repeated row: the same places once more
                    continue
                last = d
                for way, z in enumerate(searches):
                    if own := [r for r in runs if r["way"] == way]:
                        found = _halves_of(z, 2 * d + way, symbols[way][i], own)
                        held += found
                        many += sum(len(h[0]) for h in found)
                if many >= 1 << 16 or len(held) >= 1 << 10:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=_PLACE_SCHEMA)
                    held, many = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=_PLACE_SCHEMA)

    return find


def _halves_of(z: _Search, d: int, data: np.ndarray, runs: list[dict]) -> list[tuple[np.ndarray, ...]]:
    out = []
    at, is_open = _places(runs, len(data), z.to_half)
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > z.length) + 1):
        for cut in range(0, len(part), 1 << 17):
            mine = part[cut : cut + (1 << 17)]
            low, x = int(at[mine[0]]), at[mine]
            quarter = prefix_names(data[low : int(x[-1]) + z.half], z.quarter)
            half = _pair(quarter[x - low], quarter[x - low + z.to_quarter])
            out.append((np.full(len(x), d), x.astype(np.int32), is_open[mine], half.view(np.int64)))
    return out


#: Runs with more members than one in so many of all are looked up by broadcast: fewer than this many rows.
_HOT = 2000


def _met_twice(rows: DataFrame, pair: list[str]) -> DataFrame:
    """The pairs that more than one row has, numbered: their numbers are the ranks of the next length."""
    found = rows.groupBy(*pair).agg(F.count("*").alias("c")).where("c > 1")
    return materialize(found.select(*pair, F.monotonically_increasing_id().alias("number")))


def _by_way(values: list[int], way: Column | None = None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("way") if way is None else way.cast("int")) + 1)


def _doubled(places: DataFrame, searches: list[_Search]) -> DataFrame:
    """d, at of open windows that occur twice, from ranks of half windows; places is a written table and is dropped."""
    halves = _met_twice(places, ["r"])
    ranked = materialize(places.join(halves, "r").select("d", "at", "open", F.col("number").alias("rank")), places, halves)
    offset = _by_way([z.to_half for z in searches], F.col("d") % 2)
    behind = ranked.select("d", (F.col("at") - offset).alias("at"), F.col("rank").alias("rank2"))
    both = materialize(ranked.join(behind, ["d", "at"]).select("d", "at", "open", "rank", "rank2"), ranked)
    whole = _met_twice(both, ["rank", "rank2"]).select("rank", "rank2")
    return both.where("open").join(whole, ["rank", "rank2"], "left_semi").select("d", "at")


def _repeated(docs: DataFrame, searches: list[_Search]) -> DataFrame:
    """doc_id, k, found0, found1 (by search): ranges of symbols that occur elsewhere too, as start << _SIZE_BITS | size; they may overlap."""
    spots = materialize(docs.mapInArrow(_spots(searches), _SPOTS))
    prefixes = _met_twice(spots, ["r"])
    # written, so that both sides of the join are plain shuffles, whose large partitions Spark can split
    spots = materialize(spots.join(prefixes.select("r"), "r", "left_semi"), spots, prefixes)
    one = F.min(F.struct("doc_id", "k", "way", "lo", "span")).alias("one")
    runs = materialize(spots.groupBy("r", "run").agg(F.count("*").alias("c"), one))
    # a run met twice is repeated as a whole; runs of very many members don't meet in one task
    by = ["r", "run"]
    many = (runs.agg(F.sum("c")).first()[0] or 0) // _HOT + 1
    hot, equal = runs.where(F.col("c") > many).select(*by), runs.where((F.col("c") > 1) & (F.col("c") <= many)).select(*by)
    settled = spots.join(F.broadcast(hot), by, "left_semi").union(spots.join(F.broadcast(hot), by, "left_anti").join(equal, by, "left_semi"))
    length = _by_way([z.length for z in searches])
    settled = materialize(settled.select("doc_id", "k", "way", _range(F.col("lo"), F.col("span") + length)))
    # where different runs share a prefix, their windows are compared one by one
    several = runs.groupBy("r").agg(F.count("*").alias("m"), F.min("c").alias("least")).where("m > 1 and least = 1").select("r")
    listed = runs.join(several, "r", "left_semi").select("one.*", (F.col("c") == 1).alias("open"))
    by_doc = listed.groupBy("doc_id", "k").agg(F.collect_list(F.struct("way", "lo", "span", "open")).alias("runs"))
    by_doc = materialize(by_doc.withColumn("d", F.monotonically_increasing_id()), spots, runs)
    same = docs["doc_id"].eqNullSafe(by_doc["doc_id"]) & (docs["k"] == by_doc["k"])
    places = materialize(docs.join(by_doc, same).select("d", "text", "runs").mapInArrow(_halves(searches), "d long, at int, open boolean, r long"))
    way = (F.col("d") % 2).cast("int")
    single = _doubled(places, searches).select(way.alias("way"), F.shiftright("d", 1).alias("d"), "at")
    single = single.join(by_doc.select("d", "doc_id", "k"), "d").select("doc_id", "k", "way", _range(F.col("at"), length))
    # a text's list is no longer than the text
    lists = [F.collect_list(F.when(F.col("way") == i, F.col("range"))).alias(f"found{i}") for i in range(2)]
    return materialize(settled.union(single).groupBy("doc_id", "k").agg(*lists), settled, by_doc)


def _range(start: Column, size: Column) -> Column:
    return F.shiftleft(start.cast("long"), _SIZE_BITS).bitwiseOR(size.cast("long")).alias("range")


_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, n_shared_words long"


def _cut(unit: str):
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found, shared in batches:
            rows = []
            for text, own, words in zip(texts, found, shared, strict=True):
                data = text.encode() if text else b""
                ranges = _union(own)
                if unit == "words" and ranges:
                    ranges = _bytes_of_words(data, ranges)
                at, kept, removed = 0, [], 0
                for s, e in ranges:
                    kept.append(data[at:s])
                    removed, at = removed + e - s, e
                rest = b"".join([*kept, data[at:]]) if ranges else data
                rows.append((len(data), removed, len(ranges), hashlib.sha256(rest).hexdigest(), text if not ranges else rest.decode("utf-8", "ignore"), sum(e - s for s, e in _union(words))))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_shared_words"])

    return cut


def _bytes_of_words(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From the first byte of a range's first word to the last of its last word."""
    places = [m.span() for m in _WORD_BYTES.finditer(data)]
    return [(places[s][0], places[e - 1][1]) for s, e in ranges]


def _union(found: np.ndarray | None) -> list[tuple[int, int]]:
    """Sorted (start, end) of packed ranges; those that touch or overlap are one."""
    if found is None or not len(found):
        return []
    found = np.unique(found)
    start = found >> _SIZE_BITS
    end = np.maximum.accumulate(start + (found & ((1 << _SIZE_BITS) - 1)))
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = 400, unit: str = "bytes", shared_words: int | None = None) -> DataFrame:
    """docs with struct column `repeats` (n_bytes, n_removed, n_spans, kept_sha256, kept, n_shared_words): one row for each row of docs.

    unit "bytes": every byte that lies in a string of `length` bytes which also starts elsewhere, in the same or another
    document, goes. unit "words": the same for strings of `length` words, whatever white space is between them; the
    space inside a removed range goes, that around it stays. All occurrences go, judged on the input. Ranges that touch
    or overlap are one span. n_removed counts bytes in either case.
    `kept` is the rest as text: null stays null, and a character cut in two goes whole. Null text counts as empty.
    Repeated rows are repeats of each other; doc_id may be null or repeat. Other columns pass through, but
    for one named `repeats`, which is replaced. length: at least 32 bytes or 8 words, below a million.
    shared_words: n_shared_words counts the words of a text that lie in a string of so many words which also starts
    elsewhere; nothing is removed for it. It is 0 where shared_words isn't given.
    """
    if unit not in ("bytes", "words") or not (32 if unit == "bytes" else 8) <= length < 10**6 or not 8 <= (shared_words or 8) < 10**6:
        raise ValueError("unit must be bytes or words, length at least 32 bytes or 8 words, and below a million")
    names = [c for c in docs.columns if c != "repeats"]
    searches = [_Search(length, unit)] + ([_Search(shared_words, "words")] if shared_words else [])
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    found = _repeated(docs.select("doc_id", "text", key.alias("k")), searches).toDF("_doc", "_key", "_found", "_shared")
    whole = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), key.alias("_k"))
    joined = whole.join(found, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key")), "left")
    return joined.select("_row.*", F.pandas_udf(_cut(unit), _CUT)("_text", "_found", "_shared").alias("repeats"))
