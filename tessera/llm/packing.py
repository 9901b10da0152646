"""Best-fit packing by large-item matching, planned on the histogram of sizes.

Items above a third of a sequence fit at most twice into one: each of them, largest first, is matched with the
largest other one that still fits. Smaller items, largest first, then go into the smallest gap that takes
them. Sizes are whole numbers up to the capacity, so the plan needs only how many items there are of each
size: at most `capacity` numbers reach the driver, whatever the input. The plan says which ranks of a size go to
which bins; Spark ranks the items within their size and looks their places up.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, running_start

# ---------------------------------------------------------------- token ids

#: Between two characters that aren't white space, a single space always begins a token of its own word.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters and below: the range over which both libraries are tested to agree
_PLAIN = re.compile(r"[\x00-ɏ]*")


class Encoder:
    """Ids of whole texts by the `tokenizers` file, as an array of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not self.fast or any(s in text for s in self.special):
            return self._exact(text)
        if _PLAIN.fullmatch(text):
            return self._plain(text)
        # runs of plain words, and the other words, each after its space
        parts, run = [], []
        for i, word in enumerate(_CUT.split(text)):
            word = " " + word if i else word
            if _PLAIN.fullmatch(word):
                run.append(word)
                continue
            parts += [self._plain("".join(run)), self._exact(word)]
            run = []
        return np.concatenate([*parts, self._plain("".join(run))])

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _plain(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def token_pieces(docs: DataFrame, capacity: int, path: str, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each row of docs (doc_id, text).

    ids by the tokenizers file at `path`, then id 0; null text is empty. Only a longer row is cut: into pieces of
    `capacity`, the first holding what is over. ranks_path: the same vocabulary as ranks, for words of Latin
    letters and below; the ids are the same. Both are paths on every executor.
    """

    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path, ranks_path)
        for texts in batches:
            out = []
            for text in texts:
                ids = np.append(encoder.encode(text), np.uint32(0)) if text else np.zeros(1, "<u4")
                n = len(ids)
                starts = [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]
                ends = [*starts[1:], n]
                out.append([{"piece": i, "start": s, "length": e - s, "ids_crc32": zlib.crc32(ids[s:e].tobytes())} for i, (s, e) in enumerate(zip(starts, ends, strict=True))])
            yield pd.Series(out)

    cut = F.pandas_udf(pieces, "array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    return docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", "p.*")


# ---------------------------------------------------------------- the plan


class Plan:
    """For each size, ranges of ranks: `copies` items a bin from `offset`, into bins from `bin` on."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.used = dict.fromkeys(histogram, 0)
        #: size -> rows (first rank, first bin, copies a bin, offset of the first copy)
        self.ranges: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in histogram}
        #: gap -> ranges of bins [first, end) with that much room left
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.open: list[int] = []  # gaps with bins, ascending
        left = dict(sorted(histogram.items(), reverse=True))
        large = [s for s in left if 3 * s > capacity]
        self._match(left, large)
        for size in left:
            if 3 * size <= capacity and size > 0:
                self._fit(size, left[size])

    def _free(self, gap: int, first: int, end: int) -> None:
        if first < end and gap > 0:
            if gap not in self.gaps:
                insort(self.open, gap)
            self.gaps.setdefault(gap, []).append((first, end))

    def _match(self, left: dict[int, int], large: list[int]) -> None:
        ascending = sorted(large)
        for a in large:
            while left[a]:
                # the largest partner that fits beside a: itself or a smaller one
                i = bisect_left(ascending, self.capacity - a + 1) - 1
                while i >= 0 and (left[ascending[i]] == 0 or (ascending[i] == a and left[a] < 2) or ascending[i] > a):
                    i -= 1
                b = ascending[i] if i >= 0 else 0
                count = min(left[a], left[b]) if b and b != a else left[a] // 2 if b else left[a]
                first, self.bins = self.bins, self.bins + count
                self.ranges[a].append((self.used[a], first, 2 if a == b else 1, 0))
                self.used[a] += count * (2 if a == b else 1)
                left[a] -= count * (2 if a == b else 1)
                if b and b != a:
                    self.ranges[b].append((self.used[b], first, 1, a))
                    self.used[b] += count
                    left[b] -= count
                self._free(self.capacity - a - b, first, self.bins)

    def _fit(self, size: int, many: int) -> None:
        while many:
            i = bisect_left(self.open, size)
            if i == len(self.open):
                copies = self.capacity // size
                count = max(1, many // copies)
                copies = min(copies, many)
                self._place(size, self.capacity, self.bins, count, copies)
                self.bins += count
                many -= count * copies
                continue
            gap = self.open[i]
            first, end = self.gaps[gap].pop()
            copies = min(gap // size, many)
            count = min(end - first, many // copies)
            self._free_later(gap, first + count, end)
            self._place(size, gap, first, count, copies)
            many -= count * copies

    def _free_later(self, gap: int, first: int, end: int) -> None:
        if first < end:
            self.gaps[gap].append((first, end))
        elif not self.gaps[gap]:
            del self.gaps[gap]
            self.open.remove(gap)

    def _place(self, size: int, gap: int, first: int, count: int, copies: int) -> None:
        self.ranges[size].append((self.used[size], first, copies, self.capacity - gap))
        self.used[size] += count * copies
        self._free(gap - size * copies, first, first + count)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Sorted keys (size, first rank) as one number each, and what they stand for."""
        rows = [(size, *r) for size in sorted(self.ranges) for r in self.ranges[size]]
        table = np.array(rows, np.int64).reshape(-1, 5)
        return (table[:, 0] << 44) | table[:, 1], table


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """items (length between 1 and capacity, and other columns) with sequence_id and offset (both long).

    Rows are told apart by all their columns but need not be distinct. Places in a sequence are gapless from 0.
    Equal rows are interchangeable; reruns on the same rows give the same multiset of places. Columns named
    sequence_id or offset are replaced. An empty table gives no rows.
    """
    spark, names = items.sparkSession, [c for c in items.columns if c not in ("sequence_id", "offset")]
    items = materialize(items.select(*names).withColumn("_one", F.lit(1)))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError("every length must be between 1 and the capacity")
    plan = Plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan.arrays())
    order = [c for c in names if c != "length"]
    ranked = running_start(items, ["length"], order, "_one", sum(histogram.values()), "_rank").drop("_one")

    def places(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        keys, table = shared.value
        for size, rank in batches:
            row = table[np.searchsorted(keys, (size.to_numpy() << 44) | rank.to_numpy(), side="right") - 1]
            inside = rank.to_numpy() - row[:, 1]
            yield pd.DataFrame({"sequence_id": row[:, 2] + inside // row[:, 3], "offset": row[:, 4] + inside % row[:, 3] * size.to_numpy()})

    found = ranked.withColumn("_p", F.pandas_udf(places, "sequence_id long, offset long")(F.col("length"), F.col("_rank")))
    return found.select(*names, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, capacity: int, path: str, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of docs.

    Null text is empty: one piece of one token. doc_id may be null or repeat; each row is packed.
    Other columns are ignored.
    """
    return pack(token_pieces(docs.select("doc_id", "text"), capacity, path, ranks_path), capacity)
