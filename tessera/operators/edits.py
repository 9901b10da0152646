"""Edits of ordered rows: a list of insertions, moves, swaps and removals, applied in order by order keys between neighbours."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and edits that a task sorts at a time
SHARE = 500_000
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def first_keys(many: int) -> list[str]:
    """Order keys of equal width for rows 1 to many."""
    width, keys = 1, []
    while len(_DIGITS) ** width <= many:
        width += 1
    for i in range(1, many + 1):
        digits = ""
        for _ in range(width):
            i, d = divmod(i, len(_DIGITS))
            digits = _DIGITS[d] + digits
        keys.append(digits)
    return keys


def key_between(low: str, high: str | None) -> str:
    """A key behind `low` ('': the beginning) and ahead of `high` (None: the end). Keys made here never end in the smallest digit."""
    prefix, i = "", 0
    while True:
        x = _DIGITS.index(low[i]) if i < len(low) else 0
        y = len(_DIGITS) if high is None else _DIGITS.index(high[i]) if i < len(high) else 0
        if x + 1 < y:
            return prefix + _DIGITS[(x + y) // 2]
        if x < y:
            high = None
        prefix += _DIGITS[x]
        i += 1


class _Order:
    """Idents by order key, and back."""

    def __init__(self, idents: list):
        self.keys = first_keys(len(idents))
        self.ident = dict(zip(self.keys, idents, strict=True))
        self.key = {i: k for k, i in self.ident.items()}

    def place(self, ident, low: str, high: str | None) -> None:
        key = key_between(low, high)
        insort(self.keys, key)
        self.ident[key], self.key[ident] = ident, key

    def drop(self, ident) -> None:
        key = self.key.pop(ident)
        del self.keys[bisect_left(self.keys, key)], self.ident[key]

    def beside(self, anchor, behind: bool) -> tuple[str, str | None]:
        """The keys that a row next to the anchor goes between; without an anchor, the beginning or the end."""
        if anchor is None:
            return (self.keys[-1] if self.keys else "", None) if behind else ("", self.keys[0] if self.keys else None)
        at = bisect_left(self.keys, self.key[anchor])
        if behind:
            return self.keys[at], self.keys[at + 1] if at + 1 < len(self.keys) else None
        return self.keys[at - 1] if at else "", self.keys[at]

    def apply(self, op: str, ident, anchor) -> bool:
        """Does one edit; False if it can't be done, and then nothing has changed."""
        there, behind = ident in self.key, op.endswith("after")
        if ident is None or ident == anchor or (anchor is not None and anchor not in self.key):
            return False
        if op in ("insert_before", "insert_after") and not there:
            self.place(ident, *self.beside(anchor, behind))
        elif op in ("move_before", "move_after") and there:
            self.drop(ident)
            self.place(ident, *self.beside(anchor, behind))
        elif op == "swap" and there and anchor is not None:
            a, b = self.key[ident], self.key[anchor]
            self.key[ident], self.key[anchor], self.ident[a], self.ident[b] = b, a, anchor, ident
        elif op == "remove" and there:
            self.drop(ident)
        else:
            return False
        return True


def tasks_for(many: int, spark: SparkSession) -> int:
    """Tasks for so many rows: as many as Spark deals by itself, more where a task would get more than its share."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // SHARE))


def apply_edits(rows: DataFrame, edits: DataFrame, keys: list[str], ident: str, order: str, *, tasks: int | None = None) -> DataFrame:
    """keys, ident, place (from 1), order_key, refused: each sequence after its edits; refused: how many of them couldn't be done.

    rows: keys, ident, order; edits: keys, step, op, ident, anchor, done by step. Operations: insert_before, insert_after (a new ident next to the anchor),
    move_before, move_after, swap (ident and anchor change places), remove. A null anchor is the beginning (before) or the end (after). An edit of an
    ident or anchor that isn't there, an insertion of one that is, and unknown operations are refused and change nothing. An edit gives a new order key
    to the row it places and to no other, so that a stored table has only such rows to update. A sequence that only edits name begins empty; one of
    which nothing is left has no row. Repeated idents count once, the first by order; null idents don't count.
    tasks: how many the sequences are dealt to; by default rows and edits are counted first, so that a task's memory doesn't grow with the input.
    """
    tasks = tasks or tasks_for(rows.count() + edits.count(), rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    none = {c: F.lit(None).cast(kinds[c]).alias(c) for c in (ident, order)}
    lines = rows.where(F.col(ident).isNotNull()).select(*keys, F.lit(0).alias("_kind"), F.col(order).alias("_o"), F.lit(None).cast("long").alias("_step"), F.lit(None).cast("string").alias("_op"), ident, none[ident].alias("_anchor"))
    steps = edits.select(*keys, F.lit(1).alias("_kind"), none[order].alias("_o"), F.col("step").cast("long").alias("_step"), F.col("op").alias("_op"), F.col(ident).cast(kinds[ident]).alias(ident), F.col("anchor").cast(kinds[ident]).alias("_anchor"))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{ident} {kinds[ident]}", "place long", "order_key string", "refused long"])
    many = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's sequences one after the other: the rows of each in order, then its edits."""
        key, idents, line, refused, out, made = None, {}, None, 0, [], None

        def close() -> None:
            done = line or _Order(list(idents))
            out.extend((*key, done.ident[k], place, k, refused) for place, k in enumerate(done.keys, 1))

        for batch in batches:
            made = made or pa.schema([*(batch.schema.field(i) for i in range(many)), pa.field(ident, batch.schema.field(ident).type), ("place", pa.int64()), ("order_key", pa.string()), ("refused", pa.int64())])
            for *own, kind, _, _, op, name, anchor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if key is not None:
                        close()
                    key, idents, line, refused = own, {}, None, 0
                if kind == 0:
                    idents.setdefault(name)
                    continue
                line = line or _Order(list(idents))
                refused += not line.apply(op or "", name, anchor)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)
                out.clear()
        if key is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)

    both = lines.union(steps).repartition(tasks, *keys).sortWithinPartitions(*keys, "_kind", "_o", "_step", "_op", ident)
    return both.mapInArrow(run, schema)
