"""Operators whose next step reads what the last one put out. Each key's rows are folded in order.

Folds that carry one row run in the JVM over the key's sorted array; greedy ones run in applyInPandas. A key's
rows meet in one task, as the semantics demand: choose keys (a recording, a plan) whose rows are bounded.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(df: DataFrame, keys: list[str], fields: list[str], order: list[str], kind: str, step) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    folded = df.groupBy(*keys).agg(rows.alias("_rows"))
    start = F.array().cast(f"array<{kind}>")
    return folded.select(*keys, F.posexplode(F.aggregate("_rows", start, step)).alias("place", "_r")).select(*keys, "place", "_r.*")


def _replace_last(done: Column, last: Column) -> Column:
    return F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last))


def merge_captions(df: DataFrame, keys: list[str], *, gap: int, chars: int, length: int) -> DataFrame:
    """keys, place, s, e, role, text, n: captions of one role joined while the gap, the joined text and its span stay within bounds.

    df: s, e, role, text, ident. The test reads the text joined so far, so that three short captions of
    which any two would fit may end as two.
    """

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat_ws(" ", last["text"], x["text"])
        fits = (F.size(done) > 0) & last["role"].eqNullSafe(x["role"]) & (x["s"] - last["e"] <= gap) & (F.length(joined) <= chars) & (F.greatest(last["e"], x["e"]) - last["s"] <= length)
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["role"].alias("role"), joined.alias("text"), (last["n"] + 1).alias("n"))
        alone = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["role"].alias("role"), x["text"].alias("text"), F.lit(1).alias("n"))
        return F.when(fits, _replace_last(done, longer)).otherwise(F.concat(done, F.array(alone)))

    role = df.schema["role"].dataType.simpleString()
    return _fold(df, keys, ["s", "e", "role", "text", "ident"], ["s", "e", "ident"], f"struct<s: bigint, e: bigint, role: {role}, text: string, n: int>", step)


def normalize_plan(df: DataFrame, keys: list[str], *, least: int = 1) -> DataFrame:
    """keys, place, s, e, role: a gapless plan; overlaps cut the later row, gaps go to the row before, neighbours of one role merge.

    df: s, e, role, ident. A row that lies inside earlier ones, or keeps less than `least`, is left out.
    """

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        begin = F.greatest(x["s"], F.coalesce(last["e"], x["s"]))
        left_out = x["e"] - begin < least
        same = (F.size(done) > 0) & (last["role"] == x["role"])
        longer = F.struct(last["s"].alias("s"), x["e"].alias("e"), last["role"].alias("role"))
        filled = F.struct(last["s"].alias("s"), begin.alias("e"), last["role"].alias("role"))
        own = F.struct(begin.alias("s"), x["e"].alias("e"), x["role"].alias("role"))
        grown = F.when(F.size(done) > 0, F.concat(_replace_last(done, filled), F.array(own))).otherwise(F.array(own))
        return F.when(left_out, done).when(same, _replace_last(done, longer)).otherwise(grown)

    return _fold(df, keys, ["s", "e", "role", "ident"], ["s", "e", "ident"], "struct<s: bigint, e: bigint, role: string>", step)


def minimum_hold(df: DataFrame, keys: list[str], *, least: int) -> DataFrame:
    """keys, place, s, e, role: the shortest segment below `least` merges into its longer neighbour, until none is left.

    df: s, e, role of a gapless plan. Ties: the earlier segment, the earlier neighbour. Neighbours of one role are one segment.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "place int", "s long", "e long", f"role {kinds['role']}"])
    many = len(keys)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's plans one after the other."""
        key, plan, out, made = None, [], [], None

        def close() -> None:
            out.extend((*key, place, *segment) for place, segment in enumerate(_held(plan, least)))

        for batch in batches:
            made = made or pa.schema([*(batch.schema.field(i) for i in range(many)), ("place", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), pa.field("role", batch.schema.field("role").type)])
            for *own, s, e, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if key is not None:
                        close()
                    key, plan = own, []
                plan.append((s, e, role))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)
                out.clear()
        if key is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made, strict=True)], schema=made)

    rows = df.select(*keys, F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "role")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "s", "e").mapInArrow(hold, schema)


def _held(plan: list[tuple], least: int) -> list[tuple]:
    """The plan's segments after merging, by a heap of lengths over a linked list."""
    begin, end, role = (list(x) for x in zip(*plan, strict=True))
    ahead, behind = [i - 1 for i in range(len(plan))], [*range(1, len(plan)), -1]
    there = [True] * len(plan)

    def absorb(i: int, j: int) -> None:
        """Segment i becomes part of its neighbour j."""
        begin[j], end[j], there[i] = min(begin[i], begin[j]), max(end[i], end[j]), False
        if ahead[i] >= 0:
            behind[ahead[i]] = behind[i]
        if behind[i] >= 0:
            ahead[behind[i]] = ahead[i]

    def join_alike(j: int) -> int:
        while behind[j] >= 0 and role[behind[j]] == role[j]:
            absorb(behind[j], j)
        while ahead[j] >= 0 and role[ahead[j]] == role[j]:
            j, old = ahead[j], j
            absorb(old, j)
        return j

    for i in range(len(plan)):
        if there[i]:
            join_alike(i)
    waiting = [(end[i] - begin[i], begin[i], i) for i in range(len(plan)) if there[i]]
    heapq.heapify(waiting)
    while waiting:
        length, start, i = heapq.heappop(waiting)
        if not there[i] or (length, start) != (end[i] - begin[i], begin[i]):
            continue
        near = [j for j in (ahead[i], behind[i]) if j >= 0]
        if length >= least or not near:
            break
        j = max(near, key=lambda k: (end[k] - begin[k], -begin[k]))
        absorb(i, j)
        j = join_alike(j)
        heapq.heappush(waiting, (end[j] - begin[j], begin[j], j))
    return [(begin[i], end[i], role[i]) for i in range(len(plan)) if there[i]]


def suppress_peaks(df: DataFrame, keys: list[str], at: str, score: str, *, apart: int, many: int) -> DataFrame:
    """keys, place, at, score: the best rows of a key, each at least `apart` from the better ones taken; ties to the earlier."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = []
        for r in pdf.sort_values([score, at], ascending=[False, True]).itertuples():
            if len(taken) == many:
                break
            if all(abs(getattr(r, at) - t[0]) >= apart for t in taken):
                taken.append((getattr(r, at), getattr(r, score)))
        out = pd.DataFrame(taken, columns=[at, score])
        out["place"] = range(1, len(out) + 1)
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "place", at, score]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "place int", f"{at} {kinds[at]}", f"{score} {kinds[score]}"])
    return df.groupBy(*keys).applyInPandas(take, schema)


def allocate(df: DataFrame, keys: list[str], ident: str, weight: str, cap: str, *, total: int) -> DataFrame:
    """keys, ident, share: `total` units of a key by weight, none above its cap, by largest remainder; ties to the smaller ident.

    Null weights and caps are 0. What capped rows can't take goes to the others by weight; less than `total` is dealt only if all are full.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.fillna({weight: 0, cap: 0})
        rows = [[r[0], float(r[1]), int(r[2]), 0] for r in known.sort_values(ident)[[ident, weight, cap]].itertuples(index=False)]
        left = min(total, sum(r[2] for r in rows))
        while left > 0:
            free = [r for r in rows if r[3] < r[2]]
            base = sum(r[1] for r in free)
            wants = [left * r[1] / base if base > 0 else left / len(free) for r in free]
            whole = [min(int(w), r[2] - r[3]) for w, r in zip(wants, free, strict=True)]
            if sum(whole) == 0:
                for i in sorted(range(len(free)), key=lambda j: (-(wants[j] - int(wants[j])), j))[:left]:
                    whole[i] = 1
            for r, w in zip(free, whole, strict=True):
                r[3] += w
            left -= sum(whole)
        out = pd.DataFrame({ident: [r[0] for r in rows], "share": [r[3] for r in rows]})
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, ident, "share"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{ident} {kinds[ident]}", "share long"])
    return df.groupBy(*keys).applyInPandas(deal, schema)


def leaders(df: DataFrame, keys: list[str], ident: str, code: str, quality: str, *, within: int) -> DataFrame:
    """keys, ident, leader: 64-bit codes by quality; each joins the first leader at Hamming distance `within` or less, or leads itself.

    Codes at such a distance agree on one of within + 1 bands of bits, so only leaders that share a band are compared.
    A row without a code leads itself alone.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    edges = [64 * i // (within + 1) for i in range(within + 2)]

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, by_band, out = [], {}, []
        for i, c in pdf.sort_values([quality, ident], ascending=[False, True])[[ident, code]].itertuples(index=False):
            if pd.isna(c):
                out.append((i, i))
                continue
            c = int(c) & (2**64 - 1)
            bands = [(k, (c >> low) & ((1 << (high - low)) - 1)) for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False))]
            near = sorted({h for b in bands for h in by_band.get(b, ())})
            head = next((h for h in near if (c ^ heads[h][1]).bit_count() <= within), None)
            if head is None:
                head = len(heads)
                heads.append((i, c))
                for b in bands:
                    by_band.setdefault(b, []).append(head)
            out.append((i, heads[head][0]))
        out = pd.DataFrame(out, columns=[ident, "leader"])
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, ident, "leader"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{ident} {kinds[ident]}", f"leader {kinds[ident]}"])
    return df.groupBy(*keys).applyInPandas(lead, schema)


def follow_frames(rows: pd.DataFrame, made: int, seen: dict, *, far: float, memory: int, dense: int = 4000) -> tuple[list[tuple], int, dict]:
    """(frame, item, track) of boxes (frame, item, x, y, area), the number of tracks made, and the tracks last seen: track -> (frame, x, y).

    In frames of more than `dense` pairs of boxes and tracks the nearest track is looked for among those ordered by x, from the box outwards.
    """
    out = []
    rows = rows.dropna(subset=["frame"]).sort_values(["frame", "area", "item"], ascending=[True, False, True])
    frames, items, xs, ys = (rows[c].tolist() for c in ("frame", "item", "x", "y"))
    start = 0
    while start < len(frames):
        frame, end = frames[start], start
        while end < len(frames) and frames[end] == frame:
            end += 1
        seen = {t: v for t, v in seen.items() if frame - v[0] <= memory}
        pick = (_nearest_of_many if (end - start) * len(seen) > dense else _nearest_of_few)(seen, far)
        for i in range(start, end):
            t = pick(xs[i], ys[i])
            if t is None:
                t, made = made, made + 1
            seen[t] = (frame, xs[i], ys[i])
            out.append((frame, items[i], t))
        start = end
    return out, made, seen


def _nearest_of_few(seen: dict, far: float):
    """A function that takes the nearest track no further than `far` from (x, y), the older of equals, each track once."""
    free = {t: (x, y) for t, (_, x, y) in seen.items()}

    def pick(x: float, y: float) -> int | None:
        near, best = None, far
        for t, (u, v) in free.items():
            d = math.sqrt((x - u) * (x - u) + (y - v) * (y - v))
            if d < best or (d == best and (near is None or t < near)):
                near, best = t, d
        if near is not None:
            del free[near]
        return near

    return pick


def _nearest_of_many(seen: dict, far: float, least: int = 32):
    """The same for many tracks: a stretch around x in the order of x grows until none outside it can be nearer."""
    t = np.array(list(seen))
    x, y = (np.array([v[k] for v in seen.values()], float) for k in (1, 2))
    good = np.isfinite(x) & np.isfinite(y)
    t, x, y = t[good], x[good], y[good]
    by = np.lexsort((t, x))
    t, x, y = t[by], x[by], y[by]
    edges = x.tolist()

    def pick(a: float, b: float) -> int | None:
        nonlocal t, x, y, edges, taken
        if not (math.isfinite(a) and math.isfinite(b)):
            return None
        if taken > len(edges) // 2:  # those taken are left out now and then, so that no stretch is full of them
            kept = np.isfinite(y)
            t, x, y, taken = t[kept], x[kept], y[kept], 0
            edges = x.tolist()
        place, width = bisect.bisect_left(edges, a), least
        while True:
            low, high = max(0, place - width), min(len(edges), place + width)
            d = np.sqrt((a - x[low:high]) * (a - x[low:high]) + (b - y[low:high]) * (b - y[low:high]))
            best = min(d.min(initial=np.inf), far)
            if (low == 0 or a - edges[low - 1] > best) and (high == len(edges) or edges[high] - a > best):
                break
            width *= 2
        near = np.flatnonzero((d == best) & np.isfinite(d))
        if not len(near):
            return None
        i = low + int(near[t[low + near].argmin()])
        y[i], taken = np.inf, taken + 1
        return int(t[i])

    taken = 0
    return pick


def track(df: DataFrame, keys: list[str], *, far: float, memory: int) -> DataFrame:
    """keys, frame, item, track: boxes of frames followed from one to the next; larger boxes choose first.

    df: keys, frame (whole numbers), item, x, y, area. A box takes the nearest free track seen in the last `memory` frames
    and no further than `far`; ties to the older track. Others begin a track. Tracks are numbered from 0 by key.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out, *_ = follow_frames(pdf, 0, {}, far=far, memory=memory)
        out = pd.DataFrame(out, columns=["frame", "item", "track"])
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out[[*keys, "frame", "item", "track"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"frame {kinds['frame']}", f"item {kinds['item']}", "track long"])
    return df.groupBy(*keys).applyInPandas(follow, schema)
