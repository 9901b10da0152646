"""Similarity join of word n-gram sets: count-vector R-trees, overlap bounded by summed minima of coordinates, exact check.

1. The n-grams of a text are hashed; a group of hashes is a coordinate, the number of n-grams in it the value. Two sets
   can't share more than the sum over coordinates of the smaller value, nor any two sets below two boxes more than that of
   the boxes' upper corners. Equal sets (128-bit digest and size) are one point.
2. Boxes of unrelated texts overlap in so many dimensions, so one tree over all points would prune nothing but sizes.
   The points go to a forest: a tree for each n-gram among those that two sets at the threshold can't both do without
   (the first of each in one order of all n-grams, exact whatever the order). An n-gram with one text falls away; of lists with the same members the first stays.
   The first order is that of the hashes. Members of lists beyond a leaf's size are listed anew, with the n-grams of such lists
   behind all others, longer lists last (known to tasks by a table of fixed size, indexed by hash; n-grams that share a slot
   count as frequent alike), again and again as long as fewer texts are in long lists: what is left consists of frequent n-grams.
3. Every point meets the one that is most typical of most of its trees. Then the trees that still hold several components are packed by
   component and size (sorted in ranges, so that a large tree spreads over tasks) and crossed with themselves from the
   root down: pairs of boxes go if the bound, the sizes, or a component that both share whole say so. First each two leaves
   return their best pair for each two components, then, with what that has linked, all pairs left. Two points that share
   several trees come from the first of them only: two sets at the threshold pass every filter there. No list is capped;
   the pairs of one component are never expanded.
4. Surviving pairs are verified on the whole sets. Components come from star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_table, groups_of, materialize, mix
from tessera.llm.near_dedup import _shingler, components, shingle_sets

#: Points of a leaf, children of a box
LEAF = 64
#: Slots of the table of frequent n-grams: one byte each, in every Python worker and on the driver
SLOTS = 1 << 24
#: Texts in long lists are listed anew while each time this share of them or less is left
SHRINK = 0.8
#: Coordinates of a point: about a quarter of its n-grams, a power of two within these
FEW_GROUPS, MANY_GROUPS = 16, 2048
#: Earlier trees that a point knows of in each of its trees; two points that share only trees beyond these come from several, once each
EARLIER = 64
#: Characters of the texts whose words are hashed at once: their letters stay in a core's cache
PART = 1 << 16
#: Rows of a batch of texts or boxes: Spark, Arrow and Python each hold one whole
BATCH = 1000


def counts(values: np.ndarray, mixed: np.ndarray | None = None) -> np.ndarray:
    """The point of a set of hashes: how many fall in each group. mixed: of the values, if known."""
    groups = min(MANY_GROUPS, max(FEW_GROUPS, 1 << max(0, (len(values) // 4 - 1)).bit_length()))
    mixed = mix(values.view(np.uint64)) if mixed is None else mixed
    return np.bincount(mixed.view(np.int64) & (groups - 1), minlength=groups).astype(np.int32)


def packed(point: np.ndarray) -> bytes:
    """The point in as few bytes a coordinate as its largest needs, behind a byte that says how many."""
    size = 1 if point.max(initial=0) < 1 << 8 else 2 if point.max() < 1 << 16 else 4
    return bytes([size]) + point.astype(f"<u{size}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The same point, or upper corner, in fewer coordinates."""
    return point.reshape(-1, groups).sum(axis=0, dtype=np.int32)


def _in_batches(df: DataFrame) -> DataFrame:
    """materialize, with BATCH rows between Spark and Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH))
    try:
        return materialize(df)
    finally:
        conf.set(key, before)


def _points(width: int, percent: int):
    def points(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for part in groups_of(texts, lambda t: len(t or ""), PART):
                for s in shingle_sets(part, width):
                    mixed = mix(s.view(np.uint64))
                    a, b = (x.sum(dtype=np.uint64).view(np.int64) for x in (s.view(np.uint64), mixed))
                    # a partner shares ceil(n * percent / 100) at least: one of the first n - that + 1 is shared
                    rows.append((len(s), a, b, s[: len(s) - -(-len(s) * percent // 100) + 1], packed(counts(s, mixed))))
            yield pd.DataFrame(rows, columns=["n", "set_a", "set_b", "prefix", "point"])

    return F.pandas_udf(points, "n long, set_a long, set_b long, prefix array<long>, point binary")


def _ordered(width: int, percent: int, classes):
    """n, prefix: as in the first pass, in the order of (class, hash). classes: broadcast array of bytes by slot."""

    def ordered(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for part in groups_of(texts, lambda t: len(t or ""), PART):
                for s in shingle_sets(part, width):
                    order = np.argsort(classes.value[s & (len(classes.value) - 1)], kind="stable")
                    rows.append((len(s), s[order[: len(s) - -(-len(s) * percent // 100) + 1]]))
            yield pd.DataFrame(rows, columns=["n", "prefix"])

    return F.pandas_udf(ordered, "n long, prefix array<long>")


def _lengths(rows: DataFrame, percent: int) -> DataFrame:
    """v, low, high, length of the n-grams of two or more prefixes. low: the smallest n, high: the largest partner a place allows.

    Most n-grams have one text: each batch sums up its own and deals them out as arrays by hash range, so that a frequent one comes once from a batch.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def summed(v: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple:
        order = np.argsort(v)
        v = v[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(v)), bool), v[1:] != v[:-1])))
        return v[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.add.reduceat(length[order], at)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = f["prefix"].to_numpy()
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            if not sizes.sum():
                continue
            n = np.repeat(f["n"].to_numpy(np.int64), sizes)
            place = np.arange(len(n)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = summed(np.concatenate(own).astype(np.int64), n, (n - place) * (100 + percent) // percent - n, np.ones(len(n), np.int64))
            bucket = (mix(found[0].view(np.uint64)) >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            columns = [[p.tobytes() for p in np.split(c[order], starts[1:])] for c in found]
            yield pd.DataFrame({"bucket": bucket[order][starts], **dict(zip(("v", "low", "high", "length"), columns, strict=True))})

    def met(f: pd.DataFrame) -> pd.DataFrame:
        v, low, high, length = summed(*(np.frombuffer(b"".join(f[c]), np.int64) for c in ("v", "low", "high", "length")))
        several = length > 1
        return pd.DataFrame({"v": v[several], "low": low[several], "high": high[several], "length": length[several]})

    arrays = rows.select("n", "prefix").mapInPandas(dealt, "bucket long, v binary, low binary, high binary, length binary")
    return arrays.groupBy("bucket").applyInPandas(met, "v long, low long, high long, length long")


def _bounded(percent: int):
    def bounded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            keep = []
            for p, q in ((unpacked(p), unpacked(q)) for p, q in zip(left, right, strict=True)):
                groups = min(len(p), len(q))
                most = np.minimum(folded(p, groups), folded(q, groups)).sum()
                keep.append(bool(most * (100 + percent) >= percent * (p.sum() + q.sum())))
            yield pd.Series(keep, dtype=bool)

    return F.pandas_udf(bounded, "boolean")


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each row of docs (doc_id, text; other columns are ignored).

    Words are lower-cased over A-Z only. Sets link if 100 * intersection >= percent * union; n_links: the verified
    pairs of its set with other sets (not all there are: pairs within a component aren't expanded). Null, empty or blank
    text: no n-grams, no links. Null doc_id: no part in links, component null. doc_id names the document: repeated rows
    get the same answer; where rows of one doc_id differ in text, links are confirmed on the text with the smallest
    hash. Empty table: no rows.
    """
    docs = docs.select("doc_id", "text")
    digest = _in_batches(docs.select("doc_id", _points(width, percent)("text").alias("s")).select("doc_id", "s.*"))
    named = materialize(digest.drop("prefix", "point"))
    sets = lambda d: d.where("n > 0 and doc_id is not null").groupBy("set_a", "set_b", "n")
    reps = materialize(sets(digest).agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("point").alias("point")), digest)
    links = _links(docs, reps, width, percent)
    classes = sets(named).agg(F.min("doc_id").alias("rep"))
    if links is None:
        classes = classes.select("set_a", "set_b", "n", F.col("rep").alias("component"), F.lit(0).cast("long").alias("n_links"))
    else:
        found = components(links).withColumnRenamed("node", "rep")
        degree = links.select("a", "b").union(links.select("b", "a")).distinct().groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
        classes = classes.join(found, "rep", "left").join(degree, "rep", "left")
        classes = classes.select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = named.join(classes, ["set_a", "set_b", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("doc_id").isNull() | F.col("n_links").isNull(), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def _links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links a < b between representatives (a materialized table, deleted once read) that connect all that the threshold connects; None if there are none."""
    spark = docs.sparkSession

    def texts_of(chosen: DataFrame) -> DataFrame:
        """rep, text of chosen representatives. A filter of fixed size keeps most other texts out of the shuffle; the join decides."""
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
        ids = chosen.select(F.col("rep").alias("doc_id")).distinct()
        bits = np.zeros(SLOTS, bool)
        bits[ids.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)] = True
        known = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

        def held(slots: pd.Series) -> pd.Series:
            at = slots.to_numpy(np.int64)
            return pd.Series((known.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

        near = docs.where("doc_id is not null").where(F.pandas_udf(held, "boolean")(slot))
        return near.join(ids, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def listed(rows: DataFrame) -> DataFrame:
        """v, rep, n, place, most, length: the lists of two or more; most: the largest partner that this place still allows."""
        most = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent - F.col("n"))
        posted = rows.select("rep", "n", F.posexplode("prefix").alias("place", "v")).select("v", "rep", "n", "place", most.alias("most"))
        bounds = materialize(_lengths(rows, percent))
        return materialize(posted.join(bounds.hint("shuffle_hash"), "v").where("most >= low and n <= high").drop("low", "high"), bounds)

    classes, kind, before = np.zeros(SLOTS, np.uint8), 0, None
    found = listed(reps)
    points = materialize(reps.select("rep", "point").join(found.select("rep").distinct(), "rep", "left_semi"), reps)
    lists = found.where(F.col("length") <= LEAF).withColumn("kind", F.lit(kind))
    while True:
        long = found.where(F.col("length") > LEAF)
        members = materialize(long.select("rep").distinct())
        many = members.count()
        if many == 0 or (before is not None and many > SHRINK * before):
            lists = lists.union(long.withColumn("kind", F.lit(kind)))
            break
        frequent = long.groupBy((F.col("v").bitwiseAND(F.lit(SLOTS - 1))).alias("slot")).agg(F.max("length").alias("length")).toPandas()
        np.maximum.at(classes, frequent["slot"].to_numpy(), (1 + np.log2(frequent["length"].to_numpy() / LEAF)).astype(np.uint8))
        known = spark.sparkContext.broadcast(classes.copy())
        again = _in_batches(texts_of(members).select("rep", _ordered(width, percent, known)("text").alias("p")).select("rep", "p.*"))
        found, kind, before = listed(again), kind + 1, many
        drop_table(again)
        lists = lists.union(found.where(F.col("length") <= LEAF).withColumn("kind", F.lit(kind)))

    checked: list[DataFrame] = []

    def verified(pairs: DataFrame, bound: bool) -> DataFrame:
        """The links among pairs (x, y) that weren't checked before. bound: they haven't passed the bound yet."""
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        if bound:
            both = pairs.join(points.toDF("a", "p_a"), "a").join(points.toDF("b", "p_b"), "b")
            pairs = both.where(_bounded(percent)("p_a", "p_b")).select("a", "b")
        for earlier in checked:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        checked.append(pairs)
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
        whole = _in_batches(texts_of(ends).select("rep", _shingler(width)("text").alias("s")))
        both = pairs.join(whole.toDF("a", "s_a"), "a").join(whole.toDF("b", "s_b"), "b")
        common = both.select("a", "b", (F.size("s_a") + F.size("s_b")).alias("sizes"), F.size(F.array_intersect("s_a", "s_b")).alias("common"))
        return common.where(F.col("common") * 100 >= percent * (F.col("sizes") - F.col("common"))).select("a", "b")

    lists = _apart(lists)
    if lists.isEmpty():
        return None
    # the most typical point has the fewest rare n-grams before this one
    typical = lists.groupBy("kind", "v").agg(F.min(F.struct("place", "rep", "n", "most")).alias("t")).select("kind", "v", "t.*")
    fits = F.expr("p.kind = q.kind and p.v = q.v and p.rep <> q.rep and p.n <= q.most and q.n <= p.most")
    met = lists.alias("p").join(typical.alias("q"), fits).select(F.col("q.rep").alias("x"), F.col("p.rep").alias("y"), F.col("p.length").alias("length"))
    # in longer lists a point meets the one that is typical of most of its lists; the trees have what is left
    often = met.where("length > 2").groupBy("y", "x").agg(F.count("*").alias("n")).groupBy("y").agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("t"))
    pairs = met.where("length = 2").select("x", "y").union(often.select("t.x", "y"))
    links = materialize(verified(pairs, bound=True))
    lists = lists.where("length > 2")
    for every in (False, True):
        lists = _mixed(lists, links)
        if lists.isEmpty():
            break
        links = materialize(links.union(verified(_crossed(lists, points, percent, every), bound=False)))
    return None if links.isEmpty() else links


def _apart(lists: DataFrame) -> DataFrame:
    """Without lists whose members are those of an earlier one: what two points of both share first is in the earlier."""
    members = lists.groupBy("kind", "v").agg(F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("m2"), F.count("*").alias("length"), F.sum("place").alias("places"))
    # of lists with the same members the earlier one has the lower place in each of them
    first = members.where("length > 1").groupBy("kind", "m1", "m2", "length").agg(F.min_by("v", F.struct("places", "v")).alias("v"))
    first = materialize(first.select("kind", "v", "length"))
    return materialize(lists.drop("length").join(first, ["kind", "v"]))


def _mixed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """lists with the component `c` of each member, as far as a list has several."""
    lists = lists.drop("c")
    if links.isEmpty():
        return lists.withColumn("c", F.col("rep"))
    at = lists.join(components(links).toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    at = materialize(at.select(lists.columns + ["c"]))
    parts = at.groupBy("kind", "v").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("kind", "v")
    return materialize(at.join(parts, ["kind", "v"], "left_semi"))


# ---------------------------------------------------------------- the trees

_CHILD = "kind int, v long, id long, low long, most long, c long, pure boolean, first long, box binary"
_NODE = _CHILD + ", ids array<long>, lows array<long>, mosts array<long>, cs array<long>, pures array<boolean>, earliers array<array<long>>, boxes binary, groups int"


def _placed(lists: DataFrame, points: DataFrame, long: bool) -> DataFrame:
    """The points of the trees of more than LEAF points, or of the others, a row a tree.

    earlier: the first EARLIER of all lists that hold this point at a lower place, in the order that all points of a kind share.
    """
    own = F.array_sort(F.collect_list(F.struct("place", "v", "n", "most", "c", "length")))
    # dealt by rep alone, so that the lists meet the points where they are gathered
    held = lists.repartition("rep").groupBy("kind", "rep").agg(own.alias("own"))
    held = held.where(F.exists("own", lambda t: (t["length"] > LEAF) == F.lit(long))).join(points.hint("shuffle_hash"), "rep")
    rows = held.select("kind", "rep", "point", F.slice("own.v", 1, EARLIER).alias("known"), F.posexplode("own").alias("at", "t")).where((F.col("t.length") > LEAF) == F.lit(long))
    size = F.col("t.n")
    return rows.select("kind", "t.v", F.col("rep").alias("id"), size.alias("low"), "t.most", "t.c", F.lit(True).alias("pure"), size.alias("first"), F.col("point").alias("box"), "t.length", F.slice("known", F.lit(1), F.col("at")).alias("earlier"))


def _packed(children: DataFrame) -> DataFrame:
    """Boxes of up to LEAF children of one tree, in the order of component and size.

    length: the children of the tree. Only trees of four times as many as there can be ranges are cut into ranges, as
    each range begins a box of its own: so every level is shorter than the one below, however finely Spark deals.
    earlier: of points only, see _placed.
    """
    if "earlier" not in children.columns:
        children = children.withColumn("earlier", F.array().cast("array<long>"))

    def node(key: tuple, rows: list) -> tuple:
        corners = [unpacked(r.box) for r in rows]
        groups = min(map(len, corners))
        boxes = np.stack([folded(c, groups) for c in corners])
        whole = all(r.pure for r in rows) and len({r.c for r in rows}) == 1
        own = (min(r.low for r in rows), max(r.most for r in rows), rows[0].c, whole, rows[0].first, packed(boxes.max(axis=0)))
        lists = ([r.id for r in rows], [r.low for r in rows], [r.most for r in rows], [r.c for r in rows], [bool(r.pure) for r in rows], [r.earlier for r in rows])
        return (*key, rows[0].id, *own, *lists, packed(boxes.ravel()), groups)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _NODE.split(", ")]
        key, rows = None, []
        for frame in frames:
            made = []
            for r in frame.itertuples(index=False):
                if rows and ((r.kind, r.v) != key or len(rows) == LEAF):
                    made.append(node(key, rows))
                    rows = []
                key = (r.kind, r.v)
                rows.append(r)
            if made:
                yield pd.DataFrame(made, columns=names)
        if rows:
            yield pd.DataFrame([node(key, rows)], columns=names)

    ranges = int(children.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = F.col("length") > 4 * max(LEAF, ranges)
    within = ["c", "first", "id"]
    dealt = children.repartitionByRange("kind", "v", *(F.when(large, F.col(c)) for c in within))
    return materialize(dealt.sortWithinPartitions("kind", "v", *within).drop("length").mapInPandas(pack, _NODE))


class _Leaf(NamedTuple):
    """The points of a tree that are its only leaf. boxes: one of each point."""

    kind: int
    v: int
    ids: np.ndarray
    lows: np.ndarray
    mosts: np.ndarray
    cs: np.ndarray
    pures: np.ndarray
    earliers: np.ndarray
    boxes: np.ndarray

    @property
    def groups(self) -> int:
        return min((len(b) - 1) // b[0] for b in self.boxes)


def _overlaps(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Summed minima of the rows i of left and j of right."""
    if 3 * len(i) > len(left) * len(right):
        if left.size * len(right) < 1 << 20:
            return np.minimum(left[:, None, :], right[None, :, :]).sum(axis=2)[i, j]
        return np.stack([np.minimum(row, right).sum(axis=1) for row in left])[i, j]
    step = max(1, (1 << 20) // left.shape[1])
    return np.concatenate([np.minimum(left[i[k : k + step]], right[j[k : k + step]]).sum(axis=1) for k in range(0, len(i), step)] or [np.zeros(0, np.int64)])


def _descend(percent: int, leaves: bool, every: bool):
    """Pairs of boxes to those pairs of their children that the bound, the sizes and the components allow; the same for the points of trees of one leaf."""

    def corners(n, groups: int) -> np.ndarray:
        if isinstance(n.boxes, np.ndarray):
            return np.stack([folded(p, groups) for p in map(unpacked, n.boxes)])
        return unpacked(n.boxes).reshape(len(n.ids), -1, groups).sum(axis=1)

    def survivors(a, b, same: bool) -> tuple:
        (la, ma, ca, pa), (lb, mb, cb, pb) = ((n.lows, n.mosts, n.cs, n.pures) for n in (a, b))
        keep = (la[:, None] <= mb[None, :]) & (lb[None, :] <= ma[:, None])
        keep &= (ca[:, None] != cb[None, :]) | ~pa[:, None] | ~pb[None, :]
        if same:
            keep &= np.tri(len(la), len(lb), -1 if leaves else 0, dtype=bool).T
        i, j = np.nonzero(keep)
        if leaves and len(i):
            known = {x: frozenset(a.earliers[x].tolist()) for x in np.unique(i).tolist()}
            there = {y: frozenset(b.earliers[y].tolist()) for y in np.unique(j).tolist()}
            here = np.fromiter((known[x].isdisjoint(there[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            i, j = i[here], j[here]
        if len(i):
            groups = min(a.groups, b.groups)
            left = corners(a, groups)
            most, sizes = _overlaps(left, left if same else corners(b, groups), i, j), la[i] + lb[j]
            fits = most * (100 + percent) >= percent * sizes
            i, j, most, sizes = i[fits], j[fits], most[fits], sizes[fits]
        if leaves and not every and len(i) > 1:
            low, high = np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])
            order = np.lexsort((b.ids[j], a.ids[i], -most / sizes, high, low))
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
            i, j = i[order[first]], j[order[first]]
        return np.full(len(i), a.kind), np.full(len(i), a.v), a.ids[i], b.ids[j]

    def gathered(found: list[tuple]) -> pd.DataFrame:
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pd.DataFrame({n: np.concatenate([np.zeros(0, np.int64), *c]) for n, c in zip(("kind", "v", "x", "y"), columns, strict=True)})

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield gathered([survivors(r, r, True) for r in f.itertuples(index=False)])

    def apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            left, right = (f[[c for c in f if c.startswith(p)]].rename(columns=lambda c: c[2:]) for p in ("a_", "b_"))
            yield gathered([survivors(a, b, False) for a, b in zip(left.itertuples(index=False), right.itertuples(index=False), strict=True)])

    def single(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Points in the order of trees to the pairs of each tree."""

        def trees(f: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
            kind, v, ids, lows, mosts, cs, pures = (f[c].to_numpy() for c in ("kind", "v", "id", "low", "most", "c", "pure"))
            boxes, earliers, found = f["box"].to_numpy(), f["earlier"].to_numpy(), []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                node = _Leaf(kind[s], v[s], ids[s:e], lows[s:e], mosts[s:e], cs[s:e], pures[s:e].astype(bool), earliers[s:e], boxes[s:e])
                found.append(survivors(node, node, True))
            return gathered(found)

        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if f.empty:
                continue
            kind, v = f["kind"].to_numpy(), f["v"].to_numpy()
            starts = [0, *(np.flatnonzero((np.diff(kind) != 0) | (np.diff(v) != 0)) + 1).tolist()]
            rest = f.iloc[starts[-1] :]
            yield trees(f, starts)
        if rest is not None:
            yield trees(rest, [0, len(rest)])

    return alone, apart, single


def _crossed(lists: DataFrame, points: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (x, y) of points of different components that the trees of `lists` can't refuse, each from the first tree that holds both.

    every: all of them; otherwise the best of each two components that meet in two leaves.
    """
    schema = "kind int, v long, x long, y long"
    # most trees are one leaf: its points are crossed where they meet, and no box is written
    dealt = _placed(lists, points, long=False).drop("first", "length").repartition("kind", "v").sortWithinPartitions("kind", "v")
    short = _in_batches(dealt.mapInPandas(_descend(percent, True, every)[2], schema))
    if lists.where(F.col("length") > LEAF).isEmpty():
        return short.select("x", "y")
    made = _placed(lists, points, long=True)
    names, levels, spent = [c.split()[0] for c in _CHILD.split(", ")], [], []
    while True:
        nodes = _packed(made)
        levels.append(nodes)
        for table in spent:
            drop_table(table)
        several = nodes.groupBy("kind", "v").agg(F.count("*").alias("length")).where("length > 1")
        made = materialize(nodes.select(names).join(several, ["kind", "v"]).select(*names, "length"))
        spent = [made]
        if made.isEmpty():
            break
    pairs = None
    for depth in range(len(levels) - 1, -1, -1):
        nodes, leaves = levels[depth].where("not pure"), depth == 0
        above = levels[depth + 1].select("kind", "v").distinct() if depth + 1 < len(levels) else None
        alone, apart, _ = _descend(percent, leaves, every)
        # roots are crossed with themselves; other boxes as far as a pair from above asks for it
        roots = nodes if above is None else nodes.join(above, ["kind", "v"], "left_anti")
        if pairs is not None:
            own = pairs.where("x = y").select("kind", "v", F.col("x").alias("id"))
            roots = roots.unionByName(nodes.join(own, ["kind", "v", "id"], "left_semi").select(nodes.columns))
        found = roots.mapInPandas(alone, schema)
        if pairs is not None:
            all_ = levels[depth]
            side = lambda p, d=all_: d.select("kind", "v", F.col("id").alias("x" if p == "a_" else "y"), *(F.col(c).alias(p + c) for c in ("kind", "v", "ids", "lows", "mosts", "cs", "pures", "earliers", "boxes", "groups")))
            met = pairs.where("x <> y").join(side("a_"), ["kind", "v", "x"]).join(side("b_"), ["kind", "v", "y"])
            found = found.union(met.select([c for c in met.columns if c[:2] in ("a_", "b_")]).mapInPandas(apart, schema))
        pairs = materialize(found, *levels[depth + 1 : depth + 2])
    drop_table(levels[0])
    return pairs.select("x", "y").union(short.select("x", "y"))
