"""Near-duplicate documents: bottom-k sketches from one hash function, inverted lists, union-sketch filter, exact check.

1. Each document's distinct word shingles are hashed by one function; the k smallest values are its sketch.
   Documents with equal sets (128-bit digest and size) are linked at once and stand behind one of them.
2. Inverted lists: two sets at the threshold share at least `fewest` values of their sketches but for a chance of
   6e-7 a pair (16 of k = 32 at 0.85, 13 at 0.80; the chance falls steeply above), so they share one of the
   rarest k-fewest+1 retained values of either. Only those postings are kept, rarest first: values of passages that
   many documents share fall away by themselves. A list of few documents yields its pairs.
3. The members of long lists (many near copies) are listed anew by all their shingles, rarest first, as far as the
   threshold needs (exact prefix filter), with what each place still allows as a partner's size (positional
   filter). What is still long yields links to pivots, the most typical documents first: each round,
   documents outside a list's main component are compared with the others not yet connected to them, until
   the list is one component or has no pair left to compare. No list is capped, none expanded into all pairs.
4. Candidates pass by size ratio, then by the Jaccard estimate over the union's sketch, which refuses a pair at
   the threshold with a chance of 4e-7, then by the exact sets of whole texts. Components of the links come from alternating star contractions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import groups_of, materialize, mix, word_hashes

SHORT_LIST = 24
#: Values of a sketch that the estimate on a candidate pair uses
ESTIMATE_K = 128
#: Chances that sketches, and that the estimate, miss a pair at the threshold: below one in a million together
SKETCH_MISS, ESTIMATE_MISS = 6e-7, 4e-7


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of `width` words; the whole sequence if it is shorter."""
    words, first = word_hashes([(t or "").encode() for t in texts], lower=True)
    runs = np.full(len(words), width, np.uint64)
    for j in range(width):
        left = max(0, len(words) - j)
        runs[:left] = mix(runs[:left] * np.uint64(0x9E3779B97F4A7C15) + words[j:])
    for start, end in zip(first[:-1], first[1:], strict=True):
        if end - start >= width:
            own = np.sort(runs[start : end - width + 1].view(np.int64))
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            whole = np.full(min(1, end - start), end - start, np.uint64)
            for j in range(start, end):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + words[j])
            yield whole.view(np.int64)


def fewest(many: int, percent: int, chance: float) -> int:
    """The most values that two sets at the threshold have in common among the `many` smallest of their union, but for `chance`."""
    p, below, low = percent / 100, 0.0, 0
    while low < many:
        below += math.comb(many, low) * p**low * (1 - p) ** (many - low)
        if below > chance:
            break
        low += 1
    return low


def _sketcher(width: int, k: int):
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for part in groups_of(texts, lambda t: len(t or "")):
                for s in shingle_sets(part, width):
                    a, b = (mix(s.view(np.uint64) ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64) for c in (0x243F6A8885A308D3, 0x13198A2E03707344))
                    rows.append((len(s), a, b, s[:k]))
            yield pd.DataFrame(rows, columns=["n", "set_a", "set_b", "sketch"])

    return F.pandas_udf(sketch, "n long, set_a long, set_b long, sketch array<long>")


def _shingler(width: int):
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([s for part in groups_of(texts, lambda t: len(t or "")) for s in shingle_sets(part, width)])

    return F.pandas_udf(shingles, "array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b), by large-star and small-star contractions."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small)
        # stars around the smallest nodes: every end has one centre, and no centre is an end
        ends = small.groupBy("u").agg(F.count("*").alias("n"))
        if ends.where("n > 1").isEmpty() and small.join(ends.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        edges = small
    return small.select(F.col("u").alias("node"), F.col("v").alias("component")).union(small.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text; other columns are ignored).

    Words are lower-cased over A-Z only. Sets link if 100 * intersection >= percent * union.
    Null, empty or blank text: no shingles, no links. Null doc_id: no part in links, component null, kept.
    doc_id names the document: repeated rows get the same answer, ties go to the smallest doc_id; where rows of one doc_id
    differ in text, links are confirmed on the text with the smallest hash. Empty table: no rows.
    """
    docs = docs.select("doc_id", "text")
    made = docs.select("doc_id", _sketcher(width, k)("text").alias("s"))
    digest = materialize(made.select("doc_id", "s.*"))
    sets = digest.where("n > 0 and doc_id is not null").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    sets = materialize(sets)
    links = _links(docs, sets.select("rep", "n", "sketch"), width, percent, k)
    classes = sets.select("set_a", "set_b", "n", "rep")
    if links is not None:
        found = components(links)
        classes = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    else:
        classes = classes.withColumnRenamed("rep", "component")
    out = digest.drop("sketch").join(classes, ["set_a", "set_b", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _links(docs: DataFrame, reps: DataFrame, width: int, percent: int, k: int) -> DataFrame | None:
    """Links a < b between representatives that connect all that the threshold connects; None if there are none."""
    whole = math.floor(k * percent / 100)  # a set this small and any set near it are whole in their sketches
    least = F.when(F.col("n") <= whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.least(F.lit(fewest(k, percent, SKETCH_MISS)), F.floor(F.col("size") / 2)))
    posted = reps.select("rep", F.col("n").alias("whole_n"), F.size("sketch").alias("size"), least.alias("least"), F.explode("sketch").alias("v"))
    listed = _rarest(posted, F.col("size"), F.col("least")).select("v", "rep")
    listed = materialize(listed)
    lengths = materialize(listed.groupBy("v").agg(F.count("*").alias("length")).where("length > 1"))
    listed = materialize(listed.join(lengths, "v"))
    named = listed.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(named, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sets = materialize(texts.select(F.col("doc_id").alias("rep"), _shingler(width)("text").alias("s")).withColumn("n", F.size("s").cast("long")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (x, y)."""
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        brief = sets.select("rep", "n", F.slice("s", 1, ESTIMATE_K))
        pairs = pairs.join(brief.toDF("a", "n_a", "s_a"), "a").join(brief.toDF("b", "n_b", "s_b"), "b")
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, ESTIMATE_K)
        shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
        alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        likely = shared * ESTIMATE_K >= F.size(union) * fewest(ESTIMATE_K, percent, ESTIMATE_MISS)
        pairs = materialize(pairs.where(alike).where(likely).select("a", "b"))
        both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("s_b")), "b")
        common = both.select("a", "b", (F.size("s_a") + F.size("s_b")).alias("sizes"), F.size(F.array_intersect("s_a", "s_b")).alias("common"))
        return materialize(common.where(F.col("common") * 100 >= percent * (F.col("sizes") - F.col("common"))).select("a", "b"))

    short = listed.where(f"length <= {SHORT_LIST}")
    pairs = short.alias("p").join(short.alias("q"), F.expr("p.v = q.v and p.rep < q.rep")).select(F.col("p.rep").alias("x"), F.col("q.rep").alias("y"))
    links = verified(pairs)
    long = listed.where(f"length > {SHORT_LIST}").select("rep").distinct()
    relisted = _relisted(sets.join(long, "rep", "left_semi"), percent)
    if not relisted.isEmpty():
        links = _connected(links, relisted, verified)
    return None if links.isEmpty() else links


def _rarest(posted: DataFrame, size, least) -> DataFrame:
    """posted (rep, v, ...) with `place` (from 0, rarest values first): the places that two sets with `least` values in common can't both miss.

    Values in one set only come first; they are counted, but not returned.
    """
    # written, so that both sides of the join are plain shuffles, whose large partitions Spark can split
    often = materialize(posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    own = Window.partitionBy("rep")
    ranked = posted.join(often, "v").withColumn("place", F.row_number().over(own.orderBy("df", "v")) - 1 + size - F.count("*").over(own))
    return ranked.where(F.col("place") <= size - least).drop("df")


def _relisted(sets: DataFrame, percent: int) -> DataFrame:
    """v, rep, n, place, most, length: lists by rare shingles; most: the largest partner that this place still allows."""
    posted = sets.select("rep", "n", F.explode("s").alias("v"))
    lists = _rarest(posted, F.col("n"), F.ceil(F.col("n") * percent / 100))
    most = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent - F.col("n"))
    lists = materialize(lists.select("v", "rep", "n", "place", most.alias("most")))
    for _ in range(2):
        bounds = lists.groupBy("v").agg(F.min("n").alias("low"), F.max("most").alias("high"), F.count("*").alias("length")).where("length > 1")
        lists = materialize(lists.select("v", "rep", "n", "place", "most").join(bounds, "v").where("most >= low and n <= high").drop("low", "high"))
    lengths = lists.groupBy("v").agg(F.count("*").alias("length")).where("length > 1")
    return materialize(lists.drop("length").join(lengths, "v"))


def _connected(links: DataFrame, lists: DataFrame, verified) -> DataFrame:
    """links and as many more from the lists as connect all that they can."""
    fits = F.expr("p.rep <> q.rep and p.n <= q.most and q.n <= p.most")
    short, long = lists.where(f"length <= {SHORT_LIST}"), lists.where(f"length > {SHORT_LIST}")
    pairs = short.alias("p").join(short.alias("q"), F.expr("p.v = q.v and p.rep < q.rep") & fits).select(F.col("p.rep").alias("x"), F.col("q.rep").alias("y"))
    # the most typical document has the fewest rare shingles before this one
    typical = long.groupBy("v").agg(F.min(F.struct("place", "rep", "n", "most")).alias("t")).select("v", "t.*")
    pairs = pairs.union(long.alias("p").join(typical.alias("q"), F.expr("p.v = q.v") & fits).select(F.col("q.rep").alias("x"), F.col("p.rep").alias("y")))
    links = materialize(links.union(verified(pairs)))
    left, slots = long.join(typical.select("v", "rep"), ["v", "rep"], "left_anti").select("v", "rep", "n", "place", "most"), 8
    while not left.isEmpty():
        label = components(links).toDF("rep", "c")
        at = materialize(left.join(label, "rep", "left").withColumn("c", F.coalesce("c", "rep")))
        weights = at.groupBy("v", "c").agg(F.count("*").alias("w"))
        main = weights.groupBy("v").agg(F.max(F.struct("w", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("v", F.col("m.c").alias("main"))
        at = materialize(at.join(main, "v"))
        minor = at.where("c <> main")
        cost = at.groupBy("v").agg(F.count("*").alias("all"), F.count_if(F.col("c") != F.col("main")).alias("few")).agg(F.sum(F.col("all") * F.col("few")).alias("pairs"), F.sum("all").alias("rows")).first()
        if not cost["pairs"]:
            break
        last = cost["pairs"] <= 256 * cost["rows"]  # few are left outside: all of them at once, and nothing is left to compare
        if last:
            chosen = minor.select("v", "place", "rep", "n", "most", "c")
        else:
            slot = F.pmod(F.xxhash64("rep"), F.lit(slots)).alias("slot")
            chosen = materialize(minor.groupBy("v", slot).agg(F.min(F.struct("place", "rep", "n", "most", "c")).alias("t")).select("v", "t.*"))
        pairs = at.alias("p").join(chosen.alias("q"), F.expr("p.v = q.v and p.c <> q.c") & fits).select(F.col("q.rep").alias("x"), F.col("p.rep").alias("y"))
        links = materialize(links.union(verified(pairs)))
        if last:
            break
        left = at.join(chosen.select("v", "rep"), ["v", "rep"], "left_anti").select("v", "rep", "n", "place", "most")
        slots *= 4
    return links
