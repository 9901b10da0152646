"""Many sources on one clock: offsets measured between pairs of sources, combined along the surest paths, conflicts reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpointed

#: Scores are whole thousandths: 0 to SURE
SURE = 1000


def best_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, offset, score: of all measurements between two sources the surest (then the smallest offset), with both signs.

    pairs: keys, a, b, offset (time in b = time in a + offset), score. Rows with a null, and of a source with itself, don't count.
    """
    known = pairs.where("a is not null and b is not null and offset is not null and score is not null and a <> b")
    turned = F.col("a") > F.col("b")
    ordered = known.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, -F.col("offset")).otherwise(F.col("offset")).alias("offset"), "score")
    best = ordered.groupBy(*keys, "a", "b").agg(F.min(F.struct((-F.col("score")).alias("s"), "offset")).alias("m"))
    one = best.select(*keys, "a", "b", "m.offset", (-F.col("m.s")).alias("score"))
    return one.unionByName(one.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("offset")).alias("offset"), "score"))


def common_clock(pairs: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, offset, hops, doubt: each source's offset against the group's reference, along the path of least doubt.

    sources: keys, source, reference (boolean: one a group; of several the smallest source counts, as it does where there is none).
    A pair's doubt is what its score lacks of SURE, plus 1; a path's the sum. Ties: fewer hops, then the smaller path of names. Sources
    that no path reaches have nulls. Each round lets every source take what its neighbours found: as many rounds as the longest
    path has hops, all groups at once, joined by key and source.
    """
    edges = checkpointed(best_pairs(pairs, keys).withColumn("doubt", F.greatest(F.lit(SURE) - F.col("score"), F.lit(0)) + 1))
    names = sources.groupBy(*keys, "source").agg(F.max(F.coalesce("reference", F.lit(False))).alias("reference")).where("source is not null")
    first = names.groupBy(*keys).agg(F.min(F.struct((~F.col("reference")).alias("r"), "source")).alias("m"))
    label = F.struct(F.lit(0).cast("long").alias("doubt"), F.lit(0).alias("hops"), F.array(F.col("m.source")).alias("path"), F.lit(0).cast("long").alias("offset"))
    labels = checkpointed(first.select(*(F.col(k) for k in keys), F.col("m.source").alias("source"), label.alias("label"), F.lit(True).alias("fresh")))
    while not labels.where("fresh").isEmpty():
        from_ = labels.where("fresh").select(*keys, F.col("source").alias("a"), "label")
        step = from_.join(edges, [*keys, "a"])
        longer = F.struct((F.col("label.doubt") + F.col("doubt")).alias("doubt"), (F.col("label.hops") + 1).alias("hops"), F.concat("label.path", F.array("b")).alias("path"), (F.col("label.offset") + F.col("offset")).cast("long").alias("offset"))
        found = step.select(*keys, F.col("b").alias("source"), longer.alias("label"), F.lit(1).alias("new"))
        every = labels.select(*keys, "source", "label", F.lit(0).alias("new")).unionByName(found)
        labels = checkpointed(every.groupBy(*keys, "source").agg(F.min(F.struct("label", "new")).alias("m")).select(*keys, "source", "m.label", (F.col("m.new") == 1).alias("fresh")))
    return names.select(*keys, "source").join(labels, [*keys, "source"], "left").select(*keys, "source", "label.offset", "label.hops", "label.doubt")


def clock_conflicts(pairs: DataFrame, clock: DataFrame, keys: list[str], *, slack: int) -> DataFrame:
    """keys, a, b, offset, score, off: measurements that are more than `slack` off what the common clock says, and by how much."""
    at = clock.where("offset is not null").select(*keys, "source", F.col("offset").alias("_o"))
    known = pairs.where("offset is not null").select(*keys, "a", "b", "offset", "score")
    both = known.join(at.withColumnsRenamed({"source": "a", "_o": "_a"}), [*keys, "a"]).join(at.withColumnsRenamed({"source": "b", "_o": "_b"}), [*keys, "b"])
    off = F.col("offset") - (F.col("_b") - F.col("_a"))
    return both.withColumn("off", off).where(F.abs(off) > slack).select(*keys, "a", "b", "offset", "score", "off")


def synced_ranges(sources: DataFrame, clock: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, s, e: each source (keys, source, length) as a range of the reference's time; sources without offset or length are left out."""
    rows = sources.where("length > 0").join(clock.where("offset is not null"), [*keys, "source"])
    return rows.select(*keys, "source", (-F.col("offset")).alias("s"), (F.col("length") - F.col("offset")).alias("e"))
