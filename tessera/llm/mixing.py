"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... carry golden-ratio points, exact in whole numbers; a point falls into the source whose
part of the cumulative weights it lies in. Each source's slots are ranked. Its documents, in a shuffled
order fixed by hash, form one line of words that is cut into equal blocks; the source's r-th slot takes its r-th
block, and starts over when the line is used up. The last block that a target needs is taken in part.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, materialize, running_start

_BITS = 31
#: The golden ratio's fraction of 2**31, to the next odd number
_GOLDEN = 1327217885
_CELLS = 1 << 10
_CHUNK = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of each row's whole text (null: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: list[float], most: float = 3.0) -> DataFrame:
    """source, source_size, weight, target: all sizes together, shared by weight, none above `most` times its source's size.

    Sources by code point (null last) get the weights in turn. The excess of a capped source is shared among the
    others by weight until none is above: all of them end at min(cap, weight * level) with one level. One row a source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_r") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("_cap", most * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), "_r")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    # the level if this source, by cap for its weight, is the first that isn't capped; the first that fits has the highest
    level = (everything - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = capped.withColumn("_level", level).withColumn("_fits", F.col("_cap") >= F.col("weight") * F.col("_level"))
    shared = F.max(F.when(F.col("_fits"), F.col("_level"))).over(Window.partitionBy(F.lit(1)))
    return levels.withColumn("target", F.least("_cap", F.coalesce(F.col("weight") * shared, F.col("_cap")))).select("source", "source_size", "weight", "target")


def schedule(quota: DataFrame, slots: int) -> DataFrame:
    """slot, sid, r: the r-th slot of each source; quota (sid, share, need): shares sum to 1; every source gets `need` slots.

    Slots beyond a source's need are left out; where its points fall short of it, slots after the last make up for that.
    """
    spark = quota.sparkSession
    scale = F.lit(float(1 << _BITS))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    parts = quota.withColumn("_hi", F.round(F.sum("share").over(upto) * scale).cast("long")).withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("sid")), F.lit(0))).where("_hi > _lo")
    cell = (1 << _BITS) // _CELLS
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor((F.col("_hi") - 1) / cell))))
    point = (F.col("id") % (1 << _BITS)) * _GOLDEN % (1 << _BITS)
    drawn = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") / cell))
    hits = materialize(drawn.join(parts, "cell").where("u >= _lo and u < _hi").select("slot", "sid", F.floor(F.col("slot") / _CHUNK).alias("chunk")))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = hits.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("sid", "chunk", "base")
    ranked = hits.withColumn("k", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(base, ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("k")).alias("r"))
    kept = ranked.join(quota.select("sid", "need"), "sid").where("r < need").select("slot", "sid", "r")
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = quota.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    made_up = short.select("sid", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("r")).select((F.col("r") + slots).alias("slot"), "sid", "r")
    return kept.union(made_up)


def mix_sources(docs: DataFrame, weights: list[float], most: float = 3.0, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of docs (doc_id, text, source; other columns are ignored).

    documents: doc_id, size, source_size, target, taken, first_slot, slots, one row for each row of docs. taken: its words
    in the mix, repeats counted; a source's add up to its target, rounded down. No row is taken more than `most` times
    over, rounded up. first_slot: the first slot of the mix that holds words of it, null where none does; slots: how many do.
    pieces: slot, sid, epoch, doc_row, low, high: in slot order, the words [low, high) of a row that the mix holds.
    Null source is a source of its own, last in order; null, empty and blank texts have size 0 and are never taken.
    Repeated rows count each. An empty table gives no rows.
    """
    sized = materialize(sizes(docs))
    plan = targets(sized, weights, most).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    plan = materialize(plan)
    keyed = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select("doc_id", "size", "sid", "source_size", "target")
    # rows are numbered, since doc_id may repeat; the number only tells them apart
    keyed = materialize(keyed.withColumn("doc_row", F.monotonically_increasing_id()))
    summary = plan.agg(F.sum("source_size").alias("words"), F.count("*").alias("sources")).first()
    words = summary["words"] or 0
    rows = keyed.count()
    lined = running_start(keyed.where("size > 0"), ["sid"], ["doc_id", "size"], "size", rows, "begin", ties=("doc_row",))
    quota = plan.where("target >= 1").select("sid", F.col("target").cast("long").alias("want"), F.col("source_size").alias("line"), "target").withColumn("need", F.ceil(F.col("want") / block))
    # a wrap-around cuts a block short at the line's end, so that a source's blocks are: full ones, then the rest of the line
    per_line = F.ceil(F.col("line") / block)
    full, over = F.floor(F.col("want") / F.col("line")), F.col("want") % F.col("line")
    quota = quota.withColumn("need", full * per_line + F.ceil(over / block)).withColumn("per_line", per_line).withColumn("over", over).withColumn("full", full)
    share = F.col("need") / F.sum("need").over(Window.partitionBy(F.lit(1)))
    quota = materialize(quota.withColumn("share", share.cast("double")))
    slots = (quota.agg(F.sum("need")).first()[0] or 0) if words else 0
    placed = schedule(quota.select("sid", "share", "need"), int(slots))
    taken_blocks = placed.join(quota.select("sid", "per_line", "over", "full"), "sid").select(
        "slot", "sid", F.floor(F.col("r") / F.col("per_line")).alias("epoch"), (F.col("r") % F.col("per_line")).alias("b"), "over", "full"
    )
    end = F.when(F.col("epoch") == F.col("full"), F.least(F.col("over"), (F.col("b") + 1) * block)).otherwise((F.col("b") + 1) * block)
    taken_blocks = taken_blocks.select("slot", "sid", "epoch", "b", end.alias("end"))
    last = F.floor((F.col("begin") + F.col("size") - 1) / block)
    parts = lined.withColumn("b", F.explode(F.sequence(F.floor(F.col("begin") / block), last))).select("sid", "b", "doc_row", "begin", "size")
    low = F.greatest(F.col("b") * block, F.col("begin")) - F.col("begin")
    high = F.least(F.col("end"), F.col("begin") + F.col("size")) - F.col("begin")
    pieces = parts.join(taken_blocks, ["sid", "b"]).select("slot", "sid", "epoch", "doc_row", low.alias("low"), high.alias("high")).where("high > low")
    took = pieces.groupBy("doc_row").agg(F.sum(F.col("high") - F.col("low")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("slots"))
    taken, count = (F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", "slots"))
    documents = keyed.join(took, "doc_row", "left").select("doc_id", "size", "source_size", "target", taken, "first_slot", count, "doc_row")
    return documents, pieces
