"""Captions moved to where their words are spoken, held long enough to be read, short ones joined.

A recording's captions and words meet in one task, as each search begins where the last one ended; everything else is windows
and one JVM fold. Times are whole microseconds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.folds import _fold, _replace_last


def spoken_starts(captions: DataFrame, words: DataFrame, keys: list[str], ident: str, *, before: int = 350_000, after: int = 8_000_000, margin: int = 100_000, longest: int = 16, shortest: int = 3, chained: bool = True) -> DataFrame:
    """keys, ident, spoken, size, place: where each caption's text begins among the words, null where it isn't found.

    captions: keys, ident, s, e, texts (array: the text and other forms of it, normalised); words: keys, t, n (order of equal times), word (normalised).
    The words' letters in the order of time are one stream. A caption's longest prefix, of `longest` letters down to `shortest`, that
    occurs between `before` ahead of its start and `after` behind its end, and begins `margin` ahead of its end at the latest, is
    its place (from 1) and size; of several texts the one found earliest counts. chained: the next search begins where the
    match ended, so that a text said twice is found twice; captions follow one another by s, e, ident. A null or short text
    isn't found; a recording without words has no match.
    """
    kinds = {f.name: f.dataType.simpleString() for f in captions.schema}

    def follow(own: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        said = said.dropna(subset=["t", "word"]).sort_values(["t", "n"])
        stream, times = "".join(said["word"]), np.repeat(said["t"].to_numpy(np.int64), said["word"].str.len().to_numpy(int) if len(said) else 0)
        cursor, out = 0, []
        for c in own.sort_values(["s", "e", ident]).itertuples():
            low, high, limit = np.searchsorted(times, [c.s - before, c.e + after, c.e - margin])
            found = None
            for text in c.texts if c.texts is not None else []:
                for size in range(min(longest, len(text or "")), shortest - 1, -1):
                    at = stream.find(text[:size], max(low, cursor), max(high, cursor))
                    if 0 <= at < limit:
                        if found is None or times[at] < times[found[0]]:
                            found = (at, size)
                        break
            if found and chained:
                cursor = sum(found)
            out.append((getattr(c, ident), *((int(times[found[0]]), found[1], found[0] + 1) if found else (None, None, None))))
        made = pd.DataFrame(out, columns=[ident, "spoken", "size", "place"]).astype({"spoken": "Int64", "size": "Int32", "place": "Int64"})
        for key in keys:
            made[key] = own[key].iloc[0] if len(own) else None
        return made[[*keys, ident, "spoken", "size", "place"]]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{ident} {kinds[ident]}", "spoken long", "size int", "place long"])
    spoken = words.select(*keys, "t", "n", "word")
    return captions.select(*keys, ident, "s", "e", "texts").groupBy(*keys).cogroup(spoken.groupBy(*keys)).applyInPandas(follow, schema)


def moved_starts(captions: DataFrame, keys: list[str], ident: str, *, lead: int = 350_000, strong: int = 700_000, least: int = 50_000, fill: bool = True) -> DataFrame:
    """captions (keys, ident, s, e, spoken) with `s` moved to `lead` ahead of what is spoken, and `moved`: by how much.

    Only captions that are at least `strong` too early move, and not by less than `least`. fill: a caption that wasn't found,
    between two that were, moves by what lies between their moves, by its place in time; one before the first or behind the last stays.
    """
    wanted = F.greatest(F.col("spoken") - lead - F.col("s"), F.lit(0))
    moved = F.when(F.col("spoken").isNull(), None).when((F.col("spoken") - F.col("s") >= strong) & (wanted >= least), wanted).otherwise(0)
    rows = captions.withColumn("_m", moved.cast("long"))
    if fill:
        order = Window.partitionBy(*keys).orderBy("s", "e", ident)
        known = F.when(F.col("_m").isNotNull(), F.struct(F.col("s").alias("s"), F.col("_m").alias("m")))
        rows = rows.withColumn("_a", F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_z", F.first(known, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
        span = F.col("_z.s") - F.col("_a.s")
        share = F.when(span > 0, F.floor((F.col("_z.m") - F.col("_a.m")) * (F.col("s") - F.col("_a.s")) / span)).otherwise(0)
        rows = rows.withColumn("_m", F.coalesce("_m", F.col("_a.m") + share)).drop("_a", "_z")
    by = F.coalesce("_m", F.lit(0)).cast("long")
    return rows.withColumn("moved", by).withColumn("s", F.col("s") + by).drop("_m")


def held_to_read(df: DataFrame, keys: list[str], ident: str, *, shortest: int = 1_350_000, tail: int = 250_000, space: int = 40_000, least: int = 250_000) -> DataFrame:
    """df with `e` at `shortest` behind s, or `tail` behind where it was, whichever is later; not past the next start less `space`, but `least` behind s."""
    following = F.lead("s").over(Window.partitionBy(*keys).orderBy("s", "e", ident))
    wanted = F.greatest(F.col("e") + tail, F.col("s") + shortest)
    bounded = F.when(following.isNull(), wanted).otherwise(F.least(wanted, F.greatest(F.col("s") + least, following - space)))
    return df.withColumn("e", F.greatest(F.col("s") + least, bounded))


def joined_short(df: DataFrame, keys: list[str], *, gap: int = 350_000, chars: int = 52, length: int = 8_500_000, brief: int = 1_650_000, few: int = 18, near: int = 120_000) -> DataFrame:
    """keys, place, s, e, role, text, size, n: captions of one role joined while gap, size and span stay within bounds and one of the two is short.

    df: s, e, role, text, size (letters that count), ident. Short: less than `brief` long or at most `few` letters; captions no further
    apart than `near` are joined whether short or not. The test reads what was joined so far.
    """

    def short(x):
        return (x["e"] - x["s"] < brief) | (x["size"] <= few)

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        space, size = x["s"] - last["e"], last["size"] + x["size"]
        fits = (F.size(done) > 0) & last["role"].eqNullSafe(x["role"]) & (space <= gap) & (size <= chars) & (x["e"] - last["s"] <= length) & (short(last) | short(x) | (space <= near))
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["role"].alias("role"), F.concat(last["text"], x["text"]).alias("text"), size.alias("size"), (last["n"] + 1).alias("n"))
        alone = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["role"].alias("role"), x["text"].alias("text"), x["size"].alias("size"), F.lit(1).alias("n"))
        return F.when(fits, _replace_last(done, longer)).otherwise(F.concat(done, F.array(alone)))

    role = df.schema["role"].dataType.simpleString()
    return _fold(df, keys, ["s", "e", "role", "text", "size", "ident"], ["s", "e", "ident"], f"struct<s: bigint, e: bigint, role: {role}, text: string, size: int, n: int>", step)


def speech_slots(captions: DataFrame, speech: DataFrame, keys: list[str], ident: str, *, least: int) -> DataFrame:
    """keys, ident, s, e: captions laid into the bounds of the speech they belong to, in order, by the weight of their texts.

    captions: keys, block, ident, weight (0 or more); speech: keys, block, s, e. Each caption of a block gets `least` first, as far as the block is long
    enough for all (else equal shares); what is left goes by weight (equally if all weigh nothing). Slots touch, begin at the
    block's start and end at its end. Captions of a block without speech, or with speech that doesn't end after it begins, get null.
    """
    own = Window.partitionBy(*keys, "block")
    upto = own.orderBy(ident).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = speech.where("e > s").groupBy(*keys, "block").agg(F.min("s").alias("_s"), F.max("e").alias("_e"))
    rows = captions.join(bounds, [*keys, "block"], "left")
    w = F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0))
    n, k = F.count("*").over(own), F.row_number().over(own.orderBy(ident))
    rows = rows.withColumn("_n", n).withColumn("_k", k).withColumn("_all", F.sum(w).over(own)).withColumn("_upto", F.sum(w).over(upto)).withColumn("_w", w)
    span = F.col("_e") - F.col("_s")
    floor_ = F.least(F.lit(least), F.floor(span / F.col("_n")))
    rest = span - floor_ * F.col("_n")

    def edge(count, weight):
        share = F.when(F.col("_all") > 0, F.floor(rest * weight / F.col("_all"))).otherwise(F.floor(rest * count / F.col("_n")))
        return (F.col("_s") + floor_ * count + share).cast("long")

    return rows.select(*keys, ident, edge(F.col("_k") - 1, F.col("_upto") - F.col("_w")).alias("s"), edge(F.col("_k"), F.col("_upto")).alias("e"))


def joined_dependent(df: DataFrame, keys: list[str], *, leading: str, dangling: str, gap: int, chars: int) -> DataFrame:
    """keys, place, s, e, text, n: segments joined with the one before if they begin with what can't begin one, or if that ends in what can't end one.

    df: s, e, text, ident. leading, dangling: regular expressions for beginnings (that belong behind what is before) and ends (that
    belong ahead of what follows). Both look at the text joined so far; segments further apart than `gap`, or longer together than
    `chars`, stay apart. A null text is empty, and an empty text joins what is before it.
    """

    def step(done, x):
        last, text = F.try_element_at(done, F.lit(-1)), F.coalesce(x["text"], F.lit(""))
        joined = F.concat(last["text"], F.when((last["text"] == "") | (text == ""), "").otherwise(" "), text)
        belongs = text.rlike(f"^(?:{leading})") | last["text"].rlike(f"(?:{dangling})$") | (text == "")
        fits = (F.size(done) > 0) & belongs & (x["s"] - last["e"] <= gap) & (F.length(joined) <= chars)
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), joined.alias("text"), (last["n"] + 1).alias("n"))
        alone = F.struct(x["s"].alias("s"), x["e"].alias("e"), text.alias("text"), F.lit(1).alias("n"))
        return F.when(fits, _replace_last(done, longer)).otherwise(F.concat(done, F.array(alone)))

    return _fold(df, keys, ["s", "e", "text", "ident"], ["s", "e", "ident"], "struct<s: bigint, e: bigint, text: string, n: int>", step)
