"""Corpus preparation in five stages over documents: language, near duplicates, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes every stage's
rows to the shared folder and reads them again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid_kn, mixing, near_dedup, packing, suffix_dedup
from tessera.llm.common import fold, materialize

WEIGHTS = [5, 2, 1]
CAPACITY = 2048
#: words: the shortest passage of over 50
MIN_REPEAT = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; the rejected go: no letters, or unlike any learned language."""
    model = langid_kn.fit(docs, learn=F.coalesce(fold("doc_id", 4) != 2, F.lit(False)))
    return docs.where(~langid_kn.predictor(spark, model)("text")["rejected"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id: five words, similarity 0.8.

    Equal rows of one doc_id are one document; rows of one doc_id whose texts differ stay or go together. Rows
    without a doc_id all stay.
    """
    gone = near_dedup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    row, apart = F.struct(*docs.columns).alias("row"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("apart")
    kept = docs.join(gone, "doc_id", "left_anti").select(row, "doc_id", apart, F.xxhash64("text").alias("h"))
    return kept.dropDuplicates(["doc_id", "apart", "h"]).select("row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 51 words that occur more than once; n_chars follows the text.

    Null and empty texts stay as they are; a text that consists of such strings becomes empty or white space. Words, not
    bytes, since a passage of over 50 words may have fewer than 300 bytes in one language and 400 in another.
    """
    names = docs.columns
    cut = suffix_dedup.remove_repeats(docs, MIN_REPEAT, unit="words")
    return cut.withColumn("text", F.col("repeats.kept")).withColumn("n_chars", F.length("text").cast("long")).select(names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix's slots, each as often as the mix takes it whole.

    A copy is emitted for each pass over a source's line in which the mix takes half of the document's words or more,
    at the slot where that pass first takes some. Documents without a word (null, empty, white space) aren't in the mix.
    """
    # numbered and written: repeated rows stay apart, and the numbers stay the same
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("n")))
    documents, pieces = mixing.mix_sources(rows.select(F.col("n").alias("doc_id"), "row.text", "row.source"), WEIGHTS)
    passes = pieces.groupBy("doc_row", "epoch").agg(F.sum(F.col("high") - F.col("low")).alias("words"), F.min("slot").alias("slot"))
    whole = documents.select("doc_row", F.col("doc_id").alias("n"), "size").join(passes, "doc_row").where("2 * words >= size")
    return rows.join(whole.select("n", "slot"), "n").orderBy("slot", "n").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their places in sequences of 2048 tokens; a null text is one piece of token 0 alone."""
    return packing.pack_documents(docs, CAPACITY, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix", mix),
    ("pack", pack),
]

#: Learned models, hash orders and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
