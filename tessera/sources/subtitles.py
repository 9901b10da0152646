"""Subtitle files as tables: SRT and VTT blocks, ASS dialogue lines, and SRT text out of captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.clock import centisecond_clock
from tessera.functions.text import timecode, timecode_us

_TIMES = r"(?m)^\s*([\d:,.]+)\s*-->\s*([\d:,.]+).*$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, value: whole files, through Spark's reader."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_srt(files: DataFrame, keys: list[str], value: str = "value", *, joiner: str = " ") -> DataFrame:
    """keys, place, number, s, e, text: the blocks with a time line; number is null where there is none. Markup goes."""
    whole = F.regexp_replace(F.col(value), r"\r\n?", "\n")
    blocks = files.select(*keys, F.posexplode(F.split(whole, r"\n[ \t]*\n+")).alias("place", "_b"))
    s, e = (timecode_us(F.regexp_extract("_b", _TIMES, i)) for i in (1, 2))
    number = F.regexp_extract("_b", r"^\s*(\d+)[ \t]*\n", 1)
    body = F.regexp_replace(F.regexp_replace("_b", r"(?s)^.*?-->[^\n]*\n?", ""), r"<[^>]*>|\{\\[^}]*\}", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.select(*keys, "place", number.try_cast("int").alias("number"), s.alias("s"), e.alias("e"), F.array_join(lines, joiner).alias("text"))
    return rows.where("s is not null and e is not null")


def parse_ass(files: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, place, s, e, style, text: Dialogue lines; the tenth field is all that is left of the line."""
    lines = files.select(*keys, F.posexplode(F.split(F.regexp_replace(F.col(value), r"\r\n?", "\n"), "\n")).alias("place", "_l")).where(F.col("_l").startswith("Dialogue:"))
    part = F.split(F.regexp_replace("_l", r"^Dialogue:\s*", ""), ",", 10)
    text = F.regexp_replace(F.regexp_replace(F.try_element_at(part, F.lit(10)), r"\{[^}]*\}", ""), r"\\[Nn]", " ")
    rows = lines.select(*keys, "place", timecode_us(F.trim(F.try_element_at(part, F.lit(2)))).alias("s"), timecode_us(F.trim(F.try_element_at(part, F.lit(3)))).alias("e"), F.trim(F.try_element_at(part, F.lit(4))).alias("style"), F.trim(text).alias("text"))
    return rows.where("s is not null and e is not null")


def srt_block(number: Column, s: Column, e: Column, text: Column) -> Column:
    """One caption as SRT text."""
    return F.concat(number.cast("string"), F.lit("\n"), timecode(s), F.lit(" --> "), timecode(e), F.lit("\n"), text, F.lit("\n"))


def srt_files(captions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value: the SRT text of each key's captions (number, s, e, text), in order of number."""
    block = F.struct("number", srt_block(F.col("number"), F.col("s"), F.col("e"), F.col("text")).alias("b"))
    return captions.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n").alias("value"))


def numbered(captions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number (from 1), s, e, text: captions in time order without the empty ones, numbered anew."""
    rows = captions.where("trim(coalesce(text, '')) <> ''")
    return rows.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("s", "e", "text")).alias("number"), "s", "e", "text")


def concat_line(path: Column) -> Column:
    """A line of a list of files to be joined; quotes in the path are escaped."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def ass_line(s: Column, e: Column, style: Column, text: Column) -> Column:
    """A Dialogue line; line ends become \\N."""
    return F.concat(F.lit("Dialogue: 0,"), centisecond_clock(s), F.lit(","), centisecond_clock(e), F.lit(","), style, F.lit(",,0,0,0,,"), F.replace(text, F.lit("\n"), F.lit("\\N")))


def parse_segments(files: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, place, s, e, text of transcripts: JSON with segments (start, end in seconds, text) or, where that can't be read, SRT."""
    shape = "struct<segments: array<struct<start: double, end: double, text: string>>>"
    rows = files.withColumn("_j", F.from_json(value, shape)["segments"])
    from_json = rows.where("_j is not null").select(*keys, F.posexplode("_j").alias("place", "_x"))
    us = [(F.floor(F.col(f"_x.{c}") * 1_000_000 + 0.5)).alias(n) for c, n in (("start", "s"), ("end", "e"))]
    from_srt = parse_srt(rows.where("_j is null"), keys, value).select(*keys, "place", "s", "e", "text")
    return from_json.select(*keys, "place", *us, F.col("_x.text").alias("text")).union(from_srt)
