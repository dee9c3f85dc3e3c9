"""Subtitle files: SRT in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"


def stamp(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` of a number of seconds."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    part = lambda unit, size: F.lpad((F.floor(ms / unit) % size).cast("string"), 2, "0")
    return F.concat(F.lpad(F.floor(ms / 3_600_000).cast("string"), 2, "0"), F.lit(":"), part(60_000, 60), F.lit(":"), part(1_000, 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def _seconds(text: Column) -> Column:
    get = lambda i: F.regexp_extract(text, _TIME, i).try_cast("double")
    return get(1) * 3600 + get(2) * 60 + get(3) + F.rpad(F.regexp_extract(text, _TIME, 4), 3, "0").try_cast("double") / 1000


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """A row for each cue: file, idx (from 0), start, end, text; blocks without a time line or text are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("body"))
    blocks = files.select("file", F.posexplode(F.split(F.regexp_replace("body", "^﻿", ""), r"\n\s*\n")).alias("idx", "block"))
    line = F.regexp_extract("block", r"[^\n]*-->[^\n]*", 0)
    ends = F.split(line, "-->")
    text = F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)", 1), r"\s*\n\s*", " "))
    cues = blocks.where(line != "").select("file", "idx", _seconds(ends[0]).alias("start"), _seconds(F.try_element_at(ends, F.lit(2))).alias("end"), text.alias("text"))
    return cues.where((F.col("text") != "") & F.col("start").isNotNull() & F.col("end").isNotNull())


def to_srt(df: DataFrame, key: str, order: str, start: str = "start", end: str = "end", text: str = "text", offset: float = 0.0, least: float = 0.3) -> DataFrame:
    """One SRT text for each key; cues shift by ``offset`` and last ``least`` seconds at least."""
    a = F.greatest(F.col(start) + offset, F.lit(0.0))
    b = F.greatest(F.col(end) + offset, a + least)
    cue = F.struct(F.col(order).alias("o"), F.concat(stamp(a), F.lit(" --> "), stamp(b), F.lit("\n"), F.trim(F.coalesce(text, F.lit("")))).alias("c"))
    packed = df.where(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(key).agg(F.array_sort(F.collect_list(cue)).alias("p"))
    numbered = F.transform(F.col("p.c"), lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), c))
    return packed.select(key, F.concat(F.array_join(numbered, "\n\n"), F.lit("\n")).alias("srt"))


def read_asr_json(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of speech-recognition output, times from offsets in milliseconds, else from time stamps: file, idx, start, end, text."""
    shape = "transcription array<struct<offsets:struct<from:double,to:double>,timestamps:struct<from:string,to:string>,text:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.from_json("value", shape)["transcription"]).alias("idx", "p"))
    at = lambda side: F.coalesce(F.col(f"p.offsets.{side}") / 1000, _seconds(F.col(f"p.timestamps.{side}")), F.lit(0.0))
    return rows.select("file", "idx", at("from").alias("start"), at("to").alias("end"), F.trim("p.text").alias("text")).where("text != ''")
