"""Readers of captured works and metrics: CSV, JSON, workbooks, snapshots, sound."""

from __future__ import annotations

import io
import re
import wave
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIST_KEYS = ("works", "records", "items", "aweme_list", "data")
SHEETS = ("all_works", "works", "data", "Sheet1")


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, a byte order mark before the first name taken off."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_works_json(spark: SparkSession, path: str) -> DataFrame:
    """A row for each work, as a map of text: file, idx, work.  A file is a list, or an object with one under a usual key."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    items = F.coalesce(F.from_json("value", "array<string>"), *[F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in LIST_KEYS])
    return whole.select("file", F.posexplode(items).alias("idx", "item")).select("file", "idx", F.from_json("item", "map<string,string>").alias("work"))


def metric_windows(works: DataFrame, column: str = "work") -> DataFrame:
    """A row for each window of a work's ``metrics_by_window`` (an object or a list), or one row without any."""
    text = F.col(column)["metrics_by_window"]
    named = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("window_name"), F.from_json(e["value"], "map<string,string>").alias("metrics")))
    listed = F.transform(F.from_json(text, "array<map<string,string>>"), lambda m: F.struct(m["window_name"].alias("window_name"), m.alias("metrics")))
    is_list = F.startswith(F.ltrim(F.coalesce(text, F.lit(""))), F.lit("["))
    return works.withColumn("__w", F.explode_outer(F.when(is_list, listed).otherwise(named))).select(*works.columns, F.col("__w.window_name").alias("window_name"), F.coalesce("__w.metrics", F.col(column)).alias("metrics"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: a row for each visible work; files named latest and files without works are left out."""
    shape = "observed_at string, page struct<title:string,url:string>, account struct<nickname:string,profile_url:string>, visible_works array<struct<visible_count:string,title_tags_text:string,tags:array<string>>>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", shape).alias("p"))
    kept = files.where(~F.contains(F.lower("file"), F.lit("latest")) & (F.size(F.coalesce(F.col("p.visible_works"), F.array())) > 0))
    return kept.select("file", F.col("p.observed_at").alias("observed_at"), F.col("p.account.nickname").alias("account"), F.posexplode("p.visible_works").alias("idx", "w")).select("file", "observed_at", "account", "idx", "w.*")


def newest_files(spark: SparkSession, path: str) -> DataFrame:
    """The newest file of each folder: dataset, path, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    name = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(name.alias("dataset")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified"))


def asset_index(spark: SparkSession, path: str) -> DataFrame:
    """Files by the item number (10 to 24 digits) in their path and by their folder: item_id, category, paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = files.select("path", F.element_at(F.split("path", "/"), -2).alias("category"), F.explode(F.array_distinct(F.regexp_extract_all("path", F.lit(r"(?<!\d)\d{10,24}(?!\d)"), F.lit(0)))).alias("item_id"))
    return found.groupBy("item_id", "category").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def _cells(sheet: bytes, shared: list[str]) -> Iterator[list[str]]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    for row in ET.fromstring(sheet).iter(f"{ns}row"):
        out: list[str] = []
        for cell in row.iter(f"{ns}c"):
            letters = re.match(r"[A-Z]*", cell.get("r", "")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            out += [""] * (max(at, len(out) + 1) - len(out))
            value = "".join(t.text or "" for t in cell.iter(f"{ns}t")) if cell.get("t") == "inlineStr" else (cell.findtext(f"{ns}v") or "")
            out[at - 1 if at else -1] = shared[int(value)] if cell.get("t") == "s" and value else value
        yield out


def workbook_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of a workbook's preferred sheet; its header is the first of ten rows with two or more cells."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        links = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(rel)] for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")}
        name = next((s for s in SHEETS if s in sheets), next(iter(sheets)))
        rows = list(_cells(z.read(f"xl/{sheets[name]}"), shared))
    head = next((i for i, r in enumerate(rows[:10]) if sum(bool(c.strip()) for c in r) >= 2), None)
    if head is None:
        return []
    names = [c.strip() for c in rows[head]]
    return [{n: v for n, v in zip(names, r, strict=False) if n} for r in rows[head + 1 :] if any(c.strip() for c in r)]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each row of each workbook, as a map of text: file, idx, row."""

    def parse(batches):
        for pdf in batches:
            rows = [(p.rsplit("/", 1)[-1], i, r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, r in enumerate(workbook_rows(bytes(c)))]
            yield pd.DataFrame(rows, columns=["file", "idx", "row"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, idx int, row map<string,string>")


def sound_frames(content: bytes, seconds: float = 1.0) -> list[tuple[float, float]]:
    """(time, root mean square) of each stretch of a 16-bit WAV file, channels taken together."""
    with wave.open(io.BytesIO(content)) as w:
        data = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64)
        step = max(1, int(w.getframerate() * seconds) * w.getnchannels())
    return [(i * seconds, float(np.sqrt(np.mean(data[at : at + step] ** 2)))) for i, at in enumerate(range(0, len(data), step))]


def read_sound(spark: SparkSession, path: str) -> DataFrame:
    """Loudness by the second: file, time, rms, and energy, which is rms over the file's largest."""
    from pyspark.sql import Window

    def parse(batches):
        for pdf in batches:
            rows = [(p.rsplit("/", 1)[-1], t, r) for p, c in zip(pdf["path"], pdf["content"], strict=True) for t, r in sound_frames(bytes(c))]
            yield pd.DataFrame(rows, columns=["file", "time", "rms"])

    frames = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, time double, rms double")
    return frames.withColumn("energy", F.coalesce(F.try_divide("rms", F.max("rms").over(Window.partitionBy("file"))), F.lit(0.0)))


def peaks(frames: DataFrame, key: str = "file", most: int = 40) -> DataFrame:
    """Frames that are loud: at least 0.55 and 1.35 times the mean, the loudest ``most`` of each key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    loud = frames.withColumn("__m", F.avg("energy").over(w)).where(F.col("energy") >= F.greatest(F.lit(0.55), 1.35 * F.col("__m")))
    return loud.withColumn("rank", F.row_number().over(w.orderBy(F.desc("energy"), "time"))).where(F.col("rank") <= most).drop("__m")
