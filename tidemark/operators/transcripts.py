"""Operators on timed text: windows, merging, suppression of overlaps, comparison."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_windows(df: DataFrame, key: str, order: str, text: str, size: int, stride: int) -> DataFrame:
    """Text of ``size`` rows from every ``stride``-th row of a key on; the last windows are shorter."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__t", F.collect_list(text).over(w.rowsBetween(0, size - 1)))
    return rows.where(F.col("__i") % stride == 0).withColumn("joined", F.array_join("__t", " ")).withColumn("n", F.size("__t").cast("long")).drop("__i", "__t")


def _streamed(batches: Iterator[pd.DataFrame], key: str, fold) -> Iterator[pd.DataFrame]:
    """Rows sorted by key arrive in batches; ``fold(state, row)`` -> (rows to emit, state) sees them one by one."""
    state, last = None, object()
    for pdf in batches:
        out: list = []
        for row in pdf.to_dict("records"):
            if row[key] != last:
                done, state = fold(state, None)
                out += done
                last = row[key]
            done, state = fold(state, row)
            out += done
        if out:
            yield pd.DataFrame(out)
    done, _ = fold(state, None)
    if done:
        yield pd.DataFrame(done)


def merge_adjacent(df: DataFrame, key: str, order: str, start: str, end: str, text: str, tag: str, gap: float = 0.75, short: int = 24, longest: float = 8.0) -> DataFrame:
    """Neighbouring pieces of one tag become one while the gap and the text are short and the whole stays within ``longest`` seconds.

    Whether a piece joins depends on what was merged before it, so keys are
    sorted and folded in one pass; a partition holds one piece at a time.
    """

    def fold(state, row):
        if row is None:
            return ([state] if state else []), None
        piece = {key: row[key], "first": row[order], "start": row[start], "end": row[end], "text": row[text] or "", "tag": row[tag], "pieces": 1}
        if state is None:
            return [], piece
        small = len(state["text"]) <= short or len(piece["text"]) <= short
        if piece["tag"] == state["tag"] and piece["start"] - state["end"] <= gap and small and piece["end"] - state["start"] <= longest:
            return [], {**state, "end": piece["end"], "text": f"{state['text']} {piece['text']}".strip(), "pieces": state["pieces"] + 1}
        return [state], piece

    kinds = dict(df.dtypes)
    dealt = df.select(key, order, start, end, text, tag).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInPandas(lambda batches: _streamed(batches, key, fold), f"{key} {kinds[key]}, first {kinds[order]}, start double, end double, text string, tag string, pieces long")


def suppress_overlaps(df: DataFrame, key: str, item: str, start: str, end: str, score: str, print_: str, most: float = 0.55) -> DataFrame:
    """Greedy choice of intervals, best first: one goes if it overlaps a chosen one by more than ``most`` of the shorter, or has the print of a chosen one.

    Whether one is chosen depends on all that were chosen before it, so a key is
    one pass over its rows in order of score; a task holds what one key has
    chosen, by cells of time, and compares with the neighbouring cells only.
    """
    kinds = dict(df.dtypes)
    names = [key, item, start, end, score, print_]

    def choose(batches):
        last, cells, prints, width = object(), {}, set(), 1.0
        for batch in batches:
            keep = []
            columns = [batch.column(c).to_pylist() for c in (key, start, end, print_, "__width")]
            for i, (k, a, b, name, wide) in enumerate(zip(*columns, strict=True)):
                if k != last:
                    last, cells, prints, width = k, {}, set(), max(wide or 0.0, 1e-9)
                lo, hi = int(a // width), int(b // width)
                near = (x for c in range(lo - 1, hi + 1) for x in cells.get(c, ()))
                if (name and name in prints) or any(min(b, d) - max(a, c) > most * max(1e-9, min(b - a, d - c)) for c, d in near):
                    continue
                keep.append(i)
                cells.setdefault(lo, []).append((a, b))
                if name:
                    prints.add(name)
            yield batch.take(pa.array(keep, pa.int64())).select([key, item, start, end, score])

    # a cell is as wide as the key's longest interval, so what overlaps starts in the same cell or one before
    longest = df.groupBy(key).agg(F.max(F.col(end) - F.col(start)).cast("double").alias("__width"))
    rows = df.select(*names).join(longest, key).repartition(key).sortWithinPartitions(F.col(key), F.desc(score), F.asc(item))
    return rows.mapInArrow(choose, ", ".join(f"{c} {kinds[c]}" for c in (key, item, start, end, score)))


def turn_differences(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """How much each piece differs from the one before it: 1 - ratio of matching blocks, 0..1; null for the first."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))

    @F.pandas_udf("double")
    def difference(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else 1 - difflib.SequenceMatcher(None, x, y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    rows = df.withColumn("__before", before)
    return rows.select(key, order, difference("__before", text).alias("difference"))
