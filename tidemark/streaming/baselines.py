"""Baselines kept up to date by a stream: only accounts that a batch touches are computed again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUANTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9}


def weighted_quantiles(cells: np.ndarray, counts: np.ndarray, qs) -> list[float]:
    """Interpolated quantiles of sorted values that stand so often."""
    upto = np.cumsum(counts)
    at = (upto[-1] - 1) * np.asarray(list(qs))
    low, high = (cells[np.searchsorted(upto, f(at), "right")] for f in (np.floor, np.ceil))
    return (low + (high - low) * (at - np.floor(at))).tolist()


class _Counts(StatefulProcessor):
    """How often each value stands, for one account; emits its baselines whenever rows arrive."""

    def __init__(self, step: float):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "cells binary, ns binary")  # read and written in one go, not value by value

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = np.fromiter(((cell, n) for _, cell, n in rows), np.dtype((np.int64, 2)))
        held = [np.frombuffer(x, np.int64) for x in self.counts.get() or (b"", b"")]
        cells, at = np.unique(np.concatenate([held[0], new[:, 0]]), return_inverse=True)
        counts = np.zeros(len(cells), np.int64)
        np.add.at(counts, at, np.concatenate([held[1], new[:, 1]]))
        self.counts.update((cells.tobytes(), counts.tobytes()))
        values = cells * self.step
        found = weighted_quantiles(values, counts, QUANTILES.values())
        yield Row(account=key[0], n=int(counts.sum()), mean=float((values * counts).sum() / counts.sum()), **dict(zip(QUANTILES, found, strict=True)))

    def close(self) -> None:
        pass


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        yield part.groupby(["account", "cell"], as_index=False)["n"].sum()


def account_updates(events: DataFrame, account: str, value: str, step: float = 0.01) -> DataFrame:
    """A stream of account, n, mean, median, p75, p90: an account's baselines after each batch that has rows of it.

    State is one count for each of an account's values, rounded to ``step``, so
    it is bounded by their range and not by the rows.  Rows are counted where
    they are read; of a hot account a few counts travel.  Null accounts and
    values are left out.
    """
    if not events.sparkSession.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        events.sparkSession.conf.set(STORE, ROCKS)  # map state needs it
    kind = dict(events.dtypes)[account]
    cells = events.where(F.col(account).isNotNull() & F.col(value).isNotNull()).select(F.col(account).alias("account"), F.round(F.col(value) / F.lit(step)).cast("long").alias("cell"), F.lit(1).cast("long").alias("n"))
    counted = cells.mapInPandas(_combined, f"account {kind}, cell long, n long")
    return counted.groupBy("account").transformWithState(_Counts(step), f"account {kind}, n long, mean double, median double, p75 double, p90 double", "Update", "None")


def batch_baselines(events: DataFrame, account: str, value: str, step: float = 0.01) -> DataFrame:
    """What ``account_updates`` comes to once all rows were read."""
    v = F.round(F.col(value) / F.lit(step)) * F.lit(step)
    rows = events.where(F.col(account).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(F.col(account).alias("account")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), *[F.percentile(v, F.lit(q)).alias(name) for name, q in QUANTILES.items()])


def baselines_table(events: DataFrame, account: str, value: str, folder: str, step: float = 0.01) -> DataFrame:
    """Baselines of all that a stream has at hand, kept below ``folder``; a later call reads new rows only.

    Each batch writes the accounts that it touched; once there are more than
    ``MOST_PARTS`` batches the latest rows are written as one table.
    """
    updates = account_updates(events, account, value, step)
    spark, schema = events.sparkSession, updates.withColumn("batch", F.lit(0).cast("long")).schema

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/parts/batch-{number:09d}")

    updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/cursor").trigger(availableNow=True).start().awaitTermination()
    return compacted(spark, folder, schema, ["account"])


#: Batches that are read together before they are written as one.
MOST_PARTS = 50


def compacted(spark, folder: str, schema, keys: list[str]) -> DataFrame:
    """The latest row of each key of the batches below ``folder/parts``; many of them become one, named after the last."""
    names = spark._jvm.org.apache.hadoop.fs
    top = names.Path(f"{folder}/parts")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []
    whole = [p for p in found if p.startswith("whole-")]
    parts = [p for p in found if p.startswith("batch-") and (not whole or p[6:] > whole[-1][6:])]
    own = [c for c in schema.names if c not in (*keys, "batch")]
    if not whole and not parts:
        return spark.createDataFrame([], schema).drop("batch")

    def latest(names):
        rows = spark.read.schema(schema).parquet(*[f"{folder}/parts/{p}" for p in names])
        return rows.groupBy(*keys).agg(F.max("batch").alias("batch"), F.max_by(F.struct(*own), "batch").alias("__l")).select(*keys, "__l.*", "batch")

    kept = [*whole[-1:], *parts]
    if len(parts) > MOST_PARTS:
        draft, name = names.Path(f"{folder}/parts/_draft"), f"whole-{parts[-1][6:]}"
        latest(kept).write.mode("overwrite").parquet(f"{folder}/parts/_draft")
        fs.rename(draft, names.Path(f"{folder}/parts/{name}"))
        for p in kept:
            fs.delete(names.Path(f"{folder}/parts/{p}"), True)
        kept = [name]
    return latest(kept).drop("batch")
