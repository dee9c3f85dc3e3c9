"""Runs that take a platform's rows over: prepare, map, link, import, and a line in the run log whatever happens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import all_digits, metric_number, ten_or_more
from tidemark.operators.corrections import registered
from tidemark.operators.joins import resolve_link
from tidemark.operators.steps import cut
from tidemark.sources.changelog import BROADCAST_KEYS, ChangeLog

RUN_FIELDS = {"run": "string", "account": "string", "status": "string", "pulled": "long", "mapped": "long", "imported": "long", "linked": "long", "unlinked": "long", "error": "string"}
MAPPING_FIELDS = {"item": "string", "target": "string"}
METRIC_FIELDS = {"item_window": "string", "item": "string", "window": "string", "target": "string", "value": "double"}


@dataclass
class Platform:
    """The tables of one platform: how its items map to own clips, metrics by item and window, runs."""

    mappings: ChangeLog
    metrics: ChangeLog
    runs: ChangeLog

    @classmethod
    def below(cls, spark, folder: str) -> Platform:
        return cls(*[ChangeLog(spark, f"{folder}/{name}", key, fields) for name, key, fields in (("mappings", "item", MAPPING_FIELDS), ("metrics", "item_window", METRIC_FIELDS), ("runs", "run", RUN_FIELDS))])


def asked_ids(ids: DataFrame, *asking: DataFrame) -> DataFrame:
    """Those of the ids that a target of the asking rows names: ids are read where they lie, unless more targets ask than may be broadcast."""
    asked = cut(reduce(DataFrame.union, [a.select(F.col("target").alias("id")) for a in asking]).where(F.col("id").isNotNull()).distinct())
    return cut(ids.join(F.broadcast(asked) if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else asked, "id", "left_semi"))


def synced(platform: Platform, run: str, account: str, load: Callable[[], DataFrame], known: DataFrame, known_id: str) -> dict:
    """One run over the rows that ``load`` gives (item, window, target, value, all text as the platform has them).

    Items are cleaned and rows without one left out; a target that a row names
    is kept as its item's mapping, blank ones keep the stored; a row is linked
    to its own target or else to its item's, if that is among ``known``.  Of
    several rows of an item and window the greatest value counts.  A run that
    fails is logged with its error, and one with the same name runs again.
    """
    done = {"run": run, "account": account, "status": "completed", "pulled": 0, "mapped": 0, "imported": 0, "linked": 0, "unlinked": 0, "error": ""}
    try:
        digits = all_digits(F.col("item")).alias("digits")  # a step of its own, so that it is found once for each row
        cells = load().select(digits, F.coalesce("window", F.lit("final")).alias("window"), F.nullif(F.trim("target"), F.lit("")).alias("target"), metric_number(F.col("value")).cast("double").alias("value"))
        # a link follows from item and target alone, so rows that share them and the window are one from here on
        place = F.coalesce("value", F.lit(-1.0))
        rows = cells.groupBy(ten_or_more(F.col("digits")).alias("item"), "window", "target").agg(F.count("*").alias("n"), F.max("value").alias("value"), F.max(place).alias("place"))
        rows = cut(rows).where(F.col("item").isNotNull())
        named = rows.groupBy("item").agg(F.max("target").alias("target"))
        registered(platform.mappings, named, {})
        mappings = cut(platform.mappings.current(named.select("item")))
        linked = cut(resolve_link(rows, "target", asked_ids(known.select(F.col(known_id).cast("string").alias("id")), rows, mappings), "id", mappings, "item", "target"))
        best = linked.groupBy("item", "window").agg(F.max_by("link", F.struct("place", F.coalesce("link", F.lit("")))).alias("target"), F.max("value").alias("value"))
        counts = platform.metrics.merge(best.select(F.concat_ws("|", "item", "window").alias("item_window"), "*"))
        sums = linked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (("n", F.col("n")), ("linked", F.when(F.col("link").isNotNull(), F.col("n"))))]).first()
        done |= {"pulled": sums["n"], "mapped": named.where(F.col("target").isNotNull()).count(), "imported": counts.get("created", 0) + counts.get("updated", 0), "linked": sums["linked"], "unlinked": sums["n"] - sums["linked"]}
        done["status"] = "empty" if not sums["n"] else "completed_with_warnings" if done["unlinked"] else "completed"
    except Exception as e:  # the log tells of every run
        done |= {"status": "failed", "error": str(e).splitlines()[0][:200]}
    spark = platform.runs.spark
    platform.runs.merge(spark.createDataFrame([tuple(done[f] for f in RUN_FIELDS)], ", ".join(f"{n} {t}" for n, t in RUN_FIELDS.items())))
    return done


def recent_runs(platform: Platform, account: str | None = None, limit: int = 20) -> DataFrame:
    """The latest runs by name, of one account if given."""
    runs = platform.runs.current()
    return (runs.where(F.col("account") == account) if account else runs).orderBy(F.desc("run")).limit(limit)
