"""Baselines of groups, and joins that look values up in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, keys: list[str], value: Column, qs: dict[str, float] | None = None) -> DataFrame:
    """Exact interpolated percentiles and the count of ``value`` for each group."""
    qs = qs or {"median": 0.5, "p75": 0.75, "p90": 0.9}
    found = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(q) for q in qs.values()])).alias("__q"), F.count(value).alias("n"))
    return found.select(*keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(qs)], "n")


def metric_baselines(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``percentiles`` of several metric columns at once: one more key, ``metric``."""
    long = df.unpivot(keys, metrics, "metric", "value")
    return percentiles(long, [*keys, "metric"], F.col("value"))


def scoped_baselines(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Medians of every prefix of ``keys`` down to all rows, in one pass over grouping sets: level = keys used."""
    sets = [keys[:n] for n in range(len(keys), -1, -1)]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().alias("__g"), F.percentile(F.col(value), 0.5).alias("median"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    level = reduce(lambda rest, n: F.when(F.col("__g") == (1 << (len(keys) - n)) - 1, n).otherwise(rest), range(len(keys) + 1), F.lit(None))
    return out.withColumn("level", level).drop("__g")


def with_fallback_baseline(df: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """Each row with the narrowest scope's baseline that has ``least`` rows, else the narrowest that exists.

    Adds scope (keys used), baseline_median and baseline_n.  Rows of a scope are
    counted once; every scope joins on its own keys.
    """
    base = scoped_baselines(df, keys, value)
    out, tries = df, []
    for n in range(len(keys), -1, -1):
        own = base.where(F.col("level") == n).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys[:n])], F.struct(F.lit(n).alias("scope"), F.col("median"), F.col("n")).alias(f"__s{n}"))
        on = [out[k].eqNullSafe(own[f"__k{i}"]) for i, k in enumerate(keys[:n])]
        out = out.join(own, on, "left").drop(*[f"__k{i}" for i in range(n)]) if on else out.crossJoin(F.broadcast(own))  # the last is a single row
        tries.append(F.col(f"__s{n}"))
    best = F.coalesce(*[F.when(t["n"] >= least, t) for t in tries], *tries)
    return out.withColumn("__b", best).select(*df.columns, F.col("__b.scope").alias("scope"), F.col("__b.median").alias("baseline_median"), F.col("__b.n").alias("baseline_n"))


def tail_labels(df: DataFrame, group: list[str], order: list[Column], share: float = 0.2) -> DataFrame:
    """Ranks within ``group`` by ``order`` and labels the best and worst share high and low; the best win where they meet.

    Adds label_rank, label_percentile (100 for a single row) and label.
    """
    w = Window.partitionBy(*group)
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    out = df.withColumn("__n", n).withColumn("label_rank", rank)
    tail = F.greatest(F.lit(1), F.ceil(F.col("__n") * share))
    label = F.when(F.col("label_rank") <= tail, "high").when((F.col("__n") > 1) & (F.col("label_rank") > F.col("__n") - tail), "low").otherwise("mid")
    percent = F.when(F.col("__n") == 1, F.lit(100.0)).otherwise(F.try_divide((F.col("__n") - F.col("label_rank")).cast("double"), (F.col("__n") - 1).cast("double")) * 100)
    return out.withColumn("label_percentile", percent).withColumn("label", label).drop("__n")


def interest_clock(df: DataFrame, keys: list[str], hour: str, value: str, sigma: float = 3.0, near: int = 3) -> DataFrame:
    """A score for each of the 24 hours of each group: the mean of its rows' values under a Gaussian on the clock's ring.

    Rows are summed for each hour first, so that the 24-fold copies are of 24
    sums a group and not of the rows.  Adds clock_hour, score, confidence, n_near.
    """
    sums = df.where(F.col(hour) >= 0).groupBy(*keys, hour).agg(F.sum(value).alias("__v"), F.count("*").alias("__n"))
    hours = sums.withColumn("clock_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    d = F.abs(F.col("clock_hour") - F.col(hour))
    d = F.least(d, 24 - d)
    weight = F.exp(-(d * d) / F.lit(2 * sigma * sigma))
    out = hours.groupBy(*keys, "clock_hour").agg((F.sum(F.col("__v") * weight) / F.sum(F.col("__n") * weight)).alias("score"), F.coalesce(F.sum(F.when(d <= near, F.col("__n"))), F.lit(0)).alias("n_near"))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(1), F.col("n_near"))) / 4))


def field_means(df: DataFrame, fields: list[str], value: str) -> DataFrame:
    """Mean and count of ``value`` for each value of each field, and over all rows (field 'global')."""
    long = df.select(F.col(value).cast("double").alias("__v"), F.explode(F.array(F.struct(F.lit("global").alias("field"), F.lit("all").alias("key")), *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key")) for f in fields])).alias("__f"))
    return long.where("coalesce(__f.key, '') != ''").groupBy(F.col("__f.field").alias("field"), F.col("__f.key").alias("key")).agg(F.avg("__v").alias("mean"), F.count("*").alias("n"))


def insight_groups(df: DataFrame, dimensions: list[str], sums: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """Sums, means and counts for each value of each dimension."""
    named = df.select(*[F.col(c).cast("string").alias(c) for c in dimensions], *[x.alias(n) for n, x in {**sums, **means}.items()])
    long = named.withColumn("__d", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in dimensions])))
    return long.groupBy(F.col("__d.dimension").alias("dimension"), F.col("__d.value").alias("value")).agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in sums], *[F.avg(n).alias(n) for n in means])


def top_groups(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in ``order``, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def coverage(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """How many rows fulfil each field's condition: field, filled, total, share."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in fields.items()])
    long = one.unpivot(["total"], list(fields), "field", "filled")
    return long.select("field", "filled", "total", F.coalesce(F.try_divide(F.col("filled").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("share"))
