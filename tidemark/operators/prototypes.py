"""Groups of captured samples and what each is worth: scores, confidence, stability, baselines by any dimension."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp
from tidemark.operators.steps import cut

#: Rows whose tokens are summed together.
ROWS_AT_ONCE = 2_000


def spread_percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``baselines.percentiles`` for groups of any size, all rows included: one row a key, or one row where there are no keys.

    Equal values are counted before they are shuffled, the counts are dealt by range, and a value's rank follows from the
    totals of the ranges before its own; no task holds the values of a group.
    """
    v = F.col("__v")
    counts = df.select(*keys, F.col(value).alias("__v")).where(v.isNotNull()).groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    counts = cut(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))  # a range is drawn once
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row for each range
    parts = counts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__own"))
    parts = parts.withColumn("__before", F.sum("__own").over(whole.orderBy("__part")) - F.col("__own")).withColumn("__all", F.sum("__own").over(whole))
    parts = parts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__before", "__all")
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    ranked = counts.join(parts, on).select(*keys, "__part", "__v", "__n", "__before", "__all")
    ranked = ranked.withColumn("__upto", F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v")))
    at = {name: (F.col("__all") - 1) * F.lit(q) for name, q in qs.items()}
    low = [F.min(F.when(F.col("__upto") > F.floor(p), v)).alias(f"__low_{name}") for name, p in at.items()]
    high = [F.min(F.when(F.col("__upto") > F.ceil(p), v)).alias(f"__high_{name}") for name, p in at.items()]
    found = ranked.groupBy(*keys).agg(F.max("__all").alias("n"), *low, *high)
    out = []
    for name, q in qs.items():
        share = (F.col("n") - 1) * F.lit(q)
        share -= F.floor(share)
        out.append((F.col(f"__low_{name}") * (1 - share) + F.col(f"__high_{name}") * share).alias(name))
    return found.select(*keys, *out, "n")


def scored(df: DataFrame, value: str, rate: Column, total: Column, views: Column) -> DataFrame:
    """Adds score: 50 at the median of the positive values, 18 a doubling, and bonuses for engagement and for the upper quarter."""
    positive = df.withColumn("__p", F.when(F.col(value) > 0, F.col(value)))
    marks = spread_percentiles(positive, [], "__p", {"__median": 0.5, "__p75": 0.75}).drop("n")
    median = F.coalesce(F.nullif(F.col("__median"), F.lit(0.0)), F.lit(1.0))
    p75 = F.coalesce(F.nullif(F.col("__p75"), F.lit(0.0)), median)
    engaged = F.when(rate != 0, F.least(F.lit(10.0), rate * 240)).when(F.coalesce(views, F.lit(0)) <= 0, F.least(F.lit(10.0), F.log1p(total) * 0.8)).otherwise(0.0)
    base = 50 + 18 * F.log2(F.greatest(F.lit(0.05), F.col(value) / F.greatest(F.lit(1.0), median)))
    score = clamp(base + engaged + F.when(F.col(value) >= p75, 4.0).otherwise(0.0))
    return df.crossJoin(F.broadcast(marks)).withColumn("score", score).drop("__median", "__p75")  # marks: one row


def confidence(n: Column, median: Column, score: Column) -> Column:
    """How far a group is trusted: by its rows, its median and its mean score."""
    parts = F.least(F.lit(0.45), n * 0.07) + F.least(F.lit(0.25), F.log1p(F.greatest(F.lit(0.0), median)) / 48) + F.least(F.lit(0.2), F.greatest(F.lit(0.0), score - 45) / 220)
    return F.least(F.lit(0.95), 0.18 + parts)


def history_uncertainty(n: Column, best_similarity: Column) -> Column:
    """1 without history, less with ten rows of it and with a close one."""
    return F.when(n <= 0, 1.0).otherwise(clamp(1 - 0.55 * F.least(F.lit(1.0), n / 10) - 0.35 * F.coalesce(best_similarity, F.lit(0.0)), 0.0, 1.0))


#: How far history of a scope counts.
SCOPE_TRUST = {"account": 1.0, "global_fallback": 0.72, "global": 0.62, "none": 0.0}
OTHER_SCOPE_TRUST = 0.35


def research_confidence(n: Column, chosen: Column, best_similarity: Column, scope: Column, prototype: Column) -> Column:
    """Trust in a ranking: its coverage, closest row, number of matches, scope and best prototype."""
    trust = F.coalesce(F.create_map(*[F.lit(x) for pair in SCOPE_TRUST.items() for x in pair])[scope], F.lit(OTHER_SCOPE_TRUST))
    filled = lambda c: F.coalesce(c, F.lit(0.0))
    return clamp(0.25 * clamp(n / 50, 0.0, 1.0) + 0.35 * filled(best_similarity) + 0.15 * clamp(chosen / 5, 0.0, 1.0) + 0.15 * trust + 0.10 * filled(prototype), 0.0, 1.0)


def _first_tier(tiers: list[tuple[Column, str, int]]) -> Column:
    """struct(tier, rank) of the first condition that holds."""
    out = None
    for test, tier, rank in tiers:
        found = F.struct(F.lit(tier).alias("tier"), F.lit(rank).alias("rank"))
        out = F.when(test, found) if out is None else out.when(test, found)
    return out


def view_stability(n: Column, p75: Column, best: Column, trust: Column) -> Column:
    """struct(tier, rank) of a group that is judged by its views."""
    return _first_tier([
        ((n < 3) & (best >= 100_000), "potential_observation", 1),
        (n < 3, "thin_observation", 0),
        ((p75 >= 100_000) & (trust >= 0.75), "stable_high", 4),
        ((p75 >= 50_000) & (trust >= 0.70), "high_potential", 3),
        (p75 >= 10_000, "category_effective", 2),
        (F.lit(True), "weak_or_observe", 1),
    ])


def interaction_stability(n: Column, lift: Column, trust: Column) -> Column:
    """struct(tier, rank) of a group without views: by its upper quarter over its account's."""
    return _first_tier([
        (n < 3, "thin_observation", 0),
        ((lift >= 1.25) & (trust >= 0.70), "stable_high_interaction", 4),
        ((lift >= 1.0) & (trust >= 0.65), "interaction_potential", 3),
        (lift >= 0.6, "interaction_observe", 2),
        (F.lit(True), "weak_or_observe", 1),
    ])


def position_label(share: Column) -> Column:
    """Name of a place in a distribution."""
    return F.when(share >= 0.9, "top_decile").when(share >= 0.75, "top_quartile").when(share >= 0.5, "above_median").when(share >= 0.25, "below_median").otherwise("low_quartile")


def match_types(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds match_type: high from the group's 60th percentile on, low up to its 40th, neutral between."""
    marks = spread_percentiles(df, keys, value, {"__high": 0.6, "__low": 0.4}).drop("n")
    kind = F.when(F.col(value) >= F.coalesce("__high", F.lit(60.0)), "high").when(F.col(value) <= F.coalesce("__low", F.lit(40.0)), "low").otherwise("neutral")
    return df.join(marks, keys, "left").withColumn("match_type", kind).drop("__high", "__low")


def best_samples(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The preferred row of each key; a key's other rows are dropped where they are read, not after the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") == 1).drop("__r")


def prototypes(df: DataFrame, keys: list[str], value: str, views: str, score: str) -> DataFrame:
    """Groups of scored samples: n, medians, upper quarters and maxima of value and views, mean score, confidence, stability."""
    by_value = spread_percentiles(df, keys, value, {"median_value": 0.5, "p75_value": 0.75}).drop("n")
    by_views = spread_percentiles(df, keys, views, {"median_views": 0.5, "p75_views": 0.75}).drop("n")
    plain = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(value).alias("max_value"), F.max(views).alias("max_views"), F.avg(score).alias("avg_score"))
    out = plain.join(by_value, keys, "left").join(by_views, keys, "left").withColumn("confidence", confidence(F.col("n"), F.col("median_value"), F.col("avg_score")))
    tier = view_stability(F.col("n"), F.col("p75_views"), F.col("max_views"), F.col("confidence"))
    return out.withColumn("__t", tier).select("*", F.col("__t.tier").alias("stability"), F.col("__t.rank").alias("stability_rank")).drop("__t")


def weighted_keywords(df: DataFrame, keys: list[str], words: str, score: str, k: int = 8) -> DataFrame:
    """Each group's k keywords of most weight, a sample's weight growing with its score: keys, keyword, weight, place."""
    sums = df.select(*keys, F.explode(words).alias("keyword"), (1 + F.col(score) / 100).alias("__w")).groupBy(*keys, "keyword").agg(F.sum("__w").alias("weight"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("weight", 9)), "keyword"))).where(F.col("place") <= k)


def by_dimension(df: DataFrame, single: list[str], multi: list[str], keep: list[str]) -> DataFrame:
    """A row for each dimension that a row has a value of (several for a list): dimension, name, and ``keep``."""
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("name"))
    listed = lambda m: F.transform(F.coalesce(F.col(m), F.array()), lambda x: pair(m, x))
    parts = [F.array(*[pair(d, F.col(d)) for d in single]), *[listed(m) for m in multi]]
    return df.select(*keep, F.explode(F.concat(*parts)).alias("__d")).select("__d.*", *keep).where(F.coalesce("name", F.lit("")) != "")


def dimension_baselines(df: DataFrame, reward: str, views: str, label: str, least: int = 2) -> DataFrame:
    """Groups of ``by_dimension`` rows with at least ``least`` rows: n, reward and view figures, rows by label, confidence."""
    g, keys = df, ["dimension", "name"]
    plain = g.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(reward).alias("avg_reward"), F.avg(views).alias("avg_views"), F.max(views).alias("max_views"), *[F.count_if(F.col(label) == x).alias(x) for x in ("high", "mid", "low")])
    quarters = spread_percentiles(g, keys, reward, {"median_reward": 0.5, "p75_reward": 0.75}).drop("n")
    return plain.where(F.col("n") >= least).join(quarters, keys, "left").withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 20))


def dimension_examples(df: DataFrame, order: list[Column], key: str, k: int = 3) -> DataFrame:
    """The first k rows of each dimension's group: dimension, name, place, key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("dimension", "name").orderBy(*order))).where(F.col("place") <= k).select("dimension", "name", "place", key)


def _slot_sums(tokens: Column, dim: int, unit: bool) -> Column:
    """What a row's tokens add to each of the slots, of length 1 if ``unit``; distinct tokens are hashed once for some rows."""

    @F.arrow_udf("array<double>")
    def sums(lists: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(lists), ROWS_AT_ONCE):
            part = lists.slice(at, ROWS_AT_ONCE)
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            coded = part.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            digests = [hashlib.sha256(t.encode()).digest() for t in names]
            slot = np.array([int.from_bytes(h[:4], "big") % dim for h in digests], np.int64)
            weight = np.array([(1 if h[4] % 2 == 0 else -1) * (1 + min(1.0, len(t) / 8)) for t, h in zip(names, digests, strict=True)], np.float64)
            code = coded.indices.to_numpy(zero_copy_only=False)
            cell = np.repeat(np.arange(len(part)) * dim, sizes) + slot[code]
            made = np.bincount(cell, weight[code], len(part) * dim).astype(np.float64).reshape(-1, dim)  # without tokens they are integers
            if unit:
                made /= np.maximum(np.sqrt((made * made).sum(1, keepdims=True)), 1e-300)
            found.append(made.ravel())
        flat = np.concatenate(found) if found else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), pa.array(flat))

    return sums(tokens)


def hashed_vectors(df: DataFrame, key: str, tokens: str, dim: int = 128, single: bool = False) -> DataFrame:
    """Hashed text vectors as rows of their slots other than 0: key, slot, weight.

    A token's SHA-256 names its slot (first four bytes) and its sign (the fifth); longer tokens weigh up to twice as
    much. Weights are eighths, so their sums don't depend on an order; each vector has length 1. Tokens are summed where
    they are read; where no key has a second row (``single``), nothing is shuffled.
    """
    own = df.select(key, F.posexplode(_slot_sums(F.col(tokens), dim, single)).alias("slot", "__w")).where(F.col("__w") != 0)
    if single:
        return own.select(key, "slot", F.round("__w", 6).alias("weight"))
    sums = own.groupBy(key, "slot").agg(F.sum("__w").alias("__w")).where(F.col("__w") != 0)
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(key)))  # at most dim rows
    return sums.select(key, "slot", F.round(F.col("__w") / norm, 6).alias("weight"))
