"""Orders, top-k metrics, diversity and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.hashes import holdout_bucket
from tidemark.functions.rewards import gain, interaction_label


def diversity_penalty(df: DataFrame, keys: dict[str, tuple[float, int | None]], order: list[Column]) -> DataFrame:
    """Adds penalty: for each key column, its weight times how often its value came before in ``order``, up to a cap.

    What came before depends on the given order alone, so each key is one window.
    """
    total = F.lit(0.0)
    for name, (weight, cap) in keys.items():
        seen = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
        seen = F.least(seen, F.lit(cap)) if cap is not None else seen
        total = total + F.when(F.coalesce(F.col(name), F.lit("")) != "", seen * F.lit(weight)).otherwise(F.lit(0.0))
    return df.withColumn("penalty", total)


def ranking_metrics(df: DataFrame, group: list[str], score: str, reward: str, tie: str, k: int = 10, explicit: Column | None = None) -> DataFrame:
    """Of each group: n, ndcg, hit_rate, lift, high_hit, low_avoidance, mae of the order by ``score`` at k."""
    w = Window.partitionBy(*group)
    by_score, by_reward = w.orderBy(F.col(score).desc(), F.col(tie)), w.orderBy(F.col(reward).desc(), F.col(tie))
    rows = df.withColumn("__p", F.row_number().over(by_score)).withColumn("__i", F.row_number().over(by_reward)).withColumn("__n", F.count("*").over(w))
    quarter = F.percentile(F.col(reward), F.array(F.lit(0.25), F.lit(0.75)))
    cuts = df.groupBy(*group).agg(quarter.alias("__q")).select(*[F.col(g).alias(f"__g_{g}") for g in group], "__q")
    rows = rows.join(cuts, [rows[g].eqNullSafe(cuts[f"__g_{g}"]) for g in group]) if group else rows.crossJoin(F.broadcast(cuts))
    label = interaction_label(explicit if explicit is not None else F.lit(None).cast("string"), F.col(reward), F.col("__q")[0], F.col("__q")[1])
    limit = F.least(F.lit(k), F.col("__n"))
    power = F.pow(F.lit(2.0), gain(F.col(reward))) - 1
    dcg = lambda r: F.sum(F.when(F.col(r) <= k, power / F.log2(F.col(r) + 1)))
    top = F.col("__p") <= limit
    out = rows.withColumn("__l", label).groupBy(*group).agg(
        F.count("*").alias("n"), F.max(limit).alias("__k"), dcg("__p").alias("__d"), dcg("__i").alias("__best"),
        F.count_if(top & (F.col("__i") <= limit)).alias("__hit"), F.avg(F.when(top, F.col(reward))).alias("__top"), F.avg(reward).alias("__all"),
        F.count_if(top & (F.col("__l") == "high")).alias("__high"), F.count_if(top & (F.col("__l") == "low")).alias("__low"), F.avg(F.abs(F.col(score) - F.col(reward))).alias("mae"),
    )
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out.select(*group, "n", div(F.col("__d"), F.col("__best")).alias("ndcg"), div(F.col("__hit"), F.col("__k")).alias("hit_rate"), F.when(F.col("__all") > 0, div(F.col("__top"), F.col("__all"))).otherwise(0.0).alias("lift"), div(F.col("__high"), F.col("__k")).alias("high_hit"), div(F.col("__k") - F.col("__low"), F.col("__k")).alias("low_avoidance"), "mae")


def time_holdout(df: DataFrame, account: str, published: str, key: str, share: float = 0.8, least: int = 5) -> DataFrame:
    """Adds split: the later rows of an account are held out; accounts too small or without all times go by hash."""
    w = Window.partitionBy(account)
    out = df.withColumn("__n", F.count("*").over(w)).withColumn("__timed", F.count(published).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.col(published), F.col(key))))
    cut = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.ceil(F.col("__n") * share)))
    by_time = F.when(F.col("__r") <= cut, "train").otherwise("eval")
    by_hash = F.when(holdout_bucket(F.col(key)) == 0, "eval").otherwise("train")
    timed = (F.col("__n") >= least) & (F.col("__timed") == F.col("__n"))
    return out.withColumn("policy", F.when(timed, "time").otherwise("hash")).withColumn("split", F.when(timed, by_time).otherwise(by_hash)).drop("__n", "__timed", "__r")


def without_leaks(train: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Training rows that share none of the keys (blank ones aside) with the held-out rows; all of them if none would be left."""
    out = train
    for key in keys:
        seen = held.select(key).where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").distinct()
        out = out.join(seen, key, "left_anti")
    out = out.select(*train.columns)
    return train if out.isEmpty() else out


def round_robin(df: DataFrame, label: str, labels: list[str], order: list[Column], limit: int) -> DataFrame:
    """Rows taken in turn from each label, best first, up to ``limit``; adds turn."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)), F.lit(0))
    place = F.when(place == 0, F.lit(len(labels) + 1)).otherwise(place)
    # no label can give more than ``limit`` rows, so each is cut before the turns are put in order
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("turn") <= limit)
    return ranked.orderBy("turn", place, *order).limit(limit)


def first_hit_queue(sources: list[DataFrame], key: str, order: list[Column], limit: int) -> DataFrame:
    """Rows of several queues, each key once, from the first queue that has it; at most ``limit``."""
    union = None
    for place, df in enumerate(sources):
        own = df.withColumn("queue", F.lit(place))
        union = own if union is None else union.unionByName(own, allowMissingColumns=True)
    ranked = union.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("queue", *order))).where("__r = 1").drop("__r")
    return ranked.orderBy("queue", *order).limit(limit)
