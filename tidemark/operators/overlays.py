"""Scores laid over a base by similar vectors: an exact nearest search that leaves blocks out by bounds, and what it says."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp
from tidemark.functions.rewards import interaction_label
from tidemark.operators.prototypes import spread_percentiles
from tidemark.operators.steps import cut

# ---- fixed values: the pool's least size, matches that count, and what they are worth ----
LEAST_ACCOUNT = 50
MATCHES, SHOWN = 8, 3
WORTH = {"positive": 3.2, "risk": 2.7, "quality": 2.0, "quality_from": 0.48, "positive_quality": 0.75, "risk_quality": 0.65}
MIX = {"text": 0.55, "visual": 0.45}
# ---- end of fixed values ----

#: Vectors of a block, at about; blocks of a pool, at most (larger ones are read in pieces); targets of one piece of work.
BLOCK, BLOCKS, DEAL = 2_048, 256, 4_096
EVERYONE = "*"


def _unit(rows) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _dealt(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a salt, DEAL of a pool to each, and the pools' salts."""
    sizes = rows.groupBy("pool").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("__w"))
    salted = rows.join(sizes, "pool").withColumn("salt", F.pmod(F.xxhash64(name), F.col("__w")).cast("int")).drop("__w")
    return salted, sizes.select("pool", F.explode(F.sequence(F.lit(0), F.col("__w") - 1)).alias("salt"))


def _against_pivots(rows: DataFrame, pivots: DataFrame, name: str, work, schema: str) -> DataFrame:
    """``work(rows, pivots)`` for each pool; large pools are dealt and each deal gets the pivots."""
    salted, salts = _dealt(rows, name)
    copies = pivots.join(salts, "pool").select(F.col("pool").alias("p2"), F.col("salt").alias("s2"), "block", F.col("v").alias("pv"), *[c for c in pivots.columns if c not in ("pool", "block", "v")])
    empty = pd.DataFrame({c.split()[0]: pd.Series([], dtype=t) for c, t in zip(schema.split(", "), ["object"] * len(schema.split(", ")), strict=True)})
    run = lambda x, y: work(x, y.sort_values("block")) if len(x) and len(y) else empty
    return salted.groupBy("pool", "salt").cogroup(copies.groupBy("p2", "s2")).applyInPandas(run, schema)


def nearest_in_pools(targets: DataFrame, history: DataFrame, k: int = MATCHES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The k most similar history vectors of each target in its pool, exactly, and which blocks were looked into.

    ``targets`` has pool, target, own (a history row that doesn't count, or
    null), v; ``history`` has pool, sample, pref (the larger comes first of
    equally similar ones), v; identifiers are longs.  A pool's history is put
    into blocks about pivots; the angle to a pivot less its block's radius
    bounds the similarity to all in it.  A target looks into the block with the
    best bound first, and then only into those whose bound reaches its k-th
    best.  Returns target, pool, rank, sample, similarity (above 0), and target,
    pool, block, bound, visited.
    """
    own = cut(history.select("pool", F.col("sample").cast("long").alias("sample"), F.col("pref").cast("double").alias("pref"), F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull()))
    asked = cut(targets.select("pool", F.col("target").cast("long").alias("target"), F.coalesce(F.col("own").cast("long"), F.lit(-1)).alias("own"), F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull()))
    own = own.join(asked.select("pool").distinct(), "pool", "left_semi")
    sizes = own.groupBy("pool").agg(F.least(F.lit(BLOCKS), F.ceil(F.count("*") / block)).cast("int").alias("__b"))
    order = Window.partitionBy("pool").orderBy(F.xxhash64("sample"), "sample")
    first = own.withColumn("block", F.row_number().over(order) - 1).where(F.col("block") < BLOCKS)
    pivots = cut(first.join(sizes, "pool").where(F.col("block") < F.col("__b")).select("pool", "block", "v"))

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        angle = _angles(_unit(x["v"]), _unit(y["pv"]))
        at = angle.argmin(1)
        return pd.DataFrame({"pool": x["pool"].to_numpy(), "sample": x["sample"].to_numpy(), "pref": x["pref"].to_numpy(), "v": x["v"].to_numpy(), "block": y["block"].to_numpy()[at], "angle": angle[np.arange(len(x)), at]})

    kind = dict(own.dtypes)["pool"]
    placed = cut(_against_pivots(own, pivots, "sample", nearest, f"pool {kind}, sample long, pref double, v array<double>, block int, angle double"))
    blocks = placed.groupBy("pool", "block").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / (4 * block)).cast("int").alias("pieces"))
    pivots = cut(pivots.join(blocks, ["pool", "block"]))

    def bounds(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        gap = np.maximum(_angles(_unit(x["v"]), _unit(y["pv"])) - y["radius"].to_numpy(), 0)
        n = len(y)
        return pd.DataFrame({"pool": np.repeat(x["pool"].to_numpy(), n), "target": np.repeat(x["target"].to_numpy(), n), "block": np.tile(y["block"].to_numpy(), len(x)), "bound": np.cos(np.minimum(gap, np.pi)).ravel() + 1e-9})

    reach = cut(_against_pivots(asked, pivots, "target", bounds, f"pool {kind}, target long, block int, bound double"))
    best = Window.partitionBy("pool", "target").orderBy(F.desc("bound"), "block")
    reach = reach.withColumn("place", F.row_number().over(best))

    def visit(pairs: DataFrame) -> DataFrame:
        load = pairs.groupBy("pool", "block").agg(F.ceil(F.count("*") / DEAL).cast("int").alias("__t"))
        pieces = blocks.select("pool", "block", "pieces").join(load, ["pool", "block"])
        left = pairs.join(pieces, ["pool", "block"]).join(asked, ["pool", "target"]).select("pool", "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("target"), F.col("__t")).cast("int").alias("salt"), "target", "own", "v")
        right = placed.join(pieces, ["pool", "block"]).select(F.col("pool").alias("p2"), F.col("block").alias("b2"), F.pmod(F.xxhash64("sample"), F.col("pieces")).cast("int").alias("c2"), F.explode(F.sequence(F.lit(0), F.col("__t") - 1)).alias("s2"), "sample", "pref", F.col("v").alias("w"))

        def top(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({"pool": [], "target": [], "sample": [], "pref": [], "similarity": []}).astype({"target": "int64", "sample": "int64", "pref": "float64", "similarity": "float64"})
            y = y.sort_values(["pref", "sample"], ascending=[False, True], kind="stable")
            ids, pref = y["sample"].to_numpy(), y["pref"].to_numpy()
            sims = np.round(_unit(x["v"]) @ _unit(y["w"]).T, 9)
            sims[x["own"].to_numpy()[:, None] == ids[None]] = -1
            at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            out = pd.DataFrame({"pool": np.repeat(x["pool"].to_numpy(), at.shape[1]), "target": np.repeat(x["target"].to_numpy(), at.shape[1]), "sample": ids[at].ravel(), "pref": pref[at].ravel(), "similarity": np.take_along_axis(sims, at, 1).ravel()})
            return out[out["similarity"] > 0]

        return left.groupBy("pool", "block", "piece", "salt").cogroup(right.groupBy("p2", "b2", "c2", "s2")).applyInPandas(top, f"pool {kind}, target long, sample long, pref double, similarity double")

    ranked = Window.partitionBy("pool", "target").orderBy(F.desc("similarity"), F.desc("pref"), "sample")
    first_found = cut(visit(reach.where("place = 1")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
    kth = first_found.where(F.col("rank") == k).select("pool", "target", F.col("similarity").alias("kth"))
    more = cut(reach.where("place > 1").join(kth, ["pool", "target"], "left").withColumn("visited", F.col("bound") >= F.coalesce("kth", F.lit(0.0))).drop("kth"))
    rest = visit(more.where("visited").drop("visited"))
    every = first_found.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    looked = reach.where("place = 1").withColumn("visited", F.lit(True)).unionByName(more).drop("place")
    return every.select("target", "pool", "rank", "sample", "similarity"), looked


def overlay_context(train: DataFrame, account: str, reward: str) -> DataFrame:
    """Train rows with what a search needs: l (high, mid or low by the quarters of all rewards) and own (the account has rows enough)."""
    marks = spread_percentiles(train, [], reward, {"__low": 0.25, "__high": 0.75}).drop("n")  # a single row
    sizes = train.where(F.col(account).isNotNull()).groupBy(account).agg(F.count("*").alias("__n"))
    rows = train.crossJoin(F.broadcast(marks)).join(sizes, account, "left")
    kind = interaction_label(F.lit(None).cast("string"), F.col(reward), F.col("__low"), F.col("__high"))
    return rows.withColumns({"l": kind, "own": F.coalesce(F.col("__n") >= LEAST_ACCOUNT, F.lit(False))}).drop("__low", "__high", "__n")


def overlay_matches(targets: DataFrame, train: DataFrame, key: str, account: str, reward: str, vector: str, k: int = MATCHES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The k nearest high, mid and low rows of each target among its account's rows, or among all where the account has too few.

    Returns target, scope (account or global_fallback), l, rank, sample,
    similarity, reward; and the blocks as ``nearest_in_pools`` has them.
    """
    rows = cut(overlay_context(train, account, reward))
    known = rows.where("own").select(F.col(account).alias("__a")).distinct()
    scoped = targets.join(known, F.col(account) == F.col("__a"), "left").withColumn("scope", F.coalesce("__a", F.lit(EVERYONE))).drop("__a")
    labels = F.array(*[F.lit(x) for x in ("high", "mid", "low")])
    pool = lambda scope, label: F.to_json(F.struct(scope.alias("s"), label.alias("l")))
    asked = scoped.select(F.explode(labels).alias("l"), "scope", F.col(key).alias("target"), F.col(key).alias("own"), F.col(vector).alias("v")).withColumn("pool", pool(F.col("scope"), F.col("l")))
    scopes = F.array_compact(F.array(F.lit(EVERYONE), F.when(F.col("own"), F.col(account))))
    pref = F.when(F.col("l") == "low", 100 - F.col(reward)).otherwise(F.col(reward))
    held = rows.select(F.explode(scopes).alias("scope"), F.col("l"), F.col(key).alias("sample"), pref.alias("pref"), F.col(vector).alias("v")).withColumn("pool", pool(F.col("scope"), F.col("l")))
    found, looked = nearest_in_pools(asked, held, k, block)
    named = found.withColumns({"scope": F.when(F.get_json_object("pool", "$.s") == EVERYONE, "global_fallback").otherwise("account"), "l": F.get_json_object("pool", "$.l")})
    return named.join(rows.select(F.col(key).alias("sample"), F.col(reward).alias("reward")), "sample").select("target", "scope", "l", "rank", "sample", "similarity", "reward"), looked


def overlay_scores(matches: DataFrame, base: Column) -> DataFrame:
    """What the matches add to and take from a base score: target, scope, score, quality, positive_similarity, risk_similarity."""
    high, low = F.col("l") == "high", F.col("l") == "low"
    most = lambda test, value: F.coalesce(F.max(F.when(test, value)), F.lit(0.0))
    sums = matches.groupBy("target", "scope").agg(
        most(high, F.col("similarity") * F.col("reward") / 100).alias("positive"), most(low, F.col("similarity") * (100 - F.col("reward")) / 100).alias("risk"), F.max("similarity").alias("best"),
        most(high, F.col("similarity")).alias("positive_similarity"), most(low, F.col("similarity")).alias("risk_similarity"),
    )
    quality = F.greatest("best", F.col("positive") * WORTH["positive_quality"], F.col("risk") * WORTH["risk_quality"])
    score = clamp(base + F.col("positive") * WORTH["positive"] - F.col("risk") * WORTH["risk"] + F.greatest(F.lit(0.0), quality - WORTH["quality_from"]) * WORTH["quality"])
    return sums.select("target", "scope", F.when(quality <= 0, base).otherwise(score).alias("score"), quality.alias("quality"), "positive_similarity", "risk_similarity")


def mixed_overlays(targets: DataFrame, parts: dict[str, DataFrame], key: str, base: Column) -> DataFrame:
    """Each target's score by each kind of vector and by their mix; the base where a kind says nothing."""
    out = targets.select(F.col(key).alias("target"))
    for name, df in parts.items():
        out = out.join(df.select("target", F.col("score").alias(name), F.col("quality").alias(f"{name}_quality"), F.col("scope").alias(f"{name}_scope")), "target", "left")
    out = out.withColumns({name: F.coalesce(F.col(name), base) for name in parts} | {f"{name}_quality": F.coalesce(F.col(f"{name}_quality"), F.lit(0.0)) for name in parts})
    delta = sum(((F.col(name) - base) * MIX[name] for name in parts), F.lit(0.0))
    return out.withColumns({"mix": clamp(base + delta), "scope": F.coalesce(*[F.col(f"{n}_scope") for n in parts], F.lit("none"))}).drop(*[f"{n}_scope" for n in parts])


def vector_coverage(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """One row: how many rows there are and have each kind of vector, and their shares."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"{c}_ready") for c in kinds])
    return counts.select("*", *[F.round(F.col(f"{c}_ready") / F.greatest(F.lit(1), F.col("n")), 4).alias(f"{c}_rate") for c in kinds])
