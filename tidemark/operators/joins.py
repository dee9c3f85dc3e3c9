"""Joins that are more than an equality: intervals, searches in time, links, similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.steps import cut


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of intervals of one key that touch, with the common stretch.

    Both have the columns start and end besides ``keys``; the right's others are
    kept.  Intervals are dealt to cells of ``width``, so a key is not one task
    and only neighbours meet; a pair counts in the cell of its later start.  An
    interval that ends before it starts is touched by those that span it, and
    the stretch is negative.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long")))
    a = left.withColumn("__c", cells(F.col("start"), F.col("end")))
    b = right.select(*keys, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys]).withColumn("__c", cells(F.col("right_start"), F.col("right_end")))
    pairs = a.join(b, [*keys, "__c"]).where((F.col("right_start") <= F.col("end")) & (F.col("right_end") >= F.col("start")))
    pairs = pairs.where(F.floor(F.greatest("start", "right_start") / width) == F.col("__c"))
    return pairs.withColumn("from", F.greatest("start", "right_start")).withColumn("to", F.least("end", "right_end")).drop("__c")


def mean_within(spans: DataFrame, points: DataFrame, keys: list[str], at: str, value: str, width: float) -> DataFrame:
    """Each span with the mean and number of the points that lie in [start, end]."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long")))
    a = spans.withColumn("__c", cells)
    b = points.select(*keys, F.col(at).alias("__at"), F.col(value).alias("__v"), F.floor(F.col(at) / width).cast("long").alias("__c"))
    hit = a.join(b, [*keys, "__c"], "left").withColumn("__v", F.when((F.col("__at") >= F.col("start")) & (F.col("__at") <= F.col("end")), F.col("__v")))
    return hit.groupBy(*spans.columns).agg(F.avg("__v").alias("mean"), F.count("__v").alias("n"))


def next_with(df: DataFrame, keys: list[str], at: str, flag: Column, within: float, take: list[str], backward: bool = False) -> DataFrame:
    """Each row with the nearest later (earlier) row of its key that has the flag, if it lies within so long."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).asc() if backward else F.col(at).desc())  # frames that only grow are one pass
    found = F.when(flag, F.struct(at, *take))
    near = F.last(found, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("__f", near)
    close = F.abs(F.col(f"__f.{at}") - F.col(at)) <= within
    return out.select(*df.columns, *[F.when(close, F.col(f"__f.{c}")).alias(f"found_{c}") for c in [at, *take]])


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """Each left row with the right row of its key nearest in time, the earlier of two: one sorted pass, no pairs."""
    cols = [*keys, at]
    a = left.select(*left.columns, F.lit(None).cast(right.select(F.struct(at, *take).alias("s")).schema["s"].dataType).alias("__r"), F.lit(1).alias("__k"))
    b = right.select(*cols, F.struct(at, *take).alias("__r"), F.lit(0).alias("__k"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    before = F.last("__r", ignorenulls=True).over(w.orderBy(at, "__k").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__r", ignorenulls=True).over(w.orderBy(F.col(at).desc(), F.col("__k")).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__b", before).withColumn("__a", after).where("__k = 1")
    earlier = F.col("__b").isNotNull() & (F.col("__a").isNull() | (F.col(at) - F.col(f"__b.{at}") <= F.col(f"__a.{at}") - F.col(at)))
    best = F.when(earlier, F.col("__b")).otherwise(F.col("__a"))
    return out.select(*left.columns, *[best[c].alias(f"near_{c}") for c in [at, *take]])


def resolve_link(df: DataFrame, id_col: str, known_ids: DataFrame, known_id: str, bridge: DataFrame, bridge_key: str, bridge_id: str) -> DataFrame:
    """Adds link: the row's own id if it exists, else the id that the bridge has for its key, if that exists; and link_source."""
    ids = known_ids.select(F.col(known_id).alias("__id")).distinct()
    own = df.join(ids.withColumnRenamed("__id", "__own"), df[id_col] == F.col("__own"), "left")
    via = bridge.select(F.col(bridge_key).alias("__bk"), F.col(bridge_id).alias("__bid")).join(ids, F.col("__bid") == F.col("__id"), "left_semi")
    via = via.groupBy("__bk").agg(F.min("__bid").alias("__via"))
    out = own.join(via, F.col(bridge_key) == F.col("__bk"), "left")
    return out.select(*df.columns, F.coalesce("__own", "__via").alias("link"), F.when(F.col("__own").isNotNull(), "row").when(F.col("__via").isNotNull(), "bridge").otherwise("none").alias("link_source"))


def token_matches(targets: DataFrame, history: DataFrame, target_id: str, history_id: str, tokens: str, candidates: int = 360, k: int = 8) -> DataFrame:
    """The k most similar history rows of each target by Jaccard similarity of token sets.

    Candidates share a token that few history rows have: a posting list longer
    than ``max(80, min(420, rows / 8))`` says little and is left out; the
    ``candidates`` rows with most shared tokens are compared.  Ties go to the smaller identifier.
    """
    names = F.array_distinct(F.transform(tokens, lambda x: F.xxhash64(x)))  # 64 bits stand for a token
    asked = cut(targets.select(F.col(target_id).alias("target_id"), names.alias("t")).select("target_id", F.size("t").alias("tn"), F.explode("t").alias("token")))
    total = history.agg(F.count("*").alias("__rows"))
    # only tokens that a target has are worth posting; texts are read once for all that follows
    posts = history.select(F.col(history_id).alias("history_id"), names.alias("h")).select("history_id", F.size("h").alias("hn"), F.explode("h").alias("token"))
    posts = cut(posts.join(asked.select("token").distinct(), "token", "left_semi"))
    short = posts.groupBy("token").agg(F.count("*").alias("__n")).crossJoin(F.broadcast(total))
    short = short.select("token", (F.col("__n") <= F.greatest(F.lit(80), F.least(F.lit(420), F.floor(F.col("__rows") / 8)))).alias("rare"))
    listed = posts.join(short, "token")
    pairs = asked.join(listed.where("rare"), "token").groupBy("target_id", "history_id", "tn", "hn").agg(F.count("*").alias("shared_rare"))
    ranked = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("shared_rare"), "history_id"))).where(F.col("__r") <= candidates)
    # common tokens count for the similarity; they are looked up for the candidates alone
    chosen = ranked.select("target_id", "history_id", "tn", "hn")
    shared = chosen.join(asked.select("target_id", "token"), "target_id").join(posts.select("history_id", "token"), ["history_id", "token"]).groupBy("target_id", "history_id", "tn", "hn").agg(F.count("*").alias("shared"))
    score = F.col("shared") / (F.col("tn") + F.col("hn") - F.col("shared"))
    best = shared.withColumn("similarity", score).withColumn("rank", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("similarity"), "history_id")))
    return best.where(F.col("rank") <= k).select("target_id", "rank", "history_id", "shared", "similarity")


def vector_matches(vectors: DataFrame, pool: str, vec_id: str, vector: str, k: int = 5, block: int = 2_048) -> DataFrame:
    """The k nearest by cosine among the other vectors of each one's pool: vec_id, rank, match_id, similarity.

    A pool is dealt over blocks; a pair of blocks is one task, which returns the
    k best of each vector and never the pairs.
    """
    base = vectors.select(F.col(pool).alias("pool"), F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    sizes = base.groupBy("pool").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = base.join(sizes, "pool").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.withColumn("other", other).select("pool", F.col("own").alias("a"), F.col("other").alias("b"), "id", "v")
    right = dealt.withColumn("other", other).select(F.col("pool").alias("p2"), F.col("other").alias("a2"), F.col("own").alias("b2"), F.col("id").alias("id2"), F.col("v").alias("v2"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"vec_id": [], "match_id": [], "similarity": []}).astype({"vec_id": "int64", "match_id": "int64", "similarity": "float64"})
        y = y.rename(columns={"id2": "id", "v2": "v"}).sort_values("id", kind="stable")
        unit = lambda f: (m := np.stack(f["v"].to_numpy())) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, sims = y["id"].to_numpy(), np.clip(unit(x) @ unit(y).T, 0, 1)
        sims[x["id"].to_numpy()[:, None] == ids[None]] = -1
        top = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"vec_id": np.repeat(x["id"].to_numpy(), top.shape[1]), "match_id": ids[top].ravel(), "similarity": np.take_along_axis(sims, top, 1).ravel()})
        return out[out["similarity"] >= 0]

    found = left.groupBy("pool", "a", "b").cogroup(right.groupBy("p2", "a2", "b2")).applyInPandas(best, "vec_id long, match_id long, similarity double")
    order = Window.partitionBy("vec_id").orderBy(F.round("similarity", 9).desc(), "match_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
