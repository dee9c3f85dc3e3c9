"""One row about many: simulated clips and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import safe_ratio

#: Fixed value: the simulated score from which a clip has high potential.
HIGH_POTENTIAL = 72


def simulation_summary(df: DataFrame, score: Column, bottleneck: Column, stage: Column, by: list[str] | None = None) -> DataFrame:
    """n, avg_score, high_potential, and the most frequent bottleneck and stage (of equals the first by name), for each of ``by``.

    Rows are merged to one for each bottleneck and stage before anything else.  Null scores count 0.  Without ``by`` an
    empty table gives one row with zeros and nulls.
    """
    by = by or []
    score = F.coalesce(score.cast("double"), F.lit(0.0))
    rows = df.select(*by, score.alias("__score"), bottleneck.alias("__b"), stage.alias("__s"))
    one = rows.groupBy(*by, "__b", "__s").agg(F.count("*").alias("__n"), F.sum("__score").alias("__sum"), F.count_if(F.col("__score") >= HIGH_POTENTIAL).alias("__high"))
    # every pair of names is one row by now, so the counts of a name are sums over few rows
    named = lambda c: F.sum("__n").over(Window.partitionBy(*by, c))
    one = one.withColumns({"__nb": named("__b"), "__ns": named("__s")})
    first = lambda c, n: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(n), -F.col(f"{c}_rank"))))
    place = lambda c: F.dense_rank().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(c))
    one = one.withColumns({"__b_rank": place("__b"), "__s_rank": place("__s")})
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return one.groupBy(*by).agg(
        zero("__n").alias("n"), F.coalesce(F.sum("__sum") / F.nullif(F.sum("__n"), F.lit(0)), F.lit(0.0)).alias("avg_score"), zero("__high").alias("high_potential"),
        first("__b", "__nb").alias("top_bottleneck"), first("__s", "__ns").alias("top_stage"))


def transcript_summary(raw: DataFrame, processed: DataFrame, key: str, order: str, text: str, noise: Column, ad: Column, k: int = 3) -> DataFrame:
    """Of each transcript: n_raw, n_processed, compression (their ratio), n_noise, n_ads, and the first ``k`` texts of either kind.

    Noise and ads are those of the processed pieces.  A transcript with raw pieces only has zeros and empty lists; no
    more than ``k`` texts of a transcript and kind are held together.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    pieces = processed.select(F.col(key), F.col(order).alias("__order"), F.coalesce(F.col(text), F.lit("")).alias("__text"), flag(noise).alias("noise"), flag(ad).alias("ads"))
    counts = pieces.groupBy(key).agg(F.count("*").alias("n_processed"), F.count_if("noise").alias("n_noise"), F.count_if("ads").alias("n_ads"))
    marked = pieces.unpivot([key, "__order", "__text"], ["noise", "ads"], "kind", "marked").where("marked")
    marked = marked.withColumn("__r", F.row_number().over(Window.partitionBy(key, "kind").orderBy("__order", "__text"))).where(F.col("__r") <= k)
    texts = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("__r", "__text")))), lambda x: x["__text"])
    shown = marked.groupBy(key).agg(texts("noise").alias("sample_noise"), texts("ads").alias("sample_ads"))
    out = raw.groupBy(key).agg(F.count("*").alias("n_raw")).join(counts, key, "left").join(shown, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return out.select(key, "n_raw", zero("n_processed"), safe_ratio(F.coalesce(F.col("n_processed"), F.lit(0)), F.col("n_raw")).alias("compression"), zero("n_noise"), zero("n_ads"), none("sample_noise"), none("sample_ads"))
