"""Which structure a work's words speak for, whether its label agrees, and what that amounts to over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, known, safe_ratio

#: Structure, words for it, words that add to them, weight.
STRUCTURES = [
    ("climax_first", ["一开口", "刚开口", "刚唱", "第一句", "上来就", "开口跪", "开头"], ["高音", "爆发", "炸", "燃", "惊艳", "封神", "开大"], 28),
    ("chorus_first", ["副歌", "合唱", "大合唱", "全场合唱", "一起唱"], ["开口", "开场", "直接", "一上来"], 22),
    ("reaction_first", ["reaction", "反应", "全场", "观众", "导师表情", "现场沸腾", "泪目", "尖叫", "掌声"], [], 22),
    ("quote_first", ["这句话", "一句话", "金句", "名句", "说出", "喊话", "评价太准"], [], 21),
    ("setup_to_payoff", ["没想到", "直到", "最后", "反转", "铺垫", "导师", "点评", "晋级", "淘汰", "结果"], ["爆发", "高音", "封神", "泪目", "炸场"], 20),
    ("context_first", ["第一次", "原因", "为什么", "如何", "故事", "背景", "解析", "复盘", "教程", "幕后"], [], 18),
    ("pure_highlight", ["清唱", "无伴奏", "爆发", "直击", "听不够", "高音", "直拍", "名场面", "舞台燃炸"], [], 18),
    ("linear", ["vlog", "日常", "记录", "过程", "合集", "盘点", "完整版"], [], 14),
]
#: Structures that count more where a word stands in the first 48 characters; the one that counts more with context.
EARLY, EARLY_CHARS, EARLY_BONUS = ("climax_first", "chorus_first"), 48, 10
PAYOFF, PAYOFF_BONUS = "setup_to_payoff", 8
#: Fixed value: a lead of less than this is taken off the best score.
LEAD = 8.0
#: How far each status asks for a review.
STATUS_WEIGHTS = {"conflict_review": 32.0, "suggested_update": 26.0, "needs_review": 18.0, "low_confidence": 12.0, "unknown": 10.0, "trusted": 2.0, "manual_verified": 0.0}


def _hits(text: Column, words: list[str]) -> Column:
    lower = F.lower(text)
    return sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0))


def scores(text: Column) -> Column:
    """Array of struct(score, place, structure) of the structures that a text has words of, best first; of equals the first in order."""
    text, found = F.coalesce(text, F.lit("")), []
    for place, (name, words, context, weight) in enumerate(STRUCTURES):
        near = _hits(text, context)
        score = weight + F.least(F.lit(24), _hits(text, words) * 8) + F.least(F.lit(14), near * 7)
        if name in EARLY:
            score = score + F.when(_hits(F.substring(text, 1, EARLY_CHARS), words) > 0, EARLY_BONUS).otherwise(0)
        if name == PAYOFF:
            score = score + F.when(near > 0, PAYOFF_BONUS).otherwise(0)
        found.append(F.when(_hits(text, words) > 0, F.struct(clamp(score.cast("double")).alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("structure"))))
    return F.sort_array(F.array_compact(F.array(*found)), asc=False)


def suggestion(ranked: Column) -> Column:
    """struct(structure, score): the best of ``scores``, less what its lead is short of LEAD."""
    best, second = F.get(ranked, 0), F.get(ranked, 1)
    lead = best["score"] - F.coalesce(second["score"], F.lit(-LEAD))
    return F.struct(F.coalesce(best["structure"], F.lit("unknown")).alias("structure"), F.coalesce(F.greatest(F.lit(0.0), best["score"] - F.greatest(F.lit(0.0), LEAD - lead)), F.lit(0.0)).alias("score"))


def evaluated(df: DataFrame, text: str, current: str, confidence: str, reward: str, label: str) -> DataFrame:
    """Adds suggested, score, agrees, status and priority of a review."""
    out = df.withColumn("__ranked", scores(F.col(text))).withColumn("__s", suggestion(F.col("__ranked")))  # the scores are read several times, so they stand in a column of their own
    out = out.withColumns({"suggested": F.col("__s.structure"), "score": F.col("__s.score")}).drop("__s", "__ranked")
    has, offers, score = known(F.col(current)), known(F.col("suggested")), F.col("score")
    agrees = has & (F.col(current) == F.col("suggested"))
    status = (
        F.when((F.lower(F.trim(F.coalesce(F.col(confidence), F.lit("")))) == "manual_verified") & has, "manual_verified")
        .when(~offers, "unknown").when(agrees & (score >= 28), "trusted").when(~has & (score >= 32), "suggested_update")
        .when(has & (F.col(current) != F.col("suggested")) & (score >= 28), "conflict_review").when(score < 42, "low_confidence").otherwise("needs_review")
    )
    out = out.withColumns({"agrees": F.coalesce(agrees, F.lit(False)), "status": status})
    weight = F.create_map(*[F.lit(x) for pair in STATUS_WEIGHTS.items() for x in pair])[F.col("status")]
    gap = F.when(~has & offers, 12.0).when(has & offers & (F.col(current) != F.col("suggested")), 14.0).otherwise(0.0)
    impact = F.when(F.col(label) == "high", 18.0).when(F.col(label) == "low", 10.0).otherwise(4.0)
    return out.withColumn("priority", clamp(weight + gap + impact + F.coalesce(F.col(reward), F.lit(0.0)) * 0.12 + score * 0.18))


def distribution(df: DataFrame, reward: str, label: str) -> DataFrame:
    """Rows, mean reward and score, high and trusted rows of each suggested structure of ``evaluated`` rows."""
    return df.groupBy("suggested").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(reward), F.lit(0.0))).alias("avg_reward"), F.count_if(F.col(label) == "high").alias("high"), F.count_if(F.col("status").isin("trusted", "manual_verified")).alias("trusted"), F.avg("score").alias("avg_score"))


def coverage(df: DataFrame, current: str) -> DataFrame:
    """Shares of ``evaluated`` rows, one row: labelled, suggested, trusted, sure (52 on), in conflict, and agreeing where both are known."""
    has, offers = known(F.col(current)), known(F.col("suggested"))
    shares = {"labelled": has, "suggested": offers, "trusted": F.col("status").isin("trusted", "manual_verified"), "sure": F.col("score") >= 52, "conflict": F.col("status") == "conflict_review"}
    return df.agg(F.count("*").alias("n"), *[safe_ratio(F.count_if(c), F.count("*")).alias(name) for name, c in shares.items()], safe_ratio(F.count_if(has & offers & F.col("agrees")), F.count_if(has & offers)).alias("agreement"))


def issues(df: DataFrame) -> DataFrame:
    """Rows of each status and their share; the statuses are few, so their total is one row's work."""
    n = df.groupBy("status").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("__all")))).select("status", "n", safe_ratio(F.col("n"), F.col("__all")).alias("share"))
