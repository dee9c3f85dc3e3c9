"""Weighted scores of clip candidates, and the staged simulation made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp

# ---- fixed values: weights of sub-scores ----
FINAL = {"short_video_hook": 0.16, "musical_moment": 0.14, "narrative_context": 0.12, "chorus_climax": 0.09, "lyric_resonance": 0.07, "performer_stage": 0.06, "audience_reaction": 0.08, "comment_trigger": 0.11, "song_recognition": 0.04, "novelty_arrangement": 0.06, "production_quality": 0.04, "history_match": 0.03, "rights_risk": -0.20, "low_originality": -0.12}
STAGES = {
    "cold_start": {"final": 0.28, "topic_clarity": 0.24, "song_recognition": 0.14, "novelty_arrangement": 0.14, "audience_breadth": 0.12, "history_prior": 0.08, "low_originality": -0.08},
    "first_pool": {"short_video_hook": 0.36, "musical_moment": 0.21, "chorus_climax": 0.13, "narrative_context": 0.11, "production_quality": 0.10, "duration": 0.09, "low_originality": -0.10},
    "expansion": {"first_pool": 0.23, "comment_trigger": 0.22, "audience_reaction": 0.17, "lyric_resonance": 0.13, "novelty_arrangement": 0.10, "final": 0.10, "song_recognition": 0.05, "low_originality": -0.09},
    "long_tail": {"lyric_resonance": 0.22, "song_recognition": 0.20, "narrative_context": 0.17, "history_prior": 0.15, "production_quality": 0.12, "final": 0.10, "topic_clarity": 0.04, "low_originality": -0.07},
}
SIMULATED = {"cold_start": 0.18, "first_pool": 0.26, "expansion": 0.20, "long_tail": 0.14, "risk": 0.16, "diversity": 0.06}
STAGE_LIMITS = [("risk", 60, "risk_limited"), ("first_pool", 58, "weak_first_round"), ("cold_start", 60, "narrow_cold_start"), ("expansion", 66, "small_pool"), ("long_tail", 64, "short_expansion")]
CLEARED = ["cleared", "approved", "licensed", "ok", "已授权", "通过"]
# ---- end of fixed values ----


def weighted(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    return clamp(sum((F.lit(w) * F.coalesce(parts[n].cast("double"), F.lit(0.0)) for n, w in weights.items()), F.lit(0.0)))


def final_score(parts: dict[str, Column]) -> Column:
    return weighted(FINAL, parts)


def duration_score(seconds: Column) -> Column:
    between = lambda a, b: (seconds >= a) & (seconds <= b)
    return F.when(between(22, 48), 92.0).when(between(18, 65), 78.0).when(between(12, 80), 62.0).otherwise(38.0)


def simulation(parts: dict[str, Column]) -> dict[str, Column]:
    """Stage scores, simulated score, bottleneck (the lowest stage, the first of equals) and predicted stage."""
    have = dict(parts)
    for name in ("cold_start", "first_pool", "expansion", "long_tail"):
        have[name] = weighted(STAGES[name], have)
    stages = {n: have[n] for n in SIMULATED}
    score = weighted(SIMULATED, stages)
    low = F.array_min(F.array(*[F.struct(F.coalesce(c.cast("double"), F.lit(0.0)).alias("s"), F.lit(i).alias("o"), F.lit(n).alias("n")) for i, (n, c) in enumerate(stages.items())]))
    stage = F.when(score >= 74, "high_potential").otherwise("steady")
    for name, limit, label in reversed(STAGE_LIMITS):
        stage = F.when(stages[name] < limit, label).otherwise(stage)
    return {**{n: stages[n] for n in ("cold_start", "first_pool", "expansion", "long_tail")}, "simulated_score": score, "bottleneck": low["n"], "predicted_stage": stage}


def rights_risk(statuses: list[Column], seconds: Column, allowed_seconds: Column, platforms: Column, platform: str) -> Column:
    """Risk 0..100 of a clip's rights: 100 without a record, and sums for statuses, length and platforms that don't fit."""
    recorded = F.lit(False)
    for s in statuses:
        recorded = recorded | s.isNotNull()
    open_ = F.lit(False)
    for s in statuses:
        open_ = open_ | ~F.lower(F.trim(F.coalesce(s, F.lit("")))).isin(CLEARED)
    p = F.lower(F.coalesce(platforms, F.lit("")))
    risk = F.when(open_, 70.0).otherwise(0.0) + F.when(seconds > allowed_seconds, 40.0).otherwise(0.0) + F.when((p != "") & ~F.contains(p, F.lit(platform)), 35.0).otherwise(0.0)
    return F.when(~recorded, 100.0).otherwise(F.least(F.lit(100.0), risk))
