"""Columns that turn counters into rates, rewards and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, ratio, safe_ratio

#: Weights of the reward, and the rate at which each part counts in full.
REWARD_WEIGHTS = {"play": 0.12, "five_second_retention": 0.22, "avg_watch_ratio": 0.20, "completion_rate": 0.16, "rewatch_rate": 0.08, "engagement": 0.12, "follow": 0.05, "comment": 0.05, "negative": -0.20, "rights": -0.25}
GOOD_RATE = {"play": 0.35, "engagement": 0.08, "favorite": 0.02, "share": 0.02, "comment": 0.02, "follow": 0.01, "negative": 0.02}


def _count(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).cast("long")


def feedback_rates() -> dict[str, Column]:
    """Rates of a metric row with the columns views, impressions, likes, comments, favorites, shares, follows, negative_feedback."""
    views = F.greatest(F.lit(1), _count("views"))
    acted = _count("likes") + _count("comments") + _count("favorites") + _count("shares")
    per_view = lambda n: F.round(clamp(n / views, 0.0, 1.0), 4)
    play = F.when(_count("impressions") > 0, F.greatest(F.lit(0), _count("views")) / _count("impressions")).otherwise(F.lit(0.0))
    watched = {c: F.round(ratio(F.col(c)), 4) for c in ("five_second_retention", "completion_rate", "avg_watch_ratio")}
    return {"play_conversion_rate": F.round(clamp(play, 0.0, 1.0), 4), **watched, "engagement_rate": per_view(acted), "follow_rate": per_view(_count("follows")), "negative_feedback_rate": per_view(_count("negative_feedback"))}


def reward_proxy(rights_risk: Column | None = None) -> Column:
    """Reward 0..100 of a metric row; see ``feedback_rates`` for the columns, plus rewatch_rate.

    A row without impressions has half a point for plays, as its views are never below one.
    """
    rates, full = feedback_rates(), lambda col, kind: clamp(ratio(col) / GOOD_RATE[kind], 0.0, 1.0)
    views = F.greatest(F.lit(1), _count("views"))
    parts = {
        "play": F.when(_count("impressions") <= 0, F.lit(0.5)).otherwise(full(rates["play_conversion_rate"], "play")),
        **{c: ratio(F.col(c)) for c in ("five_second_retention", "avg_watch_ratio", "completion_rate", "rewatch_rate")},
        "engagement": full(rates["engagement_rate"], "engagement"),
        "follow": full(rates["follow_rate"], "follow"),
        "comment": clamp(_count("comments") / views / GOOD_RATE["comment"], 0.0, 1.0),
        "negative": full(rates["negative_feedback_rate"], "negative"),
        "rights": clamp(F.coalesce(rights_risk, F.lit(0.0)) if rights_risk is not None else F.lit(0.0)) / 100,
    }
    total = sum((F.lit(w) * parts[name] for name, w in REWARD_WEIGHTS.items()), F.lit(0.0))
    return clamp(total * 100)


def engagement_reward(views: Column, likes: Column, comments: Column, favorites: Column, shares: Column, follows: Column) -> Column:
    """Open-ended reward of a captured work: logarithms of its counters, weighted."""
    weighted = ((views, 1.0), (likes, 0.35), (comments, 1.6), (favorites, 2.0), (shares, 2.2), (follows, 2.0))
    return sum((F.lit(w) * F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))) for c, w in weighted), F.lit(0.0))


def against_baseline(value: Column, median: Column, p75: Column, count: Column, impressions: Column) -> tuple[Column, Column]:
    """(normalised 0..100, uncertainty) of a value against its group's baseline; thin groups pass the value on."""
    thin = (count < 3) | (median <= 0)
    spread = F.greatest(F.lit(5.0), p75 - median)
    score = F.when(thin, clamp(value)).otherwise(clamp(50 + (value - median) / spread * 25))
    few = F.when(impressions < 300, F.lit(0.35)).otherwise(F.lit(0.0))
    unsure = F.when(thin, F.when(impressions >= 300, F.lit(0.35)).otherwise(F.lit(0.65)))
    return score, unsure.otherwise(clamp(F.least(F.lit(0.6), 1 / F.sqrt(F.greatest(F.lit(1), count))) + few, 0.0, 1.0))


def interaction_label(explicit: Column, value: Column, low: Column, high: Column) -> Column:
    """The label that a row carries, else by the quartiles of all rows."""
    given = F.lower(F.trim(F.coalesce(explicit, F.lit(""))))
    return F.when(given.isin("high", "mid", "low"), given).when(value >= high, "high").when(value <= low, "low").otherwise("mid")


def fixed_label(value: Column, high: float = 70.0, low: float = 30.0) -> Column:
    return F.when(value >= high, "high").when(value <= low, "low").otherwise("mid")


def gain(value: Column) -> Column:
    """Gain of a reward in discounted cumulative gain: 0..5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), value / 20))


def rate(hits: Column, total: Column) -> Column:
    return F.round(safe_ratio(hits, total), 4)
