"""What is to be reviewed, corrected or collected next: contracts, queues, priorities, reports of quality."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemark.functions.numbers import clamp, safe_ratio

#: Names under which a review status goes, and from where on risks block or need a review.
STATUS_ALIASES = {"needs_review": "review", "need_review": "review", "corrected": "review", "ready": "approved", "rejected": "blocked"}
STATUSES = ("candidate", "review", "approved", "blocked", "exported")
BLOCKING_RIGHTS, REVIEW_RIGHTS = 80, 50
BLOCKING_ORIGINALITY, REVIEW_ORIGINALITY = 80, 45
#: A count before a title, with and without a mark that says so.
_PREFIX_COUNT = r"^(?:共创|热点)\s+(\d+(?:\.\d+)?(?:万|亿)?)\s+(.+)$"
_LEADING_COUNT = r"^(\d+(?:\.\d+)?(?:万|亿)?)\s+(.+)$"


def _zero(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


def _text(col: Column) -> Column:
    return F.trim(F.coalesce(col.cast("string"), F.lit("")))


def review_status(value: Column) -> Column:
    """The status that a name stands for (review where none is given); null for names that are none."""
    name = F.lower(_text(F.coalesce(F.nullif(value, F.lit("")), F.lit("review"))))
    name = F.coalesce(F.create_map(*[F.lit(x) for pair in STATUS_ALIASES.items() for x in pair])[name], name)
    return F.when(name.isin(*STATUSES), name)


def review_contract(status: Column, rights: Column, originality: Column, exported: Column) -> Column:
    """A candidate's state: blocked before exported before approved before needs_review before candidate."""
    status, rights, originality = F.coalesce(F.nullif(status, F.lit("")), F.lit("candidate")), _zero(rights), _zero(originality)
    return (
        F.when(status.isin("blocked", "rejected") | (rights >= BLOCKING_RIGHTS) | (originality >= BLOCKING_ORIGINALITY), "blocked")
        .when(exported, "exported")
        .when(status.isin("approved", "ready"), "approved")
        .when(status.isin("corrected", "review", "needs_review") | (rights >= REVIEW_RIGHTS) | (originality >= REVIEW_ORIGINALITY), "needs_review")
        .otherwise("candidate")
    )


def review_log(df: DataFrame, key: str, order: list[str], status: str, reason: str) -> DataFrame:
    """Review events that change something: those with the status and reason of the one before are left out; adds previous_status."""
    w = Window.partitionBy(key).orderBy(*order)
    said = F.struct(F.col(status), _text(F.col(reason)))
    before = F.lag(said).over(w)
    return df.withColumn("__same", F.coalesce(before == said, F.lit(False))).withColumn("previous_status", F.coalesce(F.lag(status).over(w), F.lit("candidate"))).where(~F.col("__same")).drop("__same")


def feedback_summary(df: DataFrame, key: str, reward: str, normalized: str, at: list[str], take: list[str]) -> DataFrame:
    """Rows, best rewards and the latest row of each candidate."""
    latest = F.max_by(F.struct(*take), F.struct(*at))
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.max(reward).alias("best_reward"), F.max(normalized).alias("best_normalized"), F.max(at[0]).alias("latest_at"), latest.alias("__l"))
    return g.select(key, "n", "best_reward", "best_normalized", "latest_at", *[F.col(f"__l.{c}").alias(f"latest_{c}") for c in take])


def _doubt(confidence: Column, low: float, medium: float) -> Column:
    c = F.lower(_text(confidence))
    return F.when(c.isin("", "low"), low).when(c == "medium", medium).otherwise(0.0)


def calibration_priority(reward: Column, raw_reward: Column, label: Column, needs: Column, confidence: Column) -> Column:
    """How much a sample's labels are worth correcting: reward, label, open needs and doubt, less without a raw reward."""
    impact = F.when(label == "high", 28.0).when(label == "low", 18.0).otherwise(0.0)
    score = F.least(F.lit(40.0), _zero(reward) * 0.35) + impact + F.least(F.lit(36), needs * 9) + _doubt(confidence, 12.0, 5.0)
    return clamp(score - F.when(_zero(raw_reward) <= 0, 12.0).otherwise(0.0))


def calibration_queue(df: DataFrame, reward: Column, label: Column, unknown: Column, needs: Column, confidence: Column) -> DataFrame:
    """Adds impact, risk and disagreement of a sample's labels, the queue that the strongest of them names, and its priority.

    ``unknown`` counts fields without a known value, ``needs`` the open needs. A low row goes by its risk where that is
    not exceeded; of equals disagreement goes before impact.
    """
    high, low, doubt = F.coalesce(label == "high", F.lit(False)), F.coalesce(label == "low", F.lit(False)), _doubt(confidence, 22.0, 10.0)
    disagreement = F.least(F.lit(100.0), unknown * 18.0 + needs * 8.0 + doubt) + F.when(high, F.least(F.lit(24.0), reward * 0.18)).when(low, 12.0).otherwise(0.0)
    risk = F.when(low, 64 + F.least(F.lit(24.0), (100 - reward) * 0.24) + unknown * 4.0).when(reward <= 25, 38 + unknown * 6.0).otherwise(0.0)
    impact = F.least(F.lit(100.0), reward * 0.55 + F.when(high, 30.0).otherwise(0.0) + doubt)
    out = df.withColumns({"impact": impact, "risk": risk, "disagreement": disagreement, "__low": low})
    by_risk = F.col("__low") & (F.col("risk") >= F.greatest("impact", "disagreement"))
    queue = F.when(by_risk, "risk").when(F.col("disagreement") >= F.greatest("impact", "risk"), "disagreement").otherwise("impact")
    out = out.withColumn("queue", queue)
    named = F.when(F.col("queue") == "risk", F.col("risk")).when(F.col("queue") == "disagreement", F.col("disagreement")).otherwise(F.col("impact"))
    return out.withColumn("priority", clamp(named)).drop("__low")


def collection_priority(label: Column, missing: Column, signal: Column, reward: Column) -> Column:
    """How much a sample's missing assets are worth collecting."""
    impact = F.when(label == "high", 36.0).when(label == "low", 32.0).otherwise(16.0)
    return clamp(impact + _zero(signal) * 0.25 + missing * 7.0 + _zero(reward) * 0.10)


def queue_summary(df: DataFrame, keys: list[str], score: str, duration: str, rights: str, originality: str) -> DataFrame:
    """Means, unscored rows and rows at risk of each queue."""
    at_risk = lambda c, bound: F.count_if(_zero(F.col(c)) >= bound)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(_zero(F.col(score))).alias("avg_score"), F.avg(_zero(F.col(duration))).alias("avg_duration"), F.count_if(F.col(score).isNull()).alias("unscored"),
        at_risk(rights, REVIEW_RIGHTS).alias("rights_risk"), at_risk(rights, BLOCKING_RIGHTS).alias("blocking_rights"), F.max(_zero(F.col(rights))).alias("max_rights"),
        at_risk(originality, REVIEW_ORIGINALITY).alias("originality_risk"), at_risk(originality, BLOCKING_ORIGINALITY).alias("blocking_originality"),
    )


def mix(df: DataFrame, keys: list[str], kind: str, k: int = 6) -> DataFrame:
    """The k most frequent kinds of each group: keys, kind, n, place."""
    counts = df.groupBy(*keys, F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "kind"))).where(F.col("place") <= k)


def health_score(segments: Column, noise: Column, ads: Column, candidates: Column, scored: Column, sponsor: Column, weak: Column, outliers: Column, top: Column, closed: Column, at_risk: Column) -> Column:
    """100 less penalties for a transcript and its queue; 79 at most where an issue is a risk."""
    few = lambda col, each, most: F.least(F.lit(most), col * each)
    penalties = [
        F.when(segments <= 0, 25).otherwise(0),
        few(noise, 2, 18),
        F.when(sponsor > 0, few(ads, 2, 16)).otherwise(F.least(F.lit(6), F.bround(ads * 0.25).cast("int"))),
        F.when(candidates <= 0, 20).when(scored <= 0, 16).otherwise(0),
        few(sponsor, 5, 18),
        few(weak, 3, 12),
        few(outliers, 3, 14),
        F.when((candidates > 0) & (scored < candidates), 12).otherwise(0),
        F.when((top > 0) & (closed <= F.greatest(F.lit(1), F.bround(top * 0.12).cast("int"))), 10).otherwise(0),
        F.when(at_risk, 4).otherwise(0),
    ]
    score = F.lit(100)
    for p in penalties:
        score -= p
    return F.greatest(F.lit(0), F.when(at_risk, F.least(F.lit(79), score)).otherwise(score)).cast("int")


def collection_report(df: DataFrame, keys: list[str], accepted: Column, item: str, metrics: list[str], play_missing: Column) -> DataFrame:
    """Quality of what was collected for each account: rows, accepted and different ones, duplicates, metrics known, score.

    Metrics and missing play counts are those of the different items, each by its row of the most known metrics.
    """
    known = [F.when(_zero(F.col(m)) > 0, 1).otherwise(0) for m in metrics]
    rows = df.select(*keys, accepted.alias("__ok"), F.col(item).alias("__item"), *[k.alias(f"__m{i}") for i, k in enumerate(known)], F.coalesce(play_missing, F.lit(True)).cast("int").alias("__play"))
    places = [f"__m{i}" for i in range(len(metrics))]
    total = sum((F.col(p) for p in places), F.lit(0))
    items = rows.groupBy(*keys, "__item").agg(F.count("*").alias("__raw"), F.count_if("__ok").alias("__acc"), F.max(F.when(F.col("__ok"), F.struct(total.alias("t"), *places, (1 - F.col("__play")).alias("p")))).alias("__b"))
    has = F.col("__b").isNotNull()
    g = items.groupBy(*keys).agg(
        F.sum("__raw").alias("raw"), F.sum("__acc").alias("accepted"), F.count_if(has).alias("items"),
        *[F.coalesce(F.sum(F.col(f"__b.{p}")), F.lit(0)).alias(f"known_{m}") for p, m in zip(places, metrics, strict=True)], F.coalesce(F.sum(1 - F.col("__b.p")), F.lit(0)).alias("play_missing"),
    )
    rejected, repeats, plays = F.col("raw") - F.col("accepted"), safe_ratio(F.col("accepted") - F.col("items"), F.col("accepted")), safe_ratio(F.col("play_missing"), F.col("items"))
    lacking = sum((1 - safe_ratio(F.col(f"known_{m}"), F.col("items")) for m in metrics), F.lit(0.0))
    score = F.lit(100) - F.when(rejected > 0, F.least(F.lit(30), 10 + rejected * 2)).otherwise(0) - F.when(repeats > 0.5, 25).when(repeats > 0.2, 10).otherwise(0)
    score = score - F.bround(lacking * 10).cast("int") - F.when((plays >= 0.95) & (F.col("items") > 0), 15).when(plays > 0.5, 8).otherwise(0)
    return g.withColumns({"duplicate_ratio": repeats, "play_missing_rate": plays, "score": F.greatest(F.lit(0), score)})


def author_mismatch(expected: dict[str, Column], found: dict[str, Column]) -> Column:
    """The first of sec_uid, user_id and nickname that both sides name differently, as a reason; blank where none does."""
    out = F.lit("")
    for name in ("nickname", "user_id", "sec_uid"):
        a, b = _text(expected[name]), _text(found[name])
        if name == "nickname":
            a, b = (F.lower(F.regexp_replace(x, r"\s+", "")) for x in (a, b))
        out = F.when((a != "") & (b != "") & (a != b), f"author_{name}_mismatch").otherwise(out)
    return out


def recovered_count(count: Column, title: Column) -> Column:
    """struct(count, title, flag): the count shown, else the one that the title begins with."""
    count, title = (F.trim(F.regexp_replace(_text(c), r"\s+", " ")) for c in (count, title))
    pack = lambda c, t, flag: F.struct(c.alias("count"), t.alias("title"), F.lit(flag).alias("flag"))
    part = lambda pattern, i: F.trim(F.regexp_extract(title, pattern, i))
    return (
        F.when(count != "", pack(count, title, ""))
        .when(title.rlike(_PREFIX_COUNT), pack(part(_PREFIX_COUNT, 1), part(_PREFIX_COUNT, 2), "count_recovered_from_prefix"))
        .when(title.rlike(_LEADING_COUNT), pack(part(_LEADING_COUNT, 1), part(_LEADING_COUNT, 2), "count_recovered_from_leading_text"))
        .otherwise(pack(F.lit(""), title, "missing_visible_count"))
    )


def readiness(df: DataFrame, label: str, assets: list[str]) -> DataFrame:
    """Share of rows that have each asset, for each label: label, asset, n, filled, share."""
    one = df.groupBy(F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("mid")).alias("label")).agg(F.count("*").alias("n"), *[F.count_if(F.col(a)).alias(a) for a in assets])
    return one.unpivot(["label", "n"], assets, "asset", "filled").withColumn("share", safe_ratio(F.col("filled"), F.col("n")))


def label_gaps(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean of each feature for high and for low rows, and how far they are apart: feature, high, low, gap."""
    means = df.agg(*[F.avg(F.when(F.col(label) == x, F.col(f))).alias(f"{x}__{i}") for i, f in enumerate(features) for x in ("high", "low")])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), _zero(F.col(f"high__{i}")).alias("high"), _zero(F.col(f"low__{i}")).alias("low")) for i, f in enumerate(features)]))
    return means.select(rows.alias("__r")).select("__r.*").withColumn("gap", F.col("high") - F.col("low"))


def assets_first(df: DataFrame, has_asset: Column, label: str, reward: str, key: str, limit: int) -> DataFrame:
    """A sample of ``limit`` rows: rows with assets first (high and low before others), the rest in turns of high, low and mid.

    Only rows that may be taken are ranked over all labels: the first ``limit`` of each label.
    """
    kind = F.when(F.col(label).isin("high", "low"), F.col(label)).otherwise("mid")
    best = [F.desc("__reward"), F.asc(key)]
    rows = df.withColumns({"__kind": kind, "__asset": F.coalesce(has_asset, F.lit(False)), "__reward": _zero(F.col(reward))})
    first = rows.where("__asset").orderBy(F.when(F.col("__kind") == "mid", 1).otherwise(0), *best).limit(limit)
    turn = F.when(F.col("__kind") == "high", 0).when(F.col("__kind") == "low", 1).otherwise(2)
    rest = rows.join(first.select(F.col(key).alias("__taken")), F.col(key) == F.col("__taken"), "left_anti")
    rest = rest.withColumn("__round", F.row_number().over(Window.partitionBy("__kind").orderBy(*best))).where(F.col("__round") <= limit)
    both = first.withColumn("__round", F.lit(0)).unionByName(rest)
    order = [F.asc("__round"), F.when(F.col("__round") == 0, F.when(F.col("__kind") == "mid", 1).otherwise(0)).otherwise(turn), *best]
    return both.orderBy(*order).limit(limit).drop("__kind", "__asset", "__reward", "__round")


@F.pandas_udf(BooleanType())
def _repeats(compact: pd.Series) -> pd.Series:
    """Whether a text without spaces repeats itself; pieces of a text are counted in one pass each."""

    def one(text: str) -> bool:
        if len(text) < 32:
            return False
        for n in (1, 2, 3, 4):
            parts = text if n == 1 else [text[i : i + n] for i in range(0, len(text) - n + 1, n)]
            most = max(Counter(parts).values())
            if n == 1 and most / len(text) >= 0.42 or most >= 8 and most / len(parts) >= 0.55:
                return True
        return False

    return compact.map(one)


def is_repetitive(text: Column) -> Column:
    """Of 32 characters or more, without spaces: one character makes up 42 %, or one piece of 1 to 4 characters 55 % of the pieces and stands 8 times."""
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    return _repeats(compact)
