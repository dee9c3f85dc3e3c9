"""What works say about their pictures, sound and speech, whether that ranks them better, and which assets to collect next.

Missing texts count as empty, missing flags as false and missing rewards as 0; of equals the smaller key goes first.
Empty tables give no rows, but for ``signal_gate``, which gives its one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, known
from tidemark.functions.texts import keyword_hits, keyword_score
from tidemark.operators.quality import collection_priority
from tidemark.operators.ranking import round_robin

#: Words that tell of a work's picture, sound, speech, written text and selling.
CUES = {
    "visual": ["封面", "表情", "全场", "观众", "尖叫", "掌声", "泪目", "舞台", "镜头", "reaction", "现场"],
    "audio": ["高音", "副歌", "合唱", "清唱", "转音", "爆发", "炸", "戏腔", "和声", "开口跪"],
    "speech": ["这句话", "金句", "点评", "为什么", "第一次", "没想到", "反转", "故事", "解释", "复盘"],
    "overlay": ["字幕", "歌词", "台词", "标题", "话题", "文案", "评论", "弹幕"],
    "risk": ["直播", "下单", "优惠", "福利", "广告", "带货", "同款", "橱窗"],
}
#: Words of the field and words outside of it, by which works are collected or not.
DOMAIN = ["歌", "音乐", "舞台", "副歌", "高音", "合唱", "清唱", "歌手", "唱", "乐队", "演唱", "声乐", "导师", "改编", "音色", "转音", "观众", "全场", "现场"]
EXCLUDED = ["招生", "志愿填报", "复读", "学费", "报名", "专业选择", "高考", "下单", "优惠", "团购", "福利"]
KINDS = ["music", "song", "stage", "performance", "vocal", "sing"]
#: Points of known fields, of trust, of present assets, and weights of the combined score.
BASE = 38.0
FIELDS = {"category": 10.0, "hook": 9.0, "structure": 8.0, "artist": 6.0, "song": 5.0, "entity": 5.0}
TRUST = {"manual_verified": 12.0, "high": 5.0, "medium": 5.0}
CUE_SHARE, CUE_MOST, RISK_SHARE, RISK_MOST = 0.4, 12.0, 0.8, 18.0
PRESENT = {"visual_moment": ("visual", 18.0), "audio_moment": ("audio", 18.0), "speech_context": ("transcript", 12.0), "text_overlay": ("ocr", 12.0)}
ASSET_POINTS = {"video": 18.0, "visual": 12.0, "audio": 12.0, "speech_or_text": 8.0}
COMBINED = {"semantic": 0.72, "visual_moment": 0.12, "audio_moment": 0.14, "speech_context": 0.08, "text_overlay": 0.05, "asset_bonus": 0.06, "risk_penalty": -0.10}
MEASURED = {
    "semantic": {"semantic": 1.0}, "with_audio": {"semantic": 0.84, "audio": 0.16}, "with_visual": {"semantic": 0.84, "visual": 0.16},
    "with_both": {"semantic": 0.72, "audio": 0.15, "visual": 0.13}, "audio_only": {"audio": 1.0}, "visual_only": {"visual": 1.0},
}
UNMEASURED = 50.0
#: Points of a label in the review queue and the shares of signal and reward; bounds of the gate.
REVIEW_POINTS, REVIEW_SIGNAL, REVIEW_REWARD = {"high": 30.0, "low": 24.0}, 0.35, 0.12
REVIEW_OTHER = 12.0
LEAST_LIFT, LEAST_RATE = 0.02, -0.01

COMPONENTS = ["visual_moment", "audio_moment", "speech_context", "text_overlay", "asset_bonus", "risk_penalty"]
ASSETS = ["video", "visual", "audio", "speech_or_text", "ocr"]


def _zero(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


def _weighted(weights: dict[str, float], value) -> Column:
    return clamp(sum((value(name) * w for name, w in weights.items()), F.lit(0.0)))


def _label(label: str) -> Column:
    return F.when(F.col(label).isin("high", "low"), F.col(label)).otherwise("mid")


def asset_signals(df: DataFrame, text: Column, fields: dict[str, Column], confidence: Column, assets: dict[str, Column], cues: dict[str, list[str]] = CUES) -> DataFrame:
    """Adds the assets as flags, ``semantic``, the components and ``combined``: scores 0..100 by words of the text, known fields and assets.

    ``assets`` has video, visual, audio, transcript and ocr; speech_or_text is either of the last two.
    """
    given = {name: F.coalesce(flag, F.lit(False)) for name, flag in assets.items()}
    given["speech_or_text"] = given["transcript"] | given["ocr"]
    rows = df.withColumns(given)
    points = lambda flag, n: F.when(F.col(flag), n).otherwise(0.0)
    words = lambda *kinds: keyword_score(text, list(dict.fromkeys(w for k in kinds for w in cues[k]))).cast("double")
    trusted = F.lower(F.coalesce(confidence, F.lit("")))
    semantic = BASE + sum((F.when(known(fields[name]), n).otherwise(0.0) for name, n in FIELDS.items() if name in fields), F.lit(0.0))
    semantic = semantic + F.coalesce(*[F.when(trusted == name, n) for name, n in TRUST.items()], F.lit(0.0))
    semantic = semantic + F.least(F.lit(CUE_MOST), words("audio", "visual", "speech") * CUE_SHARE) - F.least(F.lit(RISK_MOST), words("risk") * RISK_SHARE)
    kinds = dict(zip(PRESENT, ("visual", "audio", "speech", "overlay"), strict=True))
    rows = rows.withColumns({
        "semantic": clamp(semantic), **{name: clamp(words(kinds[name]) + points(*have)) for name, have in PRESENT.items()},
        "asset_bonus": sum((points(*have) for have in ASSET_POINTS.items()), F.lit(0.0)), "risk_penalty": words("risk"),
    })
    return rows.withColumn("combined", _weighted(COMBINED, F.col))


def collectable(text: Column, reward: Column, engagement: Column, artist: Column, song: Column, category: Column, hook: Column, domain: list[str] = DOMAIN, excluded: list[str] = EXCLUDED) -> Column:
    """Whether a work may be collected: it was seen, has no excluded word, and its words, artist, song, category or hook are of the field."""
    kinds = lambda c: keyword_hits(c, KINDS) > 0
    of_field = (keyword_hits(text, domain) > 0) | known(artist) | known(song) | kinds(category) | kinds(hook)
    return ((_zero(reward) > 0) | (_zero(engagement) > 0)) & (keyword_hits(text, excluded) == 0) & of_field


def _missing(assets: list[str]) -> Column:
    return F.filter(F.array(*[F.when(~F.col(a), F.lit(a)) for a in assets]), lambda a: a.isNotNull())


def collection_plan(df: DataFrame, key: str, label: str, reward: str, limit: int, assets: tuple[str, ...] = ("video", "visual", "audio", "speech_or_text"), ready: Column | None = None) -> DataFrame:
    """The works of ``asset_signals`` whose assets are collected next: ``limit`` of them, in turns of high, low and mid, then by priority.

    Adds label (mid for none), missing, priority and place.  ``ready`` leaves works out; without it those that miss nothing.
    """
    missing = _missing(list(assets))
    open_ = F.size(missing) > 0 if ready is None else ~F.coalesce(ready, F.lit(False))
    rows = df.where(open_).withColumns({label: _label(label), "missing": missing})
    rows = rows.withColumn("priority", collection_priority(F.col(label), F.size("missing"), F.greatest(*[F.col(c) for c in COMPONENTS]), F.col(reward)))
    best = [F.desc("priority"), F.asc(key)]
    chosen = round_robin(rows, label, ["high", "low", "mid"], best, limit).drop("turn")
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*best)))  # no more than limit rows


def plan_summary(plan: DataFrame, label: str, account: str) -> DataFrame:
    """How many works of a plan have each label, miss each asset and are of each account: kind, name, n."""
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    account_name = F.coalesce(F.nullif(F.col(account), F.lit("")), F.lit("main"))
    each = F.concat(F.array(one("label", F.col(label)), one("account", account_name)), F.transform("missing", lambda m: one("missing", m)))
    return plan.select(F.explode(each).alias("__e")).select("__e.*").groupBy("kind", "name").agg(F.count("*").alias("n"))


def review_queue(df: DataFrame, key: str, label: str, reward: str, limit: int = 30) -> DataFrame:
    """Works of ``asset_signals`` that miss an asset, those that tell most first: adds missing, available and priority."""
    impact = F.coalesce(*[F.when(F.col(label) == name, n) for name, n in REVIEW_POINTS.items()], F.lit(REVIEW_OTHER))
    signal = F.greatest("visual_moment", "audio_moment", "speech_context")
    rows = df.withColumns({"missing": _missing(ASSETS), "priority": clamp(impact + signal * REVIEW_SIGNAL + _zero(F.col(reward)) * REVIEW_REWARD)})
    rows = rows.where(F.size("missing") > 0).withColumn("available", F.array_except(F.array(*[F.lit(a) for a in ASSETS]), "missing"))
    return rows.orderBy(F.desc("priority"), F.asc(key)).limit(limit)


def measured_scores(semantic: Column, audio: Column, visual: Column) -> dict[str, Column]:
    """The six strategies over measured sound and picture; what was not measured counts 50."""
    given = {"semantic": _zero(semantic), "audio": F.coalesce(audio.cast("double"), F.lit(UNMEASURED)), "visual": F.coalesce(visual.cast("double"), F.lit(UNMEASURED))}
    return {name: _weighted(weights, given.__getitem__) for name, weights in MEASURED.items()}


def component_scores() -> dict[str, Column]:
    """The strategies over the columns of ``asset_signals``: semantic, combined and each component for itself, risk turned round."""
    alone = {c: 100.0 - F.col(c) if c == "risk_penalty" else F.col(c) for c in COMPONENTS}
    return {"semantic": F.col("semantic"), "combined": F.col("combined"), **alone}


def compared_strategies(df: DataFrame, strategies: dict[str, Column], label: str, reward: str, key: str, k: int = 10) -> DataFrame:
    """What the first k of each strategy are worth: strategy, n, top_reward, lift, high_rate, low_avoidance, lift_delta (to the first strategy).

    All strategies are scored in one pass.  Each partition hands on its first k for each strategy, and what all works
    have in common is one row of sums.
    """
    worth = _zero(F.col(reward))
    rows = df.select(F.col(key).alias("__key"), F.col(label).alias("__label"), worth.alias("__reward"), *[_zero(score).alias(name) for name, score in strategies.items()])
    total = rows.agg(F.count("*").alias("n"), F.avg("__reward").alias("__all"), *[F.count_if(F.col("__label") == x).alias(f"__{x}") for x in ("high", "low")])
    each = rows.unpivot(["__key", "__label", "__reward"], list(strategies), "strategy", "score")
    top = each.withColumn("__r", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("score"), F.asc("__key")))).where(F.col("__r") <= k)
    top = top.groupBy("strategy").agg(F.avg("__reward").alias("top_reward"), *[F.count_if(F.col("__label") == x).alias(f"__top_{x}") for x in ("high", "low")])
    both = top.crossJoin(F.broadcast(total))  # a row for each strategy and one row
    share = lambda x: F.col(f"__top_{x}") / F.greatest(F.lit(1), F.least(F.lit(k), F.col(f"__{x}")))
    out = both.select("strategy", "n", "top_reward", (F.col("top_reward") / F.greatest(F.lit(1e-6), F.col("__all"))).alias("lift"), share("high").alias("high_rate"), (1 - share("low")).alias("low_avoidance"))
    first = F.max(F.when(F.col("strategy") == next(iter(strategies)), F.col("lift"))).over(Window.partitionBy(F.lit(0)))  # a row for each strategy
    return out.withColumn("lift_delta", F.col("lift") - first)


def signal_gate(compared: DataFrame, baseline: str, candidate: str, least: int, ready: DataFrame | None = None, least_ready: float = 0.7) -> DataFrame:
    """Whether the candidate may go on to an experiment: one row with n, lift_delta, high_delta, low_delta, ready_rate, passed and decision.

    ``ready`` is one row with the share of works that have their assets (ready_rate); without it that is not asked.  The
    decision is the first of: empty, expand (fewer than ``least`` works), collect (too few ready), research (no lift), go.
    """
    of = lambda name, c: F.max(F.when(F.col("strategy") == name, F.col(c)))
    delta = lambda c: F.coalesce(of(candidate, c) - of(baseline, c), F.lit(0.0))
    one = compared.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), delta("lift").alias("lift_delta"), delta("high_rate").alias("high_delta"), delta("low_avoidance").alias("low_delta"))
    one = one.withColumn("ready_rate", F.lit(None).cast("double")) if ready is None else one.crossJoin(F.broadcast(ready.agg(_zero(F.max("ready_rate")).alias("ready_rate"))))  # one row each
    enough, covered, lifted = F.col("n") >= least, F.coalesce(F.col("ready_rate") >= least_ready, F.lit(True)), F.col("lift_delta") >= LEAST_LIFT
    decision = F.when(F.col("n") <= 0, "empty").when(~enough, "expand").when(~covered, "collect").when(~lifted, "research").otherwise("go")
    return one.withColumns({"passed": enough & covered & lifted & (F.col("high_delta") >= LEAST_RATE) & (F.col("low_delta") >= LEAST_RATE), "decision": decision})
