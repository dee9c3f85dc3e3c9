"""Signals of assets, collection plans and compared strategies on small cases and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals

KIND = "id long, text string, category string, trust string, video boolean, visual boolean, audio boolean, transcript boolean, ocr boolean, label string, account string, reward double"


def prepared(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    flags = {a: F.col(a) for a in ("video", "visual", "audio", "transcript", "ocr")}
    return signals.asset_signals(df, F.col("text"), {"category": F.col("category")}, F.col("trust"), flags)


def test_signals_of_nulls_words_and_selling(spark):
    rows = [
        (1, None, None, None, None, None, None, None, None, None, None, None),
        (2, "高音副歌 REACTION 字幕", "music", "Manual_Verified", True, True, True, True, False, "high", "a", 50.0),
        (3, "直播下单优惠福利广告带货同款橱窗", "unknown", "low", False, False, False, False, True, "low", "a", 5.0),
    ]
    got = {r["id"]: r for r in prepared(spark, rows).collect()}
    assert [got[1][c] for c in ["semantic", *signals.COMPONENTS, "speech_or_text"]] == [38.0, 0, 0, 0, 0, 0, 0, False]
    assert got[1]["combined"] == pytest.approx(38 * 0.72)
    assert got[2]["semantic"] == 38 + 10 + 12 + 12  # three cue words are 48 points, of which 12 count at most
    assert [got[2][c] for c in signals.COMPONENTS] == [16 + 18, 32 + 18, 12, 16, 50, 0]
    assert got[3]["risk_penalty"] == 100 and got[3]["semantic"] == 38 - 18 and got[3]["speech_or_text"]


def test_only_works_of_the_field_that_were_seen_are_collected(spark):
    rows = [("唱歌", 1.0, 0.0, "", ""), ("唱歌", 0.0, None, "", ""), ("唱歌", None, 3.0, "", ""), ("唱歌 招生", 1.0, 0.0, "x", ""), ("other", 1.0, 0.0, "unknown", ""), ("other", 1.0, 0.0, "someone", ""), (None, 1.0, 0.0, None, "Live_Vocal"), (None, None, None, None, None)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<t string, reward double, seen double, artist string, category string>").select("i", "r.*")
    none = F.lit("")
    kept = df.where(signals.collectable(F.col("t"), F.col("reward"), F.col("seen"), F.col("artist"), none, F.col("category"), none))
    assert [r["i"] for r in kept.orderBy("i").collect()] == [0, 2, 5, 6]


def test_plan_takes_turns_and_counts_what_is_missing(spark):
    flags = lambda i: [i % 2 == 0, i % 3 == 0, i % 5 == 0, False, i % 7 == 0]
    rows = [(i, "高音" if i % 4 == 0 else "", "music", "", *flags(i), ["high", "low", None, "other"][min(i % 11, 3)], f"a{i % 2}" if i % 9 else None, float(i % 13)) for i in range(1, 400)]
    rows.append((0, "x", "music", "", True, True, True, True, True, "high", "a", 90.0))  # misses nothing
    p = prepared(spark, rows)
    plan = {r["id"]: r for r in signals.collection_plan(p, "id", "label", "reward", 50).collect()}
    by = {}
    for r in p.collect():
        missing = [a for a in ("video", "visual", "audio", "speech_or_text") if not r[a]]
        kind = r["label"] if r["label"] in ("high", "low") else "mid"
        priority = min(100, {"high": 36, "low": 32, "mid": 16}[kind] + max(r[c] for c in signals.COMPONENTS) * 0.25 + 7 * len(missing) + (r["reward"] or 0) * 0.1)
        if missing:
            by.setdefault(kind, []).append((-priority, r["id"], missing))
    taken, turn = [], 0
    for kind in by:
        by[kind].sort()
    while len(taken) < 50:
        for kind in ("high", "low", "mid"):
            if turn < len(by[kind]) and len(taken) < 50:
                taken.append((*by[kind][turn], kind))
        turn += 1
    taken.sort()
    assert [(plan[i]["place"], plan[i]["missing"], plan[i]["label"]) for _, i, _, _ in taken] == [(n, m, k) for n, (_, _, m, k) in enumerate(taken, 1)]
    assert len(plan) == 50
    summary = {(r["kind"], r["name"]): r["n"] for r in signals.plan_summary(signals.collection_plan(p, "id", "label", "reward", 50), "label", "account").collect()}
    assert sum(n for (k, _), n in summary.items() if k == "label") == sum(n for (k, _), n in summary.items() if k == "account") == 50
    assert summary["missing", "video"] == sum("video" in m for _, _, m, _ in taken)
    assert signals.collection_plan(p.limit(0), "id", "label", "reward", 50).count() == 0
    assert 0 not in {r["id"] for r in signals.review_queue(p, "id", "label", "reward", 1000).collect()}


def test_strategies_are_compared_in_one_pass(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["high", "low", "mid", None]), rng.uniform(0, 100), float(rng.randrange(20)), rng.choice([None, 10.0, 90.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, label string, reward double, a double, b double").repartition(7)
    strategies = {"a": F.col("a"), "b": F.col("b"), "worth": F.col("reward")}
    compared = signals.compared_strategies(df, strategies, "label", "reward", "id", 10)
    got = {r["strategy"]: r for r in compared.collect()}
    mean = sum(r[2] for r in rows) / len(rows)
    for name, at in (("a", 3), ("b", 4), ("worth", 2)):
        top = sorted(rows, key=lambda r: (-(r[at] or 0.0), r[0]))[:10]
        lift = sum(r[2] for r in top) / 10 / mean
        assert got[name]["lift"] == pytest.approx(lift) and got[name]["n"] == 500
        assert got[name]["high_rate"] == sum(r[1] == "high" for r in top) / 10
        assert got[name]["low_avoidance"] == pytest.approx(1 - sum(r[1] == "low" for r in top) / 10)
        assert got[name]["lift_delta"] == pytest.approx(lift - got["a"]["lift"])
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # partitions hand on k rows for each strategy, not all
    empty = signals.compared_strategies(df.limit(0), strategies, "label", "reward", "id", 10)
    assert empty.count() == 0
    decide = lambda c, least, ready=None: signals.signal_gate(c, "a", "worth", least, ready).collect()[0]["decision"]
    ready = lambda x: spark.createDataFrame([(x,)], "ready_rate double")
    assert [decide(empty, 1), decide(compared, 501), decide(compared, 500, ready(0.69)), decide(compared, 500, ready(None)), decide(compared, 500, ready(0.7)), decide(compared, 500)] == ["empty", "expand", "collect", "collect", "go", "go"]
    same = signals.compared_strategies(df, {"a": F.col("a"), "worth": F.col("a")}, "label", "reward", "id")
    assert decide(same, 1) == "research"


def test_unmeasured_sound_and_picture_count_fifty(spark):
    df = spark.createDataFrame([(1, 80.0, None, 20.0), (2, None, 100.0, None)], "id int, s double, a double, v double")
    rows = df.select("id", F.struct(*[c.alias(n) for n, c in signals.measured_scores(F.col("s"), F.col("a"), F.col("v")).items()]).alias("m"))
    got = {r["id"]: r["m"].asDict() for r in rows.collect()}
    assert got[1] == pytest.approx({"semantic": 80, "with_audio": 75.2, "with_visual": 70.4, "with_both": 67.7, "audio_only": 50, "visual_only": 20})
    assert got[2] == pytest.approx({"semantic": 0, "with_audio": 16, "with_visual": 8, "with_both": 21.5, "audio_only": 100, "visual_only": 50})
