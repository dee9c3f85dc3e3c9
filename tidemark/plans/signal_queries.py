"""Queries of ``operators.signals`` over the works, with their SQL.

Stand-ins: a page of the same number plays the video, a vector the picture, a conversation the sound, its assistant's turns
the transcript, a table in the page the written text; words of the texts' languages play cues.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import signals
from tidemark.plans.queries import query, r6
from tidemark.plans.tables import WORKS_SQL, read, works

CUES = {"visual": ["eaux", "thble", "mentre"], "audio": ["ondre", "erin", "ouai", "ungen"], "speech": ["this", "pour", "that"], "overlay": ["from", "avec"], "risk": ["ouble", "lyes", "tionti"]}
DOMAIN, EXCLUDED = ["with", "dans", "nicht"], ["worthless", "ndwhst"]

_score = lambda *words: "least(100, 16 * (" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + "))::DOUBLE"
_pts = lambda flag, n: f"CASE WHEN {flag} THEN {n} ELSE 0.0::DOUBLE END"
_SIGNALS = f"""{WORKS_SQL}, j AS (SELECT w.*, lower(coalesce(text, '')) AS low, p.page_id IS NOT NULL AS video, e.vec_id IS NOT NULL AS visual, c.conv_id IS NOT NULL AS audio, coalesce(c.said, false) AS transcript, coalesce(contains(p.html, '<table'), false) AS ocr, e.vis, c.aud
  FROM works w LEFT JOIN pages p ON p.page_id = w.doc_id LEFT JOIN (SELECT vec_id, CASE WHEN embedding[1] IS NOT NULL THEN least(100, greatest(0, abs(embedding[1]::DOUBLE) * 100)) END AS vis FROM embeddings) e ON e.vec_id = w.doc_id
  LEFT JOIN (SELECT conv_id, bool_or(role = 'assistant') AS said, least(100, sum(length(coalesce(text, ''))) % 101)::DOUBLE AS aud FROM conversations GROUP BY conv_id) c ON c.conv_id = w.doc_id),
a AS (SELECT *, transcript OR ocr AS speech_or_text, {_score(*CUES['visual'])} AS vw, {_score(*CUES['audio'])} AS aw, {_score(*CUES['speech'])} AS sw, {_score(*CUES['overlay'])} AS ow, {_score(*CUES['risk'])} AS risk_penalty,
  {_score(*CUES['audio'], *CUES['visual'], *CUES['speech'])} AS cw, CASE WHEN doc_id % 5 < 3 THEN 10.0::DOUBLE ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 8 END + CASE doc_id % 4 WHEN 0 THEN 12.0::DOUBLE WHEN 1 THEN 5 WHEN 2 THEN 5 ELSE 0 END AS known FROM j),
s AS (SELECT *, least(100, greatest(0, 38.0::DOUBLE + known + least(12.0::DOUBLE, cw * 0.4::DOUBLE) - least(18.0::DOUBLE, risk_penalty * 0.8::DOUBLE))) AS semantic, least(100, vw + {_pts('visual', 18.0)}) AS visual_moment, least(100, aw + {_pts('audio', 18.0)}) AS audio_moment,
  least(100, sw + {_pts('transcript', 12.0)}) AS speech_context, least(100, ow + {_pts('ocr', 12.0)}) AS text_overlay, {_pts('video', 18.0)} + {_pts('visual', 12.0)} + {_pts('audio', 12.0)} + {_pts('speech_or_text', 8.0)} AS asset_bonus FROM a),
sig AS (SELECT *, least(100, greatest(0, 0.0::DOUBLE + semantic * 0.72::DOUBLE + visual_moment * 0.12::DOUBLE + audio_moment * 0.14::DOUBLE + speech_context * 0.08::DOUBLE + text_overlay * 0.05::DOUBLE + asset_bonus * 0.06::DOUBLE + risk_penalty * (-0.10)::DOUBLE)) AS combined FROM s)"""


def _signals(spark, d):
    i = F.col("doc_id")
    page = read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("video"), F.contains("html", F.lit("<table")).alias("ocr"))
    first = F.get("embedding", F.lit(0)).cast("double")
    picture = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("visual"), F.when(first.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.abs(first) * 100))).alias("vis"))
    said = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.lit(True).alias("audio"), F.bool_or(F.col("role") == "assistant").alias("transcript"), (F.sum(F.length(F.coalesce("text", F.lit("")))) % 101).cast("double").alias("aud"))
    w = works(spark, d).join(page, "doc_id", "left").join(picture, "doc_id", "left").join(said, "doc_id", "left")
    fields = {"category": F.when(i % 5 < 3, "music").otherwise("unknown"), "structure": F.when(i % 3 == 0, "None").otherwise("hook")}
    trust = F.get(F.array(*[F.lit(x) for x in ("manual_verified", "High", "medium", "low")]), (i % 4).cast("int"))
    return signals.asset_signals(w, F.col("text"), fields, trust, {a: F.col(a) for a in ("video", "visual", "audio", "transcript", "ocr")}, CUES)


@query(f"WITH {_SIGNALS} SELECT doc_id, round(semantic, 6) AS semantic, visual_moment, audio_moment, speech_context, text_overlay, asset_bonus, risk_penalty, round(combined, 6) AS combined FROM sig")
def asset_signals(spark, d):
    return _signals(spark, d).select("doc_id", r6("semantic", "semantic"), *signals.COMPONENTS, r6("combined", "combined"))


_ANY = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_PLAN = f"""{_SIGNALS}, o AS (SELECT *, CASE WHEN label IN ('high', 'low') THEN label ELSE 'mid' END AS kind, list_filter([CASE WHEN NOT video THEN 'video' END, CASE WHEN NOT visual THEN 'visual' END, CASE WHEN NOT audio THEN 'audio' END, CASE WHEN NOT speech_or_text THEN 'speech_or_text' END], lambda x: x IS NOT NULL) AS missing,
  greatest(visual_moment, audio_moment, speech_context, text_overlay, asset_bonus, risk_penalty) AS most FROM sig WHERE reward > 0 AND NOT {_ANY(EXCLUDED)} AND ({_ANY(DOMAIN)} OR doc_id % 7 = 0)),
q AS (SELECT *, least(100, greatest(0, CASE kind WHEN 'high' THEN 36.0::DOUBLE WHEN 'low' THEN 32.0::DOUBLE ELSE 16.0::DOUBLE END + most * 0.25::DOUBLE + len(missing) * 7.0::DOUBLE + (reward % 101) * 0.10::DOUBLE)) AS priority FROM o WHERE len(missing) > 0),
t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, doc_id) AS turn FROM q),
u AS (SELECT * FROM t ORDER BY turn, CASE kind WHEN 'high' THEN 0 WHEN 'low' THEN 1 ELSE 2 END LIMIT 120), plan AS (SELECT *, row_number() OVER (ORDER BY priority DESC, doc_id) AS place FROM u)"""


def _plan(spark, d):
    text = F.col("text")
    artist = F.when(F.col("doc_id") % 7 == 0, "someone").otherwise("unknown")
    nothing = F.lit("")
    rows = _signals(spark, d).where(signals.collectable(text, F.col("reward"), F.lit(None), artist, nothing, nothing, nothing, DOMAIN, EXCLUDED))
    return signals.collection_plan(rows.withColumn("reward", F.col("reward") % 101), "doc_id", "label", "reward", 120)


@query(f"WITH {_PLAN} SELECT doc_id, kind AS label, array_to_string(missing, ',') AS missing, round(priority, 6) AS priority, place FROM plan")
def collection_plan(spark, d):
    return _plan(spark, d).select("doc_id", "label", F.array_join("missing", ",").alias("missing"), r6("priority", "priority"), "place")


@query(f"""WITH {_PLAN}, e AS (SELECT 'label' AS kind, kind AS name FROM plan UNION ALL SELECT 'account', coalesce(nullif(account, ''), 'main') FROM plan UNION ALL SELECT 'missing', unnest(missing) FROM plan) SELECT kind, name, count(*) AS n FROM e GROUP BY ALL""")
def collection_summary(spark, d):
    return signals.plan_summary(_plan(spark, d), "label", "account")


@query(f"""WITH {_SIGNALS}, m AS (SELECT *, list_filter([CASE WHEN NOT video THEN 'video' END, CASE WHEN NOT visual THEN 'visual' END, CASE WHEN NOT audio THEN 'audio' END, CASE WHEN NOT speech_or_text THEN 'speech_or_text' END, CASE WHEN NOT ocr THEN 'ocr' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN video THEN 'video' END, CASE WHEN visual THEN 'visual' END, CASE WHEN audio THEN 'audio' END, CASE WHEN speech_or_text THEN 'speech_or_text' END, CASE WHEN ocr THEN 'ocr' END], lambda x: x IS NOT NULL) AS available,
  least(100, CASE label WHEN 'high' THEN 30.0::DOUBLE WHEN 'low' THEN 24.0::DOUBLE ELSE 12.0::DOUBLE END + greatest(visual_moment, audio_moment, speech_context) * 0.35::DOUBLE + (reward % 101) * 0.12::DOUBLE) AS priority FROM sig)
SELECT doc_id, array_to_string(missing, ',') AS missing, array_to_string(available, ',') AS available, round(priority, 6) AS priority FROM m WHERE len(missing) > 0 ORDER BY m.priority DESC, doc_id LIMIT 30""")
def asset_review_queue(spark, d):
    rows = signals.review_queue(_signals(spark, d).withColumn("reward", F.col("reward") % 101), "doc_id", "label", "reward")
    return rows.select("doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("available", ",").alias("available"), r6("priority", "priority"))


def _compared_sql(rows, strategies):
    """The same measures in SQL: a ranking of all rows for each strategy."""
    each = " UNION ALL ".join(f"SELECT '{name}' AS strategy, doc_id, label, reward, {score} AS score FROM {rows}" for name, score in strategies.items())
    first = next(iter(strategies))
    return f"""every AS ({each}), r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, doc_id) AS rn FROM every),
g AS (SELECT strategy, count(*) AS n, avg(reward) FILTER (rn <= 10) AS top_reward, avg(reward) AS mean, count(*) FILTER (rn <= 10 AND label = 'high') AS th, count(*) FILTER (rn <= 10 AND label = 'low') AS tl, count(*) FILTER (label = 'high') AS h, count(*) FILTER (label = 'low') AS l FROM r GROUP BY ALL),
f AS (SELECT strategy, n, top_reward, top_reward / greatest(1e-6, mean) AS lift, th / greatest(1, least(10, h)) AS high_rate, 1 - tl / greatest(1, least(10, l)) AS low_avoidance FROM g),
compared AS (SELECT *, lift - (SELECT lift FROM f WHERE strategy = '{first}') AS lift_delta FROM f)"""


_COMPONENTS_SQL = _compared_sql("sig", {"semantic": "semantic", "combined": "combined", **{c: f"100.0::DOUBLE - {c}" if c == "risk_penalty" else c for c in signals.COMPONENTS}})
_AUD, _VIS = "coalesce(aud, 50.0::DOUBLE)", "coalesce(vis, 50.0::DOUBLE)"
_MEASURED_SQL = "measured AS (SELECT * FROM sig WHERE audio OR visual), " + _compared_sql("measured", {
    "semantic": "semantic", "with_audio": f"least(100, 0.0::DOUBLE + semantic * 0.84::DOUBLE + {_AUD} * 0.16::DOUBLE)", "with_visual": f"least(100, 0.0::DOUBLE + semantic * 0.84::DOUBLE + {_VIS} * 0.16::DOUBLE)",
    "with_both": f"least(100, 0.0::DOUBLE + semantic * 0.72::DOUBLE + {_AUD} * 0.15::DOUBLE + {_VIS} * 0.13::DOUBLE)", "audio_only": _AUD, "visual_only": _VIS,
})
_SHOWN = "SELECT strategy, n, round(top_reward, 6) AS top_reward, round(lift, 6) AS lift, round(high_rate, 6) AS high_rate, round(low_avoidance, 6) AS low_avoidance, round(lift_delta, 6) AS lift_delta FROM compared"


def _shown(compared):
    return compared.select("strategy", "n", *[r6(c, c) for c in ("top_reward", "lift", "high_rate", "low_avoidance", "lift_delta")])


def _components(spark, d):
    return signals.compared_strategies(_signals(spark, d), signals.component_scores(), "label", "reward", "doc_id")


def _measured(spark, d):
    rows = _signals(spark, d).where("audio OR visual")
    return signals.compared_strategies(rows, signals.measured_scores(F.col("semantic"), F.col("aud"), F.col("vis")), "label", "reward", "doc_id")


@query(f"WITH {_SIGNALS}, {_COMPONENTS_SQL} {_SHOWN}")
def proxy_signals(spark, d):
    return _shown(_components(spark, d))


@query(f"WITH {_SIGNALS}, {_MEASURED_SQL} {_SHOWN}")
def measured_strategies(spark, d):
    return _shown(_measured(spark, d))


def _gate_sql(candidate, least, ready):
    delta = lambda c: f"coalesce(max({c}) FILTER (strategy = '{candidate}') - max({c}) FILTER (strategy = 'semantic'), 0)"
    return f"""gate AS (SELECT coalesce(max(n), 0) AS n, {delta('lift')} AS lift_delta, {delta('high_rate')} AS high_delta, {delta('low_avoidance')} AS low_delta, ({ready})::DOUBLE AS ready_rate FROM compared)
SELECT n, round(lift_delta, 6) AS lift_delta, round(high_delta, 6) AS high_delta, round(low_delta, 6) AS low_delta, round(ready_rate, 6) AS ready_rate,
  n >= {least} AND coalesce(ready_rate >= 0.7, true) AND lift_delta >= 0.02 AND high_delta >= -0.01 AND low_delta >= -0.01 AS passed,
  CASE WHEN n <= 0 THEN 'empty' WHEN n < {least} THEN 'expand' WHEN ready_rate < 0.7 THEN 'collect' WHEN lift_delta < 0.02 THEN 'research' ELSE 'go' END AS decision FROM gate"""


def _gate(gate):
    return gate.select("n", *[r6(c, c) for c in ("lift_delta", "high_delta", "low_delta", "ready_rate")], "passed", "decision")


@query(f"WITH {_SIGNALS}, {_COMPONENTS_SQL}, {_gate_sql('combined', 100, 'SELECT avg((video AND visual AND audio)::INT) FROM sig')}")
def validation_gate(spark, d):
    ready = _signals(spark, d).agg(F.avg((F.col("video") & F.col("visual") & F.col("audio")).cast("int")).alias("ready_rate"))
    return _gate(signals.signal_gate(_components(spark, d), "semantic", "combined", 100, ready))


@query(f"WITH {_SIGNALS}, {_MEASURED_SQL}, {_gate_sql('with_both', 60, 'NULL')}")
def feature_gate(spark, d):
    return _gate(signals.signal_gate(_measured(spark, d), "semantic", "with_both", 60))
