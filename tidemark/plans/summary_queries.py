"""Queries of ``operators.summaries``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.texts import keyword_hits
from tidemark.operators import quality, summaries
from tidemark.plans.queries import _SIMULATED_SQL, SQL, query, r6, simulated
from tidemark.plans.tables import read

ADS = ["ouble", "lyes", "tionti"]

_NAMED = f"""{_SIMULATED_SQL}, l AS (SELECT l_returnflag, score, CASE least(cold, pool, expa, tail, 100 - tx, pk) WHEN cold THEN 'cold_start' WHEN pool THEN 'first_pool' WHEN expa THEN 'expansion' WHEN tail THEN 'long_tail' WHEN 100 - tx THEN 'risk' ELSE 'diversity' END AS bottleneck,
  CASE WHEN 100 - tx < 60 THEN 'risk_limited' WHEN pool < 58 THEN 'weak_first_round' WHEN cold < 60 THEN 'narrow_cold_start' WHEN expa < 66 THEN 'small_pool' WHEN tail < 64 THEN 'short_expansion' WHEN score >= 74 THEN 'high_potential' ELSE 'steady' END AS stage FROM u),
b AS (SELECT l_returnflag, arg_max(bottleneck, n) AS top_bottleneck FROM (SELECT *, c * 100 - rank() OVER (PARTITION BY l_returnflag ORDER BY bottleneck) AS n FROM (SELECT l_returnflag, bottleneck, count(*) AS c FROM l GROUP BY ALL)) GROUP BY ALL),
s AS (SELECT l_returnflag, arg_max(stage, n) AS top_stage FROM (SELECT *, c * 100 - rank() OVER (PARTITION BY l_returnflag ORDER BY stage) AS n FROM (SELECT l_returnflag, stage, count(*) AS c FROM l GROUP BY ALL)) GROUP BY ALL)""".replace("s AS (SELECT l_returnflag", "st AS (SELECT l_returnflag")


@query(f"""WITH {_NAMED} SELECT l_returnflag, count(*) AS n, round(avg(score), 6) AS avg_score, count(*) FILTER (score >= 72) AS high_potential, any_value(top_bottleneck) AS top_bottleneck, any_value(top_stage) AS top_stage FROM l JOIN b USING (l_returnflag) JOIN st USING (l_returnflag) GROUP BY ALL""")
def simulation_summary(spark, d):
    li, s = simulated(spark, d)
    found = summaries.simulation_summary(li, s["simulated_score"], s["bottleneck"], s["predicted_stage"], ["l_returnflag"])
    return found.withColumn("avg_score", F.round("avg_score", 6))


@query(f"""WITH rep AS ({SQL['repetitive_turns']}), t AS (SELECT conv_id, turn, coalesce(text, '') AS text, repetitive, contains(lower(coalesce(text, '')), 'ouble') OR contains(lower(coalesce(text, '')), 'lyes') OR contains(lower(coalesce(text, '')), 'tionti') AS ad FROM conversations JOIN rep USING (conv_id, turn) WHERE length(text) >= 40)
SELECT c.conv_id, c.n AS n_raw, coalesce(p.n, 0) AS n_processed, round(coalesce(p.n, 0) / c.n, 6) AS compression, coalesce(n_noise, 0) AS n_noise, coalesce(n_ads, 0) AS n_ads, coalesce(a, '') AS noise, coalesce(b, '') AS ads
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL) c LEFT JOIN (SELECT conv_id, count(*) AS n, count(*) FILTER (repetitive) AS n_noise, count(*) FILTER (ad) AS n_ads,
  array_to_string((list(text ORDER BY turn, text) FILTER (repetitive))[1:3], '|') AS a, array_to_string((list(text ORDER BY turn, text) FILTER (ad))[1:3], '|') AS b FROM t GROUP BY ALL) p ON p.conv_id = c.conv_id""")
def transcript_summary(spark, d):
    text = F.coalesce("text", F.lit(""))
    said = F.when(F.col("turn") % 3 == 0, F.repeat(F.concat(F.lit("la "), (F.col("conv_id") % 7).cast("string")), 20)).when(F.col("turn") % 3 == 1, text).otherwise(F.concat(F.lit("hm" * 10), text))
    raw = read(spark, d, "conversations")
    found = summaries.transcript_summary(raw, raw.where(F.length("text") >= 40), "conv_id", "turn", "text", quality.is_repetitive(said), keyword_hits(F.col("text"), ADS) > 0)
    return found.select("conv_id", "n_raw", "n_processed", r6("compression", "compression"), "n_noise", "n_ads", F.array_join("sample_noise", "|").alias("noise"), F.array_join("sample_ads", "|").alias("ads"))
