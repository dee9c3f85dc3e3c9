"""Queries of ``operators.structures`` over the driver's tables, with their SQL; titles are put together of the rules' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import structures
from tidemark.plans.queries import query, r6
from tidemark.plans.tables import WORKS_SQL, works

#: Words that titles take one of by number, by three different divisors; blanks among them leave some without any.
_WORDS = ["一开口", "副歌 合唱", "Reaction", "金句", "没想到 导师", "故事", "清唱", "vlog 日常", "", "", "开头 第一句", "高音 爆发", "观众 全场 尖叫"]


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(column, words):
    return " + ".join(f"contains({column}, '{w}')::INT" for w in words) if words else "0"


def _scores():
    parts = []
    for place, (name, words, context, weight) in enumerate(structures.STRUCTURES):
        early = f" + CASE WHEN {_any('start', words)} > 0 THEN 10 ELSE 0 END" if name in structures.EARLY else ""
        payoff = f" + CASE WHEN {_any('low', context)} > 0 THEN 8 ELSE 0 END" if name == structures.PAYOFF else ""
        parts.append(f"SELECT doc_id, '{name}' AS structure, {place} AS place, least(100, {weight} + least(24, 8 * ({_any('low', words)})) + least(14, 7 * ({_any('low', context)})){early}{payoff})::DOUBLE AS score FROM t WHERE {_any('low', words)} > 0")
    return " UNION ALL ".join(parts)


_N = len(_WORDS)
_EVALUATED = f"""{WORKS_SQL}, t AS (SELECT *, lower(title) AS low, lower(left(title, 48)) AS start FROM (SELECT *, {_list(_WORDS)}[1 + doc_id % {_N}] || ' ' || left(coalesce(text, ''), 40) || ' ' || {_list(_WORDS)}[1 + doc_id // 7 % {_N}] AS title,
  CASE doc_id % 5 WHEN 0 THEN 'climax_first' WHEN 1 THEN 'linear' WHEN 2 THEN 'quote_first' ELSE 'unknown' END AS cur, CASE WHEN doc_id % 17 = 0 THEN 'manual_verified' ELSE 'low' END AS conf FROM works)),
c AS ({_scores()}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS second FROM c),
b AS (SELECT t.*, coalesce(structure, 'unknown') AS suggested, coalesce(CASE WHEN second IS NULL OR r.score - second >= 8 THEN r.score ELSE greatest(0, r.score - (8 - (r.score - second))) END, 0) AS score FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.r = 1),
e AS (SELECT *, cur <> 'unknown' AND cur = suggested AS agrees, CASE WHEN conf = 'manual_verified' AND cur <> 'unknown' THEN 'manual_verified' WHEN suggested = 'unknown' THEN 'unknown' WHEN cur = suggested AND score >= 28 THEN 'trusted' WHEN cur = 'unknown' AND score >= 32 THEN 'suggested_update'
  WHEN cur <> 'unknown' AND cur <> suggested AND score >= 28 THEN 'conflict_review' WHEN score < 42 THEN 'low_confidence' ELSE 'needs_review' END AS status FROM b)"""
_WEIGHT = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in structures.STATUS_WEIGHTS.items()) + " END"


def _evaluated(spark, d):
    i, words = F.col("doc_id"), F.array(*[F.lit(w) for w in _WORDS])
    pick = lambda n: F.get(words, (n % _N).cast("int"))
    title = F.concat_ws(" ", pick(i), F.substring(F.coalesce("text", F.lit("")), 1, 40), pick(F.floor(i / 7)))
    current = F.when(i % 5 == 0, "climax_first").when(i % 5 == 1, "linear").when(i % 5 == 2, "quote_first").otherwise("unknown")
    w = works(spark, d).select("doc_id", "reward", "label", title.alias("title"), current.alias("cur"), F.when(i % 17 == 0, "manual_verified").otherwise("low").alias("conf"))
    return structures.evaluated(w, "title", "cur", "conf", "reward", "label")


@query(f"""WITH {_EVALUATED} SELECT doc_id, suggested, score, agrees, status, round(least(100, greatest(0, {_WEIGHT} + CASE WHEN cur = 'unknown' AND suggested <> 'unknown' THEN 12 WHEN cur <> 'unknown' AND suggested <> 'unknown' AND cur <> suggested THEN 14 ELSE 0 END
  + CASE label WHEN 'high' THEN 18 WHEN 'low' THEN 10 ELSE 4 END + coalesce(reward, 0) * 0.12 + score * 0.18)), 6) AS priority FROM e""")
def structure_evaluation(spark, d):
    return _evaluated(spark, d).select("doc_id", "suggested", "score", "agrees", "status", r6("priority", "priority"))


@query(f"""WITH {_EVALUATED} SELECT suggested, count(*) AS n, round(avg(coalesce(reward, 0)), 6) AS avg_reward, count(*) FILTER (label = 'high') AS high, count(*) FILTER (status IN ('trusted', 'manual_verified')) AS trusted, round(avg(score), 6) AS avg_score FROM e GROUP BY ALL""")
def structure_distribution(spark, d):
    return structures.distribution(_evaluated(spark, d), "reward", "label").select("suggested", "n", r6("avg_reward", "avg_reward"), "high", "trusted", r6("avg_score", "avg_score"))


@query(f"""WITH {_EVALUATED} SELECT count(*) AS n, round(count(*) FILTER (cur <> 'unknown') / count(*), 6) AS labelled, round(count(*) FILTER (suggested <> 'unknown') / count(*), 6) AS suggested, round(count(*) FILTER (status IN ('trusted', 'manual_verified')) / count(*), 6) AS trusted,
  round(count(*) FILTER (score >= 52) / count(*), 6) AS sure, round(count(*) FILTER (status = 'conflict_review') / count(*), 6) AS conflict, round(count(*) FILTER (agrees) / count(*) FILTER (cur <> 'unknown' AND suggested <> 'unknown'), 6) AS agreement FROM e""")
def structure_coverage(spark, d):
    c = structures.coverage(_evaluated(spark, d), "cur")
    return c.select("n", *[r6(x, x) for x in c.columns[1:]])


@query(f"WITH {_EVALUATED} SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM e GROUP BY ALL")
def structure_issues(spark, d):
    return structures.issues(_evaluated(spark, d)).select("status", "n", r6("share", "share"))
