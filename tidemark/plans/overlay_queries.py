"""Queries of ``operators.overlays`` over the vectors and the documents of the same number, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import overlays
from tidemark.plans.queries import query, r6
from tidemark.plans.tables import read

_BASE = """s AS (SELECT vec_id, CASE WHEN label = 9 THEN 'rare' ELSE 'a' || label % 3 END AS account, (n_chars % 101)::DOUBLE AS reward, list_transform(embedding, lambda x: x::DOUBLE) AS text, CASE WHEN vec_id % 4 <> 0 THEN list_transform(list_reverse(embedding), lambda x: x::DOUBLE) END AS visual, vec_id % 5 = 0 AS held FROM embeddings JOIN documents ON doc_id = vec_id),
train AS (SELECT * FROM s WHERE NOT held), q AS (SELECT quantile_cont(reward, 0.25) AS lo, quantile_cont(reward, 0.75) AS hi FROM train), sizes AS (SELECT account, count(*) AS n FROM train GROUP BY ALL),
lab AS (SELECT *, CASE WHEN reward >= hi THEN 'high' WHEN reward <= lo THEN 'low' ELSE 'mid' END AS l FROM train, q),
t AS (SELECT s.vec_id, s.text, s.visual, CASE WHEN n >= 50 THEN s.account END AS scope FROM s LEFT JOIN sizes USING (account) WHERE held)"""


def _matches(kind):
    return f"""{kind}_m AS (SELECT * FROM (SELECT t.vec_id AS target, CASE WHEN t.scope IS NULL THEN 'global_fallback' ELSE 'account' END AS scope, l, lab.vec_id AS sample, reward, round(list_cosine_similarity(t.{kind}, lab.{kind}), 9) AS sim,
  row_number() OVER (PARTITION BY t.vec_id, l ORDER BY round(list_cosine_similarity(t.{kind}, lab.{kind}), 9) DESC, CASE l WHEN 'low' THEN 100 - reward ELSE reward END DESC, lab.vec_id) AS rank FROM t JOIN lab ON (t.scope IS NULL OR lab.account = t.scope) AND t.vec_id <> lab.vec_id WHERE t.{kind} IS NOT NULL AND lab.{kind} IS NOT NULL AND round(list_cosine_similarity(t.{kind}, lab.{kind}), 9) > 0) WHERE rank <= 8)"""


def _scored(kind):
    return f"""{kind}_e AS (SELECT target, scope, coalesce(max(sim * reward / 100) FILTER (l = 'high'), 0) AS pos, coalesce(max(sim * (100 - reward) / 100) FILTER (l = 'low'), 0) AS risk, max(sim) AS best FROM {kind}_m GROUP BY ALL),
{kind}_s AS (SELECT *, least(100, greatest(0, 50 + pos * 3.2 - risk * 2.7 + greatest(0, quality - 0.48) * 2)) AS score FROM (SELECT *, greatest(best, pos * 0.75, risk * 0.65) AS quality FROM {kind}_e))"""


def _rows(spark, d):
    i = F.col("vec_id")
    e = read(spark, d, "embeddings").join(read(spark, d, "documents").select("doc_id", "n_chars"), F.col("doc_id") == i)
    account = F.when(F.col("label") == 9, "rare").otherwise(F.concat(F.lit("a"), (F.col("label") % 3).cast("string")))
    return e.select("vec_id", account.alias("account"), (F.col("n_chars") % 101).cast("double").alias("reward"), F.col("embedding").alias("text"), F.when(i % 4 != 0, F.reverse("embedding")).alias("visual"), (i % 5 == 0).alias("held"))


def _found(spark, d, kind):
    rows = _rows(spark, d)
    return overlays.overlay_matches(rows.where("held"), rows.where("NOT held"), "vec_id", "account", "reward", kind)[0]


@query(f"""WITH {_BASE}, {_matches('text')}, {_matches('visual')}, {_scored('text')}, {_scored('visual')},
o AS (SELECT t.vec_id AS target, coalesce(a.score, 50) AS text, coalesce(a.quality, 0) AS text_quality, coalesce(b.score, 50) AS visual, coalesce(b.quality, 0) AS visual_quality, coalesce(a.scope, b.scope, 'none') AS scope FROM t LEFT JOIN text_s a ON a.target = t.vec_id LEFT JOIN visual_s b ON b.target = t.vec_id)
SELECT target, scope, round(text, 5) AS text, round(text_quality, 5) AS text_quality, round(visual, 5) AS visual, round(visual_quality, 5) AS visual_quality, round(least(100, greatest(0, 50 + (text - 50) * 0.55 + (visual - 50) * 0.45)), 5) AS mix FROM o""")
def overlay_strategies(spark, d):
    base = F.lit(50.0)
    parts = {kind: overlays.overlay_scores(_found(spark, d, kind), base) for kind in ("text", "visual")}
    out = overlays.mixed_overlays(_rows(spark, d).where("held"), parts, "vec_id", base)
    return out.select("target", "scope", *[F.round(c, 5).alias(c) for c in ("text", "text_quality", "visual", "visual_quality", "mix")])


@query(f"""WITH {_BASE}, {_matches('text')} SELECT target, scope, l AS label, rank, sample, round(sim, 6) AS similarity FROM text_m WHERE rank <= 3 AND l <> 'mid'""")
def overlay_evidence(spark, d):
    m = _found(spark, d, "text").where((F.col("rank") <= overlays.SHOWN) & (F.col("l") != "mid"))
    return m.select("target", "scope", F.col("l").alias("label"), "rank", "sample", r6("similarity", "similarity"))


@query(f"""WITH {_BASE} SELECT account, l AS label, own, count(*) AS n, count(text) AS text_ready, count(visual) AS visual_ready, round(count(visual) / count(*), 4) AS visual_rate FROM (SELECT lab.*, sizes.n >= 50 AS own FROM lab JOIN sizes USING (account)) GROUP BY ALL""")
def overlay_context(spark, d):
    rows = overlays.overlay_context(_rows(spark, d).where("NOT held"), "account", "reward")
    return rows.groupBy("account", F.col("l").alias("label"), "own").agg(F.count("*").alias("n"), F.count("text").alias("text_ready"), F.count("visual").alias("visual_ready"), F.round(F.count("visual") / F.count("*"), 4).alias("visual_rate"))


@query("""SELECT count(*) AS n, count(embedding) AS embedding_ready, count(CASE WHEN label > 2 THEN label END) AS shot_ready, round(count(embedding) / count(*), 4) AS embedding_rate, round(count(CASE WHEN label > 2 THEN label END) / count(*), 4) AS shot_rate FROM embeddings""")
def vector_coverage(spark, d):
    return overlays.vector_coverage(read(spark, d, "embeddings").withColumn("shot", F.when(F.col("label") > 2, F.col("label"))), ["embedding", "shot"])
