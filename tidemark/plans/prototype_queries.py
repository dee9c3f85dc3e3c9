"""Queries of ``operators.prototypes`` over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.texts import token_list
from tidemark.operators import bank, prototypes
from tidemark.plans.queries import query, r6
from tidemark.plans.tables import WORKS_SQL, read, works

_SCORED = f"""{WORKS_SQL}, m AS (SELECT quantile_cont(reward, 0.5) AS med, quantile_cont(reward, 0.75) AS p75 FROM works WHERE reward > 0),
scored AS (SELECT works.*, least(100, greatest(0, 50 + 18 * log2(greatest(0.05, reward / greatest(1, med))) + CASE WHEN doc_id % 7 > 0 THEN least(10, (doc_id % 7) / 100 * 240) WHEN coalesce(views, 0) <= 0 THEN least(10, ln(1 + doc_id % 50) * 0.8) ELSE 0 END
  + CASE WHEN reward >= p75 THEN 4 ELSE 0 END)) AS score FROM works, m)"""


def _scored(spark, d):
    i = F.col("doc_id")
    return prototypes.scored(works(spark, d), "reward", (i % 7) / 100, (i % 50).cast("double"), F.col("views"))


@query(f"WITH {_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored")
def sample_scores(spark, d):
    return _scored(spark, d).select("doc_id", r6("score", "score"))


_GROUPS = f"""{_SCORED}, g AS (SELECT account, category, count(*) AS n, quantile_cont(reward, 0.5) AS median_value, quantile_cont(reward, 0.75) AS p75_value, max(reward) AS max_value, quantile_cont(views::DOUBLE, 0.75) AS p75_views, max(views) AS max_views, avg(score) AS avg_score FROM scored WHERE account IS NOT NULL AND category IS NOT NULL GROUP BY ALL),
t AS (SELECT *, least(0.95, 0.18 + least(0.45, n * 0.07) + least(0.25, ln(1 + greatest(0, median_value)) / 48) + least(0.2, greatest(0, avg_score - 45) / 220)) AS confidence FROM g)"""


@query(f"""WITH {_GROUPS} SELECT account, category, n, round(median_value, 6) AS median_value, round(p75_value, 6) AS p75_value, max_value, round(p75_views, 6) AS p75_views, max_views, round(avg_score, 6) AS avg_score, round(confidence, 6) AS confidence,
  CASE WHEN n < 3 AND max_views >= 100000 THEN 'potential_observation' WHEN n < 3 THEN 'thin_observation' WHEN p75_views >= 100000 AND confidence >= 0.75 THEN 'stable_high' WHEN p75_views >= 50000 AND confidence >= 0.7 THEN 'high_potential' WHEN p75_views >= 10000 THEN 'category_effective' ELSE 'weak_or_observe' END AS stability FROM t""")
def prototype_groups(spark, d):
    rows = _scored(spark, d).where("account IS NOT NULL AND category IS NOT NULL")
    g = prototypes.prototypes(rows, ["account", "category"], "reward", "views", "score")
    return g.select("account", "category", "n", r6("median_value", "median_value"), r6("p75_value", "p75_value"), "max_value", r6("p75_views", "p75_views"), "max_views", r6("avg_score", "avg_score"), r6("confidence", "confidence"), "stability")


@query(f"""WITH {_GROUPS}, a AS (SELECT account, quantile_cont(reward, 0.75) AS p FROM scored GROUP BY ALL) SELECT t.account, category,
  CASE WHEN n < 3 THEN 'thin_observation' WHEN p75_value / p >= 1.25 AND confidence >= 0.7 THEN 'stable_high_interaction' WHEN p75_value / p >= 1 AND confidence >= 0.65 THEN 'interaction_potential' WHEN p75_value / p >= 0.6 THEN 'interaction_observe' ELSE 'weak_or_observe' END AS tier FROM t JOIN a ON a.account = t.account""")
def interaction_tiers(spark, d):
    rows = _scored(spark, d)
    g = prototypes.prototypes(rows.where("account IS NOT NULL AND category IS NOT NULL"), ["account", "category"], "reward", "views", "score")
    a = prototypes.spread_percentiles(rows, ["account"], "reward", {"p": 0.75}).drop("n")
    tier = prototypes.interaction_stability(F.col("n"), F.col("p75_value") / F.col("p"), F.col("confidence"))
    return g.join(a, "account").select("account", "category", tier["tier"].alias("tier"))


@query(f"""WITH {_SCORED}, k AS (SELECT account, unnest(list_distinct(string_split(lower(coalesce(left(text, 200), '')), ' '))) AS keyword, 1 + score / 100 AS w FROM scored),
s AS (SELECT account, keyword, sum(w) AS weight FROM k GROUP BY ALL) SELECT account, keyword, round(weight, 6) AS weight, place FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY round(weight, 9) DESC, keyword) AS place FROM s) WHERE place <= 8""")
def prototype_keywords(spark, d):
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.substring("text", 1, 200), F.lit(""))), " "))  # a title is a work's first 200 characters
    return prototypes.weighted_keywords(_scored(spark, d).withColumn("words", words), ["account"], "words", "score").select("account", "keyword", r6("weight", "weight"), "place")


@query(f"""WITH {WORKS_SQL}, t AS (SELECT account, quantile_cont(reward, 0.6) AS hi, quantile_cont(reward, 0.4) AS lo FROM works GROUP BY ALL)
SELECT doc_id, CASE WHEN reward >= coalesce(hi, 60) THEN 'high' WHEN reward <= coalesce(lo, 40) THEN 'low' ELSE 'neutral' END AS match_type FROM works LEFT JOIN t USING (account)""")
def relative_matches(spark, d):
    return prototypes.match_types(works(spark, d).drop("text"), ["account"], "reward").select("doc_id", "match_type")


@query("""SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'top_decile' WHEN value / 100 >= 0.75 THEN 'top_quartile' WHEN value / 100 >= 0.5 THEN 'above_median' WHEN value / 100 >= 0.25 THEN 'below_median' ELSE 'low_quartile' END AS position,
  CASE WHEN user_id % 20 = 0 THEN 1.0 ELSE round(greatest(0, least(1, 1 - 0.55 * least(1, (user_id % 20) / 10) - 0.35 * (event_id % 5) / 5)), 6) END AS uncertainty,
  round(greatest(0, least(1, 0.25 * least(1, (user_id % 80) / 50) + 0.35 * (event_id % 5) / 5 + 0.15 * least(1, (event_id % 9) / 5) + 0.15 * CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.72 WHEN 2 THEN 0.62 ELSE 0.35 END + 0.1 * (event_id % 3) / 3)), 6) AS confidence FROM events""")
def history_trust(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    scope = F.when(i % 4 == 0, "account").when(i % 4 == 1, "global_fallback").when(i % 4 == 2, "global").otherwise("other")
    trust = prototypes.research_confidence(u % 80, i % 9, (i % 5) / 5, scope, (i % 3) / 3)
    return read(spark, d, "events").select("event_id", prototypes.position_label(F.col("value") / 100).alias("position"), r6(prototypes.history_uncertainty(u % 20, (i % 5) / 5), "uncertainty"), r6(trust, "confidence"))


_LONG = f"""{WORKS_SQL}, l AS (SELECT *, unnest([{{'dimension': 'account', 'name': account}}, {{'dimension': 'category', 'name': category}}, {{'dimension': 'day', 'name': (day(published))::VARCHAR}}, {{'dimension': 'tags', 'name': 't' || doc_id % 4}}, {{'dimension': 'tags', 'name': 'u' || doc_id % 9}}], recursive := true) FROM works)"""


def _long(spark, d):
    i = F.col("doc_id")
    w = works(spark, d).withColumn("day", F.dayofmonth("published")).withColumn("tags", F.array(F.concat(F.lit("t"), (i % 4).cast("string")), F.concat(F.lit("u"), (i % 9).cast("string"))))
    return prototypes.by_dimension(w, ["account", "category", "day"], ["tags"], ["doc_id", "reward", "views", "label"])


@query(f"""WITH {_LONG} SELECT dimension, name, count(*) AS n, round(avg(reward), 6) AS avg_reward, round(quantile_cont(reward, 0.5), 6) AS median_reward, round(quantile_cont(reward, 0.75), 6) AS p75_reward, round(avg(views), 6) AS avg_views, max(views) AS max_views,
  count(*) FILTER (label = 'high') AS high, count(*) FILTER (label = 'low') AS low, round(least(1, count(*) / 20), 6) AS confidence FROM l WHERE coalesce(name, '') <> '' GROUP BY ALL HAVING count(*) >= 2""")
def history_dimensions(spark, d):
    g = prototypes.dimension_baselines(_long(spark, d), "reward", "views", "label")
    return g.select("dimension", "name", "n", *[r6(c, c) for c in ("avg_reward", "median_reward", "p75_reward", "avg_views")], "max_views", "high", "low", r6("confidence", "confidence"))


@query(f"""WITH {_LONG} SELECT dimension, name, place, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY dimension, name ORDER BY reward DESC NULLS LAST, views DESC NULLS LAST, doc_id) AS place FROM l WHERE coalesce(name, '') <> '') WHERE place <= 3""")
def dimension_examples(spark, d):
    return prototypes.dimension_examples(_long(spark, d), [F.desc("reward"), F.desc("views"), F.asc("doc_id")], "doc_id")


@query("""WITH w AS (SELECT conv_id * 100000 + turn AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS t FROM conversations),
s AS (SELECT id, ('0x' || substr(sha256(t), 1, 8))::UBIGINT % 128 AS slot, sum(CASE WHEN ('0x' || substr(sha256(t), 9, 2))::UBIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + least(1.0::DOUBLE, length(t)::DOUBLE / 8))) AS w FROM w GROUP BY ALL)
SELECT id, slot::INT AS slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM s WHERE w <> 0""")
def hashed_text_vectors(spark, d):
    """Slots of whole texts; the rows' Han characters would be tokens, too, but the table has none."""
    c = read(spark, d, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), token_list(F.col("text")).alias("tokens"))
    return prototypes.hashed_vectors(c, "id", "tokens")


_TOKEN_SQL = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')".replace("\\\\", "\\")


def _slots(name, source, key, text):
    return f"""{name}_w AS (SELECT {key} AS id, unnest({_TOKEN_SQL.format(text)}) AS t FROM {source}),
{name}_s AS (SELECT id, ('0x' || substr(sha256(t), 1, 8))::UBIGINT % 128 AS slot, sum(CASE WHEN ('0x' || substr(sha256(t), 9, 2))::UBIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (1 + least(1.0::DOUBLE, length(t)::DOUBLE / 8))) AS w FROM {name}_w GROUP BY ALL),
{name}_v AS (SELECT id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS w FROM {name}_s WHERE w <> 0), {name}_n AS (SELECT id, sqrt(sum(w * w)) AS n FROM {name}_v GROUP BY ALL)"""


_BANK = f"""{_SCORED}, r AS (SELECT *, left(coalesce(text, ''), 200) AS title, CASE WHEN duration <= 0 THEN 'unknown' WHEN duration < 25 THEN 'short' WHEN duration < 45 THEN 'medium' WHEN duration < 90 THEN 'long' ELSE 'extra_long' END AS bucket FROM scored WHERE account IS NOT NULL),
bg AS (SELECT account, coalesce(category, '') || '|' || bucket AS name, count(*) AS n, quantile_cont(reward, 0.5) AS median_value, quantile_cont(reward, 0.75) AS p75, quantile_cont(views::DOUBLE, 0.75) AS p75_views, max(reward) AS max_value, max(views) AS max_views, avg(score) AS avg_score FROM r GROUP BY ALL),
bc AS (SELECT *, least(0.95, 0.18 + least(0.45, n * 0.07) + least(0.25, ln(1 + greatest(0, median_value)) / 48) + least(0.2, greatest(0, avg_score - 45) / 220)) AS confidence FROM bg),
bk AS (SELECT account, name, keyword, row_number() OVER (PARTITION BY account, name ORDER BY round(w, 9) DESC, keyword) AS place FROM (SELECT account, name, keyword, sum(w) AS w FROM (SELECT account, coalesce(category, '') || '|' || bucket AS name, unnest(list_distinct(list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> ''))) AS keyword, 1 + score / 100 AS w FROM r) GROUP BY ALL)),
bw AS (SELECT account, name, list(keyword ORDER BY place) AS keywords FROM bk WHERE place <= 8 GROUP BY ALL),
be AS (SELECT account, name, string_agg(title, ' ' ORDER BY e) AS titles FROM (SELECT account, coalesce(category, '') || '|' || bucket AS name, title, row_number() OVER (PARTITION BY account, category, bucket ORDER BY score DESC, doc_id) AS e FROM r) WHERE e <= 3 GROUP BY ALL),
ba AS (SELECT account, quantile_cont(reward, 0.75) AS p FROM r GROUP BY ALL),
bs AS (SELECT bc.*, coalesce(keywords, []) AS keywords, titles, coalesce(p75 / nullif(p, 0), 0) AS lift, CASE WHEN n < 3 AND max_views >= 100000 THEN 1 WHEN n < 3 THEN 0 WHEN p75_views >= 100000 AND confidence >= 0.75 THEN 4 WHEN p75_views >= 50000 AND confidence >= 0.7 THEN 3 WHEN p75_views >= 10000 THEN 2 ELSE 1 END AS tier FROM bc LEFT JOIN bw USING (account, name) LEFT JOIN be USING (account, name) LEFT JOIN ba USING (account)),
bank AS (SELECT *, account || '#' || name AS id, array_to_string(keywords, ' ') || ' ' || titles AS said, row_number() OVER (PARTITION BY account ORDER BY n >= 3 DESC, tier DESC, lift DESC, avg_score * confidence DESC, n DESC, max_value DESC, name) AS place FROM bs)""".replace("\\\\", "\\")


def _bank(spark, d):
    from tidemark.functions.times import open_duration_bucket

    rows = _scored(spark, d).withColumns({"bucket": open_duration_bucket(F.col("duration")), "title": F.substring(F.coalesce("text", F.lit("")), 1, 200)})
    return bank.prototype_bank(rows, "account", ["category", "bucket"], "reward", "views", "score", "title", [F.desc("score"), F.asc("doc_id")])


@query(f"""WITH {_BANK} SELECT account, name, n, round(avg_score, 6) AS avg_score, round(confidence, 6) AS confidence, round(lift, 6) AS lift, keywords, place FROM bank""")
def prototype_bank(spark, d):
    return _bank(spark, d).select("account", "name", "n", *[r6(c, c) for c in ("avg_score", "confidence", "lift")], "keywords", "place")


@query(f"""WITH {_BANK}, ask AS (SELECT item_id, 'src' || item_id % 20 AS account, coalesce(text, '') AS text FROM benchmark), {_slots('b', 'bank', 'id', 'said')}, {_slots('t', 'ask', 'item_id', 'text')},
dots AS (SELECT t_v.id AS item_id, b_v.id AS proto, sum(t_v.w * b_v.w) AS dot FROM t_v JOIN ask ON ask.item_id = t_v.id JOIN bank ON bank.account = ask.account JOIN b_v ON b_v.id = bank.id AND b_v.slot = t_v.slot GROUP BY ALL),
fit AS (SELECT ask.item_id, bank.name, greatest(0, least(1, coalesce(dot / (t_n.n * b_n.n), 0))) AS similarity, CASE WHEN text = '' OR len(keywords) = 0 THEN 0 ELSE least(1, len(list_filter(keywords[:10], lambda k: contains(lower(text), lower(k)))) / greatest(3, least(10, len(keywords)))) END AS overlap, avg_score * (0.65::DOUBLE + 0.35::DOUBLE * confidence) AS worth
  FROM ask JOIN bank USING (account) LEFT JOIN dots ON dots.item_id = ask.item_id AND dots.proto = bank.id LEFT JOIN t_n ON t_n.id = ask.item_id LEFT JOIN b_n ON b_n.id = bank.id)
SELECT item_id, rank, name, round(similarity, 5) AS similarity, round(overlap, 5) AS overlap, round(greatest(similarity, overlap) * worth, 4) AS fit FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(greatest(similarity, overlap) * worth, 9) DESC, name) AS rank FROM fit) WHERE rank <= 5""")
def prototype_fits(spark, d):
    asked = read(spark, d, "benchmark").withColumn("account", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    fits = bank.prototype_fits(asked, _bank(spark, d), "item_id", "account", "text")
    return fits.select("item_id", "rank", "name", F.round("similarity", 5).alias("similarity"), F.round("overlap", 5).alias("overlap"), F.round("fit", 4).alias("fit"))
