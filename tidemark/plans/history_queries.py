"""Queries of ``operators.history`` over the driver's tables, with their SQL; events stand for captured samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.plans.queries import query, r6
from tidemark.plans.tables import WORKS_SQL, read, works

_KIND = "CASE event_id % 7 WHEN 0 THEN 'mock_feed' WHEN 1 THEN 'api' ELSE 'clean' END"
_SAMPLES = f"""s AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_id::VARCHAR END AS item, CASE WHEN event_id % 3 = 0 THEN 'title:' || event_type WHEN event_id % 4 = 0 THEN 'title:' ELSE '' END AS sample_key,
  {_KIND} AS kind, CASE WHEN event_id % 2 = 0 THEN floor(value) ELSE 0 END::BIGINT AS views, (event_id % 11)::BIGINT AS likes,
  CASE event_id % 6 WHEN 0 THEN '{{"source": "Mock", "statistics": {{"play_count": 5}}}}' WHEN 1 THEN '{{"metric_availability": {{"views": false}}, "views": 7}}' WHEN 2 THEN '{{"metrics": {{"views": 9}}, "play_count": " "}}' WHEN 3 THEN '{{"metric_availability": {{"views": true}}}}' ELSE '{{}}' END AS raw FROM events)"""


def _samples(spark, d):
    e, i = read(spark, d, "events"), F.col("event_id")
    raw = F.when(i % 6 == 0, '{"source": "Mock", "statistics": {"play_count": 5}}').when(i % 6 == 1, '{"metric_availability": {"views": false}, "views": 7}').when(i % 6 == 2, '{"metrics": {"views": 9}, "play_count": " "}').when(i % 6 == 3, '{"metric_availability": {"views": true}}').otherwise("{}")
    return e.select("event_id", "user_id", "event_type", "value", F.when(i % 5 == 0, "").otherwise(i.cast("string")).alias("item"), F.when(i % 3 == 0, F.concat(F.lit("title:"), "event_type")).when(i % 4 == 0, "title:").otherwise("").alias("sample_key"),
                    F.when(i % 7 == 0, "mock_feed").when(i % 7 == 1, "api").otherwise("clean").alias("kind"), F.when(i % 2 == 0, F.floor("value")).otherwise(0).cast("long").alias("views"), (i % 11).alias("likes"), raw.alias("raw"))


_MOCK = "(kind LIKE '%mock%' OR lower(coalesce(json_extract_string(raw, '$.source'), '')) = 'mock')"


@query(f"""WITH {_SAMPLES} SELECT event_id, item <> '' AND value > 50 AS research, item <> '' AND (value > 50 OR likes > 0) AS memory, {_MOCK} AS mock,
  CASE WHEN views > 0 THEN views >= 20 ELSE false END AS signal, CASE WHEN views > 0 THEN true ELSE likes > 0 END AS any_signal,
  NOT {_MOCK} AND (item <> '' OR (starts_with(sample_key, 'title:') AND length(sample_key) > 6)) AND likes > 0 AS trainable,
  CASE WHEN json_extract_string(raw, '$.metric_availability.views') IS NOT NULL THEN json_extract_string(raw, '$.metric_availability.views') = 'false' ELSE views <= 0 END AS play_missing FROM s""")
def sample_predicates(spark, d):
    s, c = _samples(spark, d), F.col
    mock = history.is_mock(c("kind"), c("raw"))
    return s.select("event_id", history.research_eligible(c("item"), c("value") - 50).alias("research"), history.research_eligible(c("item"), c("value") - 50, c("likes")).alias("memory"), mock.alias("mock"), history.prototype_signal(c("views"), 20, c("likes")).alias("signal"),
                    history.prototype_signal(c("views"), 0, c("likes")).alias("any_signal"), history.trainable(mock, c("item"), c("sample_key"), c("likes")).alias("trainable"), history.play_missing(c("views"), c("raw")).alias("play_missing"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'view' AND user_id = 7")
def dynamic_conjunction(spark, d):
    return history.conjunction(read(spark, d, "events"), {"event_type": "view", "user_id": 7, "props": None}).select("event_id", "user_id", "value")


@query("""SELECT user_id, count(*) AS rows, CASE WHEN count(*) >= 65 THEN 'account' ELSE 'global_fallback' END AS scope, CASE WHEN count(*) >= 65 THEN '' ELSE 'target_account_below_50_samples' END AS reason FROM events GROUP BY ALL""")
def account_fallback(spark, d):
    return history.account_scopes(read(spark, d, "events"), "user_id", 65)


@query(f"""WITH {_SAMPLES}, m AS (SELECT event_id, kind, CASE event_id % 6 WHEN 0 THEN '5' WHEN 1 THEN '7' WHEN 2 THEN '9' END AS value, CASE event_id % 6 WHEN 0 THEN 'raw_api.statistics.play_count' WHEN 1 THEN 'raw_api.views' WHEN 2 THEN 'raw_api.metrics.views' ELSE '' END AS source FROM s)
SELECT event_id, value, source, CASE WHEN source <> '' AND kind = 'clean' THEN 'mixed_raw_api_clean_json' WHEN source <> '' THEN 'raw_api' WHEN kind = 'clean' THEN 'clean_json' ELSE 'none' END AS combined FROM m""")
def metric_provenance(spark, d):
    found = history.first_metric(F.col("raw"), "raw_api", ["play_count", "views"])
    clean = F.when(F.col("kind") == "clean", "clean_json.views")
    return _samples(spark, d).select("event_id", found["value"].alias("value"), found["source"].alias("source"), history.metric_source(found["source"], clean).alias("combined"))


@query("""SELECT doc_id, coalesce(source, 'none') AS account, coalesce(quality, -1)::INT AS quality, coalesce(n_chars, 0) AS views FROM documents LEFT JOIN labels USING (doc_id)""")
def contract_projection(spark, d):
    df = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return history.contract(df, {"doc_id": (F.col("doc_id"), -1), "account": (F.col("source"), "none"), "quality": (F.col("quality"), -1), "views": (F.col("n_chars"), 0)})


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL) SELECT c_custkey, l.event_type, l.value FROM customer LEFT JOIN l ON user_id = c_custkey""")
def lookup_last_event(spark, d):
    e = read(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    return history.lookup_last(read(spark, d, "customer").select("c_custkey"), e, "c_custkey", "event_id", ["event_type", "value"])


@query("""SELECT source AS file, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1 AS row, doc_id IN (SELECT doc_id FROM labels) AS linked FROM documents""")
def import_rows(spark, d):
    docs = read(spark, d, "documents").select(F.col("source").alias("file"), "doc_id")
    return history.import_report(docs, "doc_id", ["file", "doc_id"], read(spark, d, "labels"), "doc_id").select("file", "doc_id", "row", "linked")


@query(f"""WITH {WORKS_SQL} SELECT * FROM (SELECT unnest([{{'field': 'label', 'missing': a}}, {{'field': 'text', 'missing': b}}, {{'field': 'duration', 'missing': c}}], recursive := true) FROM (SELECT count(*) FILTER (label IS NULL) AS a, count(*) FILTER (coalesce(text, '') = '') AS b, count(*) FILTER (NOT coalesce(duration, 0) > 0) AS c FROM works)) WHERE missing > 0""")
def missing_fields(spark, d):
    return history.missing_fields(works(spark, d), {"label": F.col("label").isNotNull(), "text": F.coalesce(F.col("text"), F.lit("")) != "", "duration": F.coalesce(F.col("duration"), F.lit(0.0)) > 0})


@query(f"""WITH {WORKS_SQL} SELECT doc_id, greatest(0, 100 - 9 * (row_number() OVER (PARTITION BY account ORDER BY reward DESC, doc_id) - 1) - 7 * (row_number() OVER (PARTITION BY category ORDER BY reward DESC, doc_id) - 1))::DOUBLE AS diversity FROM works""")
def queue_diversity(spark, d):
    return history.queue_diversity(works(spark, d).drop("text"), [F.desc("reward"), F.asc("doc_id")], "account", "category").select("doc_id", "diversity")


@query(f"""WITH {WORKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY duration DESC, doc_id) AS r FROM works)
SELECT account, count(*) AS n, round(avg(reward) FILTER (r <= 10), 6) AS top_reward, round(avg(reward) FILTER (r <= 10) / greatest(1e-6, avg(reward)), 6) AS lift, round(count(*) FILTER (r <= 10 AND label = 'high') / greatest(1, least(10, count(*) FILTER (label = 'high'))), 6) AS high_rate,
  round(1 - count(*) FILTER (r <= 10 AND label = 'low') / greatest(1, least(10, count(*) FILTER (label = 'low'))), 6) AS low_avoidance FROM k GROUP BY ALL""")
def validation_metrics(spark, d):
    t = history.top_shares(works(spark, d).drop("text"), "account", "label", [F.desc("duration"), F.asc("doc_id")], "reward")
    return t.select("account", "n", *[r6(c, c) for c in ("top_reward", "lift", "high_rate", "low_avoidance")])


@query(f"""WITH {WORKS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY reward DESC, doc_id) AS r FROM works) SELECT category, account, count(*) AS n FROM k WHERE r <= 20 GROUP BY ALL HAVING count(*) > 1""")
def repeated_in_top(spark, d):
    return history.repeated_in_top(works(spark, d).drop("text"), "category", "account", [F.desc("reward"), F.asc("doc_id")], 20)


@query(f"""WITH {WORKS_SQL}, l AS (SELECT *, 'all' AS cut FROM works UNION ALL SELECT *, label FROM works WHERE label IN ('high', 'low'))
SELECT account, cut, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY account, cut ORDER BY reward DESC, doc_id) AS rank FROM l) WHERE rank <= 8""")
def match_cuts(spark, d):
    return history.three_cuts(works(spark, d).drop("text"), "account", "label", [F.desc("reward"), F.asc("doc_id")], "doc_id")


@query(f"""WITH {WORKS_SQL}, t AS (SELECT * FROM works ORDER BY reward DESC, doc_id LIMIT 60), k AS (SELECT *, row_number() OVER (ORDER BY reward DESC, doc_id) AS base_rank, row_number() OVER (ORDER BY duration DESC, doc_id) AS new_rank FROM t) SELECT doc_id, base_rank, new_rank FROM k WHERE new_rank <= 20""")
def reranked_works(spark, d):
    return history.reranked(works(spark, d).drop("text"), [F.desc("reward"), F.asc("doc_id")], [F.desc("duration"), F.asc("doc_id")], 20).select("doc_id", "base_rank", "new_rank")


@query("""SELECT * FROM (SELECT o_orderpriority AS severity, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL) ORDER BY CASE severity WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, n DESC, severity, status LIMIT 9""")
def issues_by_severity(spark, d):
    g = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return g.orderBy(*history.by_severity(g, "severity", ["1-URGENT", "2-HIGH"], F.desc("n"), F.asc("severity"), F.asc("status"))).limit(9)


@query("""WITH u AS (SELECT l_partkey AS part, l_quantity AS fit FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT p_partkey, p_size FROM part UNION ALL SELECT l_partkey, 100 * l_discount FROM lineitem WHERE l_returnflag = 'A') SELECT part, round(max(fit), 6) AS fit, count(*) AS offers FROM u GROUP BY ALL""")
def best_fit_union(spark, d):
    li = read(spark, d, "lineitem")
    a, c = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("part"), y.alias("fit")) for x, y in (("R", F.col("l_quantity")), ("A", 100 * F.col("l_discount"))))
    b = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("fit"))
    return history.best_fit(["part"], "fit", a, b, c).select("part", r6("fit", "fit"), "offers")


@query(f"""WITH {WORKS_SQL} SELECT account, category, count(*) AS n, count(DISTINCT views) AS items, count(label) AS labelled, round(avg(reward), 6) AS mean, max(reward) AS best, round(count(label) / count(*), 6) AS coverage, count(*) > count(DISTINCT views) AS repeats FROM works GROUP BY ALL""")
def dataset_summary(spark, d):
    s = history.dataset_summary(works(spark, d).drop("text"), ["account", "category"], "views", "reward", "label")
    return s.select("account", "category", "n", "items", "labelled", r6("mean", "mean"), "best", r6("coverage", "coverage"), "repeats")


@query("""SELECT (SELECT count(*) FROM documents) AS works, (SELECT count(*) FROM events) AS samples, (SELECT count(*) FROM labels WHERE quality = 1) AS high, (SELECT count(*) FROM pages) AS pages""")
def dashboard_totals(spark, d):
    one = lambda t, n, c="true": read(spark, d, t).where(c).agg(F.count("*").alias(n))
    return one("documents", "works").crossJoin(one("events", "samples")).crossJoin(one("labels", "high", "quality = 1")).crossJoin(one("pages", "pages"))  # a row each


@query("""SELECT s_suppkey, coalesce(nullif(s_acctbal, 0), 1)::DOUBLE AS score FROM supplier ORDER BY coalesce(nullif(s_acctbal, 0), 1) DESC, s_suppkey LIMIT 15""")
def top_suggestions(spark, d):
    score = F.coalesce(F.nullif(F.col("s_acctbal"), F.lit(0.0)), F.lit(1.0))
    return read(spark, d, "supplier").select("s_suppkey", score.alias("score")).orderBy(F.desc("score"), "s_suppkey").limit(15)


@query(f"""WITH {_SAMPLES}, k AS (SELECT *, CASE WHEN item <> '' THEN 'item:' || item WHEN length(sample_key) > 6 THEN sample_key ELSE 'id:' || event_id END AS identity FROM s)
SELECT identity, event_id, views FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY views DESC, value DESC, event_id DESC) AS r FROM k) WHERE r = 1""")
def identity_dedup(spark, d):
    from tidemark.operators import dedupe

    s = _samples(spark, d).withColumn("identity", history.identity(F.col("item"), F.col("sample_key"), F.col("event_id")))
    return dedupe.keep_best(s, ["identity"], [F.col("views"), F.col("value"), F.col("event_id")]).select("identity", "event_id", "views")


@query("""SELECT n_nationkey, r.id AS region_id FROM nation LEFT JOIN (SELECT lower(r_name) AS n, min(r_regionkey) AS id FROM region GROUP BY ALL) r ON lower(CASE n_regionkey WHEN 0 THEN 'africa' WHEN 1 THEN ' America ' ELSE n_name END) = r.n OR lower(trim(CASE n_regionkey WHEN 1 THEN ' America ' END)) = r.n""")
def lookup_by_name(spark, d):
    asked = F.when(F.col("n_regionkey") == 0, "africa").when(F.col("n_regionkey") == 1, " America ").otherwise(F.col("n_name"))
    return history.lookup_by_name(read(spark, d, "nation").select("n_nationkey", asked.alias("asked")), "asked", read(spark, d, "region"), "r_name", "r_regionkey", "region_id").select("n_nationkey", "region_id")


@query("""SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE o_orderstatus = 'F'""")
def lines_with_literal(spark, d):
    o, li = read(spark, d, "orders").where("o_orderstatus = 'F'"), read(spark, d, "lineitem")
    return o.join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_returnflag") == "R"), "left").select("o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT doc_id, quality, source FROM labels LEFT JOIN documents USING (doc_id) WHERE source = 'src1'""")
def labels_of_account(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id", "left").where("source = 'src1'").select("doc_id", "quality", "source")


@query(f"""WITH {WORKS_SQL}, g AS (SELECT account, category, count(*) AS n, round(stddev_pop(reward), 3) AS stability, round(max(reward) / avg(reward), 3) AS lift, round(avg(reward), 3) AS score, least(1, count(*) / 20) AS confidence, max(reward) AS best FROM works GROUP BY ALL)
SELECT account, category, n FROM g ORDER BY n >= 3 DESC, stability DESC, lift DESC, score * confidence DESC, n DESC, best DESC, account, category LIMIT 12""")
def ranked_prototypes(spark, d):
    g = works(spark, d).groupBy("account", "category").agg(F.count("*").alias("n"), F.round(F.stddev_pop("reward"), 3).alias("stability"), F.round(F.max("reward") / F.avg("reward"), 3).alias("lift"), F.round(F.avg("reward"), 3).alias("score"), F.max("reward").alias("best"))
    g = g.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 20))
    return g.orderBy(*history.prototype_order("n", "stability", "lift", "score", "confidence", "best"), "account", "category").limit(12).select("account", "category", "n")


@query(f"""WITH {_SAMPLES}, f AS (SELECT *, CASE WHEN item <> '' THEN 'item:' || (event_id % 400) WHEN starts_with(sample_key, 'title:') AND length(sample_key) > 6 THEN sample_key ELSE 'id:' || event_id END AS identity, CASE WHEN item <> '' THEN (event_id % 400)::VARCHAR ELSE '' END AS it, {_MOCK} AS mock FROM s),
b AS (SELECT user_id, identity, count(*) AS n, max(it) AS it, arg_max(mock, event_id) AS mock, arg_max(views > 0, event_id) AS kv, arg_max(likes > 0, event_id) AS kl, arg_max(value > 50, event_id) AS strong FROM f GROUP BY ALL),
g AS (SELECT user_id, sum(n)::BIGINT AS stored, count(*) AS different, count(*) FILTER (n > 1 AND it <> '') AS repeats, count(*) FILTER (NOT mock) AS formal, count(*) FILTER (NOT mock AND strong) AS strong, count(*) FILTER (NOT mock AND kv) AS known_views, count(*) FILTER (NOT mock AND kl) AS known_likes FROM b GROUP BY ALL)
SELECT *, CASE WHEN formal = 0 THEN 0 ELSE round(known_likes / formal, 6) END AS known_likes_rate FROM g""")
def scope_statistics(spark, d):
    c = F.col
    s = _samples(spark, d).withColumn("it", F.when(c("item") != "", (c("event_id") % 400).cast("string")).otherwise(""))
    g = history.scope_stats(s, ["user_id"], history.identity(c("it"), c("sample_key"), c("event_id")), "it", ["event_id"], {"mock": history.is_mock(c("kind"), c("raw")), "strong": c("value") > 50}, ["views", "likes"])
    return g.select("user_id", "stored", "different", "repeats", "formal", "strong", "known_views", "known_likes", r6("known_likes_rate", "known_likes_rate"))


_FIELDS = "[CASE WHEN event_id % 2 = 0 THEN 'hook_type' END, CASE WHEN event_id % 3 = 0 THEN 'artist_names' END, CASE WHEN event_id % 5 = 0 THEN 'slice_structure' END]"


@query(f"""WITH e AS (SELECT event_id, CASE WHEN user_id % 30 = 0 THEN 'unknown' ELSE (user_id % 30)::VARCHAR END AS account, event_id % 4 = 0 AS saved, {_FIELDS} AS fields FROM events),
f AS (SELECT name, count(*) AS n FROM (SELECT unnest(fields) AS name FROM e WHERE NOT saved) WHERE name IS NOT NULL GROUP BY ALL ORDER BY n DESC, name LIMIT 6), a AS (SELECT account AS name, count(*) AS n FROM e WHERE NOT saved GROUP BY ALL ORDER BY n DESC, name LIMIT 8)
SELECT 'rows' AS part, 'pending' AS name, count(*) FILTER (NOT saved) AS n FROM e UNION ALL SELECT 'rows', 'saved', count(*) FILTER (saved) FROM e UNION ALL SELECT 'fields', name, n FROM f UNION ALL SELECT 'accounts', name, n FROM a""")
def calibration_batch(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    fields = F.array_compact(F.array(F.when(i % 2 == 0, "hook_type"), F.when(i % 3 == 0, "artist_names"), F.when(i % 5 == 0, "slice_structure")))
    e = read(spark, d, "events").select("event_id", F.when(u % 30 > 0, u % 30).alias("account"), fields.alias("fields"))
    return history.batch_summary(e, i % 4 == 0, "account", "fields")


@query("""SELECT event_id, 'stored' AS origin, event_type || ' ' || ' ' || value AS text FROM events WHERE event_id % 3 = 0""")
def sample_sources(spark, d):
    """Captured metrics are missing, stored samples stand in, and files are not asked."""
    e = read(spark, d, "events").select("event_id", history.joined_text(F.col("event_type"), F.lit(None), F.col("value")).alias("text"))
    return history.first_filled(e.where("event_id < -1").withColumn("origin", F.lit("metrics")), e.where("event_id % 3 = 0").withColumn("origin", F.lit("stored")), e.withColumn("origin", F.lit("files"))).select("event_id", "origin", "text")


@query(f"""WITH {WORKS_SQL} SELECT doc_id, account, views FROM (SELECT *, row_number() OVER (PARTITION BY account, views // 50 ORDER BY reward DESC NULLS LAST, label IS NOT NULL DESC, published DESC, doc_id) AS r FROM works) WHERE r = 1""")
def prototype_samples(spark, d):
    from tidemark.operators import prototypes

    order = [F.desc("reward"), F.col("label").isNotNull().desc(), F.desc("published"), F.asc("doc_id")]
    return prototypes.best_samples(works(spark, d).drop("text").withColumn("cell", F.floor(F.col("views") / 50)), ["account", "cell"], order).select("doc_id", "account", "views")
