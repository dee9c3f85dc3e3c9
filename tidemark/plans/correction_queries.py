"""Queries of ``operators.corrections`` over the driver's tables, with their SQL: each keeps its own change log below the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scores, texts
from tidemark.operators import corrections, syncing
from tidemark.operators.steps import shared_root
from tidemark.plans.queries import query, r6
from tidemark.plans.tables import read
from tidemark.sources.changelog import ChangeLog


def _log(spark, key, fields):
    return ChangeLog(spark, f"{shared_root(spark)}/log-{uuid.uuid4().hex}", key, fields)


def _runs(spark, runs, names):
    """One row for each run: run and its counts."""
    return spark.createDataFrame([(i, *[r.get(n, 0) for n in names]) for i, r in enumerate(runs)], ", ".join(["run int", *[f"{n} long" for n in names]]))


_PARTS = {"short_video_hook": 7, "musical_moment": 3, "narrative_context": 11, "production_quality": 13, "rights_risk": 5, "low_originality": 17}
_SCORE = "least(100, greatest(0, " + " + ".join(f"({scores.FINAL[n]}::DOUBLE) * (doc_id * {m} % 100)" for n, m in _PARTS.items()) + " + 0.08::DOUBLE * least(100, duration)))"
_SEGMENTS = f"""seg AS (SELECT doc_id, (doc_id % 50)::DOUBLE AS s, (doc_id % 50 + 10 + n_chars % 40)::DOUBLE AS e, (doc_id % 50 + 4)::DOUBLE AS cover, n_chars, lang FROM documents),
ask AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 = 0 THEN 95.0::DOUBLE WHEN toxic = 1 THEN (doc_id % 50 + 6)::DOUBLE END AS s2, CASE WHEN quality = 0 THEN 99.5::DOUBLE END AS e2 FROM labels WHERE toxic = 1 OR quality = 0 OR doc_id % 5 = 0),
ok AS (SELECT seg.doc_id, coalesce(s2, s) AS s, coalesce(e2, e) AS e, cover, toxic FROM seg JOIN ask USING (doc_id) WHERE coalesce(e2, e) > coalesce(s2, s) AND coalesce(e2, e) <= 100)"""


@query(f"""WITH {_SEGMENTS}, o AS (SELECT *, round(e - s, 3) AS duration FROM ok)
SELECT seg.doc_id, round(coalesce(o.s, seg.s), 3) AS start, round(coalesce(o.e, seg.e), 3) AS "end", round(CASE WHEN o.doc_id IS NULL OR o.cover BETWEEN o.s AND o.e THEN seg.cover ELSE round(o.s + o.duration * 0.45::DOUBLE, 3) END, 3) AS cover,
  CASE WHEN o.doc_id IS NULL THEN 'candidate' WHEN toxic = 1 THEN 'blocked' ELSE 'corrected' END AS status, coalesce(CASE WHEN toxic = 1 THEN 'checked' END, seg.lang) AS summary, o.score FROM seg LEFT JOIN (SELECT *, round({_SCORE}, 4) AS score FROM o) o USING (doc_id)""")
def segment_corrections(spark, d):
    i = F.col("doc_id")
    fields = {"doc_id": "long", "start": "double", "end": "double", "duration": "double", "cover": "double", "status": "string", "summary": "string", "score": "double"}
    log = _log(spark, "doc_id", fields)
    end = i % 50 + 10 + F.col("n_chars") % 40
    log.start(read(spark, d, "documents").select("doc_id", (i % 50).alias("start"), end.alias("end"), (end - i % 50).alias("duration"), (i % 50 + 4).alias("cover"), F.lit("candidate").alias("status"), F.col("lang").alias("summary"), F.lit(None).alias("score")))
    toxic, low = F.col("toxic") == 1, F.col("quality") == 0
    asked = read(spark, d, "labels").where(toxic | low | (i % 5 == 0))
    given = asked.select("doc_id", F.when(i % 5 == 0, 95.0).when(toxic, (i % 50 + 6).cast("double")).alias("start"), F.when(low, 99.5).alias("end"), F.lit(None).cast("double").alias("cover"), F.when(toxic, " blocked").otherwise("").alias("status"), F.when(toxic, "checked").alias("summary"), F.lit(100.0).alias("length"))
    parts = {n: (i * _PARTS[n] % 100) if n in _PARTS else F.lit(0.0) for n in scores.FINAL} | {"audience_reaction": F.least(F.lit(100.0), F.col("duration"))}
    for _ in range(2):  # a rerun changes nothing
        corrections.corrected_segments(log, given, "length", ["summary"], parts)
    return log.current().select("doc_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("cover", 3).alias("cover"), "status", "summary", "score")


@query("""WITH b AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'manual_verified' ELSE 'high' END AS confidence FROM labels), a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'medium' WHEN 2 THEN 'manual_verified' WHEN 3 THEN 'high' ELSE 'sure' END AS asked FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, b.confidence AS before, CASE WHEN asked = '' THEN 'low' ELSE asked END AS after FROM a JOIN b USING (doc_id) WHERE asked IN ('', 'medium', 'high') AND b.confidence <> asked""")
def reopened_calibrations(spark, d):
    i = F.col("doc_id")
    log = _log(spark, "doc_id", {"doc_id": "long", "confidence": "string"})
    log.start(read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "manual_verified").otherwise("high").alias("confidence")))
    level = F.element_at(F.array(*[F.lit(x) for x in ("", "medium", "manual_verified", "high", "sure")]), (i % 5 + 1).cast("int"))
    asked = read(spark, d, "documents").where(i % 2 == 0).select("doc_id", level.alias("confidence"))
    for _ in range(2):
        corrections.reopened(log, asked)
    return log.log().select("doc_id", F.col("before")["confidence"].alias("before"), F.col("after")["confidence"].alias("after"))


@query("""WITH b AS (SELECT p_partkey, p_name AS performer, p_size AS start, p_retailprice AS price FROM part), n AS (SELECT ps AS p_partkey, 'new ' || ps AS performer, 0 AS start FROM (SELECT max(p_partkey) + 1 + s_suppkey AS ps FROM part, supplier GROUP BY s_suppkey))
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(performer) ELSE performer END AS performer, CASE WHEN p_partkey % 3 = 0 THEN start + 1 ELSE start END AS start, round(price, 2) AS price FROM b WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey, performer, start, NULL FROM n""")
def performance_edits(spark, d):
    i = F.col("p_partkey")
    part = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("performer"), F.col("p_size").alias("start"), F.col("p_retailprice").alias("price"))
    log = _log(spark, "p_partkey", {"p_partkey": "long", "performer": "string", "start": "int", "price": "double"})
    log.start(part)
    top = part.agg(F.max(i).alias("top"))  # a single row
    new = read(spark, d, "supplier").crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.col("s_suppkey")).alias("p_partkey"), F.lit(0).alias("start"))
    edits = part.where(i % 3 == 0).select("p_partkey", F.upper("performer").alias("performer"), (F.col("start") + 1).alias("start"))
    for _ in range(2):
        log.merge(new.withColumn("performer", F.concat(F.lit("new "), i.cast("string"))), "insert")
        log.merge(edits, "update")
        log.delete(part.where(i % 10 == 0).select("p_partkey"))
    log.compact()
    return log.current().withColumn("price", F.round("price", 2))


@query("""FROM (VALUES (0), (1)) r(run), (SELECT count(*) FILTER (o_orderkey IS NOT NULL) AS linked, count(*) FILTER (o_orderkey IS NULL) AS unlinked FROM (SELECT event_id, (event_id * 7) % 20000 AS k FROM events) LEFT JOIN orders ON o_orderkey = k),
LATERAL (SELECT CASE WHEN run = 0 THEN linked ELSE 0 END AS created, CASE WHEN run = 0 THEN 0 ELSE linked END AS existing) SELECT run, created, existing, unlinked""")
def experiment_registry(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("experiment"), (F.col("event_id") * 7 % 20000).alias("variant"), F.col("event_type").alias("grouped"), F.lit("planned").alias("status"))
    log = _log(spark, "experiment", {"experiment": "long", "variant": "long", "grouped": "string", "status": "string"})
    runs = [corrections.linked_inserts(log, e, read(spark, d, "orders"), "variant", "o_orderkey") for _ in range(2)]
    return _runs(spark, runs, ["created", "existing", "unlinked"])


_BACKFILL = """b AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS low, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN quality = 1 THEN 'manual_verified' ELSE 'low' END AS confidence FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT *, CASE WHEN contains(low, 'mit') THEN 'mit' WHEN contains(low, 'com') THEN 'com' ELSE 'unknown' END AS category, (contains(low, 'license')::INT + contains(low, '555')::INT + contains(low, 'www')::INT) * 16 AS signal FROM b)"""


def _backfill_log(spark, d):
    log = _log(spark, "doc_id", {"doc_id": "long", "text": "string", "category": "string", "signal": "int", "version": "string", "confidence": "string"})
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    log.start(docs.select("doc_id", "text", F.col("lang").alias("category"), F.lit(0).alias("signal"), F.when(F.col("doc_id") % 3 == 0, "v2").otherwise("v1").alias("version"), F.when(F.col("quality") == 1, "manual_verified").otherwise("low").alias("confidence")))
    text = F.col("text")
    return log, {"category": F.when(texts.contains_any(text, ["mit"]), "mit").when(texts.contains_any(text, ["com"]), "com").otherwise("unknown"), "signal": texts.keyword_score(text, ["license", "555", "www"])}


@query(f"""WITH {_BACKFILL}, n AS (SELECT count(*) AS scanned, count(*) FILTER (version = 'v1') AS stale, count(*) FILTER (version = 'v2') AS current, count(*) FILTER (version = 'v2' AND (lang IS DISTINCT FROM category OR signal <> 0)) AS differ, count(*) FILTER (confidence = 'manual_verified') AS verified FROM c)
SELECT 0 AS run, scanned, stale AS updated, 0 AS unchanged, current AS skipped_current, verified AS manual_verified FROM n UNION ALL SELECT 1, scanned, 0, 0, scanned, verified FROM n UNION ALL SELECT 2, scanned, differ, scanned - differ, 0, verified FROM n""")
def semantic_backfill(spark, d):
    log, computed = _backfill_log(spark, d)
    runs = [corrections.backfilled(log, computed, "v2", force) for force in (False, False, True)]
    return _runs(spark, runs, ["scanned", "updated", "unchanged", "skipped_current", "manual_verified"])


@query(f"""WITH {_BACKFILL} SELECT doc_id, CASE WHEN version = 'v2' THEN lang ELSE category END AS category, CASE WHEN version = 'v2' THEN 0 ELSE signal END AS signal, 'v2' AS version FROM c""")
def backfilled_works(spark, d):
    log, computed = _backfill_log(spark, d)
    corrections.backfilled(log, computed, "v2")
    log.compact()
    return log.current().select("doc_id", "category", "signal", "version")


_BATCH = "least(2, day(ts) // 10)"
_LAST = "ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')"


@query(f"""WITH e AS (SELECT user_id, {_BATCH} AS batch, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN ' ' ELSE event_type END AS scope, value, ts, event_id FROM events),
b AS (SELECT user_id, batch, arg_max({{'scope': nullif(trim(scope), ''), 'value': value}}, {_LAST}) AS l FROM e GROUP BY ALL)
SELECT user_id, coalesce(arg_max(l.scope, batch) FILTER (l.scope IS NOT NULL), 'none') AS scope, round(arg_max(l.value, batch), 6) AS value, 'ready' AS status FROM b GROUP BY ALL""")
def account_registry(spark, d):
    log = _log(spark, "user_id", {"user_id": "long", "scope": "string", "value": "double", "status": "string"})
    i, batch = F.col("event_id"), F.least(F.lit(2), F.floor(F.dayofmonth("ts") / 10))
    e = read(spark, d, "events").select("user_id", F.when(i % 4 == 1, " ").when(i % 4 > 1, F.col("event_type")).alias("scope"), "value", F.struct("ts", "event_id").alias("o"), batch.alias("batch"))
    for b in range(3):
        rows = e.where(F.col("batch") == b)
        last = rows.groupBy("user_id").agg(F.max_by(F.struct("scope", "value"), "o").alias("l")).select("user_id", "l.*")
        corrections.registered(log, last, {"scope": "none", "status": "ready"})
    return log.current().select("user_id", "scope", r6("value", "value"), "status")


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS a, coalesce(text, '') || coalesce(CASE WHEN toxic = 1 THEN ' more' END, '') AS b FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*) AS total, count(*) FILTER (a <> b) AS changed FROM t)
SELECT 0 AS run, total AS created, 0 AS reused, total FROM n UNION ALL SELECT 1, 0, total, total FROM n UNION ALL SELECT 2, changed, total - changed, total FROM n UNION ALL SELECT 3, 0, total, total FROM n""")
def memory_bank(spark, d):
    log = _log(spark, "doc_id", {"doc_id": "long", **corrections.MEMORY_FIELDS})
    text = F.coalesce("text", F.lit(""))
    hashed = read(spark, d, "documents").select("doc_id", "text", F.sha2(text, 256).alias("plain"), F.sha2(F.concat(text, F.lit(" more")), 256).alias("longer"))
    docs, more = hashed.join(read(spark, d, "labels"), "doc_id", "left"), F.col("toxic") == 1
    first = docs.select("doc_id", "text", F.col("plain").alias("hash"))
    later = docs.select("doc_id", F.concat(text, F.when(more, " more").otherwise("")).alias("text"), F.when(more, F.col("longer")).otherwise(F.col("plain")).alias("hash"))
    runs = [corrections.memory_bank(log, rows, "text", texts.token_list(F.col("text")), content=F.col("hash")) for rows in (first, first, later, later)]
    return _runs(spark, runs, ["created", "reused", "total"])


_ROWS = """r AS (SELECT '99' || lpad((event_id % 3000)::VARCHAR, 10, '0') AS item, 'w' || hour(ts) % 3 AS window, CASE WHEN event_id % 3 = 0 THEN ((event_id * 7) % 2500)::VARCHAR WHEN event_id % 3 = 1 THEN ' ' END AS target, (user_id * 10 + event_id % 10)::DOUBLE AS value, least(2, day(ts) // 11) AS part FROM events),
b AS (SELECT part, item, max(nullif(trim(target), '')) AS target FROM r GROUP BY ALL), parts AS (SELECT unnest([0, 1, 2]) AS part),
mp AS (SELECT p.part, b.item, arg_max(b.target, b.part) FILTER (b.target IS NOT NULL) AS target FROM parts p JOIN b ON b.part <= p.part GROUP BY ALL),
l AS (SELECT r.*, coalesce(a.c, m.c) AS link FROM r LEFT JOIN (SELECT c_custkey::VARCHAR AS c FROM customer) a ON a.c = trim(r.target) LEFT JOIN mp ON mp.part = r.part AND mp.item = r.item LEFT JOIN (SELECT c_custkey::VARCHAR AS c FROM customer) m ON m.c = mp.target),
g AS (SELECT part, item, "window", max(value) AS value, arg_max(coalesce(link, ''), {'v': coalesce(value, -1), 'l': coalesce(link, '')}) AS target FROM l GROUP BY ALL),
h AS (SELECT *, (SELECT {'t': arg_max(nullif(o.target, ''), o.part) FILTER (o.target <> ''), 'v': arg_max(o.value, o.part), 'n': count(*)} FROM g o WHERE o.item = g.item AND o."window" = g."window" AND o.part < g.part) AS old FROM g)"""


def _platform_rows(spark, d):
    i = F.col("event_id")
    target = F.when(i % 3 == 0, (i * 7 % 2500).cast("string")).when(i % 3 == 1, " ")
    return read(spark, d, "events").select(
        F.concat(F.lit("ID:99"), F.lpad((i % 3000).cast("string"), 10, "0")).alias("item"), F.concat(F.lit("w"), (F.hour("ts") % 3).cast("string")).alias("window"), target.alias("target"),
        (F.col("user_id") * 10 + i % 10).cast("string").alias("value"), F.least(F.lit(2), F.floor(F.dayofmonth("ts") / 11)).alias("part"),
    )


def _synced(spark, d):
    platform = syncing.Platform.below(spark, f"{shared_root(spark)}/platform-{uuid.uuid4().hex}")
    rows = _platform_rows(spark, d)
    known = read(spark, d, "customer")
    for part in range(3):
        syncing.synced(platform, f"run{part}", "main", lambda part=part: rows.where(F.col("part") == part), known, "c_custkey")
    syncing.synced(platform, "run3", "main", lambda: rows.where("part = 9"), known, "c_custkey")
    syncing.synced(platform, "run4", "other", lambda: rows.drop("value"), known, "c_custkey")
    return platform


@query(f"""WITH {_ROWS}, n AS (SELECT part, count(*) AS pulled, count(link) AS linked FROM l GROUP BY ALL), m AS (SELECT part, count(target) AS mapped FROM b GROUP BY ALL),
i AS (SELECT part, count(*) FILTER (old.n = 0 OR old.v <> value OR (target <> '' AND target IS DISTINCT FROM old.t)) AS imported FROM h GROUP BY ALL)
SELECT 'run' || part AS run, 'main' AS account, CASE WHEN pulled > linked THEN 'completed_with_warnings' ELSE 'completed' END AS status, pulled, mapped, imported, linked, pulled - linked AS unlinked, false AS broke FROM n JOIN m USING (part) JOIN i USING (part)
UNION ALL SELECT 'run3', 'main', 'empty', 0, 0, 0, 0, 0, false UNION ALL SELECT 'run4', 'other', 'failed', 0, 0, 0, 0, 0, true""")
def sync_runs(spark, d):
    return syncing.recent_runs(_synced(spark, d)).withColumn("broke", F.col("error") != "").drop("error")


@query(f"""WITH {_ROWS} SELECT item, "window", arg_max(value, part) AS value, arg_max(target, part) FILTER (target <> '') AS target FROM g GROUP BY ALL""")
def synced_metrics(spark, d):
    return _synced(spark, d).metrics.current().select("item", "window", "value", "target")


@query("""WITH e AS (SELECT user_id AS account, round(value / 0.01::DOUBLE) * 0.01::DOUBLE AS v FROM events WHERE value IS NOT NULL)
SELECT account, count(*) AS n, round(sum(v), 2) AS total, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90 FROM e GROUP BY ALL""")
def streamed_baselines(spark, d):
    from tidemark.streaming.baselines import baselines_table

    events, folder = read(spark, d, "events").select("user_id", "value", "ts"), f"{shared_root(spark)}/baselines-{uuid.uuid4().hex}"
    part = F.least(F.lit(2), F.floor(F.dayofmonth("ts") / 11))
    for p in range(3):  # rows come in three times; each call reads the new ones only
        events.where(part == p).write.parquet(f"{folder}/in/{p}")
        out = baselines_table(spark.readStream.schema(events.schema).parquet(f"{folder}/in/*"), "user_id", "value", f"{folder}/kept")
    return out.select("account", "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"), *[r6(c, c) for c in ("median", "p75", "p90")])
