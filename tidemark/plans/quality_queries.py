"""Queries of ``operators.quality`` over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans.queries import query, r6
from tidemark.plans.tables import WORKS_SQL, read, works

_STATUS = "CASE doc_id % 9 WHEN 0 THEN 'blocked' WHEN 1 THEN 'approved' WHEN 2 THEN 'corrected' WHEN 3 THEN 'needs_review' WHEN 4 THEN 'ready' WHEN 5 THEN 'rejected' WHEN 6 THEN '' ELSE 'candidate' END"


def _named(n, names):
    """names[n], blank beyond them."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in names]), n.cast("int")), F.lit(""))


@query(f"""WITH s AS (SELECT *, {_STATUS} AS status, (doc_id * 7) % 100 AS rights, (doc_id * 3) % 90 AS orig FROM documents)
SELECT doc_id, CASE WHEN status IN ('blocked', 'rejected') OR rights >= 80 OR orig >= 80 THEN 'blocked' WHEN doc_id % 10 = 0 THEN 'exported' WHEN status IN ('approved', 'ready') THEN 'approved' WHEN status IN ('corrected', 'needs_review') OR rights >= 50 OR orig >= 45 THEN 'needs_review' ELSE 'candidate' END AS state,
  CASE status WHEN 'blocked' THEN 'blocked' WHEN 'approved' THEN 'approved' WHEN 'ready' THEN 'approved' WHEN 'rejected' THEN 'blocked' WHEN 'candidate' THEN 'candidate' ELSE 'review' END AS status FROM s""")
def review_contracts(spark, d):
    i = F.col("doc_id")
    status = _named(i % 9, ["blocked", "approved", "corrected", "needs_review", "ready", "rejected", "", "candidate", "candidate"])
    return read(spark, d, "documents").select("doc_id", quality.review_contract(status, i * 7 % 100, i * 3 % 90, i % 10 == 0).alias("state"), quality.review_status(status).alias("status"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 < 3 THEN 'approved' ELSE 'review' END AS status, CASE WHEN event_id % 4 = 0 THEN 'seen' ELSE '' END AS reason FROM events),
l AS (SELECT *, lag(status) OVER w AS s, lag(reason) OVER w AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, status, reason, coalesce(s, 'candidate') AS previous_status FROM l WHERE s IS NULL OR s <> status OR r <> reason""")
def review_events(spark, d):
    i = F.col("event_id")
    e = read(spark, d, "events").select("event_id", "user_id", "ts", F.when(i % 5 < 3, "approved").otherwise("review").alias("status"), F.when(i % 4 == 0, "seen").otherwise("").alias("reason"))
    return quality.review_log(e, "user_id", ["ts", "event_id"], "status", "reason").drop("ts")


@query("""SELECT user_id, count(*) AS n, max(value) AS best_reward, max(value % 10) AS best_normalized, arg_max(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS latest_event_type, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS latest_event_id FROM events GROUP BY ALL""")
def feedback_summaries(spark, d):
    e = read(spark, d, "events").withColumn("normalized", F.col("value") % 10)
    return quality.feedback_summary(e, "user_id", "value", "normalized", ["ts", "event_id"], ["event_type", "event_id"]).drop("latest_at")


_QUEUE = f"""{WORKS_SQL}, q AS (SELECT doc_id, account, label, (reward % 101)::DOUBLE AS reward, doc_id % 4 AS unknown, doc_id % 6 AS needs, CASE doc_id % 3 WHEN 0 THEN 22.0 WHEN 1 THEN 10.0 ELSE 0.0 END AS doubt FROM works),
x AS (SELECT *, least(100, unknown * 18 + needs * 8 + doubt) + CASE WHEN label = 'high' THEN least(24, reward * 0.18) WHEN label = 'low' THEN 12 ELSE 0 END AS disagreement,
  CASE WHEN label = 'low' THEN 64 + least(24, (100 - reward) * 0.24) + unknown * 4 WHEN reward <= 25 THEN 38 + unknown * 6 ELSE 0 END AS risk, least(100, reward * 0.55 + CASE WHEN label = 'high' THEN 30 ELSE 0 END + doubt) AS impact FROM q),
y AS (SELECT *, CASE WHEN label = 'low' AND risk >= greatest(impact, disagreement) THEN 'risk' WHEN disagreement >= greatest(impact, risk) THEN 'disagreement' ELSE 'impact' END AS queue FROM x)"""


def _queue(spark, d):
    i = F.col("doc_id")
    w = works(spark, d).withColumn("reward", F.col("reward") % 101)
    return quality.calibration_queue(w, F.col("reward"), F.col("label"), i % 4, i % 6, F.when(i % 3 == 1, "Medium").when(i % 3 == 2, "high"))


@query(f"""WITH {_QUEUE} SELECT doc_id, round(impact, 6) AS impact, round(risk, 6) AS risk, round(disagreement, 6) AS disagreement, queue, round(least(100, greatest(0, CASE queue WHEN 'risk' THEN risk WHEN 'disagreement' THEN disagreement ELSE impact END)), 6) AS priority,
  round(least(100, greatest(0, least(40, reward * 0.35) + CASE label WHEN 'high' THEN 28 WHEN 'low' THEN 18 ELSE 0 END + least(36, needs * 9) + CASE doc_id % 3 WHEN 0 THEN 12 WHEN 1 THEN 5 ELSE 0 END - CASE WHEN reward <= 0 THEN 12 ELSE 0 END)), 6) AS calibration,
  round(least(100, CASE label WHEN 'high' THEN 36 WHEN 'low' THEN 32 ELSE 16 END + (doc_id % 50) * 0.25 + needs * 7 + reward * 0.1), 6) AS collection FROM y""")
def calibration_signals(spark, d):
    i = F.col("doc_id")
    doubt = F.when(i % 3 == 1, "Medium").when(i % 3 == 2, "high")
    calibration = quality.calibration_priority(F.col("reward"), F.col("reward"), F.col("label"), i % 6, doubt)
    collection = quality.collection_priority(F.col("label"), i % 6, i % 50, F.col("reward"))
    return _queue(spark, d).select("doc_id", *[r6(c, c) for c in ("impact", "risk", "disagreement")], "queue", r6("priority", "priority"), r6(calibration, "calibration"), r6(collection, "collection"))


@query(f"""WITH {_QUEUE}, k AS (SELECT account, queue AS kind, count(*) AS n FROM y GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY n DESC, kind) AS place FROM k) WHERE place <= 6""")
def queue_mix(spark, d):
    return quality.mix(_queue(spark, d), ["account"], "queue")


_SUMS = f"""{WORKS_SQL}, w AS (SELECT *, CASE WHEN doc_id % 8 > 0 THEN doc_id % 100 END AS score, (doc_id * 7) % 100 AS rights, (doc_id * 3) % 90 AS orig FROM works),
s AS (SELECT account, count(*) AS n, avg(coalesce(score, 0)) AS avg_score, avg(coalesce(duration, 0)) AS avg_duration, count(*) FILTER (score IS NULL) AS unscored, count(*) FILTER (rights >= 50) AS rights_risk, count(*) FILTER (rights >= 80) AS blocking_rights, max(rights)::DOUBLE AS max_rights,
  count(*) FILTER (orig >= 45) AS originality_risk, count(*) FILTER (orig >= 80) AS blocking_originality FROM w GROUP BY ALL)"""


def _sums(spark, d):
    i = F.col("doc_id")
    w = works(spark, d).withColumns({"score": F.when(i % 8 > 0, i % 100), "rights": i * 7 % 100, "orig": i * 3 % 90})
    return quality.queue_summary(w, ["account"], "score", "duration", "rights", "orig")


@query(f"WITH {_SUMS} SELECT account, n, round(avg_score, 6) AS avg_score, round(avg_duration, 6) AS avg_duration, unscored, rights_risk, blocking_rights, max_rights, originality_risk, blocking_originality FROM s")
def queue_summaries(spark, d):
    return _sums(spark, d).select("account", "n", r6("avg_score", "avg_score"), r6("avg_duration", "avg_duration"), "unscored", "rights_risk", "blocking_rights", "max_rights", "originality_risk", "blocking_originality")


@query("""WITH h AS (SELECT doc_id, doc_id % 5 AS seg, doc_id % 12 AS noise, doc_id % 30 AS ads, doc_id % 4 AS cand, doc_id % 3 AS scored, doc_id % 2 * (doc_id % 7) AS sponsor, doc_id % 6 AS weak, doc_id % 8 AS outl, doc_id % 41 AS top, doc_id % 9 AS closed, doc_id % 10 = 0 AS risk FROM documents),
p AS (SELECT *, 100 - CASE WHEN seg <= 0 THEN 25 ELSE 0 END - least(18, noise * 2) - CASE WHEN sponsor > 0 THEN least(16, ads * 2) ELSE least(6, round_even(ads * 0.25, 0)) END - CASE WHEN cand <= 0 THEN 20 WHEN scored <= 0 THEN 16 ELSE 0 END - least(18, sponsor * 5) - least(12, weak * 3) - least(14, outl * 3)
  - CASE WHEN cand > 0 AND scored < cand THEN 12 ELSE 0 END - CASE WHEN top > 0 AND closed <= greatest(1, round_even(top * 0.12, 0)) THEN 10 ELSE 0 END - CASE WHEN risk THEN 4 ELSE 0 END AS s FROM h)
SELECT doc_id, greatest(0, CASE WHEN risk THEN least(79, s) ELSE s END)::INT AS health FROM p""")
def health_scores(spark, d):
    i = F.col("doc_id")
    health = quality.health_score(i % 5, i % 12, i % 30, i % 4, i % 3, i % 2 * (i % 7), i % 6, i % 8, i % 41, i % 9, i % 10 == 0)
    return read(spark, d, "documents").select("doc_id", health.alias("health"))


@query("""WITH e AS (SELECT user_id, event_type || (event_id % 40) AS item, event_id % 11 <> 0 AS ok, event_id % 3 > 0 AS likes, event_id % 4 > 0 AS shares, event_id % 2 = 0 AS play FROM events),
b AS (SELECT user_id, item, max(CASE WHEN ok THEN (likes::INT + shares::INT) * 1000 + likes::INT * 100 + shares::INT * 10 + (NOT play)::INT END) AS b, count(*) AS raw, count(*) FILTER (ok) AS acc FROM e GROUP BY ALL),
g AS (SELECT user_id, sum(raw)::BIGINT AS raw, sum(acc)::BIGINT AS accepted, count(b) AS items, coalesce(sum(b // 100 % 10), 0)::BIGINT AS known_likes, coalesce(sum(b // 10 % 10), 0)::BIGINT AS known_shares, coalesce(sum(1 - b % 10), 0)::BIGINT AS play_missing FROM b GROUP BY ALL),
r AS (SELECT *, CASE WHEN accepted = 0 THEN 0 ELSE (accepted - items) / accepted END AS dup, CASE WHEN items = 0 THEN 0 ELSE play_missing / items END AS plays, CASE WHEN items = 0 THEN 2 ELSE 1 - known_likes / items + (1 - known_shares / items) END AS lacking FROM g)
SELECT user_id, raw, accepted, items, known_likes, known_shares, play_missing, round(dup, 6) AS duplicate_ratio, greatest(0, 100 - CASE WHEN raw > accepted THEN least(30, 10 + (raw - accepted) * 2) ELSE 0 END - CASE WHEN dup > 0.5 THEN 25 WHEN dup > 0.2 THEN 10 ELSE 0 END
  - round_even(lacking * 10, 0)::INT - CASE WHEN plays >= 0.95 AND items > 0 THEN 15 WHEN plays > 0.5 THEN 8 ELSE 0 END)::BIGINT AS score FROM r""")
def collection_reports(spark, d):
    i = F.col("event_id")
    e = read(spark, d, "events").select("user_id", F.concat("event_type", (i % 40).cast("string")).alias("item"), (i % 11 != 0).alias("ok"), (i % 3).alias("likes"), (i % 4).alias("shares"), (i % 2 == 0).alias("play"))
    r = quality.collection_report(e, ["user_id"], F.col("ok"), "item", ["likes", "shares"], F.col("play"))
    return r.select("user_id", "raw", "accepted", "items", "known_likes", "known_shares", "play_missing", r6("duplicate_ratio", "duplicate_ratio"), F.col("score").cast("long").alias("score"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 4 <> c_custkey % 3 THEN 'author_sec_uid_mismatch' WHEN c_custkey % 5 = 0 THEN 'author_user_id_mismatch' WHEN c_custkey % 7 = 0 THEN 'author_nickname_mismatch' ELSE '' END AS reason FROM customer""")
def author_mismatches(spark, d):
    i = F.col("c_custkey")
    expected = {"sec_uid": F.when(i % 4 > 0, i % 4), "user_id": F.lit("u"), "nickname": F.col("c_name")}
    found = {"sec_uid": i % 3, "user_id": F.when(i % 5 == 0, "v"), "nickname": F.when(i % 7 == 0, "Other").otherwise(F.concat(F.lit(" "), F.upper("c_name")))}
    return read(spark, d, "customer").select("c_custkey", quality.author_mismatch(expected, found).alias("reason"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '3.5万' WHEN 2 THEN p_partkey::VARCHAR ELSE '' END AS count, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'count_recovered_from_prefix' WHEN 2 THEN 'count_recovered_from_leading_text' ELSE 'missing_visible_count' END AS flag FROM part""")
def recovered_counts(spark, d):
    i, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(i % 4 == 1, F.concat(F.lit("热点 3.5万  "), name)).when(i % 4 == 2, F.concat(i.cast("string"), F.lit(" "), name)).otherwise(name)
    return read(spark, d, "part").select("p_partkey", quality.recovered_count(F.when(i % 4 == 0, "12"), title).alias("__c")).select("p_partkey", "__c.*")


@query(f"""WITH {WORKS_SQL}, w AS (SELECT coalesce(label, 'mid') AS label, unnest([{{'asset': 'video', 'has': doc_id % 2 = 0}}, {{'asset': 'audio', 'has': doc_id % 3 = 0}}, {{'asset': 'cover', 'has': views > 500}}], recursive := true) FROM works)
SELECT label, asset, count(*) AS n, count(*) FILTER (has) AS filled, round(count(*) FILTER (has) / count(*), 6) AS share FROM w GROUP BY ALL""")
def asset_readiness(spark, d):
    i = F.col("doc_id")
    w = works(spark, d).withColumns({"video": i % 2 == 0, "audio": i % 3 == 0, "cover": F.col("views") > 500})
    return quality.readiness(w, "label", ["video", "audio", "cover"]).withColumn("share", F.round("share", 6))


@query(f"""WITH {WORKS_SQL}, w AS (SELECT label, unnest([{{'feature': 'reward', 'v': reward}}, {{'feature': 'duration', 'v': duration}}], recursive := true) FROM works), m AS (SELECT feature, coalesce(avg(v) FILTER (label = 'high'), 0) AS high, coalesce(avg(v) FILTER (label = 'low'), 0) AS low FROM w GROUP BY ALL)
SELECT feature, round(high, 6) AS high, round(low, 6) AS low, round(high - low, 6) AS gap FROM m""")
def feature_gaps(spark, d):
    return quality.label_gaps(works(spark, d), "label", ["reward", "duration"]).select("feature", r6("high", "high"), r6("low", "low"), r6("gap", "gap"))


@query(f"""WITH {WORKS_SQL}, w AS (SELECT doc_id, coalesce(label, 'mid') AS kind, coalesce(reward, 0) AS reward FROM works),
f AS (SELECT * FROM w WHERE doc_id % 40 = 0 ORDER BY kind = 'mid', reward DESC, doc_id LIMIT 60), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY reward DESC, doc_id) AS round FROM w WHERE doc_id NOT IN (SELECT doc_id FROM f)),
b AS (SELECT doc_id, 0 AS round, CASE kind WHEN 'mid' THEN 1 ELSE 0 END AS turn, reward FROM f UNION ALL SELECT doc_id, round, CASE kind WHEN 'high' THEN 0 WHEN 'low' THEN 1 ELSE 2 END, reward FROM r) SELECT doc_id FROM b ORDER BY round, turn, reward DESC, doc_id LIMIT 60""")
def validation_sample(spark, d):
    return quality.assets_first(works(spark, d).drop("text"), F.col("doc_id") % 40 == 0, "label", "reward", "doc_id", 60).select("doc_id")


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 3 = 0 THEN repeat('la ' || (conv_id % 7)::VARCHAR, 20) WHEN turn % 3 = 1 THEN coalesce(text, '') ELSE repeat('hm', 10) || coalesce(text, '') END, '\s+', '', 'g') AS t FROM conversations),
p AS (SELECT conv_id, turn, n, t[i:i + n - 1] AS piece, length(t) AS len FROM (SELECT *, unnest(range(1, length(t) - n + 2, n)) AS i FROM c, (VALUES (1), (2), (3), (4)) v(n) WHERE length(t) >= 32)),
m AS (SELECT conv_id, turn, n, len, max(k) AS most, sum(k) AS parts FROM (SELECT conv_id, turn, n, len, piece, count(*) AS k FROM p GROUP BY ALL) GROUP BY ALL),
h AS (SELECT conv_id, turn, bool_or(n = 1 AND most / len >= 0.42 OR most >= 8 AND most / parts >= 0.55) AS repetitive FROM m GROUP BY ALL) SELECT c.conv_id, c.turn, coalesce(repetitive, false) AS repetitive FROM c LEFT JOIN h ON c.conv_id = h.conv_id AND c.turn = h.turn""")
def repetitive_turns(spark, d):
    text = F.coalesce("text", F.lit(""))
    said = F.when(F.col("turn") % 3 == 0, F.repeat(F.concat(F.lit("la "), (F.col("conv_id") % 7).cast("string")), 20)).when(F.col("turn") % 3 == 1, text).otherwise(F.concat(F.lit("hm" * 10), text))
    return read(spark, d, "conversations").select("conv_id", "turn", quality.is_repetitive(said).alias("repetitive"))
