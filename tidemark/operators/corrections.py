"""Corrections of kept rows by a change log: segments and their scores, reopened labels, backfills, registries, the memory bank."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scores import final_score
from tidemark.operators.prototypes import hashed_vectors
from tidemark.operators.steps import cut
from tidemark.sources.changelog import ChangeLog

# ---- fixed values: where a cover stands in a clip, and the levels of trust that a reopened label may have ----
COVER_AT = 0.45
REOPENED = ["low", "medium", "high"]
VERIFIED = "manual_verified"
# ---- end of fixed values ----


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def corrected_segments(log: ChangeLog, given: DataFrame, length: str, texts: list[str], parts: dict[str, Column], reason: str = "") -> dict[str, int]:
    """Corrects segments' times, cover, status and texts, and scores those anew that changed; returns counts, times out of range as invalid.

    ``given`` has the key, start, end, cover, status and ``texts`` (null: not
    given) and ``length``, how long the whole is.  A cover outside the new times
    moves to its place in the clip; a blank status becomes corrected.  ``parts``
    are the score's parts, columns of the log's rows.
    """
    k = log.key
    asked = given.select(k, length, *[F.col(c).alias(f"__{c}") for c in ("start", "end", "cover", "status", *texts)])
    rows = asked.join(log.current(), k)
    start, end = F.coalesce("__start", "start"), F.coalesce("__end", "end")
    good = (start >= 0) & (end > start) & ((F.col(length) <= 0) | (end <= F.col(length)))
    cover = F.coalesce("__cover", "cover")
    placed = F.when(cover.isNull() | (cover < start) | (cover > end), F.round(start + F.round(end - start, 3) * COVER_AT, 3)).otherwise(cover)
    status = F.when(_blank(F.col("__status")), "corrected").otherwise(F.trim("__status"))
    judged = cut(rows.select(k, good.alias("__good"), start.alias("start"), end.alias("end"), F.round(end - start, 3).alias("duration"), placed.alias("cover"), status.alias("status"), *[F.trim(f"__{c}").alias(c) for c in texts]))
    counts = log.merge(judged.where("__good").drop("__good"), "update", reason=reason)
    wrong, missing = judged.where(~F.col("__good")).count(), asked.count() - judged.count()
    changed = judged.where("__good").select(k)
    log.merge(log.current(changed).select(k, F.round(final_score(parts), 4).alias("score")), "update", reason="rescored")
    return {**counts, **({"invalid": wrong} if wrong else {}), **({"missing": missing} if missing else {})}


def reopened(log: ChangeLog, asked: DataFrame, confidence: str = "confidence", reason: str = "reopened") -> dict[str, int]:
    """Takes labels back to a lower trust (blank: low); those that would stay verified or name no level are invalid."""
    level = F.when(_blank(F.col(confidence)), "low").otherwise(F.trim(confidence))
    rows = cut(asked.select(log.key, level.alias(confidence)))
    counts = log.merge(rows.where(F.col(confidence).isin(REOPENED)), "update", reason=reason)
    wrong = rows.where(~F.col(confidence).isin(REOPENED)).count()
    return {**counts, **({"invalid": wrong} if wrong else {})}


def backfilled(log: ChangeLog, computed: dict[str, Column], version: str, force: bool = False) -> dict[str, int]:
    """Computes fields anew where their version is an older one (everywhere if forced) and writes the rows that differ."""
    rows = log.current()
    stale = F.lit(True) if force else ~F.col("version").eqNullSafe(F.lit(version))
    seen = rows.agg(F.count("*").alias("scanned"), F.count_if(~stale).alias("current"), F.count_if(F.col("confidence") == VERIFIED).alias("verified")).first()
    done = log.merge(rows.where(stale).select(log.key, *[c.alias(n) for n, c in computed.items()], F.lit(version).alias("version")), "update", reason=f"backfill {version}")
    return {"scanned": seen["scanned"], "updated": done.get("updated", 0), "unchanged": done.get("unchanged", 0), "skipped_current": seen["current"], "manual_verified": seen["verified"]}


def registered(log: ChangeLog, rows: DataFrame, defaults: dict[str, str], order: list[Column] = ()) -> dict[str, int]:
    """Adds rows or fills stored ones: a blank value keeps what is stored, and is the default where nothing is."""
    k = log.key
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    kinds = dict(rows.dtypes)
    named = [F.when(F.lit(True), filled(c) if kinds[c] == "string" else F.col(c)).alias(c) for c in rows.columns if c != k]
    counts = log.merge(rows.select(k, *named, *[o.alias(f"__o{i}") for i, o in enumerate(order)]), order=[F.col(f"__o{i}") for i in range(len(order))])
    if not defaults:
        return counts
    lacking = [F.when(F.col(c).isNull(), F.lit(v)).alias(c) for c, v in defaults.items()]
    keys = rows.select(k).where(F.col(k).isNotNull()).distinct()
    log.merge(log.current(keys).select(k, *lacking), "update", reason="defaults")
    return counts


def linked_inserts(log: ChangeLog, rows: DataFrame, known: DataFrame, link: str, known_key: str, **how) -> dict[str, int]:
    """Inserts rows whose ``link`` exists among ``known``; the others are counted as unlinked."""
    ids = known.select(F.col(known_key).alias("__id")).distinct()
    marked = cut(rows.join(ids, F.col(link) == F.col("__id"), "left").withColumn("__ok", F.col("__id").isNotNull()).drop("__id"))
    counts = log.merge(marked.where("__ok").drop("__ok"), "insert", **how)
    loose = marked.where(~F.col("__ok")).count()
    return {**counts, **({"unlinked": loose} if loose else {})}


MEMORY_FIELDS = {"content_hash": "string", "batch": "string"}

#: Keys of new texts that may be broadcast; they are counted first.
FEW_TEXTS = 500_000


def memory_bank(log: ChangeLog, rows: DataFrame, text: str, tokens: Column, force: bool = False, content: Column | None = None) -> dict[str, int]:
    """Brings the bank of text vectors up to the rows: only contents without a vector are computed; returns created, reused, total.

    Vectors are kept by the hash of their content, so rows with equal texts
    share one; ``log`` has, for each key, the hash and the batch that holds its
    vector.  A batch that no row of the log names does not count, so a run that
    fails halfway is simply run again.  ``content`` is the SHA-256 of the text
    (null: empty) where rows have it: texts that are joined to others need not
    travel to be named.
    """
    k = log.key
    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256) if content is None else content
    named = cut(rows.select(k, content.alias("content_hash")))
    held = log.current()
    fresh = named.join(held.select(k, "content_hash"), [k, "content_hash"], "left_semi") if not force else named.limit(0)
    old = held.groupBy("content_hash").agg(F.min("batch").alias("batch"))
    stale = cut(named.join(fresh.select(k), k, "left_anti").join(old if not force else old.limit(0), "content_hash", "left"))
    batch = f"vectors/{uuid.uuid4().hex}"
    new = stale.where(F.col("batch").isNull())
    if not new.isEmpty():
        keys = cut(new.groupBy("content_hash").agg(F.min(k).alias(k)))
        few = keys.limit(FEW_TEXTS + 1).count() <= FEW_TEXTS
        wanted = F.broadcast(keys.select(k)) if few else keys.select(k)
        one = rows.join(wanted, k, "left_semi").join(keys, k).select("content_hash", tokens.alias("__tokens"))  # the rows' own joins see new texts only
        hashed_vectors(one, "content_hash", "__tokens", single=True).write.parquet(f"{log.folder}/{batch}")
    log.merge(stale.select(k, "content_hash", F.coalesce("batch", F.lit(batch)).alias("batch")))
    total, created = named.count(), stale.count()
    return {"created": created, "reused": total - created, "total": total}


def bank_vectors(log: ChangeLog) -> DataFrame:
    """The vectors of the bank's rows: key, slot, weight."""
    rows = cut(log.current())
    batches = [r["batch"] for r in rows.select("batch").distinct().collect()]  # one a build
    if not batches:
        return log.spark.createDataFrame([], f"`{log.key}` {log.fields[log.key]}, slot int, weight double")
    stored = None
    for b in batches:
        part = log.spark.read.parquet(f"{log.folder}/{b}").withColumn("batch", F.lit(b))
        stored = part if stored is None else stored.unionByName(part)
    return rows.join(stored, ["content_hash", "batch"]).select(log.key, "slot", "weight")
