"""How the driver's tables stand in for the engine's: works, snapshots, embeddings, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.steps import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def works(spark: SparkSession, sf_dir: str, of_text: dict[str, Column] | None = None) -> DataFrame:
    """Published works: documents with their quality label, and times that follow from the number; ``of_text`` are columns that stand in for the text."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    docs = spread(docs).select("doc_id", "source", "lang", "n_chars", *[c.alias(n) for n, c in of_text.items()]) if of_text else docs
    joined = docs.join(labels, "doc_id", "left")
    day = lambda n: F.expr(f"timestamp_seconds(1704067200 + 86400 * (doc_id % {n}))")
    return joined.select(
        "doc_id", F.col("source").alias("account"), F.col("lang").alias("category"), F.col("n_chars").cast("double").alias("reward"), F.col("n_chars").alias("views"), *(of_text or ["text"]),
        (F.col("n_chars") % 200).cast("double").alias("duration"), day(300).alias("published"), F.expr("timestamp_seconds(1704067200 + 86400 * (doc_id % 300) + 86400 * (doc_id % 97))").alias("collected"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("label"),
    )


WORKS_SQL = """works AS (SELECT doc_id, source AS account, lang AS category, n_chars::DOUBLE AS reward, n_chars AS views, text, (n_chars % 200)::DOUBLE AS duration,
  make_timestamp((1704067200 + 86400 * (doc_id % 300)) * 1000000) AS published,
  make_timestamp((1704067200 + 86400 * (doc_id % 300) + 86400 * (doc_id % 97)) * 1000000) AS collected,
  CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS label FROM documents LEFT JOIN labels USING (doc_id))"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric snapshots: events with account, content type, hour and value."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("account"), F.col("event_type").alias("kind"), "ts", F.hour("ts").alias("hour"), "value", "props")


SNAPS_SQL = "snaps AS (SELECT event_id, user_id AS account, event_type AS kind, ts, hour(ts) AS hour, value, props FROM events)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed transcript: the turns of a conversation, a second for each 12 characters and a half between them."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations").withColumn("length", F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text", F.lit(""))) / 12)).cast("double"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("start", F.coalesce(F.sum(F.col("length") + 0.5).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return c.select("conv_id", "turn", "role", "text", "start", (F.col("start") + F.col("length")).alias("end"))


TURNS_SQL = """turns AS (SELECT conv_id, turn, role, text, start, start + length AS "end" FROM (SELECT *, coalesce(sum(length + 0.5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start
  FROM (SELECT *, greatest(1, ceil(length(coalesce(text, '')) / 12))::DOUBLE AS length FROM conversations)))"""
