"""Summaries of simulations and transcripts on small cases."""

from pyspark.sql import functions as F

from tidemark.operators import summaries


def test_simulation_summary_takes_the_first_name_of_equals(spark):
    rows = [("a", 80.0, "z", "x"), ("a", 72.0, "b", "y"), ("a", None, None, "y"), ("a", 10.0, "b", "x"), ("a", 10.0, "z", "w"), ("b", 71.9, None, None)]
    df = spark.createDataFrame(rows, "g string, score double, b string, s string").repartition(3)
    columns = (F.col("score"), F.col("b"), F.col("s"))
    got = {r["g"]: tuple(r)[1:] for r in summaries.simulation_summary(df, *columns, ["g"]).collect()}
    assert got == {"a": (5, 34.4, 2, "b", "x"), "b": (1, 71.9, 0, None, None)}
    whole = summaries.simulation_summary(df, *columns).collect()
    assert [(r["n"], r["high_potential"], r["top_bottleneck"], r["top_stage"]) for r in whole] == [(6, 2, "b", "x")]
    assert [tuple(r) for r in summaries.simulation_summary(df.limit(0), *columns).collect()] == [(0, 0.0, 0, None, None)]


def test_transcript_summary_keeps_the_first_texts(spark):
    raw = spark.createDataFrame([(1, i, f"t{i}") for i in range(10)] + [(2, 0, None), (3, 0, "x"), (3, 0, "x")], "c long, turn int, t string")
    pieces = raw.where("c = 1 or c = 3 or t is null and c = 2 and turn > 0")
    got = {r["c"]: r for r in summaries.transcript_summary(raw, pieces, "c", "turn", "t", F.col("turn") % 2 == 1, F.when(F.col("t") == "x", True)).collect()}
    assert (got[1]["n_raw"], got[1]["n_processed"], got[1]["compression"], got[1]["n_noise"], got[1]["n_ads"]) == (10, 10, 1.0, 5, 0)
    assert got[1]["sample_noise"] == ["t1", "t3", "t5"] and got[1]["sample_ads"] == []
    assert (got[2]["n_raw"], got[2]["n_processed"], got[2]["compression"], got[2]["sample_ads"]) == (1, 0, 0.0, [])
    assert got[3]["n_ads"] == 2 and got[3]["sample_ads"] == ["x", "x"]
    assert summaries.transcript_summary(raw.limit(0), pieces, "c", "turn", "t", F.lit(True), F.lit(True)).count() == 0
