import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import prototypes, quality, structures
from tidemark.streaming.metrics import totals_table


def test_percentiles_of_groups_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", 7.0)] * 500 + [("hot", float(v)) for v in rng.integers(0, 1000, 301)] + [("one", 4.0), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    qs = {"low": 0.4, "median": 0.5, "p75": 0.75, "top": 1.0}
    got = {r["k"]: r for r in prototypes.spread_percentiles(df, ["k"], "v", qs).collect()}
    assert set(got) == {"hot", "one", None}  # groups without values have no percentiles
    for k in got:
        own = [v for key, v in rows if key == k and v is not None]
        assert [got[k][q] for q in qs] == pytest.approx([np.quantile(own, q) for q in qs.values()])
        assert got[k]["n"] == len(own)
    whole = prototypes.spread_percentiles(df, [], "v", {"median": 0.5}).collect()
    assert whole[0]["median"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))
    assert [r["median"] for r in prototypes.spread_percentiles(df.where("false"), [], "v", {"median": 0.5}).collect()] == [None]
    assert prototypes.spread_percentiles(df.where("false"), ["k"], "v", {"median": 0.5}).collect() == []


def test_hashed_vector_of_known_tokens(spark):
    import hashlib

    tokens = ["music", "live", "music", "a"]
    want = np.zeros(128)
    for t in tokens:
        h = hashlib.sha256(t.encode()).digest()
        want[int.from_bytes(h[:4], "big") % 128] += (1 if h[4] % 2 == 0 else -1) * (1 + min(1, len(t) / 8))
    want = np.round(want / np.sqrt((want**2).sum()), 6)
    df = spark.createDataFrame([(1, tokens), (2, []), (3, None)], "id int, t array<string>")
    got = prototypes.hashed_vectors(df, "id", "t").collect()
    assert {r["id"] for r in got} == {1}
    assert {r["slot"]: r["weight"] for r in got} == pytest.approx({int(i): want[i] for i in np.flatnonzero(want)})


def test_hashed_vectors_shuffle_no_tokens(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [f"w{n}" * int(n % 4 + 1) for n in rng.integers(0, 40, i % 7)]) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None), (61, ["é", "", "音"])], "id int, t array<string>").coalesce(2)
    table = lambda x: sorted(tuple(r) for r in x.collect())
    single = prototypes.hashed_vectors(df, "id", "t", single=True)
    assert "Exchange" not in single._jdf.queryExecution().toString()
    halves = df.select("id", F.expr("slice(t, 1, 2)").alias("t")).unionByName(df.select("id", F.expr("slice(t, 3, 9)").alias("t")))
    whole = prototypes.hashed_vectors(df, "id", "t")
    assert table(single) == table(whole) == table(prototypes.hashed_vectors(halves, "id", "t"))
    assert {r["id"] for r in single.collect()} >= {61} and 60 not in {r["id"] for r in single.collect()}


def test_repetition(spark):
    texts = [None, "", "aaaa", "a" * 40, "ab " * 20, "The quick brown fox jumps over the lazy dog again", "abcdefghij" * 5, "hahaha" * 8 + "xyz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(quality.is_repetitive(F.col("t"))).collect()] == [False, False, False, True, True, False, False, True]


def test_review_events_that_repeat_are_left_out(spark):
    rows = [("a", 1, "review", None), ("a", 2, "review", " "), ("a", 3, "review", "x"), ("a", 4, "approved", "x"), ("a", 5, "approved", "x"), ("b", 1, "blocked", "")]
    got = quality.review_log(spark.createDataFrame(rows, "k string, at int, status string, reason string"), "k", ["at"], "status", "reason")
    assert [(r["k"], r["at"], r["previous_status"]) for r in got.orderBy("k", "at").collect()] == [("a", 1, "candidate"), ("a", 3, "review"), ("a", 4, "review"), ("b", 1, "candidate")]


def test_counts_before_titles(spark):
    rows = [("9", "12 songs"), (None, "共创 1.5万 live"), ("", "3亿 show"), (None, "show 3"), (None, None)]
    got = spark.createDataFrame(rows, "c string, t string").select(quality.recovered_count(F.col("c"), F.col("t")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("9", "12 songs", ""), ("1.5万", "live", "count_recovered_from_prefix"), ("3亿", "show", "count_recovered_from_leading_text"), ("", "show 3", "missing_visible_count"), ("", "", "missing_visible_count")]


def test_structure_scores(spark):
    titles = [None, "plain", "副歌 一开口", "副歌", "VLOG", "没想到 爆发"]
    ranked = spark.createDataFrame([(t,) for t in titles], "t string").withColumn("r", structures.scores(F.col("t")))
    got = [tuple(r) for r in ranked.select(structures.suggestion(F.col("r")).alias("s")).select("s.*").collect()]
    # climax 28 + 8 + 10 = 46 leads chorus 22 + 8 + 7 + 7 + 10 = 47 (an opening counts as context, twice) by less than 8
    assert got[0] == got[1] == ("unknown", 0.0)
    assert got[3] == ("chorus_first", 40.0) and got[4] == ("linear", 22.0)
    assert got[5] == ("setup_to_payoff", 20.0 + 8 + 7 + 8)
    assert got[2][0] in ("climax_first", "chorus_first") and 0 < got[2][1] < 46


def test_assets_first_holds_every_label(spark):
    rows = [(i, ["high", "low", None][i % 3], float(i % 50), i % 20 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label string, reward double, has boolean")
    got = [r["id"] for r in quality.assets_first(df, F.col("has"), "label", "reward", "id", 30).select("id").collect()]
    assert len(got) == len(set(got)) == 30 and {i for i in range(300) if i % 20 == 0} <= set(got)
    assert quality.assets_first(df, F.lit(False), "label", "reward", "id", 1000).count() == 300


def test_totals_go_on_from_their_cursor(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", k, 1.0) for h in (1, 1, 2) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run = lambda: {(r["window_start"].hour, r["k"]): (r["n"], r["total"]) for r in totals_table(stream(), "ts", "k", "v", f"file://{tmp_path}/out").collect()}
    first = run()
    assert first == {(1, "a"): (2, 2.0), (1, "b"): (2, 2.0), (2, "a"): (1, 1.0), (2, "b"): (1, 1.0)}
    assert run() == first  # nothing new
    df.where("k = 'a' AND hour(ts) = 2").coalesce(1).write.parquet(f"{tmp_path}/more")
    for f in (tmp_path / "more").glob("*.parquet"):
        shutil.copy(f, tmp_path / "in" / f"more-{f.name}")
    assert run() == {**first, (2, "a"): (2, 2.0)}
