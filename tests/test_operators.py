import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import baselines, dedupe, joins, ranking, transcripts


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_tail_labels_at_small_sizes(spark):
    data = [(g, float(i)) for g, n in (("a", 1), ("b", 2), ("c", 10)) for i in range(n)]
    out = baselines.tail_labels(spark.createDataFrame(data, "g string, v double"), ["g"], [F.desc("v")])
    got = rows(out, "g", "v", "label", "label_percentile")
    assert got[0] == ("a", 0.0, "high", 100.0)
    assert [g[2] for g in got[1:3]] == ["low", "high"]
    assert [g[2] for g in got[3:]] == ["low"] * 2 + ["mid"] * 6 + ["high"] * 2


def test_fallback_takes_the_narrowest_scope_with_enough(spark):
    data = [("a", "x", 1.0)] * 3 + [("a", "y", 5.0), ("b", "x", 9.0)]
    out = baselines.with_fallback_baseline(spark.createDataFrame(data, "k string, l string, v double"), ["k", "l"], "v", 3)
    assert rows(out.distinct(), "k", "l", "scope", "baseline_n") == [("a", "x", 2, 3), ("a", "y", 1, 4), ("b", "x", 0, 5)]


def test_upsert_outcomes(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 5.0)], "k string, v double")
    new = spark.createDataFrame([("a", 2.0), ("b", 5.0), ("c", 0.0)], "k string, v double")
    assert rows(dedupe.upsert_preferred(old, new, ["k"], [F.col("v")]), "k", "v", "outcome") == [("a", 2.0, "updated"), ("b", 5.0, "kept"), ("c", 0.0, "inserted")]


def test_changed_fields(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.00000001), (2, "z", 2.0)], "k int, s string, v double")
    (row,) = dedupe.changed_fields(a, b, "k", ["s", "v"]).collect()
    assert row["k"] == 2 and list(row["diff"]) == ["s"] and row["diff"]["s"]["after"] == "z"


def test_most_common_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, v string, o int")
    assert rows(dedupe.most_common(df, ["k"], "v", "o"), "v", "n") == [("b", 2)]


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.randrange(3), i, a := rng.uniform(0, 50), a + rng.uniform(0, 20)) for i in range(n)]  # noqa: E731, F841
    a, b = make(40), make(40)
    schema = "k int, i int, start double, end double"
    got = rows(joins.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], 7.0), "i", "right_i")
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] <= x[3] and y[3] >= x[2])


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 0.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 8.0, "a"), (1, 12.0, "b")], "k int, t double, n string")
    assert rows(joins.nearest_in_time(left, right, ["k"], "t", ["n"]), "k", "t", "near_n") == [(1, 0.0, "a"), (1, 10.0, "a"), (2, 1.0, None)]


def test_search_is_bounded(spark):
    df = spark.createDataFrame([(1, 0.0, False), (1, 3.0, True), (1, 20.0, True)], "k int, t double, f boolean")
    assert rows(joins.next_with(df, ["k"], "t", F.col("f"), 5.0, []), "t", "found_t") == [(0.0, 3.0), (3.0, None), (20.0, None)]


def test_diversity_counts_what_came_before(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "a", 2.0), (3, "", 1.0), (4, "a", 0.0)], "i int, k string, s double")
    assert rows(ranking.diversity_penalty(df, {"k": (2.0, 1)}, [F.desc("s")]), "i", "penalty") == [(1, 0.0), (2, 2.0), (3, 0.0), (4, 2.0)]


def test_leaks_and_blank_keys(spark):
    train = spark.createDataFrame([(1, "x"), (2, ""), (3, "y")], "i int, k string")
    held = spark.createDataFrame([(9, "x"), (8, "")], "i int, k string")
    assert rows(ranking.without_leaks(train, held, ["k"]), "i") == [(2,), (3,)]


def test_suppression_is_greedy(spark):
    data = [(1, 1, 0.0, 10.0, 9.0, "p"), (1, 2, 1.0, 9.0, 8.0, "q"), (1, 3, 6.0, 16.0, 7.0, "r"), (1, 4, 50.0, 60.0, 6.0, "p"), (1, 5, 4.0, 14.0, 5.0, "s")]
    df = spark.createDataFrame(data, "k int, i int, start double, end double, s double, f string")
    assert rows(transcripts.suppress_overlaps(df, "k", "i", "start", "end", "s", "f"), "i") == [(1,), (3,)]


def test_merge_stops_at_gap_tag_and_length(spark):
    data = [(1, 0, 0.0, 2.0, "a", "x"), (1, 1, 2.75, 4.0, "b", "x"), (1, 2, 4.8, 5.0, "c", "x"), (1, 3, 5.0, 6.0, "d", "y"), (1, 4, 6.0, 15.0, "e", "y")]
    df = spark.createDataFrame(data, "k int, o int, start double, end double, t string, g string")
    got = rows(transcripts.merge_adjacent(df, "k", "o", "start", "end", "t", "g"), "first", "text", "pieces")
    assert got == [(0, "a b", 2), (2, "c", 1), (3, "d", 1), (4, "e", 1)]


def test_merge_of_many_keys_in_one_partition(spark):
    df = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("o"), (F.col("id") * 100.0).alias("start"), (F.col("id") * 100.0 + 1).alias("end"), F.lit("t").alias("t"), F.lit("g").alias("g"))
    assert transcripts.merge_adjacent(df, "k", "o", "start", "end", "t", "g").count() == 200


@pytest.mark.parametrize("n_train", [30, 900])
def test_similar_history_against_plain_python(spark, n_train):
    """Candidates by rare tokens and by fields, with the fall-backs for small tables and rows without tokens."""
    from collections import Counter

    from tidemark.plans.backtest import FIELD_BONUS, FIELD_POSTINGS, similar_history, with_asked

    rng, limit = random.Random(4), 40
    schema = "id long, account string, category string, hook string, tokens array<string>"
    make = lambda i: (i, f"a{min(rng.randrange(9), 4)}", rng.choice(["x", "y", None, " X"]), rng.choice(["h", "k", ""]), [] if i % 11 == 0 else ["common", *rng.sample([f"t{j}" for j in range(150)], 3)])
    held, train = [make(i) for i in range(40)], [make(1000 + i) for i in range(n_train)]
    key = lambda v: (v or "").strip().lower()
    names = ["account", "category", "hook"]
    posts = Counter(t for r in train for t in r[4])
    longest = max(80, min(420, len(train) // 8))
    want = {}
    for r in held:
        score = Counter()
        for s in train:
            n = sum(posts[t] <= longest for t in set(r[4]) & set(s[4])) + sum(FIELD_POSTINGS[f] for i, f in enumerate(names, 1) if key(r[i]) and key(r[i]) == key(s[i]))
            if n or len(train) <= limit or not r[4]:
                score[s[0]] = n
        chosen = sorted(score, key=lambda s: (-score[s], s))
        for s in chosen if len(train) <= limit or not r[4] else chosen[:limit]:
            o = train[s - 1000]
            both = len(set(r[4]) & set(o[4]))
            sim = both / max(1, len(set(r[4])) + len(set(o[4])) - both) + sum(b for f, b in FIELD_BONUS.items() if f in names and key(r[names.index(f) + 1]) and key(r[names.index(f) + 1]) == key(o[names.index(f) + 1]))
            if sim > 0:
                want[r[0], s] = min(1.0, sim)
    h, t = spark.createDataFrame(held, schema), spark.createDataFrame(train, schema)
    got = {(r["target"], r["sample"]): r["similarity"] for r in similar_history(h, t, "id", "tokens", limit).where("similarity > 0").collect()}
    assert got == pytest.approx(want)
    asked = {r["id"]: r["asked"] for r in with_asked(h, "id", "tokens").collect()}
    for r in held:
        assert asked[r[0]] == (r[0] if r[4] else min(o[0] for o in held if not o[4] and o[1:4] == r[1:4]))


def test_suppression_keeps_a_print_whose_better_row_went(spark):
    from tidemark.operators.transcripts import suppress_overlaps

    rows = [(1, "C", 0.0, 10.0, 11.0, ""), (1, "A", 0.0, 10.0, 10.0, "p"), (1, "D", 100.0, 110.0, 5.0, "p"), (1, "E", 200.0, 210.0, 4.0, "p"), (2, "A", 0.0, 10.0, 1.0, "p")]
    df = spark.createDataFrame(rows, "k int, item string, start double, end double, score double, print string")
    got = suppress_overlaps(df, "k", "item", "start", "end", "score", "print").collect()
    assert sorted((r["k"], r["item"]) for r in got) == [(1, "C"), (1, "D"), (2, "A")]


def test_leak_rule_keeps_all_if_nothing_is_left(spark):
    from tidemark.operators.ranking import without_leaks

    train, held = spark.createDataFrame([(1, "a"), (2, "a")], "i int, key string"), spark.createDataFrame([("a",)], "key string")
    assert without_leaks(train, held, ["key"]).count() == 2
    assert without_leaks(train.union(spark.createDataFrame([(3, "b")], "i int, key string")), held, ["key"]).count() == 1
