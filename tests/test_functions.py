import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashes, numbers, rewards, texts, times, vectors


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_metric_numbers(spark):
    cells = ["82%", "0.8%", "1%", "1.2万", "3亿", "1,234", "", "abc", None]
    got = [r[0] for r in values(spark, [(c,) for c in cells], "c string", numbers.metric_number(F.col("c")))]
    assert got == [82.0, 0.8, 1.0, 12000.0, 3e8, 1234.0, None, None, None]


def test_ratio_strips_percent_before_size_test(spark):
    got = [r[0] for r in values(spark, [("82%",), ("0.8%",), ("1%",), ("1.5%",), (None,)], "c string", numbers.ratio(numbers.metric_number(F.col("c"))))]
    assert got == pytest.approx([0.82, 0.8, 1.0, 0.015, 0.0])


def test_lenient_numbers_and_counts(spark):
    rows = [("about 12.5 plays",), ("1.2万",), ("-3",), ("none",), (None,)]
    assert [r[0] for r in values(spark, rows, "c string", numbers.lenient_number(F.col("c")))] == [12.5, 12000.0, -3.0, 0.0, 0.0]
    assert [r[0] for r in values(spark, [("23.8万",), ("12 plays",), ("7",)], "c string", numbers.visible_count(F.col("c")))] == [238000, None, 7]
    assert [r[0] for r in values(spark, [("1|5|2",), (None,)], "c string", numbers.largest_of_piped(F.col("c")))] == [5.0, 0.0]


def test_identifiers(spark):
    rows = [("ID: 12 3456789012 x 9876543210",), ("123",)]
    assert values(spark, rows, "c string", numbers.joined_digits(F.col("c")), numbers.first_long_digits(F.col("c"))) == [("1234567890129876543210", "3456789012"), (None, None)]
    urls = [("https://a.b/video/77?x=1",), ("https://a.b/?modal_id=88",), ("https://a.b/",)]
    assert [r[0] for r in values(spark, urls, "c string", numbers.id_in_url(F.col("c")))] == ["77", "88", None]


def test_falsy_and_known(spark):
    rows = [(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (None, None)]
    assert [r[0] for r in values(spark, rows, "a double, b double", numbers.falsy_first(F.col("a"), F.col("b")))] == [0.0, 5.0, 5.0, 0.0]
    assert [r[0] for r in values(spark, [("x",), (" Unknown ",), ("",), (None,), ("0",)], "c string", numbers.known(F.col("c")))] == [True, False, False, False, False]
    assert [r[0] for r in values(spark, [("a_20240101_20240203",), ("none",)], "c string", numbers.dataset_date(F.col("c")))] == [20240203, 0]


def test_hours_are_those_of_the_text(spark):
    rows = [("2024-05-01T20:00:00+08:00",), ("2024-05-01T12:00:00Z",), ("2024-05-01T07:30:00",), ("2024-05-01",), ("junk",), (None,)]
    assert [r[0] for r in values(spark, rows, "c string", times.wall_hour(F.col("c")))] == [20, 12, 7, 0, -1, -1]


def test_publish_hour_falls_back_to_collection(spark):
    rows = [(None, "2024-05-01T03:00:00", 5.0), ("2024-05-01T08:00:00", "2024-05-01T03:00:00", 5.0), (None, "2024-05-01T03:00:00", 0.0), (None, None, 1.0)]
    assert [r[0] for r in values(spark, rows, "p string, c string, h double", times.publish_hour(F.col("p"), F.col("c"), F.col("h")))] == [22, 8, 3, -1]


def test_buckets_at_their_edges(spark):
    seconds = [0, 15, 24.99, 25, 30, 45, 60, 90, 180, -1]
    got = values(spark, [(float(s),) for s in seconds], "s double", times.open_duration_bucket(F.col("s")), times.closed_duration_bucket(F.col("s")))
    assert [g[0] for g in got] == ["unknown", "short", "short", "medium", "medium", "long", "long", "extra_long", "extra_long", "unknown"]
    assert [g[1] for g in got] == ["", "0-15s", "16-30s", "16-30s", "16-30s", "31-60s", "31-60s", "61-180s", "61-180s", ""]
    assert [r[0] for r in values(spark, [(h,) for h in (0.0, 6.0, 24.0, 72.0, 168.0, 169.0)], "h double", times.window_name(F.col("h")))] == ["final", "6h", "24h", "72h", "7d", "30d"]


def test_epochs(spark):
    got = [r[0] for r in values(spark, [(1.7e9,), (1.7e12,), (0.0,)], "x double", times.epoch_instant(F.col("x")))]
    assert got[0] == got[1] == dt.datetime(2023, 11, 14, 22, 13, 20) and got[2] is None


def test_normalisation(spark):
    rows = [(60.0, 50.0, 55.0, 10, 1000), (60.0, 50.0, 55.0, 2, 100), (60.0, 0.0, 0.0, 10, 300)]
    score, unsure = rewards.against_baseline(*[F.col(c) for c in "vmpni"])
    assert values(spark, rows, "v double, m double, p double, n long, i long", score, unsure) == [(100.0, pytest.approx(10**-0.5)), (60.0, 0.65), (60.0, 0.35)]


def test_tokens_reach_over_latin_words(spark):
    (tokens,) = values(spark, [("中 abc 文 字 a1",)], "c string", texts.token_list(F.col("c")))[0]
    assert tokens == ["中", "abc", "文", "字", "a1", "中文", "文字", "中文字"]


def test_text_keys(spark):
    rows = [("《歌》 Part 12! https://x.y/z",), (None,)]
    assert [r[0] for r in values(spark, rows, "c string", texts.title_key(F.col("c")))] == ["歌part#", ""]
    assert [r[0] for r in values(spark, [("b|a, b",), ("unknown",)], "c string", texts.diversity_key(F.col("c")))] == ["a|b", ""]
    assert [r[0] for r in values(spark, [("abcabcabc",), ("ab",)], "c string", texts.collapse_repeats(F.col("c")))] == ["abc", "ab"]
    assert [r[0] for r in values(spark, [("haha haha haha haha",), ("fine words",)], "c string", texts.repeats_itself(F.col("c")))] == [True, False]
    assert [r[0] for r in values(spark, [("#a| b;#a",)], "c string", texts.split_values(F.col("c")))] == [["a", "b"]]


def test_hashes_match_python(spark):
    import hashlib

    keys = ["item-1", "作品", ""]
    got = values(spark, [(k,) for k in keys], "k string", hashes.holdout_bucket(F.col("k")), hashes.code_point_sum(F.col("k")), hashes.positional_seed(F.col("k")))
    want = [(int(hashlib.sha256(k.encode()).hexdigest()[:8], 16) % 5, sum(map(ord, k)), sum((i + 1) * ord(c) for i, c in enumerate(k))) for k in keys]
    assert got == want


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    assert [r[0] for r in values(spark, rows, "a array<double>, b array<double>", vectors.cosine(F.col("a"), F.col("b")))] == [1.0, 0.0, 0.0, 0.0]


def test_category_rules_in_order_and_case(spark):
    from tidemark.functions.classifiers import category, hook

    rows = [("幕后 世界杯", None), ("姆巴佩", None), ("great REACTION", None), ("歌手2025", None), ("歌手2025", "song"), ("nothing", "song"), ("nothing", None), ("浪姐", None)]
    df = spark.createDataFrame(rows, "text string, song string")
    got = [r[0] for r in df.select(category(F.col("text"), F.col("song"))).collect()]
    assert got == ["behind_the_scenes", "sports_entertainment", "reaction", "music_variety", "performance_clip", "performance_clip", "unknown", "entertainment_news"]
    assert [r[0] for r in df.select(hook(F.col("text"))).collect()][2] == "reaction"
