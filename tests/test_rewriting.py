"""Replacement in one pass against a plain scan, and against nested replaces where phrases don't overlap."""

import random
import time

from pyspark.sql import functions as F

from tidemark.functions.rewriting import Phrases, rewritten, transcript_text

#: A few pairs of the script and of hot words, as examples.
PHRASES, LETTERS, HOT = {"壓力": "压力", "節目": "节目", "現場": "现场", "掌聲": "掌声", "夢想": "梦想"}, {"這": "这", "們": "们", "個": "个", "會": "会", "學": "学"}, {"王老级": "王老吉", "白确灵": "白雀羚", "学律": "旋律"}


def plain(text, phrases, letters):
    out, i = "", 0
    while i < len(text):
        own = max((p for p in phrases if p and text.startswith(p, i)), key=len, default=None)
        out += phrases[own] if own else letters.get(text[i], text[i])
        i += len(own) if own else 1
    return out


def test_longest_first_of_overlapping_phrases():
    rng = random.Random(6)
    for _ in range(300):
        word = lambda n: "".join(rng.choice("abc]^-\\") for _ in range(rng.randrange(n)))
        phrases = {word(5): word(4) for _ in range(rng.randrange(8))}
        letters = {c: c.upper() for c in rng.sample("abc", rng.randrange(3))}
        text = word(60)
        assert Phrases(phrases, letters)(text) == plain(text, phrases, letters), (phrases, text)


def test_long_texts_are_linear():
    rules = Phrases({f"w{i}": f"<{i}>" for i in range(3000)} | {"aaaaaaab": "x"}, {"q": "Q"})
    took = []
    for n in (200_000, 800_000):
        start = time.perf_counter()
        rules("w17 plain text q " * (n // 16) + "a" * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] and took[1] < 20


def test_transcript_texts(spark):
    said = [" 王老级 ", "提醒您合作伙伴白确灵", "這次我壓力很大 你們這個節目太會搞事情", "最初的夢想學律想起的時候 現場掌聲很多", "a 　 b ， c", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    got = [r["t"] for r in df.select("i", transcript_text(F.col("t"), PHRASES, LETTERS, HOT).alias("t")).orderBy("i").collect()]
    assert got == ["王老吉", "提醒您合作伙伴白雀羚", "这次我压力很大 你们这个节目太会搞事情", "最初的梦想旋律想起的時候 现场掌声很多", "a b， c", "", ""]
    assert [r[0] for r in df.select(rewritten(F.col("t"), {}, {})).collect()] == said
    assert df.select(rewritten(F.col("t"), {"王": "W"}).alias("t")).where("t is null").count() == 1
