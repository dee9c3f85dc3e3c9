"""Licence scans of texts that repeat notices, against brute force over every run of words, and of long texts."""

import random
import re
import time

import pytest

LETTERS = "a b c d e f g h".split()


def pairs(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(zip(words, words[1:], strict=False))


def best(text, templates, threshold):
    """The greatest coefficient over all runs of bigrams, with the name that comes first; (0, None) below the threshold."""
    grams, top = pairs(text), (0.0, None)
    for name in sorted(templates):
        own = set(pairs(templates[name]))
        for a in range(len(grams)):
            run = set()
            for g in grams[a:]:
                run.add(g)
                f = 2 * len(run & own) / (len(run) + len(own))
                if f > top[0] + 1e-12:
                    top = (f, name)
    return top if top[0] >= threshold - 1e-12 else (0.0, None)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_repeated_and_broken_notices(spark, threshold):
    """Texts of few words, so that bigrams repeat within templates, runs and texts."""
    from tidemark.llm.licenses import license_matches

    rng = random.Random(int(threshold * 10))
    words = lambda k, n: " ".join(rng.choice(LETTERS[:k]) for _ in range(n))
    templates = {"one": words(8, 12), "two": words(4, 9), "three": words(8, 30), "four": "a b a b c"}
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            body = rng.choice(list(templates.values())).split()
            for _ in range(rng.randrange(0, 4)):
                body.insert(rng.randrange(len(body)), rng.choice(LETTERS + ["x", "y"]))
            if rng.random() < 0.5:
                cut = rng.randrange(len(body))
                body = body[cut:] + body[:cut]
            parts += [" ".join(body), rng.choice([words(8, 3), "x", "la " * rng.randrange(1, 40), ""])]
        rows.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in license_matches(df, templates, threshold).collect()}
    wanted = [best(t, templates, threshold) for t in rows]
    assert sum(name is not None for _, name in wanted) > 30
    for i, (score, name) in enumerate(wanted):
        assert got[i]["score"] == pytest.approx(score), rows[i]
        assert got[i]["license"] == name, rows[i]


def test_time_is_linear_in_a_text_that_repeats_a_licence(spark):
    """500 copies of a licence, one file of many notices with their own owners, and a split notice with one word 100,000 times in it."""
    from tidemark.llm.licenses import BODIES, license_matches

    rng = random.Random(5)
    owner = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(3))
    copies = " ".join(f"{BODIES['MIT']} {owner()}" for _ in range(500))
    notices = ""
    while len(notices) < 1_000_000:
        name = rng.choice(sorted(BODIES))
        notices += f"Copyright {owner()}\n{BODIES[name]}\n"
    half = BODIES["MIT"].split()
    split = " ".join(half[:80]) + " la" * 100_000 + " " + " ".join(half[80:])
    df = spark.createDataFrame([("copies", copies), ("notices", notices), ("split", split)], "doc_id string, text string")
    license_matches(spark.createDataFrame([("short", "Released under the MIT License.")], df.schema)).collect()
    took, got = {}, {}
    for name in ("copies", "notices", "split"):
        began = time.monotonic()
        got[name] = license_matches(df.where(f"doc_id = '{name}'")).collect()[0]
        took[name] = time.monotonic() - began
    assert got["copies"]["license"] == "MIT" and got["copies"]["score"] == 1.0
    assert got["notices"]["score"] == 1.0
    own = set(pairs(BODIES["MIT"]))
    assert got["split"]["license"] == "MIT" and got["split"]["score"] == pytest.approx(best_split(own, split))
    print(took)
    assert max(took.values()) < 60, took


def best_split(own, text):
    run = set(pairs(text))
    return 2 * len(run & own) / (len(run) + len(own))
