"""What is kept and taken must not depend on the order of rows or on how they are dealt."""

import random

import pytest

KIND = "doc_id long, text string, source string, n int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    shared = text(40)
    out = [(7, shared, s, n) for s in ("a", "b", "c", None) for n in range(12)] * 2  # one id and text, four sources, repeated rows
    out += [(8, shared + " ", s, 0) for s in "abc"] + [(None, shared, "a", 1), (None, shared, "b", 1)]
    out += [(i, text(rng.randrange(5, 60)), rng.choice("abc"), i) for i in range(100, 160)]
    out += [(9, None, s, 0) for s in "ab"] + [(9, "", s, 0) for s in "ab"]
    return out


def frames(spark, rows):
    for seed in range(3):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        yield spark.createDataFrame(mixed, KIND).repartition(1 + 3 * seed)


@pytest.mark.parametrize("name", ["mixing_plan", "mixed_documents", "drop_exact_duplicates", "drop_near_duplicates"])
def test_order_does_not_matter(spark, rows, name):
    from tidemark.llm import exact_dedup, mixing, simhash

    f = next(getattr(m, name) for m in (mixing, exact_dedup, simhash) if hasattr(m, name))
    results = [sorted(map(str, map(tuple, f(df).collect()))) for df in frames(spark, rows)]
    assert results[0] == results[1] == results[2] and results[0]


def test_repeats_that_differ_elsewhere_draw_their_own_numbers(spark):
    from tidemark.llm import mixing

    docs = [(1, "a b c d e", "s", n) for n in range(300)] + [(i, "x y z", "t", 0) for i in range(2, 120)]
    df = spark.createDataFrame(docs, KIND).repartition(4)
    plan = mixing.mixing_plan(df)
    target = next(r["target"] for r in plan.collect() if r["doc_id"] == 1)
    taken = [r["n"] for r in mixing.mixed_documents(df).where("doc_id = 1").collect()]
    assert abs(5 * len(taken) - target) < 0.1 * target and len(set(taken)) > 250
