"""Whitening against plain integers and a plain eigen-decomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F


def brute(vectors, components=8):
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[j] for row in x) for j in range(d)]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    dev = [sum((n * row[j] - s[j]) ** 2 for j in range(d)) for row in x]
    centred = np.array([[float(Fraction(n * row[j] - s[j], n)) for j in range(d)] for row in x])
    return n, dev, (centred @ w / np.sqrt(np.where(e > 0, e, np.nan)))[:, :components], e / np.trace(v)


def check(rows, vectors, components=8):
    n, dev, white, explained = brute(vectors, components)
    by = {}
    for r in rows:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert set(by) == set(range(1, min(components, len(vectors[0])) + 1))
    for k, found in by.items():
        sign = np.sign(found[0]["whitened"] * white[0, k - 1]) or 1
        for i, r in found.items():
            assert r["n"] == n and r["deviation_digits"] == str(dev[i]) and r["deviation"] == (dev[i] if dev[i] < 1 << 63 else None)
            assert r["whitened"] * sign == pytest.approx(white[i, k - 1], abs=1e-6)
            assert r["explained"] == pytest.approx(explained[k - 1], rel=1e-6)
            assert r["identity_error"] < 1e-6


@pytest.mark.parametrize("spread", [1.0, 3e5])
def test_whitening_is_exact(spark, spread):
    from tidemark.llm.whitening import whitened_vectors

    rng = random.Random(3)
    vectors = [[rng.gauss(j, spread * (j + 1)) for j in range(12)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    check(whitened_vectors(df).collect(), vectors)


def test_huge_entries_keep_every_digit(spark):
    from tidemark.llm.whitening import as_integers, exact_sums, whitened_vectors

    rng = random.Random(4)
    y = np.array([[rng.randrange(-(10**40), 10**40) for _ in range(5)] for _ in range(30)], object)
    sums, cross = exact_sums(y)
    assert list(sums) == [sum(y[:, j]) for j in range(5)] and all(cross[i, j] == sum(y[:, i] * y[:, j]) for i in range(5) for j in range(5))
    low = np.array([[rng.randrange(-(2**61), 2**61) for _ in range(3)] for _ in range(9000)])
    assert [int(v) for v in exact_sums(low)[0]] == [sum(low[:, j].tolist()) for j in range(3)]
    assert exact_sums(low)[1][0, 1] == sum(a * b for a, b in low[:, :2].tolist())
    assert as_integers(np.array([[1e300, -0.5]])).tolist() == [[int(1e300) * 1024, -512]]
    vectors = [[rng.gauss(0, 1e25), rng.gauss(0, 4e24), rng.gauss(1, 5e23)] for _ in range(20)]
    check(whitened_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect(), vectors)


def test_whitening_edges(spark, monkeypatch):
    from tidemark.llm import whitening

    rng = random.Random(5)
    kind = "vec_id long, embedding array<float>, n int, component string, c string, part string"
    plain = [[float(np.float32(rng.gauss(0, 1))) for _ in range(4)] for _ in range(20)]
    odd = [[rng.random() for _ in range(2)] for _ in range(9)]
    rows = [(i, v, 1, "x", None, "y") for i, v in enumerate(plain)]
    rows += [(50, None, 1, "x", None, "y"), (51, [1.0, None, 0.0, 1.0], 1, "x", None, "y"), (52, [1.0, float("nan"), 0.0, 1.0], 1, "x", None, "y"), (53, [1.0, float("inf"), 0.0, 1.0], 1, "x", None, "y"), (54, [], 1, "x", None, "y"), (55, [1.0, 2.0, 3.0], 1, "x", None, "y")]
    df = spark.createDataFrame(rows, kind).repartition(4)
    got = whitening.whitened_vectors(df).collect()
    assert {r["vec_id"] for r in got} == set(range(20))
    check(got, plain)
    # a second length is a fit of its own, also where the models are broadcast one after the other
    more = df.unionByName(spark.createDataFrame([(100 + i, v, 1, "x", None, "y") for i, v in enumerate(odd)], kind))
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)
    both = whitening.whitened_vectors(more).collect()
    check([r for r in both if r["vec_id"] < 100], plain)
    assert {r["n"] for r in both if r["vec_id"] >= 100} == {9} and len(both) == 20 * 4 + 9 * 2
    # repeated rows count; a null identifier is carried; empty, single and equal vectors have no components
    twice = whitening.whitened_vectors(df.unionByName(df)).collect()
    assert len(twice) == 160 and {r["n"] for r in twice} == {40}
    assert {r["vec_id"] for r in whitening.whitened_vectors(df.withColumn("vec_id", F.lit(None).cast("long"))).collect()} == {None}
    for few in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 1").unionByName(df.where("vec_id = 1")), df.where("vec_id > 40")):
        assert whitening.whitened_vectors(few).count() == 0


def test_merging_partial_sums_keeps_the_result(spark):
    from tidemark.llm.whitening import scatter

    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)], "vec_id long, embedding array<double>")
    one, many = ({r["place"]: r for r in scatter(df.repartition(p)).collect()} for p in (1, 40))
    assert one == many
