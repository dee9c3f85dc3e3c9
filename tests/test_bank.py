"""Prototype fits that stop early, against all prototypes compared."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bank

WORDS = [f"w{i}" for i in range(40)]


def test_early_stop_keeps_the_best(spark, monkeypatch):
    monkeypatch.setattr(bank, "STRIDE", 2)
    monkeypatch.setattr(bank, "DEAL", 7)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    protos = [(f"{a}", f"p{i:02d}", rng.uniform(0, 100), rng.random(), [rng.choice(WORDS) for _ in range(rng.randrange(13))], text(6)) for a in "ab" for i in range(30)] + [("c", "only", 0.0, 0.0, [], "")]
    targets = [(i, rng.choice("abcd"), text(rng.randrange(1, 12))) for i in range(60)] + [(90, "a", None), (91, None, "w1"), (92, "a", "...")]
    b = spark.createDataFrame(protos, "account string, name string, avg_score double, confidence double, keywords array<string>, said string")
    b = b.withColumn("id", F.concat("account", "name"))
    b = b.join(bank.dense_vectors(b, "id", F.col("said")), "id", "left")
    t = spark.createDataFrame(targets, "k long, account string, t string")
    got = {}
    for r in bank.prototype_fits(t, b, "k", "account", "t", k=3).collect():
        got[r["k"], r["rank"]] = (r["name"], r["fit"])
    dense = lambda df, key, c: {r[key]: np.array(r["v"]) for r in bank.dense_vectors(df, key, F.col(c)).collect()}
    tv, pv, want = dense(t, "k", "t"), dense(b, "id", "said"), {}
    for k, account, said in targets:
        fits = []
        for a, name, score, trust, words, _ in protos:
            if a == account:
                x, y, low = tv.get(k), pv.get(a + name), (said or "").lower()
                cos = max(0.0, float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))) if x is not None and y is not None else 0.0
                over = min(1.0, sum(w in low for w in words[:10]) / max(3, min(10, len(words)))) if low and words else 0.0
                fits.append((-round(max(cos, over) * score * (0.65 + 0.35 * trust), 9), name))
        for rank, (fit, name) in enumerate(sorted(fits)[:3], 1):
            want[k, rank] = (name, -fit)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-6) for x in want)
