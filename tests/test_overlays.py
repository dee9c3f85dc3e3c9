"""The nearest search by bounds against all pairs, with blocks that are left out."""

import numpy as np
import pytest

from tidemark.operators import overlays


def brute(targets, history, k):
    out = {}
    for pool, t, own, v in targets:
        sims = []
        for p, s, pref, w in history:
            if p == pool and s != own and v is not None and w is not None:
                a, b = np.array(v), np.array(w)
                na, nb = np.linalg.norm(a), np.linalg.norm(b)
                sim = round(float(a @ b / (na * nb)), 9) if na and nb else 0.0
                if sim > 0:
                    sims.append((-sim, -pref, s))
        for r, (sim, _, s) in enumerate(sorted(sims)[:k], 1):
            out[pool, t, r] = (s, -sim)
    return out


@pytest.mark.parametrize("block, deal", [(40, 4096), (7, 25)])
def test_exact_and_skips_blocks(spark, monkeypatch, block, deal):
    monkeypatch.setattr(overlays, "DEAL", deal)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    point = lambda: (centres[rng.integers(12)] + rng.normal(size=8) * 0.08).tolist()
    history = [(p, i, float(rng.integers(0, 100)), point()) for i, p in enumerate(["a"] * 500 + ["b"] * 60 + ["c"] * 3)]
    history += [("a", 1000 + i, 50.0, history[0][3]) for i in range(12)] + [("a", 2000, 1.0, None), ("a", 2001, 1.0, [0.0] * 8), ("z", 2002, 1.0, point())]
    targets = [("ab"[i % 2], i, i if i % 3 else None, point()) for i in range(90)] + [("a", 500, 0, history[0][3]), ("c", 501, None, point()), ("none", 502, None, point()), ("b", 503, None, None)]
    h = spark.createDataFrame(history, "pool string, sample long, pref double, v array<double>").repartition(4)
    t = spark.createDataFrame(targets, "pool string, target long, own long, v array<double>")
    found, looked = overlays.nearest_in_pools(t, h, k=5, block=block)
    got = {(r["pool"], r["target"], r["rank"]): (r["sample"], r["similarity"]) for r in found.collect()}
    want = brute(targets, history, 5)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1]) for x in want)
    seen = looked.groupBy("visited").count().collect()
    share = {r["visited"]: r["count"] for r in seen}
    assert share[False] > 0.5 * (share[False] + share[True])  # more blocks are left out than looked into


def test_overlays_of_nothing(spark):
    kind = "id long, account string, reward double, v array<double>"
    rows = spark.createDataFrame([(1, "a", 50.0, [1.0, 0.0]), (2, None, None, None)], kind)
    found, looked = overlays.overlay_matches(rows, rows.limit(0), "id", "account", "reward", "v")
    assert found.count() == 0 and looked.count() == 0
    from pyspark.sql import functions as F

    out = overlays.mixed_overlays(rows, {"text": overlays.overlay_scores(found, F.lit(50.0))}, "id", F.lit(50.0)).collect()
    assert {(r["text"], r["mix"], r["scope"]) for r in out} == {(50.0, 50.0, "none")}
