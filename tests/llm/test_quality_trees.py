"""Boosted trees against plain versions, and their accuracy on documents that were held out."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, quality int, toxic int"


def plain_score(trees, x):
    """One row, one node at a time."""
    total = trees.base
    for t in range(len(trees.feature)):
        node = 0
        while trees.child[t, node] != node:
            node = trees.child[t, node] + (1 if x[trees.feature[t, node]] > trees.threshold[t, node] else 0)
        total += trees.value[t, node]
    return 1 / (1 + np.exp(-total))


def test_walk_of_flat_arrays_is_the_plain_walk():
    from tidemark.llm.quality_trees import Trees

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] * x[:, 4] > 0)).astype(float)
    trees = Trees(0.1).fit(x, y, trees=30)
    more = np.concatenate([x, rng.normal(size=(100, 6)), np.zeros((1, 6))])
    assert trees.scores(more) == pytest.approx([plain_score(trees, r) for r in more])
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.97


def test_first_split_is_the_best_of_all():
    from tidemark.llm.quality_trees import LEAST, SMOOTH, Trees

    rng = np.random.default_rng(2)
    for _ in range(8):
        x, y = rng.integers(0, 40, (150, 4)).astype(float), rng.integers(0, 2, 150).astype(float)
        trees = Trees(0.0).fit(x, y, trees=1, depth=1)
        g, h = 0.5 - y, np.full(150, 0.25)
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + SMOOTH)
        gains = [part(x[:, f] <= v) + part(x[:, f] > v) for f in range(4) for v in np.unique(x[:, f])[:-1] if min(h[x[:, f] <= v].sum(), h[x[:, f] > v].sum()) >= LEAST]
        own = x[:, trees.feature[0, 0]] <= trees.threshold[0, 0]
        assert part(own) + part(~own) == pytest.approx(max(gains))
        left = trees.child[0, 0]
        assert trees.value[0, left] == pytest.approx(-0.15 * g[own].sum() / (h[own].sum() + SMOOTH))


def test_statistics_by_hand():
    from tidemark.llm.quality_trees import FEATURES, statistics

    s = dict(zip(FEATURES, statistics(b"AA AA aa b!\n\nAA ## 12|\nAA ## 12|"), strict=True))
    assert s["words"] == pytest.approx(np.log1p(10)) and s["lines"] == pytest.approx(np.log1p(4)) and s["shout"] == 1 / 32
    assert (s["distinct_words"], s["top_word"], s["same_as_last"], s["longest_run"]) == (0.5, 0.4, 0.1, 1)
    assert (s["capital_words"], s["marked_words"], s["bare_marks"]) == (0.4, 0.5, 0.2)
    assert (s["repeated_lines"], s["blank_lines"], s["line_words"]) == (pytest.approx(1 / 3), 0.25, 2.5)
    for raw in (b"", b" \n", b"x", "字é".encode(), b"a" * 300_000, b"a " * 200_000):
        assert len(statistics(raw)) == len(FEATURES) and np.isfinite(statistics(raw)).all()
    assert statistics(b"") == [0.0] * len(FEATURES)


def test_accuracy_on_held_out_documents(spark):
    from tidemark.llm.quality_trees import quality_scores

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_labels_of_held_out_rows_and_other_columns_have_no_say(spark):
    from tidemark.llm.quality_trees import held_out, quality_scores

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    score = lambda a, b: {r["doc_id"]: r["score"] for r in quality_scores(a, b).collect()}
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(1))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1)})
    assert score(docs, labels) == score(other.repartition(3), turned.repartition(2))


def test_quality_edges(spark, monkeypatch):
    from tidemark.llm import quality_trees

    rng = random.Random(1)
    rows = [(i, "bad!! " * rng.randrange(3, 30) if i % 2 else " ".join(rng.choice("some plain good words here now".split()) for _ in range(30)), None, None) for i in range(400)]
    rows += [(None, None, None, None), (None, "x", None, None), (500, "", None, None), (500, "", None, None), (501, "long " * 60_000, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({"text_": F.lit(1), "h": F.lit("z"), "label": F.lit(2), "x": F.lit(3), "quality": F.lit("no")})
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(3, 0, 0), (5, 1, 1), (7, None, 0), (9, 7, 0), (None, 1, 0), (501, 1, 0)], LABELS)
    got = quality_trees.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and quality_trees.quality_scores(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by[i] == 1 - i % 2 for i in range(300, 400))
    assert len({r["score"] for r in got if r["doc_id"] == 500}) == 1
    # a bound on the labelled rows keeps about as many
    monkeypatch.setattr(quality_trees, "FIT_ROWS", 50)
    few = quality_trees.labelled_statistics(docs, labels, rows=50)
    assert 20 <= few.count() <= 90
    # an identifier that stands for many texts does not break the bound
    many = docs.withColumn("doc_id", F.lit(3).cast("long"))
    assert quality_trees.labelled_statistics(many, labels, rows=60).count() <= 100
    # none, and one kind
    assert {r["score"] for r in quality_trees.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    one = quality_trees.quality_scores(docs, labels.where("quality = 1")).collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.9
    assert quality_trees.quality_scores(docs.limit(0), labels).count() == 0
