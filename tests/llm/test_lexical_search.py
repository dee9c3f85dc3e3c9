"""Ranked search against scores of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, k=20):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in found if c)
    words = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in found:
            if not c:
                continue
            m = 75 + 25 * sum(c.values()) * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((s, doc))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, r, doc, s) for r, (s, doc) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, k=20, parts=3):
    from tidemark.llm.lexical_search import ranked_documents

    d, i = spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS)
    got = sorted(map(tuple, ranked_documents(d, i, k).collect()), key=str)
    assert got == brute(docs, items, k)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    common = ["the", "of", "and"]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else vocab[min(299, int(rng.expovariate(0.02)))] for _ in range(n))
    docs = [(i, prose(rng.randrange(1, 80))) for i in range(260)]
    items = [(i, prose(rng.randrange(3, 30))) for i in range(12)]
    docs += [(1000 + j, f"{prose(9)} {items[j % 12][1]} {prose(5)}") for j in range(70)]  # passages of the items
    docs += [(2000 + j, items[3][1]) for j in range(50)]  # ties
    return docs, items


def test_ranks_as_brute_force(spark, corpus):
    docs, items = corpus
    check(spark, docs, items)
    check(spark, docs, items, k=3, parts=7)


def test_small_blocks_of_sums_items_and_batches(spark, corpus, monkeypatch):
    from tidemark.llm import lexical_search

    docs, items = corpus
    monkeypatch.setattr(lexical_search, "CELLS", 40)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lexical_search, "BROADCAST_DOCS", 2)
    check(spark, docs, items)


def test_pruning_looks_few_documents_up(spark, corpus, monkeypatch):
    from tidemark.llm import lexical_search

    docs, items = corpus
    seen = []
    whole = lexical_search._looked_up
    monkeypatch.setattr(lexical_search, "_looked_up", lambda index, chosen, *a: seen.append(chosen.count()) or whole(index, chosen, *a))
    check(spark, docs, items[:1], k=5)
    assert 5 <= seen[0] < len(docs) / 2


def test_search_edges(spark):
    from tidemark.llm.lexical_search import ranked_documents, terms_of

    odd = "Ünï-Code Ünï ÀB 字 字字 a_b A9z \x00x\x7fy it's 1234 İ"
    assert [t.decode() for t in terms_of(odd.encode())] == terms(odd)
    docs = [(1, None), (2, ""), (3, " .,\n"), (None, "apple pear"), (None, "apple"), (4, "Apple APPLE pear"), (4, "apple kiwi"), (5, "apple kiwi"), (5, "apple kiwi"), (5, "apple kiwi"), (6, odd), (7, "long " * 30_000 + "kiwi"), (8, "fig")]
    items = [(1, None), (2, ""), (3, "...absent"), (4, "apple"), (4, "kiwi kiwi apple"), (None, "pear fig"), (6, odd), (6, odd), (7, "long LONG")]
    check(spark, docs, items)
    check(spark, docs, items, k=2, parts=1)
    check(spark, [(i % 7, "same words here") for i in range(90)] + [(i, f"other {i}") for i in range(40)], [(1, "words"), (2, "words other")], parts=4)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("doc_id < 4"), i)):
        assert ranked_documents(a, b).count() == 0
    clash = d.withColumns({"term": F.lit("x"), "impact": F.lit("y"), "h": F.lit(0), "copies": F.lit(None), "score": F.lit(2)})
    assert sorted(map(tuple, ranked_documents(clash, i.withColumn("rank", F.lit(1))).collect()), key=str) == brute(docs, items)
