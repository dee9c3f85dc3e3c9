"""The corpus operators on small tables, against brute force; nulls, empty and repeated rows, ties, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, shared passages, near copies, nulls, empty and odd texts."""
    rng = random.Random(5)
    shared, base = prose(rng, 60), prose(rng, 80)
    out = [prose(rng, rng.randrange(1, 150)) for _ in range(25)]
    out += [base] * 4 + [base.replace(" ", "  ", 3), base + " end", " " + base.upper()]
    out += [f"{prose(rng, 20)} {shared} {prose(rng, 9)}" for _ in range(4)] + [shared + " " + shared]
    out += [None, "", "", " \n\t", "x", "a a a " * 40, "a b " * 90 + "c", "é " * 50, "word\u00a0joined \u3000 wide", "<|endoftext|> it's 1234 <|endof text|>", prose(rng, 3000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s3"][i % 4], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ------------------------------------------------------------------ mixing


def test_mixing_targets_and_copies(spark):
    from tidemark.llm.mixing import mixed_documents, mixing_plan

    rng = random.Random(2)
    rows = [(i, prose(rng, 20), None, s, 0) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 200 + [None] * 60)]
    df = spark.createDataFrame(rows, DOCS)
    plan = mixing_plan(df).collect()
    sizes, target, taken = Counter(), {}, Counter()
    for r, (_, text, _, s, _) in zip(sorted(plan, key=lambda r: r["doc_id"]), rows, strict=True):
        assert r["size"] == len(WORD.findall(text)) and r["taken"] in (r["size"] * k for k in range(4))
        sizes[s] += r["size"]
        target[s] = r["target"]
        taken[s] += r["taken"]
    assert all(r["source_size"] == sizes[rows[r["doc_id"]][3]] for r in plan)
    weights, total = {"a": 5, "b": 2, "c": 1, None: 5}, sum(sizes.values())
    capped: set = set()
    while True:  # share the excess anew until none is above
        open_ = [s for s in weights if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weights[s] for s in open_)
        more = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    want = {s: 3 * sizes[s] if s in capped else level * weights[s] for s in weights}
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) < 0.1 * want[s] for s in want)
    assert sorted(r["taken"] for r in mixing_plan(df.repartition(5)).collect()) == sorted(r["taken"] for r in plan)
    mixed = Counter(r["doc_id"] for r in mixed_documents(df).collect())
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})


def test_mixing_of_repeated_rows_comes_near_the_target(spark):
    from tidemark.llm import mixing

    rows = [(1, "a b c d e", None, "a", 0)] * 200 + [(2, "a b c", None, "b", 0)] * 100 + [(i, "x y", None, "b", 0) for i in range(3, 20)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    plans = [mixing.mixing_plan(x).collect() for x in (df, df.repartition(3))]
    assert sorted(map(tuple, plans[0])) == sorted(map(tuple, plans[1]))
    taken = sum(r["taken"] for r in plans[0] if r["doc_id"] == 1)
    target = next(r["target"] for r in plans[0] if r["doc_id"] == 1)
    assert abs(taken - target) < 0.1 * target
    assert mixing.mixed_documents(df).count() == sum(r["copies"] for r in plans[0])


def test_mixing_edges(spark, docs):
    from tidemark.llm import mixing

    assert mixing.mixing_plan(docs.limit(0)).count() == 0
    assert mixing.mixing_plan(docs.where("text is null or text = ''")).agg(F.sum("taken")).first()[0] == 0
    clash = docs.withColumn("target", F.lit("t")).withColumn("size", F.lit(1)).withColumn("weight", F.lit(0)).withColumn("__size", F.lit(5)).withColumn("__nth", F.lit(5))
    assert mixing.mixing_plan(clash).count() == docs.count()
    assert mixing.mixed_documents(clash).columns == clash.columns


def test_mixing_with_many_sources_is_the_same(spark, docs, monkeypatch):
    from tidemark.llm import mixing

    want = sorted(map(tuple, mixing.mixing_plan(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, mixing.mixing_plan(docs).collect()), key=str) == want


# ------------------------------------------------------------------ exact dedup


def brute_groups(texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    return groups


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_dedup(docs, texts, digest_chars):
    from tidemark.llm.exact_dedup import exact_duplicates

    got = table(exact_duplicates(docs.withColumn("digest", F.lit(1)).withColumn("rows", F.lit(2)), digest_chars=digest_chars))
    assert len(got) == len(texts)
    for squeezed, ids in brute_groups(texts).items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), i == keep)
            assert r["text_sha256"] == hashlib.sha256(squeezed.encode()).hexdigest()


def test_exact_dedup_salts_hot_groups(spark, monkeypatch):
    from tidemark.llm import common, exact_dedup

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    df = spark.createDataFrame([(i, "same text" if i < 40 else f"own {i}", None, None, 0) for i in range(60)], DOCS)
    got = table(exact_dedup.exact_duplicates(df))
    assert [got[i]["group_size"] for i in (0, 39, 40)] == [40, 40, 1]


def test_exact_dedup_memtable_flushes(spark, docs):
    from functools import partial

    from tidemark.llm.exact_dedup import compact, flush_runs

    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("digest"), F.col("id").alias("points"), F.col("id").alias("doc_id")).coalesce(1)
    runs = rows.mapInArrow(partial(flush_runs, most=3), "digest string, points long, doc_id long, rows long")
    assert runs.count() > 7
    assert {r["digest"]: (r["keep_id"], r["rows"]) for r in compact(runs).collect()} == {str(k): (max(range(k, 100, 7)), len(range(k, 100, 7))) for k in range(7)}


def test_drop_exact_duplicates(docs, texts):
    from tidemark.llm.exact_dedup import drop_exact_duplicates

    wide = docs.withColumn("digest", F.lit("x"))
    out = drop_exact_duplicates(wide.union(wide.where("doc_id = 3")))
    assert out.columns == wide.columns
    want = sorted(min(ids, key=lambda i: (-len(texts[i] or ""), i)) for ids in brute_groups(texts).values())
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_exact_dedup_of_nothing(docs):
    from tidemark.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    assert exact_duplicates(docs.limit(0)).count() == 0 and drop_exact_duplicates(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ SimHash


def brute_fingerprint(text, width=3):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_components(docs, texts):
    from tidemark.llm.simhash import drop_near_duplicates, near_duplicates

    prints = [brute_fingerprint(t) for t in texts]
    got = table(near_duplicates(docs.withColumn("fp", F.lit("x")).withColumn("n", F.lit(0))))
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = brute_components(prints)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in drop_near_duplicates(docs).collect()) == sorted(set(want))
    assert near_duplicates(docs.limit(0)).count() == 0 == drop_near_duplicates(docs.limit(0)).count()


@pytest.mark.parametrize("broadcast", [400_000, 0])
def test_near_duplicates_are_told_apart_by_id_and_text(spark, monkeypatch, broadcast):
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "BROADCAST_MARKS", broadcast)
    rng = random.Random(4)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (1, a), (7, c), (7, c.upper()), (None, a), (None, "alone " + b[:9]), (9, None)]
    df = spark.createDataFrame([(*r, None, None, 0) for r in rows], DOCS).withColumn("__stays", F.lit(1)).withColumn("root", F.lit("x"))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    seven = [t for i, t in got if i == 7]
    assert len(seven) == 1 and seven[0] in (c, c.upper())
    assert [g for g in got if g[0] != 7] == sorted([(1, a), (5, b), (None, "alone " + b[:9]), (9, None)], key=str)


@pytest.mark.parametrize(("shard_rows", "most"), [(40, 4096), (8192, 4096), (12, 3)])
def test_vantage_point_shards_lose_no_link(spark, monkeypatch, shard_rows, most):
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(simhash, "MOST_SHARDS", most)  # 3: shards are split by trees of their own
    monkeypatch.setattr(simhash, "TOO_LARGE", 2)
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):  # chains and clusters of neighbours
        p = rng.choice(prints)
        for _ in range(rng.randrange(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df, len(prints))).collect()}
    names = sorted(range(len(prints)), key=lambda i: signed[i])
    comp = brute_components([prints[i] for i in names])
    want = {signed[names[k]]: signed[names[c]] for k, c in enumerate(comp)}
    assert {p: got.get(p, p) for p in signed} == want


def test_components_of_a_long_chain(spark):
    from tidemark.llm.simhash import components

    edges = spark.range(60).select((F.col("id") * 7 % 61).alias("a"), ((F.col("id") + 1) * 7 % 61).alias("b"))
    assert {r["root"] for r in components(edges).collect()} == {0}


# ------------------------------------------------------------------ nearest neighbours


def brute_nearest(rows, queries, k):
    out = {}
    for q, v in rows:
        if q in queries:
            d = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)
            out[q] = d[:k]
    return out


def test_nearest_neighbours_recall_and_order(spark):
    from tidemark.llm import permutation_ann as ann

    rng = np.random.default_rng(4)
    centre = rng.normal(size=(8, 24))
    rows = [(i, (centre[i % 8] + 0.5 * rng.normal(size=24)).tolist()) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(30)]  # ties at distance 0
    bad = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0] * 23 + [None]), (2004, [float("inf")] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), pivots=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = [(i, np.float32(v).astype(float)) for i, v in rows]
    want = brute_nearest(rows, set(range(0, 930, 20)), 10)
    assert set(got) == set(want)
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        for _, i, d in found:
            assert d == pytest.approx(float(np.sqrt(((rows[i][1] - rows[q][1]) ** 2).sum())), abs=1e-12)
        hits += len({f[1] for f in found} & {i for _, i in want[q]})
        total += 10
    assert hits / total >= 0.9
    assert [f[1] for f in got[0]] == list(range(900, 910))


def test_nearest_neighbours_edges(spark):
    from tidemark.llm.permutation_ann import nearest_neighbours

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in nearest_neighbours(df, df.where("vec_id < 2")).orderBy("query_id").collect()] == [(0, 1), (1, 0)]
    rng = np.random.default_rng(6)  # every length takes part, also one that few have, and repeated and null identifiers
    rows = [(i, rng.normal(size=2 + (i % 50 == 0)).tolist()) for i in range(200)] + [(0, [5.0, 5.0]), (None, [1.0, 1.0])]
    mixed = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("turn", F.lit("x"))
    got = defaultdict(set)
    for r in nearest_neighbours(mixed, mixed.where("vec_id % 50 = 0 or vec_id % 51 = 0"), k=3).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert got[50] == {0, 100, 150} and len(got[51]) == 3 and set(got) == {0, 50, 100, 150, 51, 102, 153}
    assert nearest_neighbours(df.limit(0), df).count() == 0


def test_nearest_neighbours_over_blocks(spark, monkeypatch):
    from tidemark.llm import permutation_ann as ann

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    one = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=3).collect()}
    monkeypatch.setattr(ann, "FILE_ROWS", 100)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 7)
    many = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=3).collect()}
    assert sum(one[k] == many[k] for k in one) >= 0.9 * len(one) == 0.9 * len(many)
    monkeypatch.setattr(ann, "LEAST_PER_PIVOT", 8)
    monkeypatch.setattr(ann, "ASK_LEAST", 1)
    monkeypatch.setattr(ann, "ASK_SHARE", 0.01)
    monkeypatch.setattr(ann, "POST", 1)
    monkeypatch.setattr(ann, "WAVE_LEAST", 1000)
    far = ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=40)  # one file holds fewer, so all are asked
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = defaultdict(list)
    for r in far.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert all(len(v) == 40 for v in got.values()) and len(got) == 15
    want = brute_nearest(rows, set(got), 40)
    assert sum(got[q] == [i for _, i in want[q]] for q in got) >= 10


# ------------------------------------------------------------------ URL rules


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark, monkeypatch):
    from tidemark.llm import url_rules
    from tidemark.llm.queries import URL_RULES

    monkeypatch.setattr(url_rules, "SAMPLE_PER_RANGE", 3)
    rules = [*URL_RULES, ("block", "deep.www.example.com", ""), ("block", "xcom", "/")]
    rng = random.Random(9)
    hosts = ["example.com", "www.Example.COM", "a.deep.www.example.com", "example.net", "net", "com", "xexample.com", "x.xcom", "example.org", "", "com.", "example.com:80"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/x', '/fr/?a=/', '#/en/', '?x=://net/es/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://", "a://b://c/en/"] + ["https://hot.example.com/en/1"] * 200
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = table(url_rules.judged_urls(df, url_rules.rule_table(spark, rules)), "page_id")
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == brute_verdict(u, rules), u


def test_url_rules_of_nothing(spark):
    from tidemark.llm import url_rules

    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = url_rules.rule_table(spark, [("block", "a.com", "/")]).limit(0)
    assert url_rules.judged_urls(df, none, default="block").first()["verdict"] == "block"
    assert url_rules.judged_urls(df.limit(0), none).count() == 0


# ------------------------------------------------------------------ BPE


def test_bpe_equals_the_library(docs, texts):
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import encoded
    from tidemark.llm.queries import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    got = table(encoded(docs.withColumn("ids", F.lit(1)), tokenizer_path(), with_ids=True))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encoded(docs.limit(0), tokenizer_path()).count() == 0


def test_bpe_chunks_repair_their_joints():
    from tokenizers import Tokenizer

    from tidemark.llm.bpe import Codec
    from tidemark.llm.queries import tokenizer_path

    codec, library, rng = Codec(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), random.Random(0)
    parts = ["a", "é", " ", "  ", "\n", " \n ", "'s", "<|endoftext|>", "12", "!?", "\u3000", "日本", "\xa0", "Word", " the", "\t", "€", "😀", "，", "。", "語", "、a", "“q”", " слово"]
    for n in range(160):
        own = [parts, [p for p in parts if max(map(ord, p)) < 0x400], ["日本語", "，", "。", "語", "！", "12", " "], [" слово", " ещё", ", ", "“", "”", " and"]][n % 4]
        text = "".join(rng.choice(own) for _ in range(rng.randrange(0, 3000)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids
        assert codec.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)
    shared = " ".join(f"слово{i % 97} “quoted” word{i * i % 89}" for i in range(900))
    for n in range(4):  # a long passage of other scripts within different texts is encoded once
        text = f"Own beginning {n} {'x' * n} {shared} and end {n}."
        codec.asked = codec.reused = 0
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert n == 0 or codec.reused > 0.9 * codec.asked


# ------------------------------------------------------------------ licences


def test_licenses(spark):
    from tidemark.llm.licenses import TEMPLATES, license_matches

    rng = random.Random(1)
    rows = [None, "", "one", "MIT License"] + [f"{prose(rng, 30)}\n{t.upper()}\n{prose(rng, 10)}" for t in TEMPLATES.values()] + ["Released under the BSD License."]
    rows += ["This library is free software; you can redistribute it\nunder the terms of the GNU Lesser General Public License, version 2.1."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = table(license_matches(df))
    assert [got[i]["license"] for i in range(4)] == [None] * 4
    assert [got[4 + k]["license"] for k in range(len(TEMPLATES))] == list(TEMPLATES)
    assert got[4 + len(TEMPLATES)]["license"] is None  # 2 of 4 bigrams
    assert got[len(rows) - 1]["license"] == "LGPL-2.1"

    def bigrams(s):
        w = re.sub(r"[^\w]|_", " ", s.lower()).split()
        return {(a, b) for a, b in zip(w, w[1:], strict=False)}

    for i, t in enumerate(rows):
        best = max((2 * len(bigrams(x) & bigrams(b)) / max(1, len(bigrams(x)) + len(bigrams(b))) for x in [*(t or "").split("\n"), t or ""] for b in TEMPLATES.values()))
        assert got[i]["score"] == pytest.approx(best if best >= 0.8 else 0.0)
    assert license_matches(df.limit(0)).count() == 0


def test_licenses_in_all_runs_of_words(spark):
    """Wrapped, commented, inline and repeated notices, against brute force over every run of words."""
    from tidemark.llm.licenses import BODIES, TEMPLATES, license_matches

    rng = random.Random(3)
    comment = lambda t, n: "\n".join("# " + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = ["Released under the\n# MIT License.", f"{prose(rng, 20)} Released under the MIT License. {prose(rng, 20)}"]
    rows += [f"{prose(rng, 8)}\n{comment(t, 4)}\n{prose(rng, 8)}" for t in TEMPLATES.values()]
    rows += ["Released under the under the under the under the MIT license", "released under mit license, the MIT License", "under the mit released under the new MIT x License"]
    rows += [f"Released under the MIT License. {prose(rng, 3)} " * 5, "licensed under the apache\nlicense version 3.0 or licensed under the Apache x License, version 2.0"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(2)
    got = table(license_matches(df, TEMPLATES))
    pairs = lambda w: list(zip(w, w[1:], strict=False))
    split = lambda s: re.sub(r"[\W_]+", " ", s.lower()).split()
    own = {n: set(pairs(split(b))) for n, b in TEMPLATES.items()}
    for i, t in enumerate(rows):
        g = pairs(split(t))
        best = max((2 * len(s & o) / (len(s) + len(o)), n) for a in range(len(g)) for b in range(a + 1, len(g) + 1) for s in [set(g[a:b])] for n, o in own.items())
        assert got[i]["score"] == pytest.approx(best[0] if best[0] >= 0.8 else 0.0), t
        assert (got[i]["license"], got[i]["n_lines"] > 0) == ((best[1], True) if best[0] >= 0.8 else (None, False)), t
    bodies = spark.createDataFrame([(n, f"{prose(rng, 30)}\n{comment(b, 9)}\n{prose(rng, 30)}") for n, b in BODIES.items()], "doc_id string, text string")
    assert [(r["doc_id"], r["license"], r["score"]) for r in license_matches(bodies).orderBy("doc_id").collect()] == [(n, n, 1.0) for n in sorted(BODIES)]


# ------------------------------------------------------------------ language ID


def test_language_id_learns_and_declines(spark, data):
    from tidemark.llm.gru_langid import predicted_languages

    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, 0), (-2, "", "en", None, 0), (-3, "12 ?! 34", "en", None, 0)], docs.schema)
    pred = table(predicted_languages(docs.union(odd).withColumn("score", F.lit(1))))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    import zlib

    assert all(p["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, p in pred.items())
    held = [i for i, p in pred.items() if p["held_out"] and i >= 0]
    assert np.mean([pred[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert [(pred[i]["lang_pred"], pred[i]["score"]) for i in (-1, -2, -3)] == [("und", 0.0)] * 3
    assert all(0 <= p["score"] <= 1 for p in pred.values())


def test_language_id_without_labels(docs):
    from tidemark.llm.gru_langid import predicted_languages

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in predicted_languages(bare).collect()} == {"und"}


def test_language_id_fits_every_label_to_different_texts(spark, monkeypatch):
    from tidemark.llm import gru_langid

    seen = {}
    monkeypatch.setattr(gru_langid.ByteGru, "fit", lambda self, windows, labels, *rest: seen.update(windows=windows, labels=labels) or self)
    rows = [(i, f"text {i} of many", f"l{i % 70:02}") for i in range(700)] + [(1000 + i, f"copy {i % 3}", "l00") for i in range(3000)]
    net = gru_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert net.langs == [f"l{i:02}" for i in range(70)]
    first = {bytes(w).rstrip(b"\0").decode() for w, k in zip(seen["windows"], seen["labels"], strict=True) if k == 0}
    assert len(first) > 3 and {"copy 0", "copy 1", "copy 2"} < first


def test_gru_gradients():
    from tidemark.llm.gru_langid import ByteGru

    rng = np.random.default_rng(0)
    net = ByteGru(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(1, 255, (9, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    ones = np.ones(x.shape)
    _, grads = net.gradients(x, y, ones)
    for k, p in net.p.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), p.shape)
        old, e = p[at], 1e-4
        p[at] = old + e
        up = net.gradients(x, y, ones)[0]
        p[at] = old - e
        down = net.gradients(x, y, ones)[0]
        p[at] = old
        assert grads[k][at] == pytest.approx((up - down) / (2 * e), rel=2e-2), k


# ------------------------------------------------------------------ substring dedup


def brute_kept(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "block", "hot"), [(35, 12, 4000), (6, 3, 4000), (4, 4, 4000), (35, 12, 2), (6, 3, 2)])
def test_substring_dedup(docs, texts, monkeypatch, window, block, hot):
    from tidemark.llm import substring_dedup
    from tidemark.llm.substring_dedup import repeated_word_spans

    monkeypatch.setattr(substring_dedup, "HOT_PLACES", hot)
    monkeypatch.setattr(substring_dedup, "LIST_WINDOWS", 3)
    monkeypatch.setattr(substring_dedup, "BROADCAST_WINDOWS", 0 if window == 6 else 200_000)
    got = table(repeated_word_spans(docs.withColumn("block", F.lit(1)).withColumn("k1", F.lit(1)), window, block))
    want = brute_kept(texts, window)
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) for i in range(len(texts))] == want
    assert all(sum(b - a for a, b in got[i]["spans"]) == want[i][1] for i in got)
    words = [WORD.findall(t or "") for t in texts]
    factors = [(i, f) for i in got for f in got[i]["factors"]]
    assert factors and all(f["length"] >= window for _, f in factors)
    for i, f in factors:  # a factor's words are its source's, and not just those of its own place
        if f["source_start"] is not None:
            assert (i, f["start"]) != (f["source"], f["source_start"])
            assert words[i][f["start"] : f["start"] + f["length"]] == words[f["source"]][f["source_start"] : f["source_start"] + f["length"]]


def test_greedy_factors_are_longest_and_checked_over_their_boundaries():
    from tidemark.llm.substring_dedup import parse

    w = [f"{c}".encode() for c in "abcdefghijklmnop"]
    one, two, both = w[:8], w[5:14], w[:14]
    got = list(parse([(one, 1), (two, 1), (both, 1)], 4))
    assert (2, 0, 8, 0, 0) in got and (2, 5, 9, 1, 0) in got  # two factors that overlap; the windows between them are covered
    assert (0, 0, 8, 2, 0) in got and (1, 0, 9, 2, 5) in got
    apart = list(parse([(w[:5], 1), (w[5:10], 1), (w[:10], 1)], 4))
    assert [(i, n) for r, i, n, _, _ in apart if r == 2] == [(0, 5), (5, 5)]  # no window over the boundary stands elsewhere
    assert list(parse([([b"a"] * 7, 1)], 3)) == [(0, 0, 6, 0, 1), (0, 4, 3, 0, 0)]


def test_substring_dedup_of_repeated_and_no_rows(spark, docs):
    from tidemark.llm.substring_dedup import repeated_word_spans

    rng = random.Random(8)
    one = spark.createDataFrame([(1, prose(rng, 50), None, None, 0)], DOCS)
    assert [r["n_removed"] for r in repeated_word_spans(one).collect()] == [0]
    assert [r["n_removed"] for r in repeated_word_spans(one.union(one)).collect()] == [50, 50]
    assert repeated_word_spans(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ WARC


@pytest.fixture(scope="module")
def pages(spark):
    body = "<html>" + "x" * 200
    rows = [(5, "http://a/", body), (3, "http://b/", body), (9, "http://c/\r\nX: y", "é" * 60), (4, None, "é" * 60), (1, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (6, "u", "big " * 100_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))


def test_page_archive(pages):
    from tidemark.llm.warc import page_archive

    got = table(page_archive(pages), "page_id")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 4), 4: ("response", None), 1: ("response", None), 2: ("response", None), 7: ("response", None), 8: ("response", None), 6: ("response", None)}
    for i, r in got.items():
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html[i].encode()), hashlib.sha256(html[i].encode()).hexdigest())
    assert page_archive(pages.limit(0)).count() == 0


def test_warc_reads_back_texts_and_pushes_filters(spark, pages, tmp_path):
    from tidemark.llm.warc import archived

    back = archived(pages, f"file://{tmp_path}/w")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    number = lambda r: int(r["record_id"].rsplit(":", 1)[1].rstrip(">"))
    found = {number(r): r for r in back.collect()}
    assert all(bytes(r["payload"] or b"").decode() == html[i] for i, r in found.items() if r["record_type"] == "response")
    assert found[9]["target_uri"] == "http://c/X: y"
    assert {number(r) for r in back.where("record_type = 'revisit'").collect()} == {5, 9}
    assert found[5]["record_id"] == "<urn:page:5>" and found[5]["headers"]["WARC-Date"].endswith("Z")
    assert back.where(F.col("headers")["WARC-Target-URI"] == "http://a/").count() == 1
    bare = spark.read.format("warc").option("path", f"file://{tmp_path}/w").option("payload", "false").load()
    assert bare.where("payload is not null").count() == 0 and bare.count() == len(html)


def test_warc_formats(tmp_path):
    import gzip

    from tidemark.llm import warc

    plain = b"".join(warc.record("response", {"WARC-Record-ID": f"urn:page:{i}"}, b"p" * i) for i in range(5))
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record("response", {"WARC-Record-ID": f"urn:page:{i}"}, bytes([65 + i]) * 9000)) for i in range(4)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(warc.member(warc.record("response", {"WARC-Record-ID": f"urn:page:{i}"}, bytes([65 + i]) * 9000)) for i in range(4)))
    assert gzip.decompress((tmp_path / "c.warc.gz").read_bytes()).count(b"WARC/1.1") == 4
    for name, n in (("a.warc", 5), ("b.warc.gz", 4), ("c.warc.gz", 4)):
        with open(tmp_path / name, "rb") as f:
            size = (tmp_path / name).stat().st_size
            every = list(warc.records(f, size, lambda h: 2))
            some = list(warc.records(f, size, lambda h: 2 * h["WARC-Record-ID"].endswith(":3")))
        assert [h["WARC-Record-ID"] for h, _ in every] == [f"urn:page:{i}" for i in range(n)]
        assert len(some) == 1 and some[0][1] == every[3][1]


def test_warc_loses_no_record(spark, tmp_path, monkeypatch):
    """Several records in a gzip member, records over members, lower-case names, truncated files, files in several partitions."""
    import gzip
    import io

    from tidemark.llm import warc

    one = [warc.record("response", {"WARC-Record-ID": f"<urn:page:{i}>"}, bytes([65 + i]) * (9000 + i)) for i in range(4)]
    whole = b"".join(one)
    read = lambda b, want=2, **k: list(warc.records(io.BytesIO(b), len(b), lambda h: want, **k))
    for data in (gzip.compress(whole), gzip.compress(whole[:12_345]) + gzip.compress(whole[12_345:]) + b"\0" * 700, whole.replace(b"Content-Length", b"content-length").replace(b"WARC-Record-ID", b"warc-record-id")):
        assert [(h["WARC-Record-ID"], p) for h, p in read(data)] == [(f"<urn:page:{i}>", bytes([65 + i]) * (9000 + i)) for i in range(4)]
        assert len(read(data, 1)) == 4 and read(data, 0) == []
    own = b"".join(map(warc.member, one))
    cut = [whole[:-30], whole[:30], gzip.compress(whole)[:-40], own[:-20], b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx", whole + b"junk\r\n\r\n"]
    for data in cut:
        for want in (0, 1, 2):
            with pytest.raises((ValueError, warc.zlib.error)):
                read(data, want)
    monkeypatch.setattr(warc, "SPLIT_BYTES", 50)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.warc.gz").write_bytes(own)
    parts = warc.WarcReader({"path": f"file://{tmp_path}/d"}, None).partitions()
    assert len(parts) == -(-len(own) // 50)
    rows = [b.to_pylist() for p in parts for b in warc.WarcReader({"path": ""}, None).read(p)]
    assert sorted(r["record_id"] for b in rows for r in b) == [f"<urn:page:{i}>" for i in range(4)]


# ------------------------------------------------------------------ queries and pipeline


def test_queries_equal_their_sql(spark, data):
    from compare import canonical, database

    from tidemark.llm.queries import oracle_sql, queries

    con = database(data)
    for name, sql in oracle_sql().items():
        assert canonical(queries()[name](spark, data).toPandas()) == canonical(con.execute(sql).df()), name


def test_pipeline_equals_brute_force(spark, data):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from tidemark.llm.mixing import mixing_plan
    from tidemark.llm.queries import tokenizer_path

    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    docs = [r for r in docs if re.search(r"[^\W\d_]", r[1] or "")]
    groups = brute_groups([r[1] for r in docs])
    docs = [docs[min(ids, key=lambda i: (-len(docs[i][1]), docs[i][0]))] for ids in groups.values()]
    docs.sort()
    comp = brute_components([brute_fingerprint(r[1]) for r in docs])
    docs = [r for i, r in enumerate(docs) if comp[i] == i]
    copies = {r["doc_id"]: r["copies"] for r in mixing_plan(spark.createDataFrame(docs, DOCS)).collect()}
    library = Tokenizer.from_file(tokenizer_path())
    want = sorted((r[0], library.encode(r[1], add_special_tokens=False).ids) for r in docs for _ in range(copies[r[0]]))
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, data).collect())
    assert got == want


def test_stages_keep_the_columns(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = ["__lang_pred", "__score", "__text", "__digest", "__id", "__points", "__h1", "__stays", "__size", "__target", "__nth", "__copies", "size", "target", "score"]
    wide = docs.withColumns({c: F.lit(f"own {c}") for c in odd})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, wide, data)
        assert kept.columns == wide.columns
        assert kept.where(F.greatest(*[(F.col(c) != f"own {c}").cast("int") for c in odd]) > 0).isEmpty()


def test_language_stage_rejects_by_score_and_keeps_without_labels(spark, monkeypatch):
    import corpus_pipeline
    from tidemark.llm import gru_langid

    docs = spark.createDataFrame([(1, "clean text", None, "s", 10), (2, "12 ?!", None, "s", 5), (3, None, None, "s", 0), (4, "zz", None, "s", 2)], DOCS)
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect())
    assert kept() == [1, 4]
    scored = docs.withColumn("__lang_pred", F.when(F.col("doc_id").isin(1, 4), "en").otherwise("und")).withColumn("__score", F.when(F.col("doc_id") == 1, 0.9).when(F.col("doc_id") == 4, 0.3).otherwise(0.0))
    monkeypatch.setattr(gru_langid, "predicted_languages", lambda *a, **k: scored)
    assert kept() == [1]
