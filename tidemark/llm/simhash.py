"""SimHash near-dedup with vantage-point trees.

Each text gets a 64-bit fingerprint of its word shingles.  Equal fingerprints
are one class; classes are what is compared.  A vantage-point tree, fitted on a
bounded sample, partitions the classes by Hamming distance to its vantage
points into shards; a shard above its bound gets a tree of its own, fitted on a
sample of its rows, and so on, so shards stay bounded at any number of classes.  Every class lives in one shard and asks
all shards whose region comes within the link radius of it (the triangle
inequality prunes the others); a task splits its shard by further vantage
points and compares exactly at the leaves.  A shard returns one link to the
smallest member for each member of what it connects, never all pairs, and the
links are joined to components by alternating large and small stars.

Defined results: a null or empty text has fingerprint zero and links like any
other; repeated rows share fingerprint and component; a null identifier is
never a component's smallest one unless it has no other; an empty table gives
no rows; extra columns of any name are ignored, or carried by
``drop_near_duplicates``.
"""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, drawn_rows, join_by_key, one_of_each, prefix_for, slices, splittable_join

#: Fingerprints for each shard from which a tree is fitted, and the most shards of one tree: the sample is at most 262,144 numbers on the driver.
SAMPLE_PER_SHARD = 64
MOST_SHARDS = 4_096
#: Shards of a tree within a shard, which a task fits.
INNER_SHARDS = 256
#: Classes a shard should hold, and how often that (asking ones included) makes it too large.
SHARD_ROWS, TOO_LARGE = 8_192, 8
#: Dropped identifiers that are broadcast rather than shuffled with all texts; counted first.
BROADCAST_MARKS = 400_000
LEAF_ROWS = 96


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def text_names(text) -> tuple:
    """Two hashes that tell texts apart; a null text counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.xxhash64(body), F.xxhash64(F.lit(1), body)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the text's names h1 and h2, and the fingerprint fp as a signed long."""
    h1, h2 = text_names(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                prints = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column("text")), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "h1", "h2")] + [pa.array(prints.view(np.int64))], names=["doc_id", "h1", "h2", "fp"])

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, fp long")


def _split(prints: np.ndarray, turn: int = 0):
    """A vantage point among ``prints`` and the radius that halves them best; None if none parts them."""
    best = None
    for k in range(6):
        v = prints[(turn * 7 + k * max(1, len(prints) // 6)) % len(prints)]
        d = np.bitwise_count(prints ^ v)
        r = int(np.median(d))
        inside = int((d <= r).sum())
        if inside == len(prints) and r > 0:
            r -= 1
            inside = int((d <= r).sum())
        uneven = abs(2 * inside - len(prints))
        if 0 < inside < len(prints) and (best is None or uneven < best[0]):
            best = (uneven, v, r)
        if best and best[0] * 5 < len(prints):
            break
    return best and best[1:]


def fit_tree(sample: np.ndarray, shards: int):
    """Nested (vantage, radius, inside, outside) with shard numbers at the leaves."""
    count = iter(range(1 << 30))

    def grow(part, leaves):
        cut = _split(part, leaves) if leaves > 1 and len(part) > 8 else None
        if not cut:
            return next(count)
        inside = np.bitwise_count(part ^ cut[0]) <= cut[1]
        return (*cut, grow(part[inside], leaves // 2), grow(part[~inside], leaves - leaves // 2))

    return grow(sample, shards)


def route(tree, prints: np.ndarray, slack: int):
    """(shard, indices) of the shards within ``slack`` of each fingerprint; slack 0: where it lives."""
    todo = [(tree, np.arange(len(prints)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at
            continue
        v, r, inside, outside = node
        d = np.bitwise_count(prints[at] ^ v).astype(np.int16)
        todo.append((inside, at[d <= r + slack]))
        todo.append((outside, at[d > r - slack]))


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def linked(homes: np.ndarray, asking: np.ndarray, radius: int):
    """Index pairs (home, asker) that connect whatever lies within ``radius``; a spanning set for each leaf."""
    todo = [(np.arange(len(homes)), np.arange(len(asking)))]
    while todo:
        x, q = todo.pop()
        if not len(x) or not len(q):
            continue
        cut = _split(homes[x], len(x)) if len(x) > LEAF_ROWS else None
        if cut:
            dx, dq = np.bitwise_count(homes[x] ^ cut[0]), np.bitwise_count(asking[q] ^ cut[0]).astype(np.int16)
            todo.append((x[dx <= cut[1]], q[dq <= cut[1] + radius]))
            todo.append((x[dx > cut[1]], q[dq > cut[1] - radius]))
            continue
        for at in range(0, len(q), 4096):
            part = q[at : at + 4096]
            d = np.bitwise_count(homes[x][:, None] ^ asking[part][None])
            i, j = np.nonzero((d <= radius) & (d > 0))  # classes differ, so distance 0 is the class itself
            if len(i):
                yield x[i], part[j]


def _shard_links(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = pdf["fp"].to_numpy(np.int64)
        home = pdf["home"].to_numpy(bool)
        nodes = np.unique(prints)  # signed order, as Spark compares
        homes, asking = prints[home], prints[~home]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in linked(homes.view(np.uint64), asking.view(np.uint64), radius):
            a, b = np.concatenate([a, np.searchsorted(nodes, homes[i])]), np.concatenate([b, np.searchsorted(nodes, asking[j])])
            if len(a) > 1 << 20:  # fold what is known so far to one link a node
                label = smallest_labels(len(nodes), a, b)
                a = np.flatnonzero(label != np.arange(len(nodes)))
                b = label[a]
        label = smallest_labels(len(nodes), a, b)
        a = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[a], "b": nodes[label[a]]})

    return run


def _fit_inner(radius: int):
    """A tree for each oversized shard, from its sample; rows (shard, tree)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        tree = fit_tree(prints, int(pdf["leaves"].iloc[0]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    return run


def _split_large(dealt: DataFrame, limit: int, radius: int) -> DataFrame | None:
    """Rows (shard, fp, home) with the shards above ``limit`` split by trees of their own; None if there are none that can be."""
    sizes = checkpoint(dealt.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where(F.col("n") > limit))
    sizes = sizes.where(F.col("homes") > SHARD_ROWS)
    if sizes.isEmpty():
        return None
    leaves = F.least(F.lit(INNER_SHARDS), F.ceil(F.col("homes") / SHARD_ROWS)).cast("int")
    share = F.least(F.lit(1.0), SAMPLE_PER_SHARD * leaves / F.col("homes"))
    large = splittable_join(dealt.where("home"), sizes.withColumn("leaves", leaves).withColumn("share", share).drop("n", "homes"), ["shard"])
    drawn = large.where(F.pmod(F.xxhash64("fp", "shard"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("shard", "fp", "leaves")
    trees = checkpoint(drawn.groupBy("shard").applyInPandas(_fit_inner(radius), "shard string, tree binary"))

    def deal(batches):
        for batch in batches:
            prints, home = np.asarray(batch.column("fp")).astype(np.int64), batch.column("home").to_numpy(zero_copy_only=False)
            names = batch.column("shard").dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            for code in np.unique(codes).tolist():
                at = np.flatnonzero(codes == code)
                shard, tree = names.dictionary[code].as_py(), pickle.loads(batch.column("tree")[int(at[0])].as_py())
                for slack, own in ((0, at[home[at]]), (radius, at[~home[at]])):
                    for leaf, part in route(tree, prints[own].view(np.uint64), slack):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{shard}.{leaf}"] * len(part), pa.string()), pa.array(prints[own[part]]), pa.array(np.full(len(part), slack == 0))], names=["shard", "fp", "home"])

    small = dealt.join(sizes.select("shard"), "shard", "left_anti")
    split = splittable_join(dealt, trees, ["shard"]).select("shard", "fp", "home", "tree").mapInArrow(deal, "shard string, fp long, home boolean")
    return small.select("shard", "fp", "home").unionByName(split)


def near_links(classes: DataFrame, count: int, radius: int = 2) -> DataFrame:
    """Links (a, b), a > b, that connect all fingerprints (column fp, distinct) within ``radius`` bits."""
    shards = min(MOST_SHARDS, max(1, -(-count // SHARD_ROWS)))
    tree = 0
    if shards > 1:
        drawn = drawn_rows(classes, F.xxhash64("fp"), count, SAMPLE_PER_SHARD * shards).select("fp").limit(2 * SAMPLE_PER_SHARD * shards)
        tree = fit_tree(np.array([r["fp"] for r in drawn.collect()], np.int64).view(np.uint64), shards)

    def deal(batches):
        for batch in batches:
            prints = np.asarray(batch.column("fp")).astype(np.int64)
            for slack in (0, radius):
                for shard, at in route(tree, prints.view(np.uint64), slack):
                    yield pa.RecordBatch.from_arrays([pa.array([str(shard)] * len(at), pa.string()), pa.array(prints[at]), pa.array(np.full(len(at), slack == 0))], names=["shard", "fp", "home"])

    dealt = classes.select("fp").mapInArrow(deal, "shard string, fp long, home boolean")
    if shards > 1:
        dealt, most = checkpoint(dealt), None
        while True:  # each round splits what is too large; what no vantage point parts stays
            finer = _split_large(dealt, TOO_LARGE * SHARD_ROWS, radius)
            if finer is None:
                break
            finer = checkpoint(finer)
            largest = finer.groupBy("shard").count().agg(F.max("count")).first()[0]
            dealt, done, most = finer, most is not None and largest >= most, largest
            if done:
                break
    return dealt.groupBy("shard").applyInPandas(_shard_links(radius), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links``: the smallest node that it reaches.

    Alternating large and small stars (Kiveris et al., 2014): each round is two
    aggregations with map-side minima and two joins whose hubs adaptive
    execution can split; rounds grow with the logarithm of the diameter.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))), F.lit(0))).first()
        if tuple(now) == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(now)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = splittable_join(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = splittable_join(large, low, ["u"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u != v").distinct())


def _classed(docs: DataFrame, width: int, radius: int, seed: int, doc_id: str, text: str) -> DataFrame:
    """One row for each document: doc_id, h1, h2, fp, root (of its component) and component_id."""
    prints = checkpoint(fingerprints(docs, width, seed, doc_id, text))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("n")))
    sums = classes.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    roots = components(near_links(classes, sums["c"], radius))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = classes.groupBy("root").agg(F.min("low_id").alias("component_id"))
    classes = checkpoint(splittable_join(classes, low, ["root"]).select("fp", "root", "component_id", "n"))
    return join_by_key(prints, classes, ["fp"], "n", sums["n"], F.xxhash64("doc_id", "h1"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id, fp (the fingerprint as a long)."""
    out = _classed(docs, width, radius, seed, doc_id, text)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def drop_near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component.

    It is the row with the smallest identifier, a null one last, and of several
    texts with that identifier the one whose hash comes first; of rows that
    repeat it the one whose whole content's hash comes first.  Rows are told apart by identifier and text, so a text
    that nothing resembles stays whatever its identifier.
    """
    p = prefix_for(docs)
    near = _classed(docs, width, radius, seed, doc_id, text)
    keys = checkpoint(near.groupBy("root", "doc_id", "h1", "h2").agg(F.count("*").alias("times")))
    best = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id"), "h1", "h2")).alias("best"), F.sum("times").alias("rows")).where("rows > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("h1") == F.col("best.h1")) & (F.col("h2") == F.col("best.h2"))
    marks = splittable_join(keys, best, ["root"]).select(F.coalesce("doc_id", F.lit(0)).alias(f"{p}id"), F.col("doc_id").isNull().alias(f"{p}void"), F.col("h1").alias(f"{p}h1"), F.col("h2").alias(f"{p}h2"), stays.alias(f"{p}stays"), "times")
    marks = checkpoint(marks.where(~F.col(f"{p}stays") | (F.col("times") > 1)).drop("times"))  # a row for each text that goes or stands more than once
    if marks.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    h1, h2 = text_names(F.col(text))
    own = F.col(doc_id).cast("long")
    rows = docs.withColumns({f"{p}id": F.coalesce(own, F.lit(0)), f"{p}void": own.isNull(), f"{p}h1": h1, f"{p}h2": h2})
    named = [f"{p}id", f"{p}void", f"{p}h1", f"{p}h2"]
    rows = rows.join(marks, named, "left")
    once, twice = rows.where(F.col(f"{p}stays").isNull()), rows.where(F.col(f"{p}stays"))
    return once.select(*docs.columns).unionByName(one_of_each(twice, named, docs.columns))
