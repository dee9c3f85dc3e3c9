"""Mixing sources to target weights, with DataFrame functions only.

Words are aggregated for each source, the sources' targets derived from their
weights, and every document is emitted ``floor(rate)`` times plus one
hash-seeded Bernoulli copy with probability ``rate - floor(rate)``, where
``rate`` is its source's target over its source's size.

Defined results: a null text has size 0; null is a source of its own and comes
last; the n-th of the rows that repeat an identifier, a text and a source draws
its own number, so that many of them come near the target, too; they are
numbered by their whole content, so which rows are taken does not depend on the
order in which they are read and reruns agree; an empty table
gives no rows; a source without words has target 0 and its documents are not
taken.  Extra columns of any name are carried by ``mixed_documents`` and
ignored by ``mixing_plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, WORD, checkpoint, join_by_key, prefix_for, row_names


def word_count(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str, id_col, text_col, nth=None):
    """A number in [0, 1) that depends only on the seed, the id, the text and, from the second on, which of the equal rows it is."""
    parts = [F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(F.coalesce(text_col, F.lit("")))]
    if nth is not None:
        parts.append(F.when(nth > 1, nth.cast("string")))  # concat_ws leaves nulls out
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _ordered_numbers(df: DataFrame, order, name: str) -> DataFrame:
    """Adds the rows' numbers from 1 in ``order``: sorted by ranges, counted by range, numbered within each."""
    sorted_ = df.repartitionByRange(order) if isinstance(order, str) else df.repartitionByRange(*order)
    sorted_ = checkpoint(sorted_.withColumn("__pid", F.spark_partition_id()))
    counts = sorted_.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = counts.alias("a").join(counts.alias("b"), F.col("b.__pid") < F.col("a.__pid"), "left").groupBy(F.col("a.__pid").alias("__pid")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    return sorted_.join(F.broadcast(before), "__pid").withColumn(name, own + F.col("__before")).drop("__pid", "__before")


def source_targets(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, text: str = "text", source: str = "source") -> DataFrame:
    """One row for each source: source, source_size, rows, weight, target.

    Weights repeat over the sources in code point order, null last.  A target
    stops at ``cap`` times its source's size; what it would have had beyond is
    shared anew by weight until none is above.  Sharing is one small aggregate
    a round: a level (words for a unit of weight) caps the sources below it,
    what they leave gives the next level, and levels only rise.
    """
    per = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"), F.count("*").alias("rows"))
    per = _ordered_numbers(per, [F.col("source").asc_nulls_last()], "place")
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    per = checkpoint(per.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int"))).drop("place"))
    most = F.lit(cap).cast("long") * F.col("source_size")
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    capped, known = F.lit(False), -1
    while True:
        sums = per.agg(F.coalesce(F.sum(F.when(capped, most)), F.lit(0)).alias("taken"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"), F.coalesce(F.sum(capped.cast("int")), F.lit(0)).alias("n")).first()
        left, open_ = total - sums["taken"], sums["open"]
        if sums["n"] == known or not open_:
            break
        known = sums["n"]
        capped = most * F.lit(open_) <= F.lit(left) * F.col("weight")  # integers: exact
    level = F.lit(left).cast("double") / F.lit(open_) if open_ else F.lit(0.0)
    return per.select("source", "source_size", "rows", "weight", F.when(capped, most.cast("double")).otherwise(level * F.col("weight")).alias("target"))


def _numbered_repeats(docs: DataFrame, p: str, doc_id: str, text: str, source: str) -> DataFrame:
    """Adds ``{p}nth``: which of the rows with its identifier, text and source a row is; 1 for nearly all, which are not shuffled for it.

    Rows that repeat are numbered by the hash of their whole content, so only
    rows that are alike in every column may change places.  They are sorted by
    ranges, rows that are alike by the partition that they were read in, so no
    task holds a whole group.
    """
    k1, k2, name, part, n, nth, low, row = (f"{p}{c}" for c in ("k1", "k2", "name", "part", "n", "nth", "low", "row"))
    key = [F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(source).cast("string"), F.lit("")), F.col(source).isNull()]
    keyed = docs.withColumn(k1, F.xxhash64(*key)).withColumn(k2, F.xxhash64(F.lit(1), *key))
    again = checkpoint(keyed.groupBy(k1, k2).agg(F.count("*").alias(n)).where(F.col(n) > 1))
    total = again.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return docs.withColumn(nth, F.lit(1))
    found = join_by_key(keyed.withColumn(part, F.spark_partition_id()), again, [k1, k2], n, total, F.col(part))
    once = found.where(F.col(n).isNull()).select(*docs.columns, F.lit(1).cast("long").alias(nth))
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    more = found.where(F.col(n).isNotNull()).select(k1, k2, row_names(docs.columns)[0].alias(name), part, packed.alias(row))
    more = _ordered_numbers(more, [F.col(c).asc() for c in (k1, k2, name, part)], nth)
    starts = more.groupBy(k1, k2).agg(F.min(nth).alias(low), F.count("*").alias(n))
    own = join_by_key(more, starts, [k1, k2], n, total, F.col(part)).withColumn(nth, F.col(nth) - F.col(low) + 1)
    return once.unionByName(own.select(*[F.col(row)[c].alias(c) for c in docs.columns], F.col(nth).cast("long").alias(nth)))


def _with_copies(docs: DataFrame, targets: DataFrame, p: str, seed: str, doc_id: str, text: str, source: str) -> DataFrame:
    """Adds ``{p}size``, ``{p}target`` and ``{p}copies``."""
    src, size, target, rows_, rate, copies, void = (f"{p}{c}" for c in ("src", "size", "target", "rows", "rate", "copies", "void"))
    rows = _numbered_repeats(docs, p, doc_id, text, source)
    rows = rows.withColumn(src, F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn(void, F.col(source).isNull())
    t = targets.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias(src), F.col("source").isNull().alias(void), F.col("source_size").alias(size), F.col("target").alias(target), F.col("rows").alias(rows_))
    if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(t), [src, void], "left")
    else:  # many sources: both sides are dealt by source, large ones over as many salts as they need
        total = t.agg(F.sum(rows_).alias("n")).first()["n"]
        rows = join_by_key(rows, t, [src, void], rows_, total, F.xxhash64(F.col(doc_id).cast("string"), F.col(text), F.col(f"{p}nth")))
    rows = rows.withColumn(rate, F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0)))
    extra = (draw(seed, F.col(doc_id), F.col(text), F.col(f"{p}nth")) < F.col(rate) - F.floor(rate)).cast("long")
    return rows.withColumn(copies, F.floor(rate).cast("long") + extra)


def mixing_plan(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    rows = _with_copies(docs, source_targets(docs, weights, cap), "__", seed, "doc_id", "text", "source")
    size = word_count(F.col("text"))
    return rows.select("doc_id", size.alias("size"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), (size * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture itself: the rows of ``docs`` with all their columns, each as often as it is taken."""
    p = prefix_for(docs)
    rows = _with_copies(docs, source_targets(docs, weights, cap, text, source), p, seed, doc_id, text, source)
    return rows.where(F.col(f"{p}copies") > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}copies")))).select(*docs.columns)
