"""Exact dedup through a log-structured merge index of text digests.

1. Flush: each task fills a memtable (digest -> best row, count) and flushes it
   as a sorted run when it is full, so copies meet before the shuffle.
2. Compaction merges the runs of all tasks by digest; each entry keeps the row
   with the most code points, then the smallest identifier.
3. The repeated digests get a bit filter of at most ``FILTER_BITS`` bits.  A
   document that misses the filter is unique and is never shuffled.
4. Hits look up their entry (hot digests over salts) and receive byte
   verification against the kept text; texts that only share a digest are
   grouped anew by their bytes.

Defined results: a null text counts as empty; all empty texts are one group;
rows that repeat an identifier and a text are one document, so they share their
decision; a null identifier sorts last; extra columns of any name are ignored,
or carried by ``drop_exact_duplicates``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, join_by_key, one_of_each, prefix_for, without_spaces

MEMTABLE_ROWS = 100_000
#: The filter has 16 bits for each repeated digest, up to this bound (32 MB).
FILTER_BITS = 1 << 28
PROBES = 3


def flush_runs(batches, most: int = MEMTABLE_ROWS):
    """Arrow batches (digest, points, doc_id) -> sorted runs (digest, points, doc_id, rows)."""

    def run(table: dict):
        keys = sorted(table)
        best = [table[k] for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([-b[0] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.int64()), pa.array([b[3] for b in best], pa.int64())],
            names=["digest", "points", "doc_id", "rows"],
        )

    table: dict = {}
    for batch in batches:
        for digest, points, doc_id in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            new = (-points, doc_id is None, doc_id)
            old = table.get(digest)
            if old is None:
                table[digest] = [*new, 1]
            else:
                old[3] += 1
                if new[:2] < tuple(old[:2]) or new[:2] == tuple(old[:2]) and doc_id is not None and doc_id < old[2]:
                    old[:3] = new
            if len(table) >= most:
                yield run(table)
                table = {}
    if table:
        yield run(table)


def compact(runs: DataFrame) -> DataFrame:
    """Merge of runs: one entry for each digest."""
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id")))
    level = runs.groupBy("digest").agg(best.alias("best"), F.sum("rows").alias("rows"))
    return level.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), "rows")


def _bit(digest, k: int, bits: int):
    """The k-th probe of a digest: a stretch of its hash, modulo a power of two."""
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits))


def repeated_filter(repeated: DataFrame, count: int) -> np.ndarray:
    """Filter of the repeated digests as 64-bit words; its size is bounded by FILTER_BITS."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * max(1, count) - 1).bit_length()))
    at = repeated.select(F.explode(F.array(*[_bit(F.col("digest"), k, bits) for k in range(PROBES)])).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toPandas()
    out = np.zeros(bits >> 6, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def _maybe_repeated(spark, words: np.ndarray):
    held = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        w, ok = held.value, np.ones(len(a), bool)
        for col in (a, b, c):
            bit = col.to_numpy(np.int64)
            ok &= (w[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(ok)

    bits = len(words) << 6
    return lambda digest: probe(*[_bit(digest, k, bits) for k in range(PROBES)])


class DedupIndex:
    """The compacted index of ``docs`` and what the lookups of its hits gave."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_chars: int = 64):
        """``digest_chars`` shortens the digest that the index works with (tests of colliding digests)."""
        self.spark, self.digest_chars = docs.sparkSession, digest_chars
        self._doc_id, self._text = doc_id, text
        rows = docs.select(self._digest().alias("digest"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"), F.col(doc_id).cast("long").alias("doc_id"))
        runs = rows.mapInArrow(flush_runs, "digest string, points long, doc_id long, rows long")
        self.repeated = checkpoint(compact(runs).where("rows > 1"))
        sums = self.repeated.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        self.total = sums["rows"]
        self.maybe = _maybe_repeated(self.spark, repeated_filter(self.repeated, sums["n"]))
        self.hits = self._verified(docs)

    def _digest(self):
        full = F.sha2(without_spaces(F.col(self._text)), 256)
        return full if self.digest_chars == 64 else F.substring(full, 1, self.digest_chars)

    def _verified(self, docs: DataFrame) -> DataFrame:
        """Rows that hit the filter with their entry: full, digest, doc_id, points, keep_id, keep_points, rows, other.

        ``rows`` is null where the filter erred; ``other`` holds the text where it is not the kept one.
        """
        text, squeezed = F.coalesce(F.col(self._text), F.lit("")), without_spaces(F.col(self._text))
        rows = docs.select(F.sha2(squeezed, 256).alias("full"), self._digest().alias("digest"), F.col(self._doc_id).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("points"), squeezed.alias("squeezed"))
        rows = rows.where(self.maybe(F.col("digest")))
        salt = F.xxhash64("doc_id", "points")
        found = join_by_key(rows, self.repeated, ["digest"], "rows", self.total, salt)
        kept = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))
        kept = kept.groupBy("digest", F.col("rows").alias("__rows")).agg(F.min("squeezed").alias("kept_text"))
        joined = join_by_key(found, kept, ["digest"], "__rows", self.total, salt)
        other = F.when(F.col("squeezed") != F.col("kept_text"), F.col("squeezed"))
        return checkpoint(joined.select("full", "digest", "doc_id", "points", "keep_id", "keep_points", "rows", other.alias("other")))

    def decisions(self) -> DataFrame:
        """One row for each hit: doc_id, text_sha256, digest, points, keep_id, group_size, kept."""
        strays = self.hits.where("other is not null")
        if strays.isEmpty():  # no digest stands for two texts: the rule
            none = F.lit(None)
            out = self.hits.select("*", none.cast("long").alias("less"), none.cast("long").alias("sid"), none.cast("long").alias("sp"), none.cast("long").alias("n"))
        else:
            best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("id")))
            groups = strays.groupBy("digest", "other").agg(best.alias("b"), F.count("*").alias("n"))
            groups = groups.select("digest", "other", F.col("b.id").alias("sid"), (-F.col("b.p")).alias("sp"), "n")
            out = self.hits.join(strays.groupBy("digest").agg(F.count("*").alias("less")), "digest", "left").join(groups, ["digest", "other"], "left")
        alone, stray = F.col("rows").isNull(), F.col("other").isNotNull()
        pick = lambda one, own, shared: F.when(alone, one).when(stray, own).otherwise(shared)
        out = out.withColumn("keep_id", pick(F.col("doc_id"), F.col("sid"), F.col("keep_id"))).withColumn("keep_points", pick(F.col("points"), F.col("sp"), F.col("keep_points")))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
        size = pick(F.lit(1).cast("long"), F.col("n"), F.col("rows") - F.coalesce(F.col("less"), F.lit(0)))
        return out.select("doc_id", F.col("full").alias("text_sha256"), "digest", "points", "keep_id", size.alias("group_size"), kept.alias("kept"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_chars: int = 64) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DedupIndex(docs, doc_id, text, digest_chars)
    full = F.sha2(without_spaces(F.col(text)), 256)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), full.alias("text_sha256"))
    alone = rows.where(~index.maybe(F.substring("text_sha256", 1, digest_chars)))
    one = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return one.unionByName(index.decisions().select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of equal texts.

    Where several rows have the identifier and the length of the one that stays,
    it is that whose whole content's hash comes first, whatever their order.
    """
    index = DedupIndex(docs, doc_id, text)
    digest, own, points, d, i, n = (prefix_for(docs) + c for c in ("digest", "id", "points", "d", "i", "n"))
    rows = docs.withColumn(digest, index._digest())
    alone = rows.where(~index.maybe(F.col(digest))).drop(digest)
    keep = index.decisions().where("kept").select(F.col("digest").alias(d), F.col("doc_id").alias(i), F.col("points").alias(n)).distinct()
    size = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    some = rows.where(index.maybe(F.col(digest))).withColumn(own, F.col(doc_id).cast("long")).withColumn(points, size)
    kept = some.join(keep, (some[digest] == keep[d]) & some[own].eqNullSafe(keep[i]) & (some[points] == keep[n]), "left_semi")
    return alone.unionByName(one_of_each(kept, [digest, own], docs.columns))
