"""Approximate nearest neighbours with a permutation index.

Pivots are a bounded sample of the vectors.  A vector is represented by its
``PREFIX`` nearest pivots in order, and posted, with this permutation, in the
inverted files of the first ``POST`` of them.  A query goes only to the files
of its own nearest pivots.  In a file the posted vectors are ranked by what
their footrule distance to the query falls short of the largest, and true
distances are computed in waves of that order until a wave adds nothing; there
is no cap on candidates.  A vector that shares several files with a query is
compared in the first of them, so every pair meets once, and the nearest of all
files are merged.

Files are counted first: one with more than ``FILE_ROWS`` vectors (a hot pivot)
is split into blocks, and one that more than ``CHUNK_ROWS`` queries ask into
chunks of these, so tasks keep their size.  The number of pivots grows with the
square root of the number of vectors, so that files stay short.  Queries that
fewer than k vectors answered go to all files.

Vectors of every length take part and are compared within their length; the
``MOST_LENGTHS`` most frequent lengths get pivots, the vectors of each other
length are one file.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, as queries or candidates; equal vectors rank by
identifier; a repeated identifier is a candidate as often as it stands, except
for a query of that identifier; a null identifier takes no part; fewer
candidates than asked for are all returned; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, drawn_rows

#: Pivots for PIVOT_ROWS vectors; more vectors get more, by the square root, up to MOST_PIVOTS.
PIVOTS, PIVOT_ROWS, MOST_PIVOTS = 256, 65_536, 32_768
#: A pivot for so many vectors at least: small tables have few files, which queries ask all.
LEAST_PER_PIVOT = 128
PREFIX, POST = 32, 8
#: The share of a length's pivots whose files a query asks, and the least number of them.
ASK_SHARE, ASK_LEAST = 0.1, 24
FILE_ROWS, CHUNK_ROWS = 16_384, 4_096
MOST_LENGTHS = 16
#: Candidates of one wave: at least so many, and this share of a file.
WAVE_LEAST, WAVE_SHARE = 256, 0.08


def usable(vector):
    """True for vectors without null or non-finite components that aren't zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each row of x the numbers of its nearest pivots in order, ties to the smaller number."""
    out = np.empty((len(x), prefix), np.int32)
    square = (pivots**2).sum(1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = np.round(square[None] - 2 * part @ pivots.T, 9)
        if prefix < d.shape[1]:
            near = np.sort(np.argpartition(d, prefix - 1, axis=1)[:, :prefix], axis=1)
        else:
            near = np.broadcast_to(np.arange(prefix), d.shape)
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        out[at : at + 4096] = np.take_along_axis(near, order, 1)
    return out


class PivotFile:
    """A block of one pivot's inverted file: vectors with their permutations, in the order of their identifiers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, perm: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.prefix = ids[order], x[order], perm.shape[1]
        flat = perm[order].ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.position = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int32)
        self.names, starts = np.unique(flat[by], return_index=True)
        self.start = np.append(starts, len(by))

    def nearest(self, own: int, vector: np.ndarray, perm: np.ndarray, turn: int, post: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest that the waves reach, of the vectors that no earlier file of the query (its pivots before ``turn``) holds."""
        # footrule distance = prefix * (prefix + 1) - 2 * near
        near = np.zeros(len(self.ids), np.int32)
        met = self.ids == own
        for place, (pivot, at) in enumerate(zip(perm.tolist(), np.searchsorted(self.names, perm).tolist(), strict=True)):
            if at < len(self.names) and self.names[at] == pivot:
                rows, position = self.rows[self.start[at] : self.start[at + 1]], self.position[self.start[at] : self.start[at + 1]]
                if place < self.prefix:
                    near[rows] += self.prefix - np.maximum(position, place)
                if place < turn:
                    met[rows[position < post]] = True
        ranked = np.flatnonzero(~met)
        ranked = ranked[np.argsort(-near[ranked], kind="stable")]
        wave = max(WAVE_LEAST, int(WAVE_SHARE * len(ranked)))
        best_i, best_d = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(ranked), wave):
            rows = ranked[at : at + wave]
            d = np.sqrt(((self.x[rows] - vector) ** 2).sum(1))
            i = np.concatenate([best_i, self.ids[rows]])
            d = np.concatenate([best_d, d])
            top = np.lexsort((i, d))[:k]
            if at and (top < len(best_i)).sum() == len(top) and len(best_i) >= k:
                break
            best_i, best_d = i[top], d[top]
        return best_i, best_d


def fitted_pivots(base: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Pivots of the most frequent lengths; every other length is left to one file."""
    counts = base.groupBy("size").agg(F.count("*").alias("n"))
    out = {}
    for size, n in counts.orderBy(F.desc("n"), "size").limit(MOST_LENGTHS).collect():
        pivots = min(most if n <= PIVOT_ROWS else math.ceil(most * math.sqrt(n / PIVOT_ROWS)), MOST_PIVOTS, max(1, n // LEAST_PER_PIVOT))
        rows = drawn_rows(base.where(F.col("size") == size), F.xxhash64("id", "v"), n, 4 * pivots).select("v").distinct().limit(8 * pivots)
        found = sorted(tuple(float(x) for x in r["v"]) for r in rows.collect())
        some = np.random.default_rng(5).permutation(len(found))[:pivots]
        out[size] = np.array([found[i] for i in sorted(some)], np.float64).reshape(-1, size)
    return out


class Layout:
    """Pivots by length, and how files are split: what tasks need to deal vectors and queries."""

    def __init__(self, pivots: dict[int, np.ndarray], prefix: int):
        self.pivots, self.prefix, self.post = pivots, prefix, POST
        self.blocks: dict[tuple[int, int], int] = {}
        self.chunks: dict[tuple[int, int], int] = {}

    def permuted(self, batch: pa.RecordBatch):
        """(rows, vectors, permutations) of a batch for each length."""
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        values = batch.column("v")
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
            own = self.pivots.get(size)
            yield size, at, x, permutations(x, own, min(len(own), max(self.prefix, self.asked(size)))) if own is not None else np.zeros((len(at), 1), np.int32)

    def asked(self, size: int) -> int:
        n = len(self.pivots.get(size, (0,)))
        return min(n, max(ASK_LEAST, math.ceil(ASK_SHARE * n)))


def _sizes(rows: DataFrame, layout: Layout, ask: bool, every: bool = False) -> dict[tuple[int, int], int]:
    """How many rows each file gets; a row for each pivot comes back."""

    def count(batches):
        for batch in batches:
            for size, _, _, perm in layout.permuted(batch):
                names, n = np.unique(perm[:, : layout.asked(size) if ask else layout.post], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size, np.int64)), pa.array(names.astype(np.int64)), pa.array(n.astype(np.int64))], names=["size", "pivot", "n"])

    if every:
        n = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}
        return {key: n[key[0]] for key in layout.blocks if key[0] in n}
    found = rows.mapInArrow(count, "size long, pivot long, n long").groupBy("size", "pivot").agg(F.sum("n").alias("n"))
    return {(r["size"], r["pivot"]): r["n"] for r in found.collect()}


def _search(base: DataFrame, asked: DataFrame, layout: Layout, k: int, every: bool = False) -> DataFrame:
    """(query_id, vec_id, score): the nearest of each query in each file that it asks; or in all files, where each vector then stands once."""
    layout.post = 1 if every else POST
    vector_type = base.schema["v"].dataType.simpleString()
    layout.blocks = {key: -(-n // FILE_ROWS) for key, n in _sizes(base, layout, False).items()}
    layout.chunks = {key: -(-n // CHUNK_ROWS) for key, n in _sizes(asked, layout, True, every).items()}
    post, blocks, chunks = layout.post, layout.blocks, layout.chunks
    cell = f"size long, pivot int, block int, chunk int, id long, v {vector_type}, perm array<int>, turn int"

    def emit(batch, rows, perm, at, keys):
        pick = pa.array(at)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * perm.shape[1]), pa.array(perm.ravel()))
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in keys[:4]), batch.column("id").take(pick), batch.column("v").take(pick), lists, pa.array(keys[4])], names=["size", "pivot", "block", "chunk", "id", "v", "perm", "turn"])

    def deal(batches, ask):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                for size, at, _, perm in layout.permuted(batch):
                    files = [p for s, p in blocks if s == size] if ask and every else None
                    for turn in range(len(files) if files is not None else min(perm.shape[1], layout.asked(size) if ask else post)):
                        pivot = np.full(len(at), files[turn], np.int32) if files is not None else perm[:, turn]
                        n, m = (np.array([x.get((size, p), 0) for p in pivot.tolist()], np.int64) for x in (blocks, chunks))
                        mine, times = (m, n) if ask else (n, m)  # queries: one chunk of all blocks; vectors: one block of all chunks
                        rows = np.repeat(np.arange(len(at)), np.where(mine > 0, times, 0))
                        if not len(rows):
                            continue
                        other = np.concatenate([np.arange(t) for t in np.where(mine > 0, times, 0)])
                        own = (ids[at] % np.maximum(mine, 1))[rows]
                        block, chunk = (other, own) if ask else (own, other)
                        keep = perm[rows] if ask else perm[rows, : layout.prefix]
                        yield emit(batch, rows, np.ascontiguousarray(keep.astype(np.int32)), at[rows], [np.full(len(rows), size, np.int64), pivot[rows].astype(np.int32), block.astype(np.int32), chunk.astype(np.int32), np.full(len(rows), 0 if files is not None else turn, np.int32)])

    def compare(index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(index) and len(ask):
            file = PivotFile(index["id"].to_numpy(np.int64), np.stack(index["v"].to_numpy()).astype(np.float64), np.stack(index["perm"].to_numpy()))
            for own, v, perm, turn in zip(ask["id"].tolist(), ask["v"], ask["perm"], ask["turn"].tolist(), strict=True):
                i, d = file.nearest(own, np.asarray(v, np.float64), np.asarray(perm), turn, post, k)
                out.append((np.full(len(i), own), i, d))
        cat = lambda j, kind: np.concatenate([o[j] for o in out]).astype(kind) if out else np.zeros(0, kind)
        return pd.DataFrame({"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, np.float64)})

    keys = ["size", "pivot", "block", "chunk"]
    left = base.mapInArrow(lambda b: deal(b, False), cell)
    right = asked.mapInArrow(lambda b: deal(b, True), cell)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest found of each query by Euclidean distance: query_id, rank, vec_id, score."""

    def pick(df):
        v = F.col(vector) if df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
        return df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), F.size(F.col(vector)).cast("long").alias("size")).where(usable(F.col("v")) & F.col("id").isNotNull())

    base, asked = pick(vectors), pick(queries).distinct()
    layout = Layout(fitted_pivots(base, pivots), prefix)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found):
        return checkpoint(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    best = ranked(_search(base, asked, layout, k))  # k rows a query
    full = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    few = checkpoint(asked.join(full, "id", "left_anti"))
    if few.isEmpty():
        return best
    more = ranked(_search(base, few, Layout(layout.pivots, prefix), k, True))
    return best.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
