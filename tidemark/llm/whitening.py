"""Embedding whitening from an exact integer scatter.

Each entry c becomes the integer ``x = floor(scale * c) + shift``.  Nothing that
is returned depends on the shift, so tasks take it off first and accumulate, of
``y = floor(scale * c)``, sums and cross-products of arbitrary precision: blocks
of rows are multiplied as limbs of ``LIMB`` bits, whose products and sums
floating point holds exactly, and the limbs' products are put together as Python
integers.  Partial sums travel as one row for each dimension
and task and are added in two levels.  Only ``n XᵀX - SSᵀ``, formed exactly, is
converted to floating point and decomposed by ``eigh``, in a task that holds
this one matrix.

Defined results: vectors that are null or hold null or non-finite entries take
no part; vectors of each length are a fit of their own (a table has one length,
as a rule); components whose eigenvalue is not above ``RESOLVED`` times the
greatest can't be told from rounding and do not exist, so a single vector,
equal vectors and empty ones have none and no rows; of equal eigenvalues the
order is that of ``eigh``; repeated rows count and are returned each; an empty
table gives no rows; ``deviation`` is null where it is beyond 64 bits and
``deviation_digits`` always has it.  Extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

SCALE = 1024
LIMB = 20
#: Rows of a block: their products of two limbs add up to less than 2 ** 53.
BLOCK = 1 << (53 - 2 * LIMB - 1)
RESOLVED = 1e-11
#: First level of adding partial sums: tasks of one dimension's row are dealt over so many groups.
MERGES = 32
#: Models that are broadcast at once; vectors of the lengths beyond it take a further pass.
MODEL_BYTES = 64 << 20
EDGE = 1 << 62


def as_integers(c: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """x less its shift, floor(scale * c), of finite doubles: int64 where all fit, else Python integers."""
    most = float(np.abs(c).max(initial=0.0))
    if most * scale < EDGE:
        return np.floor(c * scale).astype(np.int64)
    flat = [int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale)) for v in c.ravel().tolist()]
    return np.array(flat, object).reshape(c.shape)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """``y`` as floating-point limbs, lowest first: all of 0 to 2 ** LIMB - 1 but the last, which has the sign."""
    out = []
    while True:
        if -(1 << LIMB) < y.min(initial=0) and y.max(initial=0) < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def exact_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and cross-products of integer rows, as Python integers."""
    d = y.shape[1]
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(y), BLOCK):
        parts = limbs(y[at : at + BLOCK])
        for i, a in enumerate(parts):
            sums = sums + (a.sum(0).astype(np.int64).astype(object) << (LIMB * i))
            for j in range(i + 1):
                product = (a.T @ parts[j]).astype(np.int64).astype(object) << (LIMB * (i + j))
                cross = cross + (product if i == j else product + product.T)
    return sums, cross


def exact_covariance(n: int, sums, cross: np.ndarray) -> np.ndarray:
    """(n XᵀX - SSᵀ) / n², each entry rounded once."""
    s = np.array(sums, object)
    return ((n * cross - np.outer(s, s)) / (n * n)).astype(np.float64)


def decompose(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the resolved components."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(components, int((values > max(values[0], 0.0) * RESOLVED).sum()))
    return values[:keep], vectors[:, :keep]


def _matrices(batch, column: str, scale: int):
    """(places, integers) of the usable vectors of a batch, for each length."""
    lists = batch.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    lengths[~lists.is_valid().to_numpy(zero_copy_only=False)] = -1
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        c = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
        good = np.isfinite(c).all(1)  # null entries are NaN here
        if good.any():
            yield int(d), at[good], as_integers(c[good], scale)


def scatter(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """One row for each length and dimension: length, place, n, sum, products (of this dimension with all, as decimal digits)."""
    rows = vectors.select(F.col(vector).cast("array<double>").alias("c"))
    kind = "length int, place int, n long, sum string, products array<string>"

    def partial(batches):
        from pyspark import TaskContext

        held: dict = {}
        for batch in batches:
            for d, _, y in _matrices(batch, "c", scale):
                sums, cross = exact_sums(y)
                n, s, c = held.get(d, (0, 0, 0))
                held[d] = (n + len(y), s + sums, c + cross)
        group = TaskContext.get().partitionId() % MERGES
        for d, (n, s, c) in held.items():
            yield pa.RecordBatch.from_pydict({
                "length": pa.array([d] * d, pa.int32()), "place": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                "sum": [str(v) for v in s], "products": [[str(v) for v in row] for row in c], "part": pa.array([group] * d, pa.int32()),
            })

    def added(f: pd.DataFrame) -> pd.DataFrame:
        products = sum(np.array([int(v) for v in row], object) for row in f["products"])
        one = {"length": f["length"].iloc[0], "place": f["place"].iloc[0], "n": int(f["n"].sum()), "sum": str(sum(int(v) for v in f["sum"])), "products": [str(v) for v in products]}
        return pd.DataFrame([one])

    parts = rows.mapInArrow(partial, f"{kind}, part int")
    return parts.groupBy("length", "place", "part").applyInPandas(added, kind).groupBy("length", "place").applyInPandas(added, kind)


def components_of(sums: DataFrame, components: int = 8) -> DataFrame:
    """One row for each length: length, n, sums, trace, values, axes (component by component)."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place")
        n, s = int(f["n"].iloc[0]), [int(v) for v in f["sum"]]
        v = exact_covariance(n, s, np.array([[int(x) for x in row] for row in f["products"]], object))
        values, axes = decompose(v, components)
        return pd.DataFrame([{"length": len(f), "n": n, "sums": list(f["sum"]), "trace": float(np.trace(v)), "values": values.tolist(), "axes": [a.tolist() for a in axes.T]}])

    return sums.groupBy("length").applyInPandas(fit, "length int, n long, sums array<string>, trace double, values array<double>, axes array<array<double>>")


class Whitener:
    """Projects vectors of one length; ``row`` is one of ``components_of``."""

    def __init__(self, row):
        self.n, self.sums = row["n"], np.array([int(v) for v in row["sums"]], object)
        self.values, self.axes = np.array(row["values"]), np.array(row["axes"]).reshape(len(row["values"]), -1)
        self.explained = self.values / row["trace"] if len(self.values) else self.values

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n y - S, exactly."""
        most = max(int(np.abs(y).max(initial=0)), 1)
        if self.n * most < EDGE and max(map(abs, self.sums), default=0) < EDGE:
            return self.n * y.astype(np.int64) - self.sums.astype(np.int64)
        return self.n * y.astype(object) - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.axes.T / np.sqrt(self.values)


def deviations(centred: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    most = int(np.abs(centred).max(initial=0))
    if centred.dtype != object and most * most * centred.shape[1] < EDGE:
        return (centred * centred).sum(1).tolist()
    wide = centred.astype(object)
    return (wide * wide).sum(1).tolist()


def _moments(rows: DataFrame, models, width: int, scale: int) -> DataFrame:
    """Largest entry, for each length, of the covariance of the whitened rows less the identity: length, identity_error.

    Every task centres before it multiplies, and partial moments are joined by
    the difference of their means.
    """
    kind = "length int, n long, mean array<double>, moment array<double>"

    def joined(parts):
        n, mean, moment = 0, 0.0, 0.0
        for m, a, b in parts:
            gap = a - mean
            moment = moment + b + np.outer(gap, gap) * (n * m / (n + m))
            mean, n = mean + gap * (m / (n + m)), n + m
        return n, mean, moment

    def partial(batches):
        from pyspark import TaskContext

        own, held = models.value, {}
        for batch in batches:
            for d, _, y in _matrices(batch, "c", scale):
                if d in own:
                    w = own[d].whitened(own[d].centred(y))
                    mean = w.mean(0)
                    held[d] = joined([*([held[d]] if d in held else []), (len(w), mean, (w - mean).T @ (w - mean))])
        for d, (n, mean, moment) in held.items():
            yield pa.RecordBatch.from_pydict({"length": pa.array([d], pa.int32()), "n": [n], "mean": [mean.tolist()], "moment": [moment.ravel().tolist()], "part": pa.array([TaskContext.get().partitionId() % MERGES], pa.int32())})

    def added(f: pd.DataFrame):
        square = lambda mean, m: np.array(m).reshape(len(mean), len(mean))
        n, mean, moment = joined((r.n, np.array(r.mean), square(r.mean, r.moment)) for r in f.itertuples())
        return int(f["length"].iloc[0]), n, mean, moment

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        d, n, mean, moment = added(f)
        return pd.DataFrame([{"length": d, "n": n, "mean": mean.tolist(), "moment": moment.ravel().tolist()}])

    def error(f: pd.DataFrame) -> pd.DataFrame:
        d, n, mean, moment = added(f)
        return pd.DataFrame([{"length": d, "identity_error": float(np.abs(moment / n - np.eye(len(mean))).max())}])

    parts = rows.mapInArrow(partial, f"{kind}, part int")
    return parts.groupBy("length", "part").applyInPandas(merge, kind).groupBy("length").applyInPandas(error, "length int, identity_error double")


def whitened_vectors(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits."""
    spark = vectors.sparkSession
    fits = checkpoint(components_of(scatter(vectors, vector, scale), components))
    sizes = [(r["length"], 8 * r["length"] * (r["k"] + 2)) for r in fits.select("length", F.size("values").alias("k")).where("k > 0").orderBy("length").toLocalIterator()]
    rounds, held = [[]], 0  # lengths whose models are broadcast together
    for length, size in sizes:
        if held + size > MODEL_BYTES and rounds[-1]:
            rounds, held = [*rounds, []], 0
        rounds[-1].append(length)
        held += size
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    out = None
    for lengths in rounds:
        some = rows.where(F.size("c").isin(lengths))
        models = spark.sparkContext.broadcast({r["length"]: Whitener(r) for r in fits.where(F.col("length").isin(lengths)).collect()})
        errors = {r["length"]: r["identity_error"] for r in _moments(some.select("c"), models, components, scale).collect()}

        def project(batches, models=models, errors=errors):
            own = models.value
            for batch in batches:
                ids = batch.column("vec_id")
                for d, at, y in _matrices(batch, "c", scale):
                    if d not in own:
                        continue
                    model = own[d]
                    centred = model.centred(y)
                    k, digits = len(model.values), deviations(centred)
                    again = np.repeat(np.arange(len(at)), k)
                    dev = pa.array([v if v < 1 << 63 else None for v in digits], pa.int64())
                    yield pa.RecordBatch.from_pydict({
                        "vec_id": ids.take(pa.array(at[again])), "component": pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), "n": pa.array(np.full(len(again), model.n), pa.int64()),
                        "deviation": dev.take(pa.array(again)), "whitened": model.whitened(centred).ravel(), "explained": np.tile(model.explained, len(at)),
                        "identity_error": np.full(len(again), errors[d]), "deviation_digits": pa.array([str(v) for v in digits]).take(pa.array(again)),
                    })

        found = some.mapInArrow(project, kind)
        out = found if out is None else out.unionByName(found)
    return out
