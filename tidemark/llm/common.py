"""Helpers shared by the corpus operators.

``WORD`` is the word pattern of every contract in this subpackage (Java, RE2
and Python read it alike).  Intermediate results that several jobs need are cut
with ``checkpoint`` into the folder that the cluster names in
``spark.checkpoint.dir``; lost executors then cost a re-read, not a recompute.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Hot keys are those with more rows than this, or than a ten-thousandth of all.
HOT_ROWS = 2_000
HOT_SHARE = 10_000
#: Rows of a dimension that may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 50_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a folder in the warehouse, which is shared too, only where none is set (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidemark"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, for files that several jobs or executors read; a path without scheme belongs to the default file system."""
    base = checkpoint_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        base = default.rstrip("/") + base if default.rstrip("/") != "file:" else f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_folder`` named."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def prefix_for(*frames: DataFrame) -> str:
    """A beginning that no column of ``frames`` has, so that working columns clash with none of the user's."""
    names = [c.lower() for df in frames for c in df.columns]
    prefix = "__"
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def drawn_rows(df: DataFrame, name, count: int, rows: int) -> DataFrame:
    """About ``rows`` of the ``count`` rows of ``df``: those whose hash ``name`` lies below a threshold, so no partition sends more than its share."""
    if count <= rows:
        return df
    span = 1 << 40
    return df.where(F.pmod(name, F.lit(span)) < F.lit(max(1, span * rows // count)))


def row_names(columns: list[str]) -> list:
    """Two 64-bit hashes of a row's content: an order of rows that doesn't depend on where or when they are read."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    return [F.xxhash64(body), F.xxhash64(F.lit(1), body)]


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of one row for each value of ``keys``: that whose content's hashes come first, so reruns and other orders of rows choose alike."""
    p = prefix_for(rows)
    first, second = row_names(columns)
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(first.alias("a"), second.alias("b")))
    picked = rows.groupBy(*[F.col(k).alias(f"{p}{i}") for i, k in enumerate(keys)]).agg(best.alias(f"{p}row"))
    return picked.select(*[F.col(f"{p}row")[c].alias(c) for c in columns])


def without_spaces(col):
    """``col`` without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(col, F.lit(""))
    for ch in SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch, column: str, most_bytes: int = 4 << 20):
    """Row ranges of an Arrow batch whose ``column`` holds about ``most_bytes`` each."""
    start, held = 0, 0
    lengths = batch.column(column).nbytes // max(1, batch.num_rows)
    if lengths * batch.num_rows <= most_bytes:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(sizes):
        held += n
        if held >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def join_by_key(rows: DataFrame, index: DataFrame, keys: list[str], size: str, total: int, salt_of) -> DataFrame:
    """Left join of ``rows`` with ``index`` (one row for each key), hot keys salted.

    ``index[size]`` counts the rows of a key.  Keys above
    ``max(HOT_ROWS, total / HOT_SHARE)`` are fewer than ``HOT_SHARE`` by
    counting, so their list may be broadcast at any input size; their rows are
    dealt over salts and their index rows repeated for each salt.
    """
    p = prefix_for(rows, index)
    limit = max(HOT_ROWS, total // HOT_SHARE)
    width = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    hot = index.where(F.col(size) > limit).select(*keys, width.alias(f"{p}width"))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn(f"{p}salt", F.when(F.col(f"{p}width").isNull(), F.lit(0)).otherwise(F.pmod(salt_of, F.col(f"{p}width")).cast("int"))).drop(f"{p}width")
    spread = index.withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1)))
    return salted.join(spread, [*keys, f"{p}salt"], "left").drop(f"{p}salt")


def splittable_join(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``index``, an aggregate by ``keys``, whose hot keys adaptive execution can split.

    An aggregate is dealt by its keys already, so Spark would join it in the
    stage that makes it, and a partition of such a stage can't be split.  One
    more key, which follows from the others, gives both sides an exchange of
    their own; a hot key's rows are then read by many tasks, each with the
    index row.
    """
    named = index.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in index.columns if c not in keys])
    more = lambda prefix: F.pmod(F.xxhash64(F.col(f"{prefix}{keys[-1]}")), F.lit(2))
    same = more("") == more("__")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    return rows.join(named, same).drop(*[f"__{k}" for k in keys])
