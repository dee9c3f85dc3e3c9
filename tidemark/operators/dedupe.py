"""Choosing one record of several, and merging records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: list[str], preference: list[Column]) -> DataFrame:
    """The best row of each key; ``preference`` must order totally.

    The choice is an aggregate, so rows are merged before the shuffle and a hot
    key is no more work than another.
    """
    best = F.max_by(F.struct(*df.columns), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(preference)]))
    return df.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(best.alias("__r")).select("__r.*")


def duplicate_groups(df: DataFrame, keys: list[str], member: str, shown: Column | None = None, show: int = 5) -> DataFrame:
    """Keys with more than one row: rows, sorted distinct members, and the first ``show`` of ``shown``."""
    aggs = [F.count("*").alias("n"), F.array_sort(F.collect_set(member)).alias("members")]
    if shown is not None:
        aggs.append(F.slice(F.array_sort(F.collect_set(shown)), 1, show).alias("shown"))
    return df.groupBy(*keys).agg(*aggs).where("n > 1")


def merge_records(df: DataFrame, keys: list[str], order: Column, first: list[str] = (), largest: list[str] = (), union: list[str] = ()) -> DataFrame:
    """One record a key: first filled text in ``order``, largest number, union of array values."""
    aggs = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", order)).alias(c) for c in first]
    aggs += [F.max(c).alias(c) for c in largest] + [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in union]
    return df.groupBy(*keys).agg(*aggs, F.count("*").alias("merged"))


def most_common(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones that which comes first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("__first"))).alias(value), F.max("n").alias("n"))


def upsert_preferred(stored: DataFrame, new: DataFrame, keys: list[str], preference: list[Column]) -> DataFrame:
    """Stored and new rows merged: new keys are added, better rows replace, others stay.  Adds outcome."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(preference)], (-F.col("__new")).alias("old"))
    out = both.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*both.columns), rank).alias("__r"), F.min("__new").alias("__least"))
    outcome = F.when(F.col("__least") == 1, "inserted").when(F.col("__r.__new") == 1, "updated").otherwise("kept")
    return out.withColumn("outcome", outcome).select("__r.*", "outcome").drop("__new")


def fill_blanks(stored: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Mapping rows by key where a blank new value keeps the stored one."""
    a, b = stored.select(key, *[F.col(c).alias(f"__old_{c}") for c in fields]), new.select(key, *[F.col(c).alias(f"__new_{c}") for c in fields])
    filled = [F.coalesce(F.nullif(F.col(f"__new_{c}"), F.lit("")), F.col(f"__old_{c}"), F.lit("")).alias(c) for c in fields]
    return a.join(b, key, "full_outer").select(key, *filled)


def overlay(df: DataFrame, changes: DataFrame, key: str, fields: list[str], changed_at: str) -> DataFrame:
    """Rows with their latest manual values on top; adds changed."""
    last = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(changed_at))).alias(f"__c_{c}") for c in fields])
    out = df.join(last, key, "left")
    touched = F.lit(False)
    for c in fields:
        touched = touched | (F.col(f"__c_{c}").isNotNull() & ~F.col(f"__c_{c}").eqNullSafe(F.col(c)))
    kept = [F.coalesce(F.col(f"__c_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns]
    return out.select(*kept, touched.alias("changed"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with a difference, as a map of field to (before, after); numbers differ from the sixth decimal on."""
    text = lambda df, c: F.format_number(F.col(c), 6) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("string")
    a = before.select(key, *[text(before, c).alias(f"__a_{c}") for c in fields])
    b = after.select(key, *[text(after, c).alias(f"__b_{c}") for c in fields])
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.struct(F.col(f"__a_{c}").alias("before"), F.col(f"__b_{c}").alias("after")) for c in fields]))
    diff = F.map_filter(pairs, lambda _, v: ~v["before"].eqNullSafe(v["after"]))
    return a.join(b, key).select(key, diff.alias("diff")).where(F.size("diff") > 0)
