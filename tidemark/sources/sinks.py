"""Writers: append, replacement by scope, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_scope(df: DataFrame, path: str, scope: tuple[str, ...]) -> None:
    """Replace only the partitions (values of ``scope``) that ``df`` holds; a rerun gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
