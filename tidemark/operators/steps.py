"""Cutting a plan where several jobs read one intermediate result, and dealing small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder; in the warehouse, which is shared too, only where none is set (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidemark"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the session's shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer partitions than there are cores, dealt over them; larger ones, which are read in more, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
