"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (a file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, per_slot: int = 2) -> DataFrame:
    """Split a scan of few, small files for work that is heavy on the CPU.

    A no-op where the scan has enough partitions, as it has on large tables.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots * per_slot)
