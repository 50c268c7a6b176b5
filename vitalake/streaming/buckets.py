"""Hour buckets and clean-up of event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of each window and key; rows later than ``late`` are left out of a stream."""
    return (
        events.withColumn("__t", F.col(time).cast("timestamp"))
        .withWatermark("__t", late)
        .groupBy(F.window("__t", size), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
        .select(F.col("window.start").alias("start"), *keys, "n", "mean")
    )


def each_batch(operator: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that applies a batch operator and writes the result."""

    def run(batch: DataFrame, _: int) -> None:
        write(operator(batch))

    return run
