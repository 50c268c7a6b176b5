"""Time grids of stays: horizons, buckets, dense grids and their collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_horizon(points: DataFrame, stays: DataFrame, stay: str, hours: int, ahead: int = 0) -> DataFrame:
    """Events of the first ``hours`` (both ends included) of stays of at least ``hours + ahead``.

    An interval's ``stop`` is cut to ``hours``.
    """
    kept = stays.where(F.col("los") >= hours + ahead).select(stay)
    out = points.join(kept, stay, "left_semi").where(F.col("start").between(0, hours))
    return out.withColumn("stop", F.least("stop", F.lit(hours))) if "stop" in points.columns else out


def last_horizon(points: DataFrame, stays: DataFrame, stay: str, hours: int) -> DataFrame:
    """Events of the last ``hours`` of stays of at least that length, with times from the window's begin."""
    kept = stays.where(F.col("los") >= hours).select(stay, (F.col("los") - hours).alias("__shift"))
    shifted = points.join(kept, stay).withColumn("start", F.col("start") - F.col("__shift"))
    if "stop" not in points.columns:
        return shifted.where("start >= 0").drop("__shift")
    return (
        shifted.withColumn("stop", F.col("stop") - F.col("__shift"))
        .where("stop >= 0")
        .withColumn("start", F.greatest("start", F.lit(0)))
        .drop("__shift")
    )


def sane_intervals(meds: DataFrame, stays: DataFrame, stay: str) -> DataFrame:
    """Intervals that begin in their stay and have a length, cut to the stay."""
    return (
        meds.join(stays.where("los > 0").select(stay, "los"), stay)
        .where("start >= 0 and los - start > 0 and stop - start > 0")
        .withColumn("stop", F.least("stop", "los"))
        .drop("los")
    )


def bucketed(points: DataFrame, keys: list[str], size: int, *aggregates: Column) -> DataFrame:
    """Events added up by bucket of ``size`` hours."""
    return points.withColumn("bucket", F.floor(F.col("start") / size)).groupBy(*keys, "bucket").agg(*aggregates)


def dense_grid(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A row for each bucket from 0 to ``n - 1`` of each key; buckets without one have nulls."""
    grid = cells.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return grid.join(cells.where(F.col("bucket").between(0, n - 1)), [*keys, "bucket"], "left")


def filled_forward(value: Column, keys: list[str], order: str) -> Column:
    """The last value so far."""
    return F.last(value, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )


def filled_backward(value: Column, keys: list[str], order: str) -> Column:
    """The next value."""
    return F.first(value, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    )


def med_grid(cells: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Of drugs: ``signal`` 1 while the last stop so far is ahead, ``value`` the last dose, else 0.

    ``cells``: keys, bucket, stop (in buckets), dose. A dose never seen is -1.
    """
    g = dense_grid(cells, keys, n)
    stop = F.coalesce(filled_forward(F.col("stop"), keys, "bucket"), F.lit(0.0))
    dose = F.coalesce(filled_forward(F.col("dose"), keys, "bucket"), F.lit(-1.0))
    signal = (stop - F.col("bucket") > 0).cast("int")
    return g.select(*keys, "bucket", signal.alias("signal"), (signal * dose).alias("value"))


def lab_grid(cells: DataFrame, keys: list[str], n: int, impute: bool = True, middle: str | None = None) -> DataFrame:
    """Of measurements: ``signal`` 1 where measured; ``value`` filled forward, then backward, then with the ``middle`` (mean
    or median) of the key, then 0. A key with any value is filled by its neighbours, so the middle serves keys whose cells are all null.
    """
    g = dense_grid(cells, keys, n)
    ways = [filled_forward(F.col("value"), keys, "bucket"), filled_backward(F.col("value"), keys, "bucket")]
    if middle:
        of = {"mean": F.avg, "median": F.median}[middle]
        ways.append(of("value").over(Window.partitionBy(*keys)))
    filled = F.coalesce(*ways, F.lit(0.0))
    return g.select(
        *keys, "bucket", F.col("value").isNotNull().cast("int").alias("signal"),
        (filled if impute else F.coalesce("value", F.lit(0.0))).alias("value"),
    )


def collapse(grid: DataFrame, key: str, feature: str, value: str, names: list, how: str = "mean") -> DataFrame:
    """One row a key with a column for each of ``names``; missing ones are 0."""
    agg = F.avg if how == "mean" else F.max
    return grid.groupBy(key).pivot(feature, names).agg(agg(value)).na.fill(0)
