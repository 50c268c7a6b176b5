"""Stand-ins for missing numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A stand-in makes up this share of the rows outside all bounds at least, so there are 200 at most.
LEAST_SHARE = 0.005


def stand_ins(df: DataFrame, item: str, value: str, low: float, high: float) -> list[float]:
    """The fixed numbers that stand for a missing value, at most 200.

    Such a number is outside ``low`` to ``high`` (the widest bounds of any item), is
    among the commonest numbers there and is used with at least half as many items
    as it can be: of all items with such rows, or of its own rows if those are fewer.
    Null and NaN are not looked at; an empty table has none.
    """
    outside = df.where(((F.col(value) < low) | (F.col(value) > high)) & ~F.isnan(value)).select(
        F.col(item).alias("__i"), F.col(value).alias("__v")
    )
    by_item = outside.groupBy("__v", "__i").agg(F.count(F.lit(1)).alias("n"))
    by_value = by_item.groupBy("__v").agg(F.sum("n").alias("n"), F.count("__i").alias("items"))
    whole = by_item.agg(F.sum("n").alias("rows"), F.count_distinct("__i").alias("all_items"))
    rows = (
        by_value.crossJoin(F.broadcast(whole))  # one row
        .where(
            (F.col("n") >= 3)
            & (F.col("n") >= LEAST_SHARE * F.col("rows"))
            & (F.col("items") >= 0.5 * F.least("n", "all_items"))
        )
        .select("__v")
        .collect()
    )
    return sorted(r[0] for r in rows)


def is_missing(value: Column, numbers: list[float]) -> Column:
    """True where ``value`` is null, not a number or one of ``numbers``."""
    return value.isNull() | F.isnan(value) | (value.isin(numbers) if numbers else F.lit(False))
