"""Ranks, running totals and neighbours within a key, spread over blocks of the order.

A window over a key puts the whole key into one task. These forms put only
one block of the order into a task, so that a key with a third of all rows is
worked on by many tasks; what crosses blocks is a table of one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake.session import cut


def blocked_rank(df: DataFrame, keys: list[str], order: list[Column], block: Column, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the rank from 1 within ``keys`` by ``block`` and ``order``.

    ``block`` must rise with the order. Nulls in ``keys`` are a key of their own,
    equal places in the order get different ranks.
    """
    b = f"__{name}_block"
    df = df.withColumn(b, block)
    inside = Window.partitionBy(*keys, b)
    before = Window.partitionBy(*keys).orderBy(F.col(b).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, b)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    )
    sides = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, b]]
    on = sides[0]
    for s in sides[1:]:
        on = on & s
    return (
        df.alias("l")
        .join(offsets.alias("r"), on)
        .select("l.*", "r.__offset")
        .withColumn(name, F.col("__offset") + F.row_number().over(inside.orderBy(*order)))
        .drop(b, "__offset")
    )


def blocked_dense_rank(df: DataFrame, keys: list[str], order: list[Column], block: str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the dense rank from 1 within ``keys``; rows equal in ``order`` share it.

    The column ``block`` must rise with the order and follow from it; neither it nor ``keys`` may
    be null. It is dropped.
    """
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("__inside", F.dense_rank().over(inside))
    offsets = (
        ranked.groupBy(*keys, block)
        .agg(F.max("__inside").alias("__n"))
        .select(*keys, block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        ranked.join(offsets, [*keys, block])
        .withColumn(name, F.col("__offset") + F.col("__inside"))
        .drop(block, "__offset", "__inside")
    )


def blocked_total(df: DataFrame, keys: list[str], order: list[Column], block: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to and with the row, within ``keys`` by ``block`` and ``order``.

    ``block`` must rise with the order, and neither it nor ``keys`` may be null. Of decimals
    the sums are exact, so they don't depend on the blocks.
    """
    b, v = f"__{name}_block", f"__{name}_v"
    df = df.withColumn(b, block).withColumn(v, value)
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, b).agg(F.sum(v).alias("__sum")).select(*keys, b, F.sum("__sum").over(before).alias("__offset"))
    total = F.sum(v).over(inside)
    return (
        df.join(offsets, [*keys, b])
        .withColumn(name, F.when(F.col("__offset").isNull(), total).otherwise(F.col("__offset") + total))
        .drop(b, v, "__offset")
    )


def blocked_previous(
    df: DataFrame, keys: list[str], order: list[Column], block: Column, value: Column, name: str
) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before, within ``keys``.

    ``block`` must rise with the order and follow from the row. Rows are related within their block; the first and last
    rows of blocks, two of each at most, then across blocks. A null key is a key of
    its own. ``order`` must be total for a defined result.
    """
    b, v = f"__{name}_block", f"__{name}_v"
    df = df.withColumn(b, block).withColumn(v, value)
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    within = (
        df.withColumn("__rn", F.row_number().over(inside))
        .withColumn("__end", F.lead(F.lit(1)).over(inside).isNull())
        .withColumn(name, F.lag(v).over(inside))
    )
    across = Window.partitionBy(*keys).orderBy(F.col(b).asc_nulls_first(), "__rn")
    firsts = within.where("__rn = 1 or __end").withColumn(name, F.lag(v).over(across)).where("__rn = 1")
    return within.where("__rn > 1").unionByName(firsts).drop(b, v, "__rn", "__end")


def blocked_next(df: DataFrame, keys: list[str], order: list[Column], block: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row after, within ``keys``, as ``blocked_previous`` gives that before.

    ``order`` are columns that rise; equal places are told apart by none, so the order must be total.
    """
    return blocked_previous(df, keys, [c.desc_nulls_last() for c in order], -block, value, name)


def value_block(value: Column, parts: int = 64) -> Column:
    """A whole number that rises with ``value``, with ``parts`` steps an octave: blocks of numbers of any scale."""
    size = F.floor((F.log2(F.abs(value)) + 1100) * parts).cast("bigint")
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("bigint"))


def grouped_percentiles(df: DataFrame, key: str, value: str, shares: list[float], name: str = "p") -> DataFrame:
    """``key`` and ``name``: the exact percentiles of each key, interpolated, as an array in order of ``shares``.

    Equal values are counted first; the counts are then added up in blocks of the value, so no key is in one task. Null keys,
    null values and NaN are left out.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = rows.groupBy(key, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = blocked_total(counted, [key], [F.col("__v")], value_block(F.col("__v")), F.col("__n"), "__upto")
    sizes = counted.groupBy(key).agg(F.sum("__n").alias("__all"))
    at = [F.lit(q) * (F.col("__all") - 1) for q in shares]
    # Each value is kept for the places that fall on it.
    placed = total.join(sizes, key)
    ends = [(i, low) for i in range(len(shares)) for low in (True, False)]
    on = lambda p: (F.col("__upto") > p) & (F.col("__upto") - F.col("__n") <= p)
    aggregates = [F.max(F.when(on(F.floor(at[i]) if low else F.ceil(at[i])), F.col("__v"))).alias(f"{'a' if low else 'b'}{i}") for i, low in ends]
    got = placed.groupBy(key).agg(F.max("__all").alias("__all"), *aggregates)
    return got.select(key, F.array(*[F.col(f"a{i}") + (at[i] - F.floor(at[i])) * (F.col(f"b{i}") - F.col(f"a{i}")) for i in range(len(shares))]).alias(name))


#: Rows of a table that may be broadcast.
SMALL = 200_000


def join_small(df: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """The join with a table that is expected to be small: written once and counted, it is broadcast up to ``SMALL`` rows, else joined as any other.

    So a hot key of ``df`` isn't brought together for a table of one row a key.
    """
    small = cut(small)
    return df.join(F.broadcast(small) if small.count() <= SMALL else small, on, how)
