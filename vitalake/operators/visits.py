"""Visits, consecutive pairs of visits, and what is derived from their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake.operators.ranks import blocked_next, blocked_rank
from vitalake.session import cut


def distinct_concat(events: DataFrame, key: str, code: str, order: list[str], name: str, sep: str = ";") -> DataFrame:
    """Distinct codes of each key, joined in first-seen order.

    Equal codes are reduced before anything is collected; rows with a null key or
    code are left out.
    """
    once = (
        events.where(F.col(key).isNotNull() & F.col(code).isNotNull())
        .groupBy(key, code)
        .agg(F.min(F.struct(*order)).alias("first"))
    )
    return once.groupBy(key).agg(
        F.concat_ws(
            sep, F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(code).alias("code")))), lambda x: x["code"])
        ).alias(name)
    )


def with_aggregates(visits: DataFrame, key: str, *aggregates: DataFrame) -> DataFrame:
    """``visits`` with each of the aggregates; where there is none, an empty text."""
    for a in aggregates:
        visits = visits.join(a, key, "left")
        names = [c for c in a.columns if c != key]
        visits = visits.na.fill("", names)
    return visits


#: Days of a block; a subject's rows are put in order within blocks, and only the ends of blocks meet.
BLOCK_DAYS = 32


def time_block(at: Column) -> Column:
    """The block of a time; null for none."""
    return F.floor(F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")) / BLOCK_DAYS)


def visit_order(visits: DataFrame, subject: str, order: list[str], name: str = "visit_order") -> DataFrame:
    """Number of a visit within its subject, from 0; the first of ``order`` is its time."""
    return blocked_rank(visits, [subject], [F.col(c) for c in order], time_block(F.col(order[0])), name).withColumn(name, F.col(name) - 1)


def consecutive_pairs(visits: DataFrame, subject: str, order: list[str], carry: list[str], min_visits: int = 2) -> DataFrame:
    """Each visit of a subject with the next one, as ``<c>_current`` and ``<c>_next``.

    The next row in place of a self join; the first of ``order`` is the time of the visit. Subjects with less than
    ``min_visits`` visits, or a null subject, have no pairs.
    """
    known = visits.where(F.col(subject).isNotNull())
    if min_visits > 2:  # a visit with a next one has two at least
        enough = known.groupBy(subject).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_visits).select(subject)
        known = known.join(enough, subject, "left_semi")
    columns = list(dict.fromkeys([subject, *order, *carry]))
    linked = blocked_next(known.select(*columns), [subject], [F.col(c) for c in order], time_block(F.col(order[0])), F.struct(*carry), "__next")
    return linked.where(F.col("__next").isNotNull()).select(
        subject,
        *[F.col(c).alias(f"{c}_current") for c in carry],
        *[F.col(f"__next.{c}").alias(f"{c}_next") for c in carry],
    )


def dense_ids(df: DataFrame, order: list[str], name: str = "pair_id") -> DataFrame:
    """Whole numbers from 0 in ``order``, without a window over all rows.

    Rows are sorted into ranges, and their places within the ranges are written to the shared folder
    together with them: the number of a partition isn't the same in another run of the plan. The
    size of each range gives where its numbers begin. Rows equal in ``order`` get different numbers.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(part.alias("__p"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    # One row for each partition.
    return (
        ranged.withColumn("__p", part)
        .join(F.broadcast(starts), "__p")
        .withColumn(name, F.col("__start") + inside)
        .drop("__p", "__m", "__start")
    )


def timing_bucket(days: Column) -> Column:
    """Right-closed bins of days to the next visit; null and negative have none."""
    return (
        F.when(days.isNull() | (days < 0), None)
        .when(days <= 7, "within_7_days")
        .when(days <= 30, "8_to_30_days")
        .when(days <= 90, "31_to_90_days")
        .otherwise("over_90_days")
    )


def timing_labels(df: DataFrame, days: str) -> DataFrame:
    """``df`` with ``bucket`` and ``invalid``, true where the days are missing or negative."""
    return df.withColumn("bucket", timing_bucket(F.col(days))).withColumn("invalid", F.col(days).isNull() | (F.col(days) < 0))


def days_between(a: Column, b: Column) -> Column:
    """Days from ``a`` to ``b`` with their fraction."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86_400_000_000.0)


def visit_sequences(visits: DataFrame, subject: str, time: str, codes: str, reverse: bool = False) -> DataFrame:
    """Per subject the visits in order of time: days since the one before, and codes.

    Columns: subject, ``sequence`` (array of struct of delta_days and codes); the first
    delta is 0. ``codes`` is an array column; visits of one day are one visit. With ``reverse`` the last visit
    comes first, and the days are those to the visit after.
    """
    by_day = visits.where(F.col(subject).isNotNull() & F.col(time).isNotNull()).groupBy(
        subject, F.to_date(time).alias("day")
    ).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(codes)))).alias("codes"))
    days = F.array_sort(F.collect_list(F.struct("day", "codes")))
    listed = by_day.groupBy(subject).agg((F.reverse(days) if reverse else days).alias("s"))
    # A sequence is one row, so the days between are taken from it, without a window.
    before = lambda i: F.get("s", i - 1)["day"]
    delta = lambda x, i: F.when(i > 0, F.abs(F.datediff(x["day"], before(i)))).otherwise(0)
    return listed.select(subject, F.transform("s", lambda x, i: F.struct(delta(x, i).alias("delta_days"), x["codes"].alias("codes"))).alias("sequence"))
