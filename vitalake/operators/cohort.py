"""Cohort labels of visits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Days of a block of a subject.
BLOCK_DAYS = 32


@dataclass(frozen=True)
class Entity:
    """Names of the columns of a visit."""

    subject: str = "subject_id"
    visit: str = "hadm_id"
    start: str = "admittime"
    end: str = "dischtime"


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def whole_hours(later: Column, earlier: Column) -> Column:
    """Hours between, rounded down also where negative."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(3_600_000_000)).cast("bigint")


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between, rounded down also where negative."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000)).cast("bigint")


def readmission(visits: DataFrame, gap_days: int, e: Entity = Entity()) -> DataFrame:
    """``label`` 1 where the subject is admitted again later than the end and within ``gap_days`` of it.

    The last visit of a subject (by start, then visit) is always 0, as is one without an
    end. Starts and ends are merged in order of time within blocks of ``BLOCK_DAYS``, so the first start after an end is
    found in one sort, also where visits overlap; of other blocks only the first start is looked at.
    """
    width = BLOCK_DAYS * 86_400_000_000
    kept = visits.where(F.col(e.subject).isNotNull() & F.col(e.start).isNotNull())
    columns = [F.col(c) for c in visits.columns]
    order = F.struct(F.col(e.start), F.col(e.visit))
    points = kept.select(
        F.col(e.subject).alias("__s"),
        F.explode(
            F.array(
                F.struct(micros(F.col(e.start)).alias("at"), F.lit(0).alias("kind"), order.alias("place"), F.lit(None).alias("row")),
                F.struct(micros(F.col(e.end)).alias("at"), F.lit(1).alias("kind"), order.alias("place"), F.struct(*columns).alias("row")),
            )
        ).alias("p"),
    ).select("__s", "p.*").withColumn("__b", F.floor(F.col("at") / width))
    # Of one instant, starts come first: a start at the very end is no return.
    after = Window.partitionBy("__s", "__b").orderBy(F.col("at").asc_nulls_last(), "kind").rowsBetween(0, Window.unboundedFollowing)
    inside = F.first(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(after)
    # One row a block of a subject: its first start, and the first one in later blocks.
    later = Window.partitionBy("__s").orderBy("__b").rowsBetween(1, Window.unboundedFollowing)
    starts = points.where("kind = 0").groupBy("__s", "__b").agg(F.min("at").alias("first"), F.max("place").alias("last"))
    blocks = points.where("__b is not null").select("__s", "__b").distinct().join(starts, ["__s", "__b"], "left").select(
        F.col("__s").alias("s"), F.col("__b").alias("b"), F.min("first").over(later).alias("next"),
        F.max("last").over(Window.partitionBy("__s")).alias("very_last"),
    )
    found = points.withColumn("again", inside).where("kind = 1").join(
        blocks, (F.col("__s") == F.col("s")) & (F.col("__b") == F.col("b")), "left"
    )
    again = F.coalesce("again", "next")
    is_last = F.coalesce(F.col("place") == F.col("very_last"), F.lit(True))  # without an end it is 0 anyway
    label = ~is_last & F.col("at").isNotNull() & again.isNotNull() & (again - F.col("at") <= F.lit(gap_days * 86_400_000_000))
    return found.select(*[F.col(f"row.{c}").alias(c) for c in visits.columns], F.coalesce(label.cast("int"), F.lit(0)).alias("label"))


def long_stay(visits: DataFrame, los: Column, days: float) -> DataFrame:
    """``label`` 1 where the stay is longer than ``days``."""
    return visits.withColumn("label", F.coalesce((los > days).cast("int"), F.lit(0)))


def died_within(death: Column, start: Column, end: Column) -> Column:
    """1 where death is between start and end, both included; no death is 0."""
    return F.when(death.between(start, end), 1).otherwise(0)


def mortality(visits: DataFrame, death: Column, e: Entity = Entity()) -> tuple[DataFrame, DataFrame]:
    """Labelled visits, and those that can't be judged for want of a start or end."""
    valid = F.col(e.start).isNotNull() & F.col(e.end).isNotNull()
    return (
        visits.where(valid).withColumn("label", died_within(death, F.col(e.start), F.col(e.end))),
        visits.where(~valid),
    )


def with_code(events: DataFrame, visit: str, root: Column, pattern: str) -> DataFrame:
    """Visits with an event whose code root contains ``pattern``, for a left semi join."""
    return events.where(root.rlike(pattern)).select(visit).where(F.col(visit).isNotNull()).distinct()


def icu_age(birth_year: Column, at: Column) -> Column:
    """Age by years; one below zero, as shifted dates of the very old give, is 90."""
    age = F.year(at) - birth_year
    return F.when(age < 0, 90).otherwise(age)


def year_window(group: Column, year: Column, anchor: Column) -> Column:
    """A year's true counterpart: the last year of the anchor's group and the distance to the anchor."""
    return F.right(group, F.lit(4)).try_cast("int") + (year - anchor)


def labelled(visits: DataFrame, task: str, e: Entity = Entity(), **how) -> DataFrame:  # noqa: ANN003
    """``visits`` with the label of a task: ``readmission`` (gap_days), ``los`` (los, days), ``mortality`` (death)."""
    if task == "readmission":
        return readmission(visits, how["gap_days"], e)
    if task == "los":
        return long_stay(visits, how["los"], how["days"])
    if task == "mortality":
        return mortality(visits, how["death"], e)[0]
    raise ValueError(f"unknown task {task}")


def window_index(low: Column, high: Column, shift: Column, first: int = 2008, last: int = 2019) -> Column:
    """The number of a three-year window, ``low`` to ``high`` moved by ``shift``, from 0 for that beginning in ``first``; null outside."""
    a, b = low + shift, high + shift
    return F.when((a >= first) & (a <= last - 2) & (b >= first + 2) & (b <= last), a - first)


def days_into_year(at: Column) -> Column:
    """Whole days since the begin of the year."""
    return F.datediff(F.to_date(at), F.trunc(F.to_date(at), "year"))


def window_valid(last_year: Column, limit: int) -> Column:
    """Whether a window ends by ``limit``; null isn't valid."""
    return F.coalesce(last_year <= limit, F.lit(False))


def birth_year(anchor_year: Column, anchor_age: Column) -> Column:
    """The year of birth from an anchor."""
    return anchor_year - anchor_age


def phenotype(visits: DataFrame, events: DataFrame, visit: str, code: Column, pattern: str, gap_days: int, e: Entity = Entity()) -> DataFrame:
    """Readmission within ``gap_days`` of all visits, kept for those with a code that matches ``pattern``."""
    return readmission(visits, gap_days, e).join(with_code(events, visit, code, pattern), visit, "left_semi")
