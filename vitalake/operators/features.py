"""Cleaning, mapping and summaries of coded and measured features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake.operators.ranks import grouped_percentiles, join_small


def first_match(mapping: DataFrame, key: Column, value: str, order: list[str]) -> DataFrame:
    """``key`` and ``value`` of the first row of each key in file order."""
    return mapping.select(key.alias("key"), value, *order).where("key is not null").groupBy("key").agg(
        F.min_by(value, F.struct(*order)).alias(value)
    )


def last_match(mapping: DataFrame, key: Column, value: str, order: list[str]) -> DataFrame:
    """``key`` and ``value`` of the last row of each key in file order."""
    return mapping.select(key.alias("key"), value, *order).where("key is not null").groupBy("key").agg(
        F.max_by(value, F.struct(*order)).alias(value)
    )


def feature_summary(events: DataFrame, visit: str, code: str, value: str | None = None) -> DataFrame:
    """Of each code: ``total_count``, ``mean_frequency`` per visit that has it, and ``missing_pct``, the share of zeros.

    One pass: the mean over visits of the count in a visit is the total over the number of visits.
    """
    counts = events.where(F.col(code).isNotNull() & F.col(visit).isNotNull())
    # By visit first: the second step sees one row a code and visit.
    per = counts.groupBy(code, visit).agg(
        F.count(F.lit(1)).alias("n"), (F.lit(0) if value is None else F.sum(F.when(F.col(value) == 0, 1).otherwise(0))).alias("zeros")
    )
    return per.groupBy(code).agg(
        F.sum("n").alias("total_count"),
        (F.sum("n") / F.count(F.lit(1))).alias("mean_frequency"),
        (100.0 * F.sum("zeros") / F.sum("n")).alias("missing_pct"),
    )


def keep_main_unit(events: DataFrame, item: str, unit: str, share: float = 0.95) -> DataFrame:
    """Without the rows of other units than an item's main one, where that has more than ``share`` of its rows.

    Null units count in the number of rows, but aren't a unit; they go where the filter applies.
    """
    per_unit = events.groupBy(item, unit).agg(F.count(F.lit(1)).alias("n"))
    per_item = per_unit.groupBy(item).agg(
        F.sum("n").alias("rows"),
        F.count(unit).alias("units"),
        F.max(F.when(F.col(unit).isNotNull(), F.struct("n", unit))).alias("top"),
    )
    ruled = per_item.where((F.col("units") > 1) & (F.col("top.n") > share * F.col("rows"))).select(
        F.col(item).alias("__i"), F.col(f"top.{unit}").alias("__u")
    )
    return (
        join_small(events, ruled, F.col(item) == F.col("__i"), "left")
        .where(F.col("__i").isNull() | F.coalesce(F.col(unit) == F.col("__u"), F.lit(False)))
        .drop("__i", "__u")
    )


def outlier_bounds(events: DataFrame, item: str, value: str, left: float, right: float) -> DataFrame:
    """Exact percentiles of each item, interpolated; equal values are counted before they are ranked, in blocks."""
    got = grouped_percentiles(events, item, value, [left / 100, right / 100])
    return got.select(item, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def winsorise(events: DataFrame, item: str, value: str, left: float = 0, right: float = 98, drop: bool = False) -> DataFrame:
    """Values outside an item's percentiles set to them, or their rows left out."""
    joined = join_small(events, outlier_bounds(events, item, value, left, right), item)
    if drop:
        return joined.where(F.col(value).between(F.col("low"), F.col("high"))).drop("low", "high")
    return joined.withColumn(value, F.greatest(F.least(value, "high"), F.col("low"))).drop("low", "high")


def assign_visits(events: DataFrame, visits: DataFrame, event_key: list[str], time: str) -> DataFrame:
    """``events`` with a null hadm_id given that of the subject's visit around them.

    A visit holds an event if the event's day is from the day of its admission to that of its
    discharge; of several, that admitted last before the event, then the smallest
    hadm_id. Visits are unfolded by blocks of days, so the join is an equality, and a
    subject with very many events is spread over blocks. Where no visit holds the event, hadm_id stays null.
    """
    block = 32
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    stays = (
        visits.select("subject_id", F.col("hadm_id").alias("v_hadm"), day("admittime").alias("a"), day("dischtime").alias("d"))
        .where("subject_id is not null and v_hadm is not null and a is not null and d >= a")
        .distinct()
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.col("d") / block))))
    )
    open_ = events.where(F.col("hadm_id").isNull()).select(*event_key, "subject_id", day(time).alias("t")).withColumn(
        "block", F.floor(F.col("t") / block)
    )
    found = (
        open_.join(stays, ["subject_id", "block"])
        .where("t between a and d")
        .groupBy(*event_key)
        .agg(F.min_by("v_hadm", F.struct(F.col("t") - F.col("a"), "v_hadm")).alias("__found"))
    )
    return (
        events.join(found, event_key, "left")
        .withColumn("hadm_id", F.coalesce("hadm_id", "__found"))
        .drop("__found")
    )


def top_by_subjects(events: DataFrame, code: str, subject: str, n: int) -> DataFrame:
    """The ``n`` codes that most subjects have."""
    return (
        events.where(F.col(code).isNotNull())
        .groupBy(code)
        .agg(F.count_distinct(subject).alias("subjects"))
        .orderBy(F.desc("subjects"), code)
        .limit(n)
    )


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """``df`` with the place of a row within its keys, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_by_total(events: DataFrame, code: str, n: int) -> DataFrame:
    """The ``n`` codes with most events, with their ``total``."""
    return events.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), code).limit(n)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in a total order, so that a run repeats itself."""
    return df.orderBy(*order).limit(n)


def of_kinds(df: DataFrame, column: str, kinds: list) -> DataFrame:
    """Rows whose ``column`` is one of ``kinds``; null is none."""
    return df.where(F.col(column).isin(kinds))


def with_group_max(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` of its key; keys are reduced first, and null keys have none."""
    most = df.groupBy(key).agg(F.max(value).alias(name))
    return df.join(most, key, "left")


def means_by(df: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """Rows and the mean of each column by ``part``."""
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns])


def largest_group(df: DataFrame, key: str, *sizes: Column) -> DataFrame:
    """One row: the greatest of each of ``sizes``, aggregates by key; null keys don't count."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(*sizes)
    return per.agg(*[F.max(c).alias(c) for c in per.columns if c != key])


def label_report(df: DataFrame, label: str) -> DataFrame:
    """``n`` and ``share``, to four places, of each label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("__all"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("share", F.round(F.col("n") / F.col("__all"), 4)).drop("__all")  # one row


def first_examples(df: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each label in order of the unique column ``order``; whole partitions are reduced to ``n`` before they meet."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("__rn") <= n).drop("__rn")


def pivoted_top(events: DataFrame, key: str, code: str, subject: str, n: int, value: str | None = None) -> DataFrame:
    """A row a key with a column for each of the ``n`` codes that most subjects have: 1 if it has the code, or the mean of ``value``; else 0."""
    chosen = [r[0] for r in top_by_subjects(events, code, subject, n).collect()]  # ``n`` rows
    kept = events.where(F.col(code).isin(chosen))
    cell = F.max(F.lit(1)) if value is None else F.avg(value)
    return kept.groupBy(key).pivot(code, chosen).agg(cell).na.fill(0)


def in_cohort(domains: dict[str, DataFrame], cohort: DataFrame, visit: str, chosen: dict[str, DataFrame] | None = None, code: str = "code") -> dict[str, DataFrame]:
    """Each domain's events of the visits of a cohort; of a domain with a list of ``chosen`` codes, those alone.

    ``domains`` with an event table each; ``chosen`` has one column ``code``.
    """
    visits = cohort.select(visit).where(F.col(visit).isNotNull()).distinct()
    out = {name: df.join(visits, visit, "left_semi") for name, df in domains.items()}
    for name, codes in (chosen or {}).items():
        out[name] = out[name].join(codes.select(code).distinct(), code, "left_semi")
    return out


def output_frame(df: DataFrame, key: str, y: str, score: str, demographics: DataFrame, by: str) -> DataFrame:
    """What a model gave for each row: label, probability, its logarithm of odds to base 2, and the demographics by ``by``."""
    odds = F.when((F.col(score) > 0) & (F.col(score) < 1), F.log2(F.col(score) / (1 - F.col(score))))
    return df.select(key, by, F.col(y).alias("y"), F.col(score).alias("probability"), odds.alias("logit")).join(demographics, by, "left")
