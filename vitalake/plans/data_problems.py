"""Queries p2 to p6: problems of recorded measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.operators.grid import regular_series, running_amount
from vitalake.operators.impute import fill_readings, impute_chained
from vitalake.operators.intervals import periods_and_gaps
from vitalake.operators.spikes import faulty_readings
from vitalake.operators.units import harmonise
from vitalake.plans.chart import items, readings
from vitalake.sources.tables import table


def _gridded(spark: SparkSession, folder: str) -> DataFrame:
    period = items(spark, folder).select("itemid", (F.col("grid_minutes").cast("bigint") * 60_000_000).alias("period"))
    return readings(spark, folder).where("not missing and t >= 0").join(F.broadcast(period), "itemid")  # fixed table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Slots without a value between the first and the last slot with one.

    What the method gives a slot beside its mark, the share of the increase, isn't asked for here.
    """
    return regular_series(_gridded(spark, folder), ["stay_id", "itemid"], counter=True, only_uncovered=True).select(
        "stay_id", "itemid", "slot"
    )


def p2_series(spark: SparkSession, folder: str) -> DataFrame:
    """The whole series: a row for each slot, marked as observed or uncovered."""
    series = regular_series(_gridded(spark, folder), ["stay_id", "itemid"])
    return series.withColumn("value", F.round("value", 6))


def p2_counter(spark: SparkSession, folder: str) -> DataFrame:
    """Running amount given of each drug of a stay, over all spans of its orders, as a counter, spread over hours."""
    given = (
        table(spark, folder, "preproc_med_icu")
        .where("amount > 0 and starttime is not null and endtime > starttime and stay_id is not null")
        .select("stay_id", "itemid", "orderid", "starttime", "endtime", "amount")
        .distinct()
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    origin = given.groupBy("stay_id").agg(F.min("starttime").alias("origin"))
    spans = given.join(origin, "stay_id").select(
        "stay_id", "itemid", (micros("starttime") - micros("origin")).alias("start"), (micros("endtime") - micros("origin")).alias("end"), "amount"
    )
    hour = 3_600_000_000
    counter = running_amount(spans, ["stay_id", "itemid"], hour).withColumn("period", F.lit(hour))
    series = regular_series(counter, ["stay_id", "itemid"], counter=True)
    # A little more, so that no number lies between two roundings.
    return series.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("value", "increment")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading without a value, by the operator that fills it."""
    return p3_filled(spark, folder).select("row_id")


def p3_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading without a value, with the one filled in and the basis of it."""
    return fill_readings(readings(spark, folder), items(spark, folder))


#: The most categories of a column; each is a field of the regressions.
MOST_CATEGORIES = 100


def _categories(df: DataFrame, column: str) -> list[str]:
    """All categories of ``column`` in order; an error if there are more than ``MOST_CATEGORIES``."""
    found = [r[0] for r in df.where(F.col(column) != "").groupBy(column).count().limit(MOST_CATEGORIES + 1).collect()]
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories")
    return sorted(found)


def p3_stays(spark: SparkSession, folder: str) -> DataFrame:
    """Stays with null los, race and insurance filled from the other fields."""
    visits = table(spark, folder, "visits_iv")
    races, payers = _categories(visits, "race"), _categories(visits, "insurance")
    hours = (F.unix_micros(F.col("dischtime").cast("timestamp")) - F.unix_micros(F.col("admittime").cast("timestamp"))) / 3.6e9
    return impute_chained(
        visits.select("stay_id", "los", hours.alias("hours"), F.col("hospital_expire_flag").cast("double").alias("died"), "race", "insurance"),
        "stay_id",
        ["los", "hours", "died"],
        {"race": races, "insurance": payers},
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous periods under infusion of each stay and the gaps between them."""
    spans = periods_and_gaps(table(spark, folder, "preproc_med_icu"), "stay_id", "starttime", "endtime")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spans.select("stay_id", "kind", text("span_start"), text("span_end"))


def p5_converted(spark: SparkSession, folder: str) -> DataFrame:
    """Every number of labevents in the common unit of its item."""
    return harmonise(table(spark, folder, "labevents"), table(spark, folder, "lab_units"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers recorded in another unit than the common one of their item."""
    return p5_converted(spark, folder).where("not is_common").select("labevent_id", "uom")


def p5_ways(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of each item by where their unit was found; unknown units are counted, too."""
    return p5_converted(spark, folder).groupBy("itemid", "found").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Impossible, stuck (of the very same value) and leaping readings."""
    return faulty_readings(readings(spark, folder).where("not missing and t is not null"), items(spark, folder), vanishing=0.0)


def p6_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The impossible and stuck readings among them, which SQL can tell, too."""
    return p6_found(spark, folder).where("kind <> 'spike'")


QUERIES = {
    "p2_found": p2_found,
    "p2_series": p2_series,
    "p2_counter": p2_counter,
    "p3_found": p3_found,
    "p3_filled": p3_filled,
    "p3_stays": p3_stays,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_converted": p5_converted,
    "p5_ways": p5_ways,
    "p6_found": p6_found,
    "p6_exact": p6_exact,
}
