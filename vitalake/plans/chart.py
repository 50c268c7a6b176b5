"""Readings of the chart table in the form the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.functions.durations import duration_micros
from vitalake.operators.missing import is_missing, stand_ins
from vitalake.sources.tables import table


def items(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed table of chart items."""
    return table(spark, folder, "d_items").where("linksto = 'chartevents'")


def chart_stand_ins(spark: SparkSession, folder: str) -> list[float]:
    """Stand-ins for a missing number in the chart table."""
    low, high = items(spark, folder).agg(F.min("physical_low"), F.max("physical_high")).first()
    return stand_ins(table(spark, folder, "preproc_chart_icu"), "itemid", "valuenum", low, high)


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """row_id, stay_id, itemid, t (microseconds since intime), value, missing."""
    numbers = chart_stand_ins(spark, folder)
    return table(spark, folder, "preproc_chart_icu").select(
        "row_id",
        "stay_id",
        "itemid",
        duration_micros(F.col("event_time_from_admit")).alias("t"),
        F.col("valuenum").alias("value"),
        is_missing(F.col("valuenum"), numbers).alias("missing"),
    )
