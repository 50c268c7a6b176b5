"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.operators.ranks import blocked_previous, blocked_total

BLOCK_SLOTS = 1024
#: A gap is unfolded in pieces of so many slots.
PIECE = 4096


def _unfold(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each whole number from ``first`` to ``last``, in bounded pieces."""
    pieces = F.sequence(F.floor(first / PIECE), F.floor(last / PIECE))
    return (
        df.where(last >= first)
        .withColumn("__piece", F.explode(pieces))
        .withColumn(
            name,
            F.explode(
                F.sequence(
                    F.greatest(first, F.col("__piece") * PIECE),
                    F.least(last, F.col("__piece") * PIECE + PIECE - 1),
                )
            ),
        )
        .drop("__piece")
    )


def regular_series(readings: DataFrame, keys: list[str], counter: bool = False, only_uncovered: bool = False) -> DataFrame:
    """A row for each slot of a source from its first to its last with a reading.

    ``readings``: ``keys``, ``t`` (microseconds since the origin, 0 or more), ``value`` and
    ``period`` (microseconds of a slot, one for a source). Columns: ``keys``, ``slot``,
    ``n`` (readings), ``value``, ``status``; of counters also ``increment``.

    Of gauges (the default) the value is the mean of the slot's readings; in a slot
    without one, the last reading before. Of cumulative counters, the increase
    between two consecutive readings (the reading itself after a reset, that is a fall)
    is distributed over the slots in between in proportion to the overlap, and ``value``
    is the last reading so far. ``status`` is ``observed``, or ``uncovered`` in slots
    without a reading; ``only_uncovered`` gives those alone, without going through the rest: readings are then
    reduced to the first and last of each slot before they are shuffled.

    Rows with a null key, t, value or period or with a t below 0 are left out. Of
    several readings at one instant the largest counts. Repeated rows don't
    change slots or increments; an empty table gives an empty one. A source is worked on
    in blocks of ``BLOCK_SLOTS`` slots.
    """
    valid = (
        readings.select(*keys, "t", F.col("value").cast("double").alias("value"), "period")
        .na.drop()
        .where(F.col("t") >= 0)
        .withColumn("slot", F.floor(F.col("t") / F.col("period")))
    )
    block = F.floor(F.col("slot") / BLOCK_SLOTS)
    if only_uncovered or not counter:
        slots = valid.groupBy(*keys, "slot").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            F.max("period").alias("period"),
            F.min(F.struct(F.col("t"), (-F.col("value")).alias("less"))).alias("first"),
            F.max(F.struct("t", "value")).alias("last"),
        )
        linked = blocked_previous(slots, keys, [F.col("slot")], block, F.struct("slot", "last"), "prior")
        step = -F.col("first.less") - F.col("prior.last.value")
        if counter:
            step = F.when(step < 0, -F.col("first.less")).otherwise(step)
        # A slot without a reading lies within the span between two readings as a whole.
        rate = step / (F.col("first.t") - F.col("prior.last.t"))
        gaps = _unfold(
            linked.where(F.col("prior").isNotNull() & (F.col("slot") - F.col("prior.slot") > 1)).select(
                *keys, F.col("prior.slot").alias("__from"), F.col("slot").alias("__to"), F.col("prior.last.value").alias("value"),
                (rate * F.col("period")).alias("increment"),
            ),
            F.col("__from") + 1,
            F.col("__to") - 1,
            "slot",
        ).select(*keys, "slot", F.lit(0).cast("bigint").alias("n"), "value", F.lit("uncovered").alias("status"), "increment")
        if not counter:
            gaps = gaps.drop("increment")
        if only_uncovered:
            return gaps
        return slots.select(*keys, "slot", "n", F.col("mean").alias("value"), F.lit("observed").alias("status")).unionByName(gaps)
    distinct = valid.groupBy(*keys, "t").agg(F.max("value").alias("value"), F.max("period").alias("period")).withColumn(
        "slot", F.floor(F.col("t") / F.col("period"))
    )
    linked = blocked_previous(distinct, keys, [F.col("t")], block, F.struct("t", "value", "slot"), "prior")
    step = F.col("value") - F.col("prior.value")
    spans = linked.select(
        *keys,
        "period",
        F.coalesce(F.col("prior.t"), F.col("t")).alias("__a"),
        F.col("t").alias("__b"),
        F.coalesce(F.col("prior.slot"), F.col("slot")).alias("__from"),
        F.col("slot").alias("__to"),
        F.when(F.col("prior").isNull(), 0.0).when(step < 0, F.col("value")).otherwise(step).alias("__step"),
        F.coalesce(F.col("prior.value"), F.col("value")).alias("__before"),
        F.col("value").alias("__after"),
    )
    cells = _unfold(spans, F.col("__from"), F.col("__to"), "slot")
    low = F.greatest(F.col("__a"), F.col("slot") * F.col("period"))
    high = F.least(F.col("__b"), (F.col("slot") + 1) * F.col("period"))
    length = F.col("__b") - F.col("__a")
    ends_here = F.col("slot") == F.col("__to")
    shared = cells.select(
        *keys,
        "slot",
        ends_here.cast("bigint").alias("n"),
        F.when(length > 0, F.col("__step") * (high - low) / length).otherwise(0.0).alias("increment"),
        F.struct(F.col("__b").alias("t"), F.when(ends_here, F.col("__after")).otherwise(F.col("__before")).alias("v")).alias("seen"),
        ends_here.alias("seen_here"),
    )
    return shared.groupBy(*keys, "slot").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.max(F.when(F.col("seen_here"), F.col("seen"))).getField("v"), F.max("seen.v")).alias("value"),
        F.when(F.sum("n") > 0, "observed").otherwise("uncovered").alias("status"),
        F.sum("increment").alias("increment"),
    )


def running_amount(spans: DataFrame, keys: list[str], period: int) -> DataFrame:
    """The running amount of ``keys`` at each start and end of a span, as readings ``t`` and ``value`` of a counter.

    ``spans``: ``keys``, ``start`` and ``end`` (microseconds, 0 or more), ``amount``, given evenly
    over the span. Spans may touch, overlap, nest or lie apart: at any time the rates of
    all spans under way add up. Rates and parts are added up as decimals, so the counter
    never falls, and it ends at the sum of the amounts to 1e-9.

    Rows with a null, without length or with an amount that isn't positive and finite are left
    out; each further row is an amount of its own; an empty table gives an empty one. A
    source is worked on in blocks of ``BLOCK_SLOTS`` slots of ``period`` microseconds.
    """
    rate = (F.col("amount") * 1e6 / (F.col("end") - F.col("start"))).cast("decimal(30,18)")
    valid = spans.select(*keys, "start", "end", F.col("amount").cast("double").alias("amount")).na.drop().where("end > start and amount > 0 and amount < double('infinity')")
    steps = (
        valid.select(*keys, "start", "end", rate.alias("rate"))
        .select(*keys, F.explode(F.array(F.struct(F.col("start").alias("t"), F.col("rate")), F.struct(F.col("end").alias("t"), (-F.col("rate")).alias("rate")))).alias("x"))
        .groupBy(*keys, "x.t")
        .agg(F.sum("x.rate").alias("step"))
    )
    block = F.floor(F.col("t") / (BLOCK_SLOTS * period))
    order = [F.col("t")]
    rates = blocked_total(steps, keys, order, block, F.col("step"), "rate")
    linked = blocked_previous(rates, keys, order, block, F.struct("t", "rate"), "prior")
    given = F.col("prior.rate").cast("double") * (F.col("t") - F.col("prior.t")) / 1e6
    part = F.coalesce(given, F.lit(0.0)).cast("decimal(30,12)")
    return blocked_total(linked, keys, order, block, part, "total").select(*keys, "t", F.col("total").cast("double").alias("value"))
