"""Continuous periods of overlapping intervals and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.operators.ranks import blocked_rank


def periods_and_gaps(
    df: DataFrame, entity: str, start: str, end: str, block_seconds: int = 14_400
) -> DataFrame:
    """One row for each continuous period of an entity and each gap between two.

    Starts and ends are ranked independently: with the k-th end before the
    (k+1)-th start, every interval begun so far is over, so a gap lies between
    the two. First start, gap borders and last end, paired by rank, are the
    periods. Ranks are counted in blocks of ``block_seconds``, so that an entity
    with very many intervals is spread over tasks.

    Columns: ``entity``, ``kind`` (``period`` or ``gap``), ``span_start``,
    ``span_end``. Rows with a null entity or bound, or an end not after its start,
    are left out; touching intervals are one period; repeated rows change nothing;
    an empty table gives an empty table; further columns are not looked at.
    """
    spans = (
        df.select(F.col(entity).alias("__e"), F.col(start).alias("__s"), F.col(end).alias("__t"))
        .where(F.col("__e").isNotNull() & (F.col("__t") > F.col("__s")))
        .distinct()
    )

    def ranked(bounds: DataFrame) -> DataFrame:
        block = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (block_seconds * 1_000_000))
        return blocked_rank(bounds, ["__e", "side"], [F.col("at")], block, "k")

    bounds = spans.select(
        "__e",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("__s").alias("at")),
                F.struct(F.lit(1).alias("side"), F.col("__t").alias("at")),
            )
        ).alias("b"),
    ).select("__e", "b.side", "b.at")
    # The start of rank k + 1 meets the end of rank k; the first start meets no
    # end and the last end no start.
    met = (
        ranked(bounds)
        .withColumn("at_rank", F.col("k") - F.when(F.col("side") == 0, 1).otherwise(0))
        .groupBy("__e", "at_rank")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("at"))).alias("opens"),
            F.max(F.when(F.col("side") == 1, F.col("at"))).alias("closes"),
        )
        .where(F.col("opens").isNull() | F.col("closes").isNull() | (F.col("opens") > F.col("closes")))
    )
    borders = met.select(
        "__e",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("opens").alias("at"), F.col("closes").alias("gap_from")),
                F.struct(F.lit(1).alias("side"), F.col("closes").alias("at"), F.lit(None).alias("gap_from")),
            )
        ).alias("b"),
    ).select("__e", "b.side", "b.at", "b.gap_from")
    paired = (
        ranked(borders.where(F.col("at").isNotNull()))
        .groupBy("__e", "k")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("at"))).alias("opens"),
            F.max(F.when(F.col("side") == 1, F.col("at"))).alias("closes"),
            F.max("gap_from").alias("gap_from"),
        )
    )
    return (
        paired.select(
            "__e",
            F.explode(
                F.array(
                    F.struct(
                        F.lit("period").alias("kind"), F.col("opens").alias("span_start"), F.col("closes").alias("span_end")
                    ),
                    F.struct(
                        F.lit("gap").alias("kind"), F.col("gap_from").alias("span_start"), F.col("opens").alias("span_end")
                    ),
                )
            ).alias("b"),
        )
        .select(F.col("__e").alias(entity), "b.kind", "b.span_start", "b.span_end")
        .where(F.col("span_start").isNotNull())
    )
