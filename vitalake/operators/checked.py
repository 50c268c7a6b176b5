"""Joins and tables that are checked: required columns, lost rows, one-to-one keys, equal sizes."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """``df`` itself; a KeyError that names all missing columns if it lacks any."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"{what} lacks {', '.join(missing)}")
    return df


def distinct_on(df: DataFrame, keys: list[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in ``order``; null keys are a key of their own.

    Rows are reduced before the shuffle, so a key with very many rows isn't brought together.
    """
    others = [c for c in df.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(1).alias("one"))
    first = df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("__first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns])


def join_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row on the join of two tables by ``key``: rows and distinct keys of each, rows on either side without a partner, rows of the join.

    Keys are counted before they meet, so nothing but counts is joined. Null keys have no partner.
    """
    def counted(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(n))

    both = counted(left, "a").join(counted(right, "b"), "k", "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n)
    return both.agg(
        total(a, "left_rows"), total(b, "right_rows"), total(F.when(F.col("k").isNotNull() & (a > 0), 1), "left_keys"),
        total(F.when(F.col("k").isNotNull() & (b > 0), 1), "right_keys"), total(F.when((b == 0) | F.col("k").isNull(), a), "left_alone"),
        total(F.when((a == 0) | F.col("k").isNull(), b), "right_alone"), total(F.when(F.col("k").isNotNull(), a * b), "joined"),
    )


def inner_checked(left: DataFrame, right: DataFrame, key: str, lost: str = "warn") -> DataFrame:
    """The inner join by ``key``; rows of ``left`` without a partner give a warning (``lost``: warn, error or ignore), an empty result a ValueError."""
    r = join_report(left, right, key).first()
    if r["joined"] == 0:
        raise ValueError(f"no row of the two tables shares {key}")
    if r["left_alone"] and lost != "ignore":
        text = f"{r['left_alone']} of {r['left_rows']} rows have no partner by {key}"
        if lost == "error":
            raise ValueError(text)
        log.warning(text)
    return left.join(right, key)


def left_first(left: DataFrame, right: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The left join with the first row of each key of ``right``, so there are as many rows as in ``left``."""
    return left.join(distinct_on(right.where(F.col(key).isNotNull()), [key], order), key, "left")


def one_to_one(left: DataFrame, right: DataFrame, key: str, not_null: Sequence[str] = ()) -> DataFrame:
    """The left join by a key that is unique on both sides; a ValueError if it isn't, or if a column of ``not_null`` is null after it."""
    r = join_report(left, right, key).first()
    if r["left_keys"] != r["left_rows"] or r["right_keys"] != r["right_rows"]:
        raise ValueError(f"{key} isn't unique")
    out = left.join(right, key, "left")
    if not_null and (n := out.where(" or ".join(f"`{c}` is null" for c in not_null)).count()):
        raise ValueError(f"{n} rows have a null in {', '.join(not_null)}")
    return out


def equal_size_join(left: DataFrame, right: DataFrame, key: str, suffix: str = "_right") -> DataFrame:
    """The inner join; both sides and the result must have as many rows. Further columns of ``right`` that clash get ``suffix``."""
    r = join_report(left, right, key).first()
    if not r["left_rows"] == r["right_rows"] == r["joined"]:
        raise ValueError(f"sizes differ: {r['left_rows']} and {r['right_rows']} rows, {r['joined']} joined")
    clash = {c: f"{c}{suffix}" for c in right.columns if c != key and c in left.columns}
    return left.join(right.withColumnsRenamed(clash), key)


def data_quality(df: DataFrame, key: str, required: Sequence[str] = ()) -> DataFrame:
    """One row: rows, distinct keys, rows whose key comes again, and rows that lack any of ``required`` (null or blank)."""
    absent = F.lit(False)
    for c in required:
        absent = absent | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(absent.cast("bigint")).alias("absent"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(key).alias("keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("again"), F.coalesce(F.sum("absent"), F.lit(0)).alias("absent"),
    )
