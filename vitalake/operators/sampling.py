"""Splits, folds and samples that repeat themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.operators.ranks import blocked_rank

#: A multiplicative hash on whole numbers that any SQL engine has.
MULTIPLIER, MODULUS = 2_654_435_761, 4_294_967_296
#: Rows are ranked in blocks of the hash, 16,384 of them.
BLOCK = 1 << 18


def arithmetic_hash(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 2^32 that depends on nothing but ``key`` and ``seed``."""
    return F.pmod((key.cast("bigint") % F.lit(1_000_003) + F.lit(seed)) * F.lit(MULTIPLIER), F.lit(MODULUS))


def hash_ranked(df: DataFrame, strata: list[str], key: str, seed: int = 0, name: str = "rank") -> DataFrame:
    """``df`` with the place of a row within its stratum in order of the hash, from 1."""
    h = arithmetic_hash(F.col(key), seed)
    return blocked_rank(df, strata, [h, F.col(key)], F.floor(h / BLOCK), name)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``split``: of each label the first rows by hash are test, rounded up, the rest train."""
    sizes = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * share).alias("quota"))
    ranked = hash_ranked(df, [label], key, seed).alias("r")
    return (
        ranked.join(sizes.alias("s"), F.col(f"r.{label}").eqNullSafe(F.col(f"s.{label}")))
        .select("r.*", F.when(F.col("rank") <= F.col("quota"), "test").otherwise("train").alias("split"))
        .drop("rank")
    )


def folds(df: DataFrame, key: str, k: int, label: str | None = None, seed: int = 0, equal: bool = False) -> DataFrame:
    """``fold`` from 0 to ``k - 1``, of each label in turns if ``label`` is given; ``equal``: folds of one size, the rest left out."""
    one = df if label else df.withColumn("__all", F.lit(1))
    ranked = hash_ranked(one, [label or "__all"], key, seed)
    if equal:
        size = df.agg((F.floor(F.count(F.lit(1)) / k) * k).alias("__kept"))
        ranked = ranked.crossJoin(F.broadcast(size)).where(F.col("rank") <= F.col("__kept")).drop("__kept")  # one row
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "__all")


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by hash, the same in every run."""
    h = arithmetic_hash(F.col(key), seed)
    return df.orderBy(h, F.col(key)).limit(n)


def exemplars(
    df: DataFrame, label: str, key: str, positive: int, negative: int, matched: bool = False, seed: int = 0, strategy: str | None = None
) -> DataFrame:
    """``positive`` and ``negative`` rows by hash; ``matched``: as many in all, in the labels' proportion, one positive at least.

    ``strategy`` names one of these instead: random_balanced, prevalence_matched, or similarity, which is as random_balanced; a
    ValueError for an unknown one. The share of positives is that of all rows.
    """
    if strategy is not None:
        if strategy not in ("random_balanced", "prevalence_matched", "similarity"):
            raise ValueError(f"unknown strategy {strategy}")
        matched = strategy == "prevalence_matched"
    if matched:
        share = df.agg(F.avg(F.coalesce((F.col(label) == 1).cast("double"), F.lit(0.0)))).first()[0] or 0.0
        total = positive + negative
        positive = max(1, round(total * share))
        negative = total - positive
    ranked = hash_ranked(df.where(F.col(label).isin(0, 1)), [label], key, seed)
    return ranked.where(F.col("rank") <= F.when(F.col(label) == 1, positive).otherwise(negative))


def oversampled(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Rows of the rarer label repeated by turns until there are as many as of the other; ``copy`` from 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    plan = counts.crossJoin(F.broadcast(most))  # one row
    ranked = hash_ranked(df, [label], key, seed).alias("r")
    times = F.floor(F.col("p.most") / F.col("p.n")) + (F.col("rank") <= F.col("p.most") % F.col("p.n")).cast("bigint")
    return (
        ranked.join(plan.alias("p"), F.col(f"r.{label}").eqNullSafe(F.col(f"p.{label}")))
        .select("r.*", F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias("copy"))
        .drop("rank")
    )


def shares(df: DataFrame, key: str, names: list[str], parts: list[float], seed: int = 0, name: str = "split") -> DataFrame:
    """Rows dealt to named parts by the hash alone, without a shuffle; sizes are near the shares."""
    u = arithmetic_hash(F.col(key), seed) / F.lit(float(MODULUS))
    out = F.lit(names[-1])
    edge = sum(parts[:-1])
    for n, p in reversed(list(zip(names[:-1], parts[:-1], strict=True))):
        out = F.when(u < edge, n).otherwise(out)
        edge -= p
    return df.withColumn(name, out)


def positional(df: DataFrame, order: str, cuts: list[tuple[str, float]], block: Column) -> DataFrame:
    """``split`` by the place in ``order``: names with the share of rows up to which each goes."""
    ranked = blocked_rank(df.withColumn("__all", F.lit(1)), ["__all"], [F.col(order)], block, "__r")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    out = F.lit(cuts[-1][0])
    for name, upto in reversed(cuts[:-1]):
        out = F.when(F.col("__r") <= F.floor(F.col("__n") * upto), name).otherwise(out)
    return ranked.crossJoin(F.broadcast(n)).withColumn("split", out).drop("__all", "__r", "__n")  # one row


def batches(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``batch``: rows in order of the hash, ``size`` at a time."""
    return hash_ranked(df.withColumn("__all", F.lit(1)), ["__all"], key, seed).withColumn(
        "batch", F.floor((F.col("rank") - 1) / size)
    ).drop("__all", "rank")


def copies(df: DataFrame, label: str, times: int) -> DataFrame:
    """Rows of label 1 repeated ``times`` times."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col(label) == 1, times).otherwise(1))))
