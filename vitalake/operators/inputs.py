"""Model inputs: tokens with special ones, sequences, one-hot rows, blocks of features, positions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.operators.visits import dense_ids

#: Tokens at the begin of every vocabulary, in this order from 0; UNK is the last one.
SPECIALS = ("PAD", "CLS", "SEP")


def special_vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``token`` and ``index``: PAD, CLS and SEP, the distinct tokens in alphabetical order, and UNK."""
    spark = tokens.sparkSession
    once = tokens.select(F.col(token).alias("token")).where(F.col("token").isNotNull() & ~F.col("token").isin("UNK", *SPECIALS)).distinct()
    own = dense_ids(once, ["token"], "index").withColumn("index", F.col("index") + len(SPECIALS))
    first = spark.createDataFrame(list(zip(SPECIALS, range(len(SPECIALS)), strict=True)), "token string, index bigint")
    last = own.agg((F.coalesce(F.max("index"), F.lit(len(SPECIALS) - 1)) + 1).alias("index")).select(F.lit("UNK").alias("token"), "index")
    return first.unionByName(own).unionByName(last)


def with_ids(df: DataFrame, vocabulary: DataFrame, token: str = "token", name: str = "id") -> DataFrame:
    """``df`` with the index of each token; unknown ones get that of UNK."""
    unknown = F.broadcast(vocabulary.where("token = 'UNK'").select(F.col("index").alias("__unk")))  # one row
    known = vocabulary.select(F.col("token").alias("__t"), F.col("index").alias("__i"))
    return df.join(known, F.col(token) == F.col("__t"), "left").crossJoin(unknown).withColumn(name, F.coalesce("__i", "__unk")).drop("__t", "__i", "__unk")


def one_based(categories: DataFrame, column: str) -> DataFrame:
    """``column`` and ``index`` of its distinct values in order, from 1; 0 is for padding."""
    once = categories.select(column).where(F.col(column).isNotNull()).distinct()
    return dense_ids(once, [column], "index").withColumn("index", F.col("index") + 1)


def positions(tokens: Column) -> Column:
    """The number of SEP before each token."""
    return F.transform(tokens, lambda _, i: F.size(F.filter(F.slice(tokens, F.lit(1), i), lambda t: t == "SEP")))


def segments(tokens: Column) -> Column:
    """0 and 1 by turns, changed after each SEP."""
    return F.transform(positions(tokens), lambda p: p % 2)


def padded(items: Column, to: int, pad: Column) -> Column:
    """An array filled up to ``to`` entries; a longer one is kept."""
    return F.concat(items, F.array_repeat(pad, F.greatest(F.lit(0), F.lit(to) - F.size(items))))


def sequence_item(df: DataFrame, tokens: str, to: int, repeated: Sequence[str] = ()) -> DataFrame:
    """``df`` with the token sequence padded, its positions, segments and mask (1 for tokens), and each of ``repeated`` once a token."""
    t = F.col(tokens)
    whole = padded(t, to, F.lit("PAD"))
    added = {f"{c}_sequence": padded(F.array_repeat(F.col(c).cast("string"), F.size(t)), to, F.lit("PAD")) for c in repeated}
    return df.withColumns(
        {"mask": padded(F.transform(t, lambda _: F.lit(1)), to, F.lit(0)), "positions": positions(whole), "segments": segments(whole), **added}
    ).withColumn(tokens, whole)


def event_sequences(conditions: DataFrame, events: DataFrame, key: str, code: str, hour: str, token: str, most: int = 512) -> DataFrame:
    """``key`` and ``tokens``: CLS, the distinct condition codes, SEP, then the distinct tokens of each hour, each hour with SEP.

    Keys are those with events. Sequences of ``most`` tokens or more are left out, before anything is collected.
    """
    codes = conditions.where(F.col(code).isNotNull()).select(key, F.col(code).alias("c")).distinct()
    hourly = events.where(F.col(token).isNotNull() & F.col(hour).isNotNull()).select(key, F.col(hour).alias("h"), F.col(token).alias("t")).distinct()
    n_codes = codes.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    n_events = hourly.groupBy(key).agg(F.count(F.lit(1)).alias("b"), F.count_distinct("h").alias("c"))
    short = n_events.join(n_codes, key, "left").where(F.coalesce("a", F.lit(0)) + F.col("b") + F.col("c") + 2 < most).select(key)
    by_hour = hourly.join(short, key, "left_semi").groupBy(key, "h").agg(F.concat(F.array_sort(F.collect_list("t")), F.array(F.lit("SEP"))).alias("t"))
    dynamic = by_hour.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("h", "t"))), lambda x: x["t"])).alias("dynamic"))
    static = codes.join(short, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("static"))
    begin = F.concat(F.array(F.lit("CLS")), F.coalesce("static", F.array().cast("array<string>")), F.array(F.lit("SEP")))
    return dynamic.join(static, key, "left").select(key, F.concat(begin, "dynamic").alias("tokens"))


def multi_hot(df: DataFrame, key: str, items: str, values: Sequence[str]) -> DataFrame:
    """A row a key with a column for each of ``values``: 1 if any of the key's arrays holds it, else 0."""
    return df.groupBy(key).agg(*[F.max(F.coalesce(F.array_contains(items, v), F.lit(False)).cast("int")).alias(v) for v in values])


def static_one_hot(keys: DataFrame, events: DataFrame, key: str, code: str, values: Sequence[str]) -> DataFrame:
    """A row for each of ``keys`` with 0 or 1 for each of ``values``; ``codes`` holds those it has, or ``<PAD>`` if none."""
    has = events.where(F.col(code).isin(list(values))).groupBy(key).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    none = F.array(F.lit("<PAD>"))
    joined = keys.select(key).distinct().join(has, key, "left")
    return joined.select(
        key, *[F.coalesce(F.array_contains("codes", v), F.lit(False)).cast("int").alias(f"c_{v}") for v in values], F.coalesce("codes", none).alias("codes")
    )


def code_matrix(grid: DataFrame, key: str, feature: str, t: str, signal: str, value: str, features: Sequence) -> DataFrame:
    """A row a key and time with the arrays ``ids`` (signal times the feature's number, from 1) and ``values``, over ``features`` in order."""
    cells = [F.max(F.when(F.col(feature) == f, F.col(signal))) for f in features]
    numbers = [F.max(F.when(F.col(feature) == f, F.col(value))) for f in features]
    return grid.groupBy(key, t).agg(
        F.array(*[F.coalesce(c, F.lit(0)) * F.lit(i + 1) for i, c in enumerate(cells)]).alias("ids"),
        F.array(*[F.coalesce(c, F.lit(0.0)) for c in numbers]).alias("values"),
    )


def fitted_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``value`` and ``code`` of the categories seen in ``train``, in alphabetical order from 0."""
    from vitalake.operators.mlfeed import label_codes

    return label_codes(train, list(columns))


def coded(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_code``; null and values unknown to ``codes`` get -1."""
    for c in columns:
        known = codes.where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias(f"{c}_code"))
        df = df.join(known, F.col(c).cast("string") == F.col("__v"), "left").drop("__v").na.fill(-1, [f"{c}_code"])
    return df


def decoded(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>`` told by ``<column>_code``; unknown codes give null."""
    for c in columns:
        known = codes.where(F.col("column") == c).select(F.col("code").alias("__c"), F.col("value").alias(c))
        df = df.join(known, F.col(f"{c}_code") == F.col("__c"), "left").drop("__c")
    return df


#: Which blocks of features each regime takes; fixed names.
REGIMES = {"structured_only": ("structured",), "llm_only": ("llm",), "fused": ("structured", "llm")}


def regime(df: DataFrame, name: str, structured: str, llm: str) -> DataFrame:
    """``df`` with ``features``, the arrays of the regime's blocks in a row; a ValueError for an unknown one."""
    if name not in REGIMES:
        raise ValueError(f"unknown regime {name}")
    blocks = {"structured": F.col(structured).cast("array<double>"), "llm": F.col(llm).cast("array<double>")}
    return df.withColumn("features", F.concat(*[blocks[b] for b in REGIMES[name]]))


def build_features(kind: str, makers: dict[str, Callable[..., DataFrame]], *args: object, **how: object) -> DataFrame:
    """Features by the maker of that name; a ValueError for an unknown one."""
    if kind not in makers:
        raise ValueError(f"unknown features {kind}; known are {', '.join(sorted(makers))}")
    return makers[kind](*args, **how)


def svd_rank(wanted: int, rows: int, features: int) -> int:
    """How many singular values can be asked for."""
    return max(2, min(wanted, rows - 1, features))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """``df`` with the weight that makes its label's rows count as much as another's: rows / (labels * rows of the label)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    whole = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    weights = n.crossJoin(F.broadcast(whole)).select(F.col(label).alias("__l"), (F.col("__all") / (F.col("__k") * F.col("__n"))).alias(name))  # one row
    return df.join(weights, df[label].eqNullSafe(F.col("__l"))).drop("__l")


def sinusoids(spark, length: int, width: int) -> DataFrame:  # noqa: ANN001
    """``position``, ``i`` and ``value``: the sine of position / 10000^(2 (i // 2) / width) for even i, the cosine for odd."""
    grid = spark.range(length).select(F.col("id").alias("position"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
    angle = F.col("position") * F.exp(F.floor(F.col("i") / 2) * F.lit(-2 * math.log(10_000.0) / width))
    return grid.withColumn("value", F.when(F.col("i") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)))


def resampled(signal: Column, n: int) -> Column:
    """A signal at ``n`` points from its first to its last entry, interpolated linearly; an empty one stays so."""

    def at(s: Column, i: Column) -> Column:
        place = i * (F.size(s) - 1) / F.lit(max(n - 1, 1))
        low = F.floor(place).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (place - low) * (b - a)

    return F.when(F.size(signal) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(signal, i))).otherwise(signal)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is evaluated once for all its uses."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def masked_mean(vectors: Column, mask: Column, width: int) -> Column:
    """The mean of the vectors whose mask is 1, entry by entry; zeros where none is."""
    zero = F.array_repeat(F.lit(0.0), width)

    def mean(kept: Column) -> Column:
        total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b))
        return _let(F.greatest(F.size(kept), F.lit(1)), lambda n: F.transform(total, lambda x: x / n))

    return _let(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), mean)


def unit_length(vector: Column) -> Column:
    """A vector at length one; zeros stay so."""

    def scaled(v: Column) -> Column:
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return _let(length, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return _let(vector, scaled)
