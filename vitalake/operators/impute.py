"""Missing values filled by chained equations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake.session import stored

ROUNDS = 4
RIDGE = 1e-3
#: Rows of a stay without a time are dealt to so many parts.
UNTIMED = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normals(keys: np.ndarray, salt: int) -> np.ndarray:
    """Standard normal numbers that depend on nothing but ``keys`` and ``salt``."""
    with np.errstate(over="ignore"):
        a = _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15))
        b = _mixed(a + np.uint64(0x9E3779B97F4A7C15))
    u, w = (((x >> np.uint64(11)).astype(float) + 0.5) / 2**53 for x in (a, b))
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * w)


@dataclass
class Chain:
    """The fitted equations: of each round a matrix (field, 1 + fields), and the spread of the residuals of each."""

    start: np.ndarray
    rounds: list[np.ndarray]
    spreads: list[np.ndarray]
    #: Of each category its fields and its discriminant.
    classes: list[tuple[list[int], np.ndarray]] = field(default_factory=list)

    def shares(self, x: np.ndarray, full: np.ndarray) -> np.ndarray:
        """``full`` with the probability of each value in place of the indicators of categories that ``x`` lacks."""
        out = full.copy()
        for own, weights in self.classes:
            gone = np.isnan(x[:, own[0]])
            score = weights[:, 0] + full[gone] @ weights[:, 1:].T
            p = np.exp(score - score.max(axis=1, keepdims=True))
            out[np.ix_(gone, own)] = p / p.sum(axis=1, keepdims=True)
        return out

    @property
    def spread(self) -> np.ndarray:
        """The spread of the last round."""
        return self.spreads[-1] if self.spreads else np.zeros(len(self.start))

    def fill(self, x: np.ndarray, keys: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """``x`` with each NaN replaced by the chain's prediction and a residual drawn from ``keys``; without keys, none."""
        gone = np.isnan(x)
        full = np.where(gone, self.start, x)
        k = x.shape[1]
        for r, (beta, spread) in enumerate(zip(self.rounds, self.spreads, strict=True)):
            for j in range(k):
                at = np.flatnonzero(gone[:, j])
                if len(at):
                    full[at, j] = beta[j, 0] + full[at] @ beta[j, 1:]
                    if keys is not None:
                        full[at, j] += spread[j] * normals(keys[at], (seed * 64 + r) * k + j)
        return full


def _solve(gram: np.ndarray, j: int, groups: list[object]) -> tuple[np.ndarray, float]:
    """Ridge regression of field ``j`` on those of other groups, from the moments of its observed rows."""
    k = gram.shape[0] - 1
    beta = np.zeros(k + 1)
    n = gram[0, 0]
    if n < 2:
        return beta, 0.0
    use = [0, *(i + 1 for i in range(k) if groups[i] != groups[j])]
    a, b = gram[np.ix_(use, use)].copy(), gram[use, j + 1]
    a[np.arange(1, len(use)), np.arange(1, len(use))] += RIDGE * n
    got = np.linalg.solve(a + 1e-9 * np.eye(len(use)), b)
    beta[use] = got
    left = gram[j + 1, j + 1] - got @ b
    return beta, float(np.sqrt(max(left, 0.0) / n))


def _discriminant(gram: np.ndarray, own: list[int], groups: list[object]) -> np.ndarray:
    """Linear discriminant of the indicators ``own`` of a category: of each value its constant and weights of all fields.

    From the moments of the rows in which the category is known: shares and means of each value's rows, and the scatter within.
    """
    k = gram.shape[0] - 1
    use = [i + 1 for i in range(k) if groups[i] != groups[own[0]]]
    n = max(gram[0, 0], 1.0)
    sizes = np.array([gram[0, j + 1] for j in own])
    means = np.array([gram[use, j + 1] / max(m, 1.0) for j, m in zip(own, sizes, strict=True)])
    within = (gram[np.ix_(use, use)] - (means.T * sizes) @ means) / n + RIDGE * np.eye(len(use))
    weights = np.linalg.solve(within, means.T).T
    out = np.zeros((len(own), k + 1))
    out[:, use] = weights
    out[:, 0] = np.log(np.maximum(sizes, 1e-9) / n) - 0.5 * np.sum(means * weights, axis=1)
    return out


def fit_chain(
    df: DataFrame, fields: list[str], rounds: int = ROUNDS, groups: list[object] | None = None, key: str | None = None, seed: int = 0
) -> Chain:
    """Fit the equations over all rows of ``df``, one pass over it a round.

    Each task adds up, for every field, the moments of the rows in which that field
    is observed, with the other fields as filled so far; their sums, ``len(fields)``
    squares of that many numbers, make the regressions of the round. Within a row,
    fields are then filled in order, each from those filled before it, with a residual of the equation's spread drawn
    from ``key``, a column of whole numbers, so the equations are fitted on values that vary as observed ones do. Fields of one of
    ``groups`` (the indicators of a category) don't predict each other.
    """
    k = len(fields)
    groups = groups or list(range(k))
    chain = Chain(np.zeros(k), [], [])
    of_key = F.lit(None).cast("bigint") if key is None else F.col(key).cast("bigint")
    table = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(fields)], of_key.alias("key"))
    size = k * (k + 1) * (k + 1)
    for _ in range(rounds):

        def moments(batches: Iterator[pa.RecordBatch], chain: Chain = chain) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k + 1, k + 1))
            seen = False
            for batch in batches:
                if not batch.num_rows:
                    continue
                seen = True
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:k]])
                keys = None if key is None else batch["key"].to_numpy(zero_copy_only=False)
                full = np.column_stack([np.ones(len(x)), chain.fill(x, keys, seed)])
                there = ~np.isnan(x)
                for j in range(k):
                    rows = full[there[:, j]]
                    total[j] += rows.T @ rows
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.ravel())], names=["i", "v"])

        sums = table.mapInArrow(moments, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        gram = np.zeros(size)
        for i, v in sums:
            gram[i] = v
        solved = [_solve(g, j, groups) for j, g in enumerate(gram.reshape(k, k + 1, k + 1))]
        chain = Chain(
            chain.start, [*chain.rounds, np.array([b for b, _ in solved])], [*chain.spreads, np.array([s for _, s in solved])]
        )
    grams = gram.reshape(k, k + 1, k + 1)
    for group in dict.fromkeys(groups):
        own = [i for i in range(k) if groups[i] == group]
        if len(own) > 1:
            chain.classes.append((own, _discriminant(grams[own[0]], own, groups)))
    return chain


def impute_chained(
    df: DataFrame,
    key: str,
    numeric: list[str],
    categorical: dict[str, list[str]] | None = None,
    rounds: int = ROUNDS,
    seed: int = 0,
) -> DataFrame:
    """``df`` with nulls in ``numeric`` and ``categorical`` fields filled.

    Chained equations: each field is regressed on all others, round by round; of a
    category (``categorical`` gives the values of each) the indicator of each value is
    a field. Every value filled, in each round and at the end, has a residual of the fitted spread, drawn from ``key`` and
    ``seed``, so repeated runs agree; a category is drawn in proportion to the probabilities that a linear discriminant, from the moments
    of the last round, gives its values. For every
    field ``<field>_filled`` tells whether its value was filled.

    NaN counts as null. A field that is null everywhere stays so and isn't marked. An
    empty table gives an empty table. Further columns are kept as they are.
    """
    categorical = categorical or {}
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    scale = df.agg(
        *[F.avg(number[c]).alias(f"m{i}") for i, c in enumerate(numeric)],
        *[F.stddev_pop(number[c]).alias(f"s{i}") for i, c in enumerate(numeric)],
        F.count(F.lit(1)).alias("n"),
    ).first()
    known = [c for i, c in enumerate(numeric) if scale[f"m{i}"] is not None]
    mean = {c: scale[f"m{i}"] for i, c in enumerate(numeric)}
    sd = {c: scale[f"s{i}"] or 1.0 for i, c in enumerate(numeric)}
    fields = [((number[c] - mean[c]) / sd[c]).alias(f"n_{c}") for c in known]
    names = [f"n_{c}" for c in known]
    groups: list[object] = [("n", c) for c in known]
    for c, values in categorical.items():
        for i, v in enumerate(values):
            fields.append(F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double")).alias(f"c{i}_{c}"))
            names.append(f"c{i}_{c}")
            groups.append(("c", c))
    if not names:
        return df.withColumns({f"{c}_filled": F.lit(False) for c in [*numeric, *categorical]})
    chain = fit_chain(df.select(*fields, F.xxhash64(key).alias("__key")), names, rounds, groups, "__key", seed)

    @F.pandas_udf("array<double>")
    def predicted(x, keys):  # noqa: ANN001, ANN202
        import pandas as pd

        m = np.vstack(x.to_numpy()).reshape(len(x), len(names))
        return pd.Series(list(chain.shares(m, chain.fill(m, keys.to_numpy(), seed))))

    values = F.array(*[F.coalesce(f, F.lit(float("nan"))) for f in fields])
    out = df.withColumn("__p", predicted(values, F.xxhash64(key)))
    new: dict[str, Column] = {}
    for c in numeric:
        gone = number[c].isNull() & F.lit(c in known)
        if c in known:
            new[c] = F.when(gone, F.get("__p", F.lit(names.index(f"n_{c}"))) * sd[c] + mean[c]).otherwise(number[c])
        new[f"{c}_filled"] = gone
    for c, values_ in categorical.items():
        if values_:
            share = [F.greatest(F.get("__p", F.lit(names.index(f"c{i}_{c}"))), F.lit(1e-9)) for i in range(len(values_))]
            total = sum(share[1:], share[0])
            # A value is taken where the drawn place lies within its share of the whole.
            place = (F.pmod(F.xxhash64(F.col(key), F.lit(c), F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003 * total
            drawn = F.lit(values_[-1])
            for i in range(len(values_) - 2, -1, -1):
                upto = sum(share[1 : i + 1], share[0])
                drawn = F.when(place <= upto, values_[i]).otherwise(drawn)
            new[c] = F.coalesce(F.col(c), drawn)
        new[f"{c}_filled"] = F.col(c).isNull() & F.lit(bool(values_))
    return out.withColumns(new).drop("__p")


def fill_readings(
    readings: DataFrame, items: DataFrame, slot_minutes: int = 60, block_slots: int = 24, rounds: int = ROUNDS, seed: int = 0
) -> DataFrame:
    """Each reading without a value, with one filled in from similar readings.

    ``readings``: row_id, stay_id, itemid, t (microseconds), value, missing (true where the
    value is to be filled). ``items``, a fixed table: itemid, physical_low, physical_high.
    Columns: row_id, stay_id, itemid, filled_value, basis, filled (whether there is a value).

    A record is one slot of a stay, its fields are the items of ``items``, as deviations
    from the item's mean in the stay's block of ``block_slots`` slots. Chained equations over
    these records predict the missing fields; the deviation predicted is added to that
    mean (``basis`` is ``time``), or else to the stay's mean of the item (``stay``) or the
    item's (``item``), with a residual of the fitted spread, drawn from row_id and
    ``seed``, within the bounds of the item.

    Rows with a null row_id are left out; a null stay is a stay of its own; a reading without
    a time has no record and is filled by stay or item; where an item has no value at all,
    or is not in ``items``, filled_value and basis are null and filled is false; an empty table gives an empty one; repeated
    rows are filled one by one. A stay is cut into blocks and its readings are added
    up by slot before they are shuffled; the means of a stay go to its blocks, and rows without a time are dealt to
    ``UNTIMED`` parts, so no stay is worked on as a whole.
    """
    bounds = {
        r["itemid"]: (
            -np.inf if r["physical_low"] is None else r["physical_low"],
            np.inf if r["physical_high"] is None else r["physical_high"],
        )
        for r in items.select("itemid", "physical_low", "physical_high").collect()  # fixed table
        if r["itemid"] is not None
    }
    ids = sorted(bounds)
    k = len(ids)
    if not k:
        raise ValueError("no items")
    slot = F.floor(F.col("t") / F.lit(slot_minutes * 60_000_000)).cast("int")
    base = (
        readings.select("row_id", "stay_id", "itemid", F.col("value").cast("double").alias("value"), "missing", slot.alias("slot"))
        .where(F.col("row_id").isNotNull())
        .withColumn("block", F.floor(F.col("slot") / block_slots).cast("int"))
    )
    there = ~F.col("missing") & F.col("value").isNotNull()
    added = base.groupBy("stay_id", "block", "slot").agg(
        *[F.sum(F.when(there & (F.col("itemid") == i), F.col("value"))).alias(f"s{n}") for n, i in enumerate(ids)],
        *[F.count(F.when(there & (F.col("itemid") == i), 1)).cast("int").alias(f"n{n}") for n, i in enumerate(ids)],
        F.max("missing").alias("asked"),
    )
    block = Window.partitionBy("stay_id", "block")
    level = [F.sum(f"s{n}").over(block) / F.nullif(F.sum(f"n{n}").over(block), F.lit(0)) for n in range(k)]
    wide = stored(added.repartition("stay_id", "block").select("*", *[c.alias(f"l{n}") for n, c in enumerate(level)]))
    fields = [F.try_divide(f"s{n}", f"n{n}") - F.col(f"l{n}") for n in range(k)]
    timed = F.col("slot").isNotNull()
    chain = fit_chain(
        wide.where(timed).select(*[f.alias(f"d{n}") for n, f in enumerate(fields)], F.xxhash64("stay_id", "slot").alias("key")),
        [f"d{n}" for n in range(k)], rounds, key="key", seed=seed,
    )
    # One row a block of a stay, with the sums of the stay.
    of_stay = Window.partitionBy("stay_id")
    by_block = wide.groupBy("stay_id", "block").agg(
        *[F.sum(f"s{n}").alias(f"s{n}") for n in range(k)], *[F.sum(f"n{n}").alias(f"n{n}") for n in range(k)]
    )
    whole = by_block.agg(*[F.try_divide(F.sum(f"s{n}"), F.sum(f"n{n}")).alias(f"m{n}") for n in range(k)]).first()
    item_mean = np.array([np.nan if whole[n] is None else whole[n] for n in range(k)])
    nan = F.lit(float("nan"))
    records = wide.where(F.col("asked") & timed).select(
        F.col("stay_id").alias("w_stay"),
        F.col("slot").alias("w_slot"),
        F.array(*[F.coalesce(f, nan) for f in fields]).alias("x"),
        F.array(*[F.coalesce(f"l{n}", nan) for n in range(k)]).alias("level"),
    )
    means = [F.try_divide(F.sum(f"s{n}").over(of_stay), F.sum(f"n{n}").over(of_stay)) for n in range(k)]
    parts = F.sequence(F.lit(0), F.when(F.col("block").isNull(), UNTIMED - 1).otherwise(0))
    stays = by_block.select(
        F.col("stay_id").alias("m_stay"), F.col("block").alias("m_block"), F.array(*[F.coalesce(m, nan) for m in means]).alias("mean")
    ).withColumnRenamed("m_block", "block").withColumn("m_part", F.explode(parts)).withColumnRenamed("block", "m_block")
    none = F.array_repeat(nan, k)
    part = F.when(F.col("block").isNull(), F.pmod(F.xxhash64("row_id"), F.lit(UNTIMED)).cast("int")).otherwise(0)
    asked = (
        base.where("missing")
        .select("row_id", "stay_id", "itemid", "slot", "block", part.alias("part"))
        .join(records, F.col("stay_id").eqNullSafe(F.col("w_stay")) & (F.col("slot") == F.col("w_slot")), "left")
        .join(
            stays,
            F.col("stay_id").eqNullSafe(F.col("m_stay")) & F.col("block").eqNullSafe(F.col("m_block")) & (F.col("part") == F.col("m_part")),
            "left",
        )
        .select(
            "row_id",
            "stay_id",
            "itemid",
            F.coalesce("x", none).alias("x"),
            F.coalesce("level", none).alias("level"),
            F.coalesce("mean", none).alias("mean"),
            F.xxhash64("row_id").alias("key"),
        )
    )
    order = np.array(ids)
    low, high = np.array([bounds[i] for i in ids], float).T
    bases = np.array(["time", "stay", "item"], dtype=object)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, level, mean = (
                batch[c].flatten().to_numpy(zero_copy_only=False).reshape(n, k).copy() for c in ("x", "level", "mean")
            )
            item = batch["itemid"].to_numpy(zero_copy_only=False)
            j = np.minimum(np.searchsorted(order, np.where(np.isnan(item.astype(float)), -1, item)), k - 1)
            known = order[j] == item
            at = np.arange(n)
            x[at, j] = np.nan  # a field isn't predicted from itself
            ways = np.stack([level[at, j], mean[at, j], item_mean[j]])
            which = np.argmax(~np.isnan(ways), axis=0)
            filled = chain.fill(x, batch["key"].to_numpy(zero_copy_only=False), seed)[at, j]
            value = np.clip(ways[which, at] + filled, low[j], high[j])
            value[~known] = np.nan
            empty = np.isnan(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row_id"],
                    batch["stay_id"],
                    batch["itemid"],
                    pa.array(value, pa.float64(), mask=empty),
                    pa.array(bases[which], pa.string(), mask=empty),
                    pa.array(~empty),
                ],
                names=["row_id", "stay_id", "itemid", "filled_value", "basis", "filled"],
            )

    return asked.mapInArrow(
        fill, "row_id bigint, stay_id bigint, itemid bigint, filled_value double, basis string, filled boolean"
    )
