"""Faulty measurements, judged against the normal behaviour of their source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.operators.ranks import blocked_dense_rank, join_small
from vitalake.session import stored

STUCK_RUN = 6
SPIKE_RUN = 3
THRESHOLD = 6.0
#: Innovations up to this share of the usual one count as none.
VANISHING = 1e-3
#: A source is cut into blocks of this many readings; so many readings on either side
#: are given along, more than ``STUCK_RUN`` and enough for the filter to settle.
BLOCK_READINGS = 1024
HALO_READINGS = 64
#: Readings are ranked in blocks of so many grid periods of their item.
BLOCK_PERIODS = 240

#: Steps are counted by size in so many bins an octave, 0.3 percent each.
BINS, ZERO = 256, -(1 << 40)

NONE, IMPOSSIBLE, STUCK, SPIKE = 0, 1, 2, 3
KINDS = np.array([None, "impossible", "stuck", "spike"], dtype=object)


def _quantile(ordered: list[float], q: float) -> float:
    at = q * (len(ordered) - 1)
    i = int(at)
    return ordered[i] if i + 1 == len(ordered) else ordered[i] + (at - i) * (ordered[i + 1] - ordered[i])


def _bins(x: np.ndarray) -> np.ndarray:
    """Steps by size, ``BINS`` to an octave; those without length are ``ZERO``."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.floor(np.log2(np.where(x > 0, x, 1.0)) * BINS), ZERO).astype(np.int64)


def _sizes(bins: np.ndarray) -> np.ndarray:
    return np.where(bins == ZERO, 0.0, 2.0 ** ((bins + 0.5) / BINS))


def _scatter(sizes: list[float], held: list[bool]) -> float:
    """Usual scatter of a reading: from the sizes of steps between readings that aren't stuck."""
    free = sorted(s for s, h in zip(sizes, held, strict=True) if not h)
    if len(free) < 3:
        free = sorted(sizes)
    if not free:
        return 0.0
    least = 0.3 * min((s for s in sizes if s > 0), default=0.0)
    # Both quantiles as standard deviations of a reading; few steps tend to look calmer than the source is.
    return max(_quantile(free, 0.5) / 0.954, 0.85 * _quantile(free, 0.7) / 1.466, least) * (1 + 2 / len(free))


def _pause(sizes: list[float]) -> float:
    """The usual time between two readings."""
    gaps = sorted(s for s in sizes if s > 0)
    return _quantile(gaps, 0.5) if gaps else 1.0


def _filter(t: list[int], x: list[float], sigma: float, usual: float, threshold: float) -> list[int]:
    """Places of spikes in ``x`` by a local-level Kalman filter.

    A reading whose standardised innovation is above ``threshold`` is withheld. If
    the level is met again within three withheld readings, they are spikes; if
    more are withheld, the level has moved and the filter starts anew from them.
    """
    r = sigma * sigma
    drift = 0.09 * r / usual
    most = 0.4 * r  # a long pause doesn't excuse a leap; a level that moved in it is found by what follows
    limit = threshold * threshold
    level, p, last = _quantile(sorted(x[:5]), 0.5), most, t[0]
    found: list[int] = []
    pending: list[int] = []
    for i, v in enumerate(x):
        prior = min(p + drift * (t[i] - last), most)
        s = prior + r
        e = v - level
        if e * e <= limit * s:
            gain = prior / s
            level += gain * e
            p = (1 - gain) * prior
            last = t[i]
            if pending:
                found += pending
                pending = []
        else:
            pending.append(i)
            if len(pending) > SPIKE_RUN:
                level, p, last = _quantile(sorted(x[j] for j in pending), 0.5), most, t[i]
                pending = []
    return found


def _tolerance(innovation: np.ndarray, change: np.ndarray, vanishing: float) -> np.ndarray | float:
    """``vanishing`` times the usual innovation of the source, for each innovation; of a source without any, 0."""
    if not vanishing:
        return 0.0
    at = np.r_[np.flatnonzero(change), len(change)]
    out = np.zeros(len(innovation))
    for a, b in zip(at, at[1:], strict=False):
        moved = innovation[a : b - 1]
        moved = moved[moved > 0]
        if len(moved):
            # Half of the larger ones tell the source's scatter, also where most readings are stuck.
            out[a : b - 1] = vanishing * np.median(moved[moved >= 0.01 * moved.max()])
    return out


def _states(change: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, vanishing: float) -> tuple[np.ndarray, np.ndarray]:
    """Which readings are outside the bounds, and which are in a run long enough to be stuck."""
    # Innovations against the last reading: in a run none of them is above the tolerance, so their variance vanishes.
    innovation = np.abs(np.diff(v))
    starts = np.flatnonzero(change | np.r_[True, innovation > _tolerance(innovation, change, vanishing)])
    run = np.diff(np.r_[starts, len(v)])
    return (v < low) | (v > high), np.repeat(run >= STUCK_RUN, run)


def measure_block(t: np.ndarray, v: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, vanishing: float) -> list[tuple[int, int, int]]:
    """(what, bin, number) of the steps and pauses that end in an own reading of a block: 0 and 1 steps free and held, 2 pauses.

    Added up over the blocks of a source, they are those of the source, however it is cut.
    """
    new = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])]
    t, v, own, low, high = (a[new] for a in (t, v, own, low, high))
    wrong, held = _states(np.r_[True, np.zeros(len(v) - 1, bool)], v, low, high, vanishing)
    t, v, own, held = (a[~wrong] for a in (t, v, own, held))
    mine = own[1:]
    pause = np.diff(t)[mine]
    kept = [
        (0, np.abs(np.diff(v))[mine & ~(held[1:] & held[:-1])]), (1, np.abs(np.diff(v))[mine & held[1:] & held[:-1]]), (2, pause[pause > 0].astype(float)),
    ]
    return [(what, int(b), int(n)) for what, x in kept for b, n in zip(*np.unique(_bins(x), return_counts=True), strict=True)]


def flag_sources(
    source: np.ndarray,
    t: np.ndarray,
    v: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    setting: np.ndarray,
    threshold: float = THRESHOLD,
    vanishing: float = VANISHING,
    known: np.ndarray | None = None,
) -> np.ndarray:
    """Kinds of readings, sorted by source, time and value.

    Readings equal in source, time and value count once and get the same kind. ``known`` has the scatter and the usual pause of
    each reading's source; without it, they are those of the readings given.
    """
    if not len(t):
        return np.zeros(0, np.int8)
    change = np.r_[True, source[1:] != source[:-1]]
    new = change | np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])]
    of = np.cumsum(new) - 1
    change, t, v, low, high, setting, source = (a[new] for a in (change, t, v, low, high, setting, source))
    kind = np.zeros(len(t), np.int8)
    wrong, held = _states(change, v, low, high, vanishing)
    kind[held & ~setting] = STUCK
    kind[wrong] = IMPOSSIBLE
    fit = np.flatnonzero(~wrong & ~setting)
    if len(fit):
        src = source[fit]
        at = np.flatnonzero(np.r_[True, src[1:] != src[:-1], True]).tolist()
        ts, xs, hs = t[fit], v[fit], held[fit]
        times, values = ts.tolist(), xs.tolist()
        if known is None:
            steps, pauses = (_sizes(_bins(np.abs(np.diff(x)).astype(float))).tolist() for x in (xs, ts))
            both = (hs[1:] & hs[:-1]).tolist()
        else:
            whole = known[new][fit]
        spikes: list[int] = []
        for a, b in zip(at, at[1:], strict=False):
            if b - a > 3:
                sigma, usual = (_scatter(steps[a : b - 1], both[a : b - 1]), _pause(pauses[a : b - 1])) if known is None else whole[a]
                if sigma > 0:
                    spikes += [a + i for i in _filter(times[a:b], values[a:b], sigma, usual, threshold)]
        hit = fit[spikes]
        kind[hit[kind[hit] == NONE]] = SPIKE
    return kind[of]


def faulty_readings(
    readings: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    vanishing: float = VANISHING,
) -> DataFrame:
    """Faulty readings of ``readings`` as ``row_id`` and ``kind``.

    ``readings``: row_id, stay_id, itemid, t (microseconds), value; a source is one
    item of one stay. ``items``, a fixed table: itemid, physical_low, physical_high,
    category, grid_minutes. Kinds: ``impossible`` (outside the bounds), ``stuck`` (six or
    more readings in a row whose innovations vanish, that is are ``vanishing`` times the source's usual one at most, with 0 for the
    very same value; but for settings) and ``spike``
    (one to three readings in a row off the level before and after by more than
    ``threshold`` times the usual scatter; not for settings).

    Sources are cut into blocks by the order of readings, whatever the time between them; blocks
    get the readings around them along, so no run is missed and no source is worked on as a
    whole. The scatter is that of the whole source, from counts of its steps by size: sources of one block are judged at once, the
    blocks of others are written to the shared folder and judged once their counts are added up. Rows with a null row_id, stay_id, itemid, t or
    value are no cases; rows of items without bounds can't be impossible; repeated
    rows (same source, time and value) count once in a run and get the same kind; an
    empty table gives an empty table; further columns aren't looked at.
    """
    known = {
        r["itemid"]: (
            -np.inf if r["physical_low"] is None else r["physical_low"],
            np.inf if r["physical_high"] is None else r["physical_high"],
            r["category"] == "setting",
        )
        for r in items.collect()  # fixed table
    }
    period = F.coalesce(F.col("grid_minutes"), F.lit(60)).cast("bigint") * F.lit(60_000_000)
    keyed = (
        readings.select("row_id", "stay_id", "itemid", "t", F.col("value").cast("double").alias("value"))
        .na.drop()
        .join(F.broadcast(items.select("itemid", "grid_minutes").dropDuplicates(["itemid"])), "itemid", "left")
        .withColumn("part", F.floor(F.col("t") / (period * BLOCK_PERIODS)).cast("int"))
    )
    ranked = blocked_dense_rank(keyed, ["stay_id", "itemid"], [F.col("t"), F.col("value")], "part")
    inside = F.pmod(F.col("rank") - 1, F.lit(BLOCK_READINGS))
    block = F.floor((F.col("rank") - 1) / BLOCK_READINGS).cast("int")
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))

    def halo(step: int) -> Column:
        return F.array(own, F.struct((block + step).alias("block"), F.lit(False).alias("own")))

    blocks = (
        F.when((inside < HALO_READINGS) & (block > 0), halo(-1))
        .when(inside >= BLOCK_READINGS - HALO_READINGS, halo(1))
        .otherwise(F.array(own))
    )
    cut = ranked.select("row_id", "stay_id", "itemid", "t", "value", F.explode(blocks).alias("b")).select(
        "row_id", "stay_id", "itemid", "t", "value", "b.block", "b.own"
    )
    keys = ["stay_id", "itemid", "block"]

    def bounds_of(item: np.ndarray) -> np.ndarray:
        ids_of, at = np.unique(item, return_inverse=True)
        return np.array([known.get(int(i), (-np.inf, np.inf, False)) for i in ids_of], float).reshape(-1, 3)[at]

    def columns(table: pa.Table) -> tuple:
        got = tuple(table[c].to_numpy() for c in ("stay_id", "itemid", "block", "t", "value", "own", "row_id"))
        stay, item, block = got[:3]
        return got, np.cumsum(np.r_[True, (stay[1:] != stay[:-1]) | (item[1:] != item[:-1]) | (block[1:] != block[:-1])])

    def first(table: pa.Table) -> pa.RecordBatch:
        """Flags of sources of one block; of others the readings, and the counts of steps and pauses."""
        (stay, item, block, t, v, own, ids), source = columns(table)
        bounds = bounds_of(item)
        cut_up = np.bincount(source, (block > 0) | ~own)[source] > 0
        one = np.flatnonzero(~cut_up)
        kind = np.zeros(len(t), np.int8)
        kind[one] = flag_sources(source[one], t[one], v[one], bounds[one, 0], bounds[one, 1], bounds[one, 2] > 0, threshold, vanishing)
        rows = np.flatnonzero(cut_up | (kind != NONE))
        counts, of = [], []
        edges = np.flatnonzero(np.r_[True, source[1:] != source[:-1], True])
        for a, b in zip(edges, edges[1:], strict=False):
            if cut_up[a] and not bounds[a, 2]:
                got = measure_block(t[a:b], v[a:b], own[a:b], bounds[a:b, 0], bounds[a:b, 1], vanishing)
                counts += got
                of += [a] * len(got)
        at = np.r_[rows, np.array(of, np.int64)]
        counted = np.r_[np.zeros(len(rows), bool), np.ones(len(of), bool)]
        none = np.zeros((len(rows), 3), np.int64)
        what, bins, n = np.vstack([none, np.array(counts, np.int64).reshape(-1, 3)]).T
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[at], pa.int64()), pa.array(KINDS[kind[at]], pa.string()), pa.array(stay[at]), pa.array(item[at]), pa.array(block[at]), pa.array(t[at]),
                pa.array(v[at]), pa.array(own[at]), pa.array(what, mask=~counted), pa.array(bins, mask=~counted), pa.array(n, mask=~counted),
            ],
            names=["row_id", "kind", "stay_id", "itemid", "block", "t", "value", "own", "what", "bin", "n"],
        )

    def second(table: pa.Table) -> pa.RecordBatch:
        """Flags of the own readings of blocks, with the scatter and the pause of the whole source."""
        (_, item, _, t, v, own, ids), source = columns(table)
        bounds = bounds_of(item)
        whole = np.column_stack([table[c].to_numpy() for c in ("sigma", "usual")])
        kind = flag_sources(source, t, v, bounds[:, 0], bounds[:, 1], bounds[:, 2] > 0, threshold, vanishing, np.nan_to_num(whole))
        hit = np.flatnonzero((kind != NONE) & own)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(KINDS[kind[hit]], pa.string())], names=["row_id", "kind"])

    def by_source(f):  # noqa: ANN001, ANN202
        """``f`` over whole blocks of sources, whatever the batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                # All up to the last change of source is complete.
                n = batch.num_rows
                same = np.ones(n, bool)
                for c in keys:
                    x = batch[c].to_numpy(zero_copy_only=False)
                    same &= x == x[-1]
                start = n - int(np.argmin(same[::-1])) if not same.all() else 0
                if start == 0 and rest and all(rest[-1][c][-1].as_py() == batch[c][0].as_py() for c in keys):
                    rest.append(batch)
                    continue
                rest.append(batch.slice(0, start))
                if sum(b.num_rows for b in rest):
                    yield f(pa.Table.from_batches(rest).combine_chunks())
                rest = [batch.slice(start)]
            if rest:
                yield f(pa.Table.from_batches(rest).combine_chunks())

        return run

    seen = stored(
        cut.repartition(*keys).sortWithinPartitions(*keys, "t", "value").mapInArrow(
            by_source(first),
            "row_id bigint, kind string, stay_id bigint, itemid bigint, block int, t bigint, value double, own boolean, what bigint, bin bigint, n bigint",
        )
    )
    size = F.when(F.col("bin") == ZERO, 0.0).otherwise(F.pow(F.lit(2.0), (F.col("bin") + 0.5) / BINS))
    counts = seen.where("what is not null").groupBy("stay_id", "itemid", "what", "bin").agg(F.sum("n").alias("n")).withColumn("size", size)
    shares = lambda which, q: F.expr(f"percentile(case when {which} then size end, array({q}), n)")
    total = lambda which: F.coalesce(F.sum(F.when(F.expr(which), F.col("n"))), F.lit(0))
    per = counts.groupBy("stay_id", "itemid").agg(
        shares("what = 0", "0.5D, 0.7D").alias("free"), total("what = 0").alias("n_free"), shares("what < 2", "0.5D, 0.7D").alias("all"), total("what < 2").alias("n_all"),
        F.min(F.when((F.col("what") < 2) & (F.col("size") > 0), F.col("size"))).alias("least"), shares("what = 2", "0.5D")[0].alias("usual"),
    )
    few = F.col("n_free") < 3
    q, n = F.when(few, F.col("all")).otherwise(F.col("free")), F.when(few, F.col("n_all")).otherwise(F.col("n_free"))
    sigma = F.greatest(q[0] / 0.954, q[1] * 0.85 / 1.466, F.coalesce(F.col("least") * 0.3, F.lit(0.0))) * (1 + 2 / n)
    sources = per.select("stay_id", "itemid", F.coalesce(sigma, F.lit(0.0)).alias("sigma"), F.coalesce("usual", F.lit(1.0)).alias("usual"))
    pieces = seen.where("what is null and kind is null").drop("kind", "what", "bin", "n")
    # A source of settings only has no counts.
    judged = join_small(pieces, sources, ["stay_id", "itemid"], "left").na.fill({"sigma": 0.0, "usual": 1.0})
    rest = judged.repartition(*keys).sortWithinPartitions(*keys, "t", "value").mapInArrow(by_source(second), "row_id bigint, kind string")
    return seen.where("kind is not null").select("row_id", "kind").unionByName(rest)
