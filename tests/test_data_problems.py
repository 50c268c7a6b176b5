"""Operators on recorded measurements against brute force and made-up cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalake.functions.durations import duration_micros
from vitalake.operators import spikes
from vitalake.operators.grid import regular_series
from vitalake.operators.impute import fill_readings, impute_chained
from vitalake.operators.intervals import periods_and_gaps
from vitalake.operators.missing import stand_ins
from vitalake.operators.ranks import blocked_previous, blocked_rank
from vitalake.operators.spikes import faulty_readings
from vitalake.operators.units import Affine, UnitGraph, conversions, harmonise
from vitalake.plans import data_problems
from vitalake.plans.data_problems import p2_counter

HOUR = 3_600_000_000


def test_durations(spark):
    cases = {
        "0 days 00:01:00": 60, "-1 days +16:29:21": -27039, "99:57:09": 359829, "P0DT10H10M28S": 36628, "PT5M": 300, "P1D": 86400,
        "0 days 00:00:24.5": 24.5, "-00:30:00": -1800, "-PT1H": -3600, "": None, "x": None, "P": None, "1:2": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", duration_micros(F.col("s")).alias("t"))
    assert {r.s: None if r.t is None else r.t / 1e6 for r in df.collect()} == cases


def test_blocked_rank_and_previous(spark):
    rng = random.Random(0)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 500), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, id bigint")
    got = blocked_rank(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 50), "r").collect()
    assert len(got) == 800
    for k in (1, 2, None):
        own = sorted((r.t, r.id, r.r) for r in got if r.k == k)
        assert [x[2] for x in own] == list(range(1, len(own) + 1))
    back = blocked_previous(df.where("k is not null"), ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 50), F.col("id"), "p").collect()
    for k in (1, 2):
        own = sorted((r.t, r.id, r.p) for r in back if r.k == k)
        assert [x[2] for x in own] == [None, *(x[1] for x in own[:-1])]


def brute_periods(spans):
    out = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [("period", a, b) for a, b in out] + [("gap", a[1], b[0]) for a, b in zip(out, out[1:], strict=False)]


def test_periods_and_gaps(spark):
    rng = random.Random(1)
    import datetime as dt

    origin = dt.datetime(2130, 1, 1)
    rows, by = [], defaultdict(list)
    for _ in range(900):
        k = rng.choice([1, 1, 1, 2, 3])
        a = rng.randint(0, 20_000)
        b = a + rng.choice([0, -5, 1, 10, 40, 4000 if rng.random() < 0.02 else 3])
        rows.append((k, origin + dt.timedelta(minutes=a), origin + dt.timedelta(minutes=b), "x"))
        if b > a:
            by[k].append((origin + dt.timedelta(minutes=a), origin + dt.timedelta(minutes=b)))
    rows += [rows[0], (None, origin, origin + dt.timedelta(1), "x"), (5, None, origin, "x"), (5, origin, None, "x")]
    df = spark.createDataFrame(rows, "stay bigint, s timestamp_ntz, e timestamp_ntz, kind string")
    got = sorted((r.stay, r.kind, r.span_start, r.span_end) for r in periods_and_gaps(df, "stay", "s", "e").collect())
    want = sorted((k, *x) for k, spans in by.items() for x in brute_periods(spans))
    assert got == want
    assert periods_and_gaps(df.limit(0), "stay", "s", "e").count() == 0


def test_gauge_series(spark):
    rng = random.Random(2)
    rows = [(1, rng.choice([0, 1]), rng.randint(0, 9000) * HOUR // 3, float(rng.randint(0, 9)), HOUR) for _ in range(150)]
    rows += [rows[0], (1, 0, -5, 1.0, HOUR), (None, 0, 5, 1.0, HOUR), (1, None, 5, 1.0, HOUR), (1, 0, None, 1.0, HOUR), (1, 0, 5, None, HOUR)]
    df = spark.createDataFrame(rows, "stay bigint, item bigint, t bigint, value double, period bigint").withColumn("slot", F.lit("x"))
    want = defaultdict(dict)
    for s, i, t, v, p in rows:
        if None not in (s, i, t, v) and t >= 0:
            want[s, i].setdefault(t // p, []).append((t, v))
    got = {(r.stay, r.item, r.slot): (r.n, r.status) for r in regular_series(df, ["stay", "item"]).collect()}
    full = {}
    for (s, i), slots in want.items():
        for x in range(min(slots), max(slots) + 1):
            n = len(slots.get(x, []))
            full[s, i, x] = (n, "observed" if n else "uncovered")
    assert got == full
    gaps = {(r.stay, r.item, r.slot) for r in regular_series(df, ["stay", "item"], only_uncovered=True).collect()}
    assert gaps == {k for k, v in full.items() if not v[0]}
    assert regular_series(df.limit(0), ["stay", "item"]).count() == 0


def test_counter_series(spark):
    # 10 over two hours from 00:30, a reset to 3, then 4 more within one slot.
    rows = [(1, HOUR // 2, 100.0), (1, HOUR * 5 // 2, 110.0), (1, HOUR * 7 // 2, 3.0), (1, HOUR * 15 // 4, 7.0)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, value double").withColumn("period", F.lit(HOUR))
    got = {r.slot: (r.n, r.status, round(r.increment, 6), r.value) for r in regular_series(df, ["k"], counter=True).collect()}
    assert got == {
        0: (1, "observed", 2.5, 100.0),
        1: (0, "uncovered", 5.0, 100.0),
        2: (1, "observed", 2.5 + 1.5, 110.0),
        3: (2, "observed", 1.5 + 4.0, 7.0),
    }
    assert math.isclose(sum(v[2] for v in got.values()), 17.0)


def test_counter_of_spans(spark, tmp_path):
    # One order whose spans touch, overlap and nest; a pause; spans of two orders at once; a span across blocks.
    spans = [
        (1, 7, 1, 0, 60, 4.0), (1, 7, 1, 60, 150, 3.0), (1, 7, 1, 90, 120, 0.7), (1, 7, 2, 100, 400, 9.1),
        (1, 7, 3, 2000, 2010, 5.0), (1, 7, 4, 59_000, 64_000, 2.3), (1, 8, 1, 30, 90, 6.0), (2, 7, 1, 10, 20, 1.0), (2, 7, 1, 20, 30, 1.0),
    ]
    dirty = [spans[0], (1, 7, 1, 90, 90, 5.0), (1, 7, 1, 90, 80, 5.0), (1, 7, 1, None, 80, 5.0), (1, 7, 1, 0, 80, None)]
    df = spark.createDataFrame(spans + dirty, "stay_id bigint, itemid bigint, orderid bigint, a bigint, b bigint, amount double")
    at = lambda c, n: F.timestamp_micros(F.col(c) * 60_000_000).alias(n)
    df.select("stay_id", "itemid", "orderid", at("a", "starttime"), at("b", "endtime"), "amount").write.parquet(f"{tmp_path}/preproc_med_icu.parquet")
    want = defaultdict(float)
    for stay, item, _, a, b, amount in spans:
        first = min(x[3] for x in spans if x[0] == stay)
        for m in range(a - first, b - first):
            want[stay, item, m // 60] += amount / (b - a)
    got = p2_counter(spark, str(tmp_path)).collect()
    increments = defaultdict(float)
    for r in got:
        increments[r.stay_id, r.itemid, r.slot] += r.increment
    assert all(math.isclose(increments[k], want[k], abs_tol=1e-6) for k in {*increments, *want})
    for key in {(s[0], s[1]) for s in spans}:
        rows = sorted((r.slot, r.value) for r in got if (r.stay_id, r.itemid) == key)
        assert [s for s, _ in rows] == list(range(rows[0][0], rows[-1][0] + 1))
        assert [v for _, v in rows] == sorted(v for _, v in rows)
        assert math.isclose(rows[-1][1], sum(s[5] for s in spans if s[:2] == key), abs_tol=1e-6)


def test_stand_ins(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 100))) for i in range(10) for _ in range(50)]
    rows += [(i, -999.0) for i in range(10)] * 3 + [(i, 1e6) for i in range(8)] * 3 + [(3, -50.0)] * 9 + [(i, 0.0) for i in range(10)] * 9
    df = spark.createDataFrame([*rows, (1, None), (1, float("nan"))], "i bigint, v double")
    assert stand_ins(df, "i", "v", -10.0, 200.0) == [-999.0, 1e6]
    assert stand_ins(df.limit(0), "i", "v", -10.0, 200.0) == []


def made_source(n=200, seed=0):
    rng = np.random.default_rng(seed)
    v = np.round(80 + np.cumsum(rng.normal(0, 0.3, n)) + rng.normal(0, 1, n), 1)
    return np.arange(n) * HOUR // 2, v


def flagged(t, v, setting=False):
    n = len(t)
    return spikes.KINDS[spikes.flag_sources(np.zeros(n), np.asarray(t), np.asarray(v, float), np.full(n, 10.0), np.full(n, 200.0), np.full(n, setting))]


def test_spikes_in_a_source():
    t, v = made_source()
    assert not [k for k in flagged(t, v) if k]
    v[50:53] = [150, 152, 149]
    v[90] = 40
    v[120] = -5
    v[150:157] = v[150]
    want = {50: "spike", 51: "spike", 52: "spike", 90: "spike", 120: "impossible"} | dict.fromkeys(range(150, 157), "stuck")
    assert {i: k for i, k in enumerate(flagged(t, v)) if k} == want
    level = v.copy()
    level[100:] += 60
    assert "spike" not in flagged(t, level)[95:110]
    assert set(flagged(t, v, setting=True)) == {None, "impossible"}


def test_repeated_readings_count_once():
    t, v = made_source(60)
    v[20:25] = v[20]
    t2, v2 = np.insert(t, 22, t[22]), np.insert(v, 22, v[22])
    assert not any(flagged(t2, v2))
    v[20:26] = v[20]
    t2, v2 = np.insert(t, 22, t[22]), np.insert(v, 22, v[22])
    assert [i for i, k in enumerate(flagged(t2, v2)) if k == "stuck"] == list(range(20, 27))


def test_faulty_readings(spark):
    rows, want = [], {}
    n = 0
    for item in (1, 2):
        t, v = made_source(2000, item)
        v[1000:1002] = 150
        v[959] = 300  # around the border of two blocks
        for i in range(2000):
            n += 1
            rows.append((n, 7, item, int(t[i]), float(v[i]), "x"))
            if i in (1000, 1001):
                want[n] = "spike"
            if i == 959:
                want[n] = "impossible"
    rows += [(90_000, None, 1, 5, 1.0, "x"), (90_001, 7, 1, None, 1.0, "x"), (None, 7, 1, 5, 80.0, "x"), (90_002, 8, 99, 5, 1e9, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, stay_id bigint, itemid bigint, t bigint, value double, kind string")
    items = spark.createDataFrame([(1, 10.0, 200.0, "vital", 60), (2, 10.0, 200.0, "vital", 60)], "itemid bigint, physical_low double, physical_high double, category string, grid_minutes int")
    got = {r.row_id: r.kind for r in faulty_readings(df, items).collect()}
    assert {k: v for k, v in got.items() if v != "stuck"} == want
    assert faulty_readings(df.limit(0), items).count() == 0


def test_all_categories_of_stays(spark, monkeypatch, tmp_path):
    def stays(n, name):
        spark.range(2 * n).selectExpr(
            "id as stay_id", "1.0D as los", "timestamp_seconds(0) as admittime", "timestamp_seconds(86400) as dischtime",
            "0 as hospital_expire_flag", f"concat('race', id % {n}) as race", "if(id = 0, null, if(id = 1, '', 'public')) as insurance",
        ).write.parquet(f"{tmp_path}/{name}/visits_iv.parquet")
        return f"{tmp_path}/{name}"

    monkeypatch.setattr(data_problems, "impute_chained", lambda df, key, numbers, categories: categories)
    assert data_problems.p3_stays(spark, stays(60, "a")) == {"race": sorted(f"race{i}" for i in range(60)), "insurance": ["public"]}
    with pytest.raises(ValueError, match="race has more than 100"):
        data_problems.p3_stays(spark, stays(101, "b"))


def test_stuck_runs_of_sparse_sources(spark):
    # One reading a day on a grid of 240 minutes; runs over every border of blocks, of time and of readings.
    _, v = made_source(1100)
    t = np.arange(1100) * 24 * HOUR
    for first in (39, 475, 1023 - 4, 1040):
        v[first : first + 6] = v[first] + 0.03
    v[1060:1062] = 150
    rows = [(i, 7, 1, int(a), float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))]
    rows += [(10_000 * (k + 1) + i, *rows[i][1:]) for i in (1024, 1025) for k in range(70)]  # repeated rows are no readings
    rows += [(1_000_000 + i, 8, 1, int(t[i]), float(v[i])) for i in range(1027)]
    df = spark.createDataFrame(rows, "row_id bigint, stay_id bigint, itemid bigint, t bigint, value double")
    items = spark.createDataFrame([(1, 10.0, 200.0, "lab", 240)], "itemid bigint, physical_low double, physical_high double, category string, grid_minutes int")
    got = defaultdict(set)
    for r in faulty_readings(df, items).collect():
        got[r.kind].add(r.row_id)
    runs = {i for f in (39, 475, 1019, 1040) for i in range(f, f + 6)}
    copies = {10_000 * (k + 1) + 1024 for k in range(70)}
    assert got["stuck"] == runs | copies | {1_000_000 + i for i in runs if i < 1027}
    assert got["spike"] == {1060, 1061}


UNITS = [(1, "mg/dL", True, 1.0, 50.0, 400.0), (1, "mmol/L", False, 18.0, 3.0, 22.0), (2, "K/uL", True, 1.0, 1.0, 40.0), (2, "cells/uL", False, 0.001, 1000.0, 40000.0), (2, "10^9/L", False, 1.0, 1.0, 40.0)]


def test_units(spark):
    rows = [
        (1, 1, "90", 90.0, "mg/dL", "mg/dL"), (2, 1, "5", 5.0, "MMOL / l", "mmol/L"), (3, 1, "5.5 (mM)", None, "", "mmol/L"), (4, 1, "mg% 90", None, None, "mg/dL"),
        (5, 1, "5", 5.0, None, "mmol/L"), (6, 1, "90", 90.0, "n/a", "mg/dL"), (7, 2, "x10^3/uL 11.9", None, None, "K/uL"), (8, 2, "5.1x10^3/uL", None, None, "K/uL"),
        (9, 2, "10^9/L 5", None, None, "10^9/L"), (10, 2, "5 10*9/L", None, None, "10^9/L"), (11, 2, "> 5000", 5000.0, None, "cells/uL"), (12, 2, "5", 5.0, None, "K/uL"),
        (13, 1, "pending", None, "mg/dL", None), (14, 1, None, None, None, None), (15, 1, "7", 7.0, "furlong", None), (16, 9, "7", 7.0, "mg/dL", None), (17, 1, "nan", float("nan"), "mg/dL", None),
    ]
    df = spark.createDataFrame([r[:5] for r in rows] + [rows[0][:5]], "labevent_id bigint, itemid bigint, value string, valuenum double, valueuom string").withColumn("uom", F.lit("z"))
    units = spark.createDataFrame(UNITS, "itemid bigint, uom string, is_common boolean, factor_to_common double, plausible_low double, plausible_high double")
    out = harmonise(df, units).collect()
    assert sum(r.labevent_id == 1 for r in out) == 2
    got = {r.labevent_id: r for r in out}
    assert {k: r.uom for k, r in got.items()} == {r[0]: r[5] for r in rows if r[0] not in (13, 14, 16, 17)}
    assert got[2].common_value == 90.0
    assert got[11].common_value == 5.0
    assert got[15].common_value is None
    assert harmonise(df.limit(0), units).count() == 0


def test_unit_graph():
    g = UnitGraph()
    g.add("C", "K", Affine(1.0, 273.15))
    g.add("F", "C", Affine(5 / 9, -160 / 9))
    f = g.to("K")["F"]
    assert math.isclose(212 * f.factor + f.offset, 373.15)
    g.add("F", "K", Affine(5 / 9, 0.0))
    with pytest.raises(ValueError, match="disagree"):
        g.to("K")
    with pytest.raises(ValueError, match="two conversions"):
        g.add("C", "K", Affine(2.0))
    assert {r[2] for r in conversions([u[:4] for u in UNITS])} == {"mg/dL", "mmol/L", "K/uL", "cells/uL", "10^9/L"}


def test_fill_readings_beats_the_mean(spark):
    rng = np.random.default_rng(4)
    rows, truth, n = [], {}, 0
    for stay in range(30):
        base = rng.normal(0, 10)
        for h in range(60):
            wave = rng.normal(0, 5)
            for item, level in ((1, 80), (2, 120), (3, 50)):
                n += 1
                v = level + base + wave + rng.normal(0, 0.5)
                hide = rng.random() < 0.1
                if hide:
                    truth[n] = (item, v)
                rows.append((n, stay, item, h * HOUR + 5, None if hide else float(v), bool(hide)))
    extra = [(90_001, 1, 1, None, None, True), (90_002, 99, 1, HOUR, None, True), (90_003, 1, 77, HOUR, None, True), (None, 1, 1, 5, None, True), (90_004, None, 2, 5, None, True)]
    df = spark.createDataFrame(rows + extra, "row_id bigint, stay_id bigint, itemid bigint, t bigint, value double, missing boolean")
    items = spark.createDataFrame([(1, 0.0, 300.0), (2, 0.0, 300.0), (3, 0.0, 300.0)], "itemid bigint, physical_low double, physical_high double")
    got = {r.row_id: r for r in fill_readings(df, items).collect()}
    assert set(got) == {*truth, 90_001, 90_002, 90_003, 90_004}
    assert got[90_001].basis == "stay"
    assert got[90_002].basis == "item"
    assert got[90_003].filled_value is None
    mean = {i: np.mean([r[4] for r in rows if r[2] == i and r[4] is not None]) for i in (1, 2, 3)}
    ours = np.sqrt(np.mean([(got[k].filled_value - v) ** 2 for k, (i, v) in truth.items()]))
    plain = np.sqrt(np.mean([(mean[i] - v) ** 2 for i, v in truth.values()]))
    assert ours < 0.3 * plain
    assert {r.row_id: r.filled_value for r in fill_readings(df, items).collect()} == {k: r.filled_value for k, r in got.items()}
    assert fill_readings(df.limit(0), items).count() == 0


def test_impute_chained(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        a = float(rng.normal())
        rows.append((i, a, 2 * a + float(rng.normal(0, 0.1)), "hot" if a > 0 else "cold", None))
    hidden = {i: rows[i] for i in range(0, 600, 11)}
    given = [(r[0], r[1], None if r[0] in hidden else r[2], None if r[0] in hidden else r[3], None) for r in rows]
    df = spark.createDataFrame(given, "id bigint, a double, b double, c string, d double")
    out = {r.id: r for r in impute_chained(df, "id", ["a", "b", "d"], {"c": ["cold", "hot"]}).collect()}
    assert all(out[i].b_filled == (i in hidden) and not out[i].a_filled and out[i].d is None and not out[i].d_filled for i in range(600))
    assert np.sqrt(np.mean([(out[i].b - r[2]) ** 2 for i, r in hidden.items()])) < 0.4
    assert np.mean([out[i].c == r[3] for i, r in hidden.items()]) > 0.85
    spread = np.std([out[i].b - 2 * r[1] for i, r in hidden.items()])
    assert spread > 0.02  # residual variation is kept
    assert impute_chained(df.limit(0), "id", ["a"], {"c": ["cold"]}).count() == 0


def test_stuck_by_vanishing_innovations(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(80, 2, 60)
    v[20:40] = 80 + rng.normal(0, 1e-6, 20)
    rows = [(i, 1, 7, i * HOUR, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "row_id bigint, stay_id bigint, itemid bigint, t bigint, value double")
    items = spark.createDataFrame([(7, 0.0, 300.0, "vital", 60)], "itemid bigint, physical_low double, physical_high double, category string, grid_minutes int")
    stuck = lambda **k: sorted(r.row_id for r in faulty_readings(df, items, **k).collect() if r.kind == "stuck")
    assert stuck() == list(range(20, 40))
    assert stuck(vanishing=0.0) == []


def test_flags_do_not_depend_on_the_cuts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = np.round(80 + np.cumsum(rng.normal(0, 0.2, 3000)) + rng.normal(0, 1, 3000), 1)
    for at in rng.choice(np.arange(20, 2980, 20), 60, replace=False):
        v[at : at + rng.integers(1, 4)] += 40
    for at in (500, 1021, 2044):
        v[at : at + 7] = v[at]
    t = np.cumsum(rng.integers(1, 5, 3000)) * HOUR
    df = spark.createDataFrame([(i, 1, 7, int(a), float(x)) for i, (a, x) in enumerate(zip(t, v, strict=True))], "row_id bigint, stay_id bigint, itemid bigint, t bigint, value double")
    items = spark.createDataFrame([(7, 0.0, 300.0, "vital", 60)], "itemid bigint, physical_low double, physical_high double, category string, grid_minutes int")
    found = {}
    for size in (10_000, 1024, 700, 311):
        monkeypatch.setattr(spikes, "BLOCK_READINGS", size)
        found[size] = {(r.row_id, r.kind) for r in faulty_readings(df, items).collect()}
    whole = found[10_000]
    assert len(whole) > 100
    for size in (1024, 700, 311):
        assert found[size] == whole
