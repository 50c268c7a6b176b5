"""Operators on visits, features, grids, evaluation and answers on small made-up tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitalake.functions.text import clean_title, has_code, ndc_key, ndc_table_key, padded, split_codes, strip
from vitalake.operators import answers, cohort, features, metrics, mlfeed, sampling, timeseries, visits

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2130, 1, 1)


def test_text(spark):
    df = spark.createDataFrame([(" \ta;,\n", "272; 2720 ;nan;;272X", "123456", 12345)], "a string, c string, w string, n bigint")
    r = df.select(
        strip(F.col("a")).alias("s"), clean_title(F.col("a")).alias("t"), split_codes(F.col("c")).alias("codes"),
        has_code(split_codes(F.col("c")), "^272[0-9]").alias("hit"), padded(F.col("w"), 5).alias("p"), ndc_key(F.col("n")).alias("ndc"),
        ndc_table_key(F.lit("12-3")).alias("key"), has_code(F.lit(None).cast("array<string>"), "x").alias("none"),
    ).first()
    assert (r.s, r.t, r.codes, r.hit, r.p, r.ndc, r.key, r.none) == ("a;,", "a", ["272", "2720", "272X"], True, "123456", "000000123", "000120003", False)


def test_distinct_concat_keeps_first_seen_order(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (None, "x", 1), (2, None, 1)], "k bigint, code string, o int")
    assert [tuple(r) for r in visits.distinct_concat(df, "k", "code", ["o"], "c").collect()] == [(1, "b;a")]


def test_pairs_and_ids(spark):
    rows = [(1, 10, T0), (1, 11, T0), (1, 12, T0 + DAY), (2, 20, T0), (None, 30, T0), (None, 31, T0)]
    v = spark.createDataFrame(rows, "s bigint, h bigint, t timestamp_ntz")
    pairs = visits.consecutive_pairs(v, "s", ["t", "h"], ["h"])
    got = visits.dense_ids(pairs, ["s", "h_current"]).orderBy("pair_id").collect()
    assert [(r.pair_id, r.h_current, r.h_next) for r in got] == [(0, 10, 11), (1, 11, 12)]


def test_readmission(spark):
    rows = [
        (1, 10, T0, T0 + DAY), (1, 11, T0 + 31 * DAY, T0 + 32 * DAY),  # exactly 30 days
        (2, 20, T0, T0 + DAY), (2, 21, T0 + 31 * DAY + dt.timedelta(microseconds=1), T0 + 40 * DAY),
        (3, 30, T0, T0 + DAY), (3, 31, T0 + DAY, T0 + 2 * DAY),  # at the very end
        (4, 40, T0, T0 + 10 * DAY), (4, 41, T0 + DAY, T0 + 2 * DAY), (4, 42, T0 + 12 * DAY, T0 + 13 * DAY),  # overlapping
        (5, 50, T0, None), (5, 51, T0 + DAY, T0 + 2 * DAY),
    ]
    v = spark.createDataFrame(rows, "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz")
    got = {r.hadm_id: r.label for r in cohort.readmission(v, 30).collect()}
    assert got == {10: 1, 11: 0, 20: 0, 21: 0, 30: 0, 31: 0, 40: 1, 41: 1, 42: 0, 50: 0, 51: 0}
    assert cohort.readmission(v.limit(0), 30).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        cohort.labelled(v, "x")


def test_hours_round_down(spark):
    df = spark.createDataFrame([(T0 - dt.timedelta(minutes=30), T0)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(cohort.whole_hours(F.col("a"), F.col("b")).alias("h")).first().h == -1


def test_assign_visits(spark):
    adm = spark.createDataFrame(
        [(1, 10, T0, T0 + 5 * DAY), (1, 11, T0 + 2 * DAY, T0 + 40 * DAY), (1, 12, T0 + 2 * DAY, T0 + 3 * DAY), (2, 20, T0, None)],
        "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz",
    )
    ev = spark.createDataFrame(
        [(1, 1, None, T0 + DAY), (2, 1, None, T0 + 2 * DAY), (3, 1, None, T0 + 40 * DAY + dt.timedelta(hours=3)), (4, 1, None, T0 + 60 * DAY), (5, 1, 99, T0), (6, 2, None, T0), (7, 1, None, None)],
        "e bigint, subject_id bigint, hadm_id bigint, charttime timestamp_ntz",
    )
    got = {r.e: r.hadm_id for r in features.assign_visits(ev, adm, ["e"], "charttime").collect()}
    assert got == {1: 10, 2: 11, 3: 11, 4: None, 5: 99, 6: None, 7: None}


def test_main_unit_and_outliers(spark):
    rows = [(1, "a")] * 96 + [(1, "b")] * 2 + [(1, None)] * 2 + [(2, "a")] * 94 + [(2, "b")] * 6 + [(3, None)] * 3
    df = spark.createDataFrame(rows, "i bigint, u string")
    got = {(r.i, r.u): r["count"] for r in features.keep_main_unit(df, "i", "u").groupBy("i", "u").count().collect()}
    assert got == {(1, "a"): 96, (2, "a"): 94, (2, "b"): 6, (3, None): 3}
    v = spark.createDataFrame([(1, float(x)) for x in range(101)], "i bigint, v double")
    w = features.winsorise(v, "i", "v", 2, 98).agg(F.min("v"), F.max("v"), F.count("v")).first()
    assert tuple(w) == (2.0, 98.0, 101)
    assert features.winsorise(v, "i", "v", 2, 98, drop=True).count() == 97


def test_grids(spark):
    cells = spark.createDataFrame([(1, 5, 1, 3.0, 2.0), (1, 5, 2, 2.5, None)], "s bigint, i bigint, bucket bigint, stop double, dose double")
    got = [(r.signal, r.value) for r in timeseries.med_grid(cells, ["s", "i"], 5).orderBy("bucket").collect()]
    assert got == [(0, 0.0), (1, 2.0), (1, 2.0), (0, 0.0), (0, 0.0)]
    labs = spark.createDataFrame([(1, 2, 4.0), (1, 4, 6.0)], "s bigint, bucket bigint, value double")
    got = [(r.signal, r.value) for r in timeseries.lab_grid(labs, ["s"], 6).orderBy("bucket").collect()]
    assert got == [(0, 4.0), (0, 4.0), (1, 4.0), (0, 4.0), (1, 6.0), (0, 6.0)]


def test_rank_metrics(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.4), (0, 0.4), (1, 1.0), (None, 0.3), (1, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y == 1 and s is not None]
    neg = [s for y, s in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, tp, seen = 0.0, 0, 0
    for t in sorted({*pos, *neg}, reverse=True):
        new = pos.count(t)
        tp += new
        seen += new + neg.count(t)
        ap += new / len(pos) * tp / seen
    m = metrics.rank_metrics(df, "y", "s").first()
    assert math.isclose(m.roc_auc, auc)
    assert math.isclose(m.average_precision, ap)
    flipped = metrics.rank_metrics(df.withColumn("s", 1 - F.col("s")), "y", "s").first()
    assert math.isclose(m.roc_auc + flipped.roc_auc, 1)
    one = metrics.rank_metrics(df.where("y = 1"), "y", "s").first()
    assert one.roc_auc is None
    assert metrics.curve_points(df.where("y = 1"), "y", "s").count() == 0


def test_thresholds_and_bins(spark):
    rows = [(int(k % 3 == 0), k / 100) for k in range(101)]
    df = spark.createDataFrame(rows, "y int, s double")
    for r in metrics.threshold_sweep(df, "y", "s").collect():
        assert r.tp == sum(y for y, s in rows if s >= r.threshold)
        assert r.fn == sum(y for y, s in rows if s < r.threshold)
    bins = {r.bin: r.n for r in metrics.calibration(df, "y", "s").collect()}
    assert sum(bins.values()) == 100  # the score of 1 is in none
    assert bins[3] == 10
    assert metrics.pick_threshold(metrics.threshold_sweep(df, "y", "s"), min_precision=101).first().threshold == 0.5
    assert metrics.probability_bins(df.where("s > 0.9"), "s", "y").count() == 5


def test_bootstrap_and_temperature(spark):
    rows = [(i, int(i % 4 == 0), int(i % 4 == 0 or i % 10 == 0), (3.0 if i % 4 == 0 else -3.0) * (1 if i % 5 else -1)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, y int, pred int, logit double")
    got = {r.metric: r for r in metrics.bootstrap(df, "y", "pred", 100).collect()}
    whole = metrics.confusion_metrics(df, "y", "pred").first()
    assert all(got[m].low <= whole[m] <= got[m].high and math.isclose(got[m].value, whole[m]) for m in ("accuracy", "f1"))
    t = metrics.temperature(df, "y", "logit")
    assert math.isclose(1 / (1 + math.exp(-3 / t)), 0.8, rel_tol=1e-3)


ANSWERS = [
    ("Prediction: Yes\nProbability: 0.82\nReasoning: because.", "Yes", "structured", 0.82, "ok", False, "because."),
    (" Prediction :  no \nProbability: 1.5", "No", "structured", None, "out_of_range", False, ""),
    ("yes", "Yes", "first_line", None, "missing", False, ""),
    ("No\nsome words", "No", "first_line", None, "missing", False, "some words"),
    ("I think\nPrediction: No\nPrediction: Yes\nProbability: 0.5", "No", "structured", 0.5, "ok", True, None),
    ("so Prediction: Yes, Probability: 80%", "Yes", "fallback", None, "missing", False, None),
    ("well, no", "No", "fallback", None, "missing", False, "well, no"),
    ("hm\nProbability: NaN", "unparseable", "unparseable", None, "missing", False, "hm\nProbability: NaN"),
    ("Yes\nProbability: 80%", "Yes", "first_line", None, "invalid", False, "Probability: 80%"),
    ("Yes\nProbability: 1e-1", "Yes", "first_line", 0.1, "ok", True, "Probability: 1e-1"),
    ("", "unparseable", "unparseable", None, "missing", False, ""),
    (None, "unparseable", "unparseable", None, "missing", False, ""),
]


def test_parse_answers(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, text string")
    got = {r.i: r for r in answers.parse_answers(df, "text").collect()}
    for i, (_, pred, status, p, p_status, warn, reason) in enumerate(ANSWERS):
        r = got[i]
        assert (r.prediction, r.parser_status, r.probability, r.probability_status, r.probability_format_warning) == (pred, status, p, p_status, warn), i
        assert reason is None or r.reasoning == reason, i


def test_entities_and_sections(spark):
    df = spark.createDataFrame([(1, "Denies chest pain; fever. Mother had severe headache.\nPlan: Rest at home"), (2, None)], "id bigint, t string")
    got = {r.entity: (r.negated, r.family, r.severe) for r in answers.entities(df, "id", "t").collect()}
    assert got == {"chest pain": (True, False, False), "fever": (False, False, False), "headache": (False, True, True)}
    assert [(r.section, r.content) for r in answers.sections(df, "id", "t").collect()] == [("Plan", "Rest at home")]


def test_entities_by_mention(spark):
    df = spark.createDataFrame([
        (1, "Fever yesterday, no fever now"), (2, "CKD runs in the family; chronic kidney disease or ckd, mild CKD."),
        (3, "Heroine use, systolic chf and diastolic chf"),
    ], "id bigint, t string")
    got = {(r.id, r.clause, r.entity, r.mention): (r.negated, r.family, r.severe) for r in answers.entities(df, "id", "t").collect()}
    none = (False, False, False)
    kidney = "chronic kidney disease"
    assert got == {
        (1, 0, "fever", 1): none, (1, 0, "fever", 2): (True, False, False), (2, 0, kidney, 1): (False, True, False),
        (2, 1, kidney, 1): none, (2, 1, kidney, 2): none, (2, 1, kidney, 3): (False, False, True),
        (3, 0, "heroine", 1): none, (3, 0, "systolic chf", 1): none, (3, 0, "diastolic chf", 1): none,
    }


def test_signals_and_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 4.0])], "id bigint, v array<double>")
    got = {r.id: r.s for r in df.select("id", answers.standardised(F.col("v")).alias("s")).collect()}
    assert got[1] == pytest.approx([0.0, 0.5, 1.0])
    assert got[2] == [0.0, 0.0]
    assert {tuple(r[0]) for r in df.select(answers.fixed_length(F.col("v"), 4)).collect()} == {(1.0, 2.0, 3.0, 0.0), (0.0, 4.0, 4.0, 0.0)}
    assert {tuple(r[0]) for r in df.select(answers.fixed_length(F.col("v"), 1)).collect()} == {(2.0,), (4.0,)}
    m = answers.mean_vectors(spark.createDataFrame([(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])], "k bigint, v array<double>"), "k", "v").collect()
    assert {(r.k, r.i): round(r.unit, 6) for r in m} == {(1, 0): 0.6, (1, 1): 0.8, (2, 0): 0.0, (2, 1): 0.0}


def test_two_agent_rounds(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "id int, y int")
    seen = []

    def predict(rows, advice):
        seen.append(advice)
        return rows.withColumn("pred", F.col("y") if advice else F.lit(1))

    out, advice = answers.two_agent_rounds(df, predict, lambda wrong: f"{wrong.count()} wrong", 3)
    assert advice == "1 wrong"
    assert seen == ["", "1 wrong"]
    assert out.where("pred <> y").count() == 0


def test_sampling(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "id bigint, y int")
    got = sampling.stratified_split(df, "y", "id", 0.2).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {(1, "test"): 10, (1, "train"): 40, (0, "test"): 30, (0, "train"): 120}
    f = sampling.folds(df, "id", 5, "y").groupBy("fold", "y").count().collect()
    assert {r["count"] for r in f if r.y == 1} == {10}
    assert {r["count"] for r in f if r.y == 0} == {30}
    assert sampling.exemplars(df, "y", "id", 3, 3).groupBy("y").count().count() == 2
    matched = sampling.exemplars(df, "y", "id", 2, 2, matched=True)
    assert matched.where("y = 1").count() == 1
    over = sampling.oversampled(df, "y", "id").groupBy("y").count().collect()
    assert {r["count"] for r in over} == {150}


def test_mlfeed(spark):
    df = spark.createDataFrame([(1, "Insulin Glargine;Senna"), (2, "senna;"), (3, None)], "id bigint, m string")
    vocab = {r.token: (r.df, r["index"]) for r in mlfeed.vocabulary(mlfeed.code_tokens(df, "id", ["m"])).collect()}
    assert vocab == {"glargine": (1, 0), "insulin": (1, 1), "senna": (2, 2)}
    q = spark.createDataFrame([("a", float(x)) for x in range(9)] + [("b", 5.0)] * 3 + [("a", None)], "f string, v double")
    got = {(r.f, r.v): r.token for r in mlfeed.quartile_tokens(q, "f", "v").collect()}
    assert got["b", 5.0] == "b_0"
    assert got["a", 1.0] == "a_0"
    assert got["a", 8.0] == "a_3"
    assert ("a", 0.0) not in got
    s = spark.createDataFrame([(1, 1, ["x", "y"]), (1, 2, ["z"])], "k bigint, o int, codes array<string>")
    r = mlfeed.token_sequences(s, "k", ["o"], "codes").first()
    assert r.tokens == ["CLS", "x", "y", "SEP", "z", "SEP"]
    assert r.segments == [0, 0, 0, 0, 1, 1]
    assert mlfeed.token_sequences(s, "k", ["o"], "codes", most=6).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    from vitalake.sources import readers, sinks

    df = spark.createDataFrame([("007", 1, "x"), ("08", None, 'a "b", c')], "code string, n bigint, t string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "T.csv"))
    back = readers.raw_table(spark, str(tmp_path), "T", df.schema, ["code", "n"])
    assert sorted((r.code, r.n) for r in back.collect()) == [("007", 1), ("08", None)]
    with pytest.raises(FileNotFoundError):
        readers.raw_table(spark, str(tmp_path), "U", df.schema)
    sinks.write_json_lines(df, str(tmp_path / "j"))
    sinks.append_rows(df, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), df.schema).count() == 4
    sinks.write_by_entity(df, str(tmp_path / "e"), "code")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    sinks.write_document(df, str(tmp_path / "d" / "x.json"))
    assert readers.json_folder(spark, str(tmp_path / "d")).count() == 1
    assert readers.binary_by_id(spark, str(tmp_path / "d")).first().id == "x"
    assert {r.column: r.nulls for r in readers.profile(df).collect()} == {"code": 0, "n": 1, "t": 0}
    assert "| code | n | t |" in sinks.markdown(df)


def test_stream(spark, tmp_path):
    from vitalake.streaming.buckets import each_batch, windowed

    rows = [(T0 + dt.timedelta(minutes=20 * i), "a" if i % 2 else "b", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    df.write.parquet(str(tmp_path / "in"))
    want = {(r.start, r.k): (r.n, r["mean"]) for r in windowed(df, "ts", ["k"], "v").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "ts", ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.start, r.k): (r.n, r["mean"]) for r in spark.sql("select * from w").collect()} == want
    q = stream.writeStream.foreachBatch(each_batch(lambda b: b.where("v > 5"), lambda b: b.write.mode("append").parquet(str(tmp_path / "out")))).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24


def test_dense_ids_over_many_partitions(spark):
    from vitalake.operators.visits import dense_ids

    wide = spark.range(400_000, numPartitions=16).select(
        ((F.col("id") * 7919) % 400_009).alias("a"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("hot"), F.repeat(F.lit("x"), 40).alias("text")
    )
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    got = dense_ids(wide, ["hot", "a"], "n")
    w = Window.orderBy("n")
    checked = got.withColumn("before", F.lag(F.struct("hot", "a")).over(w)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("n").alias("ids"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.sum((F.col("before") >= F.struct("hot", "a")).cast("int")).alias("wrong"),
    ).first()
    assert tuple(checked) == (400_000, 400_000, 0, 399_999, 0)
    assert dense_ids(wide.limit(0), ["a"], "n").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")
