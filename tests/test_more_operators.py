"""Sources, sinks, checked joins, codes, model inputs, prompts and settings on small made-up tables."""

import datetime as dt
import gzip
import hashlib
import json
import logging
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalake import session, settings
from vitalake.functions.text import exact_round
from vitalake.operators import cases, checked, codes, cohort, features, inputs, mlfeed, prompting, ranks, sampling, visits
from vitalake.sources import readers, sinks


def test_raw_tables(spark, tmp_path):
    with gzip.open(tmp_path / "LABS.csv.gz", "wt") as f:
        f.write("code,n\n007,1\n")
    (tmp_path / "LABS.csv").write_text("code,n\n9,9\n")
    assert [tuple(r) for r in readers.raw_table(spark, str(tmp_path), "LABS", "code string, n int").collect()] == [("007", 1)]
    assert readers.raw_table(spark, f"file://{tmp_path}", "LABS", "code string, n int", ["n"]).columns == ["n"]
    with pytest.raises(FileNotFoundError):
        readers.raw_table(spark, str(tmp_path), "none", "code string")


def test_named_and_extracted_tables(spark, tmp_path):
    (tmp_path / "core").mkdir()
    (tmp_path / "core" / "patients.csv").write_text("gender,subject_id,anchor_age,anchor_year,extra\nF,5,60,2150,x\n,6,,2150,\n")
    got = {r.subject_id: (r.yob, r.gender) for r in readers.named_table(spark, str(tmp_path), "patients").collect()}
    assert got == {5: (2090, "F"), 6: (None, None)}
    with pytest.raises(ValueError, match="unknown table"):
        readers.named_table(spark, str(tmp_path), "x")
    for raw, columns, _, _ in readers.EXTRACTION.values():
        (tmp_path / f"{raw}.csv").write_text(",".join(columns) + "\n" + ",".join(" 012 " if c == "ICD9_CODE" else "2130-01-02 03:04:05" if c == "ADMITTIME" else "x" for c in columns) + "\n")
    made = readers.extracted(spark, str(tmp_path))
    assert len(made) == 7
    assert made["diagnoses"].first()["ICD9_CODE"] == "012"
    a = made["admissions"].first()
    assert (a.ADMITTIME, a.DISCHTIME, a.SUBJECT_ID) == (dt.datetime(2130, 1, 2, 3, 4, 5), None, None)


def test_notes_and_files(spark, tmp_path):
    (tmp_path / "discharge.csv").write_text('id,text\n1,"two\nlines ""quoted"""\n')
    assert readers.notes(spark, str(tmp_path), "Discharge").first()["text"] == 'two\nlines "quoted"'
    images = tmp_path / "images"
    images.mkdir()
    for n in ("a1.png", "a1.jpg", "B2_view.jpeg", "c.txt"):
        (images / n).write_text("x")
    ids = spark.createDataFrame([("a1",), ("b2",), ("zz",), (None,)], "dicom string")
    got = {r.dicom: r.path and r.path.split("/")[-1] for r in readers.found_files(spark, ids, "dicom", str(images)).collect()}
    assert got == {"a1": "a1.jpg", "b2": "B2_view.jpeg", "zz": None, None: None}


def test_json_consolidated(spark, tmp_path):
    for rel, text in {"raw_llm_responses/few/2.json": '{"a": 1}', "metrics.json": '{"b": [1, 2]}', "raw_llm_responses/few/1.json": '{"a": "ü"}', "bad.json": "{"}.items():
        p = tmp_path / "in" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    df = readers.json_consolidated(spark, str(tmp_path / "in"))
    got = {r.path: r.line and json.loads(r.line) for r in df.collect()}
    assert got == {
        "raw_llm_responses/few/2.json": {"a": 1}, "raw_llm_responses/few/1.json": {"a": "ü"}, "metrics.json": {"__artifact__": "metrics.json", "json": {"b": [1, 2]}}, "bad.json": None,
    }
    sinks.write_lines(df, str(tmp_path / "out"), "path")
    lines = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert [json.loads(x) for x in lines] == [got[k] for k in sorted(got) if got[k]]
    files = readers.json_folder(spark, str(tmp_path / "in"))
    assert readers.mentions(files, "FEW").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "k int, t string")
    sinks.write_entities({"demo": df}, df, str(tmp_path / "e"), "k")
    assert (tmp_path / "e" / "demo" / "k=1").is_dir()
    assert (tmp_path / "e" / "labels").is_dir()
    sinks.write_bundle({"x": df.withColumn("v", F.array("k"))}, str(tmp_path / "b"), {"seed": 3})
    tables, about = sinks.read_bundle(spark, str(tmp_path / "b"))
    assert about == {"seed": 3}
    assert tables["x"].count() == 2
    assert "a\\|b<br>c" in sinks.report("R", {"one": df, "two": "text"})
    with pytest.raises(ValueError, match="more than 1"):
        sinks.markdown(df, 1)
    assert sinks.fenced("a ``` b").startswith("````\n")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "f.txt").write_text("x")
    made = sinks.archive([str(tmp_path / "src" / "f.txt")], str(tmp_path), str(tmp_path / "arch"), move=True)
    assert made["archived"] == ["src/f.txt"]
    assert not (tmp_path / "src" / "f.txt").exists()
    (tmp_path / "src" / "f.txt").write_text("y")
    assert sinks.archive([str(tmp_path / "src" / "f.txt")], str(tmp_path), str(tmp_path / "arch"))["skipped"] == ["src/f.txt"]


def test_settings(tmp_path):
    base = {"a": {"x": 1, "y": 2}, "b": 1}
    assert settings.deep_merge(base, {"a": {"y": 3}, "b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    assert base["a"]["y"] == 2
    (tmp_path / "a.json").write_text('{"a": {"x": 1}}')
    (tmp_path / "b.json").write_text('{"a": {"y": 2}}')
    assert settings.load_settings(str(tmp_path / "a.json"), [str(tmp_path / "b.json"), str(tmp_path / "none.json")]) == {"a": {"x": 1, "y": 2}}
    assert settings.logger("vitalake.t") is settings.logger("vitalake.t")
    settings.set_seed(4)
    a = random.random()
    settings.set_seed(4)
    assert random.random() == a


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Folder:
        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(Folder)})()

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    fake = type("Session", (), {"sparkContext": Context, "conf": type("C", (), {"get": staticmethod(lambda *_: None)})})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)
    assert session.stored(spark.range(3)).count() == 3


def test_checked_joins(spark, caplog):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, b string")
    assert checked.join_report(a, b, "k").first().asDict() == {"left_rows": 4, "right_rows": 2, "left_keys": 2, "right_keys": 2, "left_alone": 2, "right_alone": 1, "joined": 2}
    with caplog.at_level(logging.WARNING):
        assert checked.inner_checked(a, b, "k").count() == 2
    assert "2 of 4 rows" in caplog.text
    with pytest.raises(ValueError, match="no partner"):
        checked.inner_checked(a, b, "k", lost="error")
    with pytest.raises(ValueError, match="shares"):
        checked.inner_checked(a.limit(0), b, "k")
    with pytest.raises(ValueError, match="unique"):
        checked.one_to_one(a, b, "k")
    with pytest.raises(ValueError, match="null"):
        checked.one_to_one(a.where("k = 2"), b, "k", ["b"])
    with pytest.raises(ValueError, match="sizes"):
        checked.equal_size_join(a, b, "k")
    assert checked.equal_size_join(b, b.withColumn("b", F.lit("c")), "k").columns == ["k", "b", "b_right"]
    with pytest.raises(KeyError, match="c, d"):
        checked.require_columns(a, ["a", "c", "d"])
    firsts = checked.distinct_on(a, ["k"], ["a"]).collect()
    assert sorted((r.k or 0, r.a) for r in firsts) == [(0, "n"), (1, "x"), (2, "z")]
    assert checked.left_first(b, a, "k", ["a"]).count() == 2
    assert checked.data_quality(a, "k", ["k"]).first().asDict() == {"rows": 4, "keys": 2, "again": 1, "absent": 1}


def test_codes(spark):
    ev = spark.createDataFrame([("V10", 9), ("2720", 9), ("I50", 10), (None, 10)], "code string, version int")
    assert {r.code for r in codes.without_prefixes(ev, "code", ["V", "E"]).collect()} == {"2720", "I50", None}
    assert codes.of_versions(ev, "version", [10]).count() == 2
    assert codes.of_versions(ev, "version").count() == 4
    with pytest.raises(ValueError, match="grouping"):
        codes.grouped_code("x", F.col("code"), F.col("code"))
    lit = spark.createDataFrame([("['a', 'b c']",), ('["d"]',), ("[]",), ("oops",), (None,)], "t string").select(codes.list_literal(F.col("t")).alias("x"))
    assert [r.x for r in lit.collect()] == [["a", "b c"], ["d"], [], None, None]
    rx = spark.createDataFrame([(1, 2060100), (2, 99), (3, None), (4, -1)], "id int, ndc bigint")
    products = spark.createDataFrame([("0-20601", "Aspirin", "Anti [EPC],X [MoA]"), ("0-206", "B", None), ("00-0206", "b", "Y [EPC]")], "product string, name string, classes string")
    got = [(r.id, r.generic, r.established) for r in codes.drug_classes(rx, products, "ndc", "product", "name", "classes").collect()]
    assert all(r[0] == 1 or r[0] == 2 for r in got)
    brand = spark.createDataFrame([("12-34-5",), ("12-34",), ("9-9-9",), (None,)], "c string")
    names = spark.createDataFrame([("12-34", "zeta"), ("12-34", "alpha")], "p string, n string")
    assert [r.generic for r in codes.generic_name(brand, names, "c", "p", "n").orderBy("c").collect()] == [None, "alpha", "alpha", None]
    assert spark.range(1).select(codes.drug_name(F.lit("  Aspirin EC ")).alias("d")).first().d == "aspirin_ec"


def test_exact_round(spark):
    values = [2.675, 0.125, 0.375, -2.675, 0.0, 1e-12, 99.995, 1e17, 33.333333, 0.005, 1.005, 66.66666666666667, float("inf")] + [random.Random(1).uniform(-100, 100) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", exact_round(F.col("v"), 2).alias("a"), exact_round(F.col("v"), 4).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(round(v, 2), round(v, 4)) if math.isfinite(v) else (v, v) for v in values]


def test_percentiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 3000), np.round(rng.normal(0, 50, 3000), 1), strict=True)] + [(None, 1.0), (1, None), (1, float("nan")), (9, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r.p for r in ranks.grouped_percentiles(df, "k", "v", [0.0, 0.02, 0.5, 0.98, 1.0]).collect()}
    assert set(got) == {0, 1, 2, 9}
    for k, p in got.items():
        own = [v for i, v in rows if i == k and v is not None and not math.isnan(v)]
        assert np.allclose(p, np.percentile(own, [0, 2, 50, 98, 100]))
    assert ranks.grouped_percentiles(df.limit(0), "k", "v", [0.5]).count() == 0


def test_pairs_of_a_long_history(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2130, 1, 1)
    rows = [(1 if i % 3 else 2, i, t0 + dt.timedelta(hours=rng.randint(0, 40_000))) for i in range(900)] + [(3, 999, t0), (None, 1000, t0)]
    df = spark.createDataFrame(rows, "s int, v int, t timestamp_ntz")
    got = {(r.s, r.v_current): r.v_next for r in visits.consecutive_pairs(df, "s", ["t", "v"], ["v"]).collect()}
    want = {}
    for s in (1, 2):
        own = [v for _, v in sorted((t, v) for k, v, t in rows if k == s)]
        want |= {(s, a): b for a, b in zip(own, own[1:], strict=False)}
    assert got == want
    assert {r.s for r in visits.consecutive_pairs(df, "s", ["t", "v"], ["v"], min_visits=400).collect()} == {1}
    order = {r.v: r.visit_order for r in visits.visit_order(df, "s", ["t", "v"]).collect()}
    own = [v for _, v in sorted((t, v) for k, v, t in rows if k == 1)]
    assert [order[v] for v in own] == list(range(len(own)))


def test_readmission_over_blocks(spark):
    t0 = dt.datetime(2130, 1, 1)
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a = t0 + dt.timedelta(hours=rng.randint(0, 60_000))
        rows.append((i % 3, i, a, None if i % 17 == 0 else a + dt.timedelta(hours=rng.randint(1, 900))))
    df = spark.createDataFrame(rows, "subject_id int, hadm_id int, admittime timestamp_ntz, dischtime timestamp_ntz")
    got = {r.hadm_id: r.label for r in cohort.readmission(df, 30).collect()}
    for s, h, a, d in rows:
        last = max((x[2], x[1]) for x in rows if x[0] == s) == (a, h)
        again = d is not None and any(x[0] == s and dt.timedelta(0) < x[2] - d <= dt.timedelta(days=30) for x in rows)
        assert got[h] == int(again and not last)


def test_inputs(spark):
    tokens = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("CLS",)], "token string")
    assert {r.token: r["index"] for r in inputs.special_vocabulary(tokens).collect()} == {"PAD": 0, "CLS": 1, "SEP": 2, "a": 3, "b": 4, "UNK": 5}
    assert {r.token: r["index"] for r in inputs.special_vocabulary(tokens.limit(0)).collect()} == {"PAD": 0, "CLS": 1, "SEP": 2, "UNK": 3}
    with pytest.raises(ValueError, match="regime"):
        inputs.regime(tokens, "x", "a", "b")
    with pytest.raises(ValueError, match="unknown features"):
        inputs.build_features("x", {"bag": lambda: None})
    assert inputs.build_features("bag", {"bag": lambda n: n}, 3) == 3
    assert [inputs.svd_rank(*x) for x in ((50, 10, 30), (50, 100, 30), (1, 100, 30))] == [9, 30, 2]
    v = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (2, None)], "k int, x array<string>")
    assert sorted(tuple(r) for r in inputs.multi_hot(v, "k", "x", ["a", "c", "z"]).collect()) == [(1, 1, 1, 0), (2, 0, 0, 0)]
    e = spark.createDataFrame([(1, 0, "t")] * 3 + [(2, h, "t") for h in range(40)], "k int, h int, t string")
    c = spark.createDataFrame([(1, "y"), (1, "x"), (2, "z")], "k int, c string")
    got = {r.k: r.tokens for r in inputs.event_sequences(c, e, "k", "c", "h", "t", 20).collect()}
    assert got == {1: ["CLS", "x", "y", "SEP", "t", "SEP"]}
    s = spark.createDataFrame([([3.0, 4.0], [[1.0, 2.0], [3.0, 6.0]], [0, 0])], "v array<double>, m array<array<double>>, k array<int>")
    r = s.select(inputs.unit_length(F.col("v")).alias("u"), inputs.masked_mean(F.col("m"), F.col("k"), 2).alias("z"), inputs.resampled(F.col("v"), 3).alias("r")).first()
    assert (r.u, r.z, r.r) == ([0.6, 0.8], [0.0, 0.0], [3.0, 3.5, 4.0])
    assert mlfeed.categories(tokens, "token") == ["CLS", "a", "b"]


def test_prompts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    template = "{# no #}{% raw %}{% block user %} Say {{ t }}{{ none }}! {% endblock %}{% endraw %}"
    assert [r.p for r in df.select(prompting.flat_prompt(prompting.messages(template, {"t": F.col("t")})).alias("p")).collect()] == ["USER:\nSay a!", "USER:\nSay !"]
    with pytest.raises(ValueError, match="render"):
        prompting.rendered("{% if x %}", {})
    text = 'é "q" \\ 😀\n'
    row = spark.createDataFrame([(text,)], "t string").select(
        prompting.canonical_key(F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content"))), F.lit("m"), F.lit(0.5), F.lit(None)).alias("k")
    ).first()
    want = json.dumps({"messages": [{"role": "user", "content": text}], "model": "m", "temperature": 0.5, "seed": None}, sort_keys=True)
    assert row.k == hashlib.sha256(want.encode()).hexdigest()
    assert prompting.consolidated(["a", "", "b"]) == "Batch 1:\na\n\n---\n\nBatch 3:\nb"
    assert prompting.consolidated(["a"], "llm", lambda p: [p[0].upper() + " "]) == "BATCH 1:\nA"
    assert prompting.consolidated(["a"], "llm", lambda p: 1 / 0) == "Batch 1:\na"
    assert prompting.template_of("coagent_calibration") == prompting.template_of("few_shot")
    with pytest.raises(ValueError, match="mode"):
        prompting.template_of("x")
    with pytest.raises(ValueError, match="consolidate"):
        prompting.consolidated(["a"], "x")

    def flaky(prompts):
        if len(prompts) > 1 or prompts[0] == "2":
            raise RuntimeError("no")
        return [prompts[0] * 2]

    p = spark.createDataFrame([(i, str(i)) for i in range(4)], "id int, prompt string").coalesce(1)
    assert {r.id: r.text for r in prompting.completed(p, "prompt", flaky).collect()} == {0: "00", 1: "11", 2: "", 3: "33"}
    scored = prompting.out_of_fold(sampling.folds(p, "id", 2), "fold", 2, lambda t: t.count(), lambda m, t: t.withColumn("n", F.lit(m)))
    assert sorted((r.id, r.n) for r in scored.collect()) == [(i, 2) for i in range(4)]
    rounds = prompting.critic_rounds(p, "id", 3, 3).collect()
    assert sorted((r.round, r.place) for r in rounds) == [(a, b) for a in range(3) for b in range(3)]
    assert len({r.id for r in rounds}) == 4
    assert prompting.critic_rounds(p.limit(0), "id", 3, 3).count() == 0


def test_cases_and_small_reports(spark):
    rows = [(1, 1, 1, 0.9, "2720", "Atorvastatin", "x"), (2, 0, 0, 0.1, "", "", None), (3, 1, 0, 0.5, "", "", "y"), (4, 0, 1, 0.45, "", "Statin", "z")]
    df = spark.createDataFrame(rows, "id int, pred int, y int, p double, codes string, drugs string, text string")
    got = cases.case_records(df, "id", "pred", "y", "p", "codes", "drugs", "text")
    assert {r.case_id: (r.case_type, r.tags, r.explanation) for r in got.collect()} == {
        "1": ("TP", "high_confidence", cases.EXPLANATIONS["TP_code"]), "2": ("TN", "high_confidence", cases.EXPLANATIONS["TN"]),
        "3": ("FP", "borderline", cases.EXPLANATIONS["FP"]), "4": ("FN", "borderline", cases.EXPLANATIONS["FN"]),
    }
    assert cases.check_records(got, 1) is got
    with pytest.raises(ValueError, match="records"):
        cases.check_records(got, 2)
    with pytest.raises(ValueError, match="strategy"):
        sampling.exemplars(df, "y", "id", 1, 1, strategy="x")
    assert sampling.exemplars(df, "y", "id", 1, 1, strategy="similarity").count() == 2
    assert sampling.folds(df, "id", 3, equal=True).count() == 3
    assert features.first_examples(df, "y", "id", 1).count() == 2
    assert cohort.phenotype(
        spark.createDataFrame([(1, 1, dt.datetime(2130, 1, 1), dt.datetime(2130, 1, 2))], "subject_id int, hadm_id int, admittime timestamp_ntz, dischtime timestamp_ntz"),
        spark.createDataFrame([(1, "I50")], "hadm_id int, c string"), "hadm_id", F.col("c"), "^I50", 30,
    ).first()["label"] == 0


def test_units_by_composition():
    from vitalake.operators.units import conversions

    rows = {(item, key): (unit, factor, offset) for item, key, unit, _, factor, offset in conversions([(1, "mg/dL", True, 1.0), (1, "mmol/L", False, 18.016), (2, "degC", True, 1.0)], unlisted=True)}
    assert rows[1, "g/l"][0] == "g/L"
    assert math.isclose(rows[1, "g/l"][1], 100.0)  # by way of mg/L
    assert math.isclose(rows[1, "umol/l"][1], 0.018016)
    assert rows[1, "mg/dl"] == ("mg/dL", 1.0, 0.0)
    unit, factor, offset = rows[2, "degf"]
    assert math.isclose(98.6 * factor + offset, 37.0)
    with pytest.raises(ValueError, match=r"disagree|two conversions"):
        conversions([(1, "g/dL", True, 1.0), (1, "g/L", False, 0.2)])
