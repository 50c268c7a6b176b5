"""Further queries on cohorts, splits, model inputs and answers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.functions.text import padded
from vitalake.operators import answers, cohort, metrics, mlfeed, sampling
from vitalake.plans.cohort_queries import _MED_CELLS, DRUGS, _med_grid, drugs, r6
from vitalake.plans.evaluation_queries import _P, _PARSED, _h, _parsed, predictions
from vitalake.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function as a query under its name, with the SQL it must agree with."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT stay_id, subject_id, CASE WHEN year(intime) - 2085 < 0 THEN 90 ELSE year(intime) - 2085 END AS age FROM visits_iv
WHERE coalesce(hospital_expire_flag, 0) = 0 AND (CASE WHEN year(intime) - 2085 < 0 THEN 90 ELSE year(intime) - 2085 END) >= 18
""")
def eligible_stays(spark: SparkSession, d: str) -> DataFrame:
    """Stays of adults who didn't die in hospital, for a birth in 2085."""
    v = table(spark, d, "visits_iv").withColumn("age", cohort.icu_age(F.lit(2085), F.col("intime")))
    return v.where("coalesce(hospital_expire_flag, 0) = 0 and age >= 18").select("stay_id", "subject_id", "age")


@query("""
SELECT stay_id, CASE WHEN dod BETWEEN admittime AND dischtime THEN 1 ELSE 0 END AS in_hospital, CASE WHEN dod BETWEEN intime AND outtime THEN 1 ELSE 0 END AS in_unit
FROM (SELECT *, CASE WHEN hospital_expire_flag = 1 THEN dischtime END AS dod FROM visits_iv)
""")
def death_flags(spark: SparkSession, d: str) -> DataFrame:
    """Deaths within the hospital stay and within the unit's."""
    v = table(spark, d, "visits_iv").withColumn("dod", F.when(F.col("hospital_expire_flag") == 1, F.col("dischtime")))
    within = lambda a, b: cohort.died_within(F.col("dod"), F.col(a), F.col(b))
    return v.select("stay_id", within("admittime", "dischtime").alias("in_hospital"), within("intime", "outtime").alias("in_unit"))


@query("""
WITH v AS (SELECT DISTINCT subject_id, hadm_id, admittime, dischtime FROM admissions WHERE subject_id IS NOT NULL AND admittime IS NOT NULL),
l AS (SELECT CASE WHEN row_number() OVER (PARTITION BY subject_id ORDER BY admittime DESC, hadm_id DESC) = 1 THEN 0
       WHEN EXISTS (SELECT 1 FROM v x WHERE x.subject_id = v.subject_id AND x.admittime > v.dischtime AND x.admittime <= v.dischtime + INTERVAL 30 DAY) THEN 1 ELSE 0 END AS label FROM v)
SELECT 'los' AS task, sum(CASE WHEN los > 5 THEN 1 ELSE 0 END)::BIGINT AS positive, count(*) AS n FROM visits_iv
UNION ALL SELECT 'mortality', sum(CASE WHEN hospital_expire_flag = 1 AND dischtime >= admittime THEN 1 ELSE 0 END)::BIGINT, count(*) FROM visits_iv WHERE admittime IS NOT NULL AND dischtime IS NOT NULL
UNION ALL SELECT 'readmission', sum(label)::BIGINT, count(*) FROM l
""")
def label_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Labels by the name of a task, for all tasks there are."""
    v = table(spark, d, "visits_iv").withColumn("dod", F.when(F.col("hospital_expire_flag") == 1, F.col("dischtime")))
    a = table(spark, d, "admissions").select("subject_id", "hadm_id", "admittime", "dischtime").distinct()
    made = {
        "los": cohort.labelled(v, "los", los=F.col("los"), days=5), "mortality": cohort.labelled(v, "mortality", death=F.col("dod")),
        "readmission": cohort.labelled(a, "readmission", gap_days=30),
    }
    one = [df.agg(F.lit(t).alias("task"), F.sum("label").alias("positive"), F.count(F.lit(1)).alias("n")).select("task", "positive", "n") for t, df in made.items()]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query("SELECT stay_id, 2016 + (year(intime) - 2150) AS year FROM visits_iv")
def year_windows(spark: SparkSession, d: str) -> DataFrame:
    """Years relative to an anchor and the group of its true years."""
    return table(spark, d, "visits_iv").select("stay_id", cohort.year_window(F.lit("2014 - 2016"), F.year("intime"), F.lit(2150)).alias("year"))


@query(f"""
SELECT pair_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT pair_id, ({_h('pair_id', 5)}) / 4294967296.0::DOUBLE AS u FROM test)
""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """70, 20 and 10 percent by the hash alone."""
    return sampling.shares(table(spark, d, "test").select("pair_id"), "pair_id", ["train", "validation", "test"], [0.7, 0.2, 0.1], 5)


@query("""
SELECT pair_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT pair_id, row_number() OVER (ORDER BY pair_id) AS r, count(*) OVER () AS n FROM test)
""")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    """70, 10 and 20 percent by place."""
    cuts = [("train", 0.7), ("validation", 0.8), ("test", 1.0)]
    return sampling.positional(table(spark, d, "test").select("pair_id"), "pair_id", cuts, F.floor(F.col("pair_id") / 1000))


@query(f"SELECT pair_id, (row_number() OVER (ORDER BY {_h('pair_id', 9)}, pair_id) - 1) // 32 AS batch FROM test")
def mini_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 32."""
    return sampling.batches(table(spark, d, "test").select("pair_id"), "pair_id", 32, 9)


@query("SELECT pair_id, unnest(range(1, CASE WHEN label_lipid_disorder = 1 THEN 4 ELSE 2 END))::INT AS copy FROM test")
def positive_copies(spark: SparkSession, d: str) -> DataFrame:
    """Positive rows three times."""
    t = table(spark, d, "test").select("pair_id", "label_lipid_disorder")
    return sampling.copies(t, "label_lipid_disorder", 3).select("pair_id", "copy")


@query("""
WITH v AS (SELECT DISTINCT 'race' AS "column", race AS value FROM visits_iv WHERE race IS NOT NULL UNION SELECT DISTINCT 'insurance', insurance FROM visits_iv WHERE insurance IS NOT NULL)
SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM v
""")
def label_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of categories."""
    return mlfeed.label_codes(table(spark, d, "visits_iv"), ["race", "insurance"])


@query("SELECT stay_id, " + ", ".join(f"coalesce((insurance = '{i}')::INT, 0) AS insurance_{i}" for i in ("other", "private", "public")) + " FROM visits_iv")
def one_hot_demographics(spark: SparkSession, d: str) -> DataFrame:
    """Categories, all there are, as columns."""
    v = table(spark, d, "visits_iv")
    return mlfeed.one_hot(v, "stay_id", "insurance", mlfeed.categories(v, "insurance"))


@query("WITH " + _MED_CELLS + " SELECT stay_id, " + ", ".join(
    f"coalesce(max(CASE WHEN itemid = {i} AND bucket = {b} THEN signal END), 0) AS f{i}_{b}" for i in DRUGS for b in range(6)
) + " FROM x GROUP BY 1")
def time_flattened(spark: SparkSession, d: str) -> DataFrame:
    """The grid of all drugs as one row a stay, with a column for each drug and bucket."""
    names = drugs(spark, d)
    flat = mlfeed.flattened(_med_grid(spark, d), "stay_id", "itemid", "bucket", "signal", names, 6)
    return flat.select("stay_id", *[F.col(f"`{i}_{b}`").alias(f"f{i}_{b}") for i in names for b in range(6)])


@query(f"""
WITH {_PARSED} SELECT model_name, CASE WHEN pred_binary IS NULL THEN 'unparseable' WHEN pred_binary = label_lipid_disorder THEN 'correct' ELSE 'wrong' END AS verdict, count(*) AS n
FROM parsed JOIN test ON pair_id = sample_id WHERE label_lipid_disorder IS NOT NULL GROUP BY 1, 2
""")
def audit_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on the answers of each model."""
    p = predictions(spark, d)
    return p.groupBy("model_name", answers.verdict(F.col("pred"), F.col("y")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_PARSED}, w AS (SELECT response_id, t, label_lipid_disorder AS y, prediction, narrative_current AS text, row_number() OVER (ORDER BY {_h('response_id', 2)}, response_id) AS n
  FROM parsed JOIN test ON pair_id = sample_id WHERE label_lipid_disorder IS NOT NULL AND pred_binary <> label_lipid_disorder)
SELECT response_id, (n - 1) // 8 AS batch, '--- Sample ' || ((n - 1) % 8 + 1) || ' ---' || chr(10) || '[Patient Medical History]' || chr(10) || coalesce(text, '') || chr(10)
  || '[Actual Outcome] ' || CASE y WHEN 1 THEN 'Yes' ELSE 'No' END || chr(10) || '[Wrong Prediction] ' || prediction AS sample FROM w
""")
def critic_batches(spark: SparkSession, d: str) -> DataFrame:
    """Wrong answers in batches of eight for a critic."""
    labels = table(spark, d, "test").where("label_lipid_disorder is not null").select(F.col("pair_id").alias("sample_id"), F.col("label_lipid_disorder").alias("y"), F.col("narrative_current").alias("narrative"))
    wrong = _parsed(spark, d).join(labels, "sample_id").where("pred_binary <> y").select("response_id", "y", "prediction", "narrative", F.lit(1).alias("one"))
    ranked = sampling.hash_ranked(wrong, ["one"], "response_id", 2)
    n = F.col("rank") - 1
    return ranked.select(
        "response_id", F.floor(n / 8).alias("batch"), answers.critic_block(n % 8 + 1, F.col("narrative"), F.col("y"), F.col("prediction"), F.lit("")).alias("sample")
    )


@query("""
SELECT response_id, round(CASE WHEN response_id % 3 = 0 THEN 1.0 ELSE exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) END, 6) AS prob_yes
FROM (SELECT response_id, -(response_id % 7) / 2.0 AS a, -(response_id % 5) / 2.0 AS b FROM raw_llm_responses)
""")
def logprob_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities from the first token's alternatives; a third of the rows lack the word no."""
    a, b = -(F.col("response_id") % 7) / 2.0, -(F.col("response_id") % 5) / 2.0
    top = F.when(F.col("response_id") % 3 == 0, F.create_map(F.lit(" Yes"), a, F.lit("maybe"), b)).otherwise(F.create_map(F.lit("yes"), a, F.lit(" No"), b))
    p = answers.logprob_confidence(top)
    return table(spark, d, "raw_llm_responses").select("response_id", r6(p["prob_yes"]).alias("prob_yes"))


@query("""
WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT vec_id, i, greatest(-5, least(5, (x - avg(x) OVER w) / stddev_pop(x) OVER w)) AS z FROM e WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, i, round((z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w), 5) AS x FROM s WINDOW w AS (PARTITION BY vec_id)
""")
def signal_standardised(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as signals between 0 and 1."""
    e = table(spark, d, "embeddings").select("vec_id", answers.standardised(F.col("embedding").cast("array<double>")).alias("s"))
    return e.select("vec_id", F.posexplode("s").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


@query("SELECT vec_id, len(embedding)::BIGINT AS size, round(embedding[17]::DOUBLE, 6) AS first FROM embeddings")
def signal_cropped(spark: SparkSession, d: str) -> DataFrame:
    """The centre 32 entries of vectors, and zeros around shorter ones."""
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    c = answers.fixed_length(F.col("v"), 32)
    return e.select("vec_id", F.size(answers.fixed_length(c, 64)).cast("bigint").alias("size"), r6(c[0]).alias("first"))


@query(f"""
WITH {_P}, x AS (SELECT y, CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END AS loss FROM (SELECT y, least(greatest(score, 1e-12), 1 - 1e-12) AS q FROM p WHERE score IS NOT NULL))
SELECT round(avg(loss), 6) AS log_loss, round(avg(CASE WHEN y = 1 THEN loss END) + avg(CASE WHEN y = 0 THEN loss END), 6) AS balanced_log_loss FROM x
""")
def log_losses(spark: SparkSession, d: str) -> DataFrame:
    """Log losses of the probabilities."""
    m = metrics.log_losses(predictions(spark, d), "y", "score")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query()
def temperature_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Log losses before and after scaling by the best temperature, found by iteration."""
    q = F.least(F.greatest(F.col("score"), F.lit(1e-3)), F.lit(1 - 1e-3))
    p = predictions(spark, d).where("score is not null").select("y", "score", F.log(q / (1 - q)).alias("logit"))
    t = metrics.temperature(p, "y", "logit")
    after = metrics.log_losses(metrics.scaled(p, "logit", t), "y", "calibrated").select(F.lit(round(t, 4)).alias("temperature"), "log_loss")
    return metrics.log_losses(p, "y", "score").select(F.lit(1.0).alias("temperature"), "log_loss").unionByName(after)


@query("SELECT p_partkey, lpad(p_size::VARCHAR, 6, '0') AS code FROM part")
def padded_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes with zeros before them."""
    return table(spark, d, "part").select("p_partkey", padded(F.col("p_size").cast("string"), 6).alias("code"))


@query()
def svd_values(spark: SparkSession, d: str) -> DataFrame:
    """Singular values of the matrix of embeddings, by MLlib."""
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    values, _ = mlfeed.svd(rows, "v", 8)
    return spark.createDataFrame(list(enumerate(values)), "i int, value double")


@query(f"""
WITH r AS (SELECT pair_id, row_number() OVER (PARTITION BY label_lipid_disorder ORDER BY {_h('pair_id')}, pair_id) AS k, count(*) OVER (PARTITION BY label_lipid_disorder) AS n,
  ({_h('pair_id', 1)}) / 4294967296.0::DOUBLE AS u FROM test)
SELECT pair_id, CASE WHEN k <= ceil(n * 0.2) THEN 'test' WHEN u < 0.15 THEN 'val_tune' ELSE 'train_fit' END AS part FROM r
""")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Which part of the fused inputs each row is in: test, tuning or fitting."""
    t = sampling.stratified_split(table(spark, d, "test").select("pair_id", "label_lipid_disorder"), "label_lipid_disorder", "pair_id", 0.2)
    inner = sampling.shares(t, "pair_id", ["val_tune", "train_fit"], [0.15, 0.85], 1, "inner")
    return inner.select("pair_id", F.when(F.col("split") == "test", "test").otherwise(F.col("inner")).alias("part"))
