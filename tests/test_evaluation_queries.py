"""Sizes of the jobs that queries hand to the operators."""

import numpy as np
from pyspark.sql import functions as F

from vitalake.plans import evaluation_queries


def test_bootstrap_has_all_replicates(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("response_id"), (F.col("id") % 2).alias("y"), (F.col("id") % 3 % 2).alias("pred"))
    asked = []

    class Recorded:
        def __init__(self, seed):
            self.own = np.random.Generator(np.random.PCG64(seed))

        def multinomial(self, n, shares, size):
            asked.append((n, size))
            return self.own.multinomial(n, shares, size)

    monkeypatch.setattr(evaluation_queries, "predictions", lambda *_: rows)
    monkeypatch.setattr(evaluation_queries.metrics.np.random, "default_rng", Recorded)
    got = {r.metric: r for r in evaluation_queries.bootstrap_ci(spark, "").collect()}
    assert set(got) == {"accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy"}
    assert asked == [(400, 1000)]
    # Rows drawn with replacement give the same interval.
    y, p = (np.array([r[c] for r in rows.select("y", "pred").collect()]) for c in (0, 1))
    rng = np.random.Generator(np.random.PCG64(1))
    drawn = sorted(float(np.mean(y[i] == p[i])) for i in (rng.integers(0, 400, 400) for _ in range(1000)))
    assert abs(got["accuracy"].low - 100 * drawn[25]) < 1.5
    assert abs(got["accuracy"].high - 100 * drawn[975]) < 1.5


def test_baselines_are_whole(spark, monkeypatch, tmp_path):
    rows = spark.range(40).select(
        F.col("id").alias("pair_id"), (F.col("id") % 2).cast("int").alias("label_lipid_disorder"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda x: F.concat(F.lit("w"), (x + 200 * F.col("id")).cast("string"))), ";").alias("medications_current"),
    )
    rows.write.parquet(f"{tmp_path}/test.parquet")
    from pyspark.ml import classification

    sizes, seen = {}, set()

    class Model:
        def transform(self, df):
            return df.withColumn("prediction", F.col("label"))

    def patch(name, wanted):
        def fit(self, train):
            sizes[name] = self.getOrDefault(wanted)
            seen.add(train.first().features.size)
            return Model()

        monkeypatch.setattr(getattr(classification, name), "fit", fit)

    for name, wanted in (("LogisticRegression", "maxIter"), ("RandomForestClassifier", "numTrees"), ("GBTClassifier", "maxIter")):
        patch(name, wanted)
    evaluation_queries.ml_baselines(spark, str(tmp_path))
    assert sizes == {"LogisticRegression": 1000, "RandomForestClassifier": 100, "GBTClassifier": 100}
    assert seen == {30 * 200}
