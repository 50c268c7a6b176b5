"""Inputs of models: vocabularies, weights, tokens and baselines."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Sequence
from functools import lru_cache

import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalake.operators.ranks import grouped_percentiles, join_small
from vitalake.operators.visits import dense_ids


def code_tokens(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and ``token``: distinct lower-case words of joined lists; names of many words become many tokens."""
    text = F.lower(F.concat_ws(" ", *[F.regexp_replace(F.coalesce(F.col(c), F.lit("")), ";", " ") for c in columns]))
    return df.select(key, F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("token")).where("token <> ''")


def vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``token``, ``df`` (rows that have it) and ``index``, from 0 in alphabetical order."""
    counted = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("df"))
    return dense_ids(counted, [token], "index")


def sparse_rows(tokens: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``key`` and the sorted indices of its known tokens; unknown ones are left out."""
    return tokens.join(vocab.select("token", "index"), "token").groupBy(key).agg(F.array_sort(F.collect_list("index")).alias("indices"))


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """The English stop words that Spark brings along."""
    jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
    (jar,) = (os.path.join(jars, x) for x in os.listdir(jars) if x.startswith("spark-mllib_"))
    with zipfile.ZipFile(jar) as z:
        return tuple(z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8").split())


def tfidf(df: DataFrame, key: str, text: str, most: int = 5000, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``key``, ``token`` and ``weight``: tf * (ln((1 + n) / (1 + df)) + 1), each row at length one.

    Tokens are words of two or more signs, without ``stop_words`` (Spark's English ones, if None); the ``most`` frequent in the corpus are kept.
    """
    stop = [w for w in (english_stop_words() if stop_words is None else stop_words) if "'" not in w]  # no token has an apostrophe
    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))).alias("token"))
    tf = rows.where(~F.col("token").isin(stop)).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    terms = tf.groupBy("token").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "token").limit(most)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    weighted = tf.join(F.broadcast(terms), "token").crossJoin(F.broadcast(n)).select(  # at most ``most`` rows; one row
        key, "token", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w")
    )
    return weighted.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).drop("w")


def quartile_tokens(df: DataFrame, feature: str, value: str) -> DataFrame:
    """``df`` with ``token``: the feature and the right-closed quartile of its value; zeros and nulls have none.

    Equal edges are one; a feature with one value has the single token ``<feature>_0``.
    """
    rows = df.where((F.col(value) != 0) & ~F.isnan(value))
    tops = rows.groupBy(feature).agg(F.max(value).alias("top"))
    edges = grouped_percentiles(rows, feature, value, [0.25, 0.5, 0.75], "edges").join(tops, feature).select(
        feature, F.filter(F.array_distinct("edges"), lambda e: e < F.col("top")).alias("edges")
    )
    of = F.size(F.filter("edges", lambda e: F.col(value) > e))
    return join_small(rows, edges, feature).withColumn("token", F.concat(F.col(feature).cast("string"), F.lit("_"), of.cast("string"))).drop("edges")


def token_sequences(visits: DataFrame, key: str, order: list[str], codes: str, most: int = 512) -> DataFrame:
    """``CLS``, then the codes of each visit in order with ``SEP`` after each; sequences of ``most`` or more are left out, before they are collected.

    Also segments (0 and 1 by turns from visit to visit), positions of visits and the mask.
    """
    size = visits.groupBy(key).agg((F.sum(F.size(codes) + 1) + 1).alias("__n")).where(F.col("__n") < most).select(key)
    parts = visits.join(size, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(codes).alias("codes")))).alias("v"))
    tokens = F.concat(F.array(F.lit("CLS")), F.flatten(F.transform("v", lambda x: F.concat(x["codes"], F.array(F.lit("SEP"))))))
    seps = F.transform("tokens", lambda _, i: F.size(F.filter(F.slice("tokens", 1, i), lambda t: t == "SEP")))
    return (
        parts.select(key, tokens.alias("tokens"))
        .withColumn("positions", seps)
        .withColumn("segments", F.transform("positions", lambda p: p % 2))
        .withColumn("mask", F.transform("tokens", lambda _: F.lit(1)))
    )


def padded(tokens: str, to: int, pad: str = "PAD"):  # noqa: ANN201
    """An array column filled up to ``to`` entries."""
    return F.concat(F.col(tokens), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(to) - F.size(tokens))))


def baselines(train: DataFrame, test: DataFrame, features: str, label: str, trees: int = 100, seed: int = 42, steps: int = 1000, boosts: int = 100) -> DataFrame:
    """Predictions on ``test`` of logistic regression, a decision tree, a random forest and boosted trees fitted on ``train``.

    The regression takes ``steps`` iterations at most, the forest ``trees`` and the boosting ``boosts`` trees.
    """
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier

    made = {
        "logistic_regression": LogisticRegression(featuresCol=features, labelCol=label, maxIter=steps, regParam=0.01, standardization=False),
        "decision_tree": DecisionTreeClassifier(featuresCol=features, labelCol=label, seed=seed),
        "random_forest": RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, seed=seed),
        "boosted_trees": GBTClassifier(featuresCol=features, labelCol=label, maxIter=boosts, seed=seed),
    }
    out = None
    for name, model in made.items():
        rows = model.fit(train).transform(test).select(F.lit(name).alias("model"), F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"))
        out = rows if out is None else out.unionByName(rows)
    return out


def importances(train: DataFrame, features: str, label: str, names: list[str], trees: int = 100, seed: int = 42) -> DataFrame:
    """``feature``, its importance in a random forest and its weight in a logistic regression with classes of equal weight."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    from vitalake.operators.inputs import balanced_weights

    forest = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, seed=seed).fit(train)
    weighted = balanced_weights(train, label)
    line = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", maxIter=1000, regParam=0.01).fit(weighted)
    rows = [(n, float(forest.featureImportances[i]), float(line.coefficients[i])) for i, n in enumerate(names)]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double, weight double")


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``value`` and ``code``: categories of each column in alphabetical order from 0."""
    sets = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    once = df.select(F.explode(sets).alias("x")).select("x.*").where(F.col("value").isNotNull()).distinct()
    return once.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)


#: The most categories that become columns.
MOST_COLUMNS = 1000


def categories(df: DataFrame, column: str) -> list:
    """All values of ``column`` in order, without null; a ValueError if there are more than ``MOST_COLUMNS``."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values")
    return sorted(found)


def one_hot(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """A column of 0 and 1 for each of ``values``; others are 0 everywhere."""
    return df.select(key, *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def flattened(grid: DataFrame, key: str, feature: str, t: str, value: str, features: list, n: int) -> DataFrame:
    """A row a key with a column ``<feature>_<t>`` for each feature and time; missing cells are 0."""
    name = F.concat(F.col(feature).cast("string"), F.lit("_"), F.col(t).cast("string"))
    names = [f"{f}_{i}" for f in features for i in range(n)]
    return grid.withColumn("__c", name).groupBy(key).pivot("__c", names).agg(F.first(value)).na.fill(0)


def svd(rows: DataFrame, features: str, k: int):  # noqa: ANN201
    """Singular values of the uncentred matrix of ``features``, and its right vectors as a matrix.

    The Gram matrix is added up by the tasks; only numbers of columns times columns reach the driver.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    vectors = rows.select(features).rdd.map(lambda r: Vectors.fromML(r[0]))
    found = RowMatrix(vectors).computeSVD(k)
    return found.s.toArray().tolist(), found.V


def perceptron(train: DataFrame, test: DataFrame, features: str, label: str, layers: list[int], seed: int = 42) -> DataFrame:
    """Predictions of a multilayer perceptron."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    model = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, seed=seed, maxIter=50).fit(train)
    return model.transform(test)
