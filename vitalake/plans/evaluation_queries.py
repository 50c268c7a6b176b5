"""Queries on answers, evaluation, sampling and model inputs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.functions.text import split_codes
from vitalake.operators import answers, metrics, mlfeed, sampling
from vitalake.operators.ranks import blocked_rank
from vitalake.plans.cohort_queries import r6
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


_PARSED = r"""
raw AS (SELECT response_id, sample_id, prompt_mode, model_name, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM raw_llm_responses),
words AS (SELECT *, regexp_replace(split_part(t, chr(10), 1), '^\s+|\s+$', '', 'g') AS f,
  regexp_replace(regexp_extract(t, '(?im)^[ \t]*Probability:[ \t]*(\S.*?)[ \t\r]*$', 1), '^\s+|\s+$', '', 'g') AS tok FROM raw),
steps AS (SELECT *, lower(regexp_extract(f, '(?i)^Prediction\s*:\s*(Yes|No)\b', 1)) AS a, lower(regexp_extract(f, '(?i)^(Yes|No)\b', 1)) AS b,
  lower(regexp_extract(t, '(?im)^[ \t]*Prediction:[ \t]*(Yes|No)[ \t\r]*$', 1)) AS c, lower(regexp_extract(t, '(?i)Prediction:\s*(Yes|No)\b', 1)) AS d,
  lower(regexp_extract(t, '(?i)\b(Yes|No)\b', 1)) AS e,
  CASE WHEN regexp_matches(tok, '^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$') THEN try_cast(tok AS DOUBLE) END AS v FROM words),
told AS (SELECT *, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), nullif(d, ''), nullif(e, '')) AS w,
  CASE WHEN a <> '' THEN 'structured' WHEN b <> '' THEN 'first_line' WHEN c <> '' THEN 'structured' WHEN d <> '' OR e <> '' THEN 'fallback' ELSE 'unparseable' END AS parser_status,
  CASE WHEN tok = '' THEN 'missing' WHEN v IS NULL THEN 'invalid' WHEN v NOT BETWEEN 0 AND 1 THEN 'out_of_range' ELSE 'ok' END AS st FROM steps),
parsed AS (SELECT response_id, sample_id, prompt_mode, model_name, t, parser_status,
  CASE w WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' ELSE 'unparseable' END AS prediction,
  CASE WHEN w IS NOT NULL AND st = 'ok' THEN v END AS probability, CASE WHEN w IS NULL THEN 'missing' ELSE st END AS probability_status,
  w IS NOT NULL AND st = 'ok' AND NOT regexp_matches(tok, '^(?:0|1|0\.\d{2}|1\.00)$') AS probability_format_warning,
  CASE w WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS pred_binary FROM told)
"""

#: Labels, hard predictions and probabilities of the responses whose pair has a label.
_P = _PARSED + """,
p AS (SELECT response_id, label_lipid_disorder AS y, pred_binary AS pred, probability AS score, prompt_mode, model_name
      FROM parsed JOIN test ON pair_id = sample_id WHERE label_lipid_disorder IS NOT NULL)
"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_llm_responses").select("response_id", "sample_id", "prompt_mode", "model_name", "text")
    return answers.parse_answers(raw, "text")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """response_id, y, pred, score, prompt_mode, model_name."""
    labels = table(spark, d, "test").where("label_lipid_disorder is not null").select(F.col("pair_id").alias("sample_id"), F.col("label_lipid_disorder").alias("y"))
    return _parsed(spark, d).join(labels, "sample_id").select(
        "response_id", "y", F.col("pred_binary").alias("pred"), F.col("probability").alias("score"), "prompt_mode", "model_name"
    )


@query(f"WITH {_PARSED} SELECT response_id, prediction, parser_status, probability, probability_status, probability_format_warning FROM parsed")
def parse_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Answers taken apart."""
    return _parsed(spark, d).select("response_id", "prediction", "parser_status", "probability", "probability_status", "probability_format_warning")


@query(f"""WITH {_PARSED} SELECT prompt_mode, parser_status, probability_status, count(*) AS n, sum(probability_format_warning::INT)::BIGINT AS warnings FROM parsed GROUP BY 1, 2, 3""")
def parse_health(spark: SparkSession, d: str) -> DataFrame:
    """How many answers parse in which way."""
    return _parsed(spark, d).groupBy("prompt_mode", "parser_status", "probability_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("probability_format_warning").cast("bigint")).alias("warnings")
    )


_SCORES = """
  round(100.0 * (tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(100.0 * tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(100.0 * tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(100.0 * tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(200.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(100.0 * (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / nullif((tp + fn > 0)::INT + (tn + fp > 0)::INT, 0), 6) AS balanced_accuracy,
  round(coalesce(100.0 * tn / nullif(tn + fn, 0), 0), 6) AS npv
"""
_COUNTS = "sum((y = 1 AND pred = 1)::INT)::BIGINT AS tp, sum((y = 0 AND pred = 1)::INT)::BIGINT AS fp, sum((y = 0 AND pred = 0)::INT)::BIGINT AS tn, sum((y = 1 AND pred = 0)::INT)::BIGINT AS fn"
_METRICS = ("accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy", "npv")


def _rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, "tp", "fp", "tn", "fn", *[r6(m).alias(m) for m in _METRICS])


@query(f"WITH {_P}, c AS (SELECT prompt_mode, model_name, {_COUNTS} FROM p WHERE pred IS NOT NULL GROUP BY 1, 2) SELECT prompt_mode, model_name, tp, fp, tn, fn, {_SCORES} FROM c")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts and metrics of each prompt mode and model."""
    return _rounded(metrics.confusion_metrics(predictions(spark, d), "y", "pred", ["prompt_mode", "model_name"]), ["prompt_mode", "model_name"])


@query(f"""
WITH {_P}, s AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM p WHERE score IS NOT NULL GROUP BY 1),
c AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pa, coalesce(sum(neg) OVER w, 0) AS na FROM s WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sum(pos) AS pp, sum(neg) AS nn FROM s)
SELECT round(sum(neg * (pa + pos / 2.0)) / any_value(pp * nn), 6) AS roc_auc, round(sum(pos * (pa + pos) / (pa + pos + na + neg)::DOUBLE) / any_value(pp), 6) AS average_precision,
  round(sum(pos * ((pa + pos) / (pa + pos + na + neg)::DOUBLE + CASE WHEN pa + na > 0 THEN pa / (pa + na)::DOUBLE ELSE 1 END) / 2) / any_value(pp), 6) AS auprc_trapezoid FROM c, t
""")
def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Area under both curves and average precision."""
    m = metrics.rank_metrics(predictions(spark, d), "y", "score")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query(f"""
WITH {_P}, s AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM p WHERE score IS NOT NULL GROUP BY 1),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC)), t AS (SELECT sum(pos) AS pp, sum(neg) AS nn FROM s)
SELECT score AS threshold, round(tp / pp::DOUBLE, 6) AS tpr, round(fp / nn::DOUBLE, 6) AS fpr, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / pp::DOUBLE, 6) AS recall FROM c, t
""")
def curve_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the curves."""
    c = metrics.curve_points(predictions(spark, d), "y", "score")
    return c.select("threshold", *[r6(x).alias(x) for x in ("tpr", "fpr", "precision", "recall")])


_SWEEP = f"""
k AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS threshold),
c AS (SELECT threshold, sum((y = 1 AND score >= threshold)::INT)::BIGINT AS tp, sum((y = 0 AND score >= threshold)::INT)::BIGINT AS fp,
  sum((y = 0 AND score < threshold)::INT)::BIGINT AS tn, sum((y = 1 AND score < threshold)::INT)::BIGINT AS fn FROM p, k WHERE score IS NOT NULL GROUP BY 1),
m AS (SELECT threshold, tp, fp, tn, fn, {_SCORES} FROM c)
"""


@query(f"WITH {_P}, {_SWEEP} SELECT * FROM m")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Metrics at each of 99 thresholds."""
    return _rounded(metrics.threshold_sweep(predictions(spark, d), "y", "score"), ["threshold"])


@query(f"WITH {_P}, {_SWEEP} SELECT arg_min(threshold, (-round(f1, 2), threshold)) AS threshold FROM m")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The first threshold with the greatest F1."""
    return metrics.pick_threshold(metrics.threshold_sweep(predictions(spark, d), "y", "score"))


_BINS = """
b AS (SELECT len(list_filter([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], lambda e: score >= e)) AS bin, count(*) AS n, avg(y) AS mean_label, avg(score) AS mean_score
      FROM p WHERE score IS NOT NULL GROUP BY 1)
"""


@query(f"WITH {_P}, {_BINS} SELECT bin, n, round(mean_label, 6) AS mean_label, round(mean_score, 6) AS mean_score FROM b WHERE bin < 10")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    """Labels and scores by tenth."""
    return metrics.calibration(predictions(spark, d), "y", "score").select("bin", "n", r6("mean_label").alias("mean_label"), r6("mean_score").alias("mean_score"))


@query(f"WITH {_P}, {_BINS} SELECT round(sum(n * abs(mean_label - mean_score)) / sum(n), 6) AS ece, round(max(abs(mean_label - mean_score)), 6) AS mce FROM b WHERE bin < 10")
def calibration_ece(spark: SparkSession, d: str) -> DataFrame:
    """Calibration errors."""
    return metrics.calibration_error(metrics.calibration(predictions(spark, d), "y", "score")).select(r6("ece").alias("ece"), r6("mce").alias("mce"))


@query(f"""
WITH {_P}, g AS (
  SELECT 'prompt_mode' AS sensitive_attribute, prompt_mode AS "group", {_COUNTS} FROM p WHERE pred IS NOT NULL AND prompt_mode IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'model_name', model_name, {_COUNTS} FROM p WHERE pred IS NOT NULL AND model_name IS NOT NULL GROUP BY 2)
SELECT sensitive_attribute, "group", tp, tn, fp, fn, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS tpr, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS tnr, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr,
  round(fn / nullif(fn + tp, 0)::DOUBLE, 6) AS fnr, round((tp + fp) / (tp + fp + tn + fn)::DOUBLE, 6) AS pr, round((tn + fn) / (tp + fp + tn + fn)::DOUBLE, 6) AS nr, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy FROM g
""")
def fairness_report(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each group of two attributes."""
    f = metrics.fairness(predictions(spark, d), "y", "pred", ["prompt_mode", "model_name"])
    return f.select("sensitive_attribute", "group", "tp", "tn", "fp", "fn", *[r6(c).alias(c) for c in ("tpr", "tnr", "fpr", "fnr", "pr", "nr", "accuracy")])


@query(f"""
WITH {_P}, c AS (SELECT CASE WHEN score <= 0.2 THEN 0 WHEN score <= 0.4 THEN 1 WHEN score <= 0.6 THEN 2 WHEN score <= 0.8 THEN 3 ELSE 4 END AS k, count(*) AS n, avg(y) AS m FROM p WHERE score BETWEEN 0 AND 1 GROUP BY 1),
b AS (SELECT * FROM (VALUES (0, '0.0-0.2'), (1, '0.2-0.4'), (2, '0.4-0.6'), (3, '0.6-0.8'), (4, '0.8-1.0')) AS t(k, bin))
SELECT bin, coalesce(n, 0) AS n, round(m, 6) AS mean_label FROM b LEFT JOIN c USING (k)
""")
def prob_bins(spark: SparkSession, d: str) -> DataFrame:
    """Labels by fifth of the probability."""
    return metrics.probability_bins(predictions(spark, d), "score", "y").select("bin", "n", r6("mean_label").alias("mean_label"))


@query(f"""
WITH {_P} SELECT model_name, count(score) AS n, sum((score = 0)::INT)::BIGINT AS zeros, sum((score = 1)::INT)::BIGINT AS ones, round(100.0 * avg((score IN (0, 1))::INT), 6) AS extreme_pct,
  sum((score > 0.8 OR score < 0.2)::INT)::BIGINT AS confident, sum((score BETWEEN 0.4 AND 0.6)::INT)::BIGINT AS borderline FROM p GROUP BY 1
""")
def extreme_stats(spark: SparkSession, d: str) -> DataFrame:
    """Extreme, confident and borderline probabilities of each model."""
    s = F.col("score")
    one = lambda c, n: F.sum(c.cast("int")).alias(n)
    return predictions(spark, d).groupBy("model_name").agg(
        F.count("score").alias("n"), one(s == 0, "zeros"), one(s == 1, "ones"), r6(100 * F.avg(s.isin(0.0, 1.0).cast("int"))).alias("extreme_pct"),
        one((s > 0.8) | (s < 0.2), "confident"), one(s.between(0.4, 0.6), "borderline"),
    )


@query(f"""
WITH {_P}, h AS (SELECT least(49, floor(score * 50)::INT) AS bin, count(*) AS n FROM p WHERE score BETWEEN 0 AND 1 GROUP BY 1)
SELECT bin, n FROM h
""")
def prob_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A histogram of fifty bins, the last closed on the right."""
    return predictions(spark, d).where("score between 0 and 1").groupBy(F.least(F.lit(49), F.floor(F.col("score") * 50).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Metrics with their bootstrap interval; the resamples are drawn, so there is no SQL."""
    return metrics.bootstrap(predictions(spark, d), "y", "pred")


@query(f"""
WITH {_P}, q AS (SELECT CASE WHEN pred = 1 AND y = 1 THEN 'TP' WHEN pred = 0 AND y = 0 THEN 'TN' WHEN pred = 1 THEN 'FP' ELSE 'FN' END AS case_type, response_id, score FROM p WHERE pred IS NOT NULL AND score IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY score, response_id) AS rn, count(*) OVER (PARTITION BY case_type) AS n FROM q),
mid AS (SELECT case_type, response_id, score FROM r WHERE n >= 3 AND rn = n // 2 + 1),
near AS (SELECT case_type, arg_min(response_id, (abs(score - 0.5), score, response_id)) AS response_id FROM r WHERE score BETWEEN 0.4 AND 0.6 AND rn <> 1 AND rn <> n GROUP BY 1)
SELECT case_type, 'low' AS pick, response_id FROM r WHERE rn = 1
UNION ALL SELECT case_type, 'high', response_id FROM r WHERE rn = n AND n > 1
UNION ALL SELECT mid.case_type, 'middle', CASE WHEN mid.score NOT BETWEEN 0.4 AND 0.6 AND near.response_id IS NOT NULL THEN near.response_id ELSE mid.response_id END FROM mid LEFT JOIN near USING (case_type)
""")
def case_studies(spark: SparkSession, d: str) -> DataFrame:
    """The lowest, middle and highest case of each quadrant; the middle one borderline if there is one."""
    p = predictions(spark, d).where("pred is not null and score is not null")
    kind = F.when((F.col("pred") == 1) & (F.col("y") == 1), "TP").when((F.col("pred") == 0) & (F.col("y") == 0), "TN").when(F.col("pred") == 1, "FP").otherwise("FN")
    r = blocked_rank(p.select(kind.alias("case_type"), "response_id", "score"), ["case_type"], [F.col("score"), F.col("response_id")], F.floor(F.col("score") * 4096), "rn")
    n = p.groupBy(kind.alias("case_type")).agg(F.count(F.lit(1)).alias("n"))
    r = r.join(F.broadcast(n), "case_type")  # four rows
    inner = F.col("score").between(0.4, 0.6) & (F.col("rn") != 1) & (F.col("rn") != F.col("n"))
    middle = (F.col("n") >= 3) & (F.col("rn") == F.floor(F.col("n") / 2) + 1)
    picks = r.groupBy("case_type").agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("rn") == 1, F.col("response_id"))).alias("low"),
        F.max(F.when(F.col("rn") == F.col("n"), F.col("response_id"))).alias("high"),
        F.max(F.when(middle, F.struct("score", "response_id"))).alias("mid"),
        F.min(F.when(inner, F.struct(F.abs(F.col("score") - 0.5).alias("off"), "score", "response_id"))).alias("near"),
    )
    chosen = F.when(~F.col("mid.score").between(0.4, 0.6) & F.col("near").isNotNull(), F.col("near.response_id")).otherwise(F.col("mid.response_id"))
    pick = lambda name, c: F.struct(F.lit(name).alias("pick"), c.alias("response_id"))
    return picks.select("case_type", F.explode(F.array(
        pick("low", F.col("low")), pick("high", F.when(F.col("n") > 1, F.col("high"))), pick("middle", chosen)
    )).alias("x")).select("case_type", "x.*").where("response_id is not null")


@query("""
SELECT response_id, round(1 / (1 + exp(b - a)), 6) AS prob_yes, round(1 / (1 + exp(a - b)), 6) AS prob_no, round(a - b, 6) AS margin_logit
FROM (SELECT response_id, (response_id % 17) / 4.0 AS a, (response_id % 11) / 3.0 AS b FROM raw_llm_responses)
""")
def two_way_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities from two logits."""
    t = answers.two_way((F.col("response_id") % 17) / 4.0, (F.col("response_id") % 11) / 3.0)
    return table(spark, d, "raw_llm_responses").select("response_id", *[r6(c).alias(n) for n, c in t.items()])


@query("SELECT response_id, sha256(coalesce(model_name, '') || chr(31) || coalesce(prompt_mode, '') || chr(31) || coalesce(prompt, '')) AS key FROM raw_llm_responses")
def request_hash(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a cache of answers."""
    return table(spark, d, "raw_llm_responses").select("response_id", answers.request_key(F.col("model_name"), F.col("prompt_mode"), F.col("prompt")).alias("key"))


@query("SELECT model_name, prompt_mode, count(*) AS n, count(DISTINCT prompt) AS distinct_requests FROM raw_llm_responses GROUP BY 1, 2")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Requests, and how many a cache by hash would send."""
    raw = table(spark, d, "raw_llm_responses").withColumn("key", answers.request_key(F.col("model_name"), F.col("prompt_mode"), F.col("prompt")))
    return raw.groupBy("model_name", "prompt_mode").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("distinct_requests"))


@query(r"""
SELECT doc_id, regexp_extract(s, '^\s*(\w+):', 1) AS section, count(*) AS n, sum(length(regexp_replace(regexp_extract(s, '^\s*\w+:(.*)$', 1), '^\s+|\s+$', '', 'g')))::BIGINT AS signs
FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?]) +', '\1' || chr(10), 'g'), '\n+')) AS s FROM documents WHERE text IS NOT NULL)
WHERE regexp_matches(s, '^\s*\w+:.*$') GROUP BY 1, 2
""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the notes."""
    return answers.sections(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("signs"))


@query("""
WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(replace(lower(text), ';', chr(10)), '([.!?]) +', '\\1' || chr(10), 'g'), '\\n+')) AS c FROM documents WHERE text IS NOT NULL),
e AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', '{label}', '\\b(?:{ways})\\b')" for n, (label, ways) in answers.ENTITIES.items()) + """) AS t(entity, label, p)),
a AS (SELECT entity, label, regexp_split_to_array(c, p) AS around FROM c, e WHERE regexp_matches(c, p)),
m AS (SELECT *, unnest(range(1, len(around))) AS k FROM a),
t AS (SELECT entity, label, array_to_string(around[1:k], ' | ') AS before, array_to_string(around[k + 1:], ' | ') AS after FROM m),
s AS (SELECT entity, label, """ + ", ".join(f"regexp_matches(before, '\\b(?:{w})\\b')" + (f" OR regexp_matches(after, '\\b(?:{answers.BACKWARD[n]})\\b')" if n in answers.BACKWARD else "") + f" AS {n}" for n, w in answers.CONTEXTS.items()) + """ FROM t)
SELECT entity, label, family, severe, current, historical, negated, count(*) AS n FROM s GROUP BY ALL
""")
def entity_context(spark: SparkSession, d: str) -> DataFrame:
    """Entities of notes with their context."""
    e = answers.entities(table(spark, d, "documents"), "doc_id", "text")
    return e.groupBy("entity", "label", *answers.CONTEXTS).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH e AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS mean FROM e GROUP BY 1, 2), l AS (SELECT label, sqrt(sum(mean * mean)) AS len FROM m GROUP BY 1)
SELECT label, i, round(mean, 6) AS mean, round(mean / len, 6) AS unit FROM m JOIN l USING (label)
""")
def embedding_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean embedding of each label, and at length one."""
    return answers.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("label", "i", r6("mean").alias("mean"), r6("unit").alias("unit"))


_HASH = "((({key} % 1000003) + {seed}) * 2654435761) % 4294967296"


def _h(key: str, seed: int = 0) -> str:
    return _HASH.format(key=key, seed=seed)


@query(f"""
WITH r AS (SELECT pair_id, label_lipid_disorder AS label, row_number() OVER (PARTITION BY label_lipid_disorder ORDER BY {_h('pair_id')}, pair_id) AS k, count(*) OVER (PARTITION BY label_lipid_disorder) AS n FROM test)
SELECT pair_id, label, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r
""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of each label as test."""
    t = table(spark, d, "test").select("pair_id", F.col("label_lipid_disorder").alias("label"))
    return sampling.stratified_split(t, "label", "pair_id", 0.2)


@query(f"SELECT pair_id, ((row_number() OVER (ORDER BY {_h('pair_id', 7)}, pair_id) - 1) % 5)::INT AS fold FROM test")
def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    """Five folds."""
    return sampling.folds(table(spark, d, "test").select("pair_id"), "pair_id", 5, seed=7)


@query(f"SELECT pair_id, ((row_number() OVER (PARTITION BY label_lipid_disorder ORDER BY {_h('pair_id', 7)}, pair_id) - 1) % 5)::INT AS fold FROM test")
def oof_folds(spark: SparkSession, d: str) -> DataFrame:
    """Five folds alike in labels."""
    return sampling.folds(table(spark, d, "test").select("pair_id", "label_lipid_disorder"), "pair_id", 5, "label_lipid_disorder", 7).drop("label_lipid_disorder")


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY label_lipid_disorder ORDER BY {_h('pair_id', 3)}, pair_id) AS k FROM test WHERE label_lipid_disorder IN (0, 1)),
c AS (SELECT *, row_number() OVER (ORDER BY label_lipid_disorder, k) AS n FROM r WHERE k <= 3)
SELECT string_agg('Case ' || n || ':' || chr(10) || coalesce(narrative_current, '') || chr(10) || 'Outcome: ' || CASE label_lipid_disorder WHEN 1 THEN 'Yes' ELSE 'No' END || chr(10), chr(10) ORDER BY n) AS block FROM c
""")
def exemplar_block(spark: SparkSession, d: str) -> DataFrame:
    """Three cases of either outcome as a block of text (a sampling operator)."""
    chosen = sampling.exemplars(table(spark, d, "test"), "label_lipid_disorder", "pair_id", 3, 3, seed=3)
    rows = chosen.select(F.col("label_lipid_disorder").alias("l"), "rank", "narrative_current", F.col("label_lipid_disorder").alias("y"))
    return answers.case_blocks(rows, ["l", "rank"], "narrative_current", "y")


@query("""
WITH n AS (SELECT label_lipid_disorder AS label, count(*) AS n FROM test GROUP BY 1)
SELECT label, max(n) OVER () AS rows FROM n
""")
def oversample(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each label after the rarer one is repeated."""
    t = table(spark, d, "test").select("pair_id", F.col("label_lipid_disorder").alias("label"))
    return sampling.oversampled(t, "label", "pair_id").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("""
WITH v AS (SELECT itemid, valuenum AS v FROM labevents WHERE valuenum <> 0 AND NOT isnan(valuenum)),
q AS (SELECT itemid, list_filter(list_distinct(quantile_cont(v, [0.25, 0.5, 0.75])), lambda e: e < max(v)) AS e FROM v GROUP BY 1)
SELECT itemid, itemid || '_' || len(list_filter(e, lambda x: v > x)) AS token, count(*) AS n FROM v JOIN q USING (itemid) GROUP BY 1, 2
""".replace("lambda e: e < max(v)) AS e FROM v GROUP BY 1)", "lambda e: e < top) AS e FROM (SELECT itemid, quantile_cont(v, [0.25, 0.5, 0.75]) AS qs, max(v) AS top FROM v GROUP BY 1))").replace("list_distinct(quantile_cont(v, [0.25, 0.5, 0.75]))", "list_distinct(qs)"))
def quartile_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Values as tokens of their item's quartiles."""
    return mlfeed.quartile_tokens(table(spark, d, "labevents").select("itemid", "valuenum"), "itemid", "valuenum").groupBy("itemid", "token").agg(F.count(F.lit(1)).alias("n"))


def _visit_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test").where("subject_id is not null").select(
        "subject_id", "admittime_current", "pair_id", split_codes(F.col("diagnoses_codes_current")).alias("codes")
    )


@query("""
WITH v AS (SELECT subject_id, admittime_current AS t, pair_id, list_filter(list_transform(string_split(coalesce(diagnoses_codes_current, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS c FROM test WHERE subject_id IS NOT NULL)
SELECT subject_id, 'CLS ' || string_agg(CASE WHEN len(c) > 0 THEN array_to_string(c, ' ') || ' SEP' ELSE 'SEP' END, ' ' ORDER BY t, pair_id) AS tokens, sum(len(c) + 1)::BIGINT + 1 AS size, count(*) AS visits FROM v GROUP BY 1
""")
def token_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Codes of a patient's visits as a sequence of tokens."""
    s = mlfeed.token_sequences(_visit_codes(spark, d), "subject_id", ["admittime_current", "pair_id"], "codes")
    return s.select("subject_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("size"), F.size(F.filter("tokens", lambda t: t == "SEP")).alias("visits"))


_TOKENS = "t AS (SELECT DISTINCT pair_id, unnest(regexp_split_to_array(lower(replace(coalesce(medications_current, ''), ';', ' ')), '\\s+')) AS token FROM test), u AS (SELECT * FROM t WHERE token <> '')"


@query(f"WITH {_TOKENS}, v AS (SELECT token, count(*) AS df FROM u GROUP BY 1) SELECT token, df, row_number() OVER (ORDER BY token) - 1 AS index FROM v")
def bag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Words of the lists with their index."""
    return mlfeed.vocabulary(mlfeed.code_tokens(table(spark, d, "test"), "pair_id", ["medications_current"]))


@query(f"""
WITH {_TOKENS},
r AS (SELECT pair_id, row_number() OVER (PARTITION BY label_lipid_disorder ORDER BY {_h('pair_id')}, pair_id) AS k, count(*) OVER (PARTITION BY label_lipid_disorder) AS n FROM test),
v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS index FROM (SELECT DISTINCT token FROM u JOIN r USING (pair_id) WHERE k > ceil(n * 0.2)))
SELECT pair_id, string_agg(index, ' ' ORDER BY index) AS indices FROM u JOIN v USING (token) GROUP BY 1
""")
def bag_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as indices of a vocabulary fitted on the training part."""
    tokens = mlfeed.code_tokens(table(spark, d, "test"), "pair_id", ["medications_current"])
    train = sampling.stratified_split(table(spark, d, "test").select("pair_id", "label_lipid_disorder"), "label_lipid_disorder", "pair_id").where("split = 'train'")
    rows = mlfeed.sparse_rows(tokens, mlfeed.vocabulary(tokens.join(train, "pair_id", "left_semi")), "pair_id")
    return rows.select("pair_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), " ").alias("indices"))


@query(f"""
WITH w AS (SELECT pair_id, unnest(regexp_extract_all(lower(narrative_current), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) AS token FROM test WHERE narrative_current IS NOT NULL),
tf AS (SELECT pair_id, token, count(*) AS tf FROM w WHERE token NOT IN ({', '.join(f"'{x}'" for x in mlfeed.english_stop_words() if "'" not in x)}) GROUP BY 1, 2),
v AS (SELECT token, count(*) AS df FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, token LIMIT 5000),
x AS (SELECT pair_id, token, tf * (ln((1 + (SELECT count(*) FROM test)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN v USING (token))
SELECT pair_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY pair_id)), 6) AS weight FROM x
""")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weighted words of the narratives."""
    return mlfeed.tfidf(table(spark, d, "test"), "pair_id", "narrative_current").select("pair_id", "token", r6("weight").alias("weight"))


@query(f"""
WITH {_P}, c AS (SELECT 'by_mode' AS kind, prompt_mode AS name, NULL AS model, {_COUNTS} FROM p WHERE pred IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'by_model', NULL, model_name, {_COUNTS} FROM p WHERE pred IS NOT NULL GROUP BY 3)
SELECT kind, name, model, tp, fp, tn, fn, {_SCORES} FROM c
""")
def results_summary(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by mode and by model, stacked; columns that one lacks are null."""
    p = predictions(spark, d)
    a = metrics.confusion_metrics(p, "y", "pred", ["prompt_mode"]).withColumnRenamed("prompt_mode", "name").withColumn("kind", F.lit("by_mode"))
    b = metrics.confusion_metrics(p, "y", "pred", ["model_name"]).withColumnRenamed("model_name", "model").withColumn("kind", F.lit("by_model"))
    return _rounded(a.unionByName(b, allowMissingColumns=True), ["kind", "name", "model"])


@query()
def ml_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of four models on bags of words; MLlib's own optimisers, so there is no SQL."""
    from pyspark.ml.feature import CountVectorizer

    t = table(spark, d, "test").where("label_lipid_disorder is not null").select(
        "pair_id", F.col("label_lipid_disorder").cast("double").alias("label"), F.split(F.lower(F.regexp_replace(F.coalesce("medications_current", F.lit("")), ";", " ")), r"\s+").alias("words")
    )
    split = sampling.stratified_split(t, "label", "pair_id", 0.25)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    bag = CountVectorizer(inputCol="words", outputCol="features", binary=True, vocabSize=2**31 - 1).fit(train)
    got = mlfeed.baselines(bag.transform(train).select("features", "label"), bag.transform(test).select("features", "label"), "features", "label")
    return _rounded(metrics.confusion_metrics(got, "y", "pred", ["model"]), ["model"])
