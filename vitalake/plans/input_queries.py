"""Queries on model inputs, prompts, requests and reports on answers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.functions.text import age_bin, exact_round, log2_odds, sigmoid, split_codes
from vitalake.operators import answers, cases, features, inputs, metrics, mlfeed, prompting, sampling, timeseries, visits
from vitalake.plans.cohort_queries import _LABS, _MED_CELLS, _events, _lab_cells, _med_grid, r6
from vitalake.plans.evaluation_queries import _COUNTS, _P, _PARSED, _SCORES, _h, _parsed, _rounded, predictions
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


def _pair_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test").select("pair_id", F.explode(split_codes(F.col("diagnoses_codes_current"))).alias("token"))


_PAIR_CODES = "c AS (SELECT pair_id, trim(unnest(string_split(coalesce(diagnoses_codes_current, ''), ';'))) AS token FROM test), k AS (SELECT * FROM c WHERE token <> '')"


@query(f"""
WITH {_PAIR_CODES}, v AS (SELECT token, row_number() OVER (ORDER BY token) + 2 AS index FROM (SELECT DISTINCT token FROM k))
SELECT * FROM v UNION ALL SELECT * FROM (VALUES ('PAD', 0), ('CLS', 1), ('SEP', 2)) AS t(token, index) UNION ALL SELECT 'UNK', max(index) + 1 FROM v
""")
def special_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Codes with their ids, special tokens first and last."""
    return inputs.special_vocabulary(_pair_codes(spark, d))


@query(f"""
WITH {_PAIR_CODES}, v AS (SELECT token, row_number() OVER (ORDER BY token) + 2 AS index FROM (SELECT DISTINCT token FROM k WHERE pair_id % 2 = 0)), u AS (SELECT max(index) + 1 AS unk FROM v)
SELECT pair_id, string_agg(coalesce(index, unk), ' ' ORDER BY coalesce(index, unk)) AS ids FROM k LEFT JOIN v USING (token), u GROUP BY 1
""")
def token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Codes as ids of a vocabulary fitted on a half of the pairs; unknown ones as UNK."""
    tokens = _pair_codes(spark, d)
    made = inputs.with_ids(tokens, inputs.special_vocabulary(tokens.where("pair_id % 2 = 0")))
    return made.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("ids"))


_HOURLY = """
e AS (SELECT hadm_id, floor((epoch_us(charttime) - epoch_us(a)) / 21600000000)::BIGINT AS h, itemid || CASE WHEN valuenum > 50 THEN '_1' ELSE '_0' END AS t
      FROM labevents JOIN (SELECT hadm_id, min(admittime) AS a FROM admissions WHERE hadm_id IS NOT NULL GROUP BY 1) USING (hadm_id) WHERE valuenum IS NOT NULL),
c AS (SELECT DISTINCT hadm_id_current AS hadm_id, trim(unnest(string_split(coalesce(diagnoses_codes_current, ''), ';'))) AS c FROM test WHERE hadm_id_current IS NOT NULL)
"""


@query(f"""
WITH {_HOURLY}, cc AS (SELECT hadm_id, string_agg(c, ' ' ORDER BY c) AS s, count(*) AS n FROM c WHERE c <> '' GROUP BY 1),
d AS (SELECT DISTINCT * FROM e), hh AS (SELECT hadm_id, h, string_agg(t, ' ' ORDER BY t) || ' SEP' AS s, count(*) + 1 AS n FROM d GROUP BY 1, 2),
g AS (SELECT hadm_id, string_agg(s, ' ' ORDER BY h) AS s, sum(n) AS n FROM hh GROUP BY 1)
SELECT hadm_id, 'CLS ' || coalesce(cc.s || ' ', '') || 'SEP ' || g.s AS tokens FROM g LEFT JOIN cc USING (hadm_id) WHERE g.n + coalesce(cc.n, 0) + 2 < 64
""")
def event_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Visits as sequences of conditions and of measurements by quarter of a day, where shorter than 64 tokens."""
    first = table(spark, d, "admissions").where("hadm_id is not null").groupBy("hadm_id").agg(F.min("admittime").alias("a"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ev = table(spark, d, "labevents").where("valuenum is not null").join(first, "hadm_id").select(
        "hadm_id", F.floor((micros("charttime") - micros("a")) / 21_600_000_000).alias("h"), F.concat(F.col("itemid").cast("string"), F.when(F.col("valuenum") > 50, "_1").otherwise("_0")).alias("t")
    )
    cond = table(spark, d, "test").where("hadm_id_current is not null").select(F.col("hadm_id_current").alias("hadm_id"), F.explode(split_codes(F.col("diagnoses_codes_current"))).alias("c"))
    return inputs.event_sequences(cond, ev, "hadm_id", "c", "h", "t", 64).select("hadm_id", F.array_join("tokens", " ").alias("tokens"))


@query("""
WITH v AS (SELECT subject_id, admittime_current AS t, pair_id, list_filter(list_transform(string_split(coalesce(diagnoses_codes_current, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS c FROM test WHERE subject_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t, pair_id) - 1 AS n FROM v),
a AS (SELECT subject_id, sum(len(c) + 1)::BIGINT + 1 AS size, count(*) AS visits, '0 ' || string_agg(repeat(n || ' ', len(c) + 1), '' ORDER BY n) AS p, '0 ' || string_agg(repeat((n % 2) || ' ', len(c) + 1), '' ORDER BY n) AS s FROM o GROUP BY 1)
SELECT subject_id, p || repeat(visits || ' ', greatest(0, 64 - size)::INT) AS positions, s || repeat((visits % 2) || ' ', greatest(0, 64 - size)::INT) AS segments, repeat('1', size::INT) || repeat('0', greatest(0, 64 - size)::INT) AS mask FROM a WHERE size < 512
""")
def sequence_items(spark: SparkSession, d: str) -> DataFrame:
    """Padded token sequences with positions, segments and mask."""
    v = table(spark, d, "test").where("subject_id is not null").select("subject_id", "admittime_current", "pair_id", split_codes(F.col("diagnoses_codes_current")).alias("codes"))
    s = mlfeed.token_sequences(v, "subject_id", ["admittime_current", "pair_id"], "codes").select("subject_id", "tokens")
    item = inputs.sequence_item(s, "tokens", 64, ["subject_id"])
    text = lambda c, sep: F.array_join(F.transform(c, lambda x: F.concat(x.cast("string"), F.lit(sep))), "")
    return item.select("subject_id", text("positions", " ").alias("positions"), text("segments", " ").alias("segments"), text("mask", "").alias("mask"))


_KINDS = ("272", "428", "250", "401")


@query("SELECT subject_id, " + ", ".join(f"max(CASE WHEN list_contains(list_transform(string_split(coalesce(diagnoses_codes_current, ''), ';'), lambda x: left(trim(x), 1)), '{i}') THEN 1 ELSE 0 END) AS \"{i}\"" for i in "12345") + " FROM test GROUP BY 1")
def multi_hot_codes(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of a subject's codes, by their first digit, as columns."""
    t = table(spark, d, "test").select("subject_id", F.transform(split_codes(F.col("diagnoses_codes_current")), lambda c: F.left(c, F.lit(1))).alias("first"))
    return inputs.multi_hot(t, "subject_id", "first", list("12345"))


@query("WITH c AS (SELECT pair_id, left(trim(unnest(string_split(coalesce(diagnoses_codes_current, ''), ';'))), 1) AS f FROM test), h AS (SELECT DISTINCT pair_id, f FROM c WHERE f IN ('6', '7', '8', '9')) SELECT test.pair_id, "
       + ", ".join(f"count(CASE WHEN f = '{i}' THEN 1 END)::INT AS c_{i}" for i in "6789") + ", coalesce(string_agg(f, ' ' ORDER BY f), '<PAD>') AS codes FROM test LEFT JOIN h USING (pair_id) GROUP BY 1")
def static_one_hot(spark: SparkSession, d: str) -> DataFrame:
    """Chosen chapters of each pair as columns; pairs with none are all zero and padded."""
    ev = table(spark, d, "test").select("pair_id", F.explode(split_codes(F.col("diagnoses_codes_current"))).alias("c")).withColumn("f", F.left("c", F.lit(1)))
    return inputs.static_one_hot(table(spark, d, "test"), ev, "pair_id", "f", list("6789")).withColumn("codes", F.array_join("codes", " "))


def _drug_ids(spark: SparkSession, d: str) -> list[int]:
    return sorted(r[0] for r in table(spark, d, "d_items").where("category = 'drug'").select("itemid").collect())  # fixed table


@query(f"""
WITH {_MED_CELLS}, i AS (SELECT itemid, row_number() OVER (ORDER BY itemid) AS n FROM d_items WHERE category = 'drug'),
w AS (SELECT stay_id, bucket, n, max(signal) AS signal, max(value) AS value FROM x JOIN i USING (itemid) GROUP BY 1, 2, 3)
SELECT stay_id, bucket, string_agg(n, ' ' ORDER BY n) FILTER (WHERE signal = 1) AS ids, round(sum(value) + 1e-7, 4) AS total FROM w GROUP BY 1, 2
""")
def code_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Drugs of a stay by bucket as arrays over all drugs: numbers of those under way, and doses."""
    m = inputs.code_matrix(_med_grid(spark, d), "stay_id", "itemid", "bucket", "signal", "value", _drug_ids(spark, d))
    ids = F.filter("ids", lambda x: x > 0)
    return m.select(
        "stay_id", "bucket", F.when(F.size(ids) > 0, F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")).alias("ids"),
        F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x) + 1e-7, 4).alias("total"),
    )


_CODED = """
tr AS (SELECT * FROM visits_iv WHERE stay_id % 3 <> 0),
r AS (SELECT race, row_number() OVER (ORDER BY race) - 1 AS code FROM (SELECT DISTINCT race FROM tr WHERE race IS NOT NULL))
"""


@query(f"WITH {_CODED} SELECT stay_id, coalesce(code, -1)::INT AS race_code, CASE WHEN code IS NOT NULL THEN v.race END AS race FROM visits_iv v LEFT JOIN r USING (race)")
def coded_and_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Categories as codes fitted on a part of the rows, and told from the codes again."""
    v = table(spark, d, "visits_iv").select("stay_id", "race")
    known = inputs.fitted_codes(v.where("stay_id % 3 <> 0"), ["race"])
    return inputs.decoded(inputs.coded(v, known, ["race"]).drop("race"), known, ["race"]).select("stay_id", "race_code", "race")


@query("SELECT race, row_number() OVER (ORDER BY race) AS index FROM (SELECT DISTINCT race FROM visits_iv WHERE race IS NOT NULL)")
def one_based_codes(spark: SparkSession, d: str) -> DataFrame:
    """Categories from 1, as 0 is for padding."""
    return inputs.one_based(table(spark, d, "visits_iv"), "race")


@query(f"""
WITH {_P} SELECT response_id, CASE WHEN response_id % 2 = 0 THEN 'fused' ELSE 'llm_only' END AS regime, CASE WHEN response_id % 2 = 0 THEN 4 ELSE 2 END AS size,
  round(CASE WHEN response_id % 2 = 0 THEN y + coalesce(pred, 0) ELSE 0 END + coalesce(score, 0) + CASE WHEN score IS NULL THEN 1 ELSE 0 END, 6) AS total FROM p
""")
def feature_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of features put side by side by regime."""
    p = predictions(spark, d).select(
        "response_id", F.array(F.col("y"), F.coalesce("pred", F.lit(0))).alias("s"), F.array(F.coalesce("score", F.lit(0.0)), F.col("score").isNull().cast("double")).alias("l")
    )
    parts = [inputs.regime(p.where(f"response_id % 2 = {i}"), n, "s", "l").withColumn("regime", F.lit(n)) for i, n in enumerate(("fused", "llm_only"))]
    return parts[0].unionByName(parts[1]).select(
        "response_id", "regime", F.size("features").alias("size"), r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x)).alias("total")
    )


@query("SELECT pair_id, round(count(*) OVER () / ((SELECT count(DISTINCT coalesce(label_lipid_disorder, -1)) FROM test) * count(*) OVER (PARTITION BY label_lipid_disorder))::DOUBLE, 6) AS weight FROM test")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights that make labels count alike."""
    t = table(spark, d, "test").select("pair_id", F.col("label_lipid_disorder").alias("label"))
    return inputs.balanced_weights(t, "label").select("pair_id", r6("weight").alias("weight"))


@query("SELECT position, i, round(CASE WHEN i % 2 = 0 THEN sin(a) ELSE cos(a) END, 6) AS value FROM (SELECT p AS position, i, p * exp((i // 2) * (-2 * ln(10000.0::DOUBLE) / 16)) AS a FROM range(50) AS x(p), range(16) AS z(i))")
def position_table(spark: SparkSession, d: str) -> DataFrame:
    """Sinusoidal positions."""
    return inputs.sinusoids(spark, 50, 16).select("position", "i", r6("value").alias("value"))


@query("""
WITH e AS (SELECT vec_id, embedding AS v, len(embedding) AS m, unnest(range(24)) AS i FROM embeddings)
SELECT vec_id, i, round(v[a + 1]::DOUBLE + (p - a) * (v[least(a + 1, m - 1) + 1]::DOUBLE - v[a + 1]::DOUBLE), 5) AS x FROM (SELECT *, i * (m - 1) / 23.0::DOUBLE AS p, floor(i * (m - 1) / 23.0::DOUBLE)::INT AS a FROM e)
""")
def signal_resampled(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as signals at 24 points."""
    e = table(spark, d, "embeddings").select("vec_id", inputs.resampled(F.col("embedding").cast("array<double>"), 24).alias("s"))
    return e.select("vec_id", F.posexplode("s").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


@query("""
WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, embedding[i + 1]::DOUBLE AS a, embedding[len(embedding) - i]::DOUBLE AS b FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)),
x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS a, embedding[len(embedding) - i]::DOUBLE AS b FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)),
m AS (SELECT vec_id, i, CASE WHEN vec_id % 3 = 0 THEN a ELSE (a + b) / 2 END AS v FROM x)
SELECT vec_id, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 5) AS x FROM m
""".replace("""WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, embedding[i + 1]::DOUBLE AS a, embedding[len(embedding) - i]::DOUBLE AS b FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)),
x AS""", "WITH x AS"))
def masked_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the vectors of a text that a mask keeps, at length one; here each vector and its mirror image."""
    v = F.col("embedding").cast("array<double>")
    mask = F.array(F.lit(1), F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1))
    e = table(spark, d, "embeddings").select("vec_id", inputs.unit_length(inputs.masked_mean(F.array(v, F.reverse(v)), mask, 64)).alias("s"))
    return e.select("vec_id", F.posexplode("s").alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


@query()
def feature_importances(spark: SparkSession, d: str) -> DataFrame:
    """What a forest and a weighted regression say of a few features; MLlib's own optimisers, so there is no SQL."""
    from pyspark.ml.feature import VectorAssembler

    names = ["n_diagnoses", "n_drugs", "n_procedures", "signs"]
    t = table(spark, d, "test").where("label_lipid_disorder is not null").select(
        F.col("label_lipid_disorder").cast("double").alias("label"),
        *[F.size(split_codes(F.col(c))).cast("double").alias(n) for n, c in zip(names, ("diagnoses_codes_current", "medications_current", "procedures_codes_current"), strict=False)],
        F.coalesce(F.length("narrative_current"), F.lit(0)).cast("double").alias("signs"),
    )
    return mlfeed.importances(VectorAssembler(inputCols=names, outputCol="features").transform(t).select("features", "label"), "features", "label", names)


@query("""
WITH e AS (SELECT o_custkey, o_orderdate::DATE AS day, list_sort(list_distinct(flatten(list(c)))) AS codes FROM (
  SELECT o_custkey, o_orderdate, coalesce((SELECT list(DISTINCT p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey), []) AS c FROM orders) GROUP BY 1, 2),
w AS (SELECT *, coalesce(date_diff('day', day, lead(day) OVER (PARTITION BY o_custkey ORDER BY day)), 0) AS delta FROM e)
SELECT o_custkey, string_agg(delta || ':' || array_to_string(codes, ','), ' ' ORDER BY day DESC) AS sequence FROM w GROUP BY 1
""")
def reversed_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Each patient's visits from the last on, with the days to the visit after."""
    brands = _events(spark, d).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("codes"))
    v = table(spark, d, "orders").join(brands, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    s = visits.visit_sequences(v, "o_custkey", "o_orderdate", "codes", reverse=True)
    text = F.transform("sequence", lambda x: F.concat(x["delta_days"].cast("string"), F.lit(":"), F.array_join(x["codes"], ",")))
    return s.select("o_custkey", F.array_join(text, " ").alias("sequence"))


@query(f"""
WITH {_LABS}, q AS (SELECT hadm_id, itemid, bucket, CASE WHEN itemid % 2 = 0 THEN value END AS value FROM c), g AS (SELECT hadm_id, itemid, unnest(range(8)) AS bucket FROM (SELECT DISTINCT hadm_id, itemid FROM q))
SELECT hadm_id, itemid, bucket, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS signal,
  round(coalesce(last_value(value IGNORE NULLS) OVER w, first_value(value IGNORE NULLS) OVER b, avg(value) OVER (PARTITION BY hadm_id, itemid), 0), 6) AS value
FROM g LEFT JOIN q USING (hadm_id, itemid, bucket)
WINDOW w AS (PARTITION BY hadm_id, itemid ORDER BY bucket ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY hadm_id, itemid ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""")
def lab_impute_mean(spark: SparkSession, d: str) -> DataFrame:
    """Measurements filled by neighbours, then the mean, then 0; every second item has no values here."""
    cells = _lab_cells(spark, d).withColumn("value", F.when(F.col("itemid") % 2 == 0, F.col("value")))
    return timeseries.lab_grid(cells, ["hadm_id", "itemid"], 8, middle="mean").select("hadm_id", "itemid", "bucket", "signal", r6("value").alias("value"))


@query("""
WITH t AS (SELECT itemid, row_number() OVER (ORDER BY s DESC, itemid) AS k FROM (SELECT itemid, count(DISTINCT subject_id) AS s FROM labevents WHERE itemid IS NOT NULL GROUP BY 1) QUALIFY k <= 3)
SELECT subject_id, count(DISTINCT CASE WHEN k = 1 THEN 1 END)::INT AS a, count(DISTINCT CASE WHEN k = 2 THEN 1 END)::INT AS b, count(DISTINCT CASE WHEN k = 3 THEN 1 END)::INT AS c FROM labevents JOIN t USING (itemid) GROUP BY 1
""")
def pivoted_top(spark: SparkSession, d: str) -> DataFrame:
    """The three items that most patients have, as columns (a top-k report)."""
    wide = features.pivoted_top(table(spark, d, "labevents"), "subject_id", "itemid", "subject_id", 3)
    return wide.toDF("subject_id", *"abc"[: len(wide.columns) - 1])


@query(f"SELECT pair_id FROM test ORDER BY {_h('pair_id', 4)}, pair_id LIMIT 50")
def sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fifty pairs by hash (a sampling operator)."""
    return sampling.sampled(table(spark, d, "test").select("pair_id"), "pair_id", 50, 4)


@query(f"""
WITH n AS (SELECT greatest(1, round_even(12 * avg(CASE WHEN label_lipid_disorder = 1 THEN 1.0 ELSE 0.0 END), 0))::INT AS p FROM test),
r AS (SELECT pair_id, label_lipid_disorder AS l, row_number() OVER (PARTITION BY label_lipid_disorder ORDER BY {_h('pair_id', 6)}, pair_id) AS k FROM test WHERE label_lipid_disorder IN (0, 1))
SELECT pair_id FROM r, n WHERE k <= CASE WHEN l = 1 THEN p ELSE 12 - p END
""")
def matched_exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Twelve cases in the labels' proportion (a sampling operator)."""
    return sampling.exemplars(table(spark, d, "test"), "label_lipid_disorder", "pair_id", 6, 6, seed=6, strategy="prevalence_matched").select("pair_id")


@query(f"SELECT pair_id, ((r - 1) % 7)::INT AS fold FROM (SELECT pair_id, row_number() OVER (ORDER BY {_h('pair_id', 8)}, pair_id) AS r, count(*) OVER () AS n FROM test) WHERE r <= n // 7 * 7")
def equal_folds(spark: SparkSession, d: str) -> DataFrame:
    """Seven folds of one size; the remainder is left out, as the operator is defined."""
    return sampling.folds(table(spark, d, "test").select("pair_id"), "pair_id", 7, seed=8, equal=True)


@query(f"""
WITH w AS (SELECT pair_id, row_number() OVER (ORDER BY {_h('pair_id', 2)}, pair_id) - 1 AS r, count(*) OVER () AS n FROM test WHERE label_lipid_disorder = 1),
s AS (SELECT unnest(range(400)) AS i)
SELECT i // 40 AS round, i % 40 AS place, pair_id FROM s JOIN w ON r = i % n
""")
def critic_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Ten batches of forty rows by turns, from the begin again at the end."""
    wrong = table(spark, d, "test").where("label_lipid_disorder = 1").select("pair_id")
    return prompting.critic_rounds(wrong, "pair_id", 40, 10, 2).select("round", "place", "pair_id")


@query(f"""
WITH {_PARSED}, w AS (SELECT response_id, regexp_replace(t, '\\s+', ' ', 'g') AS t FROM parsed WHERE prediction = 'unparseable')
SELECT response_id, CASE WHEN t = '' THEN NULL ELSE '[Predictor Reasoning] ' || left(t || t, 500) END AS line FROM w
""")
def critic_reasoning(spark: SparkSession, d: str) -> DataFrame:
    """Reasoning as a critic sees it, cut at 500 signs."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")
    p = _parsed(spark, d).where("prediction = 'unparseable'").select("response_id", t.alias("t"))
    block = answers.critic_block(F.lit(1), F.lit("x"), F.lit(1), F.lit("No"), F.concat("t", "t"))
    line = F.regexp_extract(block, r"(?s)(\[Predictor Reasoning\] .*)$", 1)
    return p.select("response_id", F.when(line != "", line).alias("line"))


_TEMPLATE = """{# asks for one line #}{% block system %}
You read visits. {{ unknown }}
{% endblock %}{% block user %}
Record {{ pair_id }}:
{{ narrative }}
{% endblock %}"""


@query("SELECT pair_id, regexp_replace('SYSTEM:' || chr(10) || 'You read visits.' || chr(10) || chr(10) || 'USER:' || chr(10) || 'Record ' || pair_id || ':' || chr(10) || regexp_replace(coalesce(narrative_current, ''), '\\s+', ' ', 'g'), '\\s+$', '') AS prompt FROM test")
def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A template's blocks rendered row by row, as one text."""
    text = F.regexp_replace(F.coalesce("narrative_current", F.lit("")), r"\s+", " ")
    chat = prompting.messages(_TEMPLATE, {"pair_id": F.col("pair_id"), "narrative": text})
    return table(spark, d, "test").select("pair_id", prompting.flat_prompt(chat).alias("prompt"))


@query("""
SELECT pair_id, 'Task: Say whether a code follows.' || chr(10) || chr(10) || 'Patient record:' || chr(10) || coalesce(narrative_current, '') || chr(10) || chr(10) || 'Prediction:' || chr(10) AS ask,
  CASE WHEN label_lipid_disorder = 1 THEN 'Yes' ELSE 'No' END AS answer FROM test
""")
def instructions(spark: SparkSession, d: str) -> DataFrame:
    """Instruction texts for fitting and for evaluation."""
    t = table(spark, d, "test")
    task = "Say whether a code follows."
    ask, full = prompting.instruction(task, F.col("narrative_current")), prompting.instruction(task, F.col("narrative_current"), F.col("label_lipid_disorder"))
    return t.select("pair_id", ask.alias("ask"), F.substr(full, F.length(ask) + 1).alias("answer"))


@query("""
SELECT response_id, sha256('{"messages": [{"content": "' || coalesce(prompt_mode, '') || '", "role": "user"}], "model": "' || coalesce(model_name, '') || '", "seed": 42, "temperature": 0.0}') AS key FROM raw_llm_responses
""")
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a cache from requests as sorted JSON."""
    raw = table(spark, d, "raw_llm_responses")
    chat = F.array(F.struct(F.lit("user").alias("role"), F.coalesce("prompt_mode", F.lit("")).alias("content")))
    return raw.select("response_id", prompting.canonical_key(chat, F.coalesce("model_name", F.lit("")), F.lit(0.0), F.lit(42)).alias("key"))


@query("""
WITH k AS (SELECT DISTINCT sha256(coalesce(model_name, '') || chr(31) || coalesce(prompt_mode, '') || chr(31) || coalesce(prompt, '')) AS key FROM raw_llm_responses),
c AS (SELECT sha256(coalesce(model_name, '') || chr(31) || coalesce(prompt_mode, '') || chr(31) || coalesce(prompt, '')) AS key FROM raw_llm_responses WHERE response_id % 4 = 0)
SELECT key FROM k WHERE key NOT IN (SELECT key FROM c)
""")
def requests_to_send(spark: SparkSession, d: str) -> DataFrame:
    """Requests that a cache, here of every fourth answer, lacks; each once."""
    raw = table(spark, d, "raw_llm_responses").select("response_id", answers.request_key(F.col("model_name"), F.col("prompt_mode"), F.col("prompt")).alias("key"))
    return prompting.uncached(raw.select("key"), raw.where("response_id % 4 = 0").select("key"), "key")


def _fake(prompts: list[str]) -> list[str]:
    if any(p.startswith("7") for p in prompts) and len(prompts) > 1:
        raise RuntimeError("no batches with a seven")
    return ["" if p.startswith("7") else f"Prediction: {'Yes' if len(p) % 2 else 'No'}" for p in prompts]


@query("SELECT pair_id, CASE WHEN starts_with(pair_id::VARCHAR, '7') THEN 'unparseable' WHEN length(pair_id::VARCHAR) % 2 = 1 THEN 'Yes' ELSE 'No' END AS prediction FROM test")
def completed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prompts given to a stand-in for a model, and its answers parsed; what fails is an empty text."""
    asked = table(spark, d, "test").select("pair_id", F.col("pair_id").cast("string").alias("prompt"))
    return answers.parse_answers(prompting.completed(asked, "prompt", _fake), "text").select("pair_id", "prediction")


@query(f"""
WITH {_PARSED} SELECT response_id, CASE WHEN response_id % 5 = 0 THEN 1 WHEN prediction = 'Yes' THEN 1 WHEN prediction = 'No' THEN 0 WHEN response_id % 2 = 0 THEN 1 ELSE 0 END AS label,
  CASE WHEN response_id % 5 = 0 THEN 'first_token_yes' WHEN prediction <> 'unparseable' THEN parser_status ELSE 'logits_fallback' END AS source FROM parsed
""")
def hard_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by first token, parser or probability, whichever tells."""
    p = F.when(F.col("response_id") % 2 == 0, 0.6).otherwise(0.4)
    first = F.when(F.col("response_id") % 5 == 0, " Yes")
    h = prompting.hard_label(F.coalesce(first, F.lit("")), F.col("prediction"), F.col("parser_status"), p, 1 - p)
    return _parsed(spark, d).select("response_id", h["label"].alias("label"), h["source"].alias("source"))


@query("SELECT response_id, printf('%.2f', x)::DOUBLE AS two, printf('%.4f', x / 7)::DOUBLE AS four FROM (SELECT response_id, (response_id * 5 % 20000) / 1000.0::DOUBLE - 3 AS x FROM raw_llm_responses)")
def exact_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Numbers rounded by their exact binary value."""
    x = (F.col("response_id") * 5 % 20000) / F.lit(1000.0) - 3
    return table(spark, d, "raw_llm_responses").select("response_id", exact_round(x, 2).alias("two"), exact_round(x / 7, 4).alias("four"))


@query(f"""
WITH {_P} SELECT response_id, round(CASE WHEN score > 0 AND score < 1 THEN log2(score / (1 - score)) END, 6) AS log2_odds, round(1 / (1 + exp(-(score * 4 - 2) / 1.5)), 6) AS scaled FROM p
""")
def odds(spark: SparkSession, d: str) -> DataFrame:
    """Odds to base 2, and logits divided by a temperature."""
    return predictions(spark, d).select("response_id", r6(log2_odds(F.col("score"))).alias("log2_odds"), r6(sigmoid(F.col("score") * 4 - 2, 1.5)).alias("scaled"))


@query(f"""
WITH {_P}, g AS (SELECT 'age' AS sensitive_attribute, (least(120, greatest(0, response_id % 90)) // 10 * 10) || '-' || (least(120, greatest(0, response_id % 90)) // 10 * 10 + 10) AS "group", {_COUNTS} FROM p WHERE pred IS NOT NULL GROUP BY 2)
SELECT "group", tp, tn, fp, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy FROM g
""")
def fairness_by_age(spark: SparkSession, d: str) -> DataFrame:
    """Rates by bin of age; here the age is made from the id."""
    p = predictions(spark, d).withColumn("age", age_bin(F.col("response_id") % 90))
    return metrics.fairness(p, "y", "pred", ["age"]).select("group", "tp", "tn", "fp", "fn", r6("accuracy").alias("accuracy"))


@query(f"""
WITH {_P}, s AS (SELECT 'default' AS setting, 0.5 AS t UNION ALL SELECT 'tuned', 0.35), x AS (SELECT setting, y, CASE WHEN score >= t THEN 1 ELSE 0 END AS pred FROM p, s WHERE score IS NOT NULL),
c AS (SELECT setting, {_COUNTS} FROM x GROUP BY 1)
SELECT setting, tp, fp, tn, fn, {_SCORES}, round(100.0 * (tp + fp) / (tp + fp + tn + fn), 6) AS positive_rate FROM c
""")
def threshold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Metrics at 0.5 and at a tuned threshold, with the share predicted positive."""
    m = metrics.two_settings(predictions(spark, d), "y", "score", 0.35)
    return _rounded(m, ["setting"]).join(m.select("setting", r6("positive_rate").alias("positive_rate")), "setting")


@query(f"""
WITH {_P} SELECT tag, count(*) AS n, round(avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END), 6) AS right_share FROM (
  SELECT pred, y, unnest(list_filter([CASE WHEN score > 0.8 OR score < 0.2 THEN 'high_confidence' END, CASE WHEN score BETWEEN 0.4 AND 0.6 THEN 'borderline' END], lambda x: x IS NOT NULL)) AS tag FROM p WHERE pred IS NOT NULL) GROUP BY 1
""")
def confidence_report(spark: SparkSession, d: str) -> DataFrame:
    """How often answers of high and of borderline confidence are right."""
    p = predictions(spark, d).where("pred is not null").select("pred", "y", F.explode(metrics.confidence_tags(F.col("score"))).alias("tag"))
    return p.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("pred") == F.col("y")).cast("double"))).alias("right_share"))


@query(f"""
WITH {_P} SELECT CASE prompt_mode WHEN 'zero_shot' THEN 'Zero-Shot' WHEN 'zero_shot_plus' THEN 'Zero-Shot+' WHEN 'few_shot' THEN 'Few-Shot (N=6)' WHEN 'coagent' THEN 'Co-Agent' END AS mode, count(*) AS n
FROM p WHERE prompt_mode IN ('zero_shot', 'zero_shot_plus', 'few_shot', 'coagent') GROUP BY 1
""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the name of the mode in reports."""
    known = predictions(spark, d).where(F.col("prompt_mode").isin(*metrics.DISPLAY))
    return known.groupBy(metrics.displayed(F.col("prompt_mode")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_PARSED}, r AS (SELECT response_id, label_lipid_disorder AS y, pred_binary AS pred, probability AS score, lower(coalesce(medications_current, '')) LIKE '%statin%' AS statin,
    list_transform(list_filter(list_transform(string_split(coalesce(diagnoses_codes_current, ''), ';'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan'), lambda x: left(regexp_replace(x, '[^0-9]', '', 'g'), 5)) AS c
  FROM parsed JOIN test ON pair_id = sample_id WHERE label_lipid_disorder IS NOT NULL AND pred_binary IS NOT NULL),
f AS (SELECT *, len(list_filter(c, lambda x: regexp_matches(x, '^272'))) > 0 AS dys, len(list_filter(c, lambda x: regexp_matches(x, '^250'))) > 0 AS dia, len(list_filter(c, lambda x: regexp_matches(x, '^2780'))) > 0 AS obe, len(list_filter(c, lambda x: regexp_matches(x, '^40[1-5]'))) > 0 AS hyp FROM r)
SELECT response_id::VARCHAR AS case_id, CASE WHEN pred = 1 AND y = 1 THEN 'TP' WHEN pred = 0 AND y = 0 THEN 'TN' WHEN pred = 1 THEN 'FP' ELSE 'FN' END AS case_type,
  printf('%.4f', score)::DOUBLE AS probability, trim(CASE WHEN score > 0.8 OR score < 0.2 THEN 'high_confidence' WHEN score BETWEEN 0.4 AND 0.6 THEN 'borderline' ELSE '' END) AS tags,
  CASE WHEN pred = 1 AND y = 1 THEN CASE WHEN dys THEN 'TP_code' WHEN statin THEN 'TP_drug' WHEN dia OR dia::INT + obe::INT + dys::INT + hyp::INT >= 3 THEN 'TP_risk' ELSE 'TP' END WHEN pred = 0 AND y = 0 THEN 'TN'
    WHEN pred = 1 THEN CASE WHEN statin THEN 'FP_drug' ELSE 'FP' END ELSE CASE WHEN NOT dys AND NOT statin THEN 'FN_none' ELSE 'FN' END END AS explained FROM f
""")
def case_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of all answers with case, tags and kind of explanation."""
    t = table(spark, d, "test").where("label_lipid_disorder is not null").select(
        F.col("pair_id").alias("sample_id"), F.col("label_lipid_disorder").alias("y"), "diagnoses_codes_current", "medications_current", "narrative_current"
    )
    p = _parsed(spark, d).join(t, "sample_id").where("pred_binary is not null")
    r = cases.case_records(p, "response_id", "pred_binary", "y", "probability", "diagnoses_codes_current", "medications_current", "narrative_current")
    kinds = F.create_map(*[F.lit(x) for k, v in cases.EXPLANATIONS.items() for x in (v, k)])
    return r.select("case_id", "case_type", "probability", F.coalesce("tags", F.lit("")).alias("tags"), F.try_element_at(kinds, F.col("explanation")).alias("explained"))


@query("""
SELECT round(sum(CASE WHEN y = 1 THEN r END) / (sum(y) * sum(1 - y)) - (sum(y) + 1) / (2.0 * sum(1 - y)), 6) AS roc_auc
FROM (SELECT y, (rank() OVER (ORDER BY s) + rank() OVER (ORDER BY s) + count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM (SELECT label_lipid_disorder AS y, round((pair_id % 17) / 4.0::DOUBLE - (pair_id % 11) / 3.0::DOUBLE, 9) AS s FROM test WHERE label_lipid_disorder IS NOT NULL))
""")
def logit_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve from the logits of two answers."""
    t = table(spark, d, "test").where("label_lipid_disorder is not null").select(
        F.col("label_lipid_disorder").alias("y"), answers.two_way((F.col("pair_id") % 17) / 4.0, (F.col("pair_id") % 11) / 3.0)["prob_yes"].alias("score")
    )
    return metrics.rank_metrics(t.withColumn("score", F.round("score", 12)), "y", "score").select(r6("roc_auc").alias("roc_auc"))
