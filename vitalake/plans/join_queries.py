"""Queries on checked joins, codes, drugs and small transformations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.operators import checked, codes, cohort, features
from vitalake.plans.cohort_queries import _events, r6
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
WITH a AS (SELECT sample_id AS k, count(*) AS n FROM raw_llm_responses GROUP BY 1), b AS (SELECT pair_id AS k, count(*) AS n FROM test GROUP BY 1)
SELECT sum(coalesce(a.n, 0))::BIGINT AS left_rows, sum(coalesce(b.n, 0))::BIGINT AS right_rows, count(a.k) AS left_keys, count(b.k) AS right_keys,
  sum(CASE WHEN b.n IS NULL THEN a.n ELSE 0 END)::BIGINT AS left_alone, sum(CASE WHEN a.n IS NULL THEN b.n ELSE 0 END)::BIGINT AS right_alone, coalesce(sum(a.n * b.n), 0)::BIGINT AS joined
FROM a FULL JOIN b ON a.k = b.k
""")
def join_check(spark: SparkSession, d: str) -> DataFrame:
    """What a join of answers with their pairs would lose or multiply."""
    answers = table(spark, d, "raw_llm_responses").select(F.col("sample_id").alias("k"))
    return checked.join_report(answers, table(spark, d, "test").select(F.col("pair_id").alias("k")), "k")


@query("SELECT r.response_id, t.subject_id, t.label_lipid_disorder FROM raw_llm_responses r JOIN test t ON t.pair_id = r.sample_id")
def answers_joined(spark: SparkSession, d: str) -> DataFrame:
    """Answers with their pair's label; lost rows give a warning, an empty result an error."""
    raw = table(spark, d, "raw_llm_responses").select("response_id", F.col("sample_id").alias("pair_id"))
    return checked.inner_checked(raw, table(spark, d, "test").select("pair_id", "subject_id", "label_lipid_disorder"), "pair_id").drop("pair_id")


@query("""
WITH p AS (SELECT subject_id, race, insurance, row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS n FROM visits_iv WHERE subject_id IS NOT NULL)
SELECT pair_id, test.subject_id, race, insurance FROM test LEFT JOIN p ON p.subject_id = test.subject_id AND n = 1
""")
def pairs_with_patients(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the demographics of the patient's first stay: as many rows as pairs."""
    stays = table(spark, d, "visits_iv").select("subject_id", "intime", "stay_id", "race", "insurance")
    pairs = table(spark, d, "test").select("pair_id", "subject_id")
    return checked.left_first(pairs, stays, "subject_id", ["intime", "stay_id"]).select("pair_id", "subject_id", "race", "insurance")


@query("SELECT pair_id, t.label_lipid_disorder AS label, length(t.narrative_current) AS signs, t.subject_id IS NULL AS unknown FROM test t")
def parts_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of one row a pair put together one to one, and a third of the same size."""
    t = table(spark, d, "test")
    both = checked.one_to_one(t.select("pair_id", F.col("label_lipid_disorder").alias("label")), t.select("pair_id", F.length("narrative_current").alias("signs")), "pair_id")
    return checked.equal_size_join(both, t.select("pair_id", F.col("subject_id").isNull().alias("unknown")), "pair_id")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime NULLS FIRST, hadm_id NULLS FIRST, dischtime NULLS FIRST) AS n FROM admissions)
SELECT subject_id, hadm_id, admittime FROM a WHERE n = 1
""")
def first_admissions(spark: SparkSession, d: str) -> DataFrame:
    """The first admission of each subject."""
    a = table(spark, d, "admissions").select("subject_id", "hadm_id", "admittime", "dischtime")
    return checked.distinct_on(a, ["subject_id"], ["admittime", "hadm_id", "dischtime"]).drop("dischtime")


@query("""
SELECT sum(n)::BIGINT AS rows, count(hadm_id) AS keys, sum(n - 1)::BIGINT AS again, sum(absent)::BIGINT AS absent
FROM (SELECT hadm_id, count(*) AS n, sum(CASE WHEN subject_id IS NULL OR dischtime IS NULL THEN 1 ELSE 0 END) AS absent FROM admissions GROUP BY 1)
""")
def data_quality(spark: SparkSession, d: str) -> DataFrame:
    """Rows, keys, repeated keys and rows that lack a value."""
    return checked.data_quality(table(spark, d, "admissions"), "hadm_id", ["subject_id", "dischtime"])


#: Codes as numbers and a table of products for drugs, made of parts: every second part is a product.
_DRUGS = """
e AS (SELECT l_orderkey, l_linenumber, (l_partkey * 1000 + 7) * 100 AS number FROM lineitem),
p AS (SELECT (p_partkey * 1000 + 7) // 10000 || '-' || (p_partkey * 1000 + 7) % 10000 AS product, p_name AS name, p_type || ' [EPC],' || p_brand || ' [MoA]' AS classes FROM part WHERE p_partkey % 2 = 0)
"""


def _drugs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 1000 + 7) * 100).alias("number"))
    n = F.col("p_partkey") * 1000 + 7
    product = F.concat_ws("-", F.floor(n / 10000).cast("string"), (n % 10000).cast("string"))
    products = table(spark, d, "part").where("p_partkey % 2 = 0").select(
        product.alias("product"), F.col("p_name").alias("name"), F.concat(F.col("p_type"), F.lit(" [EPC],"), F.col("p_brand"), F.lit(" [MoA]")).alias("classes")
    )
    return ev, products


@query(f"""
WITH {_DRUGS},
k AS (SELECT lpad(split_part(product, '-', 1), 5, '0') || lpad(split_part(product, '-', 2), 4, '0') AS key, lower(name) AS generic, min(classes) AS classes FROM p GROUP BY 1, 2)
SELECT generic, array_to_string(list_filter(string_split(classes, ','), lambda x: contains(x, '[EPC]')), '|') AS classes, count(*) AS n
FROM e JOIN k ON left(lpad(number::VARCHAR, 11, '0'), 9) = key GROUP BY 1, 2
""")
def drug_classes(spark: SparkSession, d: str) -> DataFrame:
    """Prescriptions by non-proprietary name and established classes."""
    ev, products = _drugs(spark, d)
    named = codes.drug_classes(ev, products, "number", "product", "name", "classes")
    return named.groupBy("generic", F.array_join("established", "|").alias("classes")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_DRUGS}, m AS (SELECT product, min(name) AS generic FROM p GROUP BY 1)
SELECT generic, count(*) AS n FROM (SELECT (l_partkey * 1000 + 7) // 10000 || '-' || (l_partkey * 1000 + 7) % 10000 AS product FROM lineitem) x LEFT JOIN m USING (product) GROUP BY 1
""")
def generic_names(spark: SparkSession, d: str) -> DataFrame:
    """Prescriptions by the name that the first two sections of their code tell."""
    _, products = _drugs(spark, d)
    n = F.col("l_partkey") * 1000 + 7
    ev = table(spark, d, "lineitem").select(F.concat_ws("-", F.floor(n / 10000).cast("string"), (n % 10000).cast("string"), F.lit("03")).alias("code"))
    return codes.generic_name(ev, products, "code", "product", "name").groupBy("generic").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT x.brand, count(*) AS n, count(DISTINCT t) AS titles FROM (SELECT l_partkey % 40 AS brand FROM lineitem) x JOIN (SELECT p_partkey % 50 AS brand, p_name AS t FROM part) y ON x.brand = y.brand GROUP BY 1
""")
def described_codes(spark: SparkSession, d: str) -> DataFrame:
    """Events joined to all entries of their code in a dictionary, whatever its version."""
    ev = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("brand")).agg(F.count(F.lit(1)).alias("k"))
    words = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("brand"), F.col("p_name").alias("t"))
    return codes.described(ev, words, "brand", "t").groupBy("brand").agg(F.sum("k").alias("n"), F.count_distinct("t").alias("titles"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type ELSE p_partkey::VARCHAR END AS title FROM part
""")
def fallback_titles(spark: SparkSession, d: str) -> DataFrame:
    """The long title, else the short one, else the code."""
    part = table(spark, d, "part")
    words = part.select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, " ").alias("long"),
        F.when(F.col("p_size") % 3 == 1, F.col("p_type")).alias("short"),
    )
    return codes.titled(part.select("p_partkey"), words, "p_partkey", "long", "short")


_CODE_LIST = "SELECT pair_id, unnest(list_filter(list_transform(string_split(coalesce(diagnoses_codes_current, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS code FROM test"


@query(f"""
SELECT left(code || 'X', 3) AS code_group, count(*) AS n FROM ({_CODE_LIST})
WHERE NOT starts_with(code, '7') AND NOT starts_with(code, '81') AND length(code) > 3 GROUP BY 1
""")
def code_groups(spark: SparkSession, d: str) -> DataFrame:
    """Codes of one version, without two kinds, by the root of the converted code."""
    from vitalake.functions.text import split_codes

    ev = table(spark, d, "test").select("pair_id", F.explode(split_codes(F.col("diagnoses_codes_current"))).alias("code"))
    ev = ev.withColumn("version", F.when(F.length("code") > 3, 10).otherwise(9)).withColumn("converted", F.concat("code", F.lit("X")))
    kept = codes.without_prefixes(codes.of_versions(ev, "version", [10]), "code", ["7", "81"])
    return kept.groupBy(codes.grouped_code("root", F.col("code"), F.col("converted")).alias("code_group")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT drug, count(*) AS n FROM (SELECT replace(trim(lower(unnest(string_split(coalesce(medications_current, ''), ';')))), ' ', '_') AS drug FROM test) GROUP BY 1")
def drug_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Drugs in one spelling."""
    ev = table(spark, d, "test").select(F.explode(F.split(F.coalesce("medications_current", F.lit("")), ";")).alias("drug"))
    return ev.groupBy(codes.drug_name(F.col("drug")).alias("drug")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pair_id, len(string_split(diagnoses_codes_current, ';')) AS n, trim(string_split(diagnoses_codes_current, ';')[1]) AS first FROM test WHERE diagnoses_codes_current IS NOT NULL AND NOT contains(diagnoses_codes_current, '''')")
def list_literals(spark: SparkSession, d: str) -> DataFrame:
    """Lists written as literals, read again."""
    t = table(spark, d, "test").where("diagnoses_codes_current is not null and not contains(diagnoses_codes_current, \"'\")")
    text = F.concat(F.lit("['"), F.replace("diagnoses_codes_current", F.lit(";"), F.lit("', '")), F.lit("']"))
    items = codes.list_literal(text)
    return t.select("pair_id", F.size(items).alias("n"), F.trim(items[0]).alias("first"))


@query("""
SELECT pair_id, CASE WHEN abs(date_diff('day', admittime_current::DATE, admittime_next::DATE)) <= 60 THEN date_diff('day', admittime_current::DATE, admittime_next::DATE) END AS days FROM test
""")
def safe_days(spark: SparkSession, d: str) -> DataFrame:
    """Days to the next visit, null where too many (60 here, so that some are)."""
    return table(spark, d, "test").select("pair_id", codes.safe_days(F.col("admittime_next"), F.col("admittime_current"), 60).alias("days"))


@query("SELECT subject_id, hadm_id, year(admittime) AS year, max(year(admittime)) OVER (PARTITION BY subject_id) AS last_year FROM admissions WHERE subject_id IS NOT NULL AND admittime IS NOT NULL")
def last_years(spark: SparkSession, d: str) -> DataFrame:
    """Each admission with the last year of its subject."""
    a = table(spark, d, "admissions").where("subject_id is not null and admittime is not null").select("subject_id", "hadm_id", F.year("admittime").alias("year"))
    return features.with_group_max(a, "subject_id", "year", "last_year")


@query("""
WITH x AS (SELECT stay_id, 2008 + stay_id % 12 + (year(intime) - 2150) AS low, intime FROM visits_iv)
SELECT stay_id, CASE WHEN low BETWEEN 2008 AND 2017 THEN low - 2008 END AS window_index, date_diff('day', make_date(year(intime)::BIGINT, 1, 1), intime::DATE) AS days, low + 2 <= 2019 AS valid FROM x
""")
def relative_years(spark: SparkSession, d: str) -> DataFrame:
    """The window of years that a time may lie in, the days since its year's begin, and whether the window is valid."""
    low = F.col("stay_id") % 12 + 2008
    shift = F.year("intime") - 2150
    return table(spark, d, "visits_iv").select(
        "stay_id", cohort.window_index(low, low + 2, shift).alias("window_index"), cohort.days_into_year(F.col("intime")).alias("days"),
        cohort.window_valid(low + 2 + shift, 2019).alias("valid"),
    )


@query("""
SELECT CASE WHEN label_lipid_disorder = 1 THEN 'positive' ELSE 'other' END AS part, count(*) AS n, round(avg(coalesce(length(narrative_current), 0)), 6) AS mean_signs,
       round(avg(label_lipid_disorder), 6) AS mean_label FROM test GROUP BY 1
""")
def means_by_part(spark: SparkSession, d: str) -> DataFrame:
    """Means of columns by the part of a split."""
    t = table(spark, d, "test").select(
        F.when(F.col("label_lipid_disorder") == 1, "positive").otherwise("other").alias("part"), F.coalesce(F.length("narrative_current"), F.lit(0)).alias("signs"), F.col("label_lipid_disorder").alias("label")
    )
    m = features.means_by(t, "part", ["signs", "label"])
    return m.select("part", "n", r6("mean_signs").alias("mean_signs"), r6("mean_label").alias("mean_label"))


@query("SELECT max(a) AS labs, max(b) AS items, max(c) AS orders FROM (SELECT hadm_id, count(*) AS a, count(DISTINCT itemid) AS b, 0 AS c FROM labevents WHERE hadm_id IS NOT NULL GROUP BY 1 UNION ALL SELECT stay_id, 0, 0, count(DISTINCT orderid) FROM preproc_med_icu WHERE stay_id IS NOT NULL GROUP BY 1)")
def largest_groups(spark: SparkSession, d: str) -> DataFrame:
    """The most events, items and orders of one visit: the lengths that sequences need."""
    labs = features.largest_group(table(spark, d, "labevents"), "hadm_id", F.count(F.lit(1)).alias("labs"), F.count_distinct("itemid").alias("items"))
    return labs.crossJoin(features.largest_group(table(spark, d, "preproc_med_icu"), "stay_id", F.count_distinct("orderid").alias("orders")))  # one row each


@query("""
WITH r AS (SELECT DISTINCT subject_id, hadm_id, admittime, dischtime FROM admissions WHERE subject_id IS NOT NULL AND admittime IS NOT NULL),
l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY subject_id ORDER BY admittime DESC, hadm_id DESC) = 1 THEN 0
       WHEN EXISTS (SELECT 1 FROM r x WHERE x.subject_id = r.subject_id AND x.admittime > r.dischtime AND x.admittime <= r.dischtime + INTERVAL 30 DAY) THEN 1 ELSE 0 END AS label FROM r),
c AS (SELECT DISTINCT hadm_id_current AS hadm_id FROM test WHERE regexp_matches(coalesce(diagnoses_codes_current, ''), '(^|;) *(25|4)'))
SELECT subject_id, hadm_id, admittime, label FROM l WHERE hadm_id IN (SELECT hadm_id FROM c WHERE hadm_id IS NOT NULL)
""")
def phenotype_readmission(spark: SparkSession, d: str) -> DataFrame:
    """Readmission within 30 days of visits with a disease."""
    from vitalake.functions.text import split_codes

    v = table(spark, d, "admissions").select("subject_id", "hadm_id", "admittime", "dischtime").distinct()
    ev = table(spark, d, "test").select(F.col("hadm_id_current").alias("hadm_id"), F.explode(split_codes(F.col("diagnoses_codes_current"))).alias("code"))
    return cohort.phenotype(v, ev, "hadm_id", F.col("code"), "^(25|4)", 30).select("subject_id", "hadm_id", "admittime", "label")


@query("""
SELECT label_lipid_disorder AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM test GROUP BY 1
""")
def label_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of each label."""
    return features.label_report(table(spark, d, "test"), "label_lipid_disorder").withColumnRenamed("label_lipid_disorder", "label")


@query("""
SELECT label_lipid_disorder AS label, pair_id FROM (SELECT label_lipid_disorder, pair_id, row_number() OVER (PARTITION BY label_lipid_disorder ORDER BY pair_id) AS n FROM test WHERE label_lipid_disorder IS NOT NULL) WHERE n <= 3
""")
def label_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first three rows of each label (a top-k report)."""
    return features.first_examples(table(spark, d, "test").where("label_lipid_disorder is not null"), "label_lipid_disorder", "pair_id", 3).select(F.col("label_lipid_disorder").alias("label"), "pair_id")


@query("""
SELECT pair_id, CASE WHEN x IS NULL THEN NULL WHEN x < 0 THEN NULL WHEN x <= 7 THEN 'within_7_days' WHEN x <= 30 THEN '8_to_30_days' WHEN x <= 90 THEN '31_to_90_days' ELSE 'over_90_days' END AS bucket, x IS NULL OR x < 0 AS invalid
FROM (SELECT pair_id, (epoch_us(admittime_next) - epoch_us(admittime_current)) / 86400000000.0 AS x FROM test)
""")
def timing_labels(spark: SparkSession, d: str) -> DataFrame:
    """The bucket of the time to the next visit, and whether that time is missing or negative."""
    from vitalake.operators.visits import days_between, timing_labels as labelled

    return labelled(table(spark, d, "test").select("pair_id", days_between(F.col("admittime_current"), F.col("admittime_next")).alias("x")), "x").drop("x")


@query("SELECT hadm_id FROM (SELECT DISTINCT hadm_id FROM admissions INTERSECT SELECT DISTINCT hadm_id_current FROM test) WHERE hadm_id IS NOT NULL")
def shared_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits of two lists."""
    ours = table(spark, d, "admissions").select("hadm_id").where("hadm_id is not null")
    return ours.intersect(table(spark, d, "test").select("hadm_id_current"))


@query("SELECT pair_id FROM test ORDER BY pair_id LIMIT 25")
def head_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 pairs (a limit is the feature)."""
    return features.head(table(spark, d, "test").select("pair_id"), ["pair_id"], 25)


@query("SELECT itemid, count(*) AS total FROM labevents GROUP BY 1 ORDER BY total DESC, itemid LIMIT 4")
def top_items(spark: SparkSession, d: str) -> DataFrame:
    """The four items with most events (a top-k report)."""
    return features.top_by_total(table(spark, d, "labevents"), "itemid", 4)


@query("SELECT doc_id, note_type FROM documents WHERE note_type IN ('nursing note', 'radiology report')")
def notes_of_types(spark: SparkSession, d: str) -> DataFrame:
    """Notes of chosen types."""
    return features.of_kinds(table(spark, d, "documents").select("doc_id", "note_type"), "note_type", ["nursing note", "radiology report"])


@query("""
WITH c AS (SELECT DISTINCT hadm_id FROM visits_iv WHERE hadm_id IS NOT NULL), t AS (SELECT itemid FROM labevents GROUP BY 1 HAVING count(*) >= 500)
SELECT 'labs' AS domain, count(*) AS n, count(DISTINCT hadm_id) AS visits FROM labevents WHERE hadm_id IN (SELECT hadm_id FROM c) AND itemid IN (SELECT itemid FROM t)
UNION ALL SELECT 'drugs', count(*), count(DISTINCT hadm_id) FROM preproc_med_icu WHERE hadm_id IN (SELECT hadm_id FROM c)
""")
def domain_features(spark: SparkSession, d: str) -> DataFrame:
    """Events of a cohort's visits by domain, of one domain for a list of chosen items."""
    labs = table(spark, d, "labevents").select("hadm_id", F.col("itemid").alias("code"))
    listed = labs.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n >= 500").select("code")
    made = features.in_cohort({"labs": labs, "drugs": table(spark, d, "preproc_med_icu").select("hadm_id", F.col("itemid").alias("code"))}, table(spark, d, "visits_iv"), "hadm_id", {"labs": listed})
    rows = [df.agg(F.lit(n).alias("domain"), F.count(F.lit(1)).alias("n"), F.count_distinct("hadm_id").alias("visits")) for n, df in made.items()]
    return rows[0].unionByName(rows[1])


@query("""
WITH p AS (SELECT subject_id, race, insurance, row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS n FROM visits_iv WHERE subject_id IS NOT NULL)
SELECT pair_id, test.subject_id, label_lipid_disorder AS y, (pair_id % 100) / 100.0::DOUBLE AS probability, round(CASE WHEN pair_id % 100 > 0 THEN log2((pair_id % 100) / 100.0::DOUBLE / (1 - (pair_id % 100) / 100.0::DOUBLE)) END, 6) AS logit, race, insurance
FROM test LEFT JOIN p ON p.subject_id = test.subject_id AND n = 1
""")
def output_frame(spark: SparkSession, d: str) -> DataFrame:
    """Labels, probabilities, logits and demographics side by side; the probability is made from the id."""
    stays = table(spark, d, "visits_iv").where("subject_id is not null").select("subject_id", "intime", "stay_id", "race", "insurance")
    people = checked.distinct_on(stays, ["subject_id"], ["intime", "stay_id"]).drop("intime", "stay_id")
    t = table(spark, d, "test").select("pair_id", "subject_id", F.col("label_lipid_disorder").alias("y"), ((F.col("pair_id") % 100) / 100.0).alias("score"))
    return features.output_frame(t, "pair_id", "y", "score", people, "subject_id").withColumn("logit", r6("logit"))


#: Kinds of events, their flag and how many titles of each a narrative names; fixed values.
_KINDS = {"diagnoses": ("A", 12), "procedures": ("N", 12), "medications": ("R", 20)}


@query("""
WITH e AS (
  SELECT o_custkey, l_returnflag AS f, p_name, min((o_orderdate, o_orderkey, l_linenumber, l_partkey)) AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, f ORDER BY o, p_name) AS rn FROM e),
t AS (SELECT o_custkey, string_agg(p_name, ', ' ORDER BY rn) FILTER (WHERE f = 'A' AND rn <= 12) AS a, string_agg(p_name, ', ' ORDER BY rn) FILTER (WHERE f = 'N' AND rn <= 12) AS b,
  string_agg(p_name, ', ' ORDER BY rn) FILTER (WHERE f = 'R' AND rn <= 20) AS c FROM n GROUP BY 1),
k AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1)
SELECT c_custkey AS subject, 'Patient ' || c_custkey || ': ' || coalesce(k, 0) || ' admissions; diagnoses: ' || coalesce(a, 'None recorded') || '; procedures: ' || coalesce(b, 'None recorded') || '; medications: ' || coalesce(c, 'None recorded') || '.' AS narrative
FROM customer LEFT JOIN k ON k.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey
""")
def patient_narratives(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each patient with the first distinct titles of all three kinds of events."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ev = orders.join(_events(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").select(
        "o_custkey", F.col("l_returnflag").alias("f"), F.col("p_name").alias("title"), F.struct("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey").alias("o")
    )
    first = ev.groupBy("o_custkey", "f", "title").agg(F.min("o").alias("o"))
    most = F.when(F.col("f") == "R", 20).otherwise(12)
    ranked = features.rank_within(first, ["o_custkey", "f"], [F.col("o"), F.col("title")]).where(F.col("rn") <= most)
    text = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == flag, F.struct("rn", "title")))), lambda x: x["title"]), ", ")
    titles = ranked.groupBy("o_custkey").agg(*[text(flag).alias(n) for n, (flag, _) in _KINDS.items()])
    n = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    said = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c)).otherwise("None recorded")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(n, "o_custkey", "left").join(titles, "o_custkey", "left").select(
        F.col("o_custkey").alias("subject"),
        F.format_string(
            "Patient %s: %s admissions; diagnoses: %s; procedures: %s; medications: %s.", F.col("o_custkey"), F.coalesce("k", F.lit(0)), *[said(c) for c in _KINDS]
        ).alias("narrative"),
    )


@query("""
SELECT o_orderkey, c_mktsegment AS segment, n_name AS nation, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
""")
def visits_with_patients(spark: SparkSession, d: str) -> DataFrame:
    """Visits with their patient and the patient's demographics: two inner joins."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    v = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return v.join(c, "o_custkey").join(n, "n_nationkey").select("o_orderkey", "segment", "nation", "o_totalprice")
