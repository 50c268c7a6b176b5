"""Queries on visits, cohorts, features and time grids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.functions.durations import duration_micros
from vitalake.functions.text import (
    CONDITIONS, age_decade, clean_title, collapsed, epc_items, has_code, ndc_key, ndc_table_key, split_codes, truncated,
)
from vitalake.operators import cohort, features, timeseries, visits
from vitalake.operators.answers import narrative
from vitalake.operators.ranks import grouped_percentiles
from vitalake.plans.data_problems_sql import _T
from vitalake.sources.readers import profile
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


def r6(c) -> F.Column:  # noqa: ANN001
    return F.round(c, 6)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(
        table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey"
    )


def _order_codes(spark: SparkSession, d: str, flag: str, name: str) -> DataFrame:
    ev = _events(spark, d).where(F.col("l_returnflag") == flag).withColumnRenamed("l_orderkey", "o_orderkey")
    return visits.distinct_concat(ev, "o_orderkey", "p_brand", ["l_linenumber", "l_partkey"], name)


_CODES = """
firsts AS (
  SELECT l_orderkey, l_returnflag, p_brand, min((l_linenumber, l_partkey)) AS o
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
codes AS (
  SELECT l_orderkey, l_returnflag, string_agg(p_brand, ';' ORDER BY o, p_brand) AS c FROM firsts GROUP BY ALL)
"""


@query(f"""
WITH {_CODES}
SELECT o_custkey, o_orderkey, coalesce(a.c, '') AS diagnoses, coalesce(n.c, '') AS procedures, coalesce(r.c, '') AS medications,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS visit_order
FROM orders
LEFT JOIN codes a ON a.l_orderkey = o_orderkey AND a.l_returnflag = 'A'
LEFT JOIN codes n ON n.l_orderkey = o_orderkey AND n.l_returnflag = 'N'
LEFT JOIN codes r ON r.l_orderkey = o_orderkey AND r.l_returnflag = 'R'
""")
def visits_agg(spark: SparkSession, d: str) -> DataFrame:
    """Visits with their distinct codes in first-seen order, and their order."""
    v = visits.with_aggregates(
        table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_orderkey",
        _order_codes(spark, d, "A", "diagnoses"), _order_codes(spark, d, "N", "procedures"), _order_codes(spark, d, "R", "medications"),
    )
    return visits.visit_order(v, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
WITH p AS (
  SELECT o_custkey, o_orderkey AS o_orderkey_current, o_orderdate AS o_orderdate_current,
         lead(o_orderkey) OVER w AS o_orderkey_next, lead(o_orderdate) OVER w AS o_orderdate_next
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT row_number() OVER (ORDER BY o_custkey, o_orderdate_current, o_orderkey_current) - 1 AS pair_id, *
FROM p WHERE o_orderkey_next IS NOT NULL
""")
def visit_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive visits with dense ids."""
    pairs = visits.consecutive_pairs(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])
    return visits.dense_ids(pairs, ["o_custkey", "o_orderdate_current", "o_orderkey_current"])


@query(f"""
WITH {_CODES},
v AS (SELECT o_custkey, o_orderkey, o_orderdate, coalesce(c, '') AS c FROM orders LEFT JOIN codes ON l_orderkey = o_orderkey AND l_returnflag = 'N'),
p AS (SELECT o_custkey, lead(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following FROM v)
SELECT c_mktsegment AS segment, count(*) AS pairs, sum(CASE WHEN regexp_matches(following, 'Brand#1[0-9]') THEN 1 ELSE 0 END)::BIGINT AS positive,
       round(avg(CASE WHEN regexp_matches(following, 'Brand#1[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS prevalence
FROM p JOIN customer ON o_custkey = c_custkey WHERE following IS NOT NULL GROUP BY 1
""")
def next_label_prevalence(spark: SparkSession, d: str) -> DataFrame:
    """Prevalence of a code group at the next visit, by group of patients: the flagship query.

    Only whether a visit has a code of the group is carried along, not its codes.
    """
    wanted = table(spark, d, "part").where(F.col("p_brand").rlike("Brand#1[0-9]")).select(F.col("p_partkey").alias("l_partkey"))
    hits = table(spark, d, "lineitem").where("l_returnflag = 'N'").join(wanted, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    v = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(hits.withColumn("hit", F.lit(1)), "o_orderkey", "left")
    pairs = visits.consecutive_pairs(v.withColumn("label", F.coalesce("hit", F.lit(0))), "o_custkey", ["o_orderdate", "o_orderkey"], ["label"])
    per = pairs.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("label_next").alias("positive"))
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return per.join(segments, "o_custkey").groupBy("segment").agg(
        F.sum("pairs").alias("pairs"), F.sum("positive").alias("positive"), r6(F.sum("positive") / F.sum("pairs")).alias("prevalence")
    )


@query("""
SELECT pair_id, CASE WHEN len(list_filter(string_split(coalesce(diagnoses_codes_current, ''), ';'), lambda x: regexp_matches(trim(x), '^272[0-9]'))) > 0 THEN 1 ELSE 0 END AS label
FROM test
""")
def lipid_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether a list of codes has one of a group."""
    return table(spark, d, "test").select("pair_id", has_code(split_codes(F.col("diagnoses_codes_current")), "^272[0-9]").cast("int").alias("label"))


_DAYS = "(epoch_us(admittime_next) - epoch_us(admittime_current)) / 86400000000.0"


@query(f"""
SELECT CASE WHEN {_DAYS} IS NULL OR {_DAYS} < 0 THEN NULL WHEN {_DAYS} <= 7 THEN 'within_7_days' WHEN {_DAYS} <= 30 THEN '8_to_30_days'
            WHEN {_DAYS} <= 90 THEN '31_to_90_days' ELSE 'over_90_days' END AS bucket, count(*) AS n FROM test GROUP BY 1
""")
def timing_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by the time to the next visit."""
    days = visits.days_between(F.col("admittime_current"), F.col("admittime_next"))
    return table(spark, d, "test").groupBy(visits.timing_bucket(days).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT count({_DAYS}) AS n, round(min({_DAYS}), 6) AS low, round(quantile_cont({_DAYS}, 0.5), 6) AS median, round(max({_DAYS}), 6) AS high, round(avg({_DAYS}), 6) AS mean FROM test
""")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, least, median, greatest and mean days to the next visit."""
    x = table(spark, d, "test").select(F.lit(1).alias("one"), visits.days_between(F.col("admittime_current"), F.col("admittime_next")).alias("x"))
    middle = grouped_percentiles(x, "one", "x", [0.5]).agg(F.max(F.col("p")[0]).alias("median"))
    rest = x.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"))
    return rest.crossJoin(middle).select("n", *[r6(c).alias(c) for c in ("low", "median", "high", "mean")])  # one row each


@query("""
WITH a AS (SELECT subject_id, count(*) AS n_rows, count(DISTINCT hadm_id) AS n_visits, min(admittime) AS first_admit, max(dischtime) AS last_discharge, max(hospital_expire_flag) AS died FROM admissions WHERE subject_id IS NOT NULL GROUP BY 1),
l AS (SELECT subject_id, count(*) AS n_labs, count(DISTINCT itemid) AS n_lab_items FROM labevents GROUP BY 1)
SELECT a.*, coalesce(n_labs, 0) AS n_labs, coalesce(n_lab_items, 0) AS n_lab_items FROM a LEFT JOIN l USING (subject_id)
""")
def patient_mart(spark: SparkSession, d: str) -> DataFrame:
    """One row a patient."""
    a = table(spark, d, "admissions").where("subject_id is not null").groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("hadm_id").alias("n_visits"), F.min("admittime").alias("first_admit"),
        F.max("dischtime").alias("last_discharge"), F.max("hospital_expire_flag").alias("died"),
    )
    labs = table(spark, d, "labevents").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_labs"), F.count_distinct("itemid").alias("n_lab_items"))
    return a.join(labs, "subject_id", "left").na.fill(0, ["n_labs", "n_lab_items"])


@query("""
WITH e AS (
  SELECT o_custkey, p_name, min((o_orderdate, o_orderkey, l_linenumber, l_partkey)) AS o
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o, p_name) AS rn FROM e),
t AS (SELECT o_custkey, string_agg(p_name, ', ' ORDER BY rn) AS titles FROM n WHERE rn <= 12 GROUP BY 1),
c AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1)
SELECT c_custkey AS subject, 'Patient ' || c_custkey || ': ' || coalesce(k, 0) || ' admissions; medications: ' || coalesce(titles, 'None recorded') || '.' AS narrative
FROM customer LEFT JOIN c ON c.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey
""")
def patient_narrative(spark: SparkSession, d: str) -> DataFrame:
    """A sentence for each patient with the first twelve distinct titles."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ev = orders.join(_events(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey").withColumn("title", clean_title(F.col("p_name")))
    first = ev.groupBy("o_custkey", "title").agg(F.min(F.struct("o_orderdate", "o_orderkey", "l_linenumber", "l_partkey")).alias("o"))
    titles = features.rank_within(first, ["o_custkey"], [F.col("o"), F.col("title")]).where("rn <= 12").groupBy("o_custkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]), ", ").alias("titles")
    )
    n = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(n, "o_custkey", "left").join(titles, "o_custkey", "left").select(
        F.col("o_custkey").alias("subject"),
        F.format_string("Patient %s: %s admissions; medications: %s.", F.col("o_custkey"), F.coalesce("k", F.lit(0)), F.coalesce("titles", F.lit("None recorded"))).alias("narrative"),
    )


@query("""
WITH l AS (SELECT pair_id,
  list_filter(list_transform(string_split(coalesce(diagnoses_codes_current, ''), ';'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan') AS a,
  list_filter(list_transform(string_split(coalesce(medications_current, ''), ';'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan') AS b,
  list_filter(list_transform(string_split(coalesce(procedures_codes_current, ''), ';'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan') AS c FROM test),
u AS (SELECT pair_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a, list_filter(b, lambda x, i: list_position(b, x) = i) AS b, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM l)
SELECT pair_id, '- Diagnoses made: ' || coalesce(nullif(array_to_string(a, '; '), ''), 'None recorded') || chr(10) || '- Medications prescribed: ' || coalesce(nullif(array_to_string(b, '; '), ''), 'None recorded')
  || chr(10) || '- Procedures performed: ' || coalesce(nullif(array_to_string(c, '; '), ''), 'None recorded') AS narrative FROM u
""")
def narrative_bullet(spark: SparkSession, d: str) -> DataFrame:
    """Each pair's lists as bullets."""
    lists = [split_codes(F.col(c)) for c in ("diagnoses_codes_current", "medications_current", "procedures_codes_current")]
    return table(spark, d, "test").select("pair_id", narrative(*lists).alias("narrative"))


@query("SELECT p_partkey AS code, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10 GROUP BY 1")
def missing_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of events that a dictionary lacks."""
    known = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    ours = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"))
    used = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return used.join(ours, "l_partkey", "left_semi").join(known, "l_partkey", "left_anti").withColumnRenamed("l_partkey", "code")


@query("""
WITH v AS (SELECT DISTINCT subject_id, hadm_id, admittime, dischtime FROM admissions WHERE subject_id IS NOT NULL AND admittime IS NOT NULL)
SELECT subject_id, hadm_id, admittime, dischtime,
  CASE WHEN row_number() OVER (PARTITION BY subject_id ORDER BY admittime DESC, hadm_id DESC) = 1 THEN 0
       WHEN EXISTS (SELECT 1 FROM v x WHERE x.subject_id = v.subject_id AND x.admittime > v.dischtime AND x.admittime <= v.dischtime + INTERVAL 30 DAY) THEN 1 ELSE 0 END AS label
FROM v
""")
def readmission_30(spark: SparkSession, d: str) -> DataFrame:
    """Admissions followed by another of the patient within 30 days of the discharge."""
    v = table(spark, d, "admissions").select("subject_id", "hadm_id", "admittime", "dischtime").distinct()
    return cohort.readmission(v, 30)


@query("""
SELECT stay_id, floor((epoch_us(dischtime) - epoch_us(admittime)) / 86400000000)::BIGINT AS los_days, CASE WHEN los > 3 THEN 1 ELSE 0 END AS label FROM visits_iv
""")
def los_label(spark: SparkSession, d: str) -> DataFrame:
    """Stays longer than three days."""
    return cohort.long_stay(table(spark, d, "visits_iv"), F.col("los"), 3).select(
        "stay_id", cohort.whole_days(F.col("dischtime"), F.col("admittime")).alias("los_days"), "label"
    )


@query("""
SELECT subject_id, hadm_id, admittime, CASE WHEN hospital_expire_flag = 1 THEN 1 ELSE 0 END AS label
FROM admissions WHERE admittime IS NOT NULL AND dischtime IS NOT NULL AND dischtime >= admittime
""")
def mortality_label(spark: SparkSession, d: str) -> DataFrame:
    """Admissions that end with death."""
    v = table(spark, d, "admissions").withColumn("dod", F.when(F.col("hospital_expire_flag") == 1, F.col("dischtime"))).where("dischtime is null or dischtime >= admittime")
    return cohort.mortality(v, F.col("dod"))[0].select("subject_id", "hadm_id", "admittime", "label")


@query("""
SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS patients, count(DISTINCT hadm_id) AS visits, sum(hospital_expire_flag)::BIGINT AS deaths,
       sum(CASE WHEN dischtime IS NULL THEN 1 ELSE 0 END)::BIGINT AS open_visits FROM admissions
""")
def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    """Size of the cohort."""
    return table(spark, d, "admissions").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("subject_id").alias("patients"), F.count_distinct("hadm_id").alias("visits"),
        F.sum("hospital_expire_flag").alias("deaths"), F.sum(F.when(F.col("dischtime").isNull(), 1).otherwise(0)).alias("open_visits"),
    )


@query("""
WITH c AS (SELECT DISTINCT hadm_id_current AS hadm_id FROM (SELECT hadm_id_current, unnest(string_split(coalesce(diagnoses_codes_current, ''), ';')) AS c FROM test)
           WHERE hadm_id_current IS NOT NULL AND regexp_matches(substr(trim(c), 1, 3), '25'))
SELECT DISTINCT subject_id, hadm_id FROM admissions WHERE hadm_id IN (SELECT hadm_id FROM c)
""")
def disease_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Visits with a diagnosis whose root contains a code."""
    ev = table(spark, d, "test").select(F.col("hadm_id_current").alias("hadm_id"), F.explode(split_codes(F.col("diagnoses_codes_current"))).alias("code"))
    return table(spark, d, "admissions").select("subject_id", "hadm_id").distinct().join(
        cohort.with_code(ev, "hadm_id", F.substring("code", 1, 3), "25"), "hadm_id", "left_semi"
    )


@query("""
WITH m AS (SELECT p_partkey % 50 AS key, arg_min(p_name, p_partkey) AS target FROM part GROUP BY 1)
SELECT target, count(*) AS n FROM lineitem LEFT JOIN m ON l_partkey % 50 = key GROUP BY 1
""")
def code_map_first(spark: SparkSession, d: str) -> DataFrame:
    """Events by the first target of their code's root in a map."""
    m = features.first_match(table(spark, d, "part").withColumn("target", F.col("p_name")), F.col("p_partkey") % 50, "target", ["p_partkey"])
    ev = table(spark, d, "lineitem").withColumn("key", F.col("l_partkey") % 50)
    return ev.join(m, "key", "left").groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH m AS (SELECT p_size AS key, arg_max(p_name, p_partkey) AS title FROM part GROUP BY 1)
SELECT p_partkey AS code, CASE WHEN p_size > 40 THEN '[CODE:' || p_size || ']' ELSE title END AS title FROM part LEFT JOIN m ON key = p_size
""")
def dictionary_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles by the last line of a dictionary, with a placeholder where there is none."""
    part = table(spark, d, "part")
    m = features.last_match(part.where("p_size <= 40").withColumn("title", F.col("p_name")), F.col("p_size"), "title", ["p_partkey"])
    return part.select(F.col("p_partkey").alias("code"), F.col("p_size").alias("key")).join(m, "key", "left").select(
        "code", F.coalesce("title", F.concat(F.lit("[CODE:"), F.col("key").cast("string"), F.lit("]"))).alias("title")
    )


@query("""
SELECT p_partkey, left(lpad((p_partkey * 100003)::VARCHAR, greatest(11, length((p_partkey * 100003)::VARCHAR))::INT, '0'), 9) AS ndc,
       lpad(p_partkey::VARCHAR, greatest(5, length(p_partkey::VARCHAR))::INT, '0') || lpad(p_size::VARCHAR, 4, '0') AS product_key FROM part
""")
def ndc_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Nine-digit keys of drug codes from both forms."""
    return table(spark, d, "part").select(
        "p_partkey", ndc_key(F.col("p_partkey") * 100003).alias("ndc"),
        ndc_table_key(F.concat_ws("-", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))).alias("product_key"),
    )


@query("""
SELECT p_partkey, array_to_string(list_filter(string_split(p_type || ' [EPC],' || p_name || ' [MoA],' || p_brand || ' [EPC]', ','), lambda x: contains(x, '[EPC]')), '|') AS classes FROM part
""")
def epc_extract(spark: SparkSession, d: str) -> DataFrame:
    """Established classes in a list of classes."""
    text = F.concat(F.col("p_type"), F.lit(" [EPC],"), F.col("p_name"), F.lit(" [MoA],"), F.col("p_brand"), F.lit(" [EPC]"))
    return table(spark, d, "part").select("p_partkey", F.array_join(epc_items(text), "|").alias("classes"))


@query("""
WITH p AS (SELECT itemid, hadm_id, count(*) AS n, sum(CASE WHEN valuenum = 0 THEN 1 ELSE 0 END) AS z FROM labevents WHERE itemid IS NOT NULL AND hadm_id IS NOT NULL GROUP BY 1, 2)
SELECT itemid, sum(n)::BIGINT AS total_count, round(avg(n), 6) AS mean_frequency, round(100.0 * sum(z) / sum(n), 6) AS missing_pct FROM p GROUP BY 1
""")
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    """Frequency and share of zeros of each item."""
    s = features.feature_summary(table(spark, d, "labevents"), "hadm_id", "itemid", "valuenum")
    return s.select("itemid", "total_count", r6("mean_frequency").alias("mean_frequency"), r6("missing_pct").alias("missing_pct"))


@query("""
WITH t AS (SELECT itemid FROM (SELECT itemid, count(DISTINCT subject_id) AS s FROM labevents GROUP BY 1) ORDER BY s DESC, itemid LIMIT 5)
SELECT itemid, count(*) AS n FROM labevents WHERE itemid IN (SELECT itemid FROM t) GROUP BY 1
""")
def feature_select(spark: SparkSession, d: str) -> DataFrame:
    """Events of the five items that most patients have (a top-k report)."""
    labs = table(spark, d, "labevents")
    chosen = features.top_by_subjects(labs, "itemid", "subject_id", 5).select("itemid")
    return labs.join(F.broadcast(chosen), "itemid", "left_semi").groupBy("itemid").agg(F.count(F.lit(1)).alias("n"))  # five rows


@query("""
WITH e AS (SELECT event_type AS item, CASE WHEN json_extract(props, '$.k')::INT < 3 THEN 'b' WHEN json_extract(props, '$.k')::INT = 50 THEN NULL ELSE 'a' END AS unit FROM events),
u AS (SELECT item, unit, count(*) AS n FROM e GROUP BY 1, 2),
i AS (SELECT item, sum(n) AS total, count(unit) AS k, max(CASE WHEN unit IS NOT NULL THEN n END) AS top, arg_max(unit, CASE WHEN unit IS NOT NULL THEN n ELSE -1 END) AS tu FROM u GROUP BY 1)
SELECT u.item, u.unit, u.n FROM u JOIN i USING (item) WHERE NOT (k > 1 AND top > 0.95 * total) OR u.unit = tu
""")
def uom_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events without the rows of stray units."""
    k = F.get_json_object("props", "$.k").cast("int")
    ev = table(spark, d, "events").select(F.col("event_type").alias("item"), F.when(k < 3, "b").when(k == 50, None).otherwise("a").alias("unit"))
    return features.keep_main_unit(ev, "item", "unit").groupBy("item", "unit").agg(F.count(F.lit(1)).alias("n"))


_BOUNDS = "b AS (SELECT itemid, quantile_cont(valuenum, 0.02) AS lo, quantile_cont(valuenum, 0.98) AS hi FROM labevents WHERE valuenum IS NOT NULL AND NOT isnan(valuenum) GROUP BY 1)"


@query(f"WITH {_BOUNDS} SELECT labevent_id, round(least(greatest(valuenum, lo), hi), 6) AS value FROM labevents JOIN b USING (itemid) WHERE valuenum IS NOT NULL AND NOT isnan(valuenum)")
def outlier_winsorise(spark: SparkSession, d: str) -> DataFrame:
    """Values set to the percentiles of their item."""
    labs = table(spark, d, "labevents").where("valuenum is not null and not isnan(valuenum)").select("labevent_id", "itemid", F.col("valuenum").alias("value"))
    return features.winsorise(labs, "itemid", "value", 2, 98).select("labevent_id", r6("value").alias("value"))


@query(f"WITH {_BOUNDS} SELECT itemid, count(*) AS n, round(sum(valuenum), 4) AS total FROM labevents JOIN b USING (itemid) WHERE valuenum BETWEEN lo AND hi GROUP BY 1")
def outlier_drop(spark: SparkSession, d: str) -> DataFrame:
    """Values within the percentiles of their item."""
    labs = table(spark, d, "labevents").where("valuenum is not null and not isnan(valuenum)").select("itemid", F.col("valuenum").alias("value"))
    return features.winsorise(labs, "itemid", "value", 2, 98, drop=True).groupBy("itemid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH v AS (SELECT DISTINCT subject_id, hadm_id, date_trunc('day', admittime) AS a, date_trunc('day', dischtime) AS d FROM admissions WHERE hadm_id IS NOT NULL),
f AS (SELECT labevent_id, arg_min(v.hadm_id, (date_diff('day', a, date_trunc('day', charttime)), v.hadm_id)) AS found
      FROM labevents l JOIN v ON v.subject_id = l.subject_id AND date_trunc('day', charttime) BETWEEN a AND d WHERE l.hadm_id IS NULL GROUP BY 1)
SELECT labevent_id, coalesce(hadm_id, found) AS hadm_id FROM labevents LEFT JOIN f USING (labevent_id)
""")
def hadm_impute(spark: SparkSession, d: str) -> DataFrame:
    """Events without a visit given the one around them."""
    labs = table(spark, d, "labevents").select("labevent_id", "subject_id", "hadm_id", "charttime")
    return features.assign_visits(labs, table(spark, d, "admissions"), ["labevent_id"], "charttime").select("labevent_id", "hadm_id")


_MEDS = """
m AS (SELECT DISTINCT m.stay_id, m.itemid, m.orderid, m.rate, m.amount, v.los,
        floor((epoch_us(m.starttime) - epoch_us(v.intime)) / 3600000000)::BIGINT AS start, floor((epoch_us(m.endtime) - epoch_us(v.intime)) / 3600000000)::BIGINT AS stop
      FROM preproc_med_icu m JOIN (SELECT stay_id, intime, floor(los * 24)::BIGINT AS los FROM visits_iv WHERE los > 0) v USING (stay_id)),
s AS (SELECT stay_id, itemid, orderid, rate, amount, los, start, least(stop, los) AS stop FROM m WHERE start >= 0 AND los - start > 0 AND stop - start > 0)
"""


def _stays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "visits_iv").where("los > 0").select("stay_id", "intime", F.floor(F.col("los") * 24).alias("los"))


def _meds(spark: SparkSession, d: str) -> DataFrame:
    stays = _stays(spark, d)
    raw = (
        table(spark, d, "preproc_med_icu").join(stays.select("stay_id", "intime"), "stay_id")
        .select("stay_id", "itemid", "orderid", "rate", "amount", cohort.whole_hours(F.col("starttime"), F.col("intime")).alias("start"), cohort.whole_hours(F.col("endtime"), F.col("intime")).alias("stop"))
        .distinct()
    )
    return timeseries.sane_intervals(raw, stays, "stay_id")


@query(f"WITH {_MEDS} SELECT stay_id, itemid, count(*) AS n, min(start) AS first_start, max(stop) AS last_stop FROM s GROUP BY 1, 2")
def events_in_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Drug intervals of the cohort's stays in whole hours from admission."""
    return _meds(spark, d).groupBy("stay_id", "itemid").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("stop").alias("last_stop"))


@query(f"""
WITH {_MEDS} SELECT stay_id, itemid, start // 4 AS bucket, round(max(stop) / 4.0, 6) AS stop, round(avg(amount), 6) AS dose, round(avg(rate), 6) AS rate FROM s GROUP BY 1, 2, 3
""")
def bucket_meds(spark: SparkSession, d: str) -> DataFrame:
    """Drugs by bucket of four hours."""
    return timeseries.bucketed(
        _meds(spark, d), ["stay_id", "itemid"], 4, r6(F.max("stop") / 4).alias("stop"), r6(F.avg("amount")).alias("dose"), r6(F.avg("rate")).alias("rate")
    )


@query(f"WITH {_MEDS} SELECT stay_id, itemid, orderid, start, least(stop, 24) AS stop, count(*) AS n FROM s WHERE los >= 30 AND start BETWEEN 0 AND 24 GROUP BY ALL")
def horizon_first(spark: SparkSession, d: str) -> DataFrame:
    """Drugs of the first day of stays of 30 hours or more."""
    out = timeseries.first_horizon(_meds(spark, d), _stays(spark, d), "stay_id", 24, 6)
    return out.groupBy("stay_id", "itemid", "orderid", "start", "stop").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MEDS} SELECT stay_id, itemid, orderid, greatest(start - (los - 24), 0) AS start, stop - (los - 24) AS stop, count(*) AS n FROM s WHERE los >= 24 AND stop - (los - 24) >= 0 GROUP BY ALL")
def horizon_last(spark: SparkSession, d: str) -> DataFrame:
    """Drugs of the last day of stays of a day or more."""
    out = timeseries.last_horizon(_meds(spark, d), _stays(spark, d), "stay_id", 24)
    return out.groupBy("stay_id", "itemid", "orderid", "start", "stop").agg(F.count(F.lit(1)).alias("n"))


_MED_CELLS = f"""{_MEDS},
c AS (SELECT stay_id, itemid, start // 4 AS bucket, max(stop) / 4.0 AS stop, avg(amount) AS dose FROM s WHERE start BETWEEN 0 AND 23 GROUP BY 1, 2, 3),
g AS (SELECT stay_id, itemid, unnest(range(6)) AS bucket FROM (SELECT DISTINCT stay_id, itemid FROM c)),
f AS (SELECT g.*, coalesce(last_value(stop IGNORE NULLS) OVER w, 0) AS stop, coalesce(last_value(dose IGNORE NULLS) OVER w, -1) AS dose
      FROM g LEFT JOIN c USING (stay_id, itemid, bucket) WINDOW w AS (PARTITION BY stay_id, itemid ORDER BY bucket ROWS UNBOUNDED PRECEDING)),
x AS (SELECT stay_id, itemid, bucket, CASE WHEN stop - bucket > 0 THEN 1 ELSE 0 END AS signal, CASE WHEN stop - bucket > 0 THEN dose ELSE 0 END AS value FROM f)
"""


def _med_grid(spark: SparkSession, d: str) -> DataFrame:
    cells = timeseries.bucketed(_meds(spark, d).where("start < 24"), ["stay_id", "itemid"], 4, (F.max("stop") / 4).alias("stop"), F.avg("amount").alias("dose"))
    return timeseries.med_grid(cells, ["stay_id", "itemid"], 6)


@query(f"WITH {_MED_CELLS} SELECT stay_id, itemid, bucket, signal, round(value, 6) AS value FROM x")
def dense_grid_meds(spark: SparkSession, d: str) -> DataFrame:
    """Drugs of the first day on a dense grid."""
    return _med_grid(spark, d).select("stay_id", "itemid", "bucket", "signal", r6("value").alias("value"))


_LABS = """
c AS (SELECT hadm_id, itemid, floor((epoch_us(charttime) - epoch_us(a)) / 3600000000)::BIGINT // 6 AS bucket, avg(valuenum) AS value
      FROM labevents JOIN (SELECT hadm_id, min(admittime) AS a FROM admissions WHERE hadm_id IS NOT NULL GROUP BY 1) USING (hadm_id)
      WHERE valuenum IS NOT NULL AND epoch_us(charttime) >= epoch_us(a) AND epoch_us(charttime) < epoch_us(a) + 172800000000 GROUP BY 1, 2, 3)
"""


def _lab_cells(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "admissions").where("hadm_id is not null").groupBy("hadm_id").agg(F.min("admittime").alias("a"))
    ev = table(spark, d, "labevents").where("valuenum is not null").join(first, "hadm_id").withColumn("start", cohort.whole_hours(F.col("charttime"), F.col("a")))
    return timeseries.bucketed(ev.where("start between 0 and 47"), ["hadm_id", "itemid"], 6, F.avg("valuenum").alias("value"))


@query(f"WITH {_LABS} SELECT hadm_id, itemid, bucket, round(value, 6) AS value FROM c")
def bucket_labs(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each item by bucket of six hours from admission."""
    return _lab_cells(spark, d).select("hadm_id", "itemid", "bucket", r6("value").alias("value"))


@query(f"""
WITH {_LABS},
g AS (SELECT hadm_id, itemid, unnest(range(8)) AS bucket FROM (SELECT DISTINCT hadm_id, itemid FROM c))
SELECT hadm_id, itemid, bucket, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS signal,
  round(coalesce(last_value(value IGNORE NULLS) OVER w, first_value(value IGNORE NULLS) OVER b, 0), 6) AS value
FROM g LEFT JOIN c USING (hadm_id, itemid, bucket)
WINDOW w AS (PARTITION BY hadm_id, itemid ORDER BY bucket ROWS UNBOUNDED PRECEDING),
       b AS (PARTITION BY hadm_id, itemid ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""")
def lab_impute(spark: SparkSession, d: str) -> DataFrame:
    """Measurements on a dense grid, filled forward and then backward."""
    return timeseries.lab_grid(_lab_cells(spark, d), ["hadm_id", "itemid"], 8).select("hadm_id", "itemid", "bucket", "signal", r6("value").alias("value"))


#: The drugs of the fixed table of items.
DRUGS = range(920001, 920015)


def drugs(spark: SparkSession, d: str) -> list[int]:
    """All drugs of the fixed table of items; an error if the SQL doesn't name them all."""
    found = sorted(r[0] for r in table(spark, d, "d_items").where("category = 'drug'").select("itemid").collect())
    if found != list(DRUGS):
        raise ValueError(f"drugs are {found}")
    return found


@query(f"WITH {_MED_CELLS} SELECT stay_id, " + ", ".join(f"round(coalesce(avg(CASE WHEN itemid = {i} THEN value END), 0), 6) AS i{i}" for i in DRUGS) + " FROM x GROUP BY 1")
def grid_collapse(spark: SparkSession, d: str) -> DataFrame:
    """The grid as one row a stay, with a column for each drug."""
    names = drugs(spark, d)
    wide = timeseries.collapse(_med_grid(spark, d), "stay_id", "itemid", "value", names)
    return wide.select("stay_id", *[r6(f"`{i}`").alias(f"i{i}") for i in names])


@query("""
WITH e AS (SELECT o_custkey, o_orderdate::DATE AS day, list_sort(list_distinct(flatten(list(c)))) AS codes FROM (
  SELECT o_custkey, o_orderdate, coalesce((SELECT list(DISTINCT p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey), []) AS c FROM orders) GROUP BY 1, 2),
w AS (SELECT *, coalesce(date_diff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day), 0) AS delta FROM e)
SELECT o_custkey, string_agg(delta || ':' || array_to_string(codes, ','), ' ' ORDER BY day) AS sequence FROM w GROUP BY 1
""")
def visit_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Each patient's visits as days since the last one and codes."""
    codes = _events(spark, d).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("codes"))
    v = table(spark, d, "orders").join(codes, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    s = visits.visit_sequences(v, "o_custkey", "o_orderdate", "codes")
    text = F.transform("sequence", lambda x: F.concat(x["delta_days"].cast("string"), F.lit(":"), F.array_join(x["codes"], ",")))
    return s.select("o_custkey", F.array_join(text, " ").alias("sequence"))


def _flag(pattern: str) -> str:
    return f"len(list_filter(c, lambda x: regexp_matches(x, '{pattern}'))) > 0"


@query(f"""
WITH l AS (SELECT pair_id, lower(coalesce(medications_current, '')) AS m, list_transform(string_split(coalesce(diagnoses_codes_current, ''), ';'), lambda x: left(regexp_replace(x, '[^0-9]', '', 'g'), 5)) AS c FROM test)
SELECT pair_id, {', '.join(f'{_flag(p)} AS {n}' for n, p in CONDITIONS.items())}, contains(m, 'statin') AS statin,
  {_flag(CONDITIONS['ischemic_heart'])} OR {_flag(CONDITIONS['heart_failure'])} OR {_flag(CONDITIONS['atherosclerosis'])} AS cardiovascular,
  ({' + '.join(f'({_flag(CONDITIONS[n])})::INT' for n in ('diabetes', 'obesity', 'dyslipidemia', 'hypertension'))}) >= 3 AS metabolic FROM l
""")
def comorbidity_flags(spark: SparkSession, d: str) -> DataFrame:
    """Conditions told by code prefixes, and a drug by its name."""
    codes = F.transform(split_codes(F.col("diagnoses_codes_current")), lambda x: F.left(F.regexp_replace(x, "[^0-9]", ""), F.lit(5)))
    flags = table(spark, d, "test").withColumn("c", codes).select(
        "pair_id", *[has_code(F.col("c"), p).alias(n) for n, p in CONDITIONS.items()],
        F.lower(F.coalesce("medications_current", F.lit(""))).contains("statin").alias("statin"),
    )
    four = sum((F.col(n).cast("int") for n in ("diabetes", "obesity", "dyslipidemia", "hypertension")), F.lit(0))
    return flags.withColumn("cardiovascular", F.col("ischemic_heart") | F.col("heart_failure") | F.col("atherosclerosis")).withColumn("metabolic", four >= 3)


@query("""
SELECT pair_id, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(left(t, 118), '\\s+$', '') || ' …' END AS short,
  CASE WHEN length(n) > 80 THEN left(n, 80) || '...' ELSE n END AS cut
FROM (SELECT pair_id, narrative_current AS n, regexp_replace(regexp_replace(coalesce(narrative_current, ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM test)
""")
def narrative_short(spark: SparkSession, d: str) -> DataFrame:
    """Narratives collapsed and cut."""
    return table(spark, d, "test").select("pair_id", collapsed(F.col("narrative_current"), 120).alias("short"), truncated(F.col("narrative_current"), 80).alias("cut"))


@query("""
SELECT stay_id, (least(120, greatest(0, year(intime) - 2060)) // 10 * 10) || '-' || (least(120, greatest(0, year(intime) - 2060)) // 10 * 10 + 9) AS decade FROM visits_iv WHERE intime IS NOT NULL
""")
def age_decades(spark: SparkSession, d: str) -> DataFrame:
    """Decade of age at a stay, for a birth in 2060."""
    return table(spark, d, "visits_iv").where("intime is not null").select("stay_id", age_decade(F.lit("2060-01-01").cast("date"), F.col("intime")).alias("decade"))


@query("""
SELECT count(*) AS rows, 7 AS columns, unnest(['doc_id','text','lang','source','n_chars','note_type','hadm_id']) AS "column",
  unnest([count(*) - count(doc_id), count(*) - count(text), count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars), count(*) - count(note_type), count(*) - count(hadm_id)]) AS nulls FROM documents
""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns and nulls of a table."""
    return profile(table(spark, d, "documents"))


@query("SELECT event_type, count(*) AS n, round(avg(json_extract(props, '$.k')::DOUBLE), 6) AS mean_k FROM events GROUP BY 1")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    """A value within JSON text."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.get_json_object("props", "$.k").cast("double"))).alias("mean_k"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour, with the function that also serves streams."""
    from vitalake.streaming.buckets import windowed

    w = windowed(table(spark, d, "events"), "ts", ["event_type"], "value")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r6("mean").alias("mean"))


@query(f"SELECT stay_id, count(t) AS n, min(t) // 1000000 AS first_s, max(t) // 1000000 AS last_s FROM (SELECT stay_id, {_T} AS t FROM (SELECT stay_id, start_hours_from_admit AS s FROM preproc_med_icu)) GROUP BY 1")
def offsets_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Offsets written in several ways, in seconds."""
    t = duration_micros(F.col("start_hours_from_admit"))
    return table(spark, d, "preproc_med_icu").select("stay_id", F.floor(t / 1_000_000).alias("t")).groupBy("stay_id").agg(
        F.count("t").alias("n"), F.min("t").alias("first_s"), F.max("t").alias("last_s")
    )
