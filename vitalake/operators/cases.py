"""Records of chosen cases: tags, summary, evidence and explanation, with checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.functions.text import CONDITIONS, code_prefix5, collapsed, exact_round, has_code, split_codes
from vitalake.operators.metrics import confidence_tags

#: Sentences of the explanation by kind of case and signal; fixed values.
EXPLANATIONS = {
    "TP_code": "Prediction aligns with lipid-related signals in the record, including dyslipidemia-related diagnosis codes.",
    "TP_drug": "Prediction aligns with lipid-related signals in the record, including statin therapy on the medication list.",
    "TP_risk": "Prediction likely driven by metabolic risk factors (e.g., diabetes or clustered cardiometabolic diagnoses).",
    "TP": "Prediction likely driven by clinical cues in the narrative or code list suggestive of lipid disorder risk.",
    "TN": "No strong indicators of lipid disorder in structured codes relative to the task label (negative next-visit lipid disorder).",
    "FP_drug": "Model may rely on indirect signals such as statin therapy or cardiovascular medications without a documented dyslipidemia label at the next visit.",
    "FP": "Model may be over-reading cardiometabolic context or narrative phrasing as lipid-disorder risk.",
    "FN_none": "Possible miss due to sparse explicit lipid-related codes or therapies in the current-admission snapshot.",
    "FN": "Despite some lipid-adjacent signals, the model underweighted evidence; calibration or label timing ambiguity may contribute.",
}


def case_type(pred: Column, y: Column) -> Column:
    """TP, TN, FP or FN; UNKNOWN where either isn't 0 or 1."""
    return (
        F.when((pred == 1) & (y == 1), "TP").when((pred == 0) & (y == 0), "TN").when((pred == 1) & (y == 0), "FP").when((pred == 0) & (y == 1), "FN").otherwise("UNKNOWN")
    )


def flagged(df: DataFrame, codes: str, drugs: str) -> DataFrame:
    """``df`` with ``codes`` as an array, the conditions that it tells, ``statin``, ``cardiovascular`` and ``metabolic``."""
    df = df.withColumn("code_list", split_codes(F.col(codes))).withColumn("__c", F.transform("code_list", code_prefix5))
    df = df.withColumns({n: has_code(F.col("__c"), p) for n, p in CONDITIONS.items()} | {"statin": F.lower(F.coalesce(F.col(drugs), F.lit(""))).contains("statin")})
    four = sum((F.col(n).cast("int") for n in ("diabetes", "obesity", "dyslipidemia", "hypertension")), F.lit(0))
    heart = F.col("ischemic_heart") | F.col("heart_failure") | F.col("atherosclerosis")
    return df.withColumns({"cardiovascular": heart, "metabolic": four >= 3}).drop("__c")


def explanation(kind: Column) -> Column:
    """Why the model may have answered so, by the kind of case and the signals of ``flagged``."""
    say = lambda k: F.lit(EXPLANATIONS[k])
    tp = F.when(F.col("dyslipidemia"), say("TP_code")).when(F.col("statin"), say("TP_drug")).when(F.col("metabolic") | F.col("diabetes"), say("TP_risk")).otherwise(say("TP"))
    fn = F.when(~F.col("dyslipidemia") & ~F.col("statin"), say("FN_none")).otherwise(say("FN"))
    return (
        F.when(kind == "TP", tp).when(kind == "TN", say("TN")).when(kind == "FP", F.when(F.col("statin"), say("FP_drug")).otherwise(say("FP")))
        .when(kind == "FN", fn).otherwise("See structured evidence and narrative for manual review.")
    )


def evidence(most: int = 12) -> Column:
    """The first codes, the rules that apply, and whether a drug hints at the condition."""
    sample = F.concat(F.array_join(F.slice("code_list", 1, most), "; "), F.when(F.size("code_list") > most, " …").otherwise(""))
    names = ("diabetes", "obesity", "dyslipidemia", "cardiovascular", "metabolic")
    rules = F.array_join(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names])), ", ")
    drug = F.when(F.col("statin"), "Statin or lipid-lowering therapy mentioned in medication list.").otherwise("No statin keyword hit in medication list (keyword rule).")
    return F.concat(
        F.lit("Diagnosis codes (sample): "), sample, F.lit(". Rule flags: ["), F.when(rules == "", "none").otherwise(rules), F.lit("]. "), drug
    )


def case_records(df: DataFrame, key: str, pred: str, y: str, score: str, codes: str, drugs: str, text: str, signs: int = 900) -> DataFrame:
    """A record for each row: case, labels, probability to four places, tags, evidence, explanation and the text cut short."""
    kind = case_type(F.col(pred), F.col(y))
    return flagged(df, codes, drugs).select(
        F.col(key).cast("string").alias("case_id"), F.col(y).alias("true_label"), F.col(pred).alias("predicted_label"), exact_round(F.col(score), 4).alias("probability"),
        kind.alias("case_type"), F.array_join(confidence_tags(F.col(score)), ",").alias("tags"), evidence().alias("evidence"), explanation(kind).alias("explanation"),
        collapsed(F.col(text), signs).alias("excerpt"),
    )


def check_records(records: DataFrame, per_kind: int) -> DataFrame:
    """``records`` itself; a ValueError unless each kind has ``per_kind`` records and all are within bounds and have their texts."""
    r = records.groupBy("case_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.coalesce(F.col("probability").between(0, 1), F.lit(False)) | (F.col("evidence") == "") | (F.col("explanation") == "")).cast("int")).alias("bad")
    ).collect()  # five rows at most
    n = {x["case_type"]: x["n"] for x in r}
    if any(n.get(k, 0) != per_kind for k in ("TP", "TN", "FP", "FN")) or any(x["bad"] for x in r):
        raise ValueError(f"records don't hold: {n}, wrong ones {sum(x['bad'] for x in r)}")
    return records
