"""Queries p1, p7, p8, p9 and p10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.llm.bpe import encode_texts, token_counts
from vitalake.llm.mojibake import restore_texts
from vitalake.llm.packing import pack
from vitalake.llm.responses import flag_responses
from vitalake.llm.splits import PROPORTIONS, SPLITS, grouped_split, pair_groups
from vitalake.sources.tables import spread, table


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    return flag_responses(spread(table(spark, folder, "raw_llm_responses").select("response_id", "prompt", "text", "finish_reason")))


def p1_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Each defective response with every defect found, one a row."""
    return _flagged(spark, folder).select("response_id", F.explode("defects").alias("defect"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each defective response with its defect."""
    return _flagged(spark, folder).select("response_id", "defect")


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return pair_groups(table(spark, folder, "test"), table(spark, folder, "admissions"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs in a group of two or more, with the smallest pair of the group."""
    others = _groups(spark, folder).where("pair_id <> group_pair_id")
    # The smallest pair of each group is named by the others.
    return others.select(F.explode(F.array("pair_id", "group_pair_id")).alias("pair_id"), "group_pair_id").distinct()


def p7_split(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs with their split."""
    groups = _groups(spark, folder).select(F.col("pair_id").alias("id"), F.col("group_pair_id").alias("root"))
    labels = table(spark, folder, "test").select(F.col("pair_id").alias("id"), F.col("label_lipid_disorder").alias("label"))
    return grouped_split(groups, labels).select(
        F.col("id").alias("pair_id"), F.col("root").alias("group_pair_id"), "split"
    )


def p7_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, groups, groups in more than one split, and whether each split's share is within 0.02 of what is asked for."""
    split = p7_split(spark, folder)
    torn = split.groupBy("group_pair_id").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("n_groups"), F.sum((F.col("splits") > 1).cast("bigint")).alias("torn")
    )
    share = {n: F.avg((F.col("split") == n).cast("double")) for n in SPLITS}
    near = [F.abs(share[n] - p) < 0.02 for n, p in zip(SPLITS, PROPORTIONS, strict=True)]
    return torn.crossJoin(split.agg((near[0] & near[1] & near[2]).alias("near")))  # one row each


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document."""
    return encode_texts(table(spark, folder, "documents"))


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each part of one that is too long."""
    return pack(token_counts(table(spark, folder, "documents")))


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Affected documents with their restored text."""
    return restore_texts(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which a part was decoded wrongly."""
    return p10_restored(spark, folder).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_defects": p1_defects,
    "p7_found": p7_found,
    "p7_split": p7_split,
    "p7_integrity": p7_integrity,
    "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

_REACH = """
WITH RECURSIVE keys AS (
  SELECT pair_id, subject_id FROM test WHERE subject_id IS NOT NULL
  UNION SELECT pair_id, a.subject_id FROM test JOIN admissions a ON a.hadm_id IN (hadm_id_current, hadm_id_next)
  WHERE a.subject_id IS NOT NULL),
links AS (SELECT DISTINCT x.pair_id AS a, y.pair_id AS b FROM keys x JOIN keys y USING (subject_id)),
reach AS (
  SELECT a, b FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS pair_id, min(b) AS group_pair_id, count(*) AS n FROM reach GROUP BY 1)
"""

ORACLE_SQL = {
    "p7_found": f"{_REACH} SELECT pair_id, group_pair_id FROM groups WHERE n > 1",
    "p7_integrity": f"""{_REACH}
SELECT count(*) AS pairs, count(DISTINCT coalesce(group_pair_id, pair_id)) AS n_groups, 0::BIGINT AS torn, true AS near FROM test LEFT JOIN groups USING (pair_id)
""",
}
