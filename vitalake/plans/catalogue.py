"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalake.plans import cohort_queries, data_problems, data_problems_sql, evaluation_queries, input_queries, join_queries, more_queries

_PARTS = (cohort_queries, evaluation_queries, more_queries, join_queries, input_queries)
QUERIES = data_problems.QUERIES | {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = data_problems_sql.ORACLE_SQL | {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return cohort_queries.next_label_prevalence(spark, folder)
