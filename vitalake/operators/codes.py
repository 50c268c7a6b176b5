"""Codes of diagnoses, procedures and drugs: filters, grouping, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.functions.text import epc_items, ndc_key, ndc_table_key, strip
from vitalake.operators.checked import distinct_on


def without_prefixes(df: DataFrame, code: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose code begins with none of ``prefixes``; a null code is kept."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.coalesce(F.col(code).startswith(p), F.lit(False))
    return df.where(~hit)


def of_versions(df: DataFrame, version: str, versions: Sequence[int] | None = None) -> DataFrame:
    """Rows of these versions of a code system; None keeps all."""
    return df if versions is None else df.where(F.col(version).isin(list(versions)))


def grouped_code(choice: str, raw: Column, converted: Column, root_length: int = 3) -> Column:
    """A code by the chosen grouping: ``raw``, ``converted`` or ``root``, the first signs of the converted one."""
    ways = {"raw": raw, "converted": converted, "root": F.left(converted, F.lit(root_length))}
    if choice not in ways:
        raise ValueError(f"unknown grouping {choice}")
    return ways[choice]


def described(events: DataFrame, dictionary: DataFrame, code: str, title: str) -> DataFrame:
    """``events`` with ``title``, by the code alone: a code of several entries gives several rows, one without an entry none."""
    return events.join(dictionary.select(code, title), code)


def titled(events: DataFrame, dictionary: DataFrame, code: str, long: str, short: str, name: str = "title") -> DataFrame:
    """``events`` with the long title of the code, else the short one, else the code; of several entries the first by title."""
    ours = distinct_on(dictionary.select(code, long, short).where(F.col(code).isNotNull()), [code], [long, short])
    blank = lambda c: F.when(strip(F.col(c)) != "", F.col(c))
    return events.join(ours, code, "left").withColumn(name, F.coalesce(blank(long), blank(short), F.col(code).cast("string"))).drop(long, short)


def drug_name(c: Column) -> Column:
    """A drug's name in one spelling: lower case, stripped, spaces as underscores; null gives ''."""
    return F.replace(strip(F.lower(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit("_"))


def drug_classes(prescriptions: DataFrame, products: DataFrame, number: str, product: str, name: str, classes: str) -> DataFrame:
    """``prescriptions`` with the non-proprietary name and the established classes of the drug, by the nine-digit key.

    ``number`` is the drug code as a number, whose zeros at the front are lost; ``product`` the code labeler-product. Of a
    key, each distinct name gives a row, with the first of its classes; prescriptions without a match are left out.
    Columns added: ``drug_key``, ``generic`` (lower case, null as ''), ``established`` (array).
    """
    known = products.select(
        ndc_table_key(F.col(product)).alias("drug_key"), F.lower(F.coalesce(F.col(name), F.lit(""))).alias("generic"), F.col(classes).alias("c"), product
    ).where(F.col("drug_key").isNotNull())
    once = distinct_on(known, ["drug_key", "generic"], [product, "c"]).select("drug_key", "generic", epc_items(F.col("c")).alias("established"))
    return prescriptions.withColumn("drug_key", ndc_key(F.col(number))).join(once, "drug_key")


def generic_name(prescriptions: DataFrame, products: DataFrame, code: str, product: str, name: str) -> DataFrame:
    """``prescriptions`` with ``generic``, the first name of the product that the first two sections of the code tell; null if there is none."""
    first = distinct_on(products.select(F.col(product).alias("__p"), F.col(name).alias("generic")).where("__p is not null"), ["__p"], ["generic"])
    return prescriptions.withColumn("__p", F.substring_index(F.col(code), "-", 2)).join(first, "__p", "left").drop("__p")


def list_literal(c: Column) -> Column:
    """A list of texts written as a literal, with single or double quotes, as an array; what can't be read is null."""
    return F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})


def safe_days(later: Column, earlier: Column, most: int = 106_751) -> Column:
    """Whole days between two times; null where either is null or they are more than ``most`` days apart."""
    days = F.datediff(F.to_date(later), F.to_date(earlier))
    return F.when(F.abs(days) <= most, days)
