"""Text and code expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends, tabs and line ends included (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_title(c: Column) -> Column:
    """A code's title without white space at the ends and ``;`` or ``,`` at its end; null gives ''."""
    return F.coalesce(strip(F.regexp_replace(strip(c), r"[;,]+$", "")), F.lit(""))


def split_codes(c: Column, pattern: str = ";") -> Column:
    """Codes of a joined list, stripped, without blanks and the word nan."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), pattern), strip)
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def join_items(items: Column, most: int | None = None, sep: str = "; ") -> Column:
    """Distinct items in first-seen order, joined; ``most`` of None or 0 is no limit."""
    once = F.array_distinct(items)
    return F.concat_ws(sep, F.slice(once, 1, most) if most else once)


def truncated(c: Column, most: int, marker: str = "...") -> Column:
    """Text of ``most`` signs at most, with ``marker`` where it was cut."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(marker))).otherwise(c)


def collapsed(c: Column, most: int = 900) -> Column:
    """White space collapsed, cut to ``most`` signs with an ellipsis; null gives ''."""
    s = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(s) <= most, s).otherwise(
        F.concat(F.regexp_replace(F.left(s, F.lit(most - 2)), r"\s+$", ""), F.lit(" …"))
    )


def has_code(codes: Column, pattern: str) -> Column:
    """Whether any code of an array matches ``pattern``; null gives false."""
    return F.coalesce(F.exists(codes, lambda x: x.rlike(pattern)), F.lit(False))


def code_prefix5(c: Column) -> Column:
    """The first five digits of a code."""
    return F.left(F.regexp_replace(c, "[^0-9]", ""), F.lit(5))


#: Code prefixes of a few conditions; fixed values.
CONDITIONS = {
    "diabetes": "^250",
    "obesity": "^2780",
    "dyslipidemia": "^272",
    "hypertension": "^40[1-5]",
    "ischemic_heart": "^41[0-4]",
    "heart_failure": "^428",
    "atherosclerosis": "^440",
}


def padded(c: Column, width: int) -> Column:
    """Zeros before ``c`` up to ``width``; longer text stays whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def ndc_key(c: Column) -> Column:
    """Nine-digit key of a drug code given as a number; negative gives null."""
    return F.when(c >= 0, F.left(padded(c.cast("string"), 11), F.lit(9)))


def ndc_table_key(c: Column) -> Column:
    """Nine-digit key of a drug code given as labeler-product."""
    return F.concat(padded(F.split_part(c, F.lit("-"), F.lit(1)), 5), padded(F.split_part(c, F.lit("-"), F.lit(2)), 4))


def epc_items(c: Column) -> Column:
    """Established pharmacologic classes in a list of classes."""
    return F.filter(F.split(c, ","), lambda x: x.contains("[EPC]"))


def age_decade(birth: Column, at: Column) -> Column:
    """``60-69`` from the difference of years, within 0 to 120."""
    age = F.least(F.lit(120), F.greatest(F.lit(0), F.year(at) - F.year(birth)))
    low = (F.floor(age / 10) * 10).cast("bigint")
    return F.when(age.isNotNull(), F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))


def age_bin(age: Column) -> Column:
    """``60-70`` for ages from 60 to 69; null stays null."""
    low = (F.floor(age / 10) * 10).cast("bigint")
    return F.when(age.isNotNull(), F.concat(low.cast("string"), F.lit("-"), (low + 10).cast("string")))


def log2_odds(p: Column) -> Column:
    """The logarithm to base 2 of the odds; null at 0 and 1."""
    return F.when((p > 0) & (p < 1), F.log2(p / (1 - p)))


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    """The probability of a logit divided by ``temperature``."""
    return 1 / (1 + F.exp(-x / F.lit(temperature)))


def exact_round(x: Column, places: int) -> Column:
    """``x`` rounded by its exact binary value, ties to even, as Python does: 2.675 to two places is 2.67.

    The number is taken apart into a whole number times a power of two, so remainders are compared exactly.
    Null, infinite and NaN stay as they are.
    """
    size = F.abs(x)
    # One bit more than needed, as the logarithm may be off by one.
    power = F.lit(54) - F.floor(F.log2(F.when(size > 0, size)))
    whole = (size * F.pow(F.lit(2.0), power)).cast("decimal(38,0)") * F.lit(10**places).cast("decimal(6,0)")
    unit = F.pow(F.lit(2.0), power).cast("decimal(38,0)")
    whole = whole.cast("decimal(38,0)")
    rest = whole % unit
    low = ((whole - rest) / unit).cast("decimal(38,0)")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (low % 2 == 1))
    # To a double by its digits, so that the result is the nearest one.
    digits = (low + up.cast("int")).cast("decimal(38,0)")
    text = F.concat(digits.cast("string"), F.lit(f"E-{places}")).cast("double")
    return F.when(F.isnan(x) | (size >= 2.0**52) | (size == 0), x).when(power > 100, F.lit(0.0)).otherwise(F.signum(x) * text)
