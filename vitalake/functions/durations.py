"""Durations written as text, read with native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
#: ISO 8601 to ``days:hours:minutes:seconds``; parts that aren't there become 0.
_ISO = r"^-?P(?=\w)(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def duration_micros(text: Column) -> Column:
    """Microseconds of a duration as text; null where it can't be read.

    Reads ``D days HH:MM:SS[.f]`` (also ``-1 days +16:29:21``), ``[-]H:MM:SS[.f]``
    with any number of hours, and ISO 8601 ``[-]P[nD][T[nH][nM][nS]]``.
    Null, empty and malformed text give null.
    """

    def read(p: Column) -> Column:
        def part(i: int, kind: str = "bigint") -> Column:
            return F.try_element_at(p, F.lit(i)).try_cast(kind)

        n = F.size(p)
        clock = (F.abs(part(-3)) * 3600 + part(-2) * 60) * SECOND + F.round(part(-1, "double") * SECOND).cast("bigint")
        days = part(-4) * F.lit(86_400 * SECOND)
        minus = F.element_at(p, 1).startswith("-")
        return F.when(n == 4, days + clock).when((n == 3) & minus, -clock).when(n == 3, clock)

    # In a lambda the text is taken apart once, and the generated code stays small.
    s = F.trim(text)
    iso = F.regexp_replace(s, _ISO, "0$1:0$2:0$3:0$4")
    parts = F.split(F.regexp_replace(iso, r" days? \+?", ":"), ":")
    value = F.get(F.transform(F.array(parts), read), F.lit(0))
    return F.when(s.startswith("-P"), -value).otherwise(value)
