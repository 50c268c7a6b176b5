"""Quantities recorded in different units, brought to one unit each."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of a unit, by the first one; fixed values.
SPELLINGS = [
    ["mg/dL", "mg%", "mg per dL", "mgs/dL", "mg/100mL"],
    ["g/dL", "g%", "gm/dL", "gm%", "g per dL", "grams per decilitre", "grams per deciliter"],
    ["g/L", "gm/L", "g per L", "grams per litre", "grams per liter"],
    ["mg/L", "mg per L", "mcg/mL", "ug/mL"],
    ["mmol/L", "mM", "millimol/L", "mmol per L", "mmols/L"],
    ["umol/L", "mcmol/L", "micromol/L", "uM", "umol per L"],
    ["mEq/L", "meq per L"],
    ["ng/L", "pg/mL", "ng per L"],
    ["ng/mL", "ug/L", "mcg/L", "ng per mL"],
    ["K/uL", "x10^3/uL", "10^3/uL", "10*3/uL", "thou/uL", "thousand/uL", "K/mm3", "k per uL"],
    ["cells/uL", "/uL", "per uL", "/mm3", "cells/mm3", "per mm3", "#/uL"],
    ["10^9/L", "x10^9/L", "10e9/L", "x10e9/L", "10*9/L", "x10*9/L", "G/L", "giga/L"],
]
#: Words in the place of a unit that name none; fixed values.
NO_UNIT = ["", "n/a", "na", "none", "-", "--", "unknown", "null", "nan", "?", "."]

#: Conversions that hold for any quantity: from, to, factor, offset; fixed values.
GENERAL = [
    ("g/dL", "g/L", 10.0, 0.0), ("g/L", "mg/L", 1000.0, 0.0), ("mg/dL", "mg/L", 10.0, 0.0), ("mg/L", "ng/mL", 1000.0, 0.0), ("ng/mL", "ng/L", 1000.0, 0.0),
    ("mmol/L", "umol/L", 1000.0, 0.0), ("K/uL", "cells/uL", 1000.0, 0.0), ("10^9/L", "K/uL", 1.0, 0.0), ("degF", "degC", 5 / 9, -160 / 9),
]

TOLERANCE = 1e-6


def spelling_key(name: Column) -> Column:
    """A unit's spelling without case, spaces and the two micro signs."""
    return F.regexp_replace(F.translate(F.lower(name), "µμ×", "uux"), r"[\s\u00a0\u2009\[\]()]+", "")


def _key(name: str) -> str:
    s = name.lower().translate(str.maketrans("µμ×", "uux"))
    return "".join(c for c in s if not c.isspace() and c not in "[]()")


@dataclass(frozen=True)
class Affine:
    """``y = factor * x + offset``."""

    factor: float
    offset: float = 0.0

    def then(self, other: Affine) -> Affine:
        return Affine(other.factor * self.factor, other.factor * self.offset + other.offset)

    def inverse(self) -> Affine:
        return Affine(1 / self.factor, -self.offset / self.factor)

    def near(self, other: Affine) -> bool:
        return math.isclose(self.factor, other.factor, rel_tol=TOLERANCE) and math.isclose(
            self.offset, other.offset, rel_tol=TOLERANCE, abs_tol=TOLERANCE
        )


class UnitGraph:
    """Units as nodes, affine conversions as edges in both directions."""

    def __init__(self) -> None:
        self.edges: dict[object, dict[object, Affine]] = defaultdict(dict)

    def add(self, source: object, target: object, f: Affine) -> None:
        if not f.factor or not math.isfinite(f.factor):
            raise ValueError(f"no conversion from {source} to {target}")
        old = self.edges[source].get(target)
        if old is not None and not old.near(f):
            raise ValueError(f"two conversions from {source} to {target}")
        self.edges[source][target] = f
        self.edges[target].setdefault(source, f.inverse())

    def to(self, target: object) -> dict[object, Affine]:
        """The shortest composition to ``target`` from each unit that reaches it.

        Raises ValueError where two ways to ``target`` disagree, that is where the
        conversions around a cycle don't make the identity.
        """
        found = {target: Affine(1.0)}
        queue = deque([target])
        while queue:
            at = queue.popleft()
            for other in self.edges[at]:
                way = self.edges[other][at].then(found[at])
                if other not in found:
                    found[other] = way
                    queue.append(other)
                elif not found[other].near(way):
                    raise ValueError(f"the ways from {other} to {target} disagree")
        return found


def _names(unit: str) -> list[str]:
    """All spellings of a unit, itself first."""
    return next((s for s in SPELLINGS if _key(unit) in {_key(x) for x in s}), [unit])


def conversions(units: Iterable[tuple], unlisted: bool = False) -> list[tuple]:
    """(item, key, unit, common unit, factor, offset) for each spelling of each unit of an item.

    ``units``: (item, unit, is_common, factor to common). Spellings are nodes of the
    item's graph, with an edge to the unit they spell; so are the units of ``GENERAL`` that are joined to those of the item. Ways
    around a cycle, such as a listed factor and a general one, must agree. A unit of the item goes by the name in
    ``units``; with ``unlisted`` there are rows for the other units, too, in which it may be recorded without being listed.
    """
    by_item: dict[object, list[tuple]] = defaultdict(list)
    for item, unit, common, factor in units:
        by_item[item].append((unit, common, factor))
    rows = []
    for item, own in by_item.items():
        target = next(u for u, common, _ in own if common)
        name = {_key(u): u for u, _, _ in own}
        graph = UnitGraph()
        for a, b, factor, offset in GENERAL:
            ours = [next((name[k] for k in map(_key, _names(x)) if k in name), x) for x in (a, b)]
            graph.add(("unit", ours[0]), ("unit", ours[1]), Affine(factor, offset))
        for unit, _, factor in own:
            graph.add(("unit", unit), ("unit", target), Affine(factor))
        # Spellings of the item's own units come first: G/L of cells isn't g/L.
        taken = set()
        reached = [n for _, n in graph.to(("unit", target))]
        for unit in sorted(reached, key=lambda n: _key(n) not in name):
            for spelling in {_key(x) for x in [unit, *_names(unit)]} - taken:
                graph.add(("spelling", spelling), ("unit", unit), Affine(1.0))
                taken.add(spelling)
        for (kind, spelled), f in graph.to(("unit", target)).items():
            if kind == "spelling":
                unit = next(u for k, u in graph.edges[kind, spelled] if k == "unit")
                if not unlisted and _key(unit) not in name:
                    continue
                rows.append((item, spelled, unit, target, f.factor, f.offset))
    return rows


def harmonise(df: DataFrame, units: DataFrame, key: str = "labevent_id") -> DataFrame:
    """Every number of ``df`` in the common unit of its item.

    ``df``: ``key``, itemid, value (text), valuenum, valueuom. ``units``, a fixed table:
    itemid, uom, is_common, factor_to_common, plausible_low, plausible_high. Columns:
    ``key``, ``itemid``, ``number``, ``uom`` (the unit found, as ``units`` names it),
    ``common_uom``, ``common_value``, ``is_common``, ``found`` (``column``, ``text``,
    ``range``, ``assumed`` or ``unknown``).

    The number is valuenum, or that in the text. The unit is that of valueuom, else
    that in the text; if neither names one, the number tells it where it is outside
    the plausible range of the common unit and inside that of exactly one other,
    and else it counts as common. Rows without a number or of an item not in ``units``
    are left out; a unit that no conversion leads from is ``unknown`` and the row
    has no common value. Repeated rows are kept; an empty table gives an empty one.
    """
    listed = [tuple(r) for r in units.select("itemid", "uom", "is_common", "factor_to_common").collect()]  # fixed table
    spark = df.sparkSession
    edges = F.broadcast(
        spark.createDataFrame(
            conversions(listed, unlisted=True),
            "itemid bigint, unit_key string, uom string, common_uom string, factor double, offset double",
        )
    )
    ranges = units.groupBy("itemid").agg(
        F.max(F.when(F.col("is_common"), F.col("uom"))).alias("common_uom"),
        F.max(F.when(F.col("is_common"), F.col("plausible_low"))).alias("low"),
        F.max(F.when(F.col("is_common"), F.col("plausible_high"))).alias("high"),
        F.collect_list(
            F.when(~F.col("is_common"), F.struct("uom", "plausible_low", "plausible_high"))
        ).alias("others"),
    )
    text = F.trim(F.translate("value", "\u00a0\u2009", "  "))
    number = r"[+-]?(?:\d+(?:[.,]\d+)?|\.\d+)"
    # A unit before the number, a unit after it, or the number alone; signs of comparison may precede.
    # A power of ten that ends a unit isn't a part of the number before it.
    before = rf"^(?:[<>]=?|~)?\s*([^\s\d<>~][^<>]*?|1?0\S*)\s+({number})$"
    after = rf"^(?:[<>]=?|~)?\s*({number}?)\s*((?:[^\d.,\s]|x?10[\^e*E]\d).*)?$"
    is_before = text.rlike(before)
    read = F.when(
        text.rlike(rf"\d"),
        F.struct(
            F.when(is_before, F.regexp_extract(text, before, 2))
            .otherwise(F.regexp_extract(text, after, 1))
            .alias("number"),
            F.when(is_before, F.regexp_extract(text, before, 1))
            .otherwise(F.regexp_extract(text, after, 2))
            .alias("unit"),
        ),
    )
    wordless = F.lower(F.trim("valueuom")).isin(NO_UNIT)
    rows = (
        df.select(F.col(key).alias("__key"), "itemid", "value", F.col("valuenum").cast("double").alias("valuenum"), "valueuom")
        .withColumn("read", read)
        .select(
            "__key",
            "itemid",
            F.coalesce(
                F.when(~F.isnan("valuenum"), F.col("valuenum")),
                F.replace(F.col("read.number"), F.lit(","), F.lit(".")).try_cast("double"),
            ).alias("number"),
            F.when(~wordless, spelling_key(F.col("valueuom"))).alias("column_key"),
            F.when(~F.lower(F.trim("read.unit")).isin(NO_UNIT), spelling_key(F.col("read.unit"))).alias("text_key"),
        )
        .where(F.col("number").isNotNull())
    )
    joined = rows.join(F.broadcast(ranges), "itemid")  # one row an item of the fixed table
    for side in ("column", "text"):
        named = edges.select(
            "itemid",
            F.col("unit_key").alias(f"{side}_key"),
            F.struct("uom", "factor", "offset").alias(f"by_{side}"),
        )
        joined = joined.join(named, ["itemid", f"{side}_key"], "left")
    inside = F.filter(
        "others", lambda o: F.col("number").between(o["plausible_low"], o["plausible_high"])
    )
    told = F.when(
        ~F.col("number").between(F.col("low"), F.col("high")) & (F.size(inside) == 1), F.get(inside, F.lit(0))["uom"]
    )
    none = F.col("column_key").isNull() & F.col("text_key").isNull()
    found = (
        F.when(F.col("by_column").isNotNull(), "column")
        .when(F.col("by_text").isNotNull(), "text")
        .when(none & told.isNotNull(), "range")
        .when(none, "assumed")
        .otherwise("unknown")
    )
    named = joined.select(
        "__key",
        "itemid",
        "number",
        "common_uom",
        found.alias("found"),
        F.coalesce("by_column.uom", "by_text.uom", F.when(none, F.coalesce(told, F.col("common_uom")))).alias("uom"),
    )
    factors = edges.groupBy("itemid", "uom").agg(F.max("factor").alias("factor"), F.max("offset").alias("offset"))
    return named.join(F.broadcast(factors), ["itemid", "uom"], "left").select(
        F.col("__key").alias(key),
        "itemid",
        "number",
        "uom",
        "common_uom",
        (F.col("number") * F.col("factor") + F.col("offset")).alias("common_value"),
        (F.col("uom") == F.col("common_uom")).alias("is_common"),
        "found",
    )
