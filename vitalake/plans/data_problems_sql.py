"""DuckDB SQL of the queries p2 to p5, over whole tables."""

from __future__ import annotations

from vitalake.operators.units import NO_UNIT, SPELLINGS, _key

#: Microseconds of the text forms of a duration in the chart table.
_T = """
CASE WHEN s LIKE 'P%' THEN cast(round(1e6 * (
        86400 * coalesce(try_cast(regexp_extract(s, '(\\d+)D', 1) AS DOUBLE), 0)
      + 3600 * coalesce(try_cast(regexp_extract(s, '(\\d+)H', 1) AS DOUBLE), 0)
      + 60 * coalesce(try_cast(regexp_extract(s, '(\\d+)M', 1) AS DOUBLE), 0)
      + coalesce(try_cast(regexp_extract(s, '([\\d.]+)S', 1) AS DOUBLE), 0))) AS BIGINT)
     WHEN s IS NOT NULL THEN cast(round(1e6 * (
        86400 * coalesce(try_cast(regexp_extract(s, '(-?\\d+) day', 1) AS DOUBLE), 0)
      + 3600 * try_cast(regexp_extract(s, '(\\d+):\\d+:[\\d.]+$', 1) AS DOUBLE)
      + 60 * try_cast(regexp_extract(s, ':(\\d+):', 1) AS DOUBLE)
      + try_cast(regexp_extract(s, ':([\\d.]+)$', 1) AS DOUBLE))) AS BIGINT) END
"""

_CHART = f"""
stand AS (
  SELECT v FROM (
    SELECT valuenum AS v, count(*) AS n, count(DISTINCT itemid) AS items FROM preproc_chart_icu
    WHERE NOT isnan(valuenum) AND (valuenum < (SELECT min(physical_low) FROM d_items) OR valuenum > (SELECT max(physical_high) FROM d_items))
    GROUP BY 1), (
    SELECT count(*) AS rows_, count(DISTINCT itemid) AS all_items FROM preproc_chart_icu
    WHERE NOT isnan(valuenum) AND (valuenum < (SELECT min(physical_low) FROM d_items) OR valuenum > (SELECT max(physical_high) FROM d_items)))
  WHERE n >= 3 AND n >= 0.005 * rows_ AND items >= 0.5 * least(n, all_items)),
chart AS (
  SELECT row_id, stay_id, itemid, valuenum, {_T} AS t,
         valuenum IS NULL OR isnan(valuenum) OR valuenum IN (SELECT v FROM stand) AS missing
  FROM (SELECT *, trim(event_time_from_admit) AS s FROM preproc_chart_icu))
"""

_NAMES = ", ".join(f"({i}, '{k}')" for i, names in enumerate(SPELLINGS) for k in sorted({_key(x) for x in names}))
_NONE = ", ".join(f"'{x}'" for x in NO_UNIT)
_NUMBER = r"[+-]?(?:\d+(?:[.,]\d+)?|\.\d+)"
_BEFORE = rf"^(?:[<>]=?|~)?\s*([^\s\d<>~][^<>]*?|1?0\S*)\s+({_NUMBER})$"
_AFTER = rf"^(?:[<>]=?|~)?\s*({_NUMBER}?)\s*((?:[^\d.,\s]|x?10[\^e*E]\d).*)?$"


def _sql_key(c: str) -> str:
    return rf"regexp_replace(translate(lower({c}), 'µμ×', 'uux'), '[\s\[\]()]+', '', 'g')"


_TOLD = rf"""
WITH names(list, k) AS (VALUES {_NAMES}),
own AS (
  SELECT DISTINCT itemid, uom, {_sql_key('uom')} AS k FROM lab_units
  UNION SELECT DISTINCT itemid, uom, b.k FROM lab_units JOIN names a ON a.k = {_sql_key('uom')} JOIN names b USING (list)),
raw AS (
  SELECT labevent_id, itemid, valuenum, valueuom, trim(value) AS t FROM labevents WHERE itemid IN (SELECT itemid FROM lab_units)),
split AS (
  SELECT *, CASE WHEN NOT regexp_matches(t, '\d') THEN NULL WHEN regexp_matches(t, '{_BEFORE}') THEN regexp_extract(t, '{_BEFORE}', 2) ELSE regexp_extract(t, '{_AFTER}', 1) END AS n,
    CASE WHEN NOT regexp_matches(t, '\d') THEN NULL WHEN regexp_matches(t, '{_BEFORE}') THEN regexp_extract(t, '{_BEFORE}', 1) ELSE regexp_extract(t, '{_AFTER}', 2) END AS u FROM raw),
keyed AS (
  SELECT labevent_id, itemid, coalesce(CASE WHEN NOT isnan(valuenum) THEN valuenum END, try_cast(replace(n, ',', '.') AS DOUBLE)) AS number,
    CASE WHEN lower(trim(valueuom)) NOT IN ({_NONE}) THEN {_sql_key('valueuom')} END AS ck, CASE WHEN lower(trim(u)) NOT IN ({_NONE}) THEN {_sql_key('u')} END AS tk FROM split),
told AS (
  SELECT k.*, (SELECT any_value(uom) FROM own o WHERE o.itemid = k.itemid AND o.k = k.ck) AS cu, (SELECT any_value(uom) FROM own o WHERE o.itemid = k.itemid AND o.k = k.tk) AS tu,
    (SELECT any_value(uom) FROM lab_units l WHERE l.itemid = k.itemid AND is_common) AS common,
    (SELECT any_value(NOT k.number BETWEEN plausible_low AND plausible_high) FROM lab_units l WHERE l.itemid = k.itemid AND is_common) AS off,
    (SELECT count(*) FROM lab_units l WHERE l.itemid = k.itemid AND NOT is_common AND k.number BETWEEN plausible_low AND plausible_high) AS fits,
    (SELECT any_value(uom) FROM lab_units l WHERE l.itemid = k.itemid AND NOT is_common AND k.number BETWEEN plausible_low AND plausible_high) AS fit
  FROM keyed k WHERE number IS NOT NULL)
"""
_UNIT = "coalesce(cu, tu, CASE WHEN ck IS NULL AND tk IS NULL THEN CASE WHEN off AND fits = 1 THEN fit ELSE common END END)"
_WAY = "CASE WHEN cu IS NOT NULL THEN 'column' WHEN tu IS NOT NULL THEN 'text' WHEN ck IS NULL AND tk IS NULL THEN CASE WHEN off AND fits = 1 THEN 'range' ELSE 'assumed' END ELSE 'unknown' END"

ORACLE_SQL = {
    "p5_found": f"{_TOLD} SELECT labevent_id, uom FROM (SELECT labevent_id, common, {_UNIT} AS uom FROM told) WHERE uom <> common",
    "p5_ways": f"{_TOLD} SELECT itemid, {_WAY} AS found, count(*) AS n FROM told GROUP BY 1, 2",
    "p5_converted": f"""{_TOLD},
u AS (SELECT labevent_id, itemid, number, {_UNIT} AS uom, common AS common_uom, {_WAY} AS found FROM told)
SELECT labevent_id, u.itemid, number, u.uom, common_uom, number * factor_to_common AS common_value, u.uom = common_uom AS is_common, found
FROM u LEFT JOIN lab_units l ON l.itemid = u.itemid AND l.uom = u.uom
""",
    "p2_found": f"""
WITH {_CHART},
slots AS (
  SELECT DISTINCT stay_id, itemid, t // (grid_minutes * 60000000::BIGINT) AS slot
  FROM chart JOIN d_items USING (itemid) WHERE NOT missing AND t >= 0),
linked AS (
  SELECT *, lead(slot) OVER (PARTITION BY stay_id, itemid ORDER BY slot) AS following FROM slots)
SELECT stay_id, itemid, unnest(range(slot + 1, following)) AS slot FROM linked WHERE following > slot + 1
""",
    "p2_series": f"""
WITH {_CHART},
r AS (SELECT stay_id, itemid, t // (grid_minutes * 60000000::BIGINT) AS slot, t, valuenum AS v FROM chart JOIN d_items USING (itemid) WHERE NOT missing AND t >= 0),
s AS (SELECT stay_id, itemid, slot, count(*) AS n, avg(v) AS mean, arg_max(v, (t, v)) AS latest FROM r GROUP BY 1, 2, 3),
l AS (SELECT *, lead(slot) OVER (PARTITION BY stay_id, itemid ORDER BY slot) AS following FROM s)
SELECT stay_id, itemid, slot, n, round(mean, 6) AS value, 'observed' AS status FROM s
UNION ALL SELECT stay_id, itemid, unnest(range(slot + 1, following)), 0, round(latest, 6), 'uncovered' FROM l WHERE following > slot + 1
""",
    "p2_counter": """
WITH g AS (
  SELECT DISTINCT stay_id, itemid, orderid, epoch_us(starttime) AS s, epoch_us(endtime) AS e, amount FROM preproc_med_icu
  WHERE amount > 0 AND endtime > starttime AND stay_id IS NOT NULL),
o AS (SELECT stay_id, min(s) AS origin FROM g GROUP BY 1),
-- Each span by itself: the amount given by a time is the sum of the parts of all spans up to it.
spans AS (SELECT stay_id, itemid, s - origin AS s, e - origin AS e, amount FROM g JOIN o USING (stay_id)),
b AS (SELECT stay_id, itemid, s AS t FROM spans UNION SELECT stay_id, itemid, e FROM spans),
total AS (
  SELECT b.stay_id, b.itemid, t, sum(amount * greatest(0, least(t, e) - s) / (e - s)::DOUBLE) AS v FROM b JOIN spans USING (stay_id, itemid) GROUP BY 1, 2, 3),
seen AS (SELECT stay_id, itemid, t // 3600000000 AS slot, count(*) AS n, arg_max(v, t) AS v FROM total GROUP BY 1, 2, 3),
slots AS (SELECT stay_id, itemid, unnest(range(min(slot), max(slot) + 1)) AS slot FROM seen GROUP BY 1, 2),
parts AS (
  SELECT k.stay_id, k.itemid, k.slot, sum(amount * (least(e, (k.slot + 1) * 3600000000) - greatest(s, k.slot * 3600000000)) / (e - s)::DOUBLE) AS increment
  FROM slots k JOIN spans p ON p.stay_id = k.stay_id AND p.itemid = k.itemid AND s < (k.slot + 1) * 3600000000 AND e > k.slot * 3600000000 GROUP BY 1, 2, 3)
SELECT stay_id, itemid, slot, coalesce(n, 0) AS n, round(last_value(v IGNORE NULLS) OVER (PARTITION BY stay_id, itemid ORDER BY slot ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS value,
  CASE WHEN n > 0 THEN 'observed' ELSE 'uncovered' END AS status, round(coalesce(increment, 0) + 1e-9, 6) AS increment
FROM slots LEFT JOIN seen USING (stay_id, itemid, slot) LEFT JOIN parts USING (stay_id, itemid, slot)
""",
    "p3_found": f"WITH {_CHART} SELECT row_id FROM chart WHERE missing",
    "p6_exact": f"""
WITH {_CHART},
r AS (SELECT row_id, stay_id, itemid, t, valuenum AS v, coalesce(valuenum < physical_low, false) OR coalesce(valuenum > physical_high, false) AS wrong, category = 'setting' AS fixed
      FROM chart LEFT JOIN (SELECT * FROM d_items WHERE linksto = 'chartevents') USING (itemid) WHERE NOT missing AND t IS NOT NULL AND stay_id IS NOT NULL AND itemid IS NOT NULL),
d AS (SELECT DISTINCT stay_id, itemid, t, v FROM r),
m AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS opens FROM d WINDOW w AS (PARTITION BY stay_id, itemid ORDER BY t, v)),
k AS (SELECT *, sum(opens) OVER (PARTITION BY stay_id, itemid ORDER BY t, v ROWS UNBOUNDED PRECEDING) AS run FROM m),
n AS (SELECT stay_id, itemid, t, v, count(*) OVER (PARTITION BY stay_id, itemid, run) AS len FROM k)
SELECT row_id, CASE WHEN wrong THEN 'impossible' ELSE 'stuck' END AS kind FROM r JOIN n USING (stay_id, itemid, t, v)
WHERE wrong OR (len >= 6 AND NOT coalesce(fixed, false))
""",
    "p4_found": """
WITH spans AS (
  SELECT DISTINCT stay_id, starttime AS s, endtime AS e FROM preproc_med_icu
  WHERE stay_id IS NOT NULL AND endtime > starttime),
marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY stay_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            THEN 0 ELSE 1 END AS opens FROM spans),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY stay_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
periods AS (SELECT stay_id, k, min(s) AS s, max(e) AS e FROM numbered GROUP BY 1, 2),
gaps AS (SELECT stay_id, e AS s, lead(s) OVER (PARTITION BY stay_id ORDER BY k) AS e FROM periods)
SELECT stay_id, 'period' AS kind, strftime(s, '%Y-%m-%d %H:%M:%S') AS span_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS span_end FROM periods
UNION ALL
SELECT stay_id, 'gap', strftime(s, '%Y-%m-%d %H:%M:%S'), strftime(e, '%Y-%m-%d %H:%M:%S') FROM gaps WHERE e IS NOT NULL
""",
}
