"""Whole cleaning jobs on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvseries.operators import clean
from pvseries.plans.cleaning import clean_gridded, clean_station
from pvseries.queries.base import query
from pvseries.schemas import STATION_RAW


def _filled_sql(c: str, digits: int) -> str:
    """CTE ``f_<c>``: column c of o after interpolation and both fills."""
    up = "OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = "OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    known = lambda x: f"CASE WHEN {c} IS NOT NULL THEN {x} END IGNORE NULLS"
    return f"""
k_{c} AS (SELECT site, ts, us, rn, {c} AS v,
 last_value({known('rn')}) {up} AS pr, last_value({known('us')}) {up} AS pu, last_value({c} IGNORE NULLS) {up} AS pv,
 first_value({known('rn')}) {down} AS nr, first_value({known('us')}) {down} AS nu,
 first_value({c} IGNORE NULLS) {down} AS nv FROM o),
q_{c} AS (SELECT site, ts, CASE WHEN v IS NOT NULL THEN v
 WHEN pr IS NOT NULL AND nr IS NOT NULL THEN CASE WHEN rn - pr <= 3 OR nr - rn <= 3
  THEN pv + (nv - pv) * ((us - pu)::DOUBLE / (nu - pu)) END
 WHEN nr IS NOT NULL THEN CASE WHEN nr - rn <= 3 THEN nv END
 WHEN pr IS NOT NULL THEN CASE WHEN rn - pr <= 3 THEN pv END END AS q FROM k_{c}),
f_{c} AS (SELECT site, ts, round(coalesce(last_value(q IGNORE NULLS) {up}, first_value(q IGNORE NULLS) {down}), {digits})
 AS {c} FROM q_{c})"""


@query("gridded_site_clean", f"""
WITH h AS (SELECT user_id AS site, date_trunc('hour', ts) AS ts, avg(value) AS p, max(value) AS gb, min(value) AS gd,
 avg(value) FILTER (event_type <> 'view') / 7 AS t2m, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS flag
 FROM events GROUP BY ALL),
w AS (SELECT user_id AS site, date_trunc('hour', ts) AS ts, avg(value) / 7 AS rh FROM events
 WHERE event_type = 'purchase' GROUP BY ALL),
d0 AS (SELECT o_orderdate AS t, max(o_totalprice) / 7000 AS wd FROM orders GROUP BY 1),
d AS (SELECT month(t) AS mo, day(t) AS da, hour(t) AS ho, wd FROM d0
 QUALIFY row_number() OVER (PARTITION BY mo, da, ho ORDER BY t) = 1),
o AS (SELECT h.*, rh, wd, row_number() OVER (PARTITION BY h.site ORDER BY h.ts) AS rn, epoch_us(h.ts) AS us
 FROM h LEFT JOIN w ON h.site = w.site AND h.ts = w.ts
 LEFT JOIN d ON month(h.ts) = mo AND day(h.ts) = da AND hour(h.ts) = ho),
{_filled_sql('t2m', 9)}, {_filled_sql('rh', 9)}, {_filled_sql('wd', 6)}
SELECT site, ts AS datetime, round(p, 7) AS "P", round(gb + gd + 1, 7) AS "G_i", t2m.t2m AS "T2m", rh.rh AS "RH",
 wd.wd AS "WD10m", flag::INTEGER AS data_quality
FROM h JOIN f_t2m t2m USING (site, ts) JOIN f_rh rh USING (site, ts)
JOIN f_wd wd USING (site, ts)""")
def gridded_site_clean(t):
    hour = F.date_trunc("hour", "ts")
    site = F.col("user_id").alias("site")
    error = F.max(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    panel = t.events.groupBy(site, hour.alias("h")).agg(
        F.avg("value").alias("P"), F.max("value").alias("Gb(i)"), F.min("value").alias("Gd(i)"), F.lit(1.0).alias("Gr(i)"),
        F.lit(-10.0).alias("H_sun"), (F.avg(F.when(F.col("event_type") != "view", F.col("value"))) / 7).alias("T2m"),
        F.lit(2.0).alias("WS10m"), error.alias("Int"))
    half = F.col("h") + F.make_dt_interval(mins=F.lit(30))
    panel = panel.withColumn("time", F.date_format(half, "yyyyMMdd:HHmm")).drop("h").na.fill(-999.0, ["T2m"])
    weather = (t.events.filter("event_type = 'purchase'").groupBy(site, hour.alias("h"))
               .agg((F.avg("value") / 7).alias("RH2M"), (F.avg("value") / 7).alias("PS")))
    weather = weather.select("site", F.date_format("h", "yyyyMMddHH").alias("time"), "RH2M", "PS",
                             F.lit(1.0).alias("T2M"), F.lit(1.0).alias("WS10M"), F.lit(1.0).alias("ALLSKY_SFC_SW_DWN"))
    typical = t.orders.groupBy("o_orderdate").agg((F.max("o_totalprice") / 7000).alias("WD10m")).select(
        F.date_format("o_orderdate", "yyyyMMdd:HHmm").alias("time(UTC)"), "WD10m")
    out = clean_gridded(panel, [weather], typical, site_typical=False)
    return out.select("site", "datetime", F.round("P", 7).alias("P"), F.round("G_i", 7).alias("G_i"),
                      F.round("T2m", 9).alias("T2m"), F.round("RH", 9).alias("RH"),
                      F.round("WD10m", 6).alias("WD10m"), "data_quality")


# Readings are the values less 40, missing for errors, so that all three cases occur.
_STATION_SQL = """
r AS (SELECT event_id, user_id AS site, date_trunc('hour', ts) AS "Datetime",
 CASE WHEN event_type <> 'error' THEN value - 40 END AS g, value / 5 AS temp FROM events),
s AS (SELECT site, "Datetime", greatest(g, 0) AS generation, temp FROM r WHERE g IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY site, "Datetime" ORDER BY event_id) = 1),
f AS (SELECT site, "Datetime", round(generation, 6) AS generation, round(temp, 6) AS temp, CASE WHEN month("Datetime") IN (12, 1, 2) THEN 'Winter'
 WHEN month("Datetime") IN (3, 4, 5) THEN 'Spring' WHEN month("Datetime") IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season FROM s)"""


def _station(t):
    """Raw station files made of the events: 27 columns, calendar parts apart."""
    values = {"year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"), "hour": F.hour("ts"),
              "generation": F.when(F.col("event_type") != "error", F.col("value") - 40), "temp": F.col("value") / 5,
              "sealevelpressure": F.lit(1013.0), "preciptype": F.lit("rain"), "stations": F.lit("A1")}
    raw = t.events.select("event_id", F.col("user_id").alias("site"), *[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STATION_RAW])
    return clean_station(raw, 48.2, 16.4, "event_id").withColumns(
        {"generation": F.round("generation", 6), "temp": F.round("temp", 6)})


@query("station_site_clean", f"WITH {_STATION_SQL} SELECT * FROM f")
def station_site_clean(t):
    return _station(t).select("site", "Datetime", "generation", "temp", "season")


@query("station_daytime", f"WITH {_STATION_SQL} SELECT site, \"Datetime\", generation FROM f WHERE generation > 0")
def station_daytime(t):
    out = clean.daytime_filter(clean.require_columns(_station(t), ["site", "Datetime", "generation"]), "generation")
    return out.select("site", "Datetime", "generation")
