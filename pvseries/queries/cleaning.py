"""Names, casts, sentinels, filters and calendar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvseries.functions import calendar as cal
from pvseries.functions.solar import sun_elevation
from pvseries.operators import clean, scaling
from pvseries.queries.base import query, rounded


@query("clean_column_names", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders""")
def clean_column_names(t):
    padded = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority").toDF(
        " o_orderkey", "o_totalprice ", "  o_orderpriority ")
    return clean.clean_column_names(padded)


@query("select_model_columns", """
SELECT l_orderkey AS site, l_shipdate AS datetime, l_quantity AS "Gb_i", l_tax AS "RH" FROM lineitem""")
def select_model_columns(t):
    raw = t.lineitem.withColumnsRenamed({"l_quantity": "Gb(i)", "l_tax": "RH2M"})
    return clean.select_columns(raw, ["l_orderkey", "l_shipdate", "Gb(i)", "RH2M"],
                                {"l_orderkey": "site", "l_shipdate": "datetime", "Gb(i)": "Gb_i", "RH2M": "RH"})


@query("drop_sparse_columns", """
SELECT event_id, event_type FROM events""")
def drop_sparse_columns(t):
    sparse = t.events.select("event_id", "event_type",
                             F.when(F.col("event_type") == "error", F.col("value")).alias("mostly_missing"))
    return clean.drop_sparse_columns(sparse, 0.5)


@query("tolerant_cast", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE)
       AS value FROM events""")
def tolerant_cast(t):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return clean.tolerant_cast(t.events.select("event_id", text.alias("value")), ["value"])


def _coded():
    return F.when(F.col("event_type") == "error", -999.0).when(F.col("event_type") == "view", -99.0).otherwise(
        F.col("value"))


_CODED_SQL = "CASE WHEN event_type = 'error' THEN -999.0 WHEN event_type = 'view' THEN -99.0 ELSE value END"


@query("sentinel_to_null", """
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS value,
       user_id FROM events""")
def sentinel_to_null(t):
    return clean.sentinels_to_null(t.events.select("event_id", _coded().alias("value"), "user_id"))


@query("derived_total", """
SELECT l_orderkey, l_linenumber, round(nullif(l_tax, 0) + l_discount + l_quantity, 9) AS g_i,
       l_quantity * 1000.0::DOUBLE AS ps_pa FROM lineitem""")
def derived_total(t):
    parts = t.lineitem.withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return parts.select("l_orderkey", "l_linenumber",
                        F.round(clean.total("l_tax", "l_discount", "l_quantity"), 9).alias("g_i"),
                        clean.kpa_to_pa("l_quantity").alias("ps_pa"))


@query("clamp_negative", f"""
SELECT event_id, CASE WHEN v < 0 THEN 0 ELSE v END AS generation FROM
 (SELECT event_id, nullif({_CODED_SQL}, -999.0) AS v FROM events)""")
def clamp_negative(t):
    df = t.events.select("event_id", F.nullif(_coded(), F.lit(-999.0)).alias("generation"))
    return clean.clamp_negative(df, "generation")


@query("daytime_filter", """
SELECT event_id, ts, value FROM events WHERE value - 20 > 0""")
def daytime_filter(t):
    lit = t.events.withColumn("light", F.col("value") - 20)
    return clean.daytime_filter(lit, "light").select("event_id", "ts", "value")


@query("membership_filter", """
SELECT event_id, ts, value FROM events WHERE hour(ts) IN (7, 8, 9)""")
def membership_filter(t):
    return clean.membership_filter(t.events, F.hour("ts"), [7, 8, 9]).select("event_id", "ts", "value")


@query("daytime_filter_report", """
SELECT count(*) AS rows_before, count(*) FILTER (value > 20) AS rows_after,
       count(*) - count(*) FILTER (value > 20) AS rows_removed FROM events""")
def daytime_filter_report(t):
    return clean.filter_report(t.events, F.col("value") > 20)


def _flag():
    return F.when(F.col("event_type") == "error", 1).otherwise(0)


@query("quality_flag", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 1 WHEN value = 0 THEN 2 ELSE 0 END AS data_quality
FROM events""")
def quality_flag(t):
    flag = clean.quality_flag(_flag(), F.col("value") == 0)
    return t.events.select("event_id", flag.alias("data_quality"))


@query("quality_filter", """
SELECT event_id, 1 AS data_quality FROM events WHERE event_type = 'error'""")
def quality_filter(t):
    return clean.quality_filter(t.events.select("event_id", _flag().alias("data_quality")), 1)


@query("drop_missing_target", """
SELECT event_id, value AS generation FROM events WHERE event_type <> 'error'""")
def drop_missing_target(t):
    target = F.when(F.col("event_type") != "error", F.col("value"))
    return clean.drop_missing_target(t.events.select("event_id", target.alias("generation")), "generation")


@query("negative_audit", f"""
SELECT value, count(*) AS n FROM (SELECT nullif({_CODED_SQL}, -999.0) AS value FROM events)
WHERE value < 0 OR value IS NULL GROUP BY value""")
def negative_audit(t):
    return clean.negative_audit(t.events.select(F.nullif(_coded(), F.lit(-999.0)).alias("value")), "value")


@query("head_tail", """
SELECT * FROM (SELECT 'head' AS part, event_id, ts FROM events ORDER BY ts, event_id LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'tail' AS part, event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5)""")
def head_tail(t):
    rows = t.events.select("event_id", "ts")
    label = lambda df, name: df.select(F.lit(name).alias("part"), "event_id", "ts")
    return label(clean.head(rows, ["ts", "event_id"], 5), "head").unionByName(
        label(clean.tail(rows, ["ts", "event_id"], 5), "tail"))


@query("union_years", "SELECT o_orderkey, o_orderdate FROM orders")
def union_years(t):
    """One extract per year, the last also with whatever lies outside the others, in two column orders."""
    early = [clean.membership_filter(t.orders, F.year("o_orderdate"), [y]).select("o_orderkey", "o_orderdate")
             for y in range(1995, 2001)]
    late = t.orders.filter(~F.coalesce(F.year("o_orderdate").between(1995, 2000), F.lit(False)))
    return clean.union_years(*early, late.select("o_orderdate", "o_orderkey"))


@query("dedupe_first", """
SELECT o_orderdate, o_orderkey, o_custkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) = 1""")
def dedupe_first(t):
    rows = t.orders.select("o_orderdate", "o_orderkey", "o_custkey", "o_totalprice")
    return clean.dedupe_first(rows, ["o_orderdate"], ["o_orderkey"])


@query("list_duplicates", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders
QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1""")
def list_duplicates(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return clean.list_duplicates(rows, ["o_custkey", "o_orderdate"])


# -- timestamps and calendar ----------------------------------------------------

@query("parse_ts_colon", """
SELECT event_id, date_trunc('minute', ts) AS datetime FROM events""")
def parse_ts_colon(t):
    text = F.concat(F.lit(" "), F.date_format("ts", "yyyyMMdd:HHmm"), F.lit(" "))
    return t.events.select("event_id", text.alias("time")).select(
        "event_id", cal.parse_colon("time").alias("datetime"))


@query("parse_ts_compact", """
SELECT event_id, date_trunc('hour', ts) AS datetime FROM events""")
def parse_ts_compact(t):
    number = F.date_format("ts", "yyyyMMddHH").cast("long")
    return t.events.select("event_id", number.alias("time")).select(
        "event_id", cal.parse_compact("time").alias("datetime"))


@query("align_half_hour", """
SELECT event_id, ts - INTERVAL 30 MINUTE AS datetime FROM events""")
def align_half_hour(t):
    return t.events.select("event_id", cal.align_half_hour("ts").alias("datetime"))


@query("make_ts_from_parts", """
SELECT event_id, date_trunc('hour', ts) AS datetime FROM events""")
def make_ts_from_parts(t):
    df = cal.with_calendar(t.events, "ts")
    return df.select("event_id", cal.from_parts("year", "month", "day", "hour").alias("datetime"))


@query("calendar_parts", """
SELECT l_orderkey, l_linenumber, hour(l_shipdate)::INTEGER AS hour, day(l_shipdate)::INTEGER AS day,
       month(l_shipdate)::INTEGER AS month, year(l_shipdate)::INTEGER AS year,
       strftime(l_shipdate, '%Y-%m-%d') AS date, dayofyear(l_shipdate)::INTEGER AS day_of_year,
       CAST(l_shipdate AS VARCHAR)[:10] || 'T00:00:00+00:00' AS iso FROM lineitem""")
def calendar_parts(t):
    df = cal.with_calendar(t.lineitem, "l_shipdate")
    iso = F.date_format(cal.parse_iso(F.concat(F.col("date").cast("string"), F.lit("T00:00:00+00:00"))),
                        "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return df.select("l_orderkey", "l_linenumber", "hour", "day", "month", "year",
                     F.col("date").cast("string").alias("date"), "day_of_year", iso.alias("iso"))


@query("season_label", """
SELECT l_orderkey, l_linenumber,
 CASE WHEN month(l_shipdate) IN (12,1,2) THEN 'Winter' WHEN month(l_shipdate) IN (3,4,5) THEN 'Summer'
      WHEN month(l_shipdate) IN (6,7,8,9) THEN 'Monsoon' ELSE 'Post-Monsoon' END AS monsoon,
 CASE WHEN month(l_shipdate) IN (12,1,2) THEN 'Winter' WHEN month(l_shipdate) IN (3,4,5) THEN 'Spring'
      WHEN month(l_shipdate) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS temperate FROM lineitem""")
def season_label(t):
    month = F.month("l_shipdate")
    return t.lineitem.select("l_orderkey", "l_linenumber", cal.season(month).alias("monsoon"),
                             cal.season(month, "temperate").alias("temperate"))


@query("cyclic_features", """
SELECT event_id, round(sin(2*pi()*hour(ts)/24), 9) AS hour_sin, round(cos(2*pi()*hour(ts)/24), 9) AS hour_cos,
 round(sin(2*pi()*month(ts)/12), 9) AS month_sin, round(cos(2*pi()*month(ts)/12), 9) AS month_cos,
 round(sin(2*pi()*dayofyear(ts)/365), 9) AS doy_sin, round(cos(2*pi()*dayofyear(ts)/365), 9) AS doy_cos
FROM events""")
def cyclic_features(t):
    # Adding 0.0 turns the negative zero of a rounded sine into zero.
    cols = {n: F.round(c, 9) + F.lit(0.0) for n, c in cal.cyclic_features("ts").items()}
    return t.events.select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("daytime_flag", f"""
SELECT event_id, CASE WHEN coalesce(nullif({_CODED_SQL}, -999.0), 0) > 0 THEN 1 ELSE 0 END AS is_daytime
FROM events""")
def daytime_flag(t):
    sun = F.nullif(_coded(), F.lit(-999.0))
    return t.events.select("event_id", cal.daytime_flag(sun).alias("is_daytime"))


@query("peak_flag", """
SELECT event_id, CASE WHEN hour(ts) BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS peak_gridded,
 CASE WHEN hour(ts) BETWEEN 6 AND 12 THEN 1 ELSE 0 END AS peak_station,
 CASE WHEN hour(ts) BETWEEN 8 AND 16 THEN 1 ELSE 0 END AS peak_station_day FROM events""")
def peak_flag(t):
    hour = F.hour("ts")
    return t.events.select("event_id", cal.peak_flag(hour, 5, 9).alias("peak_gridded"),
                           cal.peak_flag(hour, 6, 12).alias("peak_station"),
                           cal.peak_flag(hour, 8, 16).alias("peak_station_day"))


_INTERACTION_SQL = """
WITH mx AS (SELECT max(l_discount) AS c, max(l_quantity) AS r FROM lineitem {where})
SELECT l_orderkey, l_linenumber, round(l_discount / CASE WHEN c > 0 THEN c ELSE 1 END
  * (l_quantity / CASE WHEN r > 0 THEN r ELSE 1 END), 9) AS cloud_rad,
  round(l_tax * (l_quantity / CASE WHEN r > 0 THEN r ELSE 1 END), 9) AS temp_rad FROM lineitem, mx"""


def _interactions(t, fit_on=None):
    out = scaling.interaction_features(t.lineitem, "l_discount", "l_quantity", "l_tax", fit_on)
    return rounded(out.select("l_orderkey", "l_linenumber", "cloud_rad", "temp_rad"), 9)


@query("interaction_features", _INTERACTION_SQL.format(where="WHERE l_shipdate < TIMESTAMP '1995-01-20'"))
def interaction_features(t):
    return _interactions(t, F.col("l_shipdate") < F.lit("1995-01-20").cast("timestamp_ntz"))


@query("interaction_features_all", _INTERACTION_SQL.format(where=""))
def interaction_features_all(t):
    return _interactions(t)


@query("format_ts", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' AS datetime FROM events""")
def format_ts(t):
    return t.events.select("event_id", cal.format_utc("ts").alias("datetime"))


@query("sun_elevation", """
WITH a AS (SELECT event_id, (epoch_us(ts) - 946728000000000) / 86400000000.0::DOUBLE AS n FROM events),
b AS (SELECT *, radians(357.528 + 0.9856003 * n) AS g FROM a),
c AS (SELECT *, radians(280.460 + 0.9856474 * n + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS lam,
      radians(23.439 - 0.0000004 * n) AS eps FROM b),
d AS (SELECT *, atan2(cos(eps) * sin(lam), cos(lam)) AS ra, asin(sin(eps) * sin(lam)) AS dec FROM c),
e AS (SELECT *, radians(280.46061837::DOUBLE + 360.98564736629::DOUBLE * n + 16.4) - ra AS h FROM d),
f AS (SELECT event_id, degrees(asin(sin(radians(48.2)) * sin(dec)
      + cos(radians(48.2)) * cos(dec) * cos(h))) AS el FROM e)
SELECT event_id, round(el + CASE WHEN el >= -0.8333 THEN (101325.0 / 100) / 1010.0 * (283.0 / (273.0 + 12.0))
  * 1.02 / (60.0 * tan(radians(el + 10.3 / (el + 5.11)))) ELSE 0 END, 5) AS elevation FROM f""")
def sun_elevation_(t):
    return rounded(t.events.select("event_id", sun_elevation("ts", 48.2, 16.4).alias("elevation")), 5)
