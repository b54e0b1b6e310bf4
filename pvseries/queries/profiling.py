"""Profiles, validation and distribution tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvseries.config import RangeRule
from pvseries.functions import calendar as cal
from pvseries.operators import clean
from pvseries.operators import distributions as dist
from pvseries.operators import profile as prof
from pvseries.queries.base import query, rounded
from pvseries.sources.tables import materialise

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_SEASON_SQL = """CASE WHEN month(l_shipdate) IN (12,1,2) THEN 'Winter' WHEN month(l_shipdate) IN (3,4,5) THEN 'Summer'
 WHEN month(l_shipdate) IN (6,7,8,9) THEN 'Monsoon' ELSE 'Post-Monsoon' END"""
_LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in MEASURES) + ")"


def diurnal(t):
    """Sentinels out, negatives clamped, then the mean by hour."""
    coded = F.when(F.col("event_type") == "error", -999.0).otherwise(F.col("value"))
    df = clean.sentinels_to_null(t.events.select("ts", coded.alias("p")), ["p"])
    return prof.diurnal_profile(clean.clamp_negative(df, "p"), "ts", "p")


@query("diurnal_profile", """
SELECT hour(ts)::INTEGER AS hour, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS mean_value,
 count(CASE WHEN event_type <> 'error' THEN value END) AS n FROM events GROUP BY 1""")
def diurnal_profile(t):
    return rounded(diurnal(t))


@query("monthly_profile", """
SELECT month(l_shipdate)::INTEGER AS month, strftime(max(l_shipdate), '%b') AS month_name,
 round_even(avg(l_quantity), 1) AS mean_l_quantity, round_even(avg(l_extendedprice), 1) AS mean_l_extendedprice,
 round_even(avg(l_discount), 1) AS mean_l_discount, round_even(avg(l_tax), 1) AS mean_l_tax
FROM lineitem GROUP BY 1""")
def monthly_profile(t):
    return prof.monthly_profile(t.lineitem, "l_shipdate", MEASURES)


@query("season_profile", f"""
SELECT d.pos::INTEGER AS pos, d.season, round_even(avg(l_extendedprice), 1) AS mean,
 round_even(median(l_extendedprice), 1) AS median, round_even(max(l_extendedprice), 1) AS max,
 round_even(stddev_samp(l_extendedprice), 1) AS std
FROM (VALUES (0, 'Winter'), (1, 'Summer'), (2, 'Monsoon'), (3, 'Post-Monsoon')) d(pos, season)
LEFT JOIN (SELECT {_SEASON_SQL} AS season, l_extendedprice FROM lineitem) l USING (season) GROUP BY 1, 2""")
def season_profile(t):
    df = t.lineitem.select(cal.season(F.month("l_shipdate")).alias("season"), "l_extendedprice")
    return prof.season_profile(df, "season", "l_extendedprice")


YEARS = range(1995, 2002)  # all years of the test tables


@query("year_over_year", "SELECT month(l_shipdate)::INTEGER AS month, " + ", ".join(
    f"round(avg(l_quantity) FILTER (year(l_shipdate) = {y}), 6) AS y{y}" for y in YEARS) + " FROM lineitem GROUP BY 1")
def year_over_year(t):
    return rounded(prof.year_over_year(t.lineitem, "l_shipdate", "l_quantity", list(YEARS)))


@query("describe", f"""
WITH {_LONG_SQL} SELECT "column", count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
 min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
 round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM long GROUP BY 1""")
def describe(t):
    return rounded(prof.describe(t.lineitem, MEASURES))


@query("null_profile", """
SELECT 'event_id' AS "column", count(*) - count(event_id) AS nulls, count(*) AS rows FROM events UNION ALL
SELECT 'event_type', count(*) FILTER (event_type = 'error'), count(*) FROM events UNION ALL
SELECT 'value', count(*) FILTER (event_type = 'view'), count(*) FROM events""")
def null_profile(t):
    return prof.null_profile(t.events.select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value")))


@query("column_profile", """
SELECT 'l_quantity' AS "column", 'double' AS dtype, count(DISTINCT l_quantity) AS n_distinct,
 min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem UNION ALL
SELECT 'l_linenumber', 'int', count(DISTINCT l_linenumber), min(l_linenumber), max(l_linenumber) FROM lineitem
UNION ALL SELECT 'l_suppkey', 'bigint', count(DISTINCT l_suppkey), min(l_suppkey), max(l_suppkey) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'string', count(DISTINCT l_returnflag), NULL, NULL FROM lineitem""")
def column_profile(t):
    return prof.column_profile(t.lineitem, ["l_quantity", "l_linenumber", "l_suppkey", "l_returnflag"])


@query("column_values", """
SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL
SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY ALL""")
def column_values(t):
    return prof.column_values(t.events, ["event_type", "user_id"])


@query("value_counts", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def value_counts(t):
    return prof.value_counts(t.orders, "o_orderpriority")


@query("date_range", """
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1""")
def date_range(t):
    return prof.date_range(t.events, "ts", ["user_id"])


_RULES = (RangeRule("l_quantity", 5, 45), RangeRule("l_discount", None, 0.08), RangeRule("l_tax", 0, None),
          RangeRule("not_in_table", 0, 1))


@query("range_checks", """
SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity < 5) AS below, count(*) FILTER (l_quantity > 45) AS above,
 0::BIGINT AS nulls, 0 AS ok FROM lineitem UNION ALL
SELECT 'l_discount', 0, count(*) FILTER (l_discount > 0.08::DOUBLE), 0,
 (count(*) FILTER (l_discount > 0.08::DOUBLE) = 0)::INTEGER FROM lineitem UNION ALL
SELECT 'l_tax', count(*) FILTER (l_tax < 0), 0, 0, (count(*) FILTER (l_tax < 0) = 0)::INTEGER FROM lineitem""")
def range_checks(t):
    return prof.range_checks(t.lineitem, _RULES)


@query("completeness_checks", """
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS ts FROM events),
a AS (SELECT user_id, count(*) AS n_rows, count(DISTINCT ts) AS n_stamps,
 date_diff('hour', min(ts), max(ts)) + 1 AS n_expected FROM h GROUP BY 1)
SELECT *, n_rows - n_stamps AS n_duplicates, (n_rows = n_expected)::INTEGER AS complete FROM a""")
def completeness_checks(t):
    hourly = t.events.select("user_id", F.date_trunc("hour", "ts").alias("ts"))
    return prof.completeness_checks(hourly, "ts", ["user_id"])


@query("completeness_total", """
SELECT count(*) AS n_rows, count(DISTINCT o_orderdate) AS n_stamps, count(*) - count(DISTINCT o_orderdate) AS n_duplicates,
 17544::BIGINT AS n_expected, (count(*) = 17544)::INTEGER AS complete FROM orders""")
def completeness_total(t):
    return prof.completeness_checks(t.orders, "o_orderdate", expected=17544)


@query("shape_moments", f"""
WITH {_LONG_SQL} SELECT *, CASE WHEN abs(skewness) < 0.5 THEN 'symmetric' WHEN skewness > 0 THEN 'right-skewed'
 ELSE 'left-skewed' END AS shape FROM (SELECT "column", count(v) AS n, round(skewness(v), 6) AS skewness,
 round(kurtosis(v), 6) AS kurtosis FROM (SELECT * FROM long UNION ALL SELECT 'value', value FROM events) GROUP BY 1)""")
def shape_moments(t):
    own = prof.shape_moments(t.lineitem, MEASURES)
    return rounded(own.unionByName(prof.shape_moments(t.events, ["value"])))


@query("iqr_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q)
SELECT 'value' AS "column", round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
 round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper,
 count(*) FILTER (value < lower OR value > upper) AS outliers,
 round(count(*) FILTER (value < lower OR value > upper) / count(*) * 100, 6) AS percent FROM events, f""")
def iqr_outliers(t):
    return rounded(prof.iqr_outliers(t.events, ["value"]))


def _corr_sql(where: str) -> str:
    pairs = [(MEASURES[j], MEASURES[i]) for i in range(4) for j in range(i + 1, 4)]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem {where}"
                              for a, b in pairs)


@query("correlation_matrix", _corr_sql(""))
def correlation_matrix(t):
    return rounded(prof.correlation_matrix(t.lineitem, MEASURES))


@query("correlation_daytime", _corr_sql("WHERE l_discount > 0"))
def correlation_daytime(t):
    return rounded(prof.correlation_matrix(clean.daytime_filter(t.lineitem, "l_discount"), MEASURES))


@query("category_codes", """
WITH v AS (SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS icon FROM orders),
d AS (SELECT icon, dense_rank() OVER (ORDER BY icon) - 1 AS code FROM (SELECT DISTINCT icon FROM v WHERE icon IS NOT NULL))
SELECT o_orderkey, icon, coalesce(code, -1)::INTEGER AS code FROM v LEFT JOIN d USING (icon)""")
def category_codes(t):
    df = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("icon"))
    return prof.category_codes(df, "icon")


# -- distributions ----------------------------------------------------------------

@query("histogram", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM events),
b AS (SELECT least(floor((value - lo) / (hi - lo) * 50)::BIGINT, 49) AS bin, count(*) AS n FROM events, s GROUP BY 1)
SELECT g.bin::BIGINT AS bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS left_edge,
 round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS right_edge, coalesce(n, 0) AS n, round(mean, 6) AS mean
FROM range(50) g(bin) CROSS JOIN s LEFT JOIN b ON b.bin = g.bin""")
def histogram(t):
    return rounded(dist.histogram(t.events, "value", 50))


@query("kde_unbinned", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n,
 stddev_samp(value) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS bw FROM events),
g AS (SELECT p::INTEGER AS point, lo + p * ((hi - lo) / 19) AS x, n, bw FROM range(20) r(p), s)
SELECT point, 1 AS close, round(x, 6) AS x FROM (SELECT point, x,
 sum(exp(-0.5 * pow((x - value) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(n) AS d FROM g, events GROUP BY 1, 2) WHERE d > 0""")
def kde_unbinned(t):
    """The curve on a coarse grid against the sum over all rows, not over cells."""
    curve = dist.kde_curve(t.events, "value", grid=20)
    stats = t.events.agg((F.stddev_samp("value") * F.pow(F.count("value").cast("double"), F.lit(-0.2))).alias("bw"),
                         F.count("value").alias("n"))
    # Twenty points, written out per row: the work grows with the rows alone.
    points = curve.select("point", "x", "density").join(F.broadcast(stats.withColumn("k", F.lit(1))), F.lit(1) == F.col("k"))
    listed = points.agg(F.collect_list(F.struct("point", "x", "bw", "n", "density")).alias("ps"))
    rows = t.events.select("value", F.explode(listed.scalar()).alias("p"))
    z = (F.col("p.x") - F.col("value")) / F.col("p.bw")
    exact = (rows.groupBy("p.point", "p.x", "p.n", "p.bw", "p.density").agg(F.sum(F.exp(-0.5 * z * z)).alias("s"))
             .withColumn("d", F.col("s") / (F.col("n") * F.col("bw") * 2.5066282746310002)))
    return exact.select("point", (F.abs(F.col("d") - F.col("density")) <= 0.005 * F.col("d")).cast("int").alias("close"),
                        F.round("x", 6).alias("x"))


@query("kde_curve", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n,
 stddev_samp(value) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS bw FROM events),
b AS (SELECT floor((value - lo) / bw * 32)::BIGINT AS cell, count(*) AS w, avg(value) AS m
 FROM events, s GROUP BY 1),
g AS (SELECT p::INTEGER AS point, lo + p * ((hi - lo) / 199) AS x, n, bw FROM range(200) r(p), s)
SELECT point, round(x, 6) AS x,
 round(sum(w * exp(-0.5 * pow((x - m) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(n), 8) AS density
FROM g, b GROUP BY 1, 2""")
def kde_curve(t):
    out = dist.kde_curve(t.events, "value")
    return out.select("point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("kde_by_flag", """
WITH d AS (SELECT (hour(ts) BETWEEN 6 AND 17)::INTEGER AS is_day, value FROM events),
s AS (SELECT is_day, min(value) AS lo, max(value) AS hi, count(*) AS n, stddev_samp(value) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS bw FROM d GROUP BY 1),
b AS (SELECT is_day, floor((value - lo) / bw * 32)::BIGINT AS cell, count(*) AS w, avg(value) AS m FROM d JOIN s USING (is_day) GROUP BY 1, 2),
g AS (SELECT is_day, p::INTEGER AS point, lo + p * ((hi - lo) / 99) AS x, n, bw FROM range(100) r(p), s)
SELECT is_day, point, round(x, 6) AS x, round(sum(w * exp(-0.5 * pow((x - m) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(n), 8) AS density
FROM g JOIN b USING (is_day) GROUP BY 1, 2, 3""")
def kde_by_flag(t):
    """Night against day, both on a grid of their own."""
    df = t.events.select(F.hour("ts").between(6, 17).cast("int").alias("is_day"), "value")
    out = dist.kde_curve(df, "value", ["is_day"], grid=100)
    return out.select("is_day", "point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("box_stats", f"""
WITH d AS (SELECT {_SEASON_SQL} AS season, l_extendedprice AS v FROM lineitem),
q AS (SELECT season, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
 quantile_cont(v, 0.75) AS q3 FROM d GROUP BY 1)
SELECT season, 'l_extendedprice' AS "column", n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
 min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
 max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
 count(*) FILTER (v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM d JOIN q USING (season) GROUP BY ALL""")
def box_stats(t):
    df = t.lineitem.select(cal.season(F.month("l_shipdate")).alias("season"), "l_extendedprice")
    return rounded(dist.box_stats(df, "l_extendedprice", ["season"]), 4)


@query("box_stats_all", """
WITH q AS (SELECT count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
 quantile_cont(value, 0.75) AS q3 FROM events)
SELECT 'value' AS "column", n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
 min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
 max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
 count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM events, q GROUP BY ALL""")
def box_stats_all(t):
    return rounded(dist.box_stats(t.events, "value"), 4)


@query("day_night_quartiles", """
WITH d AS (SELECT (hour(ts) BETWEEN 6 AND 17)::INTEGER AS is_day, value AS v FROM events)
SELECT is_day, 'value' AS "column", count(v) AS n, round(quantile_cont(v, 0.25), 6) AS q1,
 round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3 FROM d GROUP BY 1""")
def day_night_quartiles(t):
    df = t.events.select(F.hour("ts").between(6, 17).cast("int").alias("is_day"), "value")
    return rounded(dist.group_quartiles(df, ["value"], "is_day"))


@query("scatter_points", """
SELECT l_quantity AS x, l_extendedprice AS y, l_discount AS colour FROM lineitem""")
def scatter_points(t):
    return dist.scatter_points(t.lineitem, "l_quantity", "l_extendedprice", "l_discount")


@query("regression_line", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
 round(regr_r2(l_extendedprice, l_quantity), 9) AS r2, count(*) AS n FROM lineitem""")
def regression_line(t):
    out = dist.regression_line(t.lineitem, "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("r2", 9).alias("r2"), "n")


_BAND_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("regression_band", f"""
WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, concat_ws('|', {', '.join(_BAND_KEY)}, 42) AS k FROM lineitem),
h AS (SELECT x, y, h.b, md5(concat_ws('|', k, h.b)) AS m FROM r, range(3) h(b)),
u AS (SELECT x, y, h.b * 14 + d.i AS sample, ('0x' || substr(m, (2 * d.i + 1)::INTEGER, 2))::INTEGER AS u FROM h, range(14) d(i)
 WHERE h.b * 14 + d.i < 32),
w AS (SELECT x, y, sample, (u >= 94)::INT + (u >= 188)::INT + (u >= 235)::INT + (u >= 251)::INT + (u >= 255)::INT AS w FROM u),
m AS (SELECT sample, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY 1),
l AS (SELECT sample, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS a, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS b FROM m),
g AS (SELECT p::INTEGER AS point, lo + p * (hi - lo) / 9 AS x, a * (lo + p * (hi - lo) / 9) + b AS yhat FROM range(10) t(p),
 (SELECT min(x) AS lo, max(x) AS hi, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r)),
o AS (SELECT point, x, yhat, list_sort(list(a * x + b)) AS v FROM g, l GROUP BY 1, 2, 3)
SELECT point, round(x, 6) AS x, round(yhat, 3) AS yhat, round(v[1 + 1], 3) AS lo, round(v[32 - 1], 3) AS hi FROM o""")
def regression_band(t):
    """Ten points, 32 resamples: with a level of 0.9 the second line from either end."""
    out = dist.regression_band(t.lineitem, "l_quantity", "l_extendedprice", _BAND_KEY, samples=32, grid=10, level=0.9)
    return out.select("point", F.round("x", 6).alias("x"), *[F.round(c, 3).alias(c) for c in ("yhat", "lo", "hi")])


@query("distinct_sketches", """
SELECT year(l_shipdate)::INTEGER AS year, 'l_suppkey' AS "column", count(DISTINCT l_suppkey) AS n_distinct FROM lineitem GROUP BY 1
UNION ALL SELECT year(l_shipdate)::INTEGER, 'l_quantity', count(DISTINCT l_quantity) FROM lineitem GROUP BY 1""")
def distinct_sketches(t):
    """Stored per site and year, then merged to years; counts this small beside the sketch are exact."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("site"), F.year("l_shipdate").alias("year"), "l_suppkey", "l_quantity")
    held = materialise(prof.distinct_sketches(rows, ["l_suppkey", "l_quantity"], ["site", "year"], precision=16), "sketches")
    return prof.merged_distinct(held, ["year"])


@query("seeded_sample", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, 42)), l_orderkey, l_linenumber LIMIT 2000""")
def seeded_sample(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dist.seeded_sample(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 2000)
