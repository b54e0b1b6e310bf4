"""Order, gaps, fills, splits and look-back windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvseries.operators import series
from pvseries.queries.base import (MODEL_ROWS_SQL, SITE_SERIES_SQL, model_rows, query, rounded, site_series)


@query("row_position", """
SELECT event_id, user_id AS site, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events""")
def row_position(t):
    rows = t.events.select("event_id", F.col("user_id").alias("site"), "ts")
    return series.row_position(rows, ["site"], "ts").drop("ts")


@query("gap_audit", """
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS ts FROM events),
d AS (SELECT epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap_seconds FROM h)
SELECT gap_seconds::DOUBLE AS gap_seconds, count(*) AS n FROM d WHERE gap_seconds IS NOT NULL GROUP BY 1""")
def gap_audit(t):
    hourly = t.events.select("user_id", F.date_trunc("hour", "ts").alias("ts"))
    return series.gap_audit(hourly, ["user_id"], "ts")


_KNOTS_SQL = f"""
WITH {SITE_SERIES_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) AS rn, epoch_us(ts) AS us FROM s),
k AS (SELECT *, last_value(CASE WHEN p IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS prn,
 last_value(CASE WHEN p IS NOT NULL THEN us END IGNORE NULLS) OVER a AS pus, last_value(p IGNORE NULLS) OVER a AS pv,
 first_value(CASE WHEN p IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS nrn,
 first_value(CASE WHEN p IS NOT NULL THEN us END IGNORE NULLS) OVER b AS nus, first_value(p IGNORE NULLS) OVER b AS nv
 FROM o WINDOW a AS (PARTITION BY site ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 b AS (PARTITION BY site ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT *, CASE WHEN p IS NOT NULL THEN p
 WHEN prn IS NOT NULL AND nrn IS NOT NULL THEN CASE WHEN (rn - prn <= 3 OR nrn - rn <= 3) {{short}}
   THEN pv + (nv - pv) * ((us - pus)::DOUBLE / (nus - pus)) END
 WHEN nrn IS NOT NULL THEN CASE WHEN nrn - rn <= 3 THEN nv END
 WHEN prn IS NOT NULL THEN CASE WHEN rn - prn <= 3 THEN pv END END AS q FROM k)"""


@query("interpolate_time", _KNOTS_SQL.format(short="") + """
SELECT site, ts, round(coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(q IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p FROM i""")
def interpolate_time(t):
    return rounded(series.interpolate_time(site_series(t), ["site"], "ts", ["p"]))


@query("interpolate_short_gaps", _KNOTS_SQL.format(short="AND nrn - prn - 1 <= 3") + """
SELECT site, ts, round(q, 6) AS p FROM i""")
def interpolate_short_gaps(t):
    return rounded(series.interpolate_time(site_series(t), ["site"], "ts", ["p"], max_gap=3, then_fill=False))


@query("ffill_bfill", f"""
WITH {SITE_SERIES_SQL} SELECT site, ts, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(p IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p FROM s""")
def ffill_bfill(t):
    return series.ffill_bfill(site_series(t), ["site"], "ts", ["p"])


@query("chrono_split", f"""
WITH {MODEL_ROWS_SQL} SELECT site, ts, split, pos,
 pos - min(pos) OVER (PARTITION BY site, split) AS split_pos FROM m""")
def chrono_split(t):
    rows = model_rows(t).select("site", "ts")
    return series.chrono_split(rows, ["site"], "ts")


@query("tail_holdout", """
WITH r AS (SELECT user_id AS site, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos,
 count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT site, ts, pos, CASE WHEN pos < n - ceil(n * 0.2::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""")
def tail_holdout(t):
    return series.tail_holdout(model_rows(t).select("site", "ts"), ["site"], "ts")


def windows(t, lookback=2, horizon=1, **options):
    split = series.chrono_split(model_rows(t), ["site"], "ts")
    return series.lookback_windows(split, ["site"], "ts", ["value", "k"], "value", lookback, horizon, **options)


@query("lookback_windows", f"""
WITH {MODEL_ROWS_SQL} SELECT * FROM (SELECT site, split, ts, pos - min(pos) OVER (PARTITION BY site, split) AS split_pos,
 lag(value, 2) OVER w AS x0_value, lag(k, 2) OVER w AS x0_k, lag(value, 1) OVER w AS x1_value, lag(k, 1) OVER w AS x1_k,
 value AS y, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY site, split ORDER BY ts))
WHERE i > 2""".replace("SELECT * FROM (", "SELECT * EXCLUDE (i) FROM ("))
def lookback_windows(t):
    return _flat(windows(t), 2)


@query("lookback_windows_ahead", f"""
WITH {MODEL_ROWS_SQL} SELECT * EXCLUDE (i) FROM (SELECT site, split, ts,
 pos - min(pos) OVER (PARTITION BY site, split) AS split_pos,
 lag(value, 4) OVER w AS x0_value, lag(k, 4) OVER w AS x0_k, lag(value, 3) OVER w AS x1_value, lag(k, 3) OVER w AS x1_k,
 lag(value, 2) OVER w AS x2_value, lag(k, 2) OVER w AS x2_k,
 value AS y, row_number() OVER w AS i FROM m WINDOW w AS (PARTITION BY site, split ORDER BY ts)) WHERE i > 4""")
def lookback_windows_ahead(t):
    return _flat(windows(t, 3, 2), 3)


@query("lookback_windows_gap", f"""
WITH {MODEL_ROWS_SQL} SELECT * EXCLUDE (i, g) FROM (SELECT *, max(g) OVER (PARTITION BY site, split ORDER BY ts
  ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS widest FROM (SELECT site, split, ts,
 pos - min(pos) OVER (PARTITION BY site, split) AS split_pos,
 lag(value, 2) OVER w AS x0_value, lag(k, 2) OVER w AS x0_k, lag(value, 1) OVER w AS x1_value, lag(k, 1) OVER w AS x1_k,
 value AS y, row_number() OVER w AS i, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS g
 FROM m WINDOW w AS (PARTITION BY site, split ORDER BY ts))) WHERE i > 2 AND widest <= 36000000000""".replace(
    "EXCLUDE (i, g)", "EXCLUDE (i, g, widest)"))
def lookback_windows_gap(t):
    return _flat(windows(t, max_gap_seconds=36000), 2)


def _flat(df, lookback):
    cells = [F.col("x")[i][j].alias(f"x{i}_{name}") for i in range(lookback) for j, name in enumerate(("value", "k"))]
    return df.select("site", "split", "ts", "split_pos", *cells, "y")
