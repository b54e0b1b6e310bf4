"""Joins of sources and typical years."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvseries.operators import joins
from pvseries.queries.base import query, rounded
from pvseries.session import scratch_path

_HOURLY_SQL = """
l AS (SELECT user_id AS site, date_trunc('hour', ts) AS ts, avg(value) AS p FROM events GROUP BY ALL),
r AS (SELECT user_id AS site, date_trunc('hour', ts) AS ts, avg(value) AS rh FROM events
      WHERE event_type = 'purchase' GROUP BY ALL)"""


def _hourly(events, name):
    return (events.groupBy(F.col("user_id").alias("site"), F.date_trunc("hour", "ts").alias("ts"))
            .agg(F.avg("value").alias(name)))


def _sources(t):
    return _hourly(t.events, "p"), _hourly(t.events.filter("event_type = 'purchase'"), "rh")


@query("join_sources", f"""
WITH {_HOURLY_SQL} SELECT site, ts, round(p, 6) AS p, round(rh, 6) AS rh FROM l LEFT JOIN r USING (site, ts)""")
def join_sources(t):
    return rounded(joins.join_sources(*_sources(t), ["site", "ts"]))


@query("join_audit", f"""
WITH {_HOURLY_SQL} SELECT (SELECT count(*) FROM l) AS primary_rows, (SELECT count(*) FROM r) AS other_rows,
 count(*) AS joined_rows, count(*) FILTER (r.ts IS NULL) AS unmatched_rows
FROM l LEFT JOIN r ON l.site = r.site AND l.ts = r.ts""")
def join_audit(t):
    return joins.join_audit(*_sources(t), ["site", "ts"])


@query("join_audit_observed", f"""
WITH {_HOURLY_SQL} SELECT (SELECT count(*) FROM l) AS primary_rows, (SELECT count(*) FROM r) AS other_rows,
 count(*) AS joined_rows, count(*) FILTER (r.ts IS NULL) AS unmatched_rows
FROM l LEFT JOIN r ON l.site = r.site AND l.ts = r.ts""")
def join_audit_observed(t):
    """The audit of a join that is written: one read of either side."""
    return joins.write_joined(*_sources(t), ["site", "ts"], scratch_path(t.spark, "joined"))


@query("join_unmatched_head", f"""
WITH {_HOURLY_SQL} SELECT site, ts FROM l ANTI JOIN r USING (site, ts) ORDER BY ts, site LIMIT 5""")
def join_unmatched_head(t):
    return joins.first_unmatched(*_sources(t), ["site", "ts"], ["ts", "site"], 5)


@query("calendar_join", """
WITH d AS (SELECT month(o_orderdate) AS mo, day(o_orderdate) AS da, hour(o_orderdate) AS ho, o_totalprice AS wd
 FROM orders
 QUALIFY row_number() OVER (PARTITION BY mo, da, ho ORDER BY o_orderkey) = 1)
SELECT l_orderkey, l_linenumber, l_shipdate, wd AS o_totalprice FROM lineitem LEFT JOIN d
 ON month(l_shipdate) = mo AND day(l_shipdate) = da AND hour(l_shipdate) = ho""")
def calendar_join(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    return joins.calendar_join(rows, "l_shipdate", t.orders, "o_orderdate", ["o_orderkey"],
                               ["o_totalprice"])
