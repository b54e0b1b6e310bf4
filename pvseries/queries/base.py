"""Registry, table access and the shared stand-in series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tables:
    """The driver's tables by attribute: ``t.events`` reads ``{dir}/events.parquet``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        df = self.build(Tables(spark, folder))
        # The files hold stamps without a zone; results go out the same way.
        zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle SQL."""
    def register(build):
        QUERIES[name] = Query(build, sql)
        return build
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, as the oracles do, to hide summation order."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def site_series(t: Tables) -> DataFrame:
    """(site, ts, p): missing at both ends, in a five-day gap and wherever the type is ``error``."""
    day = F.dayofmonth("ts")
    missing = (F.col("event_type") == "error") | day.isin(1, 10, 11, 12, 13, 14) | (day >= 29)
    return t.events.select(F.col("user_id").alias("site"), "ts", F.when(~missing, F.col("value")).alias("p"))


SITE_SERIES_SQL = """
s AS (SELECT user_id AS site, ts, CASE WHEN event_type = 'error' OR day(ts) IN (1,10,11,12,13,14)
      OR day(ts) >= 29 THEN NULL ELSE value END AS p FROM events)"""


def model_rows(t: Tables) -> DataFrame:
    """(site, ts, value, k, hour): three features of every event, with ``value`` as the target."""
    return t.events.select(F.col("user_id").alias("site"), "ts", "value",
                           F.get_json_object("props", "$.k").cast("double").alias("k"),
                           F.hour("ts").cast("double").alias("hour"))


MODEL_ROWS_SQL = r"""
r AS (SELECT user_id AS site, ts, value, CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS k,
      CAST(hour(ts) AS DOUBLE) AS hour,
      row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos,
      count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT site, ts, value, k, hour, pos, n, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train'
      WHEN pos < floor(n * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r)"""
