"""Readers, writers and run artifacts, as round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvseries.operators import clean, metrics
from pvseries.queries.base import MODEL_ROWS_SQL, query, rounded
from pvseries.queries.modelling import (_FIT_SQL, _ROUND_PARAMS, METRICS_BY_SPLIT_SQL, fit_params, persistence)
from pvseries.queries.sequences import _flat, windows
from pvseries.session import scratch_path
from pvseries.sources import artifacts, nested_json, probe, tables

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                       T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                       T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@query("scan_csv_roundtrip", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def scan_csv_roundtrip(t):
    path = scratch_path(t.spark, "csv")
    tables.write_delimited(t.events, path)
    return tables.read_delimited(t.spark, path, EVENTS)


@query("scan_csv_corrupt", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, event_type = 'error' AS corrupt FROM events""")
def scan_csv_corrupt(t):
    path = scratch_path(t.spark, "csv")
    text = F.when(F.col("event_type") == "error", "broken").otherwise(F.col("value").cast("string"))
    t.events.select("event_id", text.alias("value")).write.option("header", True).csv(path)
    schema = T.StructType([EVENTS["event_id"], EVENTS["value"]])
    rows = tables.read_delimited(t.spark, path, schema, corrupt=True)
    return rows.select("event_id", "value", F.col(tables.CORRUPT).isNotNull().alias("corrupt"))


@query("sink_roundtrip", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag AS site, year(l_shipdate)::INTEGER AS year FROM lineitem""")
def sink_roundtrip(t):
    path = scratch_path(t.spark, "table")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("site"),
                             F.year("l_shipdate").alias("year"))
    tables.write_table(rows, path, ["site", "year"])
    return t.spark.read.parquet(path)


@query("sink_csv_roundtrip", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00:00' AS datetime, o_totalprice FROM orders""")
def sink_csv_roundtrip(t):
    from pvseries.functions.calendar import format_utc
    path = scratch_path(t.spark, "csv")
    rows = t.orders.select("o_orderkey", format_utc("o_orderdate").alias("datetime"), "o_totalprice")
    tables.write_delimited(rows, path)
    return tables.read_delimited(t.spark, path, T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("datetime", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType())]))


@query("json_array_to_rows", """
SELECT user_id AS site, strftime(ts, '%Y%m%d:%H%M') AS time, value AS "P" FROM events""")
def json_array_to_rows(t):
    # One document per site and day, so no document outgrows a task.
    record = F.struct(F.date_format("ts", "yyyyMMdd:HHmm").alias("time"), F.col("value").alias("P"))
    docs = (t.events.groupBy(F.col("user_id").alias("site"), F.to_date("ts").alias("day"))
            .agg(F.collect_list(record).alias("hourly")).select("site", F.struct("hourly").alias("outputs")))
    path = scratch_path(t.spark, "json")
    docs.write.json(path)
    schema = "site bigint, outputs struct<hourly: array<struct<time: string, P: double>>>"
    return nested_json.array_to_rows(t.spark.read.schema(schema).json(path), "outputs.hourly", ["site"])


@query("json_maps_to_wide", """
SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS time, value AS "T2M",
 CASE WHEN event_type <> 'error' THEN value * 2 END AS "PS" FROM events""")
def json_maps_to_wide(t):
    time = F.date_format("ts", "yyyyMMddHHmmss")
    second = F.when(F.col("event_type") != "error", F.create_map(time, F.col("value") * 2)).otherwise(
        F.create_map(F.lit("19000101000000"), F.lit(0.0)))
    docs = t.events.select("event_id", F.create_map(
        F.lit("T2M"), F.create_map(time, F.col("value")), F.lit("PS"), second).alias("parameter"))
    path = scratch_path(t.spark, "json")
    docs.write.json(path)
    schema = "event_id bigint, parameter map<string, map<string, double>>"
    return nested_json.maps_to_wide(t.spark.read.schema(schema).json(path), "parameter", ["T2M", "PS"], ["event_id"])


@query("header_offset_probe", "SELECT event_id, user_id, value FROM events")
def header_offset_probe(t):
    """Eight files, each with two lines of site text above its header, read back below it."""
    part = scratch_path(t.spark, "probe")
    body = t.events.select(F.pmod("event_id", F.lit(8)).cast("int").alias("p"), F.col("event_id").cast("long").alias("o"),
                           F.concat_ws(",", "event_id", "user_id", F.col("value").cast("string")).alias("value"))
    top = t.spark.range(8).select(F.col("id").cast("int").alias("p"), F.posexplode(F.array(
        F.lit("Latitude: 48.2"), F.lit("Longitude: 16.4"), F.lit("event,site,P"))).alias("o", "value"))
    top = top.select("p", (F.col("o") - (1 << 62)).cast("long").alias("o"), "value")
    (top.unionByName(body).repartition(8, "p").sortWithinPartitions("p", "o").select("p", "value")
     .write.partitionBy("p").text(part))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("value", T.DoubleType())])
    return probe.read_after_header(t.spark, part, schema, ["event", "P"]).select("event_id", "user_id", "value")


_WINDOWS_SQL = f"""
WITH {MODEL_ROWS_SQL} SELECT * EXCLUDE (i) FROM (SELECT site, split, ts, pos - min(pos) OVER (PARTITION BY site, split)
 AS split_pos, lag(value, 2) OVER w AS x0_value, lag(k, 2) OVER w AS x0_k, lag(value, 1) OVER w AS x1_value,
 lag(k, 1) OVER w AS x1_k, value AS y, row_number() OVER w AS i
 FROM m WINDOW w AS (PARTITION BY site, split ORDER BY ts)) WHERE i > 2"""


@query("windows_roundtrip", _WINDOWS_SQL)
def windows_roundtrip(t):
    path = scratch_path(t.spark, "windows")
    artifacts.write_windows(windows(t), path)
    return _flat(artifacts.read_windows(t.spark, path), 2)


@query("scaler_params", f"WITH {_FIT_SQL} {_ROUND_PARAMS}")
def scaler_params(t):
    path = scratch_path(t.spark, "scalers")
    artifacts.write_scalers(fit_params(t), path)
    return rounded(artifacts.read_scalers(t.spark, path))


@query("run_metadata", f"""
WITH {MODEL_ROWS_SQL}, w AS (SELECT split, row_number() OVER (PARTITION BY site, split ORDER BY ts) AS i FROM m)
SELECT 'value,k' AS feature_columns, 2::BIGINT AS lookback_window, 1::BIGINT AS forecast_horizon,
 count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'val') AS val_size,
 count(*) FILTER (split = 'test') AS test_size, 2::BIGINT AS n_features, 'value' AS target_column
FROM w WHERE i > 2""")
def run_metadata(t):
    path = scratch_path(t.spark, "metadata")
    artifacts.write_json(artifacts.run_metadata(windows(t), ["value", "k"], "value", 2, 1), path)
    row = t.spark.read.json(path)
    return row.withColumn("feature_columns", F.concat_ws(",", "feature_columns")).drop("preprocessing_date")


@query("cleaning_report", """
SELECT 'table' AS section, 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM events UNION ALL
SELECT 'table', 'columns', '3' UNION ALL
SELECT 'period', 'first', strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM events UNION ALL
SELECT 'period', 'last', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events UNION ALL
SELECT 'quality', 'clean', CAST(count(*) FILTER (event_type <> 'error') AS VARCHAR) FROM events UNION ALL
SELECT 'quality', 'source_interpolated', CAST(count(*) FILTER (event_type = 'error') AS VARCHAR) FROM events UNION ALL
SELECT 'quality', 'gap_filled', '0' UNION ALL
SELECT 'column', 'ts', 'UTC timestamp'""")
def cleaning_report(t):
    flag = clean.quality_flag(F.when(F.col("event_type") == "error", 1).otherwise(0))
    path = scratch_path(t.spark, "report")
    rows = t.events.select("event_id", "ts", flag.alias("data_quality"))
    artifacts.write_json(artifacts.cleaning_report(rows, "data_quality", "ts", {"ts": "UTC timestamp"}), path)
    return t.spark.read.json(path)


@query("metrics_roundtrip", METRICS_BY_SPLIT_SQL)
def metrics_roundtrip(t):
    path = scratch_path(t.spark, "metrics")
    artifacts.write_json(metrics.regression_metrics(persistence(t), by=["split"]), path)
    return rounded(t.spark.read.json(path), 5)
