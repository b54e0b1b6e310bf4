"""Schemas of the raw files. Names and order are fixed values: they must match the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T


def _struct(kind: T.DataType, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


PANEL_HOURLY = T.StructType(
    _struct(T.StringType(), ["time"])
    + _struct(T.DoubleType(), ["P", "Gb(i)", "Gd(i)", "Gr(i)", "H_sun", "T2m", "WS10m", "Int"]))

WEATHER_PARAMETERS = ("T2M", "RH2M", "WS10M", "PS", "ALLSKY_SFC_SW_DWN")
WEATHER_HOURLY = T.StructType(
    _struct(T.StringType(), ["time"]) + [T.StructField(p, T.DoubleType()) for p in WEATHER_PARAMETERS])

TYPICAL_YEAR = T.StructType(_struct(T.StringType(), ["time(UTC)"]) + _struct(T.DoubleType(), ["WD10m"]))

HOURLY_JSON = T.StructType([T.StructField("outputs", T.StructType([
    T.StructField("hourly", T.ArrayType(PANEL_HOURLY)),
    T.StructField("tmy_hourly", T.ArrayType(TYPICAL_YEAR))]))])

PARAMETER_JSON = T.StructType([T.StructField("properties", T.StructType([
    T.StructField("parameter", T.MapType(
        T.StringType(), T.MapType(T.StringType(), T.DoubleType())))]))])

STATION_RAW = T.StructType(
    _struct(T.IntegerType(), ["year", "month", "day", "hour"])
    + _struct(T.DoubleType(), ["generation", "temp", "feelslike", "dew", "humidity", "precip", "precipprob"])
    + _struct(T.StringType(), ["preciptype"])
    + _struct(T.DoubleType(), ["snow", "snowdepth", "windgust", "windspeed", "winddir", "sealevelpressure", "cloudcover", "visibility"])
    + _struct(T.IntegerType(), ["solarradiation"])
    + _struct(T.DoubleType(), ["solarenergy"])
    + _struct(T.IntegerType(), ["uvindex", "severerisk"])
    + _struct(T.StringType(), ["conditions", "icon", "stations"]))

SITE_META = T.StructType([
    T.StructField("inputs", T.StructType([
        T.StructField("location", T.StructType(_struct(T.DoubleType(), ["latitude", "longitude", "elevation"]))),
        T.StructField("meteo_data", T.StructType(
            _struct(T.StringType(), ["radiation_db", "meteo_db"])
            + _struct(T.IntegerType(), ["year_min", "year_max"])
            + _struct(T.BooleanType(), ["use_horizon"]))),
        T.StructField("mounting_system", T.StructType([T.StructField("fixed", T.StructType([
            T.StructField("slope", T.StructType(
                _struct(T.DoubleType(), ["value"]) + _struct(T.BooleanType(), ["optimal"]))),
            T.StructField("azimuth", T.StructType(
                _struct(T.DoubleType(), ["value"]) + _struct(T.BooleanType(), ["optimal"]))),
            T.StructField("type", T.StringType())]))])),
        T.StructField("pv_module", T.StructType(
            _struct(T.StringType(), ["technology"]) + _struct(T.DoubleType(), ["peak_power", "system_loss"])))]))])
