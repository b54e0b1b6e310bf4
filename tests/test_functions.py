"""Calendar parsing, labels and the sun's elevation."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pvseries.functions import calendar as cal
from pvseries.functions.solar import refraction, sun_elevation
from pvseries.operators import clean


def one(spark, expr, rows=((" 20190101:0030 ", 2019010105),), schema="a string, b long"):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("x")).first().x


def test_parsing(spark):
    assert one(spark, cal.format_utc(cal.align_half_hour(cal.parse_colon("a")))) == "2019-01-01 00:00:00+00:00"
    assert one(spark, cal.format_utc(cal.parse_compact("b"))) == "2019-01-01 05:00:00+00:00"
    assert one(spark, cal.parse_colon("a", strict=False), [("junk", 1)]) is None
    assert one(spark, cal.parse_compact("b", strict=False), [("x", 7)]) is None
    with pytest.raises(PySparkException):
        one(spark, cal.parse_colon("a"), [("junk", 1)])


def test_local_time_is_converted_on_request(spark):
    df = spark.createDataFrame([(2024, 7, 1, 12)], "year int, month int, day int, hour int")
    parts = ("year", "month", "day", "hour")
    text = lambda c: df.select(cal.format_utc(c).alias("x")).first().x
    assert text(cal.from_parts(*parts)) == "2024-07-01 12:00:00+00:00"
    assert text(cal.from_parts(*parts, local_tz="Europe/Kyiv")) == "2024-07-01 09:00:00+00:00"


def test_labels(spark):
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = months.select(cal.season(F.col("m")).alias("a"), cal.season(F.col("m"), "temperate").alias("b"),
                        cal.month_name(F.col("m")).alias("c")).collect()
    assert [r.a for r in got][8:] == ["Monsoon", "Post-Monsoon", "Post-Monsoon", "Winter"]
    assert [r.b for r in got][8:] == ["Fall", "Fall", "Fall", "Winter"] and got[11].c == "Dec"
    r = spark.createDataFrame([(0.2,), (-0.2,), (0.05,), (None,)], "r double")
    assert [x[0] for x in r.select(cal.effect_label(F.col("r"))).collect()] == ["up", "down", "mixed", "mixed"]


# Solar noon elevation is 90 - |latitude - declination|; declinations of the almanac.
NOON = [("2024-06-20 12:02:00", 51.4779, 0.0, 90 - 51.4779 + 23.437),
        ("2024-12-21 11:58:00", 51.4779, 0.0, 90 - 51.4779 - 23.437),
        ("2024-03-20 12:07:30", 0.0, 0.0, 89.85)]


@pytest.mark.parametrize("ts,lat,lon,want", NOON)
def test_noon_elevation(spark, ts, lat, lon, want):
    df = spark.createDataFrame([(ts,)], "t string").withColumn("t", F.to_timestamp("t"))
    got = df.select(sun_elevation("t", lat, lon, 0.0)).first()[0]
    assert got == pytest.approx(want, abs=0.2)


def test_sunrise_and_refraction(spark):
    # Published sunrise at Greenwich on 2024-06-20: 03:43 UTC, centre at -0.833 degrees.
    df = spark.createDataFrame([("2024-06-20 03:43:00",)], "t string").withColumn("t", F.to_timestamp("t"))
    assert df.select(sun_elevation("t", 51.4779, 0.0, 0.0)).first()[0] == pytest.approx(-0.83, abs=0.1)
    lift = lambda e: spark.range(1).select(refraction(F.lit(e), F.lit(101000.0), F.lit(10.0))).first()[0]
    assert lift(0.0) == pytest.approx(0.48, abs=0.03) and lift(45.0) == pytest.approx(0.0167, abs=0.002)
    assert lift(-2.0) == 0.0


def test_guards_and_flags(spark):
    df = spark.createDataFrame([(1.0, "x", float("nan"), -1), (-99.0, "7", None, 2)], "a double, s string, n double, i int")
    with pytest.raises(ValueError, match="missing"):
        clean.require_columns(df, ["a", "gone"])
    out = clean.sentinels_to_null(clean.tolerant_cast(df, ["s"])).collect()
    assert [(r.a, r.s, r.n, r.i) for r in out] == [(1.0, None, None, -1), (None, 7.0, None, 2)]
    assert [r.f for r in df.select(cal.daytime_flag("s").alias("f")).collect()] == [0, 1]
    flags = df.select(clean.quality_flag(F.col("a")).alias("data_quality"))
    assert [r[0] for r in flags.collect()] == [1, 0]
    assert clean.quality_filter(flags, 0).count() == 2 and clean.quality_filter(flags, 1).count() == 1
    assert clean.quality_filter(flags, keep_flags=[0]).count() == 1
    assert dt.date(2024, 2, 29) == spark.range(1).select(
        F.to_date(cal.parse_iso(F.lit("2024-02-29T05:00:00+00:00")))).first()[0]
