"""End-to-end jobs on synthetic sites."""

import dataclasses
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvseries.config import GRIDDED, STATION, STATION_DAY
from pvseries.functions.calendar import season
from pvseries.operators import checks, scaling
from pvseries.plans import cleaning, explore, forecast, prepare
from pvseries.schemas import STATION_RAW
from pvseries.session import scratch_path
from pvseries.sources import artifacts

CUT = 20


def gridded_files(days=40, seed=0, start="2020-02-10"):
    rng = np.random.default_rng(seed)
    ts = pd.date_range(start, periods=24 * days, freq="h")
    n = len(ts)
    sun = 60 * np.sin((ts.hour - 6) * np.pi / 12)
    beam = np.clip(sun * 10, 0, None) * rng.random(n)
    panel = pd.DataFrame({
        "time": (ts + pd.Timedelta(minutes=30)).strftime("%Y%m%d:%H%M"), " P ": np.round(beam * 0.8, 2).astype(str),
        "Gb(i)": beam, "Gd(i)": beam * 0.2, "Gr(i)": beam * 0.01, "H_sun": sun,
        "T2m": 20 + 5 * np.sin(ts.hour / 4), "WS10m": rng.random(n) * 9, "Int": (rng.random(n) < 0.02).astype(float)})
    panel.loc[[5, 6, 90], "T2m"] = -999.0
    panel.loc[200:220, "WS10m"] = -9999.0
    panel.loc[7, " P "] = "n/a"
    weather = pd.DataFrame({
        "time": ts.strftime("%Y%m%d%H").astype("int64"), "T2M": 1.0, "RH2M": rng.random(n) * 100, "WS10M": 2.0,
        "PS": 95 + rng.random(n), "ALLSKY_SFC_SW_DWN": beam})
    weather.loc[300:302, "PS"] = -999.0
    weather = weather.drop(index=range(400, 410))
    year = pd.date_range("2015-01-01", periods=365 * 24, freq="h")
    typical = pd.DataFrame({"time(UTC)": " " + year.strftime("%Y%m%d:%H%M"), "WD10m": rng.random(len(year)) * 360})
    return panel, weather, typical


@pytest.fixture(scope="module")
def sites(spark):
    frames = {name: gridded_files(seed=i) for i, name in enumerate(("north", "south"))}
    merged = [pd.concat([f[k].assign(site=n) for n, f in frames.items()]) for k in range(3)]
    return frames, [spark.createDataFrame(m).repartition(3) for m in merged]


def thirty_hours(spark):
    """Hours from noon of 28 February 2020 on: gaps of 2 and 8, both edges, each sentinel, an unmatched hour, a leap day."""
    ts = pd.date_range("2020-02-28 12:00", periods=30, freq="h")
    code = {0: -999.0, 1: -9999.0, 5: -99.0, 6: -999.0, 29: -9999.0} | {h: -999.0 for h in range(10, 18)}
    panel = pd.DataFrame([{
        "site": "a", "time": (t + pd.Timedelta(minutes=30)).strftime("%Y%m%d:%H%M"), " P ": "n/a" if h == 7 else str(h * 10.0),
        "Gb(i)": 1.0, "Gd(i)": 2.0, "Gr(i)": 3.0, "H_sun": 10.0, "T2m": code.get(h, float(h)), "WS10m": 4.0,
        "Int": float(h == 3)} for h, t in enumerate(ts)])
    weather = pd.DataFrame([{
        "site": "a", "time": int(t.strftime("%Y%m%d%H")), "T2M": 1.0, "RH2M": 2.0 * h, "WS10M": 2.0,
        "PS": -999.0 if h == 4 else 100.0, "ALLSKY_SFC_SW_DWN": 0.0} for h, t in enumerate(ts) if h != 20])
    year = pd.date_range("2015-02-27", periods=96, freq="h")
    typical = pd.DataFrame({"site": "a", "time(UTC)": " " + year.strftime("%Y%m%d:%H%M"), "WD10m": year.hour.astype(float)})
    return [spark.createDataFrame(f).repartition(3) for f in (panel, weather, typical)]


@pytest.mark.parametrize("chunks", [None, CUT], ids=["session", "many"])
def test_gridded_cleaning_by_hand(spark, chunks):
    panel, weather, typical = thirty_hours(spark)
    early = F.col("time") < 2020022900
    out = cleaning.clean_gridded(panel, [weather.filter(early), weather.filter(~early)], typical, chunks=chunks)
    assert out.columns == ["site", "datetime", "P", "G_i", "Gb_i", "Gd_i", "Gr_i", "H_sun", "T2m", "WS10m", "RH",
                           "SP", "WD10m", "data_quality"]
    rows = out.orderBy("datetime").collect()
    warm = [float(h) for h in range(30)]
    # Edges take the nearest value; of the gap of 8 only three rows from each side are on the line.
    warm[0] = warm[1] = 2.0
    warm[13] = warm[14] = 12.0
    warm[29] = 28.0
    assert [r.T2m for r in rows] == pytest.approx(warm)
    assert [r.RH for r in rows] == pytest.approx([2.0 * h for h in range(30)])
    assert [r.P for r in rows] == [None if h == 7 else h * 10.0 for h in range(30)]
    assert [r.WD10m for r in rows] == [float(h + 12) if h < 12 else 23.0 for h in range(30)]
    assert {r.SP for r in rows} == {100_000.0} and {r.G_i for r in rows} == {6.0}
    assert [r.data_quality for r in rows] == [int(h == 3) for h in range(30)]


def test_leap_day_and_filled_flag(sites):
    _, (panel, weather, typical) = sites
    out = cleaning.clean_gridded(panel, [weather], typical, mark_filled=True).filter("site = 'north'")
    day = out.filter("to_date(datetime) = '2020-02-29'")
    assert day.filter("data_quality = 0").count() == 0 and day.filter("WD10m is null").count() == 0
    assert out.filter("data_quality = 2").count() > 24


def station_rows():
    hours = pd.date_range("2022-10-29 20:00", periods=120, freq="h")
    rng = np.random.default_rng(3)
    rows = []
    for i, t in enumerate(hours):
        light = max(0, int(500 * np.sin((t.hour - 6) * np.pi / 12)))
        rows.append((t.year, t.month, t.day, t.hour, float(light) if light else -1.0, 10.0 + rng.random(), 9.0, 5.0, 70.0,
                     0.0, 0.0, None, 0.0, 0.0, 5.0, 4.0, 180.0, 1012.0, 50.0 * rng.random(), 10.0, light, 1.0, 2, 10,
                     "Clear", "clear-day", "A1"))
    again = list(rows[7])
    again[4] = 999.0
    rows.insert(8, tuple(again))
    lost = list(rows[50])
    lost[4] = None
    rows[50] = tuple(lost)
    return rows


def test_station_cleaning(spark):
    rows = [(*r, i) for i, r in enumerate(station_rows())]
    raw = spark.createDataFrame(rows, STATION_RAW.simpleString()[7:-1].replace(":", " ") + ", pos long")
    out = cleaning.clean_station(cleaning.with_site(raw, "east").repartition(4), 48.2, 16.4, "pos")
    assert "preciptype" not in out.columns and out.columns[:2] == ["site", "Datetime"]
    pdf = out.toPandas()
    assert len(pdf) == 119 and pdf.Datetime.is_unique and pdf.generation.min() == 0
    twice = pdf[pdf.Datetime == dt.datetime(2022, 10, 30, 3)]
    assert twice.generation.iloc[0] != 999.0
    assert set(pdf.season) == {"Fall"} and pdf.sunheight.between(-60, 40).all()
    again = cleaning.clean_station(cleaning.with_site(raw, "east"), 48.2, 16.4, "pos", pressure_scale=100.0)
    lift = again.agg(F.max("sunheight")).first()[0] - out.agg(F.max("sunheight")).first()[0]
    assert 0 < lift < 0.1


def hourly_site(spark, n, name="a"):
    """A clean gridded table whose daylight rows number exactly ``n``."""
    ids = spark.range(n)
    ts = F.lit("2019-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))
    noise = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 10.0)
    cols = {"G_i": 1.0 + noise(1), "Gb_i": noise(2), "Gd_i": noise(3), "Gr_i": noise(4), "T2m": noise(5), "WS10m": noise(6),
            "RH": noise(7), "SP": noise(8), "H_sun": noise(9) - 50, "WD10m": noise(10), "P": noise(1) * 2}
    return ids.select(F.lit(name).alias("site"), ts.alias("datetime"), *[c.alias(k) for k, c in cols.items()],
                      F.lit(0).alias("data_quality"))


def test_prepare_reproduces_the_known_window_counts(spark):
    """8,787 daylight rows give 6,148 / 1,756 / 877 windows of 2 x 18."""
    done = prepare.prepare(hourly_site(spark, 8787), GRIDDED, chunks=20)
    row = done.checks.first()
    assert (row.train_size, row.val_size, row.test_size) == (6148, 1756, 877)
    assert row.finite and row.same_shape and row.enough_train and row.train_largest
    first = done.windows.first()
    assert len(first.x) == 2 and len(first.x[0]) == 18 == len(GRIDDED.features)
    if row.passed:
        path = scratch_path(spark, "prepared")
        prepare.write_prepared(done, path)
        path = artifacts.published_version(spark, path)
        assert artifacts.read_windows(spark, f"{path}/windows", "test").count() == 877
        meta = spark.read.json(f"{path}/metadata").first()
        assert (meta.train_size, meta.n_features, meta.target_column) == (6148, 18, "P")
        info = spark.read.json(f"{path}/feature_info").first()
        assert info.angle_features == ["H_sun", "WD10m"]
    train = [r.data_min for r in done.params.filter("feature = 'P'").collect()]
    assert len(train) == 1


def test_gate_blocks_a_small_set(spark):
    done = prepare.prepare(hourly_site(spark, 100), GRIDDED)
    path = scratch_path(spark, "blocked")
    with pytest.raises(ValueError, match="enough_train"):
        prepare.write_prepared(done, path)
    assert artifacts.published_version(spark, path) is None
    with pytest.raises(Exception):
        spark.read.parquet(f"{path}/versions/*/windows").count()


def test_scaling_round_trip_and_no_leakage(spark):
    df = hourly_site(spark, 300).withColumn("split", F.when(F.col("datetime") < "2019-01-08", "train").otherwise("test"))
    df = df.withColumn("T2m", F.when(F.col("split") == "test", 1e6).otherwise(F.col("T2m"))).withColumn("RH", F.lit(4.0))
    for keys in ([], ["site"]):
        params = scaling.fit_scalers(df.filter("split = 'train'"), GRIDDED.scaled, keys)
        fit = {r.feature: r for r in params.collect()}
        assert fit["T2m"].data_max < 1e6 and fit["RH"].scale == 1.0
        scaled = scaling.apply_scaling(df, params, keys)
        span = scaled.filter("split = 'train'").agg(*[F.min("H_sun"), F.max("H_sun"), F.avg("T2m"), F.stddev_pop("T2m"),
                                                      F.max("RH")]).first()
        np.testing.assert_allclose(span, [-1, 1, 0, 1, 0], atol=1e-9)
        back = scaling.invert_scaling(scaled, params, {"P": "P", "T2m": "T2m", "RH": "RH"}, keys)
        off = back.join(df.select("datetime", F.col("P").alias("p0"), F.col("T2m").alias("t0")), "datetime")
        assert off.agg(F.max(F.abs(F.col("P") - F.col("p0")) + F.abs(F.col("T2m") - F.col("t0")) / 1e6)).first()[0] < 1e-6
    table = scaling.group_table(spark, GRIDDED.groups, "P").toPandas()
    assert list(table.feature)[:-1] == GRIDDED.features and len(STATION.features) == 18 and len(STATION_DAY.features) == 28


def test_interaction_maxima_come_from_training_rows(spark):
    df = spark.createDataFrame([("train", 10.0, 4.0, 2.0), ("test", 100.0, 8.0, 3.0)],
                               "split string, cloudcover double, solarradiation double, temp double")
    rows = {r.split: r for r in scaling.interaction_features(df, fit_on=F.col("split") == "train").collect()}
    assert rows["test"].cloud_rad == 20.0 and rows["test"].temp_rad == 6.0
    assert scaling.interaction_features(df).filter("split = 'test'").first().cloud_rad == 1.0
    dark = df.withColumn("solarradiation", F.lit(0.0))
    assert scaling.interaction_features(dark).first().temp_rad == 0.0


def test_checks_see_bad_values(spark):
    df = spark.createDataFrame([("train", [[1.0, float("nan")]], 0.1), ("train", [[1.0, 2.0]], 0.5), ("val", [[1.0]], 2.0),
                                ("test", [[1.0, None]], -0.1)], "split string, x array<array<double>>, y double")
    row = checks.window_checks(df, min_train=2, inclusive=True).first()
    assert (row.finite, row.target_in_range, row.same_shape, row.enough_train, row.train_largest) == (0, 0, 0, 1, 1)
    assert not row.passed and checks.window_checks(df, min_train=2).first().enough_train == 0


def test_explore_runs_every_table(sites):
    _, (panel, weather, typical) = sites
    clean = cleaning.clean_gridded(panel, [weather], typical).cache()
    tables = explore.explore(clean, (2020,))
    counts = {k: v.count() for k, v in tables.items()}
    assert counts["diurnal"] == 24 and counts["describe"] == 11 and counts["correlation"] == 55
    assert counts["seasonal"] == 4 and counts["power_density"] == 200 and counts["pairs_sample"] <= 2000
    assert all(counts.values())
    report = artifacts.cleaning_report(clean, "data_quality", "datetime", cleaning.GRIDDED_UNITS)
    lines = {(r.section, r.metric): r.value for r in report.collect()}
    assert lines[("table", "rows")] == "1920" and lines[("table", "columns")] == "14"
    assert cleaning.export_gridded(clean).orderBy("datetime").first().datetime == "2020-02-10 00:00:00+00:00"


def test_tree_study_and_window_study(spark):
    df = hourly_site(spark, 600).withColumn("month", F.month("datetime"))
    study = forecast.tree_study(df, trees=5, depth=3, rate=0.3, sample=50)
    assert study.metrics.first().r2 > 0.5
    top = study.importance.first()
    assert top.feature == "G_i" and top.effect == "up" and study.attributions.count() == 50 * 14
    with pytest.raises(ValueError, match="enough_train"):
        forecast.window_study(prepare.prepare(df, GRIDDED), "linear")
    done = prepare.prepare(df, dataclasses.replace(GRIDDED, min_train=100))
    _, scored, metrics = forecast.window_study(done, "linear")
    assert {r.split for r in metrics.collect()} == {"val", "test"}
    assert scored.agg(F.max("y")).first()[0] > 50


def test_seasons_cover_the_year(spark):
    labels = spark.range(1, 13).select(season(F.col("id").cast("int")).alias("s"))
    assert labels.filter("s is null").count() == 0
