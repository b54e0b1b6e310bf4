"""Density with far outliers, regression bands, sketches, observed joins, per-site scaling and published versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvseries.config import MINMAX, FeatureGroup
from pvseries.operators import distributions as D
from pvseries.operators import joins as J
from pvseries.operators import profile as P
from pvseries.operators import scaling as S
from pvseries.plans import prepare
from pvseries.session import fingerprint, scratch_path, write_text
from pvseries.sources import artifacts


def density(values, grid, bw=None):
    bw = bw or values.std(ddof=1) * len(values) ** -0.2
    x = values.min() + np.arange(grid) * (values.max() - values.min()) / (grid - 1)
    return x, np.array([np.exp(-0.5 * ((p - values) / bw) ** 2).sum() for p in x]) / (len(values) * bw * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("n", [300, 6000])
def test_density_equals_the_sum_over_rows(spark, n):
    rng = np.random.default_rng(n)
    groups = {"a": rng.normal(0, 1, n), "b": np.exp(rng.normal(0, 2, n)), None: rng.random(n), "flat": np.full(3, 2.0), "one": np.array([5.0])}
    pdf = pd.DataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], columns=["g", "v"])
    got = D.kde_curve(spark.createDataFrame(pdf, "g string, v double"), "v", ["g"], grid=25).toPandas()
    assert len(got) == 25 * 5
    for g in ("a", "b", None):
        mine = got[got.g.isna() if g is None else got.g == g].sort_values("point")
        x, want = density(groups[g], 25)
        np.testing.assert_allclose(mine.x, x)
        np.testing.assert_allclose(mine.density, want, rtol=5e-3, atol=1e-9)
    assert got[got.g.isin(["flat", "one"])].density.isna().all()


def test_a_far_outlier_adds_no_work(spark):
    """Cells meet the grid points in reach only: their number of meetings does not grow with the range."""
    rng = np.random.default_rng(2)
    values = rng.random(4000)
    for extra in ([], [1e9]):
        df = spark.createDataFrame([(float(v),) for v in [*values, *extra]], "v double")
        curve = D.kde_curve(df, "v", grid=200)
        assert curve.count() == 200 and curve.filter("density IS NULL OR density < 0").count() == 0
        step = curve.agg((F.max("x") - F.min("x")) / 199).first()[0]
        area = curve.agg(F.sum("density")).first()[0] * step
        assert 0 < area < 1.2 or extra


def test_regression_band_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    x = rng.random(800) * 10
    rows = [(i, float(a), float(3 * a + 2 + e)) for i, (a, e) in enumerate(zip(x, rng.normal(0, 2, 800)))] + [(900, None, 1.0), (901, 1.0, math.nan)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    bands = [D.regression_band(df.repartition(k), "x", "y", ["id"], samples=60, grid=5).orderBy("point").toPandas() for k in (1, 7)]
    np.testing.assert_allclose(bands[0], bands[1], rtol=1e-9)
    b = bands[0]
    assert (b.lo < b.yhat).all() and (b.yhat < b.hi).all()
    # About two standard errors of the line on either side.
    se = 2 * np.sqrt(1 / 800 + (b.x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    width = (b.hi - b.lo) / (2 * 1.96 * se)
    assert width.between(0.6, 1.5).all()


def test_poisson_weights_have_mean_and_variance_one(spark):
    df = spark.range(4000).select("id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    chance = np.searchsorted(D._POISSON, np.arange(256), "right")
    assert abs(chance.mean() - 1) < 0.01 and abs(chance.var() - 1) < 0.03
    assert D.regression_band(df, "x", "y", ["id"], samples=3, grid=2).filter("lo IS NOT NULL").count() == 0


def test_sketches_merge_to_the_sketch_of_the_union(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("site"), (F.col("id") % 3).alias("year"), (F.col("id") % 20_011).alias("v"),
                                    F.when(F.col("id") % 5 > 0, F.col("id") % 40).alias("w"))
    held = P.distinct_sketches(df, ["v", "w"], ["site", "year"], precision=12)
    whole = P.distinct_sketches(df.withColumn("k", F.lit(1)), ["v", "w"], ["k"], precision=12)
    once = {r["column"]: r["n_distinct"] for r in P.merged_distinct(whole).collect()}
    merged = {r["column"]: r["n_distinct"] for r in P.merged_distinct(held).collect()}
    assert merged["w"] == once["w"] == 32
    error = 0.83 / math.sqrt(2 ** 12)
    for found in (once, merged):
        assert abs(found["v"] / 20_011 - 1) < 4 * error
    by_year = {(r["year"], r["column"]): r["n_distinct"] for r in P.merged_distinct(held, ["year"]).collect()}
    assert all(abs(by_year[y, "v"] / 20_000 - 1) < 4 * error for y in range(3)) and len(by_year) == 6


def test_observed_audit_equals_the_audit(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", 9)], "site string, ts int")
    right = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 6.0), ("b", 1, 7.0), ("d", 4, 8.0)], "site string, ts int, v double")
    path = scratch_path(spark, "observed")
    got = J.write_joined(left, right, ["site", "ts"], path).first()
    assert tuple(got) == tuple(J.join_audit(left, right, ["site", "ts"]).first()) == (5, 4, 6, 3)
    assert spark.read.parquet(path).columns == ["site", "ts", "v"] and spark.read.parquet(path).count() == 6


def test_per_site_scaling_keeps_rows_without_a_site(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 10.0), (None, 30.0)], "site string, v double")
    params = S.fit_scalers(df, [FeatureGroup("g", ("v",), MINMAX)], ["site"])
    out = S.apply_scaling(df, params, ["site"])
    assert sorted((r.site or "", r.v) for r in out.collect()) == [("", 0.0), ("", 1.0), ("a", 0.0), ("a", 1.0)]
    back = S.invert_scaling(out, params, {"v": "v"}, ["site"])
    assert sorted(r.v for r in back.collect()) == [1.0, 3.0, 10.0, 30.0]


def windows(spark, n, y=0.5):
    split = F.when(F.col("id") < n * 0.7, "train").when(F.col("id") < n * 0.9, "val").otherwise("test")
    return spark.range(n).select(F.lit("s").alias("site"), split.alias("split"), F.array(F.array(F.lit(0.1), F.lit(0.2))).alias("x"),
                                 F.lit(y).alias("y"))


def test_only_checked_versions_are_published(spark):
    root, params = scratch_path(spark, "versions"), spark.createDataFrame([("f", 1.0)], "feature string, scale double")
    assert artifacts.published_version(spark, root) is None
    for _ in range(2):
        with pytest.raises(ValueError, match="target_in_range"):
            prepare.publish_windows(windows(spark, 50, 9.0), params, root, min_train=10)
    assert artifacts.published_version(spark, root) is None
    first, _ = prepare.publish_windows(windows(spark, 50), params, root, min_train=10)
    assert artifacts.published_version(spark, root) == first
    second, row = prepare.publish_windows(windows(spark, 80), params, root, min_train=10)
    with pytest.raises(ValueError):
        prepare.publish_windows(windows(spark, 5), params, root, min_train=10)
    with pytest.raises(RuntimeError):  # whatever fails before the manifest is written leaves no trace either
        prepare.publish_windows(windows(spark, 90), params, root, min_train=10, extras=lambda folder: (_ for _ in ()).throw(RuntimeError()))
    folder = artifacts.published_version(spark, root)
    assert folder == second != first and row["train_size"] == 56
    assert artifacts.read_windows(spark, f"{folder}/windows").count() == 80
    assert artifacts.read_windows(spark, f"{first}/windows").count() == 50  # readers of the old version are not cut off


def test_text_files_are_replaced_whole(spark):
    path = scratch_path(spark, "note")
    write_text(spark, path, "one")
    mark = fingerprint(spark, path)
    write_text(spark, path, "two")
    assert spark.read.text(path).first()[0] == "two" and fingerprint(spark, path) != mark
