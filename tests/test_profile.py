"""Quantiles, profiles and distributions on shapes the test tables do not have."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvseries.operators import clean, distributions as D, profile as P
from pvseries.operators.quantiles import exact_quantiles

PROBS = [0.5, 0.0, 0.25, 0.75, 0.999, 1.0]


def shapes():
    rng = np.random.default_rng(4)
    n = 30_000
    return {
        "uniform": rng.random(n),
        "heavy_tail": np.exp(rng.normal(0, 4, n)),
        "third_equal": np.where(rng.random(n) < 0.34, 7.0, rng.normal(7, 2, n)),
        "few_values": rng.integers(0, 5, n).astype(float),
        "constant": np.full(n, 3.5),
        "outlier": np.r_[rng.random(n - 1), 1e12],
    }


@pytest.mark.parametrize("accuracy,limit", [(10_000, 200_000), (200, 200_000), (200, 40)])
def test_quantiles_equal_pandas(spark, accuracy, limit):
    """The small limit divides brackets and cells again and again."""
    pdf = pd.DataFrame(shapes())
    got = exact_quantiles(spark.createDataFrame(pdf).repartition(5), list(pdf), PROBS,
                          accuracy=accuracy, limit=limit).toPandas().set_index("column")
    for c in pdf:
        np.testing.assert_allclose(got.loc[c, [f"q{i}" for i in range(len(PROBS))]].astype(float),
                                   pdf[c].quantile(PROBS), rtol=1e-12)


@pytest.mark.parametrize("limit", [200_000, 50])
def test_grouped_quantiles_skip_missing(spark, limit):
    rng = np.random.default_rng(8)
    size = [1, 2, 3, 400, 401, 5000, 12_001]
    pdf = pd.DataFrame({"g": np.repeat(np.arange(len(size)), size), "v": rng.normal(size=sum(size))})
    pdf.loc[rng.random(len(pdf)) < 0.1, "v"] = np.nan
    got = exact_quantiles(spark.createDataFrame(pdf), ["v"], [0.25, 0.5, 0.9], ["g"], limit=limit).toPandas()
    want = pdf.dropna().groupby("g").v
    got = got.set_index("g").sort_index()
    assert (got.n == want.size()).all()
    for i, q in enumerate((0.25, 0.5, 0.9)):
        np.testing.assert_allclose(got[f"q{i}"], want.quantile(q), rtol=1e-12)


def test_quantiles_with_infinities_and_missing_groups(spark):
    """Extremes that no difference can span, and rows without a group."""
    values = [-math.inf, -1.7e308, *np.linspace(-3, 3, 500), 1.7e308, math.inf, math.inf]
    df = spark.createDataFrame([(g, float(v)) for g in ("a", None) for v in values], "g string, v double")
    got = exact_quantiles(df, ["v"], [0.0, 0.1, 0.5, 1.0], ["g"], limit=10).collect()
    want = pd.Series(values).sort_values(ignore_index=True)
    assert {r.g for r in got} == {"a", None}
    for r in got:
        assert (r.n, r.q0, r.q3) == (len(values), -math.inf, math.inf)
        assert r.q1 == pytest.approx(want.iloc[1:].quantile((0.1 * (len(want) - 1) - 1) / (len(want) - 2)))
        assert r.q2 == pytest.approx(want[252])


def test_empty_and_all_missing_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert [r.column for r in exact_quantiles(df, ["a", "b"], [0.5]).collect()] == ["a"]
    rows = {r.column: r for r in P.describe(df, ["a", "b"]).collect()}
    assert rows["a"].p50 == 1.5 and rows["b"]["count"] == 0 and rows["b"].p50 is None
    empty = df.limit(0)
    assert P.null_profile(empty).filter("rows <> 0").count() == 0
    assert D.histogram(empty, "a", 4).agg(F.sum("n")).first()[0] == 0


def test_constant_column(spark):
    df = spark.range(20).select(F.lit(2.0).alias("c"), F.col("id").cast("double").alias("v"))
    assert P.correlation_matrix(df, ["c", "v"]).first().r is None
    assert P.iqr_outliers(df, ["c"]).first().outliers == 0
    hist = D.histogram(df, "c", 5).orderBy("bin").toPandas()
    assert list(hist.n) == [20, 0, 0, 0, 0]
    assert P.shape_moments(df, ["v"]).first()["shape"] == "symmetric"


def test_histogram_counts_everything(spark):
    pdf = pd.DataFrame({"v": shapes()["third_equal"]})
    hist = D.histogram(spark.createDataFrame(pdf), "v", 40).orderBy("bin").toPandas()
    counts, edges = np.histogram(pdf.v, bins=40)
    assert hist.n.sum() == len(pdf) and abs(hist.n - counts).sum() <= 2
    np.testing.assert_allclose(hist.left_edge, edges[:-1])


@pytest.mark.parametrize("cut", [0.0, 2.0])
def test_density_close_to_the_exact_kernel_sum(spark, cut):
    pdf = pd.DataFrame({"g": [0, 1] * 1500, "v": np.random.default_rng(2).gamma(2.0, 3.0, 3000)})
    got = D.kde_curve(spark.createDataFrame(pdf), "v", ["g"], cut=cut).toPandas()
    for g, part in pdf.groupby("g"):
        v = part.v.to_numpy()
        bw = v.std(ddof=1) * len(v) ** -0.2
        mine = got[got.g == g].sort_values("point")
        x = np.linspace(v.min() - cut * bw, v.max() + cut * bw, 200)
        np.testing.assert_allclose(mine.x, x)
        z = (x[:, None] - v[None, :]) / bw
        exact = np.exp(-0.5 * z * z).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))
        np.testing.assert_allclose(mine.density, exact, rtol=2e-3, atol=1e-6)


def test_category_codes_follow_pandas(spark):
    values = ["rain", "clear-day", None, "clear-night", "cloudy", "", "rain", "Snow", "zz", "ré", "é"]
    pdf = pd.DataFrame({"id": range(len(values)), "icon": values})
    got = P.category_codes(spark.createDataFrame(pdf, "id long, icon string"), "icon").orderBy("id").toPandas()
    want = pdf.icon.astype(pd.CategoricalDtype(sorted(v for v in set(values) if v is not None))).cat.codes
    assert list(got.code) == list(want)


def test_duplicates_with_missing_keys_and_a_hot_key(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.when(F.col("id") < 10, None).otherwise(F.col("id").cast("string"))).alias("k"))
    assert clean.list_duplicates(df, ["k"]).count() == 1000 + 6
    first = clean.dedupe_first(df, ["k"], ["id"])
    assert first.filter("k = 'hot'").first().id == 0 and first.count() == 3000 - 999 - 5
    audit = P.completeness_checks(df.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), "ts").first()
    assert (audit.n_rows, audit.n_duplicates, audit.complete) == (3000, 2999, 0)


def test_seeded_sample_is_repeatable_and_capped(spark):
    df = spark.range(5000).repartition(7)
    a = {r.id for r in D.seeded_sample(df, ["id"], 200).collect()}
    b = {r.id for r in D.seeded_sample(df.repartition(3), ["id"], 200).collect()}
    assert a == b and len(a) == 200
    assert D.seeded_sample(df.limit(10), ["id"], 200).count() == 10
    assert {r.id for r in D.seeded_sample(df, ["id"], 200, seed=1).collect()} != a


def test_sample_of_a_large_table_equals_the_plain_ordering(spark):
    df = spark.range(600_000)
    plain = df.orderBy(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit("42"))), "id").limit(100)
    assert {r.id for r in D.seeded_sample(df, ["id"], 100).collect()} == {r.id for r in plain.collect()}
    lumpy = df.select("id", F.lit(1).alias("k"))
    assert D.seeded_sample(lumpy, ["k"], 100).count() == 100
