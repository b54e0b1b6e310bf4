"""Series operators against pandas, with the session's chunks and with many."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pvseries.operators import series as S

CUT = 40
SPECS = pytest.mark.parametrize("chunks", [None, CUT], ids=["session", "many"])


def build(n_sites=3, n=400, seed=1, holes=True):
    """Irregular minutes; site 0 has gaps of many shapes, the others random ones."""
    rng = np.random.default_rng(seed)
    frames = []
    for site in range(n_sites):
        size = n if site == 0 else int(rng.integers(1, 60))
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 90, size)), unit="min")
        v = rng.normal(20, 5, size).round(3)
        u = rng.normal(0, 1, size).round(3)
        if holes and site == 0:
            for a, b in ((0, 4), (20, 21), (40, 45), (60, 66), (100, 123), (390, 399)):
                v[a:b + 1] = np.nan
        u[rng.random(size) < 0.4] = np.nan
        frames.append(pd.DataFrame({"site": site, "ts": ts, "v": v, "u": u}))
    frames.append(pd.DataFrame({"site": 99, "ts": pd.to_datetime(["2024-01-01", "2024-01-02"]),
                                "v": [np.nan, np.nan], "u": [np.nan, 1.0]}))
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=3))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("v", "u")}).repartition(3)


def collect(df):
    return df.toPandas().sort_values(["site", "ts"]).reset_index(drop=True)


def pandas_fill(pdf, limit, fill):
    out = pdf.copy()
    for _, idx in out.groupby("site").groups.items():
        part = out.loc[idx].set_index("ts")
        for c in ("v", "u"):
            done = part[c]
            if limit != 0:
                done = done.interpolate(method="time", limit=limit, limit_direction="both")
            out.loc[idx, c] = (done.ffill().bfill() if fill else done).values
    return out


@SPECS
@pytest.mark.parametrize("limit,fill", [(3, True), (3, False), (1, True), (None, False)])
def test_interpolate_matches_pandas(spark, chunks, limit, fill):
    pdf = build()
    got = collect(S.interpolate_time(to_spark(spark, pdf), ["site"], "ts", ["v", "u"], limit=limit,
                                     then_fill=fill, chunks=chunks))
    want = pandas_fill(pdf, limit, fill).sort_values(["site", "ts"])
    for c in ("v", "u"):
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=0, atol=1e-9)


@SPECS
def test_fill_matches_pandas(spark, chunks):
    pdf = build(seed=5)
    got = collect(S.ffill_bfill(to_spark(spark, pdf), ["site"], "ts", ["v", "u"], chunks=chunks))
    want = pandas_fill(pdf, 0, True)
    for c in ("v", "u"):
        np.testing.assert_array_equal(got[c].astype(float), want[c])


def test_max_gap_leaves_long_gaps(spark):
    pdf = build(n_sites=1)
    got = collect(S.interpolate_time(to_spark(spark, pdf), ["site"], "ts", ["v"], max_gap=3,
                                     then_fill=False, chunks=CUT))
    site = got[got.site == 0].reset_index(drop=True)
    assert site.v[20:22].notna().all()
    assert site.v[40:46].isna().all() and site.v[100:124].isna().all()


@SPECS
def test_positions_splits_and_gaps(spark, chunks):
    pdf = build(seed=9)
    df = to_spark(spark, pdf)
    want = pdf.sort_values(["site", "ts"]).reset_index(drop=True)
    by = want.groupby("site")
    want["pos"], n = by.cumcount(), by.site.transform("size")
    got = collect(S.row_position(df, ["site"], "ts", chunks=chunks))
    assert (got.pos == want.pos).all()

    cut1, cut2 = (n * 0.7).astype(int), (n * (0.7 + 0.2)).astype(int)
    split = np.where(want.pos < cut1, "train", np.where(want.pos < cut2, "val", "test"))
    got = collect(S.chrono_split(df, ["site"], "ts", chunks=chunks))
    assert (got.split == split).all()
    start = np.where(split == "train", 0, np.where(split == "val", cut1, cut2))
    assert (got.split_pos == want.pos - start).all()

    got = collect(S.tail_holdout(df, ["site"], "ts", chunks=chunks))
    assert ((got.split == "test") == (want.pos >= n - np.ceil(n * 0.2))).all()

    gaps = S.gap_audit(df, ["site"], "ts", chunks=chunks).toPandas().set_index("gap_seconds").n.to_dict()
    assert gaps == by.ts.diff().dt.total_seconds().dropna().value_counts().to_dict()


@pytest.mark.parametrize("rows", [1_000_000, 9])
@pytest.mark.parametrize("lookback,horizon", [(2, 1), (3, 2), (5, 4)])
def test_windows_match_a_plain_loop(spark, rows, lookback, horizon):
    pdf = build(seed=2, holes=False).assign(u=lambda d: d.u.fillna(0)).query("site != 99")
    split = S.chrono_split(to_spark(spark, pdf), ["site"], "ts", chunks=CUT)
    got = S.lookback_windows(split, ["site"], "ts", ["v", "u"], "v", lookback, horizon, rows=rows).toPandas()
    seen = {(r.site, r.split, r.split_pos): r for r in got.itertuples()}
    count = 0
    for (site, part), g in collect(split).groupby(["site", "split"]):
        g = g.sort_values("ts")
        data, y = g[["v", "u"]].to_numpy(), g.v.to_numpy()
        for i in range(lookback, len(g) - horizon + 1):
            row = seen[(site, part, i + horizon - 1)]
            np.testing.assert_array_equal(np.array([list(a) for a in row.x]), data[i - lookback:i])
            assert row.y == y[i + horizon - 1]
            count += 1
    assert count == len(got)


def test_windows_can_reject_gaps(spark):
    ts = pd.date_range("2024-01-01", periods=10, freq="h").append(
        pd.date_range("2024-01-02 12:00", periods=10, freq="h"))
    pdf = pd.DataFrame({"site": 1, "ts": ts, "v": np.arange(20.0), "u": 0.0})
    df = (S.row_position(to_spark(spark, pdf), ["site"], "ts", col="split_pos")
          .withColumn("split", F.lit("train")))
    full = S.lookback_windows(df, ["site"], "ts", ["v"], "v", 3)
    kept = S.lookback_windows(df, ["site"], "ts", ["v"], "v", 3, max_gap_seconds=3600)
    assert full.count() == 17
    assert sorted(kept.toPandas().y) == [3, 4, 5, 6, 7, 8, 9, 13, 14, 15, 16, 17, 18, 19]


def test_single_row_and_empty_input(spark):
    one = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), None, None)],
                                "site int, ts timestamp, v double, u double")
    assert collect(S.interpolate_time(one, ["site"], "ts", ["v"])).v.isna().all()
    empty = one.limit(0)
    assert S.interpolate_time(empty, ["site"], "ts", ["v"]).count() == 0
    assert S.chrono_split(empty, ["site"], "ts").count() == 0


@pytest.mark.parametrize("shape", ["early stamp", "no site", "burst"])
def test_chunks_are_even_in_any_shape(spark, shape):
    """A third of all rows belongs to one site; no chunk holds more than twice the mean."""
    hot = F.lit(None).cast("long") if shape == "no site" else F.lit(-1).cast("long")
    site = F.when(F.col("id") % 3 == 0, hot).otherwise(F.col("id") % 50)
    seconds = F.col("id") if shape != "burst" else F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.col("id"))
    ts = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=seconds.cast("int")))
    if shape == "early stamp":
        ts = F.when(F.col("id") == 0, F.lit("1970-01-01").cast("timestamp")).otherwise(ts)
    df = spark.range(60_000).select(site.alias("site"), ts.alias("ts"), "id")
    cut = S.Chunked(df, ["site"], "ts", ["id"], chunks=30)
    sizes = cut.df.groupBy("__chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 60_000 / 30
    got = cut.positioned("pos", "n").done("pos", "n").groupBy("site").agg(
        F.countDistinct("pos").alias("d"), F.max("pos").alias("top"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert all(r.d == r.rows == r.n == r.top + 1 for r in got.collect())
