"""Tree models, attributions, forecaster and persistence."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pvseries.operators import attribution as A
from pvseries.operators import boosting as B
from pvseries.operators import metrics as M
from pvseries.operators import models as ML
from pvseries.operators import series as S
from pvseries.session import scratch_path

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).select(
        "id", *[(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 100.0).alias(n)
                for s, n in enumerate(FEATURES[:3])], F.lit(4.0).alias("d"))
    return df.withColumn("y", F.when(F.col("a") > 5, F.col("b")).otherwise(2 * F.col("c")) + F.col("a")).cache()


@pytest.fixture(scope="module")
def model(rows):
    return B.fit_trees(rows, FEATURES, "y", trees=8, depth=3, rate=0.3)


def walked(feature, goes_left):
    """The leaf reached when ``goes_left`` tells the side at each node."""
    at = 0
    while feature[at] >= 0:
        at = 2 * at + 2 - goes_left(at)
    return at


@pytest.mark.parametrize("depth", [1, 5, 8])
def test_leaf_tables_reach_the_leaf_of_a_walk(depth):
    """Up to 256 leaves, so several words of bits; features that no node tests; missing values on either side."""
    rng, k, missing = np.random.default_rng(depth), 5, 20
    n = (1 << (depth + 1)) - 1
    feature = np.where((np.arange(n) < (1 << depth) - 1) & (rng.random(n) < .95), rng.integers(0, k - 1, n), -1)
    cut, gap = rng.integers(0, missing - 1, n), rng.random(n) < .5
    bins = rng.integers(0, missing + 1, (k, 300))
    got = B.LeafTables(feature, cut, gap, [missing] * k).leaves(list(bins))
    want = [walked(feature, lambda i: int(gap[i] if b[feature[i]] == missing else b[feature[i]] <= cut[i])) for b in bins.T]
    assert got.tolist() == want
    model = B.TreeModel(tuple("abcde"), 0.5, feature[None], cut[None] * 1.0, gap[None], rng.random((1, n)), np.ones((1, n)))
    x = np.where(bins.T == missing, np.nan, bins.T * 1.0)
    assert np.allclose(model.predict(x), 0.5 + model.value[0][want])
    assert (B.LeafTables(np.full(3, -1), np.zeros(3), np.zeros(3, bool), [missing] * k).leaves(list(bins)) == 0).all()


def test_files_of_blocks_follow_the_cores_not_the_rows(rows, monkeypatch):
    asked, pack = [], B.to_blocks
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    monkeypatch.setattr(B, "to_blocks", lambda *a: asked.append(a[-1]) or pack(*a))
    model = B.fit_trees(rows, FEATURES, "y", trees=B.REFRESH + 2, depth=2, rate=0.3)
    assert asked[0] <= 2 * rows.sparkSession.sparkContext.defaultParallelism
    assert (model.cover[:, 0] > 2200).all() and (model.cover[:, 0] < 2600).all()


def brute_force(model, x):
    """Shapley values by enumerating every coalition of all features."""
    def walk(t, i, inside):
        f = model.feature[t, i]
        if f < 0:
            return model.value[t, i]
        children = 2 * i + 1, 2 * i + 2
        if f in inside:
            left = model.missing_left[t, i] if math.isnan(x[f]) else x[f] <= model.threshold[t, i]
            return walk(t, children[0] if left else children[1], inside)
        return sum(walk(t, c, inside) * model.cover[t, c] / model.cover[t, i] for c in children)

    def game(inside):
        return model.base + sum(walk(t, 0, inside) for t in range(len(model.feature)))

    k = len(x)
    value = {s: game(set(s)) for r in range(k + 1) for s in itertools.combinations(range(k), r)}
    phi = np.zeros(k)
    for i in range(k):
        for s in value:
            if i not in s:
                w = math.factorial(len(s)) * math.factorial(k - len(s) - 1) / math.factorial(k)
                phi[i] += w * (value[tuple(sorted(s + (i,)))] - value[s])
    return phi, value[()]


def test_attributions_equal_enumeration(model, rows):
    few = rows.filter("id < 5")
    got = A.tree_attributions(model, few, FEATURES, ["id"]).toPandas()
    for r in few.collect():
        phi, base = brute_force(model, [r[f] for f in FEATURES])
        mine = got[got.id == r.id].set_index("feature").attribution
        np.testing.assert_allclose([mine[f] for f in FEATURES], phi, atol=1e-9)
        assert got.base.iloc[0] == pytest.approx(base)


def test_attributions_add_up_to_the_prediction(model, rows):
    parts = A.tree_attributions(model, rows, FEATURES, ["id"])
    total = parts.groupBy("id").agg((F.sum("attribution") + F.first("base")).alias("s"))
    off = (B.predict(model, rows, ["id"]).join(total, "id")
           .agg(F.max(F.abs(F.col("yhat") - F.col("s"))), F.count("*")).first())
    assert off[0] < 1e-9 and off[1] == 3000
    imp = A.feature_importance(parts, bar=0.5).toPandas().set_index("feature")
    assert imp.loc["d", "importance"] == 0 and imp.loc["d", "effect"] == "mixed"
    assert imp.loc["c", "effect"] == "up"
    assert imp.bar.str.len().eq((imp.importance / 0.5).astype(int)).all()
    assert A.dependence_table(parts, ["a", "b"]).count() == 6000
    binned = A.dependence_table(parts, ["a"], bins=10).toPandas()
    assert binned.n.sum() == 3000 and len(binned) == 10


def test_rows_with_missing_features_keep_their_signal(spark, rows):
    """Two values of three are missing at random, and a missing one adds 20 to the target."""
    holes = rows.withColumn("b", F.when(F.col("id") % 3 == 0, F.col("b"))).withColumn(
        "y", F.when(F.col("id") % 10 != 0, F.col("a") + F.when(F.col("b").isNull(), 20.0).otherwise(0.0)))
    model = B.fit_trees(holes, FEATURES, "y", trees=12, depth=3, rate=0.5)
    out = B.predict(model, holes, ["id", "y"])
    assert out.count() == 3000 and out.filter("yhat IS NULL OR isnan(yhat)").count() == 0
    m = M.regression_metrics(out).first()
    assert (m.n, m.n_missing) == (2700, 300) and m.r2 > 0.97
    parts = A.tree_attributions(model, holes.filter("b IS NULL"), FEATURES, ["id"])
    total = parts.groupBy("id").agg((F.sum("attribution") + F.first("base")).alias("s")).join(out, "id")
    assert total.count() == 2000 and total.filter("abs(s - yhat) > 1e-9").count() == 0
    few = holes.filter("id < 4")
    got = A.tree_attributions(model, few, FEATURES, ["id"]).toPandas()
    for r in few.collect():
        phi, _ = brute_force(model, [math.nan if r[f] is None else r[f] for f in FEATURES])
        np.testing.assert_allclose(got[got.id == r.id].set_index("feature").attribution[FEATURES], phi, atol=1e-9)


def test_deep_paths_add_up():
    """Twelve levels and twelve features on a path: far more patterns than could be tabulated."""
    rng = np.random.default_rng(3)
    depth, k = 12, 14
    n = (1 << (depth + 1)) - 1
    inner = np.arange(n) < (1 << depth) - 1
    order = np.stack([rng.permutation(k)[:depth] for _ in range(1)])[0]
    level = np.floor(np.log2(np.arange(n) + 1)).astype(int)
    feature = np.where(inner, order[np.minimum(level, depth - 1)], -1)
    cover = np.ones(n)
    for i in range((1 << depth) - 2, -1, -1):
        cover[i] = cover[2 * i + 1] + cover[2 * i + 2]
    cover[1:] *= 1.0
    model = B.TreeModel(tuple(map(str, range(k))), 1.5, feature[None], rng.random(n)[None], (rng.random(n) < .5)[None],
                        np.where(inner, 0.0, rng.random(n))[None], cover[None])
    base, tables = A.leaf_tables(model)
    x = np.where(rng.random((6, k)) < .2, np.nan, rng.random((6, k)))
    phi = A.attribute_rows(x, tables)
    np.testing.assert_allclose(phi.sum(1) + base, model.predict(x), atol=1e-9)
    assert (phi[:, np.setdiff1d(np.arange(k), order)] == 0).all()


def plain_boosting(x, y, edges, columns_of, drawn_of, trees, depth, rate):
    """The same trees, node by node over plain rows."""
    margin, fits = np.full(len(y), y.mean()), []

    def grow(k, i, rows, level, out):
        g = margin[rows] - y[rows]
        out[i] = -rate * g.sum() / (len(rows) + 1)
        best = (1e-9, None)
        if level < depth:
            for f in columns_of[k]:
                v, gap = x[rows, f], np.isnan(x[rows, f])
                for cut in [*edges[f], np.inf]:
                    for left in (gap | (v <= cut), ~gap & (v <= cut)):
                        a, b = g[left], g[~left]
                        if len(a) and len(b):
                            gain = a.sum() ** 2 / (len(a) + 1) + b.sum() ** 2 / (len(b) + 1) - g.sum() ** 2 / (len(g) + 1)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut, left[gap].all() if gap.any() else len(a) >= len(b)))
        if best[1]:
            f, cut, gap_left = best[1]
            v = x[:, f]
            side = np.where(np.isnan(v), gap_left, v <= cut)
            grow(k, 2 * i + 1, rows[side[rows]], level + 1, out)
            grow(k, 2 * i + 2, rows[~side[rows]], level + 1, out)
            out[i] = (f, cut, gap_left)

    def leaf(tree, r):
        i = 0
        while isinstance(tree[i], tuple):
            f, cut, gap_left = tree[i]
            left = gap_left if np.isnan(x[r, f]) else x[r, f] <= cut
            i = 2 * i + 1 if left else 2 * i + 2
        return tree[i]

    for k in range(trees):
        tree = {}
        grow(k, 0, drawn_of(k), 0, tree)
        margin = margin + np.array([leaf(tree, r) for r in range(len(y))])
        fits.append(tree)
    return margin


def test_trees_equal_plain_boosting(spark):
    """All rows and columns drawn, values that are their own bins: the fit must be the plain one."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (400, 3)).astype(float)
    x[rng.random((400, 3)) < .25] = np.nan
    y = np.where(np.isnan(x[:, 0]), 3.0, x[:, 0]) * np.where(x[:, 1] > 4, 1.5, -.5) + rng.normal(0, .3, 400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    model = B.fit_trees(df, ["a", "b", "c"], "y", trees=11, depth=3, rate=0.4, rows=1.0, columns=1.0, bins=200, tolerance=0.0, least_gain=0.0)
    edges = [np.unique(v[~np.isnan(v)])[:-1] for v in x.T]
    want = plain_boosting(x, y, edges, [[0, 1, 2]] * 11, lambda k: np.arange(400), 11, 3, 0.4)
    np.testing.assert_allclose(model.predict(x), want, atol=1e-6)


def test_model_survives_saving(spark, model, rows):
    path = scratch_path(spark, "model")
    B.save(model, spark, path)
    again = B.predict(B.load(spark, path), rows, ["id"])
    diff = again.join(B.predict(model, rows, ["id"]).withColumnRenamed("yhat", "o"), "id")
    assert diff.filter("yhat <> o").count() == 0
    assert M.regression_metrics(B.predict(model, rows)).first().r2 > 0.8


@pytest.mark.parametrize("kind,settings", [("linear", {}), ("gbt", {"trees": 10, "depth": 3, "rate": 0.3})])
def test_forecaster_learns_a_cycle(spark, kind, settings):
    hours = spark.range(600).select(
        F.lit(1).alias("site"), (F.lit("2024-01-01").cast("timestamp")
                                 + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"),
        (0.5 + 0.5 * F.sin(F.col("id") * math.pi / 12)).alias("v"))
    windows = S.lookback_windows(S.chrono_split(hours, ["site"], "ts"), ["site"], "ts", ["v"], "v", 3).cache()
    out = ML.forecast(ML.fit_forecaster(windows, kind, **settings), windows)
    score = {r.split: r.r2 for r in M.regression_metrics(out, by=["split"]).collect()}
    assert set(score) == {"train", "val", "test"} and score["test"] > 0.9


def test_metrics_match_their_definitions(spark):
    y, p = np.array([1.0, 2.0, 4.0, 7.0]), np.array([1.5, 1.5, 5.0, 6.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, yhat double")
    m, e = M.regression_metrics(df).first(), y - p
    assert m.mae == pytest.approx(abs(e).mean()) and m.rmse == pytest.approx(math.sqrt((e ** 2).mean()))
    assert m.r2 == pytest.approx(1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert m.nrmse == pytest.approx(m.rmse / 6 * 100)
    r = M.residual_summary(df).first()
    assert r["std"] == pytest.approx(e.std()) and r.max_overestimate == -1.0 and r.max_underestimate == 1.0
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, yhat double")
    assert M.regression_metrics(flat).first().r2 is None
