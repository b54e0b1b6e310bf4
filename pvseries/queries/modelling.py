"""Scaling, window checks, models, metrics and attributions."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from pvseries.config import MINMAX, STANDARD, FeatureGroup
from pvseries.operators import attribution, boosting, checks, metrics, models, scaling, series
from pvseries.operators import distributions as dist
from pvseries.plans import prepare
from pvseries.queries.base import MODEL_ROWS_SQL, model_rows, query, rounded
from pvseries.session import exists, fingerprint, run_dir, scratch_path
from pvseries.sources import artifacts
from pvseries.sources.tables import materialise

GROUPS = (FeatureGroup("spatial", ("value",), MINMAX), FeatureGroup("temporal", ("k",), STANDARD),
          FeatureGroup("angle", ("hour",), MINMAX, -1.0, 1.0))
TREES = {"trees": 200, "depth": 5, "rate": 0.05}

_FIT_SQL = f"""
{MODEL_ROWS_SQL},
tr AS (SELECT * FROM m WHERE split = 'train'),
st AS (SELECT 'value' AS feature, 'spatial' AS "group", 'minmax' AS kind, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi,
 min(value) AS data_min, max(value) AS data_max, avg(value) AS mean, stddev_pop(value) AS std FROM tr UNION ALL
 SELECT 'k', 'temporal', 'standard', 0, 1, min(k), max(k), avg(k), stddev_pop(k) FROM tr UNION ALL
 SELECT 'hour', 'angle', 'minmax', -1, 1, min(hour), max(hour), avg(hour), stddev_pop(hour) FROM tr),
pa AS (SELECT *, CASE WHEN kind = 'minmax' THEN (hi - lo) / (data_max - data_min) ELSE 1 / std END AS scale,
 CASE WHEN kind = 'minmax' THEN lo - data_min * ((hi - lo) / (data_max - data_min)) ELSE -mean / std END AS "offset"
 FROM st)"""
_ROUND_PARAMS = """SELECT feature, "group", kind, lo, hi, data_min, data_max, round(mean, 6) AS mean,
 round(std, 6) AS std, round(scale, 6) AS scale, round("offset", 6) AS "offset" FROM pa"""
_ONE = lambda f, col: f"(SELECT {col} FROM pa WHERE feature = '{f}')"
_SCALED_SQL = ", ".join(f"round({f} * {_ONE(f, 'scale')} + {_ONE(f, chr(34) + 'offset' + chr(34))}, 6) AS {f}"
                        for f in ("value", "k", "hour"))


def split_rows(t):
    return series.chrono_split(model_rows(t), ["site"], "ts")


def fit_params(t):
    """Scaler parameters straight from the split plan: one aggregate."""
    return scaling.fit_scalers(split_rows(t).filter("split = 'train'"), GROUPS)


def fitted(t):
    """The split rows and their scaler parameters, both saved, for queries that read both."""
    rows = materialise(split_rows(t), "split")
    return rows, materialise(scaling.fit_scalers(rows.filter("split = 'train'"), GROUPS), "scalers")


@query("fit_minmax", f"WITH {_FIT_SQL} {_ROUND_PARAMS} WHERE kind = 'minmax'")
def fit_minmax(t):
    return rounded(fit_params(t).filter("kind = 'minmax'"))


@query("fit_standard", f"WITH {_FIT_SQL} {_ROUND_PARAMS} WHERE kind = 'standard'")
def fit_standard(t):
    return rounded(fit_params(t).filter("kind = 'standard'"))


@query("fit_per_site", f"""
WITH {MODEL_ROWS_SQL} SELECT site, 'value' AS feature, min(value) AS data_min, max(value) AS data_max,
 round(avg(value), 6) AS mean FROM m WHERE split = 'train' GROUP BY 1""")
def fit_per_site(t):
    train = split_rows(t).filter("split = 'train'")
    return rounded(scaling.fit_scalers(train, GROUPS[:1], ["site"]).select(
        "site", "feature", "data_min", "data_max", "mean"))


@query("scaler_report", f"""
WITH {_FIT_SQL} SELECT feature, "group", kind, round(data_min, 2) AS data_min, round(data_max, 2) AS data_max,
 round(mean, 2) AS mean, round(std, 2) AS std FROM pa""")
def scaler_report(t):
    return scaling.scaler_report(fit_params(t))


@query("apply_scaling", f"WITH {_FIT_SQL} SELECT site, ts, split, {_SCALED_SQL} FROM m")
def apply_scaling(t):
    rows, params = fitted(t)
    return rounded(scaling.apply_scaling(rows, params).select("site", "ts", "split", "value", "k", "hour"))


@query("inverse_scaling", f"WITH {MODEL_ROWS_SQL} SELECT site, ts, round(value, 6) AS value, round(k, 6) AS k FROM m")
def inverse_scaling(t):
    rows, params = fitted(t)
    scaled = scaling.apply_scaling(rows, params)
    back = scaling.invert_scaling(scaled, params, {"value": "value", "k": "k"})
    return rounded(back.select("site", "ts", "value", "k"))


@query("feature_vector", """
SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_discount AS f1, l_tax AS f2, 3 AS n_features FROM lineitem""")
def feature_vector(t):
    df = scaling.feature_vector(t.lineitem, ["l_quantity", "l_discount", "l_tax"])
    f = F.col("features")
    return df.select("l_orderkey", "l_linenumber", f[0].alias("f0"), f[1].alias("f1"), f[2].alias("f2"),
                     F.size(f).alias("n_features"))


def scaled_windows(t):
    rows, params = fitted(t)
    scaled = scaling.apply_scaling(rows, params)
    return series.lookback_windows(scaled, ["site"], "ts", ["value", "k", "hour"], "value", 2), params


@query("window_checks", f"""
WITH {_FIT_SQL}, y AS (SELECT split, value * {_ONE('value', 'scale')} + {_ONE('value', '"offset"')} AS y,
 row_number() OVER (PARTITION BY site, split ORDER BY ts) AS i FROM m),
c AS (SELECT count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'val') AS val_size,
 count(*) FILTER (split = 'test') AS test_size, (min(y) >= 0 AND max(y) <= 1.5)::INTEGER AS target_in_range
 FROM y WHERE i > 2)
SELECT 1 AS finite, target_in_range, (train_size > val_size AND train_size > test_size)::INTEGER AS train_largest,
 1 AS same_shape, (train_size > 1000)::INTEGER AS enough_train, train_size, val_size, test_size,
 (target_in_range + (train_size > val_size AND train_size > test_size)::INTEGER + (train_size > 1000)::INTEGER = 3)
 ::INTEGER AS passed FROM c""")
def window_checks(t):
    return checks.window_checks(scaled_windows(t)[0])


@query("per_site_scaling", f"""
WITH {MODEL_ROWS_SQL}, s AS (SELECT CASE WHEN site % 5 > 0 THEN site END AS site, ts, split, value, hour FROM m),
p AS (SELECT site, min(value) AS v0, max(value) AS v1, min(hour) AS h0, max(hour) AS h1 FROM s WHERE split = 'train' GROUP BY 1)
SELECT s.site, s.ts, s.split, round((value - v0) / (v1 - v0), 6) AS value, round(2 * (hour - h0) / (h1 - h0) - 1, 6) AS hour
FROM s LEFT JOIN p ON s.site IS NOT DISTINCT FROM p.site""")
def per_site_scaling(t):
    """Scalers per site; every fifth site is unknown, and its rows are fitted and scaled as one."""
    rows = materialise(split_rows(t), "split").withColumn("site", F.when(F.col("site") % 5 > 0, F.col("site")))
    groups = (FeatureGroup("spatial", ("value",), MINMAX), FeatureGroup("angle", ("hour",), MINMAX, -1.0, 1.0))
    params = materialise(scaling.fit_scalers(rows.filter("split = 'train'"), groups, ["site"]), "scalers")
    return rounded(scaling.apply_scaling(rows, params, ["site"]).select("site", "ts", "split", "value", "hour"))


@query("window_stats", f"""
WITH {MODEL_ROWS_SQL}, b AS (SELECT site, split, ts, k, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS value FROM m),
w AS (SELECT split, value AS y, row_number() OVER o AS i, lag(value, 1) OVER o AS a, lag(value, 2) OVER o AS c,
 coalesce(isfinite(value), false) AS good FROM b WINDOW o AS (PARTITION BY site, split ORDER BY ts))
SELECT split, count(*) AS n, count(*) FILTER (NOT (coalesce(isfinite(a), false) AND coalesce(isfinite(c), false))) AS bad_x,
 count(*) FILTER (NOT good) AS bad_y, min(y) AS y_min, max(y) AS y_max FROM w WHERE i > 2 GROUP BY 1""")
def window_stats(t):
    """Windows with missing and infinite values in them."""
    value = F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 11 == 0, float("inf")).otherwise(F.col("value"))
    rows = split_rows(t).withColumn("value", value)
    w = series.lookback_windows(rows, ["site"], "ts", ["value", "k"], "value", 2)
    return checks.window_stats(w).select("split", "n", "bad_x", "bad_y", "y_min", "y_max")


@query("publish_gate", f"""
WITH {MODEL_ROWS_SQL}, w AS (SELECT split, row_number() OVER (PARTITION BY site, split ORDER BY ts) AS i FROM m),
g AS (SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
 FROM w WHERE i > 2)
SELECT attempt, CASE WHEN attempt > 1 THEN train END AS train, CASE WHEN attempt > 1 THEN val END AS val,
 CASE WHEN attempt > 1 THEN test END AS test FROM g, (SELECT unnest([1, 2, 3]) AS attempt)""")
def publish_gate(t):
    """What readers find after a bad set of windows, a good one, and a bad one again."""
    w, params = scaled_windows(t)
    root, told = scratch_path(t.spark, "published"), []
    for attempt, rows in enumerate((w.withColumn("y", F.col("y") + 10), w, w.withColumn("y", F.col("y") - 10)), 1):
        try:
            prepare.publish_windows(rows, params, root, min_train=10)
        except ValueError:
            pass
        folder = artifacts.published_version(t.spark, root)
        sizes = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
        found = artifacts.read_windows(t.spark, f"{folder}/windows").agg(*sizes).first() if folder else (None, None, None)
        told.append((attempt, *found))
    return t.spark.createDataFrame(told, "attempt int, train long, val long, test long")


# -- metrics ----------------------------------------------------------------------

def _linear(t):
    yhat = F.col("l_quantity") * 1500.0 + F.col("l_tax") * 10000.0 + 14000.0
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), yhat.alias("yhat"))


_LINEAR_SQL = "d AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 + l_tax * 10000.0 + 14000.0 AS yhat FROM lineitem)"
_METRICS_SQL = """count(y - yhat) AS n,
 count(*) FILTER (y - yhat IS NULL) AS n_missing, round(avg((y - yhat) * (y - yhat)), {d}) AS mse, round(avg(abs(y - yhat)), {d}) AS mae,
 round(sqrt(avg((y - yhat) * (y - yhat))), {d}) AS rmse,
 round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), {d}) AS r2,
 round(sqrt(avg((y - yhat) * (y - yhat))) / (max(y) - min(y)) * 100, {d}) AS nrmse"""


@query("regression_metrics", f"WITH {_LINEAR_SQL} SELECT {_METRICS_SQL.format(d=3)} FROM d")
def regression_metrics(t):
    return rounded(metrics.regression_metrics(_linear(t)), 3)


@query("residual_summary", f"""
WITH {_LINEAR_SQL} SELECT count(*) AS n, round(avg(y - yhat), 4) AS mean, round(stddev_pop(y - yhat), 4) AS std,
 round(avg(y - yhat) - stddev_pop(y - yhat), 4) AS band_lo, round(avg(y - yhat) + stddev_pop(y - yhat), 4) AS band_hi,
 round(min(y - yhat), 4) AS max_overestimate, round(max(y - yhat), 4) AS max_underestimate FROM d""")
def residual_summary(t):
    return rounded(metrics.residual_summary(_linear(t)), 4)


@query("residual_table", f"WITH {_LINEAR_SQL} SELECT y, yhat, round(y - yhat, 6) AS residual FROM d")
def residual_table(t):
    return rounded(metrics.with_residual(_linear(t)))


def persistence(t):
    """Windows scored with their last known value, in original units."""
    w, params = scaled_windows(t)
    last = w.withColumn("yhat", F.col("x")[F.size("x") - 1][0]).select("site", "split", "ts", "y", "yhat")
    return scaling.invert_scaling(last, params, {"y": "value", "yhat": "value"})


METRICS_BY_SPLIT_SQL = f"""
WITH {MODEL_ROWS_SQL}, d AS (SELECT split, value AS y, lag(value) OVER w AS yhat, row_number() OVER w AS i FROM m
 WINDOW w AS (PARTITION BY site, split ORDER BY ts))
SELECT split, {_METRICS_SQL.format(d=5)} FROM d WHERE i > 2 GROUP BY split"""


@query("metrics_by_split", METRICS_BY_SPLIT_SQL)
def metrics_by_split(t):
    return rounded(metrics.regression_metrics(persistence(t), by=["split"]), 5)


# -- models -----------------------------------------------------------------------

# Known effects: two steps up or down, and one of a day that is missing in two rows of three.
STEPS = (("l_quantity", 40, "l_quantity > 25"), ("l_discount", -20, "l_discount > 0.055"), ("ship_day", 12, "ship_day IS NULL"))
FEATURES = ("l_quantity", "l_discount", "ship_day", "l_tax", "month_sin", "month_cos")
KEY = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]
SAMPLE = 2000
TARGET = " + ".join(f"{size} * CAST({step} AS INT)" for _, size, step in STEPS)
SHIP_DAY = "CASE WHEN day(l_shipdate) <= 10 THEN day(l_shipdate) END"

_HOLDOUT_SQL = f"""
a AS (SELECT *, {SHIP_DAY} AS ship_day FROM lineitem),
h AS (SELECT *, CASE WHEN l_orderkey % 50 > 0 THEN ({TARGET})::DOUBLE END AS target,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
 count(*) OVER (PARTITION BY l_suppkey) AS size FROM a),
train AS (SELECT * FROM h WHERE pos < size - ceil(size * 0.2::DOUBLE) AND target IS NOT NULL),
test AS (SELECT * FROM h WHERE pos >= size - ceil(size * 0.2::DOUBLE)),
picked AS (SELECT * FROM test ORDER BY md5(concat_ws('|', l_suppkey, l_orderkey, l_linenumber, l_partkey, 42)),
 l_suppkey, l_orderkey, l_linenumber, l_partkey LIMIT 2000)"""

# A step's attribution is what it adds beyond its mean over the training rows; other features add nothing.
_EFFECTS_SQL = " UNION ALL ".join(
    [f"SELECT p.*, '{f}' AS feature, {f}::DOUBLE AS v, {size} * (({step})::INT - (SELECT avg(({step})::INT) FROM train)) AS phi FROM picked p"
     for f, size, step in STEPS]
    + [f"SELECT p.*, '{f}', {v}, 0 FROM picked p" for f, v in (("l_tax", "l_tax"), ("month_sin", "NULL"), ("month_cos", "NULL"))])


def _study(t):
    """(model, hold-out rows, attributions of a sample of them).

    Trees on line items, one series per supplier with its last fifth held out. The four queries that
    read the study share one fit per run: it is saved under the checksum of the table's files.
    """
    base = f"{run_dir(t.spark)}/study-{fingerprint(t.spark, f'{t.folder}/lineitem.parquet')}"
    if not exists(t.spark, f"{base}/attributions/_SUCCESS"):
        angle = 2 * 3.141592653589793 * F.month("l_shipdate") / 12
        rows = t.lineitem.withColumn("ship_day", F.expr(SHIP_DAY)).select(
            "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "ship_day",
            F.when(F.col("l_orderkey") % 50 > 0, F.expr(TARGET).cast("double")).alias("target"),
            F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"))
        split = series.tail_holdout(rows, ["l_suppkey"], "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey"])
        split.write.mode("overwrite").parquet(f"{base}/holdout")
        split = t.spark.read.parquet(f"{base}/holdout")
        model = boosting.fit_trees(split.filter("split = 'train'"), FEATURES, "target", **TREES)
        boosting.save(model, t.spark, f"{base}/model")
        picked = dist.seeded_sample(split.filter("split = 'test'"), KEY, SAMPLE)
        parts = attribution.tree_attributions(model, picked, FEATURES, KEY)
        parts.write.mode("overwrite").parquet(f"{base}/attributions")
    return (boosting.load(t.spark, f"{base}/model"), t.spark.read.parquet(f"{base}/holdout").filter("split = 'test'"),
            t.spark.read.parquet(f"{base}/attributions"))


def _whole(c):
    """Rounded to a whole number, so that what the oracle derives from the steps must be met to within a half."""
    return F.round(c).cast("long")


@query("gbt_forecast_metrics", f"""
WITH {_HOLDOUT_SQL} SELECT l_quantity > 25 AS much, l_discount > 0.055 AS reduced, ship_day IS NULL AS no_day, count(target) AS n,
 count(*) FILTER (target IS NULL) AS n_missing, round(avg({TARGET}))::BIGINT AS yhat,
 (stddev_pop(target) + avg(target) - min({TARGET}))::BIGINT AS rmse FROM test GROUP BY 1, 2, 3""")
def gbt_forecast_metrics(t):
    """Per combination of steps, which has one target: rows, mean prediction and error, as whole numbers."""
    model, test, _ = _study(t)
    cell = ["much", "reduced", "no_day"]
    # Saved: two aggregates read it, and each would run the trees on every row.
    scored = materialise(boosting.predict(model, test.withColumns({
        "much": F.expr("l_quantity > 25"), "reduced": F.expr("l_discount > 0.055"), "no_day": F.expr("ship_day IS NULL")}),
        [*cell, "target"]), "tree-scores")
    told = metrics.regression_metrics(scored, "target", by=cell).select(*cell, "n", "n_missing", _whole("rmse").alias("rmse"))
    return told.join(scored.groupBy(*cell).agg(_whole(F.avg("yhat")).alias("yhat")), cell)


@query("tree_attributions", f"""
WITH {_HOLDOUT_SQL}, e AS ({_EFFECTS_SQL}) SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, feature, (4 * round(phi / 4))::BIGINT AS attribution FROM e""")
def tree_attributions(t):
    """Every feature of every sampled row, to the nearest 4: chance ties the features a little, the steps are independent."""
    return _study(t)[2].select(*KEY, "feature", (4 * _whole(F.col("attribution") / 4)).alias("attribution"))


@query("feature_importance", f"""
WITH {_HOLDOUT_SQL}, e AS ({_EFFECTS_SQL}),
i AS (SELECT feature, round(avg(abs(phi)))::BIGINT AS importance, floor(avg(abs(phi)) / 3)::INTEGER AS bars,
 CASE WHEN feature IN ('l_quantity', 'l_discount') THEN round(corr(v, phi), 1) END AS corr FROM e GROUP BY 1)
SELECT rank() OVER (ORDER BY importance DESC) AS rank, feature, importance, repeat('█', bars) AS bar, corr,
 CASE WHEN corr > 0 THEN 'up' WHEN corr < 0 THEN 'down' ELSE 'none injected' END AS effect FROM i""")
def feature_importance(t):
    """All features; direction and correlation only where the target has a step in the feature's values."""
    out = attribution.feature_importance(_study(t)[2], bar=3.0).withColumn("importance", _whole("importance"))
    known = F.col("feature").isin("l_quantity", "l_discount")
    # One row per feature.
    return out.select(F.rank().over(Window.orderBy(F.desc("importance"))).cast("long").alias("rank"), "feature", "importance", "bar",
                      F.when(known, F.round("corr", 1)).alias("corr"), F.when(known, F.col("effect")).otherwise("none injected").alias("effect"))


def _bins_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * 10), 0)::BIGINT, 9) AS bin, count(*) AS n,
 round(avg(v), 6) AS value, round(avg(phi))::BIGINT AS attribution
 FROM e, (SELECT min(v) AS lo, max(v) AS hi FROM e WHERE feature = '{c}') WHERE feature = '{c}' GROUP BY 1, 2"""


@query("dependence_table", f"""
WITH {_HOLDOUT_SQL}, e AS ({_EFFECTS_SQL}) {' UNION ALL '.join(map(_bins_sql, ('l_quantity', 'l_discount', 'l_tax')))}""")
def dependence_table(t):
    out = attribution.dependence_table(_study(t)[2], ["l_quantity", "l_discount", "l_tax"], bins=10)
    return out.select("feature", "bin", "n", F.round("value", 6).alias("value"), _whole("attribution").alias("attribution"))


@query("window_forecaster", f"""
WITH {MODEL_ROWS_SQL}, w AS (SELECT split, row_number() OVER (PARTITION BY site, split ORDER BY ts) AS i FROM m)
SELECT split, count(*) AS n, 1 AS beats_persistence FROM w WHERE i > 2 AND split <> 'train' GROUP BY split""")
def window_forecaster(t):
    """Rows scored per split, and whether the error is below that of the last known value."""
    w, params = scaled_windows(t)
    w = materialise(w, "windows")
    last = F.col("x")[F.size("x") - 1][0].alias("last")
    scored = models.forecast(models.fit_forecaster(w, **TREES), w.select("*", last)).select("site", "split", "ts", "y", "yhat", "last")
    back = scaling.invert_scaling(scored, params, {"y": "value", "yhat": "value", "last": "value"})
    rows = materialise(back.filter("split <> 'train'"), "scored")
    own = metrics.regression_metrics(rows, by=["split"]).select("split", "n", "rmse")
    naive = metrics.regression_metrics(rows, yhat="last", by=["split"]).select("split", F.col("rmse").alias("naive"))
    return own.join(naive, "split").select("split", "n", (F.col("rmse") < F.col("naive")).cast("int").alias("beats_persistence"))


@query("linear_forecaster", f"""
WITH {_FIT_SQL}, w AS (SELECT split, value * {_ONE('value', 'scale')} + {_ONE('value', '"offset"')} AS y, site, ts FROM m),
p AS (SELECT split, y, lag(y) OVER (PARTITION BY site, split ORDER BY ts) AS x FROM w)
SELECT round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM p WHERE split = 'train' AND x IS NOT NULL""")
def linear_forecaster(t):
    """One look-back row of one feature: the least-squares line. The model is saved and loaded again."""
    rows, params = fitted(t)
    scaled = scaling.apply_scaling(rows, params)
    w = materialise(series.lookback_windows(scaled, ["site"], "ts", ["value"], "value", 1), "windows")
    path = scratch_path(t.spark, "linear")
    models.save_model(models.fit_forecaster(w, "linear"), path)
    model = LinearRegressionModel.load(path)
    return t.spark.createDataFrame([(round(float(model.coefficients[0]), 5), round(float(model.intercept), 5))],
                                   "slope double, intercept double")
