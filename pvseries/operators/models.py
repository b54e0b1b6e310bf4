"""Forecasters on look-back windows, fitted and applied with Spark ML."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.session import use_checkpoints


def boosted_trees(features_col: str = "features", label: str = "y", trees: int = 200, depth: int = 5,
                  rate: float = 0.05, seed: int = 42, validation: str | None = None) -> GBTRegressor:
    """Squared-loss boosting with 80 % row and column subsampling.

    With ``validation`` (a boolean column) boosting stops once the error on those rows no
    longer improves, and the best prefix of trees is kept.
    """
    gbt = GBTRegressor(featuresCol=features_col, labelCol=label, predictionCol="yhat", maxIter=trees,
                       maxDepth=depth, stepSize=rate, subsamplingRate=0.8,
                       featureSubsetStrategy="0.8", seed=seed, cacheNodeIds=True)
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def flatten_windows(windows: DataFrame) -> DataFrame:
    """Turn the look-back matrix into one vector, oldest row first."""
    return windows.withColumn("features", array_to_vector(F.flatten("x")))


def fit_forecaster(windows: DataFrame, kind: str = "gbt", **settings):
    """A forecaster on look-back windows; trees stop early on the ``val`` split."""
    use_checkpoints(windows.sparkSession)
    rows = flatten_windows(windows.filter(F.col("split").isin("train", "val")).dropna(subset=["y"]))
    rows = rows.withColumn("is_val", F.col("split") == "val").select("features", "y", "is_val")
    if kind == "linear":
        model = LinearRegression(featuresCol="features", labelCol="y", predictionCol="yhat", **settings)
        return model.fit(rows.filter(~F.col("is_val")))
    return boosted_trees(validation="is_val", **settings).fit(rows)


def forecast(model, windows: DataFrame) -> DataFrame:
    return model.transform(flatten_windows(windows)).drop("features", "x")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
