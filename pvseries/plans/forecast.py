"""Fit, evaluate and explain forecasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.config import TREE_FEATURES
from pvseries.functions import calendar as cal
from pvseries.operators import attribution, boosting, checks, metrics, models, scaling, series
from pvseries.operators.distributions import seeded_sample
from pvseries.plans.prepare import Prepared
from pvseries.sources.tables import materialise


# The features of the dependence figures.
DEPENDENCE = ("G_i", "H_sun", "T2m", "RH")


@dataclass(frozen=True)
class TreeStudy:
    model: boosting.TreeModel
    metrics: DataFrame
    attributions: DataFrame
    importance: DataFrame
    dependence: DataFrame


def tree_study(df: DataFrame, target: str = "P", ts: str = "datetime", daytime: bool = False,
               sample: int = 2000, chunks: int | None = None, **settings) -> TreeStudy:
    """Boosted trees on the hourly rows with the last fifth held out, and their attributions.

    ``daytime`` keeps rows with the sun up, as in the second model of the study. The split is
    written once because fitting reads it many times.
    """
    df = df.withColumns(cal.cyclic_features(ts))
    if daytime:
        df = df.filter("H_sun > 0")
    rows = df.select("site", ts, target, *TREE_FEATURES)
    split = materialise(series.tail_holdout(rows, ["site"], ts, chunks=chunks), "holdout")
    model = boosting.fit_trees(split.filter("split = 'train'"), TREE_FEATURES, target, **settings)
    test = split.filter("split = 'test'")
    scored = boosting.predict(model, test, ["site", ts, target])
    picked = seeded_sample(test, ["site", ts], sample)
    parts = materialise(attribution.tree_attributions(model, picked, TREE_FEATURES, ["site", ts]), "attributions")
    return TreeStudy(model, metrics.regression_metrics(scored, target, "yhat"), parts,
                     attribution.feature_importance(parts), attribution.dependence_table(parts, DEPENDENCE))


def window_study(prepared: Prepared, kind: str = "gbt", **settings) -> tuple[object, DataFrame, DataFrame]:
    """Fit a forecaster on prepared windows; return it, the predictions and metrics per split.

    Predictions and metrics are in original units. Nothing is fitted unless every check passes.
    """
    checks.gate(prepared.checks)
    windows = materialise(prepared.windows, "windows")
    model = models.fit_forecaster(windows, kind, **settings)
    target = prepared.spec.target
    scored = models.forecast(model, windows).select("site", "split", prepared.spec.ts, "y", "yhat")
    scored = scaling.invert_scaling(scored, prepared.params, {"y": target, "yhat": target})
    scored = metrics.with_residual(scored)
    return model, scored, metrics.regression_metrics(scored.filter(F.col("split") != "train"), by=["split"])
