"""Forecast quality: error metrics and residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_residual(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Actual minus predicted."""
    return df.withColumn("residual", F.col(y) - F.col(yhat))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """n, n_missing, MSE, MAE, RMSE, R squared and NRMSE (percent of the actual range) in one aggregate.

    Rows without an actual or a predicted value are counted as ``n_missing`` and take no other
    part. R squared and NRMSE are null for a constant target.
    """
    e = F.col(y) - F.col(yhat)
    known = F.when(e.isNotNull(), F.col(y))
    mse = F.avg(e * e)
    out = df.groupBy(*by).agg(
        F.count(e).alias("n"), F.count_if(e.isNull()).alias("n_missing"), mse.alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(mse).alias("rmse"), F.var_pop(known).alias("__v"), (F.max(known) - F.min(known)).alias("__r"))
    return out.select(*by, "n", "n_missing", "mse", "mae", "rmse",
                      F.when(F.col("__v") > 0, 1 - F.col("mse") / F.col("__v")).alias("r2"),
                      F.when(F.col("__r") > 0, F.col("rmse") / F.col("__r") * 100).alias("nrmse"))


def residual_summary(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of the residual, the one-sigma band, and its extremes."""
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"),
        (F.avg(e) - F.stddev_pop(e)).alias("band_lo"), (F.avg(e) + F.stddev_pop(e)).alias("band_hi"),
        F.min(e).alias("max_overestimate"), F.max(e).alias("max_underestimate"))
