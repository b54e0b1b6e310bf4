"""Checks on look-back windows, and the gate that stops a bad set from being written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INF = float("inf")


def _bad(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(_INF))


def window_stats(windows: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Per split: samples, bad values in x and y, target range, and the shapes seen."""
    bad_x = F.exists("x", lambda row: F.exists(row, _bad))
    return windows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad_x).alias("bad_x"), F.count_if(_bad(F.col("y"))).alias("bad_y"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.min(F.size("x")).alias("lookback_min"), F.max(F.size("x")).alias("lookback_max"),
        F.min(F.array_min(F.transform("x", F.size))).alias("features_min"),
        F.max(F.array_max(F.transform("x", F.size))).alias("features_max"))


def window_checks(windows: DataFrame, min_train: int = 1000, inclusive: bool = False,
                  target_max: float = 1.5) -> DataFrame:
    """One row of flags: finite, target in range, train largest, shapes equal, train large enough."""
    stats = window_stats(windows)

    def size(split: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("split") == split, F.col("n"))), F.lit(0))

    train = size("train")
    enough = train >= min_train if inclusive else train > min_train
    flags = {
        "finite": F.max(F.col("bad_x") + F.col("bad_y")) == 0,
        "target_in_range": (F.min("y_min") >= 0) & (F.max("y_max") <= target_max),
        "train_largest": (train > size("val")) & (train > size("test")),
        "same_shape": (F.min("lookback_min") == F.max("lookback_max"))
                      & (F.min("features_min") == F.max("features_max")),
        "enough_train": enough,
    }
    out = stats.agg(*[F.coalesce(f, F.lit(False)).cast("int").alias(n) for n, f in flags.items()],
                    train.alias("train_size"), size("val").alias("val_size"), size("test").alias("test_size"))
    passed = sum((F.col(n) for n in flags), F.lit(0))
    return out.withColumn("passed", (passed == len(flags)).cast("int"))


def gate(checks: DataFrame) -> dict:
    """The check row as a dict; raises unless every check passed."""
    row = checks.first().asDict()
    if not row["passed"]:
        failed = [k for k, v in row.items() if v == 0 and k not in ("passed", "train_size", "val_size", "test_size")]
        raise ValueError(f"window checks failed: {failed}")
    return row
