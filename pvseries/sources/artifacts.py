"""What a run leaves behind: windows, scaler parameters, metadata, reports and metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvseries.config import FeatureGroup
from pvseries.session import exists, write_text
from pvseries.sources.tables import write_table


def write_windows(windows: DataFrame, path: str) -> None:
    """Look-back windows as Parquet, one folder per split."""
    write_table(windows, path, ["split"])


def read_windows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All windows, or those of one split, which reads that folder only."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def write_scalers(params: DataFrame, path: str) -> None:
    """One row per feature (and site), so a single file is enough unless fitted per site."""
    params.write.mode("overwrite").parquet(path)


def read_scalers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def publish_version(spark: SparkSession, root: str, version: str) -> None:
    """Make a finished version the one that readers get: its name replaces the one in the manifest."""
    write_text(spark, f"{root}/manifest", version)


def published_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the published version, or None before the first one."""
    if not exists(spark, f"{root}/manifest"):
        return None
    return f"{root}/versions/{spark.read.text(f'{root}/manifest').first()[0]}"


def run_metadata(windows: DataFrame, features: Sequence[str], target: str, lookback: int, horizon: int,
                 extra: Mapping[str, Column] | None = None, stamp: Column | None = None) -> DataFrame:
    """One row: feature columns, window shape, samples per split, target and time of the run."""
    size = lambda s: F.count_if(F.col("split") == s).alias(f"{s}_size")
    row = windows.agg(size("train"), size("val"), size("test"))
    return row.select(
        F.array(*[F.lit(f) for f in features]).alias("feature_columns"),
        F.lit(lookback).alias("lookback_window"), F.lit(horizon).alias("forecast_horizon"),
        "train_size", "val_size", "test_size", F.lit(len(features)).alias("n_features"),
        F.lit(target).alias("target_column"),
        (F.current_timestamp() if stamp is None else stamp).alias("preprocessing_date"),
        *[c.alias(n) for n, c in (extra or {}).items()])


def feature_info_row(spark: SparkSession, groups: Sequence[FeatureGroup], target: str) -> DataFrame:
    cols = [F.array(*[F.lit(f) for f in g.features]).alias(f"{g.name}_features") for g in groups]
    return spark.range(1).select(*cols, F.lit(target).alias("target"))


def cleaning_report(df: DataFrame, flag: str, ts: str, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """(section, metric, value) with table size, period, rows per flag and column descriptions."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag) == 0).alias("f0"),
                 F.count_if(F.col(flag) == 1).alias("f1"), F.count_if(F.col(flag) == 2).alias("f2"),
                 F.min(ts).alias("a"), F.max(ts).alias("b"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    lines = [("table", "rows", F.col("n").cast("string")),
             ("table", "columns", F.lit(str(len(df.columns)))),
             ("period", "first", text("a")), ("period", "last", text("b")),
             ("quality", "clean", F.col("f0").cast("string")),
             ("quality", "source_interpolated", F.col("f1").cast("string")),
             ("quality", "gap_filled", F.col("f2").cast("string"))]
    lines += [("column", c, F.lit(t)) for c, t in (descriptions or {}).items()]
    cells = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), v.alias("value")) for s, m, v in lines]
    return row.select(F.explode(F.array(*cells)).alias("l")).select("l.*")


def write_json(df: DataFrame, path: str) -> None:
    """Small result tables (metadata, report, metrics) as JSON lines."""
    df.write.mode("overwrite").json(path)
