"""Clean table to scaled look-back windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.config import ModelSpec
from pvseries.functions import calendar as cal
from pvseries.operators import checks, clean, scaling, series
from pvseries.session import delete
from pvseries.sources import artifacts
from pvseries.sources.tables import materialise


@dataclass(frozen=True)
class Prepared:
    spec: ModelSpec
    windows: DataFrame
    params: DataFrame
    checks: DataFrame


def prepare(df: DataFrame, spec: ModelSpec, daytime_only: bool = True, min_quality: int = 0,
            max_gap_seconds: float | None = None, fit_on_all: bool = False,
            chunks: int | None = None) -> Prepared:
    """Features, daytime filter, chronological split, scaling and windows.

    ``fit_on_all`` takes the interaction maxima from the whole table instead of the training
    rows. The split table feeds several actions, so it is written once to the shared folder.
    """
    raw = [f for f in spec.features if f in df.columns]
    clean.require_columns(df, ["site", spec.ts, spec.target, *raw])
    flags = ["data_quality"] if min_quality > 0 else []
    df = cal.model_features(df.select("site", spec.ts, spec.target, *raw, *flags), spec.ts, spec.sun, spec.peak)
    interactions_before = spec.interactions and fit_on_all
    if interactions_before:
        df = scaling.interaction_features(df)
    if daytime_only:
        df = clean.daytime_filter(df, spec.daylight)
    if min_quality > 0:
        df = clean.quality_filter(df, min_quality)
    split = materialise(series.chrono_split(df, ["site"], spec.ts, split=spec.split, chunks=chunks), "split")
    if spec.interactions and not fit_on_all:
        split = scaling.interaction_features(split, fit_on=F.col("split") == "train")
    clean.require_columns(split, spec.features)
    params = materialise(scaling.fit_scalers(split.filter("split = 'train'"), spec.scaled), "scalers")
    scaled = scaling.apply_scaling(split, params)
    w = spec.window
    windows = series.lookback_windows(scaled, ["site"], spec.ts, spec.features, spec.target, w.lookback,
                                      w.horizon, max_gap_seconds)
    return Prepared(spec, windows, params,
                    checks.window_checks(windows, spec.min_train, spec.min_train_inclusive))


def publish_windows(windows: DataFrame, params: DataFrame, root: str, min_train: int = 1000,
                    inclusive: bool = False, extras: Callable[[str], None] | None = None) -> tuple[str, dict]:
    """Write, audit, publish: (folder, check row) of a new version under ``root``.

    Windows and scalers go to a folder that no reader knows. The checks run on what was written, so
    nothing is evaluated twice and nothing unchecked can be read. A version that passes is completed by
    ``extras``, which gets its folder, and published by one rename of the manifest; one that fails is
    deleted, and the version before it stays.
    """
    spark, version = windows.sparkSession, uuid.uuid4().hex
    staged = f"{root}/versions/{version}"
    try:
        artifacts.write_windows(windows, f"{staged}/windows")
        artifacts.write_scalers(params, f"{staged}/scalers")
        result = checks.gate(checks.window_checks(artifacts.read_windows(spark, f"{staged}/windows"), min_train, inclusive))
        if extras:
            extras(staged)
    except Exception:
        delete(spark, staged)
        raise
    artifacts.publish_version(spark, root, version)
    return staged, result


def write_prepared(prepared: Prepared, path: str) -> dict:
    """Publish windows, scalers, metadata and feature groups as a version, once every check has passed on the written windows."""
    spec, spark = prepared.spec, prepared.windows.sparkSession

    def describe(folder: str) -> None:
        written = artifacts.read_windows(spark, f"{folder}/windows")
        artifacts.write_json(artifacts.run_metadata(written, spec.features, spec.target, spec.window.lookback,
                                                    spec.window.horizon), f"{folder}/metadata")
        artifacts.write_json(artifacts.feature_info_row(spark, spec.groups, spec.target), f"{folder}/feature_info")

    return publish_windows(prepared.windows, prepared.params, path, spec.min_train, spec.min_train_inclusive, describe)[1]
