"""Fit, store, apply and invert feature scalers.

Fitted parameters are a table with one row per feature (and per site, if fitted per site).
A global scaler is applied as literal expressions in one projection; a per-site scaler by a
join on the site.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvseries.config import MINMAX, FeatureGroup
from pvseries.operators.clean import quoted
from pvseries.operators.profile import summarise

_EPS = sys.float_info.epsilon


def fit_scalers(train: DataFrame, groups: Sequence[FeatureGroup], keys: Sequence[str] = ()) -> DataFrame:
    """Parameters of every scaled feature, from training rows only.

    Columns: keys, feature, group, kind, lo, hi, data_min, data_max, mean, std, scale, offset
    with ``scaled = x * scale + offset``. Deviations are population ones. A constant feature
    keeps a divisor of 1, so it maps to ``lo`` (min-max) or 0 (standard).
    """
    scaled = [g for g in groups if g.kind]
    features = [f for g in scaled for f in g.features]
    stats = summarise(train, features, {
        "n": F.count, "data_min": lambda c: F.min(c.cast("double")),
        "data_max": lambda c: F.max(c.cast("double")), "mean": F.avg, "var": F.var_pop}, keys)
    group_of = {f: g for g in scaled for f in g.features}
    pick = lambda attr: F.create_map(*[x for f in features for x in (F.lit(f), F.lit(getattr(group_of[f], attr)))])
    out = stats.withColumnRenamed("column", "feature")
    for name, attr in (("group", "name"), ("kind", "kind"), ("lo", "lo"), ("hi", "hi")):
        out = out.withColumn(name, pick(attr)[F.col("feature")])

    spread = F.col("data_max") - F.col("data_min")
    spread = F.when(spread < 10 * _EPS, 1.0).otherwise(spread)
    n, mean, var = F.col("n"), F.col("mean"), F.col("var")
    noise = n * _EPS * var + (n * mean * _EPS) * (n * mean * _EPS)
    std = F.when(var <= noise, 1.0).otherwise(F.sqrt("var"))
    minmax = F.col("kind") == MINMAX
    factor = F.when(minmax, (F.col("hi") - F.col("lo")) / spread).otherwise(1.0 / std)
    shift = F.when(minmax, F.col("lo") - F.col("data_min") * F.col("scale")).otherwise(-mean * F.col("scale"))
    return (out.withColumn("std", F.sqrt("var")).withColumn("scale", factor).withColumn("offset", shift)
            .select(*keys, "feature", "group", "kind", "lo", "hi", "data_min", "data_max", "mean", "std",
                    "scale", "offset"))


def scaler_report(params: DataFrame, digits: int = 2) -> DataFrame:
    """The statistics of each feature, rounded."""
    stats = ("data_min", "data_max", "mean", "std")
    return params.select("feature", "group", "kind", *[F.round(c, digits).alias(c) for c in stats])


def apply_scaling(df: DataFrame, params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Scale every fitted feature that ``df`` holds; values outside the fitted range are kept."""
    return _transform(df, params, keys, lambda c, scale, offset: c * scale + offset)


def invert_scaling(df: DataFrame, params: DataFrame, columns: dict[str, str],
                   keys: Sequence[str] = ()) -> DataFrame:
    """Back to original units; ``columns`` maps a column of ``df`` to the feature it was scaled as."""
    return _transform(df, params, keys, lambda c, scale, offset: (c - offset) / scale, columns)


def _transform(df: DataFrame, params: DataFrame, keys: Sequence[str], fn,
               columns: dict[str, str] | None = None) -> DataFrame:
    if not keys:
        # One row per feature of the configuration.
        fitted = {r["feature"]: (F.lit(r["scale"]), F.lit(r["offset"]))
                  for r in params.select("feature", "scale", "offset").collect()}
        of = columns or {f: f for f in fitted}
        return df.select(*[fn(quoted(c), *fitted[of[c]]).alias(c) if c in of and of[c] in fitted
                           else quoted(c) for c in df.columns])
    table = params.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("feature"), F.struct("scale", "offset")))).alias("__fit"))
    features = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    of = columns or {c: c for c in features}
    names = {r["feature"] for r in params.select("feature").distinct().collect()}
    renamed = table.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], "__fit")
    # Rows without a site were fitted as one group, so missing keys are equal here too.
    joined = df.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]), "left")
    out = []
    for c in df.columns:
        if c in of and of[c] in names:
            fit = F.element_at("__fit", F.lit(of[c]))
            out.append(fn(quoted(c), fit["scale"], fit["offset"]).alias(c))
        else:
            out.append(quoted(c))
    return joined.select(*out)


def interaction_features(df: DataFrame, cloud: str = "cloudcover", radiation: str = "solarradiation",
                         temp: str = "temp", fit_on: Column | None = None) -> DataFrame:
    """cloud_rad and temp_rad, normalised by maxima; a maximum that is not positive counts as 1.

    ``fit_on`` restricts the rows the maxima come from (the training rows); without it they
    come from the whole table.
    """
    base = df.filter(fit_on) if fit_on is not None else df
    top = base.agg(F.struct(F.max(cloud).alias("cloud"), F.max(radiation).alias("rad"))).scalar()
    safe = lambda c: F.when(c > 0, c).otherwise(1.0)
    rad = F.col(radiation) / safe(top.getField("rad"))
    return df.withColumns({"cloud_rad": F.col(cloud) / safe(top.getField("cloud")) * rad,
                           "temp_rad": F.col(temp) * rad})


def feature_vector(df: DataFrame, features: Sequence[str], col: str = "features") -> DataFrame:
    """One array column holding the features in order."""
    return df.withColumn(col, F.array(*[quoted(f).cast("double") for f in features]))


def group_table(spark, groups: Sequence[FeatureGroup], target: str) -> DataFrame:
    """(group, feature, position, kind) of a configuration."""
    rows, pos = [], 0
    for g in groups:
        for f in g.features:
            rows.append((g.name, f, pos, g.kind))
            pos += 1
    rows.append(("target", target, pos, MINMAX))
    return spark.createDataFrame(rows, "group string, feature string, position int, kind string")


