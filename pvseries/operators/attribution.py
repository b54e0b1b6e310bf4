"""Additive attributions of boosted-tree predictions.

For one leaf reached by a path that tests the features U, a coalition S contributes the leaf
value times, per feature of U, 1 or 0 if the feature is in S (does the row pass its tests?)
and otherwise the share of training rows that pass. A path's coalitions are counted by size in a
polynomial that is extended by one factor per feature, and a feature's Shapley value is read off
after its own factor is unwound again: about depth squared steps per leaf and row, for all leaves
with the same number of features and a batch of rows at once. Attributions plus the base value add
up to the prediction.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.functions.calendar import effect_label
from pvseries.functions.stats import pearson
from pvseries.operators.boosting import TreeModel

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CELLS = 1 << 20  # (row, leaf, feature) cells worked on at once


def _paths(model: TreeModel, tree: int) -> Iterator[tuple[float, dict[int, list]]]:
    """(value, {feature: [above, at most, whether missing passes, share of rows]}) per leaf, tests of one feature merged."""
    feature, cover = model.feature[tree], model.cover[tree]
    open_ = [(0, {})]
    while open_:
        at, tests = open_.pop()
        f = int(feature[at])
        if f < 0:
            yield float(model.value[tree, at]), tests
            continue
        cut, gap_left = float(model.threshold[tree, at]), bool(model.missing_left[tree, at])
        for child, left in ((2 * at + 1, True), (2 * at + 2, False)):
            lo, hi, gap, share = tests.get(f, (-np.inf, np.inf, True, 1.0))
            part = float(cover[child] / cover[at])
            merged = (lo, min(hi, cut)) if left else (max(lo, cut), hi)
            open_.append((child, {**tests, f: (*merged, gap and gap_left == left, share * part)}))


def leaf_tables(model: TreeModel) -> tuple[float, list[tuple[np.ndarray, ...]]]:
    """(base value, per number of features on a path: values, features, limits, passes of missing values, shares)."""
    base, groups = model.base, defaultdict(list)
    for tree in range(len(model.feature)):
        for value, tests in _paths(model, tree):
            base += value * float(np.prod([t[3] for t in tests.values()]))
            if tests:
                groups[len(tests)].append((value, list(tests), *zip(*tests.values())))
    kinds = (float, np.int64, float, float, bool, float)
    return base, [tuple(np.array(column, kind) for column, kind in zip(zip(*leaves), kinds)) for leaves in groups.values()]


def path_values(passed: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values (rows, leaves, features) of leaves of value 1."""
    m = share.shape[-1]
    weight = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
    sizes = [np.ones(passed.shape[:2])]  # coefficient of each coalition size
    for j in range(m):
        z, o = share[:, j], passed[:, :, j]
        sizes = [sizes[0] * z, *[sizes[k] * z + sizes[k - 1] * o for k in range(1, j + 1)], sizes[j] * o]
    out = np.empty(passed.shape)
    for j in range(m):
        z, o = share[:, j], passed[:, :, j]
        rest, total = np.zeros(passed.shape[:2]), np.zeros(passed.shape[:2])
        for s in range(m - 1, -1, -1):  # unwound from the largest size
            rest = np.where(o, sizes[s + 1] - z * rest if s < m - 1 else sizes[m], sizes[s] / z)
            total += weight[s] * rest
        out[:, :, j] = (o - z) * total
    return out


def attribute_rows(x: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Attribution of every feature (rows, features) of ``x``, NaN where missing."""
    phi = np.zeros(x.shape)
    for value, used, lo, hi, gap, share in tables:
        step = max(1, _CELLS // used.size)
        for at in range(0, len(x), step):
            v = x[at:at + step][:, used]
            passed = np.where(np.isnan(v), gap, (v > lo) & (v <= hi))
            part = path_values(passed, share) * value[:, None]
            flat = np.arange(len(v))[:, None, None] * x.shape[1] + used
            phi[at:at + step] += np.bincount(flat.ravel(), part.ravel(), len(v) * x.shape[1]).reshape(len(v), -1)
    return phi


def tree_attributions(model: TreeModel, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, feature, value, attribution, base): one row per input row and feature of the model, in its order."""
    base, tables = leaf_tables(model)
    features, key = list(features), list(key)
    shared = df.sparkSession.sparkContext.broadcast(tables)
    index = range(len(features))
    rows = df.select(*key, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            phi = attribute_rows(pdf[[f"x{i}" for i in index]].to_numpy(float), shared.value)
            yield pdf.assign(**{f"phi{i}": phi[:, i] for i in index})

    fields = [f"`{name}` {kind}" for name, kind in rows.dtypes] + [f"phi{i} double" for i in index]
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").alias("value"), F.col(f"phi{i}").alias("attribution"))
             for i, f in enumerate(features)]
    return (rows.mapInPandas(attribute, ", ".join(fields))
            .select(*key, F.explode(F.array(*cells)).alias("c")).select(*key, "c.*", F.lit(base).alias("base")))


def feature_importance(attributions: DataFrame, bar: float = 3.0) -> DataFrame:
    """Mean absolute attribution per feature with a text bar and the direction of effect."""
    out = attributions.groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("importance"),
        pearson(F.col("value"), F.col("attribution")).alias("corr"))
    length = F.floor(F.col("importance") / bar).cast("int")
    return (out.withColumn("bar", F.repeat(F.lit("█"), length))
            .withColumn("effect", effect_label(F.col("corr")))
            .orderBy(F.desc("importance"), "feature"))


def dependence_table(attributions: DataFrame, features: Sequence[str], bins: int | None = None) -> DataFrame:
    """Feature value against attribution for chosen features; with ``bins``, means per equal-width bin."""
    chosen = attributions.filter(F.col("feature").isin(*features))
    if bins is None:
        return chosen.select("feature", "value", "attribution")
    span = chosen.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.coalesce(F.floor((F.col("value") - F.col("lo")) / width * bins), F.lit(0))
    # One row per chosen feature.
    return (chosen.join(F.broadcast(span), "feature")
            .groupBy("feature", F.least(place, F.lit(bins - 1)).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"),
                 F.avg("attribution").alias("attribution")))
