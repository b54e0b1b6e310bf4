"""The tables behind histograms, density curves, box plots and scatter plots."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.operators.clean import quoted
from pvseries.operators.profile import iqr_bounds
from pvseries.operators.quantiles import exact_quantiles, melt, same
from pvseries.sources.tables import materialise


def _present(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    c = quoted(column).cast("double")
    return df.select(*groups, c.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width counts over [min, max], the maximum in the last bin, empty bins included.

    Also gives the overall mean, which the figures mark with a line.
    """
    data = _present(df, column)
    span = data.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"),
                             F.avg("v").alias("mean"))).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    width = F.nullif(hi - lo, F.lit(0.0))
    place = F.coalesce(F.floor((F.col("v") - lo) / width * bins), F.lit(0))
    counts = (data.select(F.least(place, F.lit(bins - 1)).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    step = (hi - lo) / bins
    # Both sides hold at most ``bins`` rows.
    return (df.sparkSession.range(bins).withColumnRenamed("id", "bin")
            .join(F.broadcast(counts), "bin", "left")
            .select("bin", (lo + F.col("bin") * step).alias("left_edge"),
                    (lo + (F.col("bin") + 1) * step).alias("right_edge"),
                    F.coalesce("n", F.lit(0)).alias("n"), span.getField("mean").alias("mean")))


def kde_curve(df: DataFrame, column: str, groups: Sequence[str] = (), grid: int = 200,
              fineness: int = 32, cut: float = 0.0, reach: float = 8.0) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth std * n ** (-1/5), per group.

    Rows are first reduced to cells of a ``fineness``-th of the bandwidth, each kept as its count
    and mean. A cell then meets only the grid points within ``reach`` bandwidths of its mean, a
    number set by the grid and the bandwidth; what lies beyond weighs less than exp(-reach ** 2 / 2),
    1.3e-14 of the kernel's top. The grid runs from min to max, extended by ``cut`` bandwidths.
    Groups may be any number, missing ones too; a group without spread has null densities.
    """
    data = _present(df, column, groups)
    stats = data.groupBy(*groups).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n_all"),
        (F.stddev_samp("v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("bw"))
    stats = stats.withColumn("bw", F.nullif("bw", F.lit(0.0)))
    if groups:
        stats = materialise(stats, "density-stats")  # its stored size decides how it is joined
        joined = same(data, stats, groups)
    else:
        one = stats.agg(F.first(F.struct("*"))).scalar()
        joined = data.select("v", *[one.getField(c).alias(c) for c in ("lo", "hi", "bw")])
    start = F.col("lo") - cut * F.coalesce("bw", F.lit(0.0))
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.coalesce("bw", F.lit(0.0))) / (grid - 1)
    cell = F.floor((F.col("v") - F.col("lo")) / F.col("bw") * fineness)
    binned = (joined.filter("bw IS NOT NULL").groupBy(*groups, "lo", "hi", "bw", cell.alias("cell"))
              .agg(F.count(F.lit(1)).alias("w"), F.avg("v").alias("m")))
    first = F.greatest(F.ceil((F.col("m") - reach * F.col("bw") - start) / step), F.lit(0))
    last = F.least(F.floor((F.col("m") + reach * F.col("bw") - start) / step), F.lit(grid - 1))
    near = binned.select("*", first.cast("int").alias("first"), last.cast("int").alias("last")).filter("first <= last")
    near = near.select("*", F.explode(F.sequence("first", "last")).alias("point"))
    z = (start + F.col("point") * step - F.col("m")) / F.col("bw")
    kernel = F.exp(-0.5 * z * z) / (F.col("bw") * math.sqrt(2 * math.pi))
    sums = near.groupBy(*groups, "point").agg(F.sum(F.col("w") * kernel).alias("s"))
    frame = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    named = sums.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], F.col("point").alias("__point"), "s")
    hit = F.col("point") == F.col("__point")
    for k, g in enumerate(groups):
        hit = hit & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    density = F.when(F.col("bw").isNotNull(), F.coalesce("s", F.lit(0.0)) / F.col("n_all"))
    return frame.join(named, hit, "left").select(*groups, "point", (start + F.col("point") * step).alias("x"), density.alias("density"))


def box_stats(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences) and outlier count per group."""
    bounds = iqr_bounds(df, [column], groups)
    inside = F.col("value").between(F.col("lower"), F.col("upper"))
    keys = [*groups, "column"]
    # Saved: the size of the stored table decides how it is joined.
    return (same(melt(df, [column], groups), materialise(bounds, "fences"), keys)
            .groupBy(*keys, "n", "q1", "median", "q3")
            .agg(F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
                 F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
                 F.count_if(~inside).alias("outliers")))


def group_quartiles(df: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """Quartiles of each column on either side of a flag."""
    return exact_quantiles(df, columns, [0.25, 0.5, 0.75], [flag]).select(
        flag, "column", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))


def scatter_points(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """Columns of a scatter plot; combine with :func:`seeded_sample` to thin it."""
    out = [quoted(x).alias("x"), quoted(y).alias("y")]
    return df.select(*out, *([quoted(colour).alias("colour")] if colour else []))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope, intercept and r squared of y on x."""
    a, b = quoted(y), quoted(x)
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"),
                  F.regr_r2(a, b).alias("r2"), F.regr_count(a, b).alias("n"))


# 256 equal chances cut into the counts 0 to 5 of a Poisson variable with mean 1.
_POISSON = (94, 188, 235, 251, 255)


def regression_band(df: DataFrame, x: str, y: str, key: Sequence[str], samples: int = 40, grid: int = 20,
                    level: float = 0.95, seed: int = 42) -> DataFrame:
    """(point, x, yhat, lo, hi): the least-squares line on an even grid, with a bootstrap band.

    Every row has a Poisson weight in each of ``samples`` resamples, told by the MD5 of its ``key``
    and the seed, so the band is the same from any partitioning. All resamples are weighted moments,
    added up in one pass; the band lies between the order statistics of their lines at each point.
    """
    named = [F.col(k).cast("string") for k in key]
    data = df.select(quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y"), *[
        F.md5(F.concat_ws("|", *named, F.lit(str(seed)), F.lit(str(b)))).alias(f"h{b}") for b in range(-(-samples // 14))])
    data = data.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    # Two numbers of seven bytes from each digest.
    data = data.select("x", "y", *[F.conv(F.substring(f"h{k // 2}", 14 * (k % 2) + 1, 14), 16, 10).cast("long").alias(f"n{k}")
                                   for k in range(-(-samples // 7))])

    cuts = _POISSON

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((samples, 5))
        for batch in batches:
            u, v = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            draws = np.stack([batch.column(f"n{b // 7}").to_numpy() >> (8 * (6 - b % 7)) & 255 for b in range(samples)])
            total += np.searchsorted(cuts, draws, "right") @ np.stack([np.ones(len(u)), u, v, u * u, u * v], 1)
        yield pa.RecordBatch.from_pydict({"sample": np.arange(samples), **{c: total[:, k] for k, c in enumerate(("n", "sx", "sy", "sxx", "sxy"))}})

    # A task sends one row per resample.
    sums = (data.mapInArrow(add, "sample long, n double, sx double, sy double, sxx double, sxy double").groupBy("sample")
            .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]))
    slope = F.expr("(n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0)")
    drawn = sums.select(slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.nullif("n", F.lit(0.0))).alias("intercept"))
    fit = data.agg(F.min("x").alias("first"), F.max("x").alias("last"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    lines = fit.select("*", drawn.agg(F.collect_list(F.struct("slope", "intercept"))).scalar().alias("lines"))
    at = F.col("first") + F.col("point") * (F.col("last") - F.col("first")) / (grid - 1)
    points = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point")).withColumn("x", at)
    heights = F.array_sort(F.filter(F.transform("lines", lambda s: s["slope"] * F.col("x") + s["intercept"]), lambda v: v.isNotNull()))
    low = F.floor((F.size("heights") - 1) * ((1 - level) / 2)).cast("int")
    return points.withColumn("heights", heights).select(
        "point", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("yhat"),
        F.get("heights", low).alias("lo"), F.get("heights", F.size("heights") - 1 - low).alias("hi"))


def seeded_sample(df: DataFrame, key: Sequence[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows without replacement, or all rows if there are fewer.

    The rows with the lowest MD5 of ``key`` (which should identify a row) and seed win. Every task
    keeps its first ``n`` rows only, in one pass.
    """
    hashed = df.withColumn("__h", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))))
    return hashed.orderBy("__h", *key).limit(n).drop("__h")
