"""Profiles and summaries. Wide aggregates run as one pass and are turned to long form after."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvseries.config import RangeRule
from pvseries.functions.calendar import MONTH_NAMES, micros, season_order, skew_label
from pvseries.functions.stats import pearson
from pvseries.operators.clean import quoted
from pvseries.sources.tables import materialise
from pvseries.operators.quantiles import exact_quantiles, melt


def one_row_to_long(df: DataFrame, columns: Sequence[str], fields: Sequence[str],
                    groups: Sequence[str] = ()) -> DataFrame:
    """Turn columns named ``{i}__{field}`` into one row per entry of ``columns``."""
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{i}__{f}").alias(f) for f in fields])
            for i, c in enumerate(columns)]
    return df.select(*groups, F.explode(F.array(*rows)).alias("__r")).select(*groups, "__r.*")


def summarise(df: DataFrame, columns: Sequence[str], fields: Mapping[str, object],
              groups: Sequence[str] = ()) -> DataFrame:
    """One pass over the table: each entry of ``fields`` maps a Column to an aggregate."""
    aggs = [fn(quoted(c)).alias(f"{i}__{f}") for i, c in enumerate(columns) for f, fn in fields.items()]
    grouped = df.groupBy(*groups) if groups else df
    return one_row_to_long(grouped.agg(*aggs), columns, list(fields), groups)


def diurnal_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(
        F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def monthly_profile(df: DataFrame, ts: str, columns: Sequence[str], digits: int = 1) -> DataFrame:
    """Monthly means, rounded half to even, with the month's name."""
    means = [F.bround(F.avg(quoted(c)), digits).alias(f"mean_{c}") for c in columns]
    out = df.groupBy(F.month(ts).alias("month")).agg(*means)
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return out.withColumn("month_name", F.element_at(names, F.col("month")))


def season_profile(df: DataFrame, season: str, value: str, scheme: str = "monsoon",
                   digits: int = 1) -> DataFrame:
    """Mean, median, max and sample deviation per season, in fixed order; absent seasons are null."""
    order = [F.struct(F.lit(i).alias("pos"), F.lit(s).alias(season))
             for i, s in enumerate(season_order(scheme))]
    # A fixed list of at most four rows, so both broadcasts below are bounded.
    frame = df.sparkSession.range(1).select(F.explode(F.array(*order)).alias("s")).select("s.*")
    stats = df.groupBy(season).agg(F.avg(value).alias("mean"), F.max(value).alias("max"),
                                   F.stddev_samp(value).alias("std"))
    median = exact_quantiles(df, [value], [0.5], [season]).select(season, F.col("q0").alias("median"))
    out = frame.join(F.broadcast(stats), season, "left").join(F.broadcast(median), season, "left")
    return out.select("pos", season, *[F.bround(c, digits).alias(c) for c in ("mean", "median", "max", "std")])


def year_over_year(df: DataFrame, ts: str, value: str, years: Sequence[int]) -> DataFrame:
    """Monthly mean per year, one column per year."""
    cols = [F.avg(F.when(F.year(ts) == y, F.col(value))).alias(f"y{y}") for y in years]
    return (df.filter(F.year(ts).isin(*years)).groupBy(F.month(ts).alias("month")).agg(*cols))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column; quartiles are exact."""
    stats = summarise(df, columns, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    # One row per column name on both sides.
    return stats.join(F.broadcast(quart), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    return summarise(df, columns, {"nulls": lambda c: F.count_if(c.isNull()),
                                   "rows": lambda c: F.count(F.lit(1))})


def column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column with their counts, one row each, as text.

    One row per value keeps any number of distinct values distributed.
    """
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]
    return (df.select(F.explode(F.array(*cells)).alias("__c")).select("__c.*")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """dtype, distinct count, and the extremes of numeric columns, per column.

    Distinct values are counted from (column, value) groups, so a frequent value is combined
    before it is shuffled and no task holds a column's whole set of values.
    """
    types = dict(df.dtypes)
    numeric = [c for c in columns if types[c] not in ("string", "boolean", "timestamp", "timestamp_ntz", "date")]
    distinct = (column_values(df, columns).filter(F.col("value").isNotNull())
                .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))
    span = summarise(df, numeric, {"min": lambda c: F.min(c.cast("double")),
                                   "max": lambda c: F.max(c.cast("double"))})
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype")) for c in columns]
    frame = df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    # All three tables have one row per column name.
    return (frame.join(F.broadcast(distinct), "column", "left")
            .join(F.broadcast(span), "column", "left")
            .select("column", "dtype", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min", "max"))


def distinct_sketches(df: DataFrame, columns: Sequence[str], groups: Sequence[str], precision: int = 14) -> DataFrame:
    """(groups, column, sketch): one mergeable sketch of the distinct values per group, to be stored.

    The relative standard error is about 0.83 / sqrt(2 ** precision), and far less for counts that are
    small beside 2 ** precision. Missing values are not counted.
    """
    aggs = [F.hll_sketch_agg(quoted(c).cast("string"), F.lit(precision)).alias(f"{i}__sketch") for i, c in enumerate(columns)]
    return one_row_to_long(df.groupBy(*groups).agg(*aggs), columns, ["sketch"], groups)


def merged_distinct(sketches: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, column, n_distinct) from stored sketches, for any coarser grouping, without the rows."""
    return sketches.groupBy(*groups, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), column))


def date_range(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                               F.count(F.lit(1)).alias("n"))


def range_checks(df: DataFrame, rules: Sequence[RangeRule]) -> DataFrame:
    """Values below, above and missing per rule; bounds count as valid, absent columns are skipped."""
    rules = [r for r in rules if r.column in df.columns]
    aggs = []
    for i, r in enumerate(rules):
        c = quoted(r.column)
        aggs += [
            (F.count_if(c < r.lo) if r.lo is not None else F.lit(0).cast("long")).alias(f"{i}__below"),
            (F.count_if(c > r.hi) if r.hi is not None else F.lit(0).cast("long")).alias(f"{i}__above"),
            F.count_if(c.isNull()).alias(f"{i}__nulls")]
    long = one_row_to_long(df.agg(*aggs), [r.column for r in rules], ["below", "above", "nulls"])
    clean = (F.col("below") == 0) & (F.col("above") == 0) & (F.col("nulls") == 0)
    return long.withColumn("ok", clean.cast("int"))


def completeness_checks(df: DataFrame, ts: str, keys: Sequence[str] = (),
                        expected: int | None = None) -> DataFrame:
    """Rows, distinct stamps, duplicates and the expected hourly row count, per site.

    Counting per stamp first keeps a stamp with very many copies out of one task.
    """
    stamps = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("__n"))
    out = stamps.groupBy(*keys).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count(ts).alias("n_stamps"),
        F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    hours = F.floor((micros("__b") - micros("__a")) / F.lit(3_600_000_000)) + 1
    want = F.lit(expected).cast("long") if expected is not None else hours
    return out.select(*keys, "n_rows", "n_stamps", (F.col("n_rows") - F.col("n_stamps")).alias("n_duplicates"),
                      want.alias("n_expected"), (F.col("n_rows") == want).cast("int").alias("complete"))


def shape_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis with a label; undefined for tiny samples."""
    raw = summarise(df, columns, {"n": F.count, "g1": F.skewness, "g2": F.kurtosis})
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return (raw.select("column", "n", skew.alias("skewness"), kurt.alias("kurtosis"))
            .withColumn("shape", skew_label(F.col("skewness"))))


def iqr_bounds(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = (),
               k: float = 1.5) -> DataFrame:
    """Quartiles and the fences ``k`` interquartile ranges outside them."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], groups)
    iqr = F.col("q2") - F.col("q0")
    return q.select(*groups, "column", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"),
                    F.col("q2").alias("q3"), (F.col("q0") - k * iqr).alias("lower"),
                    (F.col("q2") + k * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values outside the fences per column, as a count and as a share of all rows."""
    bounds = iqr_bounds(df, columns)
    rows = df.agg(F.count(F.lit(1))).scalar()
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    # One row per column name.
    return (melt(df, columns).join(F.broadcast(bounds), "column")
            .groupBy("column", "q1", "q3", "lower", "upper")
            .agg(F.count_if(outside).alias("outliers"))
            .withColumn("percent", F.col("outliers") / rows * 100))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r for every pair below the diagonal; a null on either side skips the row."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[pearson(quoted(a), quoted(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"p{i}").alias("r"))
             for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def category_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Sorted distinct values to 0..k-1, missing to -1.

    Distinct values are range-partitioned by value and saved; a running count over the
    partitions shifts the ranks inside each, so no task sorts all values.
    """
    values = df.select(F.col(column).alias("__v")).filter(F.col("__v").isNotNull()).distinct()
    placed = materialise(values.repartitionByRange("__v").withColumn("__p", F.spark_partition_id()), "categories")
    # One row per partition.
    starts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__k")).select("__p", F.coalesce(F.sum("__k").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__v")) - 1
    dim = placed.withColumn("__r", rank).join(starts, "__p").select("__v", (F.col("__r") + F.col("__start")).cast("int").alias(code))
    return (df.join(dim, df[column] == dim["__v"], "left").withColumn(code, F.coalesce(code, F.lit(-1)))
            .select(*df.columns, code))
