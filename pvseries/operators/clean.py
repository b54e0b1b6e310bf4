"""Column and row cleaning: names, casts, sentinels, filters, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvseries.config import SENTINELS


def quoted(name: str) -> Column:
    """A column by exact name, also when it holds dots or brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def select_columns(df: DataFrame, columns: Sequence[str],
                   rename: Mapping[str, str] | None = None) -> DataFrame:
    """Keep, order and rename columns."""
    rename = rename or {}
    return df.select(*[quoted(c).alias(rename.get(c, c)) for c in columns])


def tolerant_cast(df: DataFrame, columns: Sequence[str], to: str = "double") -> DataFrame:
    """Cast; values that do not parse become null."""
    return _map(df, columns, lambda c: c.try_cast(to))


def sentinels_to_null(df: DataFrame, columns: Sequence[str] | None = None,
                      sentinels: Sequence[float] = SENTINELS) -> DataFrame:
    """Null out sentinel values and NaN, by default in every numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    chosen = set(columns)
    out = []
    for name in df.columns:
        c = quoted(name)
        if name in chosen:
            bad = c.isin(*[float(s) for s in sentinels])
            bad = bad | F.isnan(c) if name in floats else bad
            c = F.when(~bad, c)
        out.append(c.alias(name))
    return df.select(*out)


def clamp_negative(df: DataFrame, column: str) -> DataFrame:
    """Negative values become 0; missing values stay missing."""
    return _map(df, [column], lambda c: F.when(c < 0, F.lit(0.0)).otherwise(c))


def total(*columns: str) -> Column:
    """Sum of columns; missing when any part is missing."""
    out = quoted(columns[0])
    for c in columns[1:]:
        out = out + quoted(c)
    return out


def kpa_to_pa(column: str) -> Column:
    return quoted(column) * F.lit(1000.0)


def quality_flag(interpolated: Column, filled: Column | None = None) -> Column:
    """0 clean, 1 reconstructed by the source and, if ``filled`` is given, 2 filled here."""
    flag = F.when(interpolated == 1, 1)
    if filled is not None:
        flag = flag.when(filled, 2)
    return flag.otherwise(0)


def quality_filter(df: DataFrame, minimum: int = 0, column: str = "data_quality",
                   keep_flags: Sequence[int] | None = None) -> DataFrame:
    """Rows with flag >= ``minimum``; 0 keeps all. ``keep_flags`` selects flags by name instead."""
    if keep_flags is not None:
        return df.filter(F.col(column).isin(*keep_flags))
    return df.filter(F.col(column) >= minimum) if minimum > 0 else df


def daytime_filter(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def membership_filter(df: DataFrame, value: Column, allowed: Sequence) -> DataFrame:
    """Rows whose value is in a list, such as some hours or one year."""
    return df.filter(value.isin(*allowed))


def filter_report(df: DataFrame, condition: Column) -> DataFrame:
    """Row counts before and after a filter, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(condition).alias("rows_after")).withColumn(
        "rows_removed", F.col("rows_before") - F.col("rows_after"))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.dropna(subset=[target])


def drop_sparse_columns(df: DataFrame, max_null_share: float = 0.5) -> DataFrame:
    """Drop columns whose share of nulls exceeds the limit; one aggregate decides."""
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(quoted(c)).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if row["__n"] == 0 or 1 - row[c] / row["__n"] <= max_null_share]
    return select_columns(df, keep)


def negative_audit(df: DataFrame, column: str) -> DataFrame:
    """Each negative value with its row count, and the number of missing rows as a null value."""
    c = F.col(column)
    return (df.filter((c < 0) | c.isNull()).groupBy(c.alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))


def head(df: DataFrame, ts: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*ts).limit(n)


def tail(df: DataFrame, ts: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in ts]).limit(n).orderBy(*ts)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``.

    ``row_number() = 1`` lets Spark keep one row per key and map task before the shuffle,
    so a key with many copies never gathers in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def list_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once; missing key parts count as equal.

    Keys are counted map-side first. The semi join then streams the rows, and adaptive
    execution splits the partition of a key with very many of them.
    """
    repeated = (df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
                .filter("__n > 1"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(repeated, same, "left_semi")


def union_years(*parts: DataFrame) -> DataFrame:
    """Concatenate yearly extracts by column name; duplicates stay."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _map(df: DataFrame, columns: Sequence[str], fn) -> DataFrame:
    chosen = set(columns)
    return df.select(*[fn(quoted(c)).alias(c) if c in chosen else quoted(c) for c in df.columns])
