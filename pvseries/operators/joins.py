"""Joins of hourly sources, and to a typical year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pvseries.operators.clean import dedupe_first


def join_sources(primary: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on exact keys; every primary row stays.

    No broadcast hint: the other source grows with the data, so the choice is left to the
    sizes adaptive execution measures.
    """
    return primary.join(other, list(on), "left")


def join_audit(primary: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of both sides, joined rows, and primary rows without a match.

    Both sides are counted per key first, so a heavily repeated key costs one row.
    """
    left = primary.groupBy(*on).agg(F.count(F.lit(1)).alias("l"))
    right = other.groupBy(*on).agg(F.count(F.lit(1)).alias("r"))
    both = left.join(right, list(on), "full")
    present = F.col("l").isNotNull()
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(
        count("l").alias("primary_rows"), count("r").alias("other_rows"),
        count(F.when(present, F.col("l") * F.coalesce("r", F.lit(1)))).alias("joined_rows"),
        count(F.when(present & F.col("r").isNull(), F.col("l"))).alias("unmatched_rows"))


def write_joined(primary: DataFrame, other: DataFrame, on: Sequence[str], path: str) -> DataFrame:
    """Write the left join and return its audit, as :func:`join_audit` gives it, from the same pass.

    The counts are observed while the joined rows are written, so neither side is read again. A lost
    executor can make Spark observe the rows of a repeated task twice; where the figures must hold even
    then, use :func:`join_audit`.
    """
    spark, hit = primary.sparkSession, "__hit"
    seen = {name: Observation(name) for name in ("primary", "other", "joined")}
    count = F.count(F.lit(1)).alias("n")
    right = other.withColumn(hit, F.lit(True)).observe(seen["other"], count)
    joined = join_sources(primary.observe(seen["primary"], count), right, on)
    joined = joined.observe(seen["joined"], count, F.count_if(F.col(hit).isNull()).alias("unmatched"))
    joined.drop(hit).write.mode("overwrite").parquet(path)
    told = {name: o.get for name, o in seen.items()}
    row = (told["primary"].get("n", 0), told["other"].get("n", 0), told["joined"].get("n", 0), told["joined"].get("unmatched", 0))
    return spark.createDataFrame([row], "primary_rows long, other_rows long, joined_rows long, unmatched_rows long")


def unmatched(primary: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Primary rows with no match."""
    return primary.join(other.select(*on), list(on), "left_anti")


def first_unmatched(primary: DataFrame, other: DataFrame, on: Sequence[str], order: Sequence[str],
                    n: int = 5) -> DataFrame:
    """Keys of the first ``n`` unmatched rows in time order."""
    return unmatched(primary.select(*on), other, on).orderBy(*order).limit(n)


def calendar_join(df: DataFrame, ts: str, typical: DataFrame, typical_ts: str, order: Sequence[str],
                  columns: Sequence[str], parts: Sequence[str] = ("month", "day", "hour"),
                  keys: Sequence[str] = ()) -> DataFrame:
    """Attach typical-year columns by calendar pattern; the first row of a slot wins.

    A slot missing from the typical year (29 February) gives nulls. Without ``keys`` the
    deduplicated table has at most 366 * 24 rows, which bounds its broadcast. With ``keys``
    (one typical year per site) it grows with the sites and is left to adaptive execution.
    """
    take = {"month": F.month, "day": F.dayofmonth, "hour": F.hour}
    slots = [f"__{p}" for p in parts]
    on = [*keys, *slots]
    keyed = typical.select("*", *[take[p](typical_ts).alias(f"__{p}") for p in parts])
    dim = dedupe_first(keyed.select(*on, *dict.fromkeys([*order, *columns])), on, order).select(*on, *columns)
    left = df.select("*", *[take[p](ts).alias(f"__{p}") for p in parts])
    joined = left.join(dim if keys else F.broadcast(dim), on, "left")
    return joined.select(*df.columns, *columns)
