"""Finding where the header of a delimited file starts, and reading on from there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvseries.operators.clean import head, tail
from pvseries.operators.profile import null_profile


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")


def header_offsets(spark: SparkSession, path: str, expected: Sequence[str]) -> DataFrame:
    """(file, skip, header): lines to skip per file until one holds an expected column name.

    A header is looked for in a file's whole first block. Every file that has lines is listed;
    those without such a line have a null ``skip`` and ``header``. Lines of a file follow one
    another in ``id``, so places come from aggregates that each task combines before the shuffle.
    """
    names = F.split("value", ",")
    hit = F.lit(False)
    for name in expected:
        hit = hit | F.array_contains(names, name)
    lines = _lines(spark, path)
    first = F.when((F.col("block") == 0) & hit, F.struct("id", F.col("value").alias("header")))
    files = lines.groupBy("file").agg(F.min(F.when(F.col("block") == 0, F.col("id"))).alias("top"), F.min(first).alias("m"))
    # A blank line before the header is passed over, so skipping may start at it.
    above = (lines.where((F.col("block") == 0) & (F.length(F.trim("value")) > 0)).join(files, "file")
             .where(F.col("id") < F.col("m.id")).groupBy("file").agg(F.max("id").alias("last")))
    skip = F.when(F.col("m").isNotNull(), F.coalesce(F.col("last") + 1 - F.col("top"), F.lit(0)))
    return files.join(above, "file", "left").select("file", skip.cast("int").alias("skip"), F.col("m.header").alias("header"),
                                                    F.col("m.id").alias("header_id"))


def read_after_header(spark: SparkSession, path: str, schema: T.StructType, expected: Sequence[str]) -> DataFrame:
    """Rows below each file's header; trailing lines that hold no value at all are dropped.

    Columns are taken by position, as in a read that skips the leading lines. Files in which no
    header is found stop the read with their names, so none is lost unseen.
    """
    heads = header_offsets(spark, path, expected)
    unknown = [r["file"] for r in heads.where("skip IS NULL").select("file").limit(5).collect()]
    if unknown:
        raise ValueError(f"no header with {list(expected)} in {', '.join(unknown)}")
    # One row per file, so the size grows with the number of files: no broadcast hint.
    body = (_lines(spark, path).join(heads.select("file", "header_id"), "file")
            .filter((F.col("block") > 0) | (F.col("id") > F.col("header_id"))))
    parsed = body.select("file", F.from_csv("value", _ddl(schema)).alias("r"))
    return parsed.select("file", "r.*").dropna(how="all", subset=schema.fieldNames())


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def inspect(df: DataFrame, order: Sequence[str]) -> dict[str, DataFrame]:
    """Null counts and types per column, the first three rows and the last two."""
    types = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")
    return {"columns": null_profile(df).join(F.broadcast(types), "column"),
            "head": head(df, order, 3), "tail": tail(df, order, 2)}
