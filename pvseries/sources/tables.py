"""Delimited and columnar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvseries.session import scratch_path

CORRUPT = "_corrupt_record"

# Text form of stamps, with microseconds; quotes inside cells are doubled.
_TEXT = {"escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
         "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}


def source_position() -> Column:
    """File order of a row: file, block, then order inside the block."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                   corrupt: bool = False, position: str | None = None, **options) -> DataFrame:
    """Read CSV files with a header under an explicit schema.

    Malformed rows keep the cells that parse; ``corrupt`` adds the raw text of such rows, and
    ``position`` names a column with the file order.
    """
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).options(**{**_TEXT, **options}))
    df = reader.csv(path)
    return df.withColumn(position, source_position()) if position else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite", **options) -> None:
    """Write a partitioned table.

    The rebalance hint gathers each partition value in few files, and adaptive execution cuts a
    value that holds far more rows than the others into several tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_delimited(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """CSV with a header, columns in table order."""
    write_table(df, path, partition_by, "csv", mode, header="true", **_TEXT)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where several actions read one result: it survives lost executors and cuts the plan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
