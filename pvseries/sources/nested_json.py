"""Nested JSON of the two weather services, flattened to hourly rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvseries.schemas import HOURLY_JSON, PARAMETER_JSON, SITE_META, WEATHER_PARAMETERS


def read_hourly_json(spark: SparkSession, path: str, field: str = "hourly", multiline: bool = True) -> DataFrame:
    """Rows of ``outputs.<field>[]``; one document per file, or per line if not ``multiline``."""
    docs = spark.read.schema(HOURLY_JSON).option("multiLine", multiline).json(path)
    return array_to_rows(docs, f"outputs.{field}")


def array_to_rows(df: DataFrame, array: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per record of an array of structs. Explodes in place, without a shuffle."""
    return df.select(*keys, F.explode(array).alias("h")).select(*keys, "h.*")


def read_parameter_json(spark: SparkSession, path: str, parameters: Sequence[str] = WEATHER_PARAMETERS,
                        multiline: bool = True) -> DataFrame:
    """Rows of ``properties.parameter``, one document per file or line, with the file name as ``doc``."""
    docs = (spark.read.schema(PARAMETER_JSON).option("multiLine", multiline).json(path)
            .select(F.concat_ws("#", "_metadata.file_path", F.monotonically_increasing_id()).alias("doc"),
                    "properties.parameter"))
    return maps_to_wide(docs, "parameter", parameters, ["doc"])


def maps_to_wide(df: DataFrame, column: str, parameters: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """parameter -> (time -> value) maps to one row per time with a column per parameter.

    The first parameter of a document decides which times exist; a value missing for another
    parameter is null. ``keys`` identify a document. A document is one row, and its maps are
    joined inside the row, so nothing is shuffled.
    """
    lead = F.element_at(F.map_values(column), 1)
    kind = df.select(column).schema[0].dataType.valueType.valueType.simpleString()
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>"))
    rows = F.transform_values(lead, lambda _, v: F.array().cast(f"array<{kind}>"))
    for p in parameters:
        cells = F.coalesce(F.element_at(column, p), empty)
        rows = F.map_zip_with(rows, cells, lambda _, a, v: F.when(a.isNotNull(), F.concat(a, F.array(v))))
    out = df.select(*keys, F.explode(rows).alias("time", "__v")).filter(F.col("__v").isNotNull())
    return out.select(*keys, "time", *[F.col("__v")[i].alias(p) for i, p in enumerate(parameters)])


def read_site_meta(spark: SparkSession, path: str) -> DataFrame:
    """The site and system description as one flat row per file."""
    meta = spark.read.schema(SITE_META).option("multiLine", True).json(path)
    return meta.select("inputs.location.*", "inputs.meteo_data.*",
                       F.col("inputs.mounting_system.fixed.slope").alias("slope"),
                       F.col("inputs.mounting_system.fixed.azimuth").alias("azimuth"),
                       F.col("inputs.mounting_system.fixed.type").alias("mounting"), "inputs.pv_module.*")
