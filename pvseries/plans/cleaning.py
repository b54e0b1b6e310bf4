"""Raw files to clean hourly tables, for both site types.

All functions take and return tables with a ``site`` column; ``with_site`` adds one to the
files of a single site.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvseries.functions import calendar as cal
from pvseries.functions.solar import sun_elevation
from pvseries.operators import clean, joins, series
from pvseries.schemas import WEATHER_PARAMETERS

# Measured columns, the columns filled by interpolation, and the output names.
PANEL_MEASURES = ("P", "Gb(i)", "Gd(i)", "Gr(i)", "H_sun", "T2m", "WS10m", "Int")
MET_COLUMNS = ("T2m", "WS10m", "RH2M", "PS_Pa", "WD10m")
GRIDDED_COLUMNS = ("datetime", "P", "G_i", "Gb(i)", "Gd(i)", "Gr(i)", "H_sun", "T2m", "WS10m", "RH2M",
                   "PS_Pa", "WD10m", "data_quality")
GRIDDED_NAMES = {"Gb(i)": "Gb_i", "Gd(i)": "Gd_i", "Gr(i)": "Gr_i", "RH2M": "RH", "PS_Pa": "SP"}
# Units of the measures; reports take any descriptions that the caller gives.
GRIDDED_UNITS = {"P": "W", "G_i": "W/m2", "H_sun": "degrees", "T2m": "C", "WS10m": "m/s", "RH": "percent", "SP": "Pa",
                 "WD10m": "degrees"}


def with_site(df: DataFrame, site: str) -> DataFrame:
    return df.withColumn("site", F.lit(site))


def panel_table(raw: DataFrame) -> DataFrame:
    """Typed panel measures on full hours, with the total irradiance."""
    df = clean.clean_column_names(raw)
    df = clean.sentinels_to_null(clean.tolerant_cast(df, PANEL_MEASURES))
    return df.withColumns({"datetime": cal.align_half_hour(cal.parse_colon("time")),
                           "G_i": clean.total("Gb(i)", "Gd(i)", "Gr(i)")})


def weather_table(*years: DataFrame) -> DataFrame:
    """Typed weather measures of all yearly extracts, with pressure in Pa."""
    df = clean.union_years(*[clean.clean_column_names(y) for y in years])
    df = clean.sentinels_to_null(clean.tolerant_cast(df, WEATHER_PARAMETERS))
    return df.withColumns({"datetime": cal.parse_compact("time"), "PS_Pa": clean.kpa_to_pa("PS")})


def clean_gridded(panel_raw: DataFrame, weather_raw: Sequence[DataFrame], typical_raw: DataFrame,
                  limit: int = 3, max_gap: int | None = None, mark_filled: bool = False,
                  site_typical: bool = True, chunks: int | None = None) -> DataFrame:
    """Join the panel, weather and typical-year sources and fill the weather columns.

    ``max_gap`` leaves longer gaps to the forward fill alone; ``mark_filled`` gives rows with a
    filled weather value the flag 2. ``site_typical=False`` uses one typical year for all sites.
    """
    typical = clean.clean_column_names(typical_raw).withColumn("__t", cal.parse_colon("time(UTC)"))
    df = joins.join_sources(panel_table(panel_raw),
                            weather_table(*weather_raw).select("site", "datetime", "RH2M", "PS_Pa"),
                            ["site", "datetime"])
    df = joins.calendar_join(df, "datetime", typical, "__t", ["__t"], ["WD10m"],
                             keys=["site"] if site_typical else [])
    missing = F.lit(False)
    for c in MET_COLUMNS:
        missing = missing | clean.quoted(c).isNull()
    df = df.withColumn("__filled", missing)
    df = series.interpolate_time(df, ["site"], "datetime", MET_COLUMNS, limit=limit, max_gap=max_gap, chunks=chunks)
    df = df.withColumn("data_quality", clean.quality_flag(F.col("Int"), F.col("__filled") if mark_filled else None))
    return clean.select_columns(df, ("site", *GRIDDED_COLUMNS), GRIDDED_NAMES)


def clean_station(raw: DataFrame, lat: float, lon: float, position: str | None = None,
                  local_tz: str | None = None, pressure_scale: float = 1.0,
                  spare: Sequence[str] = ("preciptype", "stations")) -> DataFrame:
    """Station rows with one timestamp, non-negative generation, season and sun height.

    Rows without generation go; of rows with equal stamps the first by ``position`` stays (an
    hour repeated at a clock change), or by all values if no position is known. Pressure is
    passed to the refraction term as given; readings in hPa need ``pressure_scale=100``.
    ``local_tz`` converts wall time to UTC first.
    """
    parts = ("year", "month", "day", "hour")
    df = raw.withColumn("Datetime", cal.from_parts(*parts, local_tz=local_tz)).drop(*parts, *spare)
    df = clean.drop_missing_target(clean.clamp_negative(df, "generation"), "generation")
    order = [position] if position else [c for c in df.columns if c not in ("site", "Datetime")]
    df = clean.dedupe_first(df, ["site", "Datetime"], order)
    df = df.withColumns({
        "season": cal.season(F.month("Datetime"), "temperate"),
        "sunheight": station_sun(lat, lon, pressure_scale)})
    keep = [c for c in df.columns if c not in ("site", "Datetime", position)]
    return df.select("site", "Datetime", *keep)


def station_sun(lat: float, lon: float, pressure_scale: float = 1.0) -> Column:
    return sun_elevation("Datetime", lat, lon, F.col("sealevelpressure") * pressure_scale, F.col("temp"))


def export_gridded(df: DataFrame) -> DataFrame:
    """The clean table with text stamps, as written to delimited files."""
    return df.withColumn("datetime", cal.format_utc("datetime"))
