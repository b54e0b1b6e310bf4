"""The full profile of a clean gridded table, as a dictionary of small lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.config import GRIDDED_RANGES
from pvseries.functions import calendar as cal
from pvseries.operators import distributions as dist
from pvseries.operators import profile as prof

# The columns each table covers.
MEASURES = ("P", "G_i", "Gb_i", "Gd_i", "Gr_i", "H_sun", "T2m", "WS10m", "RH", "SP", "WD10m")
OUTLIER_COLUMNS = ("P", "G_i", "T2m", "WS10m", "RH")
SPREAD_COLUMNS = ("G_i", "T2m", "WS10m", "RH")
BOX_COLUMNS = ("P", "G_i", "T2m", "WS10m", "RH", "SP")
DAY_NIGHT_COLUMNS = ("T2m", "WS10m", "RH", "SP", "WD10m", "H_sun")


def with_parts(df: DataFrame, scheme: str = "monsoon") -> DataFrame:
    return cal.with_calendar(df, "datetime").withColumns({
        "is_day": cal.daytime_flag("H_sun"), "season": cal.season(F.month("datetime"), scheme)})


def explore(df: DataFrame, years: tuple[int, ...] = (2019, 2020)) -> dict[str, DataFrame]:
    df = with_parts(df)
    day = df.filter("P > 0")
    return {
        "describe": prof.describe(df, MEASURES),
        "nulls": prof.null_profile(df, MEASURES),
        "ranges": prof.range_checks(df, GRIDDED_RANGES),
        "completeness": prof.completeness_checks(df, "datetime", ["site"]),
        "diurnal": prof.diurnal_profile(df, "datetime", "P"),
        "monthly": prof.monthly_profile(df, "datetime", ["P", "G_i", "T2m", "RH"]),
        "seasonal": prof.season_profile(day, "season", "P"),
        "year_over_year": prof.year_over_year(df, "datetime", "P", years),
        "correlation": prof.correlation_matrix(df, MEASURES),
        "correlation_day": prof.correlation_matrix(day, MEASURES),
        "moments": prof.shape_moments(df, MEASURES),
        "outliers": prof.iqr_outliers(day, OUTLIER_COLUMNS),
        "power_histogram": dist.histogram(df, "P", 50),
        "power_density": dist.kde_curve(df, "P"),
        "power_by_season": dist.box_stats(day, "P", ["season"]),
        "temperature_by_season": dist.box_stats(df, "T2m", ["season"]),
        "day_power_histogram": dist.histogram(day, "P", 40),
        **{f"{c}_histogram": dist.histogram(df, c, 30) for c in SPREAD_COLUMNS},
        **{f"{c}_density": dist.kde_curve(df, c) for c in SPREAD_COLUMNS},
        **{f"{c}_box": dist.box_stats(df, c) for c in BOX_COLUMNS},
        **{f"{c}_day_night_density": dist.kde_curve(df, c, ["is_day"]) for c in DAY_NIGHT_COLUMNS},
        **{f"{x}_power_line": dist.regression_line(day, x, "P") for x in ("T2m", "RH")},
        "irradiance_points": dist.scatter_points(day, "G_i", "P", "T2m"),
        "temperature_points": dist.scatter_points(day, "T2m", "P", "G_i"),
        "humidity_points": dist.scatter_points(day, "RH", "P", "G_i"),
        "day_night": dist.group_quartiles(df, DAY_NIGHT_COLUMNS, "is_day"),
        "irradiance_line": dist.regression_line(day, "G_i", "P"),
        "pairs_sample": dist.seeded_sample(day, ["site", "datetime"], 2000).select(*OUTLIER_COLUMNS),
    }
