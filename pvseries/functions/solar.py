"""Apparent sun elevation from public low-precision almanac formulae.

Declination and right ascension follow the Astronomical Almanac's low-precision series
(about 0.01 degree from 1950 to 2050); sidereal time gives the hour angle, and Bennett's
formula scaled by pressure and temperature gives refraction. Everything is a Column
expression, so no row leaves the JVM. It is not the iterative high-precision algorithm:
expect agreement within about 0.1 degree above the horizon.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pvseries.functions.calendar import micros

_J2000_MICROS = 946_728_000_000_000     # 2000-01-01 12:00 UTC
_DAY_MICROS = 86_400_000_000.0
_HORIZON = -0.8333                      # solar radius plus refraction at the horizon


def _sin(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def true_elevation(ts: str | Column, lat: Column, lon: Column) -> Column:
    """Geometric elevation of the sun's centre, in degrees."""
    n = (micros(ts) - F.lit(_J2000_MICROS)) / F.lit(_DAY_MICROS)
    anomaly = 357.528 + 0.9856003 * n
    ecliptic = 280.460 + 0.9856474 * n + 1.915 * _sin(anomaly) + 0.020 * _sin(2 * anomaly)
    obliquity = 23.439 - 0.0000004 * n
    ascension = F.degrees(F.atan2(_cos(obliquity) * _sin(ecliptic), _cos(ecliptic)))
    sin_decl = _sin(obliquity) * _sin(ecliptic)
    cos_decl = F.sqrt(F.lit(1.0) - sin_decl * sin_decl)
    sidereal = 280.46061837 + 360.98564736629 * n + lon
    sin_elev = _sin(lat) * sin_decl + _cos(lat) * cos_decl * _cos(sidereal - ascension)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin_elev))))


def refraction(elevation: Column, pressure_pa: Column, temp_c: Column) -> Column:
    """Degrees to add to the true elevation; zero once the sun is below the horizon."""
    lift = ((pressure_pa / 100.0) / 1010.0 * (283.0 / (273.0 + temp_c)) * 1.02
            / (60.0 * F.tan(F.radians(elevation + 10.3 / (elevation + 5.11)))))
    return F.when(elevation >= _HORIZON, lift).otherwise(0.0)


def sun_elevation(ts: str | Column, lat: Column | float, lon: Column | float,
                  pressure_pa: Column | float | None = None, temp_c: Column | float = 12.0,
                  altitude_m: Column | float | None = None) -> Column:
    """Apparent elevation in degrees: the true one plus refraction.

    Without a pressure, that of the standard atmosphere at the altitude counts (sea level if none
    is given). An altitude also subtracts the sun's parallax, at most 8.8 seconds of arc.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    elevation = true_elevation(ts, as_col(lat), as_col(lon))
    if pressure_pa is None:
        pressure_pa = 101325.0 * F.pow(1 - 2.25577e-5 * as_col(0.0 if altitude_m is None else altitude_m), F.lit(5.25588))
    if altitude_m is not None:
        elevation = elevation - 8.794 / 3600 * F.cos(F.radians(elevation))
    return elevation + refraction(elevation, as_col(pressure_pa), as_col(temp_c))
