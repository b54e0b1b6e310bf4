"""Timestamps, calendar parts and time-derived features, all as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, and month -> season under each scheme.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SEASONS = {
    "monsoon": {"Winter": (12, 1, 2), "Summer": (3, 4, 5), "Monsoon": (6, 7, 8, 9),
                "Post-Monsoon": (10, 11)},
    "temperate": {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)},
}


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; works for both timestamp types."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def _parser(strict: bool):
    return F.to_timestamp if strict else F.try_to_timestamp


def parse_colon(c: str | Column, strict: bool = True) -> Column:
    """``20190101:0030`` as UTC. ``strict=False`` turns bad text into null."""
    c = F.col(c) if isinstance(c, str) else c
    return _parser(strict)(F.trim(c), F.lit("yyyyMMdd:HHmm") if not strict else "yyyyMMdd:HHmm")


def parse_compact(c: str | Column, strict: bool = True) -> Column:
    """``2019010100``, text or integer, as UTC."""
    c = F.col(c) if isinstance(c, str) else c
    return _parser(strict)(c.cast("string"), F.lit("yyyyMMddHH") if not strict else "yyyyMMddHH")


def parse_iso(c: str | Column) -> Column:
    """ISO text, with or without an offset, in the session time zone (UTC)."""
    return F.to_timestamp(F.col(c) if isinstance(c, str) else c)


def format_utc(ts: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss+00:00``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))


def shift_minutes(ts: Column, minutes: int) -> Column:
    return ts + F.make_dt_interval(mins=F.lit(minutes))


def align_half_hour(ts: str | Column) -> Column:
    """Mid-hour stamps to the start of the hour."""
    return shift_minutes(F.col(ts) if isinstance(ts, str) else ts, -30)


def from_parts(year: str, month: str, day: str, hour: str, local_tz: str | None = None) -> Column:
    """Timestamp of four integer columns; ``local_tz`` converts wall time to UTC."""
    zero = F.lit(0)
    ts = F.make_timestamp(F.col(year), F.col(month), F.col(day), F.col(hour), zero, zero)
    return F.to_utc_timestamp(ts, local_tz) if local_tz else ts


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Add hour, day, month, year, date and day_of_year."""
    return df.withColumns({
        "hour": F.hour(ts), "day": F.dayofmonth(ts), "month": F.month(ts), "year": F.year(ts),
        "date": F.to_date(ts), "day_of_year": F.dayofyear(ts)})


def season(month: Column, scheme: str = "monsoon") -> Column:
    label = F.lit(None).cast("string")
    for name, months in SEASONS[scheme].items():
        label = F.when(month.isin(*months), name).otherwise(label)
    return label


def season_order(scheme: str = "monsoon") -> tuple[str, ...]:
    return tuple(SEASONS[scheme])


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month)


def cyclic(value: Column, period: int, name: str) -> dict[str, Column]:
    """Sine and cosine of a periodic quantity, keyed ``{name}_sin`` and ``{name}_cos``."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def cyclic_features(ts: str) -> dict[str, Column]:
    """Hour, month and day-of-year cycles; the year counts 365 days, leap or not."""
    return {**cyclic(F.hour(ts), 24, "hour"), **cyclic(F.month(ts), 12, "month"),
            **cyclic(F.dayofyear(ts), 365, "doy")}


def daytime_flag(sun: str | Column) -> Column:
    """1 above the horizon; missing and unparsable values count as night."""
    c = F.col(sun) if isinstance(sun, str) else sun
    return (F.coalesce(c.try_cast("double"), F.lit(0.0)) > 0).cast("int")


def peak_flag(hour: Column, lo: int, hi: int) -> Column:
    return hour.between(lo, hi).cast("int")


def model_features(df: DataFrame, ts: str, sun: str, peak: Sequence[int]) -> DataFrame:
    """The six cyclic columns and the two flags."""
    return df.withColumns({**cyclic_features(ts), "is_daytime": daytime_flag(sun),
                           "is_peak_hours": peak_flag(F.hour(ts), *peak)})


def skew_label(skew: Column) -> Column:
    return (F.when(F.abs(skew) < 0.5, "symmetric").when(skew > 0, "right-skewed")
            .when(skew.isNotNull(), "left-skewed"))


def effect_label(corr: Column) -> Column:
    """Direction of effect; an undefined correlation counts as mixed."""
    return F.when(corr > 0.1, "up").when(corr < -0.1, "down").otherwise("mixed")
