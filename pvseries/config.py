"""Settings of the two site types: feature groups, splits, windows and valid ranges.

The column lists, ranges and ratios below are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SENTINELS = (-999.0, -9999.0, -99.0)

CYCLIC = ("hour_sin", "hour_cos", "month_sin", "month_cos", "doy_sin", "doy_cos")
FLAGS = ("is_daytime", "is_peak_hours")
INTERACTIONS = ("cloud_rad", "temp_rad")

MINMAX, STANDARD = "minmax", "standard"


@dataclass(frozen=True)
class FeatureGroup:
    """Features that share a scaler; ``kind=None`` leaves them unscaled."""

    name: str
    features: tuple[str, ...]
    kind: str | None = None
    lo: float = 0.0
    hi: float = 1.0


@dataclass(frozen=True)
class SplitSpec:
    """Chronological shares; the test part is the remainder."""

    train: float = 0.7
    val: float = 0.2


@dataclass(frozen=True)
class WindowSpec:
    """Rows of history per sample and rows ahead to predict."""

    lookback: int = 2
    horizon: int = 1


@dataclass(frozen=True)
class RangeRule:
    """Inclusive valid range of one column; ``None`` leaves a side open."""

    column: str
    lo: float | None = None
    hi: float | None = None


@dataclass(frozen=True)
class ModelSpec:
    """Everything needed to go from a clean table to look-back windows."""

    name: str
    target: str
    ts: str
    groups: tuple[FeatureGroup, ...]
    daylight: str               # column whose positive values mark usable hours
    sun: str                    # column that drives is_daytime
    peak: tuple[int, int]       # inclusive hour band of is_peak_hours
    split: SplitSpec = field(default_factory=SplitSpec)
    window: WindowSpec = field(default_factory=WindowSpec)
    min_train: int = 1000
    min_train_inclusive: bool = False
    interactions: bool = False

    @property
    def features(self) -> list[str]:
        return [f for g in self.groups for f in g.features]

    @property
    def scaled(self) -> tuple[FeatureGroup, ...]:
        target = FeatureGroup("target", (self.target,), MINMAX)
        return tuple(g for g in self.groups if g.kind) + (target,)


_CALENDAR = (FeatureGroup("cyclic", CYCLIC), FeatureGroup("flags", FLAGS))

# Gridded-weather site, 18 features.
GRIDDED = ModelSpec(
    name="gridded", target="P", ts="datetime",
    groups=(
        FeatureGroup("spatial", ("G_i", "Gb_i", "Gd_i", "Gr_i"), MINMAX),
        FeatureGroup("temporal", ("T2m", "WS10m", "RH", "SP"), STANDARD),
        FeatureGroup("angle", ("H_sun", "WD10m"), MINMAX, -1.0, 1.0),
    ) + _CALENDAR,
    daylight="G_i", sun="H_sun", peak=(5, 9))

# Weather-station site, 18 features and two hours of history.
STATION = ModelSpec(
    name="station", target="generation", ts="Datetime",
    groups=(
        FeatureGroup("spatial", ("solarradiation", "solarenergy", "cloudcover", "visibility"), MINMAX),
        FeatureGroup("temporal", ("temp", "humidity", "windspeed", "sealevelpressure"), STANDARD),
        FeatureGroup("angle", ("sunheight", "winddir"), MINMAX, -1.0, 1.0),
    ) + _CALENDAR,
    daylight="solarradiation", sun="sunheight", peak=(6, 12), min_train=500)

# Weather-station site, 28 features and a full day of history.
STATION_DAY = ModelSpec(
    name="station_day", target="generation", ts="Datetime",
    groups=(
        FeatureGroup("solar", ("solarradiation", "solarenergy", "uvindex"), MINMAX),
        FeatureGroup("met", ("temp", "feelslike", "dew", "humidity", "windspeed", "windgust",
                             "sealevelpressure", "cloudcover", "visibility"), STANDARD),
        FeatureGroup("precip", ("precip", "precipprob", "snow", "snowdepth"), MINMAX),
        FeatureGroup("angle", ("sunheight", "winddir"), MINMAX, -1.0, 1.0),
    ) + _CALENDAR + (FeatureGroup("interact", INTERACTIONS),),
    daylight="solarradiation", sun="solarradiation", peak=(8, 16),
    window=WindowSpec(24, 1), min_train=500, min_train_inclusive=True, interactions=True)

GRIDDED_RANGES = (
    RangeRule("P", 0, 1100), RangeRule("G_i", 0, 1600), RangeRule("H_sun", -90, 90),
    RangeRule("T2m", -10, 55), RangeRule("WS10m", 0, 30), RangeRule("RH", 0, 100),
    RangeRule("SP", 80000, 105000), RangeRule("WD10m", 0, 360))

STATION_RANGES = (
    RangeRule("generation", 0, None), RangeRule("solarradiation", 0, None),
    RangeRule("temp", -40, 50), RangeRule("humidity", 0, 100),
    RangeRule("windspeed", 0, None), RangeRule("sealevelpressure", 900, 1100))

STATION_DAY_RANGES = (
    RangeRule("generation", -0.5, 500), RangeRule("solarradiation", 0, 1500),
    RangeRule("temp", -30, 45), RangeRule("humidity", 0, 100),
    RangeRule("sealevelpressure", 950, 1060), RangeRule("sunheight", -90, 90))

# Inputs of the all-hours and daytime tree models.
TREE_FEATURES = ("G_i", "Gb_i", "Gd_i", "Gr_i", "H_sun", "T2m", "WS10m", "RH", "SP", "WD10m",
                 "hour_sin", "hour_cos", "month_sin", "month_cos")
