"""Crop, soil and weather expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilth.functions.spectral import clamp

MM_PER_INCH = 25.4
NDVI_BARE, NDVI_FULL = 0.15, 0.85
LIGHT_RAIN_SHARE = 0.2
#: kc_ini, kc_mid, depletion fraction, least and largest root depth in m, perennial (fixed values).
CROPS = {
    "sorghum": (0.30, 1.05, 0.55, 0.3, 1.2, False),
    "sugarcane": (0.40, 1.25, 0.65, 0.8, 1.5, False),
    "cotton": (0.35, 1.18, 0.65, 0.3, 1.2, False),
    "corn": (0.30, 1.20, 0.55, 0.3, 1.2, False),
    "soybean": (0.40, 1.15, 0.50, 0.3, 1.0, False),
    "citrus": (0.65, 0.65, 0.50, 1.2, 1.2, True),
}
#: Share of applied water that stays in the root zone, by irrigation method (fixed values).
EFFICIENCY = {"furrow": 0.65, "flood": 0.70, "border": 0.70, "basin": 0.80, "sprinkler": 0.75, "pivot": 0.85, "drip": 0.90}
#: Growth stages with degree units needed by short- and long-season hybrids (fixed values).
STAGES = (
    ("emergence", 200, 200), ("three_leaf", 500, 500), ("four_leaf", 575, 575), ("five_leaf", 660, 660),
    ("panicle_initiation", 924, 1365), ("flag_leaf", 1287, 1470), ("boot", 1683, 1750), ("heading", 1749, 1890),
    ("flowering", 1848, 1995), ("soft_dough", 2211, 2310), ("hard_dough", 2508, 2765), ("black_layer", 2673, 3360),
)
#: Depths in m of the soil storage curve.
STORAGE_DEPTHS = (0.25, 0.5, 1.0, 1.5)


def canopy_fraction(ndvi: Column) -> Column:
    return clamp((ndvi - NDVI_BARE) / (NDVI_FULL - NDVI_BARE), 0.0, 1.0)


def crop_coefficient(cover: Column, kc_ini: Column, kc_mid: Column, perennial: Column) -> Column:
    return F.when(perennial, kc_mid).otherwise(kc_ini + (kc_mid - kc_ini) * cover)


def depletion_fraction(base: Column, demand_mm: Column) -> Column:
    """Share of stored water that may go before stress: less on days of high demand."""
    return clamp(base + F.lit(0.04) * (F.lit(5.0) - demand_mm), 0.1, 0.8)


def effective_rain(rain_mm: Column, eto_mm: Column) -> Column:
    """Rain lighter than a fifth of the day's demand wets leaves only."""
    return F.when(rain_mm >= LIGHT_RAIN_SHARE * eto_mm, rain_mm).otherwise(F.lit(0.0))


def c_to_f(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def degree_units(high_c: Column, low_c: Column) -> Column:
    """Growing degree units of a day, base 50 F and cap 100 F."""
    return (clamp(c_to_f(high_c), 50.0, 100.0) + clamp(c_to_f(low_c), 50.0, 100.0)) / 2 - 50


def stage_needs(maturity: str | None = None) -> list[tuple[str, float]]:
    """Stage and degree units; a medium hybrid needs the rounded mean of the two."""
    pick = {"short": lambda s, g: s, "long": lambda s, g: g}.get(maturity or "medium", lambda s, g: round((s + g) / 2))
    return [(name, float(pick(short, long))) for name, short, long in STAGES]


def vapour_kpa(celsius: Column) -> Column:
    return F.lit(0.6108) * F.exp(F.lit(17.27) * celsius / (celsius + 237.3))


def reference_et(tmax: Column, tmin: Column, dew: Column, wind: Column, solar: Column, lat: Column, elevation: Column, doy: Column) -> Column:
    """FAO-56 Penman-Monteith reference evapotranspiration in mm a day (wind at 2 m, solar in MJ).

    Wind counts as 0.5 m/s at least and solar as none below zero, the air holds no more vapour than
    saturates it, and a day without sun above the horizon has no figure (NULL), as any missing input.
    """
    wind, solar = F.when(wind < 0.5, 0.5).otherwise(wind), F.when(solar < 0, 0.0).otherwise(solar)
    mean = (tmax + tmin) / 2
    pressure = F.lit(101.3) * F.pow((F.lit(293.0) - 0.0065 * elevation) / 293.0, F.lit(5.26))
    gamma = F.lit(0.000665) * pressure
    slope = 4098 * vapour_kpa(mean) / F.pow(mean + 237.3, F.lit(2.0))
    saturated, actual = (vapour_kpa(tmax) + vapour_kpa(tmin)) / 2, vapour_kpa(dew)
    actual = F.when(actual > saturated, saturated).otherwise(actual)
    angle = F.lit(2 * math.pi / 365) * doy
    distance = F.lit(1.0) + 0.033 * F.cos(angle)
    tilt = F.lit(0.409) * F.sin(angle - 1.39)
    phi = lat * (math.pi / 180)
    sunset = F.acos(clamp(-F.tan(phi) * F.tan(tilt), -1.0, 1.0))
    above = F.lit(24 * 60 / math.pi * 0.0820) * distance * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))
    clear = (F.lit(0.75) + 2e-5 * elevation) * above
    cloud = clamp(F.when(clear > 0, solar / clear), 0.3, 1.0)
    kelvin4 = (F.pow(tmax + 273.16, F.lit(4.0)) + F.pow(tmin + 273.16, F.lit(4.0))) / 2
    long_wave = F.lit(4.903e-9) * kelvin4 * (F.lit(0.34) - 0.14 * F.sqrt(actual)) * (1.35 * cloud - 0.35)
    net = F.lit(0.77) * solar - long_wave
    top = 0.408 * slope * net + gamma * 900 / (mean + 273) * wind * (saturated - actual)
    eto = top / (slope + gamma * (1 + 0.34 * wind))
    return F.when(eto < 0, 0.0).otherwise(eto)


def stored_water_mm(depth_m: Column, storage_cm: list[Column]) -> Column:
    """Available water down to a depth: piecewise linear through the storage knots, the last slope goes on."""
    knots = [(0.0, F.lit(0.0)), *zip(STORAGE_DEPTHS, storage_cm, strict=True)]
    out = None
    for (d0, s0), (d1, s1) in zip(knots, knots[1:], strict=False):
        line = (s0 + (s1 - s0) * (depth_m - d0) / (d1 - d0)) * 10
        out = F.when(depth_m <= d1, line) if out is None else out.when(depth_m <= d1, line)
    return out.otherwise(line)


def uniform_storage_cm(inches_per_foot: Column) -> list[Column]:
    """Storage knots of a soil given by one figure."""
    return [inches_per_foot * (2.54 * d * 100 / 30.48) for d in STORAGE_DEPTHS]


def days_status(days: Column) -> Column:
    return F.when(days.isNull(), "ok for now").when(days <= 0, "water now").when(days <= 3, "water within 3 days").when(days <= 7, "water this week").otherwise("ok for now")


def lookup(table: dict, key: Column, part: int | None = None) -> Column:
    """A value of a small fixed table; NULL for other keys."""
    flat = [F.lit(x) for k, v in table.items() for x in (k, v if part is None else v[part])]
    return F.create_map(*flat)[key]
