"""Soil expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilth.functions.spectral import clamp

#: Inches of water that a foot of soil can plausibly hold (fixed values).
AWC_RANGE = (0.3, 4.0)


def available_water_fraction(sand: Column, clay: Column, organic: Column) -> Column:
    """Water between field capacity and wilting as a share of the volume (Saxton and Rawls 2006, equations 1 and 2), from percents."""
    s, c, o = sand / 100, clay / 100, clamp(organic, 0.0, 8.0)
    dry = -0.024 * s + 0.487 * c + 0.006 * o + 0.005 * s * o - 0.013 * c * o + 0.068 * s * c + 0.031
    wet = -0.251 * s + 0.195 * c + 0.011 * o + 0.006 * s * o - 0.027 * c * o + 0.452 * s * c + 0.299
    wilting = dry + (0.14 * dry - 0.02)
    capacity = wet + (1.283 * wet * wet - 0.374 * wet - 0.015)
    return F.greatest(capacity - wilting, F.lit(0.0))


def intake(group: Column, clay: Column, sand: Column) -> Column:
    """How fast water soaks in: by the hydrologic group or, where it is not given, the surface texture."""
    g = F.upper(F.coalesce(group, F.lit("")))
    none = g == ""
    slow = g.startswith("D") | g.startswith("C/D") | (none & F.coalesce(clay >= 40, F.lit(False)))
    fast = g.startswith("A") | (none & F.coalesce(sand >= 70, F.lit(False)))
    return F.when(slow, "slow").when(fast, "fast").otherwise("moderate")


def texture(clay: Column, sand: Column) -> Column:
    return F.when(clay.isNull() | sand.isNull(), "unknown").when(clay >= 40, "clay").when(clay >= 27, "clay loam").when(sand >= 52, "sandy").otherwise("loam")


def inches_per_foot(storage_1m_cm: Column) -> Column:
    """Inches of water a foot of soil holds, over the top metre."""
    return storage_1m_cm / 100 * 12


def given_inches_per_foot(value: Column) -> tuple[Column, Column]:
    """A stated figure, and what is wrong with it."""
    number = value.cast("string").try_cast("double")
    given = F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))
    fits = F.coalesce(number.between(*AWC_RANGE), F.lit(False))
    return F.when(given & fits, number), F.when(given & number.isNull(), "no number").when(given & ~fits, "out of range")


def profile_cm(layers: Column, depths: tuple[float, ...]) -> Column:
    """Water stored in cm down to each depth in m, from layers (bottom_cm, fraction, stones_pct) in order of depth.

    Layers lie one under the other from the surface; stones hold none; below the last layer it goes on.
    """
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("rate"))

    def down_to(depth: float) -> Column:
        end = F.lit(depth * 100)

        def step(acc: Column, layer: Column) -> Column:
            bottom = layer["bottom_cm"].cast("double")
            rate = layer["fraction"] * (1 - F.coalesce(layer["stones_pct"].cast("double"), F.lit(0.0)) / 100)
            return F.struct(bottom.alias("top"), (acc["sum"] + rate * F.greatest(F.least(bottom, end) - acc["top"], F.lit(0.0))).alias("sum"), rate.alias("rate"))

        return F.aggregate(layers, start, step, lambda acc: acc["sum"] + acc["rate"] * F.greatest(end - acc["top"], F.lit(0.0)))

    return F.array(*map(down_to, depths))
