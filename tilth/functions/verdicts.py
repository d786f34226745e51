"""Rules that turn figures into verdicts, warnings and lists, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilth.functions.agronomy import STAGES
from tilth.functions.stats import logistic

#: Plausible row spacings in m by crop word, and memory in GB by number of photos (fixed values).
SPACING = {"sorghum": (0.35, 1.05), "corn": (0.35, 1.05), "maize": (0.35, 1.05), "cotton": (0.5, 1.05), "soy": (0.18, 0.8), "cane": (1.2, 2.2)}
MEMORY = ((100, 4), (250, 8), (500, 16), (1500, 32), (2500, 64))
#: Crop words in the order they are looked for (fixed values).
CROP_WORDS = ("sorghum", "sugarcane", "cane", "cotton", "corn", "soy", "citrus", "orange", "grapefruit")
#: Border of the lower 48 states in the south: longitude and latitude (fixed values).
CONUS = (-125.0, 24.0, -66.5, 49.5)


def first_word(text: Column, words: tuple[str, ...] = CROP_WORDS) -> Column:
    """The first of the words that a text contains."""
    out = F.lit(None).cast("string")
    for w in reversed(words):
        out = F.when(F.lower(text).contains(w), w).otherwise(out)
    return out


def agreement(satellite: Column, drone: Column, satellite_alarm: Column, drone_share: Column, concern: float) -> Column:
    """How two views of a field agree; satellite and drone say whether there is such a view."""
    high = drone_share >= concern
    return (
        F.when(~satellite & ~drone, "no data")
        .when(~drone, F.when(satellite_alarm, "satellite only: fly it").otherwise("satellite only"))
        .when(~satellite, "drone only")
        .when(satellite_alarm & high, "both see trouble")
        .when(satellite_alarm, "satellite alone sees trouble")
        .when(high, "drone alone sees trouble")
        .otherwise("both see none")
    )


def survey_warnings(n_images: Column, n_gps: Column, overlap: Column, altitude_spread: Column) -> Column:
    """What speaks against a flight, worst first."""
    return F.array_compact(
        F.array(
            F.when(n_images < 12, F.concat(F.lit("only "), n_images.cast("string"), F.lit(" images"))),
            F.when(n_gps < n_images, F.concat((n_images - n_gps).cast("string"), F.lit(" images without position"))),
            F.when(overlap.isNull(), "overlap unknown").when(overlap < 0.7, "too little overlap"),
            F.when(altitude_spread > 0.15, "uneven altitude"),
        )
    )


def spacing_warning(crop: Column, spacing_m: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, (low, high) in SPACING.items():
        out = F.when(F.lower(crop).contains(word) & ~spacing_m.between(low, high), F.lit(f"expected {low} to {high} m for {word}")).otherwise(out)
    return out


def memory_needed(n_images: Column) -> Column:
    out = None
    for n, gb in MEMORY:
        out = F.when(n_images <= n, gb) if out is None else out.when(n_images <= n, gb)
    return out.otherwise(MEMORY[-1][1])


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(F.lit("planted"), *(F.lit(s[0]) for s in STAGES)), stage)


def aphid_threshold(stage: Column) -> Column:
    """Percent of infested plants that calls for action: 20 before heading, 30 from then on, none once ripe."""
    rank, heading, ripe = stage_rank(stage), 1 + [s[0] for s in STAGES].index("heading") + 1, 1 + len(STAGES)
    return F.when(rank >= ripe, F.lit(None).cast("int")).when(rank >= heading, 30).when(rank >= 1, 20)


def aphid_verdict(percent: Column, stage: Column) -> Column:
    need = aphid_threshold(stage)
    return F.when(need.isNull(), "harvest").when(percent >= need, "above").when(percent >= need - 5, "near").otherwise("below")


def patch_chance(above_c: Column, area_m2: Column, compact: Column, ground: Column, water_days: Column, problem: Column, field_problem: Column) -> Column:
    """Chance that a warm patch is a pest, from a weighted scorecard."""
    points = (
        F.when(above_c >= 3, 2).when(above_c >= 2, 1).otherwise(-1)
        + F.when(area_m2 >= 200, 1).otherwise(0)
        + F.when(compact >= 0.35, 1).when(compact <= 0.15, -1).otherwise(0)
        + F.when(ground == "high", -2).when(ground == "low", -1).when(ground == "level", 2).otherwise(0)
        + F.when(water_days.isNull(), 0).when(water_days >= 3, 2).otherwise(-2)
        + F.when(problem.isNull(), 0).when(problem > F.greatest(F.lit(0.1), 1.5 * field_problem), 2).when(problem <= field_problem, -1).otherwise(0)
    )
    return F.round(F.greatest(F.lit(0.10), F.least(F.lit(0.85), logistic((points - 3) / 1.6))), 2)


def compactness(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area / (perimeter * perimeter))


def in_conus(lat: Column, lon: Column) -> Column:
    west, south, east, north = CONUS
    return lon.between(west, east) & lat.between(south, north)


def missing_facts(facts: dict[str, Column]) -> Column:
    """Names of the facts that are NULL, in order; the first is the next question."""
    return F.array_compact(F.array(*(F.when(c.isNull(), name) for name, c in facts.items())))


def harmonised(flag: Column, dark_dn: Column) -> Column:
    """Whether reflectance has its offset taken off already: by the file's flag, else by its dark pixels."""
    return F.coalesce(flag, dark_dn < 1000)


def thermal_unit(median: Column) -> Column:
    return F.when(median > 2000, "centikelvin").when(median > 200, "kelvin").when(median.between(-20, 70), "celsius")
