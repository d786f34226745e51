"""Small rules of plans, flights, scenes and run logs, as expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilth.functions.agronomy import STAGES

#: Plans in which a drone flies, and the plan of those who chose none (fixed values).
FLYING_PLANS, DEFAULT_PLAN = ("drone", "thermal"), "satellite"
#: Shares of missing or negative pixels from which data, not cloud, is to blame (fixed values).
NODATA_SHARE, NEGATIVE_SHARE = 0.2, 0.25
#: Chance from which a warm patch is worth a message; NDVI below which ground is bare; days until a crop shows (fixed values).
WORTH_TEXTING, BARE_NDVI, EMERGENCE_DAYS = 0.4, 0.28, 45


def stage_order(stage: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s, _, _ in STAGES)), stage)


def watch_for(stage: Column) -> Column:
    """What to scout for at a growth stage, most pressing first."""
    last = len(STAGES)
    item = lambda name, when: F.when(when, name)
    return F.array_compact(F.array(
        item("midge", stage.isin("heading", "flowering")), item("sugarcane_aphid", stage_order(stage).between(1, last - 1)),
        item("headworm", stage.isin("flowering", "soft_dough", "hard_dough")), item("harvest", stage.isin("hard_dough", "black_layer")),
    ))


def plan_of(own: Column, farmers: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(farmers, F.lit("")), F.lit(DEFAULT_PLAN))


def can_send(channel: Column, sms_ready: bool, token: str | None) -> Column:
    return F.when(channel == "sms", F.lit(sms_ready)).when(channel == "telegram", F.lit(bool(token))).otherwise(F.lit(False))


def drone_wait(plan: Column, flight: Column, has_report: Column) -> Column:
    """Why a field's answer waits for its flight: photos or working; NULL if it does not."""
    waits = plan.isin(*FLYING_PLANS) & ~F.coalesce(flight.isin("done", "failed"), F.lit(False)) & ~has_report
    return F.when(waits, F.when(flight == "working", "working").otherwise("photos"))


def expected_action(status: Column, irrigated: Column, days: Column) -> Column:
    """What the water balance calls for."""
    by_days = F.when(days <= 0, "water_now").when(days <= 3, "water_soon").when(days.isNotNull(), "no_water_yet")
    return F.when(status.isin("harvested", "mature"), status).when(~irrigated, "not_irrigated").otherwise(by_days)


def bare_ground(level: Column, perennial: Column, sown: Column, days_since_start: Column) -> Column:
    """grove or stand, where recent images show bare ground under a crop; else NULL."""
    return F.when(level < BARE_NDVI, F.when(perennial, "grove").when(sown & (days_since_start >= EMERGENCE_DAYS), "stand"))


def weather_source(in_conus: Column) -> Column:
    return F.when(in_conus, "gridmet").otherwise("power")


def canopy(celsius: Column, height_m: Column, least_m: float = 0.3) -> Column:
    return F.coalesce(celsius.isNotNull() & ~F.isnan(celsius) & (height_m >= least_m) & ~F.isnan(height_m), F.lit(False))


def leaf(celsius: Column, share: Column, least: float = 0.3) -> Column:
    return F.coalesce(celsius.isNotNull() & ~F.isnan(celsius) & (share >= least) & ~F.isnan(share), F.lit(False))


def size_measure(method: Column, height_mean: Column, volume: Column) -> Column:
    """What units of a method are compared by: mean height of row pieces, which clipping does not change, else volume."""
    return F.when(method == "rows", height_mean).otherwise(volume)


def readable(hrefs: Column, needed: int) -> Column:
    """Whether all needed bands are open files of the right kind."""
    low = lambda h: F.lower(h)
    return (F.size(hrefs) >= needed) & F.forall(hrefs, lambda h: h.isNotNull() & ~low(h).startswith("s3://") & ~low(h).endswith(".jp2"))


def nodata_dominated(status: Column, nodata: Column) -> Column:
    return (status == "dropped") & (nodata > NODATA_SHARE)


def drop_reason(valid: Column, nodata: Column, least: float) -> Column:
    """Why a scene was left out; NULL where the valid share is. Shares are rounded from their exact binary value, as C's printf does."""
    cause = F.when(nodata > NODATA_SHARE, "mostly nodata").otherwise("cloud or shadow")
    finite = F.abs(valid) < float("inf")
    # format_string rounds the shortest decimal form up; format_number the value itself, half to even, with commas
    share = F.when(finite, F.translate(F.format_number(valid, 2), ",", "")).when(F.isnan(valid), "nan").when(valid.isNotNull(), F.when(valid > 0, "inf").otherwise("-inf"))
    return F.concat(F.lit("valid_fraction "), share, F.lit(f" below threshold {least:.2f} ("), cause, F.lit(")"))


def field_likeness(purity: Column, squareness: Column, acres: Column) -> Column:
    """Score of a candidate outline: pure, rectangular and of an everyday size (about 50 acres)."""
    return purity * 2 + squareness + F.exp(-F.pow(F.log(acres) - math.log(50.0), F.lit(2.0)) / 2)


def footprint_m(width_px: Column, height_px: Column, gsd_cm: Column) -> tuple[Column, Column]:
    return width_px * gsd_cm / 100, height_px * gsd_cm / 100


def frames_needed(area_m2: Column, across_m: Column, along_m: Column, overlap: Column, side: float = 0.70) -> Column:
    """Frames that cover an area at the forward overlap (0.80 if unknown) and the side overlap."""
    each = along_m * (1 - F.coalesce(overlap, F.lit(0.80))) * (across_m * (1 - side))
    return F.when(each > 0, F.ceil(area_m2 / each)).otherwise(F.lit(0)).cast("long")


def height_above_ground(relative_mean: Column, altitude_mean: Column, ground: Column) -> Column:
    """Mean relative altitude, else the mean altitude above the ground if that is over 1 m."""
    return F.coalesce(relative_mean, F.when(altitude_mean - ground > 1, altitude_mean - ground))


def rational(text: Column) -> Column:
    """'28/10' or '2.8' as a number; NULL for a zero divisor."""
    top, bottom = F.get(F.split(text, "/"), F.lit(0)).try_cast("double"), F.get(F.split(text, "/"), F.lit(1)).try_cast("double")
    return F.when(text.contains("/"), F.try_divide(top, F.nullif(bottom, F.lit(0.0)))).otherwise(top)


def near_any(number: Column, known: Column) -> Column:
    """Whether a number is one of the known, within 3 % or 0.051."""
    return F.exists(known, lambda k: F.abs(number - k) <= F.greatest(F.lit(0.051), 0.03 * F.abs(k)))


def content_key(name: Column, content: Column) -> Column:
    """16 hex digits that stand for a model's name and a JSON text."""
    return F.left(F.sha2(F.concat(name, content), 256), F.lit(16))


def strip_colours(text: Column) -> Column:
    """Text without terminal colour codes."""
    return F.regexp_replace(text, "\x1b?\\[[0-9;]*m", "")


def last_stage(log: Column) -> Column:
    """The last stage that a run log says was started."""
    return F.try_element_at(F.regexp_extract_all(log, F.lit(r"Running (\w+) stage"), 1), F.lit(-1))


#: What failed runs say, the most telling first, and a word for the cause (the texts are fixed values).
SIGNATURES = (
    ("Good tracks: 0", "no matches"), ("0 partial reconstructions in total", "no reconstruction"), ("could not process this dataset using the current settings", "unusable"), ("not enough overlap", "overlap"),
    ("Not enough supported images", "few images"), ("No images found", "empty folder"), ("MemoryError", "memory"), ("Killed", "memory"), ("Cannot find a valid georeference", "no positions"), ("cannot allocate memory", "memory"),
)


def diagnosis(log: Column, code: Column) -> Column:
    """Why a run failed, by the first known text in its log, else by its exit code."""
    low = F.lower(log)
    rest = F.when(code == 137, "memory").otherwise("unknown")
    return reduce(lambda out, s: F.when(low.contains(s[0].lower()), s[1]).otherwise(out), reversed(SIGNATURES), rest)
