"""Scenes of a field: grouping by day, choice of what to read, and shares of pixels inside the outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.operators.quantiles import exact_quantiles
from tilth.functions.rules import NEGATIVE_SHARE


def by_solar_day(scenes: DataFrame) -> DataFrame:
    """Scenes (field, day, scene) of each day, in order of their names; a day has as many as there are tiles."""
    return scenes.groupBy("field", "day").agg(F.array_sort(F.collect_set("scene")).alias("scenes"))


def preference(nodata: Column, cloud: Column) -> Column:
    """Rank of a tile: least missing, then least clouded; unknown counts as all."""
    return F.struct(F.coalesce(nodata, F.lit(100.0)).alias("nodata"), F.coalesce(cloud, F.lit(100.0)).alias("cloud"))


def reading_order(scenes: DataFrame) -> DataFrame:
    """What to read for each field and day, from scenes (field, day, scene, readable, nodata, cloud, cells, n_cells).

    cells are the field's cells that the scene covers, n_cells all of the field. `primary` is the best of the
    readable scenes that cover all or, if none does, those that each add cells, from the largest cover on;
    `others` are further covering scenes, best first, where one scene is primary.
    """
    one = F.struct(preference(F.col("nodata"), F.col("cloud")).alias("rank"), "scene", "readable", "cells", (F.size("cells") >= F.col("n_cells")).alias("whole"))
    days = scenes.groupBy("field", "day").agg(F.array_sort(F.collect_list(one)).alias("all"), F.max("n_cells").alias("n_cells"))
    readable = F.filter("all", lambda s: s["readable"])
    days = days.withColumn("usable", F.when(F.size(readable) > 0, readable).otherwise(F.col("all")))
    names = lambda xs: F.transform(xs, lambda s: s["scene"])
    whole = F.filter("usable", lambda s: s["whole"])
    largest = F.array_sort(F.transform("usable", lambda s: F.struct((-F.size(s["cells"])).alias("n"), s["rank"].alias("rank"), s["scene"].alias("scene"), s["cells"].alias("cells"))))
    start = F.struct(F.array().cast("array<bigint>").alias("seen"), F.array().cast("array<string>").alias("chosen"))

    def add(acc: Column, s: Column) -> Column:
        useful = (F.size(acc["seen"]) < F.col("n_cells")) & (F.size(F.array_except(s["cells"], acc["seen"])) > 0)
        return F.when(useful, F.struct(F.array_union(acc["seen"], s["cells"]).alias("seen"), F.array_append(acc["chosen"], s["scene"]).alias("chosen"))).otherwise(acc)

    joined = F.aggregate(largest, start, add, lambda acc: acc["chosen"])
    primary = F.when(F.size("usable") <= 1, names(F.col("usable"))).when(F.size(whole) > 0, F.slice(names(whole), 1, 1)).when(F.size(joined) > 0, joined).otherwise(names(F.col("all")))
    days = days.withColumn("primary", primary)
    others = names(F.filter("all", lambda s: s["readable"] & s["whole"] & ~F.array_contains("primary", s["scene"])))
    return days.select("field", "day", "primary", F.when(F.size("primary") == 1, others).otherwise(F.array().cast("array<string>")).alias("others"))


def class_share(pixels: DataFrame, keys: list[str], scene_class: int) -> DataFrame:
    """Share of the pixels inside the outline that a scene class has; 0 without any."""
    inside = F.count_if("inside")
    return pixels.groupBy(*keys).agg(F.coalesce(F.try_divide(F.count_if(F.col("inside") & (F.col("scl") == scene_class)), inside), F.lit(0.0)).alias("share"))


def negative_shares(pixels: DataFrame, keys: list[str], band: str) -> DataFrame:
    """Share of valid pixels below zero inside the outline, and whether scale or offset must be wrong."""
    valid = F.col("inside") & F.col(band).isNotNull() & ~F.isnan(band)
    share = F.coalesce(F.try_divide(F.count_if(valid & (F.col(band) < 0)), F.count_if(valid)), F.lit(0.0))
    return pixels.groupBy(*keys).agg(share.alias("share")).withColumn("implausible", F.col("share") > NEGATIVE_SHARE)


def dark_level(pixels: DataFrame, keys: list[str], band: str) -> DataFrame:
    """The 2nd percentile of a band's positive numbers."""
    return exact_quantiles(pixels.where(F.col(band) > 0), keys, band, [0.02]).select(*keys, F.get("q", F.lit(0)).alias("dark"))


def rows_of_scenes(observations: DataFrame, scenes: DataFrame) -> DataFrame:
    """Observations (obs, scene_ids joined by +) that any of the given scenes (scene) is part of."""
    parts = observations.select("obs", F.explode(F.split("scene_ids", r"\+")).alias("scene"))
    return observations.join(parts.join(scenes.select("scene"), "scene", "left_semi").select("obs").distinct(), "obs", "left_semi")


def nearest_normal(readings: DataFrame, baseline: DataFrame, keys: list[str], last: int = 3) -> DataFrame:
    """The last readings (date, doy, value) of each key beside the normal value (doy, median) of the nearest day.

    A key has 366 normals at most, so they are held as one array.
    """
    normals = baseline.where("median is not null").groupBy(*keys).agg(F.collect_list(F.struct("doy", "median")).alias("normals"))
    recent = readings.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set(F.struct("date", "doy", "value")), asc=False), 1, last).alias("r")).select(*keys, F.explode("r").alias("r")).select(*keys, "r.*")
    nearest = F.array_min(F.transform("normals", lambda n: F.struct(F.abs(n["doy"] - F.col("doy")).alias("d"), n["doy"].alias("doy"), n["median"].alias("median"))))["median"]
    return recent.join(normals, keys, "left").select(*keys, "date", "value", nearest.alias("normal"))
