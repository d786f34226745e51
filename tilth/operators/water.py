"""Daily soil-water balance, projection and ranking.

The depletion recurrence depends on its own state, so a key's days are folded in order; a season has
some hundred days, and keys are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.functions.agronomy import canopy_fraction, crop_coefficient, days_status, depletion_fraction, effective_rain
from tilth.functions.spectral import clamp

MAX_PROJECTION = 45


def daily_demand(days: DataFrame, keys: list[str], date: str, taw: Column) -> DataFrame:
    """fc, kc, potential demand, its 7-day mean, depletion share, taw and raw of each day.

    days: eto, rain, ndvi, kc_ini, kc_mid, p_base, perennial.
    """
    rows = days.withColumn("fc", F.coalesce(canopy_fraction(F.col("ndvi")), F.lit(0.0)))
    rows = rows.withColumn("kc", crop_coefficient(F.col("fc"), F.col("kc_ini"), F.col("kc_mid"), F.col("perennial"))).withColumn("etp", F.col("kc") * F.col("eto"))
    order = Window.partitionBy(*keys).orderBy(date)
    rows = rows.withColumn("cover", F.max("fc").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mean = F.avg("etp").over(order.rowsBetween(-6, 0))
    return rows.withColumn("p", depletion_fraction(F.col("p_base"), mean)).withColumn("taw", taw).withColumn("raw", F.col("p") * F.col("taw"))


def balance(days: DataFrame, keys: list[str], date: str, start: Column) -> DataFrame:
    """Depletion, stress, evapotranspiration and drainage of each day.

    days: daily_demand() columns and irrigation (NULL: none, negative: a full refill of unknown size).
    """
    rain = effective_rain(F.col("rain"), F.col("eto"))
    item = F.struct(F.col(date).alias("date"), "etp", "p", "taw", "raw", rain.alias("rain"), "irrigation")
    seasons = days.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("days"), start.alias("start"))

    def step(acc: Column, d: Column) -> Column:
        dr = F.least(acc["dr"], d["taw"])
        ks = F.when(dr <= d["raw"], F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (d["taw"] - dr) / ((1 - d["p"]) * d["taw"])))
        etc = ks * d["etp"]
        water = F.when(d["irrigation"].isNull(), F.lit(0.0)).when(d["irrigation"] < 0, dr).otherwise(d["irrigation"])
        after = dr - d["rain"] - water + etc
        kept = clamp(after, 0.0, float("inf"))
        end = F.least(kept, d["taw"])
        row = F.struct(d["date"].alias("date"), ks.alias("ks"), etc.alias("etc"), end.alias("dr"), F.greatest(F.lit(0.0), -after).alias("drained"), d["raw"].alias("raw"), d["taw"].alias("taw"))
        return F.struct(end.alias("dr"), F.concat(acc["path"], F.array(row)).alias("path"))

    empty = F.expr("cast(array() as array<struct<date:date,ks:double,etc:double,dr:double,drained:double,raw:double,taw:double>>)")
    folded = F.aggregate("days", F.struct(F.col("start").cast("double").alias("dr"), empty.alias("path")), step, lambda acc: acc["path"])
    return seasons.select(*keys, F.explode(folded).alias("d")).select(*keys, "d.*")


def days_to_stress(dr: Column, raw: Column, etc: Column, most: int = MAX_PROJECTION) -> Column:
    """First whole day on which depletion reaches the stress point: 0 if it has, NULL beyond the horizon."""
    k = F.ceil((raw - dr) / F.when(etc > 0, etc)).cast("int")
    return F.when(dr >= raw, 0).when(k <= most, k)


def project(state: DataFrame) -> DataFrame:
    """Days left, its range by demand 20 % up and down, and the status of each row (dr, raw, etc)."""
    dr, raw, etc = F.col("dr"), F.col("raw"), F.col("etc")
    days = days_to_stress(dr, raw, etc)
    soon, late = (F.coalesce(days_to_stress(dr, raw, etc * f), F.lit(MAX_PROJECTION)) for f in (1.2, 0.8))
    ranged = F.coalesce(days, F.lit(MAX_PROJECTION)) > 0
    return state.withColumn("days", days).withColumn("days_soonest", F.when(ranged, soon)).withColumn("days_latest", F.when(ranged, late)).withColumn("status", days_status(F.col("days")))


def season_start(events: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Start of each key's season: the last planting of a year, else the first irrigation, else 60 days ago."""
    planted = F.max(F.when((F.col("kind") == "planted") & F.col("day").between(F.date_sub(as_of, 365), as_of), F.col("day")))
    watered = F.min(F.when((F.col("kind") == "irrigated") & F.col("day").between(F.date_sub(as_of, 365), as_of), F.col("day")))
    out = events.groupBy(*keys).agg(planted.alias("planted"), watered.alias("watered"))
    return out.select(*keys, F.coalesce("planted", "watered", F.date_sub(as_of, 60)).alias("start"), F.when(F.col("planted").isNotNull(), "planted").when(F.col("watered").isNotNull(), "irrigated").otherwise("assumed").alias("reason"))


#: Days of weather that a missing end is filled from, and days of it that may be missing (fixed values).
FILL_FROM, FILL_MOST = 7, 10


def complete_weather(weather: DataFrame, spans: DataFrame) -> DataFrame:
    """Every day of each field's span (field, start, as_of) with eto and rain, whether it was filled, and what is wrong.

    Weather is published a few days late, so up to FILL_MOST days at the end are filled with the mean of
    the week before them and no rain. A gap anywhere else is a problem, and the field's days then have no
    figures. Days without rain readings had none.
    """
    known = F.col("eto").isNotNull()
    inside = weather.join(spans, "field").where(known)
    within = F.col("date").between(F.col("start"), F.col("as_of"))
    state = inside.groupBy("field", "start", "as_of").agg(F.max("date").alias("latest"), F.max(F.when(within, F.col("date"))).alias("last"), F.min(F.when(within, F.col("date"))).alias("first"), F.count_if(within).alias("n"))
    state = spans.join(state, ["field", "start", "as_of"], "left")
    end = F.coalesce("last", "latest")
    late = F.datediff("as_of", end)
    problem = (
        F.when(F.col("last").isNull() & (F.col("latest").isNull() | (F.col("latest") >= F.col("start")) | (late > FILL_MOST)), "no weather")
        .when(F.col("first") > F.col("start"), "starts late").when(F.col("last").isNotNull() & (F.col("n") < F.datediff("last", "start") + 1), "missing days").when(late > FILL_MOST, "ends early")
    )
    state = state.select("field", "start", "as_of", end.alias("end"), F.when(F.col("last").isNotNull(), F.greatest(F.col("start"), F.date_sub(end, FILL_FROM - 1))).otherwise(F.date_sub(end, FILL_FROM - 1)).alias("since"), problem.alias("problem"))
    week = weather.where(known).join(state.where("problem is null"), "field").where(F.col("date").between(F.col("since"), F.col("end"))).groupBy("field").agg(F.avg("eto").alias("usual"))
    days = state.join(week, "field", "left").select("field", "end", "usual", "problem", F.explode(F.sequence("start", "as_of", F.expr("interval 1 day"))).alias("date"))
    rows = days.join(weather.select("field", "date", "eto", "rain"), ["field", "date"], "left")
    fine = F.col("problem").isNull()
    filled = fine & (F.col("date") > F.col("end"))
    return rows.select("field", "date", F.when(filled, F.col("usual")).when(fine, F.col("eto")).alias("eto"), F.when(filled, 0.0).when(fine, F.coalesce("rain", F.lit(0.0))).alias("rain"), filled.alias("filled"), "problem")
