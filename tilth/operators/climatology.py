"""Day-of-year climatology, season scoring and triage.

Observations have the columns of `keys`, `date`, `doy`, `year`, `value`. The year is a ring of 366 days.
The band join of days within a window is an equi-join: each observation is sent to the days that see it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.functions.stats import DAYS, mid_rank, robust_z

WINDOW, SMOOTH = 12, 15
STATISTICS, PROBABILITIES = ("p10", "p25", "median", "p75", "p90"), (0.10, 0.25, 0.50, 0.75, 0.90)
FLAG_RUN, SUSTAINED_RUN, SUSTAINED_SHORTFALL, SHORTFALL_FLOOR, SEVERITY_CLIP, PERSISTENCE_CLIP = 2, 6, 0.10, 0.2, 0.4, 4
NDVI_WEIGHT, NDMI_WEIGHT = 0.75, 0.25


def spread_to_days(history: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each observation and day of the year within the window of it (day column: target)."""
    return history.withColumn("target", F.explode(F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(DAYS)) + 1)))


def confidence(n_obs: Column, n_years: Column) -> Column:
    return F.when((n_obs >= 6) & (n_years >= 3), "high").when((n_obs >= 3) & (n_years >= 2), "medium").when(n_obs >= 1, "low").otherwise("none")


def climatology(history: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """Percentiles, counts and years of each key and each of the 366 days; days without data have NULLs and zeros."""
    history = history.where(F.col("value").isNotNull() & ~F.isnan("value"))
    # equal values of a day and year are one row with a weight, before they are multiplied by the window
    weighed = history.groupBy(*keys, "doy", "year", "value").agg(F.count("*").alias("w"))
    # a quantile is read off running counts of sorted rows, so a key of any size is sorted on disk, not held
    order = Window.partitionBy(*keys, "target").orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = spread_to_days(weighed, window).select(*keys, "target", "year", "value", F.sum("w").over(upto).alias("upto"), F.sum("w").over(whole).alias("n"))
    at = [p * (F.col("n") - 1) for p in PROBABILITIES]
    beyond = lambda place: F.min(F.when(F.col("upto") > place, F.col("value")))
    stats = ranked.groupBy(*keys, F.col("target").alias("doy")).agg(
        F.max("n").alias("n_obs"), F.size(F.collect_set("year")).cast("long").alias("n_years"), *(beyond(F.floor(x)).alias(f"lo{i}") for i, x in enumerate(at)), *(beyond(F.ceil(x)).alias(f"hi{i}") for i, x in enumerate(at))
    )
    between = [(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (p * (F.col("n_obs") - 1) - F.floor(p * (F.col("n_obs") - 1)))).alias(s) for i, (p, s) in enumerate(zip(PROBABILITIES, STATISTICS, strict=True))]
    spine = history.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(DAYS))).alias("doy"))
    # both have up to 366 rows a key, which the planner does not see: merged, as a broadcast would go through the driver
    rows = spine.join(stats.hint("merge"), [*keys, "doy"], "left")
    return rows.select(*keys, "doy", *between, F.coalesce("n_obs", F.lit(0)).alias("n_obs"), F.coalesce("n_years", F.lit(0)).alias("n_years"))


def smooth_ring(rows: DataFrame, keys: list[str], columns: list[str], width: int = SMOOTH) -> DataFrame:
    """Centred means over a ring of days, NULLs left out."""
    before, after = width // 2, (width - 1) // 2
    ring = rows.withColumn("turn", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("at", F.col("doy") + F.col("turn") * DAYS)
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(-before, after)
    return ring.select("*", *(F.avg(c).over(w).alias(f"{c}_s") for c in columns)).where("turn = 0").drop("turn", "at")


def smoothed(raw: DataFrame, keys: list[str], width: int = SMOOTH) -> DataFrame:
    """Smoothed statistics, whether a day was filled, and its confidence from the plain counts."""
    out = smooth_ring(raw, keys, list(STATISTICS), width)
    return out.select(*keys, "doy", *(F.col(f"{s}_s").alias(s) for s in STATISTICS), "n_obs", "n_years", (F.col("median").isNull() & F.col("median_s").isNotNull()).cast("int").alias("interpolated"), confidence(F.col("n_obs"), F.col("n_years")).alias("confidence"))


def thin_stretches(baseline: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Runs of `least` days or more without high confidence: first and last day and the worst grade."""
    order = Window.partitionBy(*keys).orderBy("doy")
    weak = baseline.withColumn("rn", F.row_number().over(order)).where("confidence != 'high'")
    runs = weak.withColumn("run", F.col("rn") - F.row_number().over(order))
    grade = F.when(F.col("confidence") == "none", 0).when(F.col("confidence") == "low", 1).otherwise(2)
    out = runs.groupBy(*keys, "run").agg(F.min("doy").alias("first_doy"), F.max("doy").alias("last_doy"), F.count("*").alias("days"), F.min(grade).alias("g"))
    return out.where(F.col("days") >= least).select(*keys, "first_doy", "last_doy", "days", F.element_at(F.array(F.lit("none"), F.lit("low"), F.lit("medium")), F.col("g") + 1).alias("worst"))


def score_observations(season: DataFrame, baseline: DataFrame, history: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """Each season observation (with all its columns) against its day: below p10, robust z and mid-rank percentile in the day's pool.

    A season is a small part of its history, so each of its observations is sent to the days of its pool, where its rank is a
    running count over the day's sorted values; the ranks of the days add up to that in the pool. History is not multiplied.
    """
    counts = history.where(F.col("value").isNotNull()).groupBy(*keys, F.col("doy").alias("target"), "value").agg(F.count("*").alias("w"))
    asked = spread_to_days(season.where(F.col("value").isNotNull()).select(*keys, "doy", "value").distinct(), window)
    both = counts.select(*keys, "target", "value", "w", F.lit(None).cast("int").alias("doy")).union(asked.select(*keys, "target", "value", F.lit(0).cast("long").alias("w"), F.col("doy").cast("int")))
    order = Window.partitionBy(*keys, "target").orderBy("value")
    upto, ties = (F.sum("w").over(order.rangeBetween(start, Window.currentRow)) for start in (Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    running = both.select(*keys, "doy", "value", upto.alias("upto"), ties.alias("ties"), whole.alias("n")).where("doy is not null")
    ranked = running.groupBy(*keys, "doy", "value").agg(F.sum(F.col("upto") - F.col("ties")).alias("below"), F.sum("ties").alias("ties"), F.sum("n").alias("n")).where("n > 0")
    rows = season.join(baseline.select(*keys, "doy", "p10", "p25", "median", "p75", "confidence"), [*keys, "doy"], "left").join(ranked, [*keys, "doy", "value"], "left")
    return rows.select(
        *season.columns, "median", "p10", mid_rank(F.col("below"), F.col("ties"), F.col("n")).alias("percentile"),
        robust_z(F.col("value"), F.col("median"), F.col("p25"), F.col("p75")).alias("z"), F.coalesce(F.col("value") < F.col("p10"), F.lit(False)).alias("below_p10"), "confidence",
    )


def index_terms(scores: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key: the final runs, shortfall, sustained trigger and term of one index."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    low = F.max(F.when(F.col("below_p10"), 0).otherwise(1)).over(newest) == 0
    depressed = F.max(F.when(F.coalesce(F.col("z") < 0, F.lit(False)), 0).otherwise(1)).over(newest) == 0
    short = (F.col("median") - F.col("value")) / F.greatest(F.abs("median"), F.lit(SHORTFALL_FLOOR))
    rows = scores.select(*keys, *order, "confidence", low.alias("low"), depressed.alias("dep"), short.alias("short"))
    out = rows.groupBy(*keys).agg(
        F.count_if("low").alias("low_run"), F.count_if("dep").alias("depressed_run"), F.coalesce(F.percentile(F.when(F.col("dep"), F.col("short")), F.lit(0.5)), F.lit(0.0)).alias("shortfall"),
        F.max_by("confidence", F.struct(*order)).alias("confidence"), F.max(F.struct(*order)).alias("last"), F.count("*").alias("n_observations"),
    )
    sustained = (F.col("depressed_run") >= SUSTAINED_RUN) & (F.col("shortfall") >= SUSTAINED_SHORTFALL)
    severity = F.least(F.greatest(F.col("shortfall"), F.lit(0.0)), F.lit(SEVERITY_CLIP)) / SEVERITY_CLIP
    persistence = F.least(F.greatest(F.col("low_run"), F.when(sustained, F.col("depressed_run")).otherwise(0)), F.lit(PERSISTENCE_CLIP)) / PERSISTENCE_CLIP
    return out.select("*", sustained.alias("sustained"), F.when(F.col("depressed_run") == 0, 0.0).otherwise((severity + persistence) / 2).alias("term"))


def field_scores(terms: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Stress score, flag, trigger and water stress of each key from the terms of its two indices (0 and 1 in the column `index`)."""
    own = [c for c in terms.columns if c not in (*keys, index)]
    of = lambda i, columns: F.max(F.when(F.col(index) == i, F.struct(*columns)))
    other = [F.col("term").alias("ndmi_term"), F.col("low_run").alias("ndmi_run"), F.col("sustained").alias("ndmi_sustained")]
    rows = terms.groupBy(*keys).agg(of(0, own).alias("a"), of(1, other).alias("b")).where("a is not null").select(*keys, "a.*", "b.*")
    weight = F.when(F.col("confidence") == "high", 1.0).when(F.col("confidence") == "medium", 0.85).when(F.col("confidence") == "low", 0.6).otherwise(0.0)
    score = 100 * (NDVI_WEIGHT * F.col("term") + NDMI_WEIGHT * F.coalesce("ndmi_term", F.lit(0.0))) * weight
    flagged = (F.col("low_run") >= FLAG_RUN) | F.col("sustained")
    water = flagged & (F.coalesce(F.col("ndmi_run") > 0, F.lit(False)) | F.coalesce("ndmi_sustained", F.lit(False)))
    return rows.select(
        *keys, F.round(score, 1).alias("score"), flagged.alias("flagged"), water.alias("water_stress"), F.col("low_run").alias("n_low"), F.col("depressed_run").alias("n_depressed"),
        F.when(F.col("low_run") >= FLAG_RUN, "p10-run").when(F.col("sustained"), "sustained").otherwise("").alias("trigger"), F.col("shortfall").alias("shortfall"), "confidence", "n_observations",
    )


def rank_fields(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Worst first: flagged, score, run, key. The rows are one for each field, so one sort orders them."""
    return scores.orderBy(F.col("flagged").desc(), F.col("score").desc(), F.col("n_low").desc(), *keys)
