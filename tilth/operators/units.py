"""Verdicts on measured units (plants, row segments, squares) against their group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.functions.stats import IQR_TO_SIGMA, percentile_over

#: Thresholds of the verdicts (fixed values).
STRESSED_QUANTILE, MIN_SHORTFALL, MIN_Z, DEAD_Z, DEAD_COLOUR, DEAD_SIZE, MISSING_COVER, EDGE_AREA, MIN_GROUP = 0.15, 0.20, -1.5, -3.0, 0.25, 0.10, 0.70, 0.75, 8


def with_group_statistics(units: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Median, 15 % quantile and robust z of the given columns within each group.

    The statistics are one row for each group and are joined back, so a large group is never sorted whole.
    """
    stats = units.groupBy(*keys).agg(*(F.percentile(c, F.array(*map(F.lit, (STRESSED_QUANTILE, 0.25, 0.5, 0.75)))).alias(f"_{c}") for c in columns), F.count("*").alias("group_size"))
    rows = units.join(stats, keys)
    for c in columns:
        q = [F.get(f"_{c}", F.lit(i)) for i in range(4)]
        spread = (q[3] - q[1]) / IQR_TO_SIGMA
        rows = rows.withColumn(f"{c}_cut", q[0]).withColumn(f"{c}_median", q[2]).withColumn(f"{c}_z", F.when(spread <= 0, 0.0).otherwise((F.col(c) - q[2]) / spread)).drop(f"_{c}")
    return rows


def verdict(size: str, colour: str, cover: str, area: str, rows_method: bool = True) -> Column:
    """NO_DATA, EDGE, MISSING, DEAD, STRESSED or HEALTHY of a unit with its group's statistics."""
    weak = lambda c: (F.col(c) < F.col(f"{c}_cut")) & (F.col(c) < (1 - MIN_SHORTFALL) * F.col(f"{c}_median")) & (F.col(f"{c}_z") < MIN_Z)
    colour_dead = (F.col(f"{colour}_z") < DEAD_Z) & ((F.col(f"{colour}_median") <= 0) | (F.col(colour) < DEAD_COLOUR * F.col(f"{colour}_median")))
    out = F.when(F.col(size).isNull(), "NO_DATA")
    if rows_method:
        out = out.when(F.col(area) < EDGE_AREA * F.col(f"{area}_median"), "EDGE").when(F.col(cover) < MISSING_COVER * F.col(f"{cover}_median"), "MISSING")
    return out.when(F.col(size) < DEAD_SIZE * F.col(f"{size}_median"), "DEAD").when(colour_dead, "DEAD").when(weak(size) | weak(colour), "STRESSED").otherwise("HEALTHY")


def classify(units: DataFrame, keys: list[str], size: str, colour: str, cover: str, area: str) -> DataFrame:
    """Units with their flag; groups too small to judge are healthy where they have data."""
    columns = list(dict.fromkeys([size, colour, cover, area]))
    rows = with_group_statistics(units, keys, columns)
    return rows.withColumn("flag", F.when(F.col("group_size") < MIN_GROUP, F.when(F.col(size).isNull(), "NO_DATA").otherwise("HEALTHY")).otherwise(verdict(size, colour, cover, area)))


def block_summary(flagged: DataFrame, keys: list[str], volume: str) -> DataFrame:
    """Counts and shares of judged units in each block."""
    n = lambda f: F.count_if(F.col("flag") == f)
    out = flagged.groupBy(*keys).agg(F.count("*").alias("n_units"), *(n(f.upper()).alias(f"n_{f}") for f in ("healthy", "stressed", "dead", "missing")), F.count_if(F.col("flag").isin("EDGE", "NO_DATA")).alias("n_not_assessed"), F.percentile(volume, F.lit(0.5)).alias("median_volume"))
    judged = F.col("n_units") - F.col("n_not_assessed")
    share = lambda *cs: F.when(judged > 0, sum((F.col(f"n_{c}") for c in cs), F.lit(0)) / judged)
    return out.select("*", judged.alias("n_judged"), share("stressed").alias("share_stressed"), share("dead").alias("share_dead"), share("missing").alias("share_missing"), share("stressed", "dead", "missing").alias("share_problem"))


def relative_to_group(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Ratio to the size of the group's median."""
    return rows.withColumn("relative", F.col(column) / (F.abs(percentile_over(F.col(column), 0.5, keys)) + 1e-6))


def number_within(rows: DataFrame, keys: list[str], order: list[Column], prefix: Column) -> DataFrame:
    """Labels such as H1, H2 by rank within each group."""
    return rows.withColumn("label", F.concat(prefix, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")))
