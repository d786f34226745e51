"""Exact quantiles of large groups, without a group in one task's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.sources.shared import materialize

#: Groups whose figures are sent whole to the rows; those of more are sent to parts of their group.
FEW_GROUPS = 10_000
#: Parts that the rows of a group are dealt in, beside the figures of many groups.
PARTS = 32

#: Rank error of the sketch as one part in so many; groups up to twice as large are ranked whole.
ACCURACY = 10_000


def beside(rows: DataFrame, figures: DataFrame, keys: list[str], few: int = FEW_GROUPS) -> DataFrame:
    """rows with the figures of their group (one row a group), without a group's rows in one task."""
    figures = materialize(figures)
    if figures.count() <= few:
        return rows.join(F.broadcast(figures), keys)
    parts = figures.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).cast("int"))
    return dealt.join(parts.hint("merge"), [*keys, "_part"]).drop("_part")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """keys and q: exact quantiles (linear between ranks) of each group; NULL and NaN take no part.

    A mergeable sketch brackets each quantile within a few ten-thousandths of the group; the rows below
    the bracket are counted, and only those in it are sorted and ranked.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("v"))
    around = [min(1.0, max(0.0, p + side * 3 / ACCURACY)) for p in probabilities for side in (-1, 1)]
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", around, ACCURACY).alias("b"))
    count = len(probabilities)
    small = F.col("n") <= 2 * ACCURACY
    lo = lambda i: F.when(small, float("-inf")).otherwise(F.get("b", F.lit(2 * i)))
    hi = lambda i: F.when(small, float("inf")).otherwise(F.get("b", F.lit(2 * i + 1)))
    judged = beside(rows, bounds, keys)
    below = judged.groupBy(*keys, "n").agg(*(F.count_if(F.col("v") < lo(i)).alias(f"below{i}") for i in range(count)))
    inside = F.array_compact(F.array(*(F.when(F.col("v").between(lo(i), hi(i)), i) for i in range(count))))
    values = judged.select(*keys, "v", F.explode(inside).alias("i")).groupBy(*keys, "i", "v").agg(F.count("*").alias("w"))
    upto = F.sum("w").over(Window.partitionBy(*keys, "i").orderBy("v"))
    start = F.get(F.array(*(f"below{i}" for i in range(count))), F.col("i"))
    ranked = values.withColumn("upto", upto).join(below, keys).withColumn("upto", F.col("upto") + start)
    place = F.get(F.array(*map(F.lit, map(float, probabilities))), F.col("i")) * (F.col("n") - 1)
    at = ranked.groupBy(*keys, "i", "n").agg(F.min(F.when(F.col("upto") > F.floor(place), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil(place), F.col("v"))).alias("z"))
    between = F.col("a") + (F.col("z") - F.col("a")) * (place - F.floor(place))
    return at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))), lambda x: x["q"]).alias("q"))
