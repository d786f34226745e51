"""Ordered data: gaps, runs, spines, interpolation, running statistics, intervals, sessions."""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(rows: DataFrame, keys: list[str], date: str, least_days: int = 30) -> DataFrame:
    """Pairs of neighbouring dates at least so many days apart."""
    before = F.lag(date).over(Window.partitionBy(*keys).orderBy(date))
    return rows.select(*keys, date).distinct().select(*keys, before.alias("gap_start"), F.col(date).alias("gap_end")).withColumn("days", F.datediff("gap_end", "gap_start")).where(F.col("days") >= least_days)


def islands(rows: DataFrame, keys: list[str], position: str, condition: Column) -> DataFrame:
    """Runs of neighbouring positions (whole numbers, one row each) where the condition holds."""
    hit = rows.where(condition)
    run = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return hit.withColumn("run", run).groupBy(*keys, "run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length")).drop("run")


def trailing_runs(rows: DataFrame, keys: list[str], order: list[str], condition: Column) -> DataFrame:
    """Length of the final run of TRUE of each key."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(1)).over(newest)
    return rows.select(*keys, (broken == 0).alias("in_run")).groupBy(*keys).agg(F.count_if("in_run").alias("run"), F.count("*").alias("n"))


def spine(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Every day from the first to the last of each key."""
    ends = rows.groupBy(*keys).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(date))


def fill_spine(rows: DataFrame, keys: list[str], date: str, columns: list[str]) -> DataFrame:
    """Daily rows with the last known values carried forward, and whether a day was filled."""
    order = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    joined = spine(rows, keys, date).join(rows.withColumn("_have", F.lit(True)), [*keys, date], "left")
    return joined.select(*keys, date, *(F.last(c, ignorenulls=True).over(order).alias(c) for c in columns), F.col("_have").isNull().alias("filled"))


def interpolate(rows: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Daily values, linear between known days and flat beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(date)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(date))
    both = spine(rows, keys, date).join(rows.select(*keys, date, value), [*keys, date], "left").select(
        *keys, date, F.last(value, True).over(back).alias("v0"), F.last(known, True).over(back).alias("d0"), F.first(value, True).over(ahead).alias("v1"), F.first(known, True).over(ahead).alias("d1")
    )
    share = F.datediff(date, "d0") / F.nullif(F.datediff("d1", "d0"), F.lit(0))
    return both.select(*keys, date, F.coalesce(F.col("v0") + (F.col("v1") - F.col("v0")) * F.coalesce(share, F.lit(0.0)), "v0", "v1").alias(value))


#: Widths of the window in one block of a running median.
BLOCK_WINDOWS = 8


def running_median(rows: DataFrame, keys: list[str], seconds: str, value: str, half_window: int) -> DataFrame:
    """Median of all values of the key within the window of each row (id: once in a key); rows without a key or a time have none.

    Time is cut into blocks of several windows; a row is sent to its block and to the next one where that sees it.
    A block is worked through in order of time with the window's values kept sorted, so no pair of rows is
    ever written.
    """
    wide = BLOCK_WINDOWS * half_window
    block = lambda s: F.floor(s / wide)
    s = F.col(seconds)
    placed = rows.where(reduce(Column.__and__, (c.isNotNull() for c in (s, *map(F.col, keys))))).select(*keys, "id", s.alias("s"), F.col(value).cast("double").alias("v"), F.col(value).isNotNull().alias("some"), block(s).alias("own"))
    sent = placed.withColumn("block", F.explode(F.sequence(block(F.col("s") - half_window), block(F.col("s") + half_window))))

    def slide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("s", kind="stable")
        at, some = part["s"].to_numpy(), part["some"].to_numpy(bool)
        # values by their rank: NaN is the largest, as in SQL
        ordered, rank = np.unique(part["v"].to_numpy(np.float64), return_inverse=True)
        rank = rank.tolist()
        first, last = np.searchsorted(at, at - half_window, "left"), np.searchsorted(at, at + half_window, "right")
        asked = np.flatnonzero(part["own"].to_numpy() == part["block"].to_numpy())
        medians, window, lo, hi = np.full(len(asked), np.nan), [], 0, 0
        known = np.zeros(len(asked), bool)
        for i, row in enumerate(asked):
            while hi < last[row]:
                if some[hi]:
                    insort(window, rank[hi])
                hi += 1
            while lo < first[row]:
                if some[lo]:
                    del window[bisect_left(window, rank[lo])]
                lo += 1
            if n := len(window):
                a, b = ordered[window[(n - 1) // 2]], ordered[window[n // 2]]
                medians[i], known[i] = a if a == b else 0.5 * a + 0.5 * b, True
        kept = part.iloc[asked]
        return pd.DataFrame({**{k: kept[k] for k in keys}, "id": kept["id"], "median": medians, "known": known, "n": last[asked] - first[asked]})

    kinds = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in (*keys, "id"))
    got = sent.groupBy(*keys, "block").applyInPandas(slide, f"{kinds}, median double, known boolean, n long")
    # a NaN comes back from pandas as NULL
    return got.select(*keys, "id", F.when(F.col("known"), F.coalesce("median", F.lit(float("nan")))).alias("median"), "n")


def crossings(rows: DataFrame, keys: list[str], order: str, amount: str, needs: list[tuple[str, float]], last_rows: int = 14) -> DataFrame:
    """First day on which the running sum reaches each need, else a projection by the mean of the last rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    summed = rows.select(*keys, order, amount, F.sum(amount).over(w).alias("total"), F.row_number().over(newest).alias("rn"))
    totals = summed.groupBy(*keys).agg(F.max_by("total", order).alias("total"), F.max(order).alias("last"), F.avg(F.when(F.col("rn") <= last_rows, F.col(amount))).alias("rate"), *(F.min(F.when(F.col("total") >= need, F.col(order))).alias(f"n{i}") for i, (_, need) in enumerate(needs)))
    marks = F.array(*(F.struct(F.lit(name).alias("stage"), F.lit(need).alias("need"), F.col(f"n{i}").alias("reached")) for i, (name, need) in enumerate(needs)))
    rows = totals.select(*keys, "total", "last", "rate", F.explode(marks).alias("m")).select(*keys, "total", "last", "rate", "m.*")
    ahead = F.when(F.col("rate") > 0, F.date_add("last", F.ceil((F.col("need") - F.col("total")) / F.col("rate")).cast("int")))
    return rows.select(*keys, "stage", "need", "total", F.col("reached").isNotNull().alias("reached"), F.coalesce("reached", ahead).alias("date"))


def holding_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, bin_width: float) -> DataFrame:
    """The first interval (seq, start, end) holding each point, NULL for a point in none.

    An equi-join by bins: an interval is sent to each bin it touches.
    """
    spread = intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width))))
    p = points.withColumn("bin", F.floor(F.col(at) / bin_width))
    held = p.join(spread, [*keys, "bin"]).where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end"))).groupBy(*keys, "point").agg(F.min_by("seq", "seq").alias("held"))
    return points.join(held, [*keys, "point"], "left")


def interval_or_nearest(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, bin_width: float) -> DataFrame:
    """The first interval (seq, start, end) holding each point, else the one with the nearest middle, however far.

    The nearest middles before and after a point come from its own bin in order of time or, where that
    has none, from the nearest bins that have: only bins, not rows, are ordered over a whole key. Of
    equally near middles the first interval counts. NULL is left for keys without intervals and for
    points without a time.
    """
    found = holding_interval(points, intervals, keys, at, bin_width)
    middles = intervals.select(*keys, ((F.col("start") + F.col("end")) / 2).alias("m"), "seq").where("m is not null").groupBy(*keys, "m").agg(F.min("seq").alias("seq"))
    alone = found.where(F.col("held").isNull() & F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("t"), "point")
    is_middle = F.col("_is_middle")
    rows = middles.select(*keys, F.col("m").cast("double").alias("t"), F.struct(F.col("m").cast("double").alias("m"), "seq").alias("_mid"), F.lit(True).alias("_is_middle")).unionByName(alone.withColumn("_is_middle", F.lit(False)), allowMissingColumns=True).withColumn("bin", F.floor(F.col("t") / bin_width))
    here = Window.partitionBy(*keys, "bin").orderBy("t", is_middle.desc())
    near = rows.select(
        *keys, "bin", "t", "point", "_is_middle", F.last("_mid", True).over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("back"), F.first("_mid", True).over(here.rowsBetween(0, Window.unboundedFollowing)).alias("ahead")
    ).where(~is_middle)
    order = Window.partitionBy(*keys).orderBy("bin")
    bins = rows.groupBy(*keys, "bin").agg(F.min("_mid").alias("lo"), F.max("_mid").alias("hi"))
    bins = bins.select(*keys, "bin", F.last("hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    sides = F.array(F.coalesce("back", "before"), F.coalesce("ahead", "after"))
    best = F.array_min(F.transform(F.filter(sides, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(F.col("t") - x["m"]).alias("d"), x["seq"].alias("seq"))))
    nearest = near.join(bins, [*keys, "bin"]).select(*keys, "point", best.alias("_best")).groupBy(*keys, "point").agg(F.min("_best").alias("_best"))
    return found.join(nearest, [*keys, "point"], "left").withColumn("held", F.coalesce("held", "_best.seq")).drop("_best")


def sessions(rows: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Sessions closed by a silence longer than the gap."""
    w = Window.partitionBy(*keys).orderBy(ts, "event_id")
    new = F.when(F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w)) <= gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def covered_bytes(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Whether pieces (start, length) cover each key's whole (total) without a gap."""
    w = Window.partitionBy(*keys).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("start") > F.coalesce(F.max(F.col("start") + F.col("length")).over(w), F.lit(0))
    return pieces.select(*keys, "total", gap.alias("gap"), (F.col("start") + F.col("length")).alias("end")).groupBy(*keys).agg((~F.bool_or("gap") & (F.max("end") >= F.max("total"))).alias("complete"), F.max("end").alias("reached"))
