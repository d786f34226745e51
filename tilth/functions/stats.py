"""Robust statistics as expressions and window columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

IQR_TO_SIGMA = 1.349
DAYS = 366


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), in which the value is worked out once, however often it is read.

    The planner writes a struct's fields, and functions over arrays work out what they read, anew at each place.
    """
    return F.get(F.transform(F.array(value), made), F.lit(0))


def number(text: Column, kind: str) -> Column:
    """The number that a text is; NULL for an empty text, without the exception that a cast would raise and catch for each."""
    return once(text, lambda x: F.when(x != "", x.try_cast(kind)))


def circular_distance(a: Column, b: Column, size: int = DAYS) -> Column:
    return F.least(F.abs(a - b), size - F.abs(a - b))


def robust_z(value: Column, median: Column, p25: Column, p75: Column) -> Column:
    """Distance from the median in units of IQR / 1.349; 0 without spread, NULL if anything is missing."""
    spread = (p75 - p25) / IQR_TO_SIGMA
    return F.when(spread <= 0, F.when(value.isNotNull() & median.isNotNull(), 0.0)).otherwise((value - median) / spread)


def mid_rank(below: Column, ties: Column, n: Column) -> Column:
    return F.when(n > 0, 100.0 * (below + 0.5 * ties) / n)


def percentile_over(value: Column, p: float, keys: list[str]) -> Column:
    """An exact percentile of the whole group on each of its rows."""
    return F.percentile(value, F.lit(p)).over(Window.partitionBy(*keys))


def average_rank_percent(value: str, over: list[str]) -> Column:
    """Percentile rank 0-100 with average ties; NULLs take no part."""
    ordered = Window.partitionBy(*over).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*over, value)
    everyone = Window.partitionBy(*over)
    rank = F.rank().over(ordered) + (F.count(value).over(ties) - 1) / 2.0
    return F.when(F.col(value).isNotNull(), 100.0 * rank / F.count(value).over(everyone))


def trailing_run(condition: Column, newest_first: WindowSpec, keys: list[str]) -> tuple[Column, Column]:
    """Row number from the newest, and whether the row is in the final run of TRUE."""
    failed = F.max(F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(1)).over(newest_first.rowsBetween(Window.unboundedPreceding, 0))
    return F.row_number().over(newest_first), failed == 0


def log_factorial(n: Column) -> Column:
    """ln n!, exactly summed to 20 and by Stirling's series above."""
    x = n + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    return F.when(n <= 20, small).otherwise(series)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided Fisher exact test: chance of a or more in [[a, b], [c, d]] with its margins.

    Terms are summed from a, or 12 standard deviations below the mean, to as far above the larger of a and
    the mean; those beyond add less than 1e-17 of the whole, so the sum is as long as the spread, not the counts.
    """
    rows, cols, total = a + b, a + c, a + b + c + d
    fixed = log_factorial(rows) + log_factorial(c + d) + log_factorial(cols) + log_factorial(b + d) - log_factorial(total)
    term = lambda k: F.exp(fixed - log_factorial(k) - log_factorial(rows - k) - log_factorial(cols - k) - log_factorial(total - rows - cols + k))
    mean = rows * cols / total
    reach = F.ceil(12 * F.sqrt(mean * (total - rows) / total * (total - cols) / F.greatest(total - 1, F.lit(1)))) + 60
    first = F.greatest(a, F.floor(mean - reach)).cast("bigint")
    ks = F.sequence(first, F.least(rows, cols, F.ceil(F.greatest(a, mean) + reach)).cast("bigint"))
    return F.least(F.aggregate(ks, F.lit(0.0), lambda s, k: s + term(k)), F.lit(1.0))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fold_accents(text: Column) -> Column:
    """Lower case without the accents of western languages."""
    return F.translate(F.lower(text), "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")
