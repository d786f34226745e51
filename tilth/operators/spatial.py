"""Neighbours, lattices, fits and links of points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.functions.stats import fisher_greater
from tilth.operators.quantiles import beside, exact_quantiles
from tilth.sources.shared import materialize


#: The cells around a cell, itself included.
_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _on_grid(rows: DataFrame, cell: float) -> DataFrame:
    return rows.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))


def _to_cells_around(rows: DataFrame) -> DataFrame:
    """Each row on the grid sent to its cell and the eight around it."""
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _AROUND))
    return rows.withColumn("_k", F.explode(around)).withColumns({"gx": F.col("gx") + F.col("_k.a"), "gy": F.col("gy") + F.col("_k.b")}).drop("_k")


def _places(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Distinct places with their k + 1 least ids: points of one place are equally far from any other, and no more of them can be among k neighbours."""
    first = points.select(*keys, "x", "y", "id", F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy("id")).alias("_rn")).where(F.col("_rn") <= k + 1)
    return materialize(first.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list("id")).alias("ids")))


def _near_places(places: DataFrame, asked: DataFrame, keys: list[str], k: int, cell: float) -> DataFrame:
    """near: the k + 1 nearest points (d, other) of each asked place within one cell's width, those of the place itself included.

    Both sides are merged, as neither is small once it is sent to nine cells: a broadcast would go through the driver.
    """
    right = _on_grid(places, cell).select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"), "ids", "gx", "gy")
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y2"), F.lit(2.0)))
    pairs = _to_cells_around(_on_grid(asked.select(*keys, "x", "y"), cell)).join(right.hint("merge"), [*keys, "gx", "gy"]).select(*keys, "x", "y", "ids", d.alias("d")).where(F.col("d") <= cell)
    # a place behind k + 1 nearer ones has nothing to give
    at = Window.partitionBy(*keys, "x", "y")
    close = pairs.withColumn("_r", F.rank().over(at.orderBy("d"))).where(F.col("_r") <= k + 1)
    one = close.select(*keys, "x", "y", "d", F.explode("ids").alias("other")).withColumn("_r", F.row_number().over(at.orderBy("d", "other"))).where(F.col("_r") <= k + 1)
    return one.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("near"))


def _of_points(points: DataFrame, near: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The neighbours of each point from those of its place, without itself."""
    rows = points.select(*keys, "x", "y", "id").join(near.hint("merge"), [*keys, "x", "y"])
    others = F.slice(F.filter("near", lambda n: n["other"] != F.col("id")), 1, k)
    return rows.select(*keys, "id", F.posexplode(others).alias("_at", "_n")).select(*keys, "id", "_n.other", "_n.d", (F.col("_at") + 1).alias("rank"))


def nearest_within(points: DataFrame, keys: list[str], k: int, cell: float, of: DataFrame | None = None) -> DataFrame:
    """The k nearest other points of each point (id, x, y), or of those given, within one cell's width, by a grid equi-join of distinct places; an id stands once in a key."""
    places = _places(points, keys, k)
    asked = places if of is None else of.select(*keys, "x", "y").distinct()
    return _of_points(points if of is None else of, _near_places(places, asked, keys, k, cell), keys, k)


def nearest(points: DataFrame, keys: list[str], k: int, cell: float) -> DataFrame:
    """The k nearest other points of each point (id, x, y) at any distance, all others where a key has fewer.

    Places that find too few within a cell's width look again on a grid of doubled cells. Points without
    a finite place have no neighbours and are none.
    """
    finite = F.lit(float("inf"))
    points = points.select(*keys, "id", "x", "y").where((F.abs("x") < finite) & (F.abs("y") < finite))
    sizes = points.groupBy(*keys).agg(F.least(F.lit(k + 1), F.countDistinct("id")).alias("_need"))
    places = _places(points, keys, k)
    left = materialize(beside(places.select(*keys, "x", "y"), sizes, keys, few=0).where("_need > 1"))  # few=0: the planner would send places, if their file is small
    out = None
    while not left.isEmpty():
        got = materialize(left.join(_near_places(places, left, keys, k, cell).hint("merge"), [*keys, "x", "y"], "left"))
        done = F.coalesce(F.size("near") >= F.col("_need"), F.lit(False))
        found = got.where(done).select(*keys, "x", "y", "near")
        out = found if out is None else out.union(found)
        left, cell = got.where(~done).select(left.columns), 2 * cell
    return _of_points(points, _near_places(places, left, keys, k, cell) if out is None else out, keys, k)


def _best_in_tasks(queries: pa.Table, rows: DataFrame, k: int, dim: int) -> DataFrame:
    """query, id, d: from each task the k nearest of its rows (id, v) for each query (query, q), and what rounding could put level with them.

    One product of matrices gives squared distances up to its rounding; pairs that these leave possible get theirs
    added in order. Of one distance only the k least ids are kept, so copies don't add up.
    """
    names = queries.column("query").to_numpy()
    points = queries.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), dim)
    sent = rows.sparkSession.sparkContext.broadcast((names, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points = sent.value
        norms = (points * points).sum(axis=1)
        other = np.concatenate([-2 * points, norms[:, None], np.ones((len(points), 1))], axis=1).T.copy()
        bound = np.full(len(names), np.inf)  # a query's k-th distance, and what is rounded to no more
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        step = max(k + 2, (1 << 22) // max(len(names), 1))
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
            for at in range(0, len(ids), step):
                part, own = v[at : at + step], ids[at : at + step]
                square = (part * part).sum(axis=1)
                about = np.concatenate([part, np.ones((len(part), 1)), square[:, None]], axis=1) @ other
                slack = 8 * (dim + 8) * np.finfo(float).eps * (norms + square.max(initial=0.0))
                limit = bound * bound + slack
                if len(part) >= k and np.isinf(bound).any():
                    others = np.where(own[:, None] == names, np.inf, about)
                    limit = np.minimum(limit, (np.sqrt(np.maximum(np.partition(others, k - 1, axis=0)[k - 1], 0.0) + slack) + _LEVEL) ** 2 + slack)
                i, j = np.nonzero(about <= limit)
                i, j = (x[own[i] != names[j]] for x in (i, j))
                total = np.zeros(len(i))
                for c in range(dim):
                    apart = part[i, c] - points[j, c]
                    total += apart * apart
                best = _least(*(np.concatenate(x) for x in zip(best, (j, np.sqrt(total), own[i]), strict=True)), k, bound)
        yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["query", "id", "d"])

    return rows.select("id", "v").mapInArrow(run, "query long, id long, d double")


#: More than rounding to six places moves two distances apart or together.
_LEVEL = 2e-6


def _least(j: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query's place j, distance d, id) those that can be among a query's k first by rounded distance and id; sets the bounds."""

    def place(new: np.ndarray) -> np.ndarray:
        return np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))

    order = np.lexsort((ids, d, j))
    j, d, ids = j[order], d[order], ids[order]
    new = np.ones(len(j), bool)
    new[1:] = (j[1:] != j[:-1]) | (d[1:] != d[:-1])
    kept = place(new) < k
    j, d, ids = j[kept], d[kept], ids[kept]
    new = np.ones(len(j), bool)
    new[1:] = j[1:] != j[:-1]
    last = place(new) == k - 1
    bound[j[last]] = d[last] + _LEVEL
    kept = d <= bound[j]
    return j[kept], d[kept], ids[kept]


def nearest_vectors(queries: DataFrame, rows: DataFrame, k: int, block: int = 16_384) -> DataFrame:
    """The k nearest rows (id, v) of a stated set of query vectors; every pair is looked at.

    Queries are sent to the rows in blocks of about `block`, whatever their number; each task keeps the
    best k of each query before anything is shuffled. Vectors that are null, of another length than most,
    or hold NULLs, NaN or huge numbers are compared by expressions, pair by pair.
    """
    sizes = queries.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    plain = F.coalesce((F.size("v") == dim) & F.forall("v", lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))), F.lit(False)) & F.lit(dim > 0)
    even = queries.where(plain & F.col("id").isNotNull())
    blocks = -(-even.count() // block)
    asked = even.select(F.col("id").cast("long").alias("query"), F.col("v").alias("q"), F.pmod(F.xxhash64("id"), F.lit(max(blocks, 1))).alias("part"))
    order = F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))
    parts = []
    dealt = rows.where(plain & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "v").repartition("id")  # a table in one file is still worked on by many
    for i in range(blocks):
        near = _best_in_tasks(asked.where(F.col("part") == i).select("query", "q").toArrow(), dealt, k, dim)
        parts.append(near.withColumn("d", F.round("d", 6)))
    odd_rows, odd_queries = rows.where(~plain), queries.where(~plain)
    parts += [_by_expression(queries, odd_rows)] if not odd_rows.isEmpty() else []
    parts += [_by_expression(odd_queries, rows.where(plain))] if not odd_queries.isEmpty() else []
    if not parts:
        parts = [_by_expression(queries, rows)]
    best = [p.withColumn("rank", order).where(F.col("rank") <= k) for p in parts]
    if len(best) == 1:
        return best[0]
    return reduce(DataFrame.union, [materialize(b).drop("rank") for b in best]).withColumn("rank", order).where(F.col("rank") <= k)


def _by_expression(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query, id, d of all pairs, in the JVM."""
    d = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = rows.crossJoin(queries.select(F.col("id").alias("query"), F.col("v").alias("q"))).where(F.col("id") != F.col("query"))
    return pairs.select(F.col("query").cast("long").alias("query"), F.col("id").cast("long").alias("id"), F.round(F.sqrt(d), 6).alias("d"))


def empty_positions(points: DataFrame, keys: list[str], step: float, tolerance: float) -> DataFrame:
    """Lattice positions of each group's rectangle without a point within tolerance * step."""
    box = points.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    line = lambda c: F.sequence(F.floor(F.col(f"lo_{c}") / step).cast("long"), F.ceil(F.col(f"hi_{c}") / step).cast("long"))
    lattice = box.select(*keys, F.explode(line("x")).alias("i"), "lo_y", "hi_y").select(*keys, "i", F.explode(line("y")).alias("j"))
    near = points.withColumn("i", F.round(F.col("x") / step).cast("long")).withColumn("j", F.round(F.col("y") / step).cast("long"))
    near = near.where(F.pow(F.col("x") - F.col("i") * step, F.lit(2.0)) + F.pow(F.col("y") - F.col("j") * step, F.lit(2.0)) <= (tolerance * step) ** 2)
    return lattice.join(near.select(*keys, "i", "j").distinct(), [*keys, "i", "j"], "left_anti")


def link(rows: DataFrame, keys: list[str], problem: Column, inside: Column) -> DataFrame:
    """2 x 2 counts, ratio of shares and one-sided Fisher p of problems inside against outside."""
    n = lambda p, i: F.count_if((problem if p else ~problem) & (inside if i else ~inside))
    t = rows.groupBy(*keys).agg(n(1, 1).alias("a"), n(0, 1).alias("b"), n(1, 0).alias("c"), n(0, 0).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    share_in, share_out = a / F.nullif(a + b, F.lit(0)), c / F.nullif(c + d, F.lit(0))
    rows = t.withColumn("ratio", F.when(share_out > 0, F.least(share_in / share_out, F.lit(99.0))).when(share_in > 0, 99.0)).withColumn("p", fisher_greater(a, b, c, d))
    return rows.withColumn("linked", F.coalesce((F.col("ratio") >= 1.5) & (F.col("p") < 0.01) & (F.col("a") >= 10), F.lit(False)))


def plane_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares plane z = a + b x + c y of each key, from centred sums (Cramer's rule)."""
    t = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    b = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / F.nullif(det, F.lit(0.0))
    c = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / F.nullif(det, F.lit(0.0))
    return t.select(*keys, "n", (F.col("mz") - b * F.col("mx") - c * F.col("my")).alias("a"), b.alias("b"), c.alias("c"))


def robust_plane(rows: DataFrame, keys: list[str], rounds: int = 3, cut: float = 3.0) -> DataFrame:
    """Plane fits that leave out residuals beyond cut * 1.4826 * MAD, refitted so many rounds."""
    kept = rows
    for _ in range(rounds - 1):
        fit = plane_sums(kept, keys)
        res = materialize(beside(rows, fit, keys).withColumn("r", F.col("z") - F.col("a") - F.col("b") * F.col("x") - F.col("c") * F.col("y")).select(*rows.columns, "r"))
        med = exact_quantiles(res, keys, "r", [0.5]).select(*keys, F.get("q", F.lit(0)).alias("m"))
        res = materialize(beside(res, med, keys).select(*rows.columns, F.abs(F.col("r") - F.col("m")).alias("e")))
        mad = exact_quantiles(res, keys, "e", [0.5]).select(*keys, (F.get("q", F.lit(0)) * 1.4826).alias("s"))
        kept = materialize(beside(res, mad, keys).where((F.col("e") <= cut * F.col("s")) | (F.col("s") == 0)).select(*rows.columns))
    return plane_sums(kept, keys)


def main_axis(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Direction in degrees of the longest spread of points (x, y), in [0, 180)."""
    t = rows.groupBy(*keys).agg(F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"), F.count("*").alias("n"))
    return t.select(*keys, "n", F.pmod(F.degrees(0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy"))), F.lit(180.0)).alias("axis"))


def circular_phase(rows: DataFrame, keys: list[str], value: str, step: float) -> DataFrame:
    """Mean offset of values on a ring of the given length."""
    turn = F.col(value) * (2 * np.pi / step)
    return rows.groupBy(*keys).agg(F.pmod(F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn))) * (step / (2 * np.pi)), F.lit(step)).alias("phase"))


def greedy_pick(candidates: DataFrame, keys: list[str], n: int, apart: float) -> DataFrame:
    """Best candidates (id, x, y, score) of each key that lie `apart` from all better picks: at most n.

    Rounds instead of one scan in order: a candidate with no better one left nearby is picked, those near
    a pick go, and the rest meet again. The picks are those of the scan; the best n are kept.
    """
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    # of several at one place only the best can be picked: the others are near it, or near what is near it
    best = F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy(F.col("score").desc(), "id"))
    first = candidates.where(finite).withColumn("_rn", best).where("_rn = 1").drop("_rn").union(candidates.where(~F.coalesce(finite, F.lit(False))))
    left = materialize(_on_grid(first, apart))
    picks = None
    while not left.isEmpty():
        other = _to_cells_around(left.select(*keys, F.struct("id", "x", "y", "score").alias("_o"), "gx", "gy"))
        near = F.pow(F.col("x") - F.col("_o.x"), F.lit(2.0)) + F.pow(F.col("y") - F.col("_o.y"), F.lit(2.0)) < apart * apart
        better = (F.col("_o.score") > F.col("score")) | ((F.col("_o.score") == F.col("score")) & (F.col("_o.id") < F.col("id")))
        beaten = left.join(other.hint("merge"), [*keys, "gx", "gy"]).where(near & better).select(*keys, "id").distinct()
        best = materialize(left.join(beaten.hint("merge"), [*keys, "id"], "left_anti"))
        picks = best if picks is None else picks.union(best)
        taken = _to_cells_around(best.select(*keys, F.struct("id", "x", "y").alias("_o"), "gx", "gy"))
        gone = left.join(taken.hint("merge"), [*keys, "gx", "gy"]).where(near).select(*keys, "id").distinct()
        left = materialize(left.join(gone.hint("merge"), [*keys, "id"], "left_anti").join(best.select(*keys, "id").hint("merge"), [*keys, "id"], "left_anti"))
    if picks is None:
        return candidates
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return picks.withColumn("rank", rank).where(F.col("rank") <= n).select(*candidates.columns, "rank")
