"""Operator 12: near copies of embeddings by spherical k-means cells and blocked cosine products.

Centres of cells are fitted by spherical k-means on a sample of about SAMPLE vectors a cell, taken by their
hash; every vector goes to the cell of its most alike centre, its home. No link is lost at the borders: two
vectors of different homes within an angle t have the plane between the two centres between them, so one
of them lies within t / 2 of it, and that one visits the other's cell.

The vectors within t / 2 of a centre, its core, are all linked with each other, so a large group of near copies
is counted without comparing it; with others than the core only vectors within 3 t / 2 of the centre (the
shell) can be linked. Of a cell the vectors at home outside of the core are compared with each other and with
the visitors, and the core with the shell, in blocks of bounded bytes: a task gets two blocks, however large the
cell. It gives for each vector the number of vectors linked with it and one edge to the smallest of its part of
the graph; pairs are not given out. A pair that meets in both cells counts in the lower one.

Equal vectors are one class, whose members are linked. Cosines are doubles; those within 1e-12 of the
threshold are taken again from the plain sums of products, so that they do not depend on the blocks.

Vectors that are null, zero or hold null or non-finite components have no links. Vectors of different lengths
are compared as if filled up with zeros. Null vec_ids count as the smallest id and are shown as null. Rows that
repeat a vec_id are vectors of their own, linked as others are, with one component for all rows of the id.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import materialize, mix, release, signed, table
from tilth.llm.jaccard_join import components
from tilth.llm.vectors import finite, from_binary, padded

THRESHOLD = 0.95
#: Cells: an eighth of the square root of the number of classes, and bounded by the bytes of their centres.
MAX_CELLS, CENTRE_BYTES = 4096, 1 << 24
#: Vectors a cell in the sample, and rounds, from which centres are fitted.
SAMPLE, ROUNDS = 64, 4
#: Bytes of a block's vectors as doubles, and most of its vectors.
BLOCK_BYTES, BLOCK = 1 << 24, 1 << 14
#: Vectors given to their cells, and cosines taken, at a time.
_STEP, _AT_ONCE = 2048, 1 << 21
_NULL_ID = -(1 << 63)
_SLACK = 1e-9
_OUTER, _CORE, _VISITOR = 0, 1, 2


def hashed(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """doc, vector (its components as bytes) and h1, h2 (hash of it, null where it has no direction) for rows (doc, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, length, values = finite(batch.column("embedding"))
            row, place = np.repeat(np.arange(len(length)), length), np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)
            told = values != 0  # zeros, also those that fill up, tell nothing
            bits = mix((values + 0.0).view(np.uint64) ^ mix(place.astype(np.uint64)))
            sums = np.zeros((2, len(length)), np.uint64)
            for i in (0, 1):
                np.add.at(sums[i], row[told], mix(bits[told] + np.uint64(i + 1)))
            some = np.bincount(row[told], minlength=len(length)) > 0
            at = np.full(len(batch), -1, np.int64)
            at[np.flatnonzero(good)[some]] = np.flatnonzero(some)
            pick = pa.array(at, mask=at < 0)
            raw, size = values.astype(kind).tobytes(), length * kind.itemsize
            vectors = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), vectors.cast(pa.binary()).take(pick), *(signed(s).take(pick) for s in sums)], names=["doc", "vector", "h1", "h2"])

    return rows.mapInArrow(run, "doc long, vector binary, h1 long, h2 long")


def directions(array: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """Vectors as unit rows."""
    x = from_binary(array, kind, width)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(classes: DataFrame, cells: int, n: int, kind: np.dtype, width: int) -> np.ndarray:
    """Unit rows, fitted by spherical k-means on the sample."""
    sample = materialize(classes.where(F.pmod("h1", F.lit(max(1, n // (SAMPLE * cells)))) == 0).select("h1", "h2", "vector"))
    first = sample.orderBy("h1", "h2").limit(cells).toArrow()
    if len(first) < cells:
        first = classes.orderBy("h1", "h2").select("h1", "h2", "vector").limit(cells).toArrow()
    middle = directions(first["vector"].combine_chunks(), kind, width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(middle.shape)
        for batch in batches:
            x = directions(batch.column("vector"), kind, width)
            np.add.at(total, (x @ middle.T).argmax(1), x)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([row.tobytes() for row in total[used]], pa.binary())], names=["cell", "s"])

    def summed(part: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(s) for s in part["s"].to_pylist()], axis=0)
        return pa.table({"cell": part["cell"].slice(0, 1), "s": pa.array([whole.tobytes()], pa.binary())})

    for _ in range(ROUNDS):
        new = sample.select("vector").mapInArrow(sums, "cell long, s binary").groupBy("cell").applyInArrow(summed, "cell long, s binary").toArrow()
        whole = np.array([np.frombuffer(s) for s in new["s"].to_pylist()]).reshape(-1, width)
        long = np.sqrt((whole * whole).sum(1))
        some = long > _SLACK
        middle = middle.copy()
        middle[new["cell"].to_numpy()[some]] = whole[some] / long[some, None]
    release(sample)
    return middle


def placed(classes: DataFrame, middle: np.ndarray, angle: float, kind: np.dtype) -> DataFrame:
    """A row for each class and each cell where it is at home or visits: cell, home, visits (other cells; of visitors none), role, shell, rep, m, vector."""
    width = middle.shape[1]
    names = ["cell", "home", "visits", "role", "shell", "rep", "m", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = (middle * middle).sum(1)
        apart = np.sqrt(np.maximum(0, norm[:, None] - 2 * middle @ middle.T + norm))
        for whole in batches:
            for a in range(0, len(whole), _STEP):
                batch = whole.slice(a, _STEP)
                n = len(batch)
                cos = directions(batch.column("vector"), kind, width) @ middle.T
                home = cos.argmax(1)
                own = cos[np.arange(n), home]
                near = own[:, None] - cos <= (math.sin(angle / 2) + _SLACK) * apart[home] + 1e-12
                near[np.arange(n), home] = False
                row, cell = np.nonzero(near)
                ends = np.append(0, np.cumsum(near.sum(1)))
                visits = pa.ListArray.from_arrays(pa.array(np.append(ends, np.full(len(row), ends[-1])), pa.int32()), pa.array(cell, pa.int32()))
                core = own >= math.cos(angle / 2) + _SLACK
                at = np.concatenate([np.arange(n), row])
                cells = np.concatenate([home, cell])
                role = np.concatenate([np.where(core, _CORE, _OUTER), np.full(len(row), _VISITOR)])
                shell = (cos[at, cells] >= math.cos(1.5 * angle) - _SLACK) & (role != _CORE)
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(home[at], pa.int32()), visits, pa.array(role, pa.int32()), pa.array(shell), *(batch.column(c).take(pick) for c in names[5:])], names=names)

    return classes.select("rep", "m", "vector").mapInArrow(run, "cell int, home int, visits array<int>, role int, shell boolean, rep long, m long, vector binary")


def units(rows: DataFrame, cells: DataFrame, block: int) -> DataFrame:
    """placed() rows with the tasks that they go to: kind (0: at home outside of the core, 1: core and shell, 2: at home and visitors), i, j (blocks) and side."""
    kinds = ("outer", "core", "visitor", "shell")
    blocks = [F.ceil(F.col(c) / block).cast("int").alias(f"{c}_blocks") for c in kinds]
    sized = rows.join(F.broadcast(cells.select("cell", *blocks)), "cell")  # at most MAX_CELLS rows
    own = lambda c: F.pmod(F.xxhash64("rep"), F.greatest(F.col(f"{c}_blocks"), F.lit(1))).cast("int")
    unit = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    each = lambda c, f: F.when(F.col(f"{c}_blocks") > 0, F.transform(F.sequence(F.lit(0), F.col(f"{c}_blocks") - 1), f)).otherwise(F.array())
    first, second = F.lit(0), F.lit(1)
    home = F.concat(
        each("outer", lambda j: unit(0, F.least(own("outer"), j), F.greatest(own("outer"), j), own("outer") > j)),
        each("visitor", lambda j: unit(2, own("outer"), j, first)),
    )
    visitor = each("outer", lambda i: unit(2, i, own("visitor"), second))
    core = each("shell", lambda j: unit(1, own("core"), j, first))
    shell = each("core", lambda i: unit(1, i, own("shell"), second))
    to = F.when(F.col("role") == _CORE, core).when(F.col("role") == _OUTER, home).otherwise(visitor)
    return sized.withColumn("unit", F.explode(F.when(F.col("shell"), F.concat(to, shell)).otherwise(to))).select(*rows.columns, "unit.*")


def join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that edges reach from each place, after those that gave `label`."""
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        for ends in (a, b):
            np.minimum.at(after, label[ends], low)
            np.minimum.at(after, ends, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def compared(tasks: DataFrame, threshold: float, kind: np.dtype, width: int) -> DataFrame:
    """rep, links (vectors linked with it) and low (smallest rep of its part of the graph) by task."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("rep").combine_chunks()
        get = lambda c: part[c].to_numpy()
        side, role, home, m, rep = get("side"), get("role"), get("home"), get("m"), get("rep")
        cell, same = int(part["cell"][0].as_py()), part["kind"][0].as_py() == 0 and part["i"][0] == part["j"][0]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == int(not same))
        none = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        if not len(first) or not len(second):
            return none
        vector = part["vector"].combine_chunks()
        vector = vector if isinstance(vector, pa.Array) else vector.chunk(0)
        x = directions(vector, kind, width)
        visits = part["visits"].combine_chunks()
        visits = visits if isinstance(visits, pa.Array) else visits.chunk(0)
        cells = 1 + max(int(home.max()), int(visits.flatten().to_numpy().max(initial=0)))
        seen = np.repeat(np.arange(len(x)), visits.value_lengths().to_numpy()) * cells + visits.flatten().to_numpy()
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        step = max(1, _AT_ONCE // len(second))
        for at in range(0, len(first), step):
            cos = x[first[at : at + step]] @ x[second].T
            a, b = np.nonzero(cos >= threshold - 1e-12)
            value, a, b = cos[a, b], first[at + a], second[b]
            keep = value > threshold + 1e-12
            if not keep.all():
                raw = from_binary(vector, kind, width)
                raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])  # by powers of two: no rounding
                y, z = raw[a[~keep]], raw[b[~keep]]
                keep[~keep] = (y * z).sum(1) / (np.sqrt((y * y).sum(1)) * np.sqrt((z * z).sum(1))) >= threshold
            if same:
                keep &= a < b
            a, b = a[keep], b[keep]
            label = join_up(label, a, b)
            guest = np.flatnonzero(role[b] == _VISITOR)  # only second sides are
            elsewhere = (home[b[guest]] < cell) & np.isin(a[guest] * cells + home[b[guest]], seen)
            here = np.ones(len(a), bool)
            here[guest[elsewhere]] = False
            np.add.at(links, a[here], m[b[here]])
            np.add.at(links, b[here], m[a[here]])
        low = rep[label]
        met = (links > 0) | (low != rep)
        return pa.table({"rep": rep[met], "links": links[met], "low": low[met]})

    return tasks.groupBy("cell", "kind", "i", "j").applyInArrow(run, "rep long, links long, low long")


def near_copies(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row (vec_id, embedding); 0 < threshold < 1."""
    kind = np.dtype("f4" if "float" in rows.schema["embedding"].dataType.simpleString() else "f8")
    angle = math.acos(threshold)
    ids = materialize(hashed(rows.select(F.coalesce("vec_id", F.lit(_NULL_ID)).alias("doc"), "embedding"), kind))
    classes = materialize(ids.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.min("doc").alias("rep0"), F.count("*").alias("m"), F.min_by("vector", "doc").alias("vector")))
    # classes are told apart by number: ids may repeat
    classes_n = materialize(classes.withColumn("rep", F.monotonically_increasing_id()))
    release(classes)
    n, size = classes_n.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    if not n:
        plain = ids.select("doc", F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("comp"))
        return _shown(plain)
    width = size // kind.itemsize
    cells = int(min(MAX_CELLS, max(1, CENTRE_BYTES // (8 * width)), math.ceil(math.sqrt(n) / 8)))
    block = min(BLOCK, max(1, BLOCK_BYTES // (8 * width)))
    middle = centres(classes_n, cells, n, kind, width)
    where = materialize(placed(classes_n, middle, angle, kind))
    count = lambda c: F.count(F.when(c, 1))
    role = lambda r: F.col("role") == r
    core = role(_CORE)
    sizes = materialize(where.groupBy("cell").agg(count(role(_OUTER)).alias("outer"), count(core).alias("core"), count(role(_VISITOR)).alias("visitor"), count(F.col("shell")).alias("shell"), F.sum(F.when(core, F.col("m"))).alias("weight"), F.min(F.when(core, F.col("rep"))).alias("least")))
    found = materialize(compared(units(where, sizes, block), threshold, kind, width))
    inside = where.where(core).select("cell", "rep", "m").join(F.broadcast(sizes.select("cell", "weight", "least")), "cell")
    dense = materialize(inside.select("rep", (F.col("weight") - F.col("m")).alias("links"), F.col("least").alias("low")))
    release(where, sizes)
    both = found.union(dense)
    links = both.groupBy("rep").agg(F.sum("links").alias("links"))
    # ids that repeat join their classes
    own = ids.where(F.col("h1").isNotNull()).select("doc", "h1", "h2").join(classes_n.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc", "rep")
    again = own.groupBy("doc").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc", "low")
    repeats = own.join(again, "doc").where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    labels = components(both.where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b")).union(repeats).distinct())
    named = classes_n.select("h1", "h2", "rep", "rep0", "m").join(labels.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = named.groupBy("comp").agg(F.min("rep0").alias("least"))
    told = materialize(named.join(least, "comp").join(links, "rep", "left").select("h1", "h2", F.col("least").alias("comp"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    release(found, dense, labels, classes_n)
    whole = ids.select("doc", "h1", "h2").join(told, ["h1", "h2"], "left").select("doc", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "doc").alias("comp"))
    return _shown(whole)


def _shown(whole: DataFrame) -> DataFrame:
    plain = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return whole.select(plain("doc").alias("vec_id"), "n_links", plain("comp").alias("component_id"), (F.col("doc") == F.col("comp")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), walk AS (
  SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT walk.vec_id, l.b FROM walk JOIN l ON l.a = walk.reached
), c AS (
  SELECT vec_id, min(reached) AS component_id FROM walk GROUP BY vec_id
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""
