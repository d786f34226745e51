"""Operator 11: vector codes by Lloyd's rounds with Hamerly's bounds.

Components become integers floor(1024 * x), vectors are cut into PARTS equal consecutive parts, and each
part position has a codebook, at first that part of the 256 smallest vec_ids. A round gives every part to
the nearest entry (squared Euclidean distance, ties to the lower index) and moves each entry to the floor
of its parts' mean; entries without parts stay.

Between rounds each row keeps, written in the shared folder, for each part its entry, an upper bound of
the distance to it and a lower bound of the distance to the second nearest entry. When entries have moved
the bounds move by as much. A part is compared with all entries only where the upper bound is not strictly
below the lower one (or half of the way to the next entry), also after it was set to the distance itself:
a part with two nearest entries is always compared with all, and gets the lower index. Distances are
integers below 2**53, held exactly in doubles; bounds are rounded away from a wrong decision.

Rows whose vector is null or holds null or non-finite components are left out; vectors of different lengths
are filled up with zeros to the longest, and to a multiple of PARTS. Integers are held within bound(), which
lies at 2**23 for parts of 16 components, so that sums stay exact. Null vec_ids come after all others, and
rows that repeat a vec_id are each coded (where they start a codebook, in order of their vectors). An empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import materialize, release, table
from tilth.llm.vectors import finite, lists, padded

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows compared with a whole codebook at a time.
_STEP = 1 << 13
_STATE = "vec_id long, label {label}, x array<int>, entry array<int>, upper array<double>, lower array<double>, scans int"


def bound(size: int) -> int:
    """The largest integer of a part of `size` components: 4 * size * bound**2 <= 2**53."""
    return 1 << ((51 - (size - 1).bit_length()) // 2)


def integers(rows: DataFrame, width: int) -> DataFrame:
    """vec_id, label and the vector as `width` integers x, for rows (vec_id, label, embedding) with whole vectors."""
    most = bound(width // PARTS)
    names = ["vec_id", "label", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, length, values = finite(batch.column("embedding"))
            held = np.clip(values, -most / SCALE, most / SCALE)
            x = padded(length, np.floor(held * SCALE).astype(np.int32), width)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), lists(x, pa.int32())], names=names)

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, x array<int>")


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


class Move:
    """A codebook of one part, and how far its entries lie from the one before and from each other."""

    def __init__(self, new: np.ndarray, old: np.ndarray | None = None):
        self.book = new.astype(np.float64)
        self.norm = (self.book**2).sum(1)
        between = self.norm[:, None] - 2 * self.book @ self.book.T + self.norm
        np.fill_diagonal(between, np.inf)
        self.half = _down(_down(np.sqrt(between.min(1, initial=np.inf))) / 2)
        if old is not None:
            self.way = _up(np.sqrt(((self.book - old) ** 2).sum(1)))
            self.farthest = int(self.way.argmax())
            self.most, self.next = np.sort(np.append(self.way, 0.0))[[-1, -2]]

    def distance(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x - self.book[entry]) ** 2).sum(1)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry, the lowest of equals, and bounds of its distance from above and the second's from below."""
        entry, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x))
        for a in range(0, len(x), _STEP):
            part = x[a : a + _STEP]
            d = (part**2).sum(1)[:, None] - 2 * part @ self.book.T + self.norm
            at, own = np.arange(len(part)), d.argmin(1)
            entry[a : a + _STEP], upper[a : a + _STEP] = own, _up(np.sqrt(d[at, own]))
            d[at, own] = np.inf
            lower[a : a + _STEP] = _down(np.sqrt(d.min(1)))
        return entry, upper, lower

    def again(self, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Brings entries and bounds up to date in place; gives the rows that were compared with all entries."""
        upper[:] = _up(upper + self.way[entry])
        lower[:] = _down(lower - np.where(entry == self.farthest, self.next, self.most))
        least = np.maximum(lower, self.half[entry])
        open_ = np.flatnonzero(~(upper < least))
        upper[open_] = _up(np.sqrt(self.distance(x[open_], entry[open_])))
        open_ = open_[~(upper[open_] < least[open_])]
        entry[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return open_


def _matrix(batch: pa.RecordBatch, name: str, width: int, kind: type = np.float64) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().astype(kind).reshape(len(batch), width)


def assigned(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, width: int) -> DataFrame:
    """Rows with each part's nearest entry and bounds; scans: parts of the row that were compared with all entries.

    books: parts x entries x components; `before`: those by which rows were assigned, None for rows without bounds.
    """
    size = width // PARTS
    names = ["vec_id", "label", "x", "entry", "upper", "lower", "scans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = [Move(books[p], None if before is None else before[p]) for p in range(PARTS)]
        for batch in batches:
            n = len(batch)
            x = _matrix(batch, "x", width)
            scans = np.zeros(n, np.int32)
            if before is None:
                entry, upper, lower = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS)), np.zeros((n, PARTS))
            else:
                entry, upper, lower = _matrix(batch, "entry", PARTS, np.int64), _matrix(batch, "upper", PARTS), _matrix(batch, "lower", PARTS)
            for p, move in enumerate(moves):
                part = x[:, p * size : (p + 1) * size]
                if before is None:
                    entry[:, p], upper[:, p], lower[:, p] = move.scan(part)
                    scans += 1
                else:
                    scans[move.again(part, entry[:, p], upper[:, p], lower[:, p])] += 1
            arrays = [batch.column(c) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*arrays, lists(entry.astype(np.int32), pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(scans)], names=names)

    return rows.mapInArrow(run, _STATE.format(label=rows.schema["label"].dataType.simpleString()))


def moved(state: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after each used entry went to the floor of its parts' mean; the driver gets one sum for each component of an entry."""
    size, entries = width // PARTS, books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS * entries, size + 1), np.int64)
        for batch in batches:
            x, entry = _matrix(batch, "x", width, np.int64), _matrix(batch, "entry", PARTS, np.int64)
            for p in range(PARTS):
                np.add.at(total, p * entries + entry[:, p], np.column_stack([x[:, p * size : (p + 1) * size], np.ones(len(x), np.int64)]))
        slot, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(place), pa.array(total[slot, place])], names=["slot", "place", "s"])

    parts = state.select("x", "entry").mapInArrow(run, "slot long, place long, s long").groupBy("slot", "place").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((PARTS * entries, size + 1), np.int64)
    total[parts["slot"].to_numpy(), parts["place"].to_numpy()] = parts["s"].to_numpy()
    count, sums = total[:, -1:], total[:, :-1]
    return np.where(count > 0, sums // np.maximum(count, 1), books.reshape(PARTS * entries, size)).reshape(books.shape)


def coded(state: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed over parts) of assigned rows."""
    size = width // PARTS
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, entry = _matrix(batch, "x", width, np.int64), _matrix(batch, "entry", PARTS, np.int64)
            error = sum(((x[:, p * size : (p + 1) * size] - books[p][entry[:, p]]) ** 2).sum(1) for p in range(PARTS))
            code = digits[entry].sum(1) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = state.schema["label"].dataType.simpleString()
    return state.select("vec_id", "label", "x", "entry").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def train(rows: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """State after the last assignment of rows (vec_id, label, embedding), the final codebooks, and the width of x."""
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = PARTS * max(1, -(-dim // PARTS))
    start = materialize(integers(rows.select("vec_id", "label", "embedding"), width))
    first = start.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(ENTRIES).toArrow()["x"]
    books = np.array(first.to_pylist(), np.int64).reshape(-1, PARTS, width // PARTS).transpose(1, 0, 2)
    if not len(first):
        books = np.zeros((PARTS, 1, width // PARTS), np.int64)
    state, before = start, None
    for turn in range(ROUNDS + 1):
        after = materialize(assigned(state, books, before, width))
        release(state)
        state = after
        if turn < ROUNDS:
            before, books = books, moved(state, books, width)
    return state, books if len(first) else books[:, :0], width


def encode(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for the rows (vec_id, label, embedding) with whole vectors."""
    state, books, width = train(rows)
    told = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    own = materialize(coded(state, books, width))
    release(state)
    total = own.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    both = own.join(total, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Rounds written out one after another: a<i> assigns by codebooks b<i> (part, entry, k, c)."""

    def assign(i: int) -> str:
        return f"""d{i} AS MATERIALIZED (
  SELECT r, v.part, entry, sum((x - c) * (x - c)) AS d FROM v JOIN b{i} b ON v.part = b.part AND v.k = b.k GROUP BY ALL
), a{i} AS MATERIALIZED (
  SELECT r, part, min(d)::BIGINT AS d, arg_min(entry, d * {ENTRIES} + entry) AS entry FROM d{i} GROUP BY ALL
)"""

    def update(i: int) -> str:
        return f"""m{i} AS MATERIALIZED (
  SELECT part, entry, k, sum(x) AS s, count(*) AS n FROM a{i} JOIN v USING (r, part) GROUP BY ALL
), b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.k, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM b{i} b LEFT JOIN m{i} USING (part, entry, k)
)"""

    rounds = ", ".join(f"{assign(i)}, {update(i)}" for i in range(ROUNDS))
    return f"""
WITH w AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT r, (p - 1) // (len(e) // {PARTS}) AS part, (p - 1) % (len(e) // {PARTS}) AS k, floor({SCALE} * e[p])::HUGEINT AS x
  FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS p FROM w)
), b0 AS MATERIALIZED (
  SELECT part, r AS entry, k, x AS c FROM v WHERE r < {ENTRIES}
), {rounds}, {assign(ROUNDS)}, o AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, k)) FROM b{ROUNDS}) AS codebooks_sha256
FROM w JOIN o USING (r)"""


ORACLE_SQL = _oracle()
