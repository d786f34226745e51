"""Shared pieces: table access, shared-folder checkpoints and byte-level views of Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one round of array work covers; a longer single text is taken alone.
BLOCK_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of written frames that may be deleted.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees.

    Where a single-machine session has no such setting (tests) a folder below /tmp is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/tilth-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tilth-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a with block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut and survives lost executors.

    Shuffle files that served only this write are dropped when it is done.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the folders of materialized frames that nothing will read again; what was made of them must be written."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(frame))
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name that is not among `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and 64-bit offsets of a string array; nulls are empty texts."""
    array = array.cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.null_count:
        array = array.fill_null("")
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts sum to about `limit` bytes; every row is in exactly one range."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


class RangeHash:
    """64-bit hashes of any ranges of a byte (or code point) array, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        up, self._down = powers(len(values) + 1, base)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sum[end] - self._sum[start]) * self._down[start]
        return mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the long of the same bits."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def planes(x: np.ndarray) -> bytes:
    """64-bit values as eight byte planes, which compress well where high bytes are alike."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of unsigned 64-bit keys; rises with the key."""
    return ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def bucket_count(spark: SparkSession, items: int, each: int = 1_000_000) -> int:
    """Buckets of about `each` items, four for each shuffle partition at least."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), items // each + 1)


def deal(packed: DataFrame) -> DataFrame:
    """Rows by their column bucket, in order of it within each task."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each bucket together, from rows in order of the bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield held[0]["bucket"], held
                held = []
            held.append(row)
    if held:
        yield held[0]["bucket"], held


def meeting_keys(rows: DataFrame, pairs: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], buckets: int, local: int = 8, repeats: bool = False) -> DataFrame:
    """key, id: all pairs whose key occurs with two ids or more.

    pairs() gives for an Arrow batch its keys and ids, without repeats in all batches, or with `repeats`
    (then a pair can be given again). The pairs are packed and dealt by ranges of the key, once. Keys that
    `local` ids of one batch have are known to meet: their pairs are dealt apart, and one stand-in goes with
    the key's range to tell the others, so a very frequent key sends a few rows of each batch to its task.
    """
    names = ["bucket", "keys", "ids", "stands"]

    def ordered(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, key)) if repeats else np.argsort(key)
        key, ids = key[order], ids[order]
        if repeats and len(key):
            new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
            key, ids = key[new], ids[new]
        return key, ids

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids = pairs(batch)
            if not len(key):
                continue
            key, ids = ordered(key, ids)
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            runs = np.diff(np.append(cut, len(key)))
            known = np.repeat(runs >= local, runs)
            stand = key[cut[runs >= local]]
            out = []
            if len(stand):
                out.append((buckets + int(stand[0] % np.uint64(buckets)), planes(key[known]), planes(ids[known]), b""))
                key, ids = key[~known], ids[~known]
            edges = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
            s_edges = np.searchsorted(bucket_of(stand, buckets), np.arange(buckets + 1))
            for b in np.flatnonzero((np.diff(edges) > 0) | (np.diff(s_edges) > 0)).tolist():
                a, z = edges[b], edges[b + 1]
                out.append((b, planes(key[a:z]), planes(ids[a:z]), planes(stand[s_edges[b] : s_edges[b + 1]])))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in by_bucket(batches):
            key = np.concatenate([from_planes(r["keys"], np.uint64) for r in held])
            ids = np.concatenate([from_planes(r["ids"]) for r in held])
            if bucket < buckets:
                stand = np.concatenate([from_planes(r["stands"], np.uint64) for r in held])
                key, ids = ordered(key, ids)
                cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                runs = np.diff(np.append(cut, len(key)))
                keep = np.repeat((runs > 1) | np.isin(key[cut], stand), runs)
                key, ids = key[keep], ids[keep]
            for a in range(0, len(key), 1 << 17):
                yield pa.RecordBatch.from_arrays([signed(key[a : a + (1 << 17)]), pa.array(ids[a : a + (1 << 17)])], names=["key", "id"])

    packed = rows.mapInArrow(emit, "bucket int, keys binary, ids binary, stands binary")
    return deal(packed).mapInArrow(meet, "key long, id long")
