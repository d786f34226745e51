"""Operator 1: Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the shortest string, from where the last one
ended, that is not yet in the dictionary (a last phrase that is in it counts too). The phrase set is
hashed and kept as a one-permutation minimum-hash signature of SLOTS values of 16 bits; an empty slot
takes the value of the next filled one. Likeness is the share of equal slots.

Documents follow each other by (doc_id, text); null doc_ids come first, and after the last comes the
first. Null and empty texts have the empty fingerprint, like one another (1.0) and unlike any other
text (0.0). Repeated rows are each other's neighbours. An empty table gives an empty result; extra
columns of the input are not read.

Rows are dealt into ranges of doc_id. The first row of each range is also sent to the range before
it, so every task sees its rows' successors; a task holds one Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tilth.llm.common import RangeHash, table

SLOTS = 128
#: Rows in one range of doc_id; at most MAX_RANGES ranges, which then hold more rows (they are streamed).
RANGE_ROWS, MAX_RANGES = 4_000, 20_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Parse:
    """A dictionary parse that can be carried on with more text."""

    __slots__ = ("known", "phrases", "rest")

    def __init__(self) -> None:
        self.known: set[str] = set()
        self.phrases: list[str] = []
        self.rest = ""

    def copy(self) -> Parse:
        other = Parse()
        other.known, other.phrases, other.rest = self.known.copy(), self.phrases.copy(), self.rest
        return other

    def feed(self, text: str) -> Parse:
        known, rest = self.known, self.rest
        add, append = known.add, self.phrases.append
        for c in text:
            rest += c
            if rest not in known:
                add(rest)
                append(rest)
                rest = ""
        self.rest = rest
        return self

    def cuts(self) -> list[str]:
        return [*self.phrases, self.rest] if self.rest else self.phrases


def signatures(parses: list[Parse]) -> np.ndarray:
    """One row of SLOTS 16-bit values for each parse."""
    cuts = [p.cuts() for p in parses]
    counts = np.array([len(c) for c in cuts])
    flat = [x for c in cuts for x in c]
    points = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
    starts = ends - np.diff(ends, prepend=0)
    hashes = RangeHash(points).of(starts, ends)
    slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64) + np.repeat(np.arange(len(cuts)), counts) * SLOTS
    least = np.full(len(cuts) * SLOTS, _EMPTY)
    np.minimum.at(least, slot, hashes >> np.uint64(7))
    least = least.reshape(-1, SLOTS)
    filled = least != _EMPTY
    twice = np.concatenate([filled, filled], 1)
    at = np.where(twice, np.arange(2 * SLOTS), 2 * SLOTS - 1)
    nearest = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :SLOTS] % SLOTS
    return (np.take_along_axis(least, nearest, 1) & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), (a == b).mean(1))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(group: list[tuple[int, str]]) -> pa.RecordBatch:
    """Results for all rows of a run but the last, whose row only serves as successor."""
    parses, edits, shas = [], [], []
    for (_, text), (_, following) in zip(group, group[1:], strict=False):
        half = len(text) // 2
        head = Parse().feed(text[: len(text) - half])
        other = head.copy().feed(following[:half])
        parses.append(head.feed(text[len(text) - half :]))
        edits.append(other)
        shas.append(hashlib.sha256((text[: len(text) - half] + following[:half]).encode("utf-8", "surrogatepass")).hexdigest())
    parses.append(Parse().feed(group[-1][1]))
    n = len(edits)
    own, edited = signatures(parses), signatures(edits)
    none, edited_none = np.array([not p.cuts() for p in parses]), np.array([not p.cuts() for p in edits])
    show = lambda s, e: pa.array(["" if e[i] else s[i].tobytes().hex() for i in range(n)], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([g[0] for g in group[:n]], pa.int64()), pa.array([len(g[1]) for g in group[:n]], pa.int64()), pa.array(shas, pa.string()), show(own, none), show(edited, edited_none),
            pa.array(likeness(own[:n], edited, none[:n], edited_none)), pa.array(likeness(own[:-1], own[1:], none[:-1], none[1:])),
        ],
        names=[c.split()[0] for c in _SCHEMA.split(", ")],
    )


def _run(batches: Iterator[pa.RecordBatch], block_chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and place; the last row of each range only serves as successor."""
    group: list[tuple[int, str]] = []
    held, at = 0, None
    for batch in batches:
        ids, texts, ranges = (batch.column(c) for c in ("doc_id", "text", "range"))
        for i in range(len(batch)):
            text, here = texts[i].as_py(), ranges[i].as_py()
            if here != at or held > block_chars:
                if len(group) > 1:
                    yield _rows(group)
                group = group[-1:] if here == at else []
                held, at = sum(len(g[1]) for g in group), here
            group.append((ids[i].as_py(), text))
            held += len(text)
    if len(group) > 1:
        yield _rows(group)


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text of docs (doc_id, text), of its edited text, and likenesses."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    count = docs.count()
    n = int(min(MAX_RANGES, max(1, count // RANGE_ROWS)))
    bounds = np.array(sorted(set(docs.select(key.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else [], np.float64)

    @F.pandas_udf(LongType())
    def range_of(ids):
        return ids.__class__(np.searchsorted(bounds, ids.to_numpy().astype(np.float64), side="right"))

    dealt = docs.withColumn("range", range_of(key))
    order = F.struct(key.alias("k"), F.col("text"))
    # the least doc_id of each range, and the range before: as many rows as there are ranges
    least = docs.select(key.alias("k")).withColumn("range", range_of("k")).groupBy("range").agg(F.min("k").alias("k")).orderBy("range").collect()
    before = spark.createDataFrame([(least[i]["k"], least[i - 1]["range"]) for i in range(len(least))], "k long, before long")
    firsts = (
        dealt.withColumn("k", key)
        .join(F.broadcast(before), "k")
        .groupBy("before")
        .agg(F.min_by(F.struct("doc_id", "text"), order).alias("first"))
        .select("first.*", F.col("before").alias("range"), F.lit(1).alias("carried"))
    )
    rows = dealt.withColumn("carried", F.lit(0)).unionByName(firsts)
    rows = rows.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "range") if n > 1 else rows.repartition(1)
    return rows.sortWithinPartitions("range", "carried", key, "text").drop("carried").mapInArrow(_run, _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
