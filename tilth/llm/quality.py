"""Operator 5: quality scores by regularised quadratic discriminant analysis.

Each text becomes FEATURES transformed statistics. From labelled rows come the sums that give each
class its mean and covariance; the covariance is shrunk towards the pooled one and towards a scaled
identity, and its Cholesky factor is kept for scoring. A score is the posterior of class 1 from the
difference of Mahalanobis log-densities and the log prior odds.

Null and empty texts have all statistics 0 and are scored like any text. Labels of null quality or
without a document are ignored; repeated labels weigh as often as they occur; repeated documents are
each scored. Where one class has no labelled row, each score is the share of class 1 (0.5 without any
label). An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import RangeHash, blocks, materialize, table, text_bytes
from tilth.llm.language_id import held_out

FEATURES = ["size", "word_size", "upper", "digit", "symbol", "bar", "distinct", "repeat", "once", "stop_rate", "line_repeat", "spread"]
#: Shares of the pooled covariance (more for classes of few rows) and of the scaled identity in each class covariance.
TO_POOLED, TO_IDENTITY = 0.1, 0.02
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 small or beyond ASCII, 2 capital, 3 digit, 4 symbol, 5 bar, 6 white space, 7 line end
_KIND[0x21:0x7F] = 4
_KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[[0x2E, 0x2C]] = 0
_KIND[0x7C] = 5
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 6
_KIND[0x0A] = 7


def _distinct(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: distinct keys, keys that occur once, and the largest count of a key."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(row)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row[at], counts)
    return np.bincount(row[at], minlength=n), np.bincount(row[at], weights=counts == 1, minlength=n), most


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of each row."""
    raw, off = raw[off[0] : off[-1]], off - off[0]
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    kind = _KIND[raw]
    sizes = np.diff(off)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    letters = kinds[:, 1] + kinds[:, 2]
    share = lambda a, b: a / np.maximum(b, 1)
    inside = kind < 6
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0] = edge[-1] = True
    edge[off] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    word = inside[start]
    start, end = start[word], end[word]
    hashes = RangeHash(raw)
    w_row, w_hash = row[start], hashes.of(start, end)
    words = np.bincount(w_row, minlength=n).astype(float)
    distinct, once, most = _distinct(w_row, w_hash, n)
    same = np.zeros(len(start), bool)
    same[1:] = (w_hash[1:] == w_hash[:-1]) & (w_row[1:] == w_row[:-1])
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[1:] = raw == 0x0A
    breaks[off] = True
    lines = np.flatnonzero(breaks)
    l_start, l_end = lines[:-1], lines[1:]
    l_row = row[l_start]
    l_count = np.bincount(l_row, minlength=n).astype(float)
    l_end = np.where(raw[l_end - 1] == 0x0A, l_end - 1, l_end)
    l_distinct, _, _ = _distinct(l_row, hashes.of(l_start, np.maximum(l_end, l_start)), n)
    short = np.bincount(w_row, weights=(end - start) <= 3, minlength=n)
    size = np.zeros(n)
    size[:] = np.bincount(w_row, weights=end - start, minlength=n)
    square = np.bincount(w_row, weights=(end - start) ** 2, minlength=n)
    mean = share(size, words)
    cols = {
        "size": np.log1p(sizes) / 10,
        "word_size": np.log1p(mean),
        "upper": np.sqrt(share(kinds[:, 2], letters)),
        "digit": np.sqrt(share(kinds[:, 3], sizes)),
        "symbol": np.sqrt(share(kinds[:, 4], sizes)),
        "bar": np.sqrt(share(kinds[:, 5], words)),
        "distinct": share(distinct, words),
        "repeat": np.sqrt(share(np.bincount(w_row, weights=same, minlength=n), words)),
        "once": share(once, words),
        "stop_rate": share(short, words),
        "line_repeat": np.sqrt(1 - share(l_distinct, np.maximum(l_count, 1)) * (l_count > 0)) * (l_count > 0),
        "spread": np.log1p(np.sqrt(np.maximum(share(square, words) - mean**2, 0))),
    }
    for i, name in enumerate(FEATURES):
        out[:, i] = cols[name]
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the FEATURES of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            for a, b in blocks(off):
                x = statistics(raw, off[a : b + 1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")), *(pa.array(x[:, i].copy()) for i in range(x.shape[1]))], names=["doc_id", "held_out", *FEATURES])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{f} double" for f in FEATURES))


class Discriminant:
    """Class means and cached Cholesky factors."""

    def __init__(self, counts: dict[int, float], sums: dict[int, np.ndarray], squares: dict[int, np.ndarray]):
        total = sum(counts.values())
        self.share = counts.get(1, 0) / total if total else 0.5
        self.usable = all(counts.get(c, 0) > 1 for c in (0, 1))
        if not self.usable:
            return
        d = len(sums[0])
        self.mean = {c: sums[c] / counts[c] for c in (0, 1)}
        cov = {c: squares[c] / counts[c] - np.outer(self.mean[c], self.mean[c]) for c in (0, 1)}
        pooled = sum(cov[c] * counts[c] for c in (0, 1)) / total
        self.factor, self.log_det = {}, {}
        for c in (0, 1):
            to_pooled = max(TO_POOLED, 2 * d / (counts[c] + 2 * d) * (1 - TO_IDENTITY))
            mixed = (1 - to_pooled - TO_IDENTITY) * cov[c] + to_pooled * pooled + (TO_IDENTITY * np.trace(pooled) / d + 1e-9) * np.eye(d)
            lower = np.linalg.cholesky(mixed)
            self.factor[c] = np.linalg.inv(lower)
            self.log_det[c] = 2 * np.log(np.diag(lower)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.share)
        log_density = {c: -0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] for c in (0, 1)}
        odds = log_density[1] - log_density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From doc statistics and labels (doc_id, quality): two rows of sums come back to the driver."""
    rows = stats.join(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)"), "doc_id")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = rows.groupBy("quality").agg(F.count("*").alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in pairs)).collect()
    counts, sums, squares = {}, {}, {}
    for r in got:
        c = r["quality"]
        counts[c] = r["n"]
        sums[c] = np.array([r[f"s{i}"] for i in range(d)])
        squares[c] = np.zeros((d, d))
        for i, j in pairs:
            squares[c][i, j] = squares[c][j, i] = r[f"q{i}_{j}"]
    return Discriminant(counts, sums, squares)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.stack([batch.column(f).to_numpy() for f in FEATURES], 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(document_statistics(table(spark, sf_dir, "documents")))
    return score(stats, fit(stats.where(~F.col("held_out")), table(spark, sf_dir, "labels")))
