"""Operator 7: benchmark decontamination by hashed test n-grams.

Words are runs of ASCII letters and digits and of any characters from U+0080 on, after A-Z are made
small. A window is `width` consecutive words of a benchmark item; a shorter item (of one word at
least) is one window. Every window of a document whose hash is a window's hash is compared with that
window's words, so a hash collision is never a hit. A document word inside any occurring window is hit.

The benchmark's windows are broadcast while its texts have at most BROADCAST_BYTES, which takes less
than WINDOW_COST times as much memory; a larger benchmark is joined to the documents by window hash
instead, and each document then carries just the windows that occur in it.

Null and empty texts have no words and are not contaminated. Benchmark rows with null text or null
item_id are ignored and repeated ones count once. Repeated documents are each reported. An empty
table on either side gives no hits. Extra columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import RangeHash, blocks, table, text_bytes, unused

WIDTH = 13
#: Contaminated: n_hit > 0 and SHARE * n_hit >= n_words.
SHARE = 20
#: Texts of the benchmark up to this size are broadcast, and bytes that are broadcast for one of them at most:
#: of a word of one letter, a hash, a width, an item, two places and the word itself.
BROADCAST_BYTES, WINDOW_COST = 8 << 20, 24

#: Lower-cased byte, or 0 where a byte is in no word.
_LOWER = np.zeros(256, np.uint8)
_LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)


class Words:
    """Words of some consecutive rows: the row of each, its bytes and hashes of word windows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.base = int(offsets[0])
        self.low = _LOWER[raw[self.base : offsets[-1]]]
        off = offsets - self.base
        word = self.low > 0
        edge = np.zeros(len(word) + 1, bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[0] = edge[-1] = True
        edge[off] = True  # words end with their text
        cuts = np.flatnonzero(edge)
        self.start, self.end = cuts[:-1], cuts[1:]
        if len(word):
            real = word[self.start]
            self.start, self.end = self.start[real], self.end[real]
        self.row = np.searchsorted(off, self.start, side="right") - 1
        self.counts = np.bincount(self.row, minlength=len(off) - 1)
        self._windows = RangeHash(RangeHash(self.low).of(self.start, self.end))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all runs of `width` words; those that cross rows are meaningless."""
        first = np.arange(max(0, len(self.start) - width + 1))
        return self._windows.of(first, first + width)

    def words(self, first: int, width: int) -> bytes:
        data = self.low
        return b" ".join(data[a:b].tobytes() for a, b in zip(self.start[first : first + width], self.end[first : first + width], strict=True))


def item_windows(item_id: int, text: str, width: int) -> Iterator[tuple[int, int, bytes, int]]:
    """Hash, width, words and item of each window of an item."""
    for got in Windows.of_items([(item_id, text)], width).rows():
        yield got


class Windows:
    """Benchmark windows in order of hash, by width: their hashes, items and ranges of `data`, in which words are joined by blanks."""

    def __init__(self, data: bytes, hashes: np.ndarray, widths: np.ndarray, items: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.by_width = data, {}
        for w in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == w)
            mine = mine[np.argsort(hashes[mine], kind="stable")]
            known = np.zeros(1 << 16, bool)
            known[hashes[mine] & np.uint64(0xFFFF)] = True
            self.by_width[w] = (known, hashes[mine], items[mine], start[mine], end[mine])

    @classmethod
    def of_items(cls, items: list[tuple[int, str]], width: int) -> Windows:
        """All windows of items (item_id, text). Each word is held once, whatever the windows it is in."""
        raw, off = text_bytes(pa.array([text for _, text in items], pa.string()))
        words = Words(raw, off)
        n = words.counts
        sizes = words.end - words.start
        at = np.cumsum(sizes + 1) - sizes - 1
        data = b" ".join(words.low[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True))
        ids = np.array([i for i, _ in items], np.int64)
        width_of = np.minimum(n, width)
        first = np.flatnonzero(np.arange(len(sizes)) - (np.cumsum(n) - n)[words.row] <= (n - width_of)[words.row])
        w = width_of[words.row[first]]
        hashes = np.zeros(len(first), np.uint64)
        for one in np.unique(w).tolist():
            hashes[w == one] = words.windows(one)[first[w == one]]
        last = first + w - 1
        return cls(data, hashes, w, ids[words.row[first]], at[first], at[last] + sizes[last])

    @classmethod
    def of_rows(cls, rows: list[dict]) -> Windows:
        """The given windows (h, width, words, item_id)."""
        sizes = np.array([len(r["words"]) for r in rows], np.int64)
        col = lambda c, t: np.array([r[c] for r in rows], t)
        end = np.cumsum(sizes)
        return cls(b"".join(r["words"] for r in rows), col("h", np.int64).view(np.uint64), col("width", np.int64), col("item_id", np.int64), end - sizes, end)

    def rows(self) -> Iterator[tuple[int, int, bytes, int]]:
        for w, (_, hashes, items, start, end) in self.by_width.items():
            for h, item, a, b in zip(hashes.tolist(), items.tolist(), start.tolist(), end.tolist(), strict=True):
                yield h, w, self.data[a:b], item

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Whether each word is hit, and the items found by row."""
        change = np.zeros(len(words.start) + 1, np.int64)
        found: dict[int, set[int]] = defaultdict(set)
        for width, (known, hashes, items, start, end) in self.by_width.items():
            got = words.windows(width)
            at = np.flatnonzero(known[got & np.uint64(0xFFFF)])
            at = at[words.row[at] == words.row[at + width - 1]]
            lo, hi = (np.searchsorted(hashes, got[at], side=s) for s in ("left", "right"))
            for i, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                own = words.words(i, width)
                same = [int(items[j]) for j in range(a, b) if self.data[start[j] : end[j]] == own]
                if same:
                    change[i] += 1
                    change[i + width] -= 1
                    found[int(words.row[i])].update(same)
        return np.cumsum(change[:-1]) > 0, found


def _kept_text(words: Words, raw: np.ndarray, off: np.ndarray, hit: np.ndarray, row: int) -> str:
    """The row's text without the stretches from the first to the last byte of each run of hit words."""
    lo, hi = np.searchsorted(words.row, [row, row + 1])
    flags = np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]]))
    out, at = [], int(off[row])
    for a, b in zip(np.flatnonzero(flags == 1) + lo, np.flatnonzero(flags == -1) + lo - 1, strict=True):
        out.append(raw[at : words.start[a] + words.base].tobytes())
        at = int(words.end[b]) + words.base
    out.append(raw[at : int(off[row + 1])].tobytes())
    return b"".join(out).decode("utf-8", "replace")


_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _report(words: Words, hit: np.ndarray, found: dict[int, set[int]], share: int) -> list[pa.Array]:
    n_words = words.counts
    n_hit = np.bincount(words.row, weights=hit, minlength=len(n_words)).astype(np.int64)
    named = [",".join(sorted(map(str, found.get(r, ())))) for r in range(len(n_words))]
    return [
        pa.array(n_words.astype(np.int64)), pa.array(n_hit), pa.array([len(found.get(r, ())) for r in range(len(n_words))], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named], pa.string()), pa.array((n_hit > 0) & (share * n_hit >= n_words)),
    ]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, spans: bool = False, carry: bool = False) -> DataFrame:
    """Contamination figures for each row of docs; with `spans` also clean_text, the text without hit spans.

    With `carry` all columns of docs stay before the figures.
    """
    items = benchmark.select("item_id", "text").dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kept = [*docs.columns] if carry else ["doc_id"]
    place = (kept if carry else ["doc_id", "text"]).index("text")
    docs = docs if carry else docs.select("doc_id", "text")
    figures = _SCHEMA + (", clean_text string" if spans else "")
    names = [*kept, *(c.split()[0] for c in figures.split(", "))]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), figures])

    def rows(columns: list[pa.Array], raw: np.ndarray, off: np.ndarray, windows: Windows) -> pa.RecordBatch:
        words = Words(raw, off)
        hit, found = windows.scan(words)
        out = [*columns[: len(kept)], *_report(words, hit, found, share)]
        if spans:
            out.append(pa.array([_kept_text(words, raw, off, hit, r) for r in range(len(off) - 1)], pa.string()))
        return pa.RecordBatch.from_arrays(out, names=names)

    if size <= BROADCAST_BYTES:
        known = docs.sparkSession.sparkContext.broadcast(Windows.of_items([(r.item_id, r.text) for r in items.collect()], width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = text_bytes(batch.column(place))
                for a, b in blocks(off):
                    yield rows(batch.slice(a, b - a).columns, raw, off[a : b + 1], known.value)

        return docs.mapInArrow(run, schema)
    return _joined(docs, items, width, rows, schema, place)


def _joined(docs: DataFrame, items: DataFrame, width: int, rows, schema: str, place: int) -> DataFrame:
    """scan() for a benchmark too large to broadcast: windows meet by hash in a shuffle join."""

    def bench(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = [*item_windows(item, text, width)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64)), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.binary()), pa.array([g[3] for g in got], pa.int64())], names=["h", "width", "words", "item_id"])

    windows = items.mapInArrow(bench, "h long, width int, words binary, item_id long")
    widths = [r.width for r in windows.select("width").distinct().collect()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            for a, b in blocks(off):
                words = Words(raw, off[a : b + 1])
                for w in widths:
                    h = words.windows(w)
                    at = np.flatnonzero(words.row[: len(h)] == words.row[w - 1 : w - 1 + len(h)])
                    key = np.unique(np.stack([words.row[at].astype(np.uint64), h[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
                    row = pa.array(key[:, 0].astype(np.int64) + a)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in ("t1", "t2")), pa.array(np.ascontiguousarray(key[:, 1]).view(np.int64))], names=["t1", "t2", "h"])

    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    own = [unused(c, columns) for c in ("t1", "t2", "found")]
    keyed = docs.withColumns(dict(zip(own, (F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=False)))
    hits = keyed.select(F.col(own[0]).alias("t1"), F.col(own[1]).alias("t2"), "text").dropDuplicates(["t1", "t2"]).mapInArrow(emit, "t1 long, t2 long, h long").join(windows, "h")
    found = hits.groupBy(F.col("t1").alias(own[0]), F.col("t2").alias(own[1])).agg(F.collect_set(F.struct("h", "width", "words", "item_id")).alias(own[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column(place))
            for r, got in enumerate(batch.column(len(columns)).to_pylist()):
                yield rows(batch.slice(r, 1).columns, raw, off[r : r + 2], Windows.of_rows(got or []))

    return keyed.join(found, own[:2], "left").select(*(F.col(f"`{c}`") for c in columns), own[2]).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, k, w[i:i + k - 1] AS g FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, w[i:i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))
), hit AS (
  SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.g = dw.g
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
