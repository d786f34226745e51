"""Operator 3: removal of repeated byte strings by suffix arrays.

Every byte covered by a string of `width` bytes that also starts in a document with a smaller doc_id
is removed; strings are judged on the input, and matches never cross documents.

1. Equal texts are one class; the smallest doc_id stands for it. (A later copy is wholly covered.)
2. Anchors: of the ANCHOR-byte strings inside each window of `width` bytes, the one with the least
   hash. Equal windows have equal anchors, so only anchors of two documents or more matter. Anchors
   that many documents of one Arrow batch share are known at once and not sent to one task.
3. The bytes of the windows that a shared anchor was chosen in are its snippet. Equal snippets are one,
   with their smallest doc_id.
4. The snippets of one anchor are sorted by a suffix array (linear grouping, many anchors at once).
   Suffixes that follow each other and agree on `width` bytes are one window, which belongs to its
   smallest doc_id. An anchor with very many snippets is cut into lanes (in several tasks if one
   Arrow batch alone has many), whose windows then meet by a 128-bit digest; an anchor with one snippet needs no order.
5. Each occurrence of a snippet is covered by its windows that belong to a smaller doc_id.

Null and empty texts have no bytes. Null doc_ids count as the smallest. Repeated rows (equal doc_id)
don't remove each other, as neither id is smaller. An empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import RangeHash, blocks, bucket_count, bucket_of, by_bucket, deal, from_planes, materialize, meeting_keys, mix, planes, release, signed, table, text_bytes
from tilth.llm.suffix_arrays import suffix_arrays

WIDTH, ANCHOR = 50, 24
#: Documents of one Arrow batch from which on an anchor is known to be shared.
LOCAL = 8
#: Snippets of one anchor that are sorted together.
BLOCK_SNIPPETS = 32
#: Symbols sorted in one round.
SORT_SYMBOLS = 1 << 19
_NULL_ID = -(1 << 63)
#: The half of a hash that anchors are chosen by; their places take the other half.
_HIGH = np.uint64(0xFFFFFFFF00000000)
_BASE2 = 0xC2B2AE3D27D4EB4F


def anchors(raw: np.ndarray, off: np.ndarray, width: int, size: int) -> tuple[np.ndarray, ...]:
    """Anchors of consecutive rows: rows, hashes, and the first and last start (from off[0]) of the windows each is the anchor of."""
    raw, off = raw[off[0] : off[-1]], off - off[0]
    windows = len(raw) - width + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none.astype(np.uint64), none, none
    at = np.arange(len(raw) - size + 1)
    hashes = RangeHash(raw).of(at, at + size)
    least = (hashes & _HIGH) | at.astype(np.uint64)  # of equal hashes the leftmost is the least
    span, have = width - size + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    crossing = (off[1:-1, None] - np.arange(1, width)).ravel()
    inside = np.ones(windows, bool)
    inside[crossing[(crossing >= 0) & (crossing < windows)]] = False
    starts = np.flatnonzero(inside)
    places = (least[starts] & ~_HIGH).astype(np.int64)
    cut = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(places) else none
    first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1] if len(cut) else none
    return np.searchsorted(off, first, side="right") - 1, hashes[places[cut]], first, last


def shared_anchors(texts: DataFrame, width: int, size: int, local: int) -> DataFrame:
    """u, hashes: for each text (u, text) the mixed hashes of its anchors that another text has too."""

    def own_anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        raw, off = text_bytes(batch.column("text"))
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in blocks(off):
            r, h, _, _ = anchors(raw, off[a : b + 1], width, size)
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            rows.append(r[new] + a)
            hashes.append(mix(h[new]))  # least hashes are small: mixed, they are dealt out evenly
        return np.concatenate(hashes), batch.column("id").to_numpy()[np.concatenate(rows)]

    size_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(texts.sparkSession, 2 * size_ // (width - size + 2))
    met = meeting_keys(texts.select(F.col("u").alias("id"), "text"), own_anchors, buckets, local)
    return met.groupBy(F.col("id").alias("u")).agg(F.collect_list("key").alias("hashes"))


def found_anchors(batch: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, width: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Shared anchors of a batch (text, hashes), by block of text: the rows, anchors, starts and ends of snippets in raw, their digests and first bytes in the row."""
    lists = batch.column("hashes")
    flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    for a, b in blocks(off):
        if ends[a] == ends[b]:
            continue
        rows, hashes, first, last = anchors(raw, off[a : b + 1], width, size)
        wanted = np.unique(flat[ends[a] : ends[b]] ^ mix(np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(ends[a : b + 1])) + np.uint64(1)))
        mine = mix(hashes) ^ mix(rows.astype(np.uint64) + np.uint64(1))
        keep = np.isin(mine, wanted)
        rows, hashes, start, end = rows[keep] + a, hashes[keep], first[keep], last[keep] + width
        text = raw[off[a] : off[b]]
        s1, s2 = RangeHash(text).of(start, end) ^ hashes, RangeHash(text, _BASE2).of(start, end)
        start, end = start + off[a], end + off[a]
        yield rows, hashes, start, end, s1, s2, start - off[rows]


def occurrences(texts: DataFrame, width: int, size: int) -> DataFrame:
    """All snippets of shared anchors: s1, s2 (digest), u, d, at (its first byte in the text), from texts (u, d, text, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            for rows, _, _, _, s1, s2, at in found_anchors(batch, raw, off, width, size):
                ids = pa.array(rows)
                yield pa.RecordBatch.from_arrays([signed(s1), signed(s2), batch.column("u").take(ids), batch.column("d").take(ids), pa.array(at.astype(np.int32))], names=["s1", "s2", "u", "d", "at"])

    return texts.where("hashes is not null").select("u", "d", "text", "hashes").mapInArrow(run, "s1 long, s2 long, u long, d long, at int")


_PACKED = ["h", "salt", "s1", "s2", "lo", "hi", "size"]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of each run of equal rows."""
    new = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new)) if len(columns[0]) else np.zeros(0, np.int64)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def packed_snippets(texts: DataFrame, width: int, size: int, buckets: int, block: int) -> DataFrame:
    """Distinct snippets of each Arrow batch, packed by ranges of their anchor, from texts (d, text, hashes).

    An anchor with more than `block` snippets in the batch sends them to salted lanes, and a
    stand-in that tells its own lane so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy()
            raw, off = text_bytes(batch.column("text"))
            parts = [(h, s1, s2, d[rows], start, end) for rows, h, start, end, s1, s2, _ in found_anchors(batch, raw, off, width, size)]
            if not sum(len(p[0]) for p in parts):
                continue
            h, s1, s2, own, start, end = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(s1)
            h, s1, s2, own, start, end = (c[order] for c in (h, s1, s2, own, start, end))
            cut = _heads(h, s1, s2)
            lo, hi = np.minimum.reduceat(own, cut), np.maximum.reduceat(own, cut)
            order = np.argsort(h[cut], kind="stable")
            h, s1, s2, start, end = (c[cut][order] for c in (h, s1, s2, start, end))
            lo, hi, lengths = lo[order], hi[order], end - start
            runs_at = _heads(h)
            runs = np.diff(np.append(runs_at, len(h)))
            many = np.repeat(runs, runs)
            hot = many > block
            salt = np.where(hot, (s1 % (2 * many // block).clip(1).astype(np.uint64)).astype(np.int64), -1)
            bucket = np.where(hot, bucket_of(mix(h ^ mix(salt.astype(np.uint64))), buckets), bucket_of(mix(h), buckets))
            stand = h[runs_at[runs > block]]
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            stand_bucket = bucket_of(mix(stand), buckets)
            out = []
            for b in np.union1d(bucket, stand_bucket).tolist():
                at = order[edges[b] : edges[b + 1]]
                out.append((b, *(planes(c[at]) for c in (h, salt, s1, s2, lo, hi, lengths)), raw[_places(start[at], lengths[at])].tobytes(), planes(stand[stand_bucket == b])))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", *_PACKED, "bytes", "stands"])

    return texts.where("hashes is not null").select("d", "text", "hashes").mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in [*_PACKED, "bytes", "stands"]))


def sort_lanes(raw: np.ndarray, start: np.ndarray, lengths: np.ndarray, lane: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Windows of all snippets (ranges of raw), grouped by content within each lane (lane ascending).

    Gives for each window its snippet, its place there and the number of its group, and the bytes
    joined with the snippets' starts in them.
    """
    closing = np.append(lane[1:] != lane[:-1], True)
    sizes = lengths + 1 + closing  # a separator after each snippet, and the closing symbol, which stands alone, after each lane's last
    starts = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.uint8)
    symbols = np.ones(len(flat), np.int64)
    to = _places(starts, lengths)
    flat[to] = raw[_places(start, lengths)]
    symbols[to] = flat[to].astype(np.int64) + 2
    ends = (starts + sizes)[closing]
    symbols[ends - 1] = 0
    order = suffix_arrays(symbols, np.append(0, ends))
    has = np.maximum(lengths - width + 1, 0)
    owner = np.full(len(symbols), -1, np.int64)
    owner[_places(starts, has)] = np.repeat(np.arange(len(lengths)), has)
    order = order[owner[order] >= 0]
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = lane[owner[order[1:]]] != lane[owner[order[:-1]]]
        words = np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,))
        for i in {*range(0, width - 7, 8), width - 8}:
            w = words[order + i]
            fresh[1:] |= w[1:] != w[:-1]
    return owner[order], order - starts[owner[order]], np.cumsum(fresh) - 1, symbols, starts


def _runs(snippet: np.ndarray, place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Snippet, first and last window place, owner of runs of windows with the same owner."""
    order = np.lexsort((place, snippet))
    s, p, o = snippet[order], place[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
    cut = np.flatnonzero(new)
    return s[cut], p[cut], p[np.append(cut[1:], len(s)) - 1] if len(s) else p[:0], o[cut]


def sorted_windows(packed: DataFrame, width: int, block: int) -> DataFrame:
    """Owned runs of windows of each snippet, and the windows of anchors that were cut into lanes.

    Rows: s1, s2, a, b, owner; or w1, w2, owner and members.
    """
    schema = "s1 long, s2 long, a int, b int, owner long, w1 long, w2 long, members array<struct<s1:long,s2:long,o:int,hi:long>>"
    member = pa.list_(pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("o", pa.int32()), ("hi", pa.int64())]))
    names = ["s1", "s2", "a", "b", "owner", "w1", "w2", "members"]

    def plain(s1, s2, a, b, owner) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(owner), none, none, pa.nulls(len(a), member)], names=names)

    def flush(rows: list[np.ndarray], raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        lane, cut, open_, s1, s2, lo, hi, lengths, at = rows
        many = np.bincount(lane)[lane] > 1
        single = np.flatnonzero(~many & ~cut & (lo < hi) & (lengths >= width))
        yield plain(s1[single], s2[single], np.zeros(len(single), np.int64), lengths[single] - width, lo[single])
        use = np.flatnonzero(many | cut)
        if not len(use):
            return
        # lanes of like length together, so that no step has only a few of them
        total = np.bincount(lane, weights=lengths + 1)
        use = use[np.lexsort((use, lane[use], total[lane[use]]))]
        rounds = _whole_lanes(np.cumsum(lengths[use] + 1), lane[use], SORT_SYMBOLS)
        found: list[tuple[np.ndarray, ...]] = []  # windows of cut lanes: snippet, place, digest, smallest doc_id
        for k in range(int(rounds[-1]) + 1):
            part = use[rounds == k]
            if not len(part):
                continue
            where, place, group, symbols, starts = sort_lanes(raw, at[part], lengths[part], lane[part], width)
            if not len(where):
                continue
            least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, lo[part][where])
            owner = least[group]
            whole = ~cut[part][where]
            useful = whole & (owner < hi[part][where])
            s, a, b, o = _runs(where[useful], place[useful], owner[useful])
            yield plain(s1[part][s], s2[part][s], a, b, o)
            rest = np.flatnonzero(~whole)
            if len(rest):
                first = starts[where[rest]] + place[rest]
                found.append((part[where[rest]], place[rest], RangeHash(symbols).of(first, first + width), RangeHash(symbols, _BASE2).of(first, first + width), owner[rest]))
        if not found:
            return
        who, place, w1, w2, owner = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((w2, w1))
        who, place, w1, w2, owner = (c[order] for c in (who, place, w1, w2, owner))
        heads = _heads(w1, w2)
        sizes = np.diff(np.append(heads, len(who)))
        least = np.minimum.reduceat(owner, heads)
        owner = np.repeat(least, sizes)
        useful = ~open_[who] & (owner < hi[who])
        s, a, b, o = _runs(who[useful], place[useful], owner[useful])
        yield plain(s1[s], s2[s], a, b, o)
        # anchors that have lanes in other tasks too
        rest = np.flatnonzero(open_[who])
        if len(rest):
            g = np.repeat(np.arange(len(heads)), sizes)[rest]
            cuts = _heads(g)
            w = who[rest]
            parts = pa.StructArray.from_arrays([pa.array(s1[w]), pa.array(s2[w]), pa.array(place[rest].astype(np.int32)), pa.array(hi[w])], fields=list(member.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(rest)).astype(np.int32)), parts)
            null, null32 = pa.nulls(len(cuts), pa.int64()), pa.nulls(len(cuts), pa.int32())
            one = heads[g[cuts]]
            yield pa.RecordBatch.from_arrays([null, null, null32, null32, pa.array(least[g[cuts]]), signed(w1[one]), signed(w2[one]), lists.cast(member)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_bucket(batches):
            h, salt, s1, s2, lo, hi, size = (np.concatenate([from_planes(r[c], t) for r in held]) for c, t in zip(_PACKED, (np.uint64, np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64), strict=True))
            if not len(h):
                continue
            raw, at = np.frombuffer(b"".join([r["bytes"] for r in held]), np.uint8), np.cumsum(size) - size
            stands = np.concatenate([from_planes(r["stands"], np.uint64) for r in held])
            order = np.lexsort((s2, s1, salt, h))
            h, salt, s1, s2, lo, hi, size, at = (c[order] for c in (h, salt, s1, s2, lo, hi, size, at))
            new = _heads(h, salt, s1, s2)
            lo, hi = np.minimum.reduceat(lo, new), np.maximum.reduceat(hi, new)
            h, salt, s1, s2, size, at = (c[new] for c in (h, salt, s1, s2, size, at))
            lanes = _heads(h, salt)
            counts = np.diff(np.append(lanes, len(h)))
            many = np.repeat(counts, counts)
            open_ = (salt >= 0) | np.isin(h, stands)
            cut = open_ | (many > 2 * block)
            part = np.where(cut, (np.arange(len(h)) - np.repeat(lanes, counts)) // block, 0)
            lane = np.cumsum(np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (part[1:] != part[:-1]))) - 1
            yield from flush([lane, cut, open_, s1.view(np.int64), s2.view(np.int64), lo, hi, size, at], raw)

    return deal(packed).mapInArrow(run, schema)


def _whole_lanes(size: np.ndarray, lane: np.ndarray, limit: int) -> np.ndarray:
    """Round of each element: by its lane's last running size, so that lanes stay whole."""
    ends = np.append(np.flatnonzero(lane[1:] != lane[:-1]), len(lane) - 1)
    counts = np.diff(np.append(-1, ends))
    return np.repeat(size[ends] // limit, counts)


def covered(texts: DataFrame) -> DataFrame:
    """t1, t2, d, n_bytes, n_removed, n_spans and kept_sha256 of texts (t1, t2, d, text, spans: list of start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_bytes(batch.column("text"))
            out = []
            for r, spans in enumerate(batch.column("spans")):
                text = raw[off[r] : off[r + 1]]
                pairs = spans.values
                if pairs is None or not len(pairs):
                    out.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
                    continue
                start, end = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                change = np.bincount(start, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1)
                gone = np.cumsum(change[:-1]) > 0
                spans_n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(text), int(gone.sum()), spans_n, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t1", "t2", "d")), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["t1", "t2", "d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("t1", "t2", "d", "text", "spans").mapInArrow(run, "t1 long, t2 long, d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, size: int = ANCHOR, local: int = LOCAL, block: int = BLOCK_SNIPPETS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    h = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    classes = keyed.select("d", *h, "text").groupBy("t1", "t2").agg(F.min("d").alias("d"), F.min_by("text", "d").alias("text"))
    texts = materialize(classes.withColumn("u", F.monotonically_increasing_id()))
    hashes = materialize(shared_anchors(texts, width, size, local))
    with_hashes = materialize(texts.join(hashes, "u", "left"))
    buckets = bucket_count(docs.sparkSession, hashes.agg(F.sum(F.size("hashes"))).first()[0] or 0, 200_000)
    release(texts, hashes)
    windows = materialize(sorted_windows(packed_snippets(with_hashes, width, size, buckets, block), width, block))
    found = materialize(occurrences(with_hashes, width, size))
    own = windows.where("s1 is not null").select("s1", "s2", "a", "b", "owner")
    parts = windows.where("w1 is not null").select("w1", "w2", "owner", "members")
    met = parts.groupBy("w1", "w2").agg(F.min("owner").alias("owner"))
    across = (
        parts.select("w1", "w2", "members")
        .join(met, ["w1", "w2"])
        .select("owner", F.explode("members").alias("m"))
        .where(F.col("owner") < F.col("m.hi"))
        .select("m.s1", "m.s2", F.col("m.o").alias("a"), F.col("m.o").alias("b"), "owner")
    )
    spans = materialize(
        found.join(own.union(across), ["s1", "s2"])
        .where("owner < d")
        .select("u", F.struct((F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.col("b") + width).alias("end")).alias("span"))
        .groupBy("u")
        .agg(F.collect_list("span").alias("spans"))
    )
    release(windows, found)
    judged = materialize(covered(with_hashes.join(spans, "u", "left"))).withColumnRenamed("d", "first")
    release(with_hashes, spans)
    copy = (F.col("d") > F.col("first")) & (F.col("n_bytes") >= width)
    return keyed.select("d", *h).join(judged, ["t1", "t2"]).select(
        F.when(F.col("d") != _NULL_ID, F.col("d")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
