"""Operator 8: n-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct shingles of `width` words (fewer words: the whole sequence as
one; none: the empty set, linked with nothing). Two documents link when their sets' Jaccard
similarity is `similarity` or more.

Equal sets are one class with the smallest doc_id for it. Sizes are cut into bands so narrow that
linked sets lie in the same band or in neighbours; a set signs for its band and the next. Linked sets
of a band differ in at most k features, so of k + 1 + s partitions of the feature domain s + 1 at
least hold the same features in both: a signature is the hash of one partition's features, and linked
sets share one.

Within the sets of one signature only one, the pivot, is compared with all others: the set whose
signatures have the most sets, which is the middle of a group of near copies. Sets that are not linked
with it get a pivot among themselves, PIVOT_ROUNDS times, so that several groups under one signature
are each connected through their own middle. Where a signature then still has sets of different
components, two of its sets are compared if they also share one of their rarest features, as many as
linked sets must share one of (see rare_features()), and if its places in both, their sizes and their
parity maps leave a link possible: the features before the first shared one are in one set only (see
placed_features()), so sets that have too many of their own do not meet. Passages that many documents
repeat are frequent and so hardly ever among the rarest. Every compared pair is verified on whole texts,
and no link between components is missed. Within a component no pairs are made; components meet by the
sizes of their sets that have a feature, and only of sizes that may be linked the sets themselves.

Null and empty texts have the empty set. Null doc_ids count as the smallest id and are shown as null.
Rows that repeat a doc_id count as one document with the links of all of them. An empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import RangeHash, blocks, bucket_count, from_planes, materialize, meeting_keys, mix, planes, release, signed, table, text_bytes

#: Partitions of the domain tried for sets that leave too many parts of it empty.
TURNS = 6
#: Times that the sets of a signature not linked with its pivot get one among themselves.
PIVOT_ROUNDS = 3
#: Slots, by hash, in which sets are counted to tell rare features (four bytes each in every task).
COUNT_SLOTS = 1 << 20
#: Bits of a set's parity map.
MAP_BITS = 256
_MAP = [f"m{i}" for i in range(MAP_BITS // 64)]
_NULL_ID = -(1 << 63)

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x41:0x5B] += 0x20


def shingles(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of distinct shingles, sorted by both."""
    raw, off = _SMALL[raw[off[0] : off[-1]]], off - off[0]
    n = len(off) - 1
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[off] = True
    edge[0] = edge[-1] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    if len(raw):
        word = inside[start]
        start, end = start[word], end[word]
    row = np.searchsorted(off, start, side="right") - 1
    counts = np.bincount(row, minlength=n)
    run = RangeHash(RangeHash(raw).of(start, end))
    first = np.arange(max(0, len(start) - width + 1))
    first = first[row[first] == row[first + width - 1]]
    few = np.flatnonzero((counts > 0) & (counts < width))
    few_first = (np.cumsum(counts) - counts)[few]
    rows = np.concatenate([row[first], few])
    hashes = np.concatenate([run.of(first, first + width), run.of(few_first, few_first + counts[few])])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


class Bands:
    """Size bands for a similarity given in percent; grown as sizes are asked for."""

    def __init__(self, percent: int):
        self.percent = percent
        self.least = [1]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while self.least[-1] <= int(sizes.max(initial=1)) * 100 // self.percent:
            self.least.append(self.least[-1] * 100 // self.percent + 1)
        return np.searchsorted(self.least, sizes, side="right") - 1

    def differing(self, band: np.ndarray) -> np.ndarray:
        """Most features in which linked sets of this band, or of it and the one before, differ."""
        most = np.array(self.least)[band] * 100 // self.percent
        return 2 * most * (100 - self.percent) // (100 + self.percent)


def signatures(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Rows and signatures of all sets, from their features and sizes.

    Partitions without features sign nothing while they are no more than the spare ones: of the
    partitions that linked sets share, one has features then. Sets with more of them sign again by
    another partition of the domain, so that two such sets meet there, and at the last by all.
    """
    out_rows, out = [], []
    own = bands.of(sizes)
    beyond = bands.of(sizes * 100 // bands.percent) > own
    for band, signs in ((own, sizes > 0), (own + 1, (sizes > 0) & beyond)):
        k = bands.differing(np.minimum(band, len(bands.least) - 1))
        spare = 1 + k // 12
        open_ = signs & (k > 0)  # k = 0: only equal sets link
        for turn in range(TURNS):
            parts = np.where(open_, k + 1 + spare, 0)
            if not parts.any():
                break
            base = np.cumsum(parts) - parts
            use = parts[rows] > 0
            r, h = rows[use], hashes[use]
            own_seed = mix(band.astype(np.uint64) * np.uint64(TURNS) + np.uint64(turn + 1))
            seed = own_seed[r]
            place = base[r] + (mix(h ^ seed) % parts[r].astype(np.uint64)).astype(np.int64)
            total = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(total, place, mix(h + seed))
            filled = np.zeros(len(total), bool)
            filled[place] = True
            row = np.repeat(np.arange(len(sizes)), parts)
            few = np.bincount(row, weights=~filled, minlength=len(sizes)) <= spare
            part = (np.arange(len(total)) - base[row]).astype(np.uint64)
            signature = mix(total ^ mix(own_seed[row] + part))
            give = filled if turn + 1 < TURNS else filled | ~few[row]
            out_rows.append(row[give])
            out.append(signature[give])
            open_ = open_ & ~few
    return np.concatenate([np.zeros(0, np.int64), *out_rows]), np.concatenate([np.zeros(0, np.uint64), *out])


def _hashed_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By block of a batch (text): its row range, the features' rows and hashes, and the sets' sizes and hash sums."""
    raw, off = text_bytes(batch.column("text"))
    for a, b in blocks(off):
        rows, hashes = shingles(raw, off[a : b + 1], width)
        sums = np.zeros((2, b - a), np.uint64)
        for i in (0, 1):
            np.add.at(sums[i], rows, mix(hashes + np.uint64(i + 1)))
        yield a, b, rows, hashes, np.bincount(rows, minlength=b - a), sums


def _class_id(sums: np.ndarray) -> np.ndarray:
    return mix(sums[0] ^ mix(sums[1])).view(np.int64)


def hashed_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc, n (set size), h1, h2 (hash of the set) and class (64 bits of them) for each row of docs (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, _, sizes, sums in _hashed_sets(batch, width):
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), pa.array(sizes), *(pa.array(s.view(np.int64)) for s in sums), pa.array(_class_id(sums))], names=["doc", "n", "h1", "h2", "class"])

    return docs.mapInArrow(run, "doc long, n long, h1 long, h2 long, class long")


def class_signatures(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """sig, class: signatures that two classes of docs (text) or more share. Copies give theirs once a batch."""

    def own_signatures(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bands = Bands(percent)
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, rows, hashes, sizes, sums in _hashed_sets(batch, width):
            own = _class_id(sums)
            _, first = np.unique(own, return_index=True)
            kept = np.zeros(len(own), bool)
            kept[first] = True
            use = kept[rows]
            at, sigs = signatures(rows[use], hashes[use], np.where(kept, sizes, 0), bands)
            keys.append(sigs)
            ids.append(own[at])
        return np.concatenate(keys), np.concatenate(ids)

    met = meeting_keys(docs.select("text"), own_signatures, buckets, repeats=True)
    return met.select(F.col("key").alias("sig"), F.col("id").alias("class")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (a, b) with linked (similar enough)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [text_bytes(batch.column(x)) for x in ("ta", "tb")]
            cuts = sorted({x for _, off in sides for pair in blocks(off) for x in pair})
            for a, b in zip(cuts, cuts[1:], strict=False):
                (ra, ha), (rb, hb) = (shingles(raw, off[a : b + 1], width) for raw, off in sides)
                n = b - a
                r, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                shared = np.bincount(r[1:][(r[1:] == r[:-1]) & (h[1:] == h[:-1])], minlength=n)
                union = np.bincount(r, minlength=n) - shared
                linked = (100 * shared >= percent * union) & (shared > 0)
                yield pa.RecordBatch.from_arrays([batch.column("a").slice(a, n), batch.column("b").slice(a, n), pa.array(linked)], names=["a", "b", "linked"])

    # b first: a pivot's text is then not sent with each of its pairs
    rows = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """doc, comp: the smallest id that links (a, b) reach from each linked doc."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("comp")))
    before = None
    while True:
        total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            release(both)
            return labels
        before = total
        near = both.join(labels.withColumnRenamed("doc", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(near, labels.doc == near.a).select("doc", F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("doc").alias("comp"), F.col("comp").alias("next"))
        lower = materialize(low.join(jump, "comp", "left").select("doc", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        release(labels)
        labels = lower


def against_pivots(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """All links (a, b) with pivots, from members (sig, doc)."""
    left, links = members, []
    for _ in range(PIVOT_ROUNDS):
        inside = left.join(left.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"), "sig")
        weights = inside.groupBy("doc").agg(F.sum("c").alias("weight"))
        pivots = inside.join(weights, "doc").groupBy("sig").agg(F.max_by("doc", F.struct("weight", -F.col("doc"))).alias("a"))
        pairs = inside.select("sig", F.col("doc").alias("b")).join(pivots, "sig").where("a != b")
        linked = materialize(verified(pairs.select("a", "b").distinct(), texts, width, percent).where("linked").select("a", "b"))
        links.append(linked)
        after = materialize(pairs.join(linked, ["a", "b"], "left_anti").select("sig", F.col("b").alias("doc")))
        if left is not members:
            release(left)
        left = after
        if left.isEmpty():
            break
    release(left)
    return reduce(DataFrame.union, links)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % COUNT_SLOTS


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    """In how many sets of texts (text) the features of each slot are: COUNT_SLOTS numbers, whatever the input."""
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_SLOTS, np.int64)
        for batch in batches:
            for _, _, _, hashes, _, _ in _hashed_sets(batch, width):
                total += np.bincount(_slots(hashes), minlength=COUNT_SLOTS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([planes(x) for x in total.reshape(parts, -1)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + from_planes(counts)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    whole = np.zeros((parts, COUNT_SLOTS // parts), np.int64)
    for row in texts.select("text").mapInArrow(count, "part int, counts binary").repartition(parts, "part").mapInArrow(add, "part int, counts binary").collect():
        whole[row["part"]] = np.frombuffer(bytes(row["counts"]), np.int64)
    return np.minimum(whole.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def _rarest(rows: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes and ranks of each set's rarest features, as many as linked sets share one of."""
    order = np.lexsort((hashes, counts[_slots(hashes)], rows))
    rows, hashes = rows[order], hashes[order]
    rank = np.arange(len(rows)) - (np.cumsum(sizes) - sizes)[rows]
    kept = rank < (sizes + -sizes * percent // 100 + 1)[rows]
    return rows[kept], hashes[kept], rank[kept]


def rare_features(texts: DataFrame, counts: np.ndarray, width: int, percent: int, buckets: int) -> DataFrame:
    """key, doc: features that two of texts (doc, text) or more have among their rarest.

    Linked sets share at least s * n features of a set of n. With all features in one order, the first
    n - s * n + 1 of each then hold a shared one. The order is by the count of a feature's slot, so that
    frequent features come last; it decides what is compared, never what is linked.
    """

    def own_rarest(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        doc = batch.column("doc").to_numpy()
        keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, _, rows, hashes, sizes, _ in _hashed_sets(batch, width):
            rows, hashes, _ = _rarest(rows, hashes, sizes, counts, percent)
            keys.append(mix(hashes))
            ids.append(doc[a + rows])
        return np.concatenate(keys), np.concatenate(ids)

    return meeting_keys(texts.select("doc", "text"), own_rarest, buckets, repeats=True).withColumnRenamed("id", "doc")


def placed_features(texts: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """key, doc, n (set size) and over for the rarest features of each of texts (doc, text).

    Of the features in a set before the first that it shares with another, by the order of rare_features(),
    the other has none. With r of them and sizes n and m, linked sets keep percent * m <= percent * n - over,
    where over = (100 + percent) * r - (100 - percent) * n, and the same the other way round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for a, _, rows, hashes, sizes, _ in _hashed_sets(batch, width):
                rows, hashes, rank = _rarest(rows, hashes, sizes, counts, percent)
                yield pa.RecordBatch.from_arrays([signed(mix(hashes)), pa.array(doc[a + rows]), pa.array(sizes[rows]), pa.array((100 + percent) * rank - (100 - percent) * sizes[rows])], names=["key", "doc", "n", "over"])

    return texts.select("doc", "text").mapInArrow(run, "key long, doc long, n long, over long")


def parity_maps(texts: DataFrame, width: int) -> DataFrame:
    """doc, n (set size) and the parity map of the set for each of texts (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows, hashes, sizes, _ in _hashed_sets(batch, width):
                n = b - a
                parity = np.bincount(rows * MAP_BITS + (mix(hashes) % np.uint64(MAP_BITS)).astype(np.int64), minlength=n * MAP_BITS).reshape(n, -1) & 1
                bits = np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, n), pa.array(sizes), *(pa.array(bits[:, i].copy()) for i in range(len(_MAP)))], names=["doc", "n", *_MAP])

    return texts.select("doc", "text").mapInArrow(run, "doc long, n long, " + ", ".join(f"{c} long" for c in _MAP))


def beside_pivots(members: DataFrame, texts: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: documents of different groups (doc, comp) that share a signature of members (sig, doc) and a rare feature, and may be linked."""
    grouped = members.join(groups, "doc", "left").select("sig", "doc", F.coalesce("comp", "doc").alias("comp"))
    apart_sigs = grouped.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    open_ = materialize(grouped.join(apart_sigs, "sig").select("sig", "doc", "comp"))
    own = open_.select("doc", "comp").distinct()
    open_texts = materialize(texts.join(own.select("doc"), "doc", "left_semi"))
    counts = slot_counts(open_texts, width)
    buckets = bucket_count(texts.sparkSession, int(counts.sum(dtype=np.int64)) * (100 - percent) // 100)
    hits = materialize(rare_features(open_texts, counts, width, percent, buckets).join(own, "doc"))
    mixed = hits.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    met = materialize(hits.join(mixed, "key"))
    release(hits)
    met_texts = open_texts.join(met.select("doc").distinct(), "doc", "left_semi")
    placed = materialize(met.join(placed_features(met_texts, counts, width, percent), ["key", "doc"]).groupBy("key", "doc", "comp", "n").agg(F.min("over").alias("over")))
    release(met)
    # groups first, by the sizes of their sets, so that rows of one group do not meet each other; of a pair that may be linked one side at least is not over
    sizes = materialize(placed.groupBy("key", "comp", "n").agg(F.min("over").alias("over")))
    side = lambda rows, c, *more: rows.select("key", *(F.col(x).alias(f"{x}{c}") for x in ("comp", "n", "over", *more)))
    fits = f"{percent} * ny <= {percent} * nx - overx AND {percent} * nx <= {percent} * ny - overy"
    sides = side(sizes.where("over <= 0"), "x").join(side(sizes, "y"), "key").where(f"compx != compy AND (overy > 0 OR compx < compy) AND {fits}").drop("overx", "overy")
    near = sides.join(side(placed, "x", "doc"), ["key", "compx", "nx"]).join(side(placed, "y", "doc"), ["key", "compy", "ny"]).where(fits)
    candidates = materialize(near.select(F.least("docx", "docy").alias("a"), F.greatest("docx", "docy").alias("b")).distinct())
    release(placed, sizes)
    named = candidates.select(F.col("a").alias("doc")).union(candidates.select("b")).distinct()
    maps = materialize(parity_maps(open_texts.join(named, "doc", "left_semi"), width))
    release(open_texts)
    of = lambda c: maps.select(*(F.col(x).alias(f"{x}_{c}") for x in maps.columns)).withColumnRenamed(f"doc_{c}", c)
    # features in one set only: no fewer than the bits in which the parity maps differ
    apart = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in _MAP), F.lit(0))
    share = (100 - percent) / (100 + percent)
    pairs = materialize(candidates.join(of("a"), "a").join(of("b"), "b").where(apart <= share * (F.col("n_a") + F.col("n_b")) + 1).select("a", "b").distinct())
    release(maps, candidates)
    signed_pairs = pairs.join(open_.select("sig", F.col("doc").alias("a")), "a").join(open_.select("sig", F.col("doc").alias("b")), ["sig", "b"], "left_semi")
    out = materialize(signed_pairs.select("a", "b").distinct())
    release(open_, pairs)
    return out


def link(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text)."""
    docs = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), "text")
    sets = materialize(hashed_sets(docs, width))
    classes = materialize(sets.where("n > 0").groupBy("class", "h1", "h2").agg(F.min("doc").alias("rep")))
    size = sets.agg(F.sum("n")).first()[0] or 0
    # sets whose hashes share 64 bits are told apart again by the texts
    met = class_signatures(docs, width, percent, bucket_count(docs.sparkSession, size // 4))
    members = materialize(met.join(classes.select("class", F.col("rep").alias("doc")), "class").select("sig", "doc").distinct())
    texts = materialize(docs.join(members.select("doc").distinct(), "doc", "left_semi"))
    labels = components(against_pivots(members, texts, width, percent))
    pairs = beside_pivots(members, texts, labels, width, percent)
    release(members)
    if not pairs.isEmpty():
        rest = materialize(verified(pairs, texts, width, percent).where("linked").select("a", "b"))
        comp = lambda c: labels.select(F.col("doc").alias(c), F.col("comp").alias(f"c{c}"))
        between = rest.join(comp("a"), "a", "left").join(comp("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(between).select(F.col("doc").alias("own"), F.col("comp").alias("least"))
        alone = rest.select(F.col("a").alias("doc")).union(rest.select("b")).distinct().join(labels, "doc", "left_anti").withColumn("comp", F.col("doc"))
        merged = labels.union(alone).withColumnRenamed("comp", "own").join(joined, "own", "left").select("doc", F.coalesce("least", "own").alias("comp"))
        whole = materialize(merged)
        release(labels, rest)
        labels = whole
    release(pairs, texts)
    named = sets.join(classes.drop("class"), ["h1", "h2"], "left").join(labels.withColumnRenamed("doc", "rep"), "rep", "left")
    shown = F.when(F.col("n") > 0, F.coalesce("comp", "rep")).otherwise(F.col("doc"))
    plain = lambda c: F.when(c != _NULL_ID, c)
    return named.select(plain(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), plain(shown).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), walk AS (
  SELECT doc_id, doc_id AS reached FROM documents UNION SELECT walk.doc_id, e.b FROM walk JOIN e ON e.a = walk.reached
)
SELECT walk.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM walk LEFT JOIN n ON n.doc_id = walk.doc_id GROUP BY walk.doc_id
"""
