"""Operator 13: how far the sources of a language diverge, by dense term blocks.

Terms are runs of letters a-z (A-Z lower-cased) and of all characters beyond ASCII. A language keeps the V
terms that MIN_DOCS of its documents have. With count occurrences of a term in a (lang, source) group or
a language, and N of all kept terms there, its share is p = 1 + floor(UNIT * (count + 1) / (N + V)), and the
divergence of two shares is f = floor((p - q) * (p - q) / q).

Tasks count the terms of their documents, and one shuffle by term brings a term's counts of all sources
together. Kept terms are dealt into blocks of about BLOCK terms; a task makes of a block the int64 tile of shares,
groups by terms, broadcasts every group of it against all others and gives the sums of the pairs, and of
each group the TOP terms that it has more of than its language. Sums and tops of the blocks are merged after.
All numbers are integers: shares come from a long division in three steps, which is exact for N + V < 2**53.

Null text, lang and source are ''. Groups without terms have count 0 for all kept terms; where a language
keeps no term its pairs have the value 0. Repeated rows are documents of their own. An empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilth.llm.common import materialize, release, table

#: Documents of a language that must have a term; the unit of shares; terms shown of a group.
MIN_DOCS, UNIT, TOP = 3, 10**9, 200
#: Terms in a block, bytes of a text cut up at a time, and counts that a task holds before it gives them out.
BLOCK, PIECE, HELD = 4096, 1 << 20, 1 << 19
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a piece at a time; a piece ends between terms."""
    text = text.translate(_TERMS)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents) of the docs of a task, in parts."""
    names = ["lang", "source", "term", "n", "d"]

    def batch_of(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            found = sorted(n)
            if found:
                text = pa.array(found, pa.binary()).cast(pa.string())
                counts = (pa.array([c[t] for t in found], pa.int64()) for c in (n, d))
                same = (pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(found), np.int32)), pa.array([x])).dictionary_decode() for x in (lang, source))
                yield pa.RecordBatch.from_arrays([*same, text, *counts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            for value, lang, source in zip(text, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for part in terms(value.as_py()):
                    n.update(part)
                    own.update(part)
                d.update(own)
                size += len(n) - before
                if size > HELD:
                    yield from batch_of(held)
                    held, size = {}, 0
        yield from batch_of(held)

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, d long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total) for count < total < 2**53."""
    rest, out = count + 1, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    digits, rest = np.divmod(rest, total)  # one term may be all that there is
    out += digits * UNIT
    for unit in (10**6, 10**3, 1):
        digits, rest = np.divmod(rest * 1000, total)
        out += digits * unit
    return out + 1


def tile(kept: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial pair sums and top terms of one block: kept (term, sources, counts) beside the language's groups (source, n, v)."""
    source = groups["source"].to_pylist()
    lang, block = groups["lang"][0].as_py(), groups["block"][0].as_py()
    place = {s: i for i, s in enumerate(source)}
    n, v = groups["n"].to_numpy(), int(groups["v"][0].as_py())
    term = kept["term"].to_pylist()
    some = len(term) > 0
    size = len(source)
    out_source, out_part, out_item, out_value = [], [], [], []
    if some:
        lists = kept["sources"].combine_chunks()
        length = np.array([len(x) for x in lists], np.int64)
        count = np.zeros((size, len(term)), np.int64)
        row = np.array([place[s] for x in lists.to_pylist() for s in x], np.int64)
        count[row, np.repeat(np.arange(len(term)), length)] = [c for x in kept["counts"].to_pylist() for c in x]
        p = shares(count, (n + v)[:, None])
        whole = shares(count.sum(0), np.array(n.sum() + v))
    if some or not block:
        # pairs: every group as p, all groups as q; block 0 also stands in where a language keeps no term
        for i in range(size):
            value = ((p[i] - p) ** 2 // p).sum(1) if some else np.zeros(size, np.int64)
            for j in range(size):
                if j != i:
                    out_source.append(source[i])
                    out_part.append("pair")
                    out_item.append(source[j])
                    out_value.append(int(value[j]))
    if some:
        # places of the terms in UTF-8 order settle ties
        order = np.argsort(np.argsort(np.array([t.encode() for t in term], object)))
        for i in range(size):
            has = np.flatnonzero((count[i] > 0) & (p[i] > whole))
            value = (p[i][has] - whole[has]) ** 2 // whole[has]
            for k in np.lexsort((order[has], -value))[:TOP].tolist():
                out_source.append(source[i])
                out_part.append("term")
                out_item.append(term[has[k]])
                out_value.append(int(value[k]))
    m = len(out_source)
    return pa.table({"lang": pa.array([lang] * m, pa.string()), "source": pa.array(out_source, pa.string()), "part": pa.array(out_part, pa.string()), "item": pa.array(out_item, pa.string()), "value": pa.array(out_value, pa.int64())})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source)."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    # dealt by term once; both groupings below are within that
    parts = counted(docs).repartition("lang", "term")
    by_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = by_source.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("own"), F.sum("d").alias("d"))
    kept = materialize(by_term.where(F.col("d") >= MIN_DOCS).select("lang", "term", F.col("own.source").alias("sources"), F.col("own.n").alias("counts")))
    per_group = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("v"))
    every = docs.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    groups = materialize(every.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    blocks = 1 + kept.count() // BLOCK
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = materialize(dealt.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInArrow(tile, "lang string, source string, part string, item string, value long"))
    release(kept, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    top = tiles.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.unionByName(top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), k AS (
  SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), gn AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), w AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
  FROM c JOIN (SELECT lang, sum(total) AS total FROM gn GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), top AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN w USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM top)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
