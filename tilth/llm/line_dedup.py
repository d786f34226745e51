"""Operator 10: line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is a run of words (anything between ASCII white space). Two lines are near when their words
are equal or, with MIN_WORDS words at least on both sides, when one word inserted, deleted or
replaced makes them equal. A line is removed when a near line comes earlier, by (doc_id, text,
line number), in the same or another document; each line is judged against the input. Lines without
words are kept.

Each distinct line is one class with the place where it first occurs. A pair within one edit agrees
on its first or its last half, so classes that share neither with another class have no partner. All
other classes emit every variant with one word deleted, and themselves, as hashed keys. Lines that are
equal but for the word at one place meet the earliest of them; a line and those a word longer meet, but
the longer ones not each other, as they may be two edits apart: they meet the line, and it the earliest
of them. So the members of a key are all partners of the one they meet. The pair's edit distance is
verified on its words, and the later one goes. Groups are only ever reduced to their earliest members,
so a key of any size costs as many rows as it has. Kept lines return to the document of their class's
first place.

Null texts stay null. Repeated rows (same doc_id and text) are one document and all keep the same
lines. Null doc_ids come first. An empty table gives an empty result; other columns pass
through, but for n_lines and n_removed, which are made anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import materialize, release, setting, table

MIN_WORDS = 8
#: Line numbers are looked up by blocks of so many, so that long texts stay cheap.
BLOCK_LINES = 256
#: Kinds of keys: of a line as it is, of one with a word deleted, of one with a word left open.
WHOLE, SHORTER, OPEN = 0, 1, 2
#: Size of a scan from which on a small join side filters it by a Bloom filter.
_BLOOM = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


def has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r")) != ""


def words_of(line: Column) -> Column:
    """Words of a line that has some; white space other than single blanks between words is made so first."""
    odd = reduce(Column.__or__, (line.contains(x) for x in ("\t", "\x0b", "\f", "\r", "  ")), line.startswith(" ") | line.endswith(" "))
    return F.split(F.when(odd, F.btrim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line), " ")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether one word inserted, deleted or replaced, or none, makes two word arrays equal; one pass over the words."""
    longer = F.when(F.size(a) >= F.size(b), a).otherwise(b)
    other = F.when(F.size(a) >= F.size(b), b).otherwise(a)
    differ = F.zip_with(longer, other, lambda x, y: ~x.eqNullSafe(y))
    first = F.greatest(F.array_position(differ, True).cast("int"), F.lit(1))
    after = lambda words, start: F.slice(words, start, F.greatest(F.size(words) - start + 1, F.lit(0)))
    one_more = (F.size(longer) == F.size(other) + 1) & (after(longer, first + 1) == after(other, first))
    return F.when(F.size(a) == F.size(b), F.size(F.filter(differ, lambda d: d)) <= 1).otherwise(one_more)


def _halves(words: Column) -> Column:
    """Keys of the first and last halves, for partners of the same size, one less and one more."""
    n = F.size(words)
    keys = []
    for more in (0, 1):
        half = ((n + more - 1) / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), n + more, F.slice(words, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("last"), n + more, F.slice(words, n - half + 1, half)))
    return F.array(*keys)


def _variants(rows: DataFrame) -> DataFrame:
    """first, kind, k: keys of every line (first, words, front, back) and of its deletions.

    A line's key is the exclusive or of its words' hashes with their places, so the key of a deletion
    comes from running ones: words after the deleted one move a place forward. Each deletion gives two
    keys, one for partners a word shorter and, with the place in it, one for partners with another word
    there. A line that shares its front half with partners needs deletions behind it only, and one that
    shares its back half those before it.
    """
    here = F.transform("words", lambda w, i: F.xxhash64(w, i))
    ahead = F.transform("words", lambda w, i: F.xxhash64(w, i - 1))
    start = F.struct(F.lit(0).cast("long").alias("xor"), F.array(F.lit(0).cast("long")).alias("all"))
    step = lambda acc, x: F.struct(acc["xor"].bitwiseXOR(x).alias("xor"), F.concat(acc["all"], F.array(acc["xor"].bitwiseXOR(x))).alias("all"))
    running = lambda hashes: F.aggregate(hashes, start, step, lambda acc: acc["all"])
    last = F.size("words") - 1
    half = (last / 2).cast("int")
    places = F.when(F.col("front") & F.col("back"), F.sequence(F.lit(0), last)).when(F.col("front"), F.sequence(half, last)).when(F.col("back"), F.sequence(F.lit(0), last - half)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("first", here.alias("here"), ahead.alias("ahead"), places.alias("places")).select("first", "here", "places", running(F.col("here")).alias("a"), running(F.col("ahead")).alias("b"))
    whole, end = F.element_at("a", -1), F.element_at("b", -1)
    key = lambda kind, k: F.struct(F.lit(kind).cast("byte").alias("kind"), k.alias("k"))
    shorter = F.transform("places", lambda p: key(SHORTER, F.xxhash64(F.lit(-1), F.get("a", p).bitwiseXOR(end).bitwiseXOR(F.get("b", p + 1)))))
    other = F.transform("places", lambda p: key(OPEN, F.xxhash64(p, whole.bitwiseXOR(F.get("here", p)))))
    return rows.select("first", F.inline(F.concat(F.array(key(WHOLE, F.xxhash64(F.lit(-1), whole))), shorter, other)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"), "text")


def line_classes(keyed: DataFrame) -> DataFrame:
    """h1, h2 (hash of the words), first (document and number of the first such line) and k0 to k3, keys of its halves (NULL for short lines)."""
    lines = keyed.select("d", "t", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.where(has_words(F.col("line"))).select(F.struct("d", "t", "n").alias("first"), words_of(F.col("line")).alias("words"))
    halves = F.when(F.size("words") >= MIN_WORDS, _halves(F.col("words")))
    k = [F.get("halves", F.lit(i)).alias(f"k{i}") for i in range(4)]
    h2 = F.when(F.col("halves").isNull(), F.xxhash64(F.lit(1), "words")).otherwise(F.xxhash64(F.get("halves", F.lit(0)), F.get("halves", F.lit(1))))
    return (
        lines.select("first", "words", F.xxhash64("words").alias("h1"), halves.alias("halves"))
        .select("h1", h2.alias("h2"), "first", *k)
        .groupBy("h1", "h2")
        .agg(F.min("first").alias("first"), *(F.max(f"k{i}").alias(f"k{i}") for i in range(4)))
    )


def lines_with_partners(classes: DataFrame) -> DataFrame:
    """d, t, ns: first places of the classes that share a half with another class, by document.

    front and back tell whether a class may be the longer of two partners, or as long, with that half
    shared.
    """
    keys = classes.where("k0 is not null").select("h1", "h2", F.posexplode(F.array(*(F.col(f"k{i}") for i in range(4)))).alias("i", "k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    partnered = keys.join(shared, "k", "left_semi").groupBy("h1", "h2").agg(F.bool_or(F.col("i") == 0).alias("front"), F.bool_or(F.col("i") == 1).alias("back"))
    rows = classes.select("h1", "h2", "first").join(partnered, ["h1", "h2"])
    return rows.groupBy("first.d", "first.t").agg(F.collect_list(F.struct("first.n", "front", "back")).alias("ns"))


def later_lines(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """first: the wanted lines that have an earlier near line among them, as a written frame."""
    rows = (
        keyed.join(wanted.where(F.size("ns") > 0), ["d", "t"])
        .select("d", "t", F.split("text", "\n").alias("all"), F.explode("ns").alias("w"))
        .select(F.struct("d", "t", "w.n").alias("first"), F.get("all", F.col("w.n")).alias("line"), "w.front", "w.back")
        .distinct()
    )
    with setting(keyed.sparkSession, _BLOOM, "1m"):  # documents without wanted lines stay out of the shuffle
        written = materialize(rows)
    candidates = written.select("first", words_of(F.col("line")).alias("words"), "front", "back")
    variants = materialize(_variants(candidates))
    is_whole = F.col("kind") == WHOLE
    leads = (
        variants.groupBy("k")
        .agg(F.min(F.when(is_whole, F.col("first"))).alias("whole"), F.min(F.when(~is_whole, F.col("first"))).alias("other"), F.count("*").alias("c"), F.max("kind").alias("most"))
        .where((F.col("c") > 1) & (F.col("whole").isNotNull() | (F.col("most") == OPEN)))
        .select("k", "whole", "other")
    )
    lead = F.when(F.col("kind") == SHORTER, F.col("whole")).otherwise(F.col("other"))
    pairs = variants.join(leads, "k").select("first", lead.alias("lead")).where("lead < first").distinct()
    later = materialize(
        pairs.join(candidates.select("first", F.col("words").alias("a")), "first")
        .join(candidates.select(F.col("first").alias("lead"), F.col("words").alias("b")), "lead")
        .where(within_one_edit(F.col("a"), F.col("b")))
        .select("first")
        .distinct()
    )
    release(written, variants)
    return later


def kept_lines(docs: DataFrame) -> DataFrame:
    """d, t (document), kept: map from block to numbers of the lines with words that stay, as a written frame."""
    keyed = _keyed(docs)
    classes = materialize(line_classes(keyed))
    wanted = materialize(lines_with_partners(classes))
    later = later_lines(keyed, wanted)
    release(wanted)
    kept = classes.select("first").join(later, "first", "left_anti").select("first.*")
    blocks = (
        kept.groupBy("d", "t", (F.col("n") / BLOCK_LINES).cast("int").alias("block"))
        .agg(F.collect_list("n").alias("ns"))
        .groupBy("d", "t")
        .agg(F.map_from_entries(F.collect_list(F.struct("block", "ns"))).alias("kept"))
    )
    out = materialize(blocks)
    release(classes, later)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with its lines deduplicated, and the columns n_lines and n_removed."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    keyed = _keyed(docs)
    stays = F.filter(F.split("text", "\n"), lambda line, i: F.coalesce(F.array_contains(F.col("kept")[(i / BLOCK_LINES).cast("int")], i), F.lit(False)) | ~has_words(line))
    out = (
        keyed.join(kept_lines(docs), ["d", "t"], "left")
        .select("d", "t", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"), stays.alias("lines"))
        .select("d", "t", F.array_join("lines", "\n").alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), F.size(F.coalesce("lines", F.array())).alias("n_kept"))
        .withColumn("n_removed", F.col("n_lines") - F.col("n_kept"))
        .drop("n_kept")
    )
    doc_id = F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id")
    if not others:
        return out.select(doc_id, "text", "n_lines", "n_removed")
    rest = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"))
    return rest.join(out.dropDuplicates(["d", "t"]), ["d", "t"]).select(doc_id, "text", "rest.*", "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, n, line, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL)
), c AS (
  SELECT words, min({'d': doc_id, 'n': n}) AS first FROM l WHERE len(words) > 0 GROUP BY words
), v AS (
  SELECT first, hash(-1, words) AS k FROM c WHERE len(words) >= 8
  UNION ALL SELECT first, hash(-1, words[:p - 1] || words[p + 1:]) FROM c, unnest(range(1, len(words) + 1)) AS u(p) WHERE len(words) >= 8
  UNION ALL SELECT first, hash(p, words[:p - 1] || words[p + 1:]) FROM c, unnest(range(1, len(words) + 1)) AS u(p) WHERE len(words) >= 8
), g AS (
  SELECT k, min(first) AS lead FROM v GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT first FROM v JOIN g USING (k) WHERE lead < first
), kept AS (
  SELECT first.d AS doc_id, first.n AS n FROM c WHERE first NOT IN (SELECT first FROM gone)
), r AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE len(words) > 0 AND kept.n IS NULL) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (WHERE len(words) = 0 OR kept.n IS NOT NULL), '') AS text
  FROM l LEFT JOIN kept ON kept.doc_id = l.doc_id AND kept.n = l.n GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN r.text END AS text, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN r USING (doc_id)
"""
