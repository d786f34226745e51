"""Operator 2: language identification by cross-parsing entropy.

For each learned language a suffix automaton of labelled text is made. A text is parsed greedily into
longest matches with that text; the language with the fewest phrases per symbol wins (of equal ones
the first by name). Symbols are UTF-8 bytes of the lower-cased text, where each run of ASCII other
than letters is one space. A long text is parsed in stretches of STRETCH symbols, which adds at most
one phrase to each for every language alike.

Learning reads a bounded sample: for each language at most EXCERPTS excerpts of EXCERPT_CHARS
characters, taken by hash from rows with non-null text and language. `score` is
second / (best + second), of the phrase counts of the two best languages: 0.5 is undecided; with one
learned language it is 1 less the phrases per symbol.

`und` with score 0 is given to null texts, to texts without letters, and to all if nothing could be
learned. Repeated rows get the same answer each; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import blocks, table, text_bytes

EXCERPTS, EXCERPT_CHARS, STRETCH = 128, 400, 2048
UNDETERMINED = "und"


def held_out(column: str = "doc_id"):
    """Rows that learning must not see: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small letters and bytes from 0x80 on, with runs of anything else as one space; and the rows' new offsets."""
    raw, off = raw[off[0] : off[-1]], off - off[0]
    keep = ((raw >= 0x61) & (raw <= 0x7A)) | (raw >= 0x80)
    before = np.zeros(len(raw), bool)
    before[1:] = keep[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    before[first] = False
    both = keep | before
    out = np.where(keep, raw, np.uint8(0x20))[both]
    places = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(both, out=places[1:])
    return out, places[off]


class SuffixAutomaton:
    """The smallest automaton that accepts all substrings of some symbols."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] != length[p] + 1:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        return new


class CrossParser:
    """Automata of all languages in one table: step[state, symbol] = 2 * next state, plus 1 where a phrase begins.

    Each language also has a void state, its last, in which no phrase is open: texts begin there, and
    symbols that the language lacks, which are phrases of their own, lead there.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        seen = sorted(set().union(*(set(t) for t in texts.values())))
        self.width = len(seen) + 1
        self.code = np.full(256, len(seen), np.uint8)  # the last code is of unknown symbols
        self.code[seen] = np.arange(len(seen))
        parts, self.void, base = [], [], 0
        for lang in self.langs:
            automaton = SuffixAutomaton(texts[lang])
            n = len(automaton.next)
            rows = np.repeat(np.arange(n), [len(x) for x in automaton.next])
            cols = self.code[np.fromiter((c for x in automaton.next for c in x), np.int64, len(rows))]
            to = np.fromiter((t for x in automaton.next for t in x.values()), np.int64, len(rows)) + base
            begin = np.full(self.width, 2 * (base + n) + 1, np.int64)
            at_root = rows == 0
            begin[cols[at_root]] = 2 * to[at_root] + 1
            step = np.tile(begin, (n + 1, 1))
            step[rows, cols] = 2 * to
            parts.append(step)
            self.void.append(base + n)
            base += n + 1
        self.step = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int64)
        if base < 1 << 30:
            self.step = self.step.astype(np.int32)

    def _parse(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in each stretch (first axis) for each language, from the given states on, and the last states."""
        order = np.argsort(-length, kind="stable")
        start, length, state = start[order], length[order], state[order]
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
        count = np.zeros(state.shape, np.int64)
        for t in range(longest):
            n = active[t]
            got = self.step[state[:n] * self.width + codes[start[:n] + t][:, None]]
            count[:n] += got & 1
            state[:n] = got >> 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return count[back], state[back]

    def phrases(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrase counts of each row (first axis) for each language."""
        sizes = np.diff(off)
        lanes = -(-sizes // STRETCH)
        row = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = off[row] + nth * STRETCH
        length = np.minimum(off[row + 1] - start, STRETCH)
        k = len(self.langs)
        begun = np.repeat(np.array(self.void, np.int64)[None], len(row), 0)
        count, last = self._parse(codes, start, length, begun)
        later = np.flatnonzero(nth > 0)
        while True:  # a stretch that began in another state than the one before it ends in is parsed again
            again = later[(last[later - 1] != begun[later]).any(1)]
            if not len(again):
                break
            begun[again] = last[again - 1]
            count[again], last[again] = self._parse(codes, start[again], length[again], begun[again])
        out = np.zeros((len(sizes), k), np.int64)
        np.add.at(out, row, count)
        return out


_PARSERS: dict[int, CrossParser] = {}


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Symbols of the sampled excerpts by language, from docs (text, lang): a bounded sample, so it is collected."""
    h = F.xxhash64("text")
    excerpt = F.substring("text", (F.lit(1) + F.pmod(h, F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(1)))).cast("int"), F.lit(EXCERPT_CHARS))
    rows = (
        docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(EXCERPTS)).alias("part"), h.alias("h"), F.lower(excerpt).alias("excerpt"))
        .groupBy("lang", "part")
        .agg(F.min_by("excerpt", F.struct("h", "excerpt")).alias("excerpt"))
        .orderBy("lang", "part")
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for r in rows:
        texts.setdefault(r.lang, []).append(r.excerpt)
    return {lang: symbols(*text_bytes(pa.array([" ".join(parts)])))[0].tobytes() for lang, parts in texts.items()}


def identify(docs: DataFrame, texts: dict[str, bytes], carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrase_rate (phrases per symbol of the winner) and n_symbols for each row of docs.

    With `carry` all columns of docs stay before them, but for held_out.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(texts)
    kept = [*docs.columns] if carry else ["doc_id", "held_out"]
    names = [*kept, "lang_pred", "score", "phrase_rate", "n_symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(model.value.items())))
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = CrossParser(model.value)
        parser = _PARSERS[key]
        langs = np.array([*parser.langs, UNDETERMINED], object)
        for batch in batches:
            raw, off = text_bytes(batch.column(len(kept) + 1))
            letters = batch.column(len(kept)).to_numpy(zero_copy_only=False)
            for a, b in blocks(off, 4 << 20):
                sym, at = symbols(raw, off[a : b + 1])
                size = np.maximum(np.diff(at), 1)
                if len(parser.langs):
                    counts = parser.phrases(parser.code[sym], at)
                    best = counts.argmin(1)
                    ranked = np.sort(counts, 1).astype(float)
                    rate = ranked[:, 0] / size
                    score = ranked[:, 1] / np.maximum(ranked[:, 0] + ranked[:, 1], 1) if len(parser.langs) > 1 else 1 - np.minimum(rate, 1)
                else:
                    best, rate, score = np.zeros(b - a, int), np.ones(b - a), np.zeros(b - a)
                ok = letters[a:b].astype(bool) & (len(parser.langs) > 0) & (np.diff(at) > 0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(kept))), pa.array(langs[np.where(ok, best, len(langs) - 1)], pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(np.where(ok, rate, 1.0)), pa.array(np.diff(at))],
                    names=names,
                )

    rows = docs if carry else docs.select("doc_id", held_out().alias("held_out"), "text")
    low, letters = F.lower("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = rows.select(*(F.col(f"`{c}`") for c in kept), letters.alias("_letters"), low.alias("_low"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)])
    return rows.mapInArrow(run, schema + ", lang_pred string, score double, phrase_rate double, n_symbols long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs.where(~held_out())))
