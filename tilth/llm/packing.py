"""Operator 6: bounded-space online best-fit packing of token sequences.

Each task packs the stream of its own documents with a fixed number of open sequences, held in a
bitset keyed by free space; when a piece fits none of them and all places are taken, the fullest
closes. Nothing is shuffled and a task holds one Arrow batch and the open sequences only. The pieces
of an Arrow batch arrive longest first, which leaves fewer gaps.

Null and empty texts are one piece of length 1 (the closing id 0). Repeated rows are packed each; an
empty table gives an empty result; extra columns of the input are not read. Texts of any length are
tokenized whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tilth.llm.common import table
from tilth.llm.token_counts import tokenizer

CAPACITY, OPEN_SEQUENCES, END_ID = 2048, 4096, 0
#: Characters that Python's split(), but not the tokenizer, takes as white space.
ODD = re.compile("[\x1c-\x1f\x85᠎]")
#: The word pattern and the normalisation of tokenizer files whose words are looked up (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD = regex.compile(PATTERN)
MEMO_CHARS, MEMO_CHUNKS = 48, 800_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class IdEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins across white space, so a text is the concatenation of its chunks, and
    a chunk met before is looked up. Chunks of Latin letters go to the model by the file's own
    normalisation and word pattern; any other chunk goes through the whole tokenizer, and so does every
    text where the file has another normalisation, pattern or special string.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        form = json.loads(self.tokenizer.to_str())
        splits = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = (
            (form["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and (splits[0]["pattern"], splits[0]["behavior"], splits[0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
            and all(t["content"].startswith("<|") for t in form["added_tokens"])
        )
        self.symbols = byte_symbols()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            mapped = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbols)
            found = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(word) <= MEMO_CHARS:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        if "<|" in chunk:
            return self.whole(chunk)
        if not chunk.isascii():
            try:
                chunk.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(chunk)
        return b"".join(map(self.word, WORD.findall(chunk.lower())))

    def encode(self, text: str) -> bytes:
        if not self.plain or ODD.search(text):
            return self.whole(text)
        chunks = text.split()
        known = self.chunks
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            long = {}
            for c in {*chunks}.difference(known):
                (known if len(c) <= MEMO_CHARS else long)[c] = self.chunk(c)
            out = b"".join([known[c] if c in known else long[c] for c in chunks])
        if len(known) > MEMO_CHUNKS:
            known.clear()
        if len(self.words) > MEMO_CHUNKS:
            self.words.clear()
        return out


class BestFit:
    """Open sequences by free space; place() gives the sequence number and the offset of a piece."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.bits, self.open, self.started = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.places:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.started, self.capacity
            self.started += 1
        if left := free - length:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], capacity: int = CAPACITY, places: int = OPEN_SEQUENCES) -> DataFrame:
    """One row for each piece of docs (doc_id, text).

    encoder() is called once a task and gives the function from a text to its ids as bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        first = TaskContext.get().partitionId() << 36
        bins = BestFit(capacity, places)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            pieces = []  # length, row, piece, start, crc
            for row, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    pieces.append((stop - start, row, piece, start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])))
            pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
            placed = [bins.place(p[0]) for p in pieces]
            cols = [np.array([p[i] for p in pieces], np.int64) for i in range(5)]
            at = [np.array([p[i] for p in placed], np.int64) for i in range(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(cols[1])), pa.array(cols[2].astype(np.int32)), pa.array(cols[3]), pa.array(cols[0]), pa.array(cols[4]), pa.array(at[0] + first), pa.array(at[1])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def tokenizer_encoder(path: str) -> Callable[[], Callable[[str], bytes]]:
    return lambda: IdEncoder(path).encode


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), tokenizer_encoder(public_tokenizers.path("word_bpe_49k.json")))
