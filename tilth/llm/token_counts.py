"""Operator 4: token counts by batch encoding in Arrow functions.

Null texts count as empty (0 tokens). Repeated rows are counted each; an empty table gives an empty
result; extra columns of the input are not read. Texts of any length are cut only before a run of
white space that follows other characters, where the tokenizer never joins, so the sum is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tilth.llm.common import blocks, table, text_bytes

#: A run of white space with the word after it: cuts before white space are safe.
CHUNK = re.compile(r"\s*\S+|\s+")
#: Characters that Python, but not the tokenizer, takes as white space.
ODD = re.compile("[\x1c-\x1f\x85\u180e]")
#: Longer chunks are encoded each time and not remembered; at most so many are remembered.
MEMO_CHARS, MEMO_CHUNKS = 48, 800_000
#: Bytes of text in one batch.
BATCH_BYTES = 4 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer in a file, loaded once for each Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class LengthEncoder:
    """Token counts of texts; lengths of chunks already met are kept, ids never are."""

    def __init__(self, path: str):
        self.encode_batch = tokenizer(path).encode_batch_fast
        self.known: dict[str, int] = {}

    def lengths(self, chunks: list[str]) -> list[int]:
        return [len(e.ids) for e in self.encode_batch(chunks, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        cut = [[t] if ODD.search(t) else CHUNK.findall(t) for t in texts]
        if len(self.known) > MEMO_CHUNKS:
            self.known.clear()
        fresh = set().union(*cut).difference(self.known)
        if fresh:
            fresh = list(fresh)
            self.known.update(zip(fresh, self.lengths(fresh), strict=True))
        get = self.known.__getitem__
        out = [sum(map(get, chunks)) for chunks in cut]
        for chunk in fresh:
            if len(chunk) > MEMO_CHARS:
                del self.known[chunk]
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LengthEncoder(tokenizer_path)
        for batch in batches:
            texts = batch.column("text")
            _, off = text_bytes(texts)
            counts: list[int] = []
            for a, b in blocks(off, BATCH_BYTES):
                counts += encoder.count([t or "" for t in texts.slice(a, b - a).to_pylist()])
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(off[1:] - off[:-1], pa.int64()), n, pc.greater(n, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
