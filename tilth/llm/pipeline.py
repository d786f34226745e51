"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all rows it is given.

Null and empty texts go with the language stage, which finds no letters in them. Null doc_ids stay, and
come first where order decides; a null lang is filled in, a null source stays. Rows that repeat a doc_id
are told apart by number; rows that repeat a text are near copies, of which the first by doc_id stays.
Equally early rows are told apart by their place in the written table. An empty table gives empty
results. Columns beside those of documents pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from tilth.llm.common import materialize, table, unused

#: Shingle width and similarity (percent) of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A text of MIN_SYMBOLS or more with more phrases per symbol than this fits none of the learned languages.
MAX_PHRASE_RATE, MIN_SYMBOLS = 0.6, 20


_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's rows of docs, whose columns beside those of documents have names meanwhile that no operator uses."""
    names = {c: c if c in _OWN else f"_beside{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or unlike all languages go. A null lang is filled in."""

    def fitting(docs: DataFrame) -> DataFrame:
        named = language_id.identify(docs, language_id.learn(docs.where(~language_id.held_out())), carry=True)
        fits = (F.col("lang_pred") != language_id.UNDETERMINED) & ((F.col("phrase_rate") <= MAX_PHRASE_RATE) | (F.col("n_symbols") < MIN_SYMBOLS))
        return named.where(fits).withColumn("lang", F.coalesce("lang", "lang_pred"))

    return apart(docs, fitting)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines removed; those left without any word go."""
    out = line_dedup.dedup_lines(docs)
    return out.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, null doc_ids first; rows are told apart by number, as doc_ids can repeat."""
    row = unused("row", docs.columns)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    linked = jaccard_join.link(numbered.select(F.col(row).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    place = F.struct(F.col("doc_id").isNotNull(), "doc_id", row)
    stays = numbered.select("doc_id", row).join(linked.select(F.col("doc_id").alias(row), "component_id"), row).groupBy("component_id").agg(F.min(place).getField(row).alias(row))
    return numbered.join(stays.select(row), row, "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return apart(docs, lambda own: decontamination.scan(own, table(spark, sf_dir, "benchmark"), carry=True).where(~F.col("contaminated")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token pieces."""
    import public_tokenizers

    return packing.pack(docs, packing.tokenizer_encoder(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
