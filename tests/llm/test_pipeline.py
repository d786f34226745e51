"""The pipeline keeps the columns of documents and what each stage decides takes effect."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.duck import DATA
from tests.llm.test_corpus import brute_components
from tilth.llm.common import materialize

SF = str(DATA / "sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        kept[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "jaccard_join":
            groups = brute_components({r.doc_id: r.text for r in before.collect()}, 5, 80)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in groups.items() if i == c}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "best_fit_packing"]
    assert kept["language_id"] == 200 and 100 < kept["decontamination"] <= kept["jaccard_join"] <= kept["line_dedup"] <= 200


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_rows_with_null_or_repeated_ids_stay(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (3, text("c")), (3, text("d")), (5, text("a")), (4, text("e")), (7, text("e")), (7, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, SF).collect()
    assert sorted(((r.doc_id or 0), r.text[0]) for r in got) == [(0, "a"), (0, "b"), (3, "c"), (3, "d"), (4, "e")]


def test_nulls_and_empty_tables(spark):
    text = lambda w: " ".join(f"{w}{x}" for x in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta"))
    rows = [(1, text("a"), "en", "s", 5), (None, text("b"), None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0), (4, "12 34", None, "s", 5), (5, text("a"), "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start, expected in ((docs, [None, 1]), (docs.where("false"), [])):
        out = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, out, SF))
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(expected, key=str)
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() == len(expected)


def test_columns_of_clashing_names_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    extra = ("lang_pred", "phrase_rate", "n_symbols", "_low", "contaminated", "n_words", "row", "lang_pred_", "odd name", "held_out", "n_hit", "h")
    wide = materialize(docs.withColumns({c: F.col("doc_id").cast("string") for c in extra}))
    plain = docs = materialize(wide.select(docs.columns))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide, plain = materialize(stage(spark, wide, SF)), materialize(stage(spark, plain, SF))
        assert wide.columns == [*docs.columns, *extra]
        assert sorted(map(tuple, wide.select(docs.columns).collect())) == sorted(map(tuple, plain.collect())), name
        assert wide.where(" or ".join(f"`{c}` != doc_id" for c in extra)).isEmpty()
