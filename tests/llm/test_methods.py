"""What each method computes, against plain versions of it: parses, phrase counts, sets, covariances, ids, pairs compared."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_corpus import brute_components, extracted, near_copies, table
from tilth.llm import decontamination, fingerprints, html_extraction, jaccard_join, language_id, line_dedup, packing, quality, token_counts
from tilth.llm.common import text_bytes


def naive_phrases(text):
    """The Lempel-Ziv phrase set of a text."""
    known, i = set(), 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j] in known:
            j += 1
        known.add(text[i:j])
        i = j
    return known


def test_phrases_equal_a_naive_parse():
    rnd = random.Random(3)
    for n in [0, 1, 2, 30, 400, 3000]:
        text = "".join(rnd.choice("abé") for _ in range(n))
        assert set(fingerprints.Parse().feed(text).cuts()) == naive_phrases(text)
        cut = rnd.randint(0, n)
        head = fingerprints.Parse().feed(text[:cut])
        other = head.copy().feed(text[cut:])
        assert set(other.cuts()) == naive_phrases(text) and set(head.cuts()) == naive_phrases(text[:cut])


def test_likeness_estimates_the_overlap_of_phrase_sets(spark):
    """Mean error of likeness against the exact Jaccard similarity of phrase sets: 128 slots leave 0.04 or so."""
    texts = near_copies(4, 60, 200)
    rows = fingerprints.fingerprint(table(spark, texts)).collect()
    ids = sorted(texts)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    errors = []
    for r in rows:
        t, x = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        h = len(t) // 2
        own = naive_phrases(t)
        for got, other in ((r.near_next, naive_phrases(x)), (r.near_edited, naive_phrases(t[: len(t) - h] + x[:h]))):
            if len(own) > 60 and len(other) > 60:
                errors.append(abs(got - len(own & other) / len(own | other)))
    assert len(errors) > 80 and sum(errors) / len(errors) < 0.06


def naive_cross_parse(text: bytes, learned: bytes) -> int:
    """Phrases of a text: longest matches with the learned text, and single symbols that it lacks."""
    count = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in learned:
            n += 1
        count, i = count + 1, i + n
    return count


@pytest.mark.parametrize("stretch", [3, 7, 2048])
def test_cross_parsing_equals_a_naive_parser(monkeypatch, stretch):
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    rnd = random.Random(stretch)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n)).encode()
    learned = {"aa": word("abc ", 60), "bb": word("abd ", 90), "cc": b"b"}
    parser = language_id.CrossParser(learned)
    texts = [b"", b"x", b"axbxaxb", *(word("abcdx ", rnd.randint(1, 80)) for _ in range(60))]
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    got = parser.phrases(parser.code[np.frombuffer(b"".join(texts), np.uint8)], off)
    assert got.tolist() == [[naive_cross_parse(t, learned[k]) for k in parser.langs] for t in texts]


def test_a_lacking_symbol_costs_a_phrase(spark):
    texts = {"aa": b"abab ab ba", "zz": b"ab x ab ba"}
    assert language_id.identify(table(spark, {1: "axbxaxb"}), texts).first().lang_pred != "aa" or naive_cross_parse(b"axbxaxb", texts["aa"]) <= naive_cross_parse(b"axbxaxb", texts["zz"])
    tie = language_id.identify(table(spark, {1: "ab"}), {"b": b"ab", "a": b"ab"}).first()
    assert (tie.lang_pred, tie.score) == ("a", 0.5)


def test_discriminant_equals_dense_one():
    rnd = np.random.default_rng(1)
    x = {0: rnd.normal(size=(300, 3)) @ rnd.normal(size=(3, 3)), 1: rnd.normal(size=(200, 3)) + 1}
    model = quality.Discriminant({c: len(v) for c, v in x.items()}, {c: v.sum(0) for c, v in x.items()}, {c: v.T @ v for c, v in x.items()})
    cov = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = (cov[0] * 300 + cov[1] * 200) / 500
    density = {}
    for c in (0, 1):
        shrunk = (1 - quality.TO_POOLED - quality.TO_IDENTITY) * cov[c] + quality.TO_POOLED * pooled + (quality.TO_IDENTITY * np.trace(pooled) / 3 + 1e-9) * np.eye(3)
        d = x[0] - x[c].mean(0)
        density[c] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(shrunk), d) - 0.5 * np.log(np.linalg.det(shrunk))
    assert np.allclose(model.score(x[0]), 1 / (1 + np.exp(density[0] - density[1] - np.log(2 / 3))))


def test_statistics_equal_plain_ones():
    texts = ["", "One two two  THREE. 4 |", "a b a\na b a\n\nlast line here", "é" * 5]
    raw, off = text_bytes(pa.array(texts))
    got = quality.statistics(raw, off)
    names = quality.FEATURES
    for t, row in zip(texts, got, strict=True):
        words = t.split()
        n, size = len(words), len(t.encode())
        of = dict(zip(names, row, strict=True))
        letters = sum(c.isascii() and c.isalpha() for c in t) + sum(len(c.encode()) for c in t if not c.isascii())
        assert of["size"] == pytest.approx(np.log1p(size) / 10)
        assert of["upper"] == pytest.approx(np.sqrt(sum("A" <= c <= "Z" for c in t) / max(letters, 1)))
        assert of["digit"] == pytest.approx(np.sqrt(sum(c.isdigit() for c in t) / max(size, 1)))
        assert of["distinct"] == pytest.approx(len(set(words)) / max(n, 1))
        assert of["once"] == pytest.approx(sum(words.count(w) == 1 for w in words) / max(n, 1))
        assert of["repeat"] == pytest.approx(np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n, 1)))


def test_labels_null_repeated_or_without_documents(spark):
    texts = {i: "good words in a line " * 3 if i % 2 else "x x x x 1 1 ###" for i in range(40)}
    stats = quality.document_statistics(table(spark, texts))
    labels = [(i, i % 2) for i in range(40)] * 2 + [(3, None), (None, 1), (99, 0)]
    model = quality.fit(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.predicted for r in quality.score(stats, model).collect()}
    assert got == {i: i % 2 for i in range(40)}
    assert quality.score(quality.document_statistics(table(spark, texts).where("false")), model).count() == 0


def test_ids_of_every_low_character_equal_the_tokenizers():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, tokenizer = packing.IdEncoder(path).encode, token_counts.tokenizer(path)
    rnd = random.Random(0)
    low = [chr(i) for i in range(256)]
    texts = [a + b for a in low for b in ("", "a", "é", " b")] + ["".join(rnd.choice(low) for _ in range(rnd.randint(1, 12))) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_by_a_file_of_another_form():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = packing.IdEncoder(path), token_counts.tokenizer(path)
    assert not encoder.plain
    for t in ["One two  THREE", "ça\tva", ""]:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def two_groups(n, words=200):
    """Two groups of near copies under common signatures, whose bases are a few words apart."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    a = [word() for _ in range(words)]
    b = [word() if i % 20 == 10 and i < 170 else w for i, w in enumerate(a)]
    out = {}
    for i in range(2 * n):
        w = list((a, b)[i % 2])
        w[rnd.randrange(words - 20)] = word()
        out[i] = " ".join(w)
    return out


def test_groups_under_one_signature_do_not_make_all_their_pairs(spark, monkeypatch):
    """Compared pairs grow in proportion to the groups, not with their square."""
    compared = []
    verified = jaccard_join.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "verified", counted)
    totals = []
    for n in (250, 500):
        compared.clear()
        got = jaccard_join.link(table(spark, two_groups(n))).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: i % 2 for i in range(2 * n)}
        totals.append(sum(compared))
    assert totals[1] < 2.5 * totals[0] and totals[1] < 30 * 1000


def test_links_beside_the_pivot_are_found(spark, monkeypatch):
    """With one round of pivots the rest is found by rare features."""
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 1)
    for seed in (11, 12):
        texts = near_copies(seed, 150)
        got = jaccard_join.link(table(spark, texts), 2, 80).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, 2, 80)


def test_passages_that_many_documents_share_bring_no_pairs(spark):
    """Sets of one signature that are alike by frequent passages only are not paired; the linked two of them are."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(40)] for _ in range(2)]
    texts = [(i, " ".join(passages[0] + [word() for _ in range(60)] + passages[1])) for i in range(300)]
    texts.append((300, texts[7][1].rsplit(" ", 3)[0]))
    docs = spark.createDataFrame(texts, "doc long, text string").repartition(4)
    members = docs.selectExpr("1L sig", "doc")
    none = spark.createDataFrame([], "doc long, comp long")
    pairs = jaccard_join.beside_pivots(members, docs, none, 5, 80).collect()
    assert (7, 300) in {(r.a, r.b) for r in pairs} and len(pairs) < 300


def test_sets_with_too_many_features_of_their_own_are_not_paired(spark):
    """Copies of a text, each with other words in it than the rest: below the threshold, whatever they still share; the linked one is paired."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(1500)]
    texts = []
    for i in range(60):
        own = list(base)
        for at in range(i % 30, 1500, 37):
            own[at] = word()
        texts.append((i, " ".join(own)))
    texts.append((60, texts[7][1].rsplit(" ", 3)[0]))
    docs = spark.createDataFrame(texts, "doc long, text string").repartition(4)
    none = spark.createDataFrame([], "doc long, comp long")
    pairs = jaccard_join.beside_pivots(docs.selectExpr("1L sig", "doc"), docs, none, 3, 90).collect()
    assert (7, 60) in {(r.a, r.b) for r in pairs} and len(pairs) < 60


def test_slot_counts_are_those_of_all_sets(spark):
    texts = [("a b c d", ), ("b c d e", ), (None, ), ("", ), ("a b c d", )]
    counts = jaccard_join.slot_counts(spark.createDataFrame(texts, "text string").repartition(3), 3)
    assert len(counts) == jaccard_join.COUNT_SLOTS and sorted(counts[counts > 0]) == [1, 2, 3]
    assert not jaccard_join.slot_counts(spark.createDataFrame([], "text string"), 3).any()


def test_what_is_broadcast_of_a_benchmark_is_bounded():
    rnd = random.Random(2)
    for letters in (1, 6):
        items = [(i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(letters)) for _ in range(60))) for i in range(500)]
        w = decontamination.Windows.of_items(items, 13)
        held = len(w.data) + sum(sum(x.nbytes for x in cols[1:]) for cols in w.by_width.values())
        assert held <= decontamination.WINDOW_COST * sum(len(t) + 1 for _, t in items)


def test_names_are_one_feature(spark):
    assert extracted(spark, [
        '<body><ul class="main-menu"><li>Home<li>About</ul><div><p>The story is long enough to be told here</div></body>',
        '<body><nav>x</nav><article class="post tags-politics"><p>The story</article></body>',
        '<body><div class="share-capital"><p>The story of a share, told at length</div><div class=ad-slot>Buy</div></body>',
        '<body><section class="comments"><article class="comment">I think, at some length, that this is so</article></section><div>Story</div></body>',
        '<body><div class="post form-standard"><p>A long long story here</div><div class="related-posts">Other</div></body>',
    ]) == ["The story is long enough to be told here", "The story", "The story of a share, told at length", "Story", "A long long story here"]


def site_pages(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return [r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_small_hosts_are_judged_by_their_template(spark):
    page = "<body><div class=top>Read all about it</div><article><p>Story {0} of {1}</p><div>Follow us</div></article></body>"
    assert site_pages(spark, [(f"http://h{i}.t/x", page.format(i, i * 7)) for i in range(20)]) == [f"Story {i} of {i * 7}" for i in range(20)]


def test_copies_of_pages_do_not_make_a_site(spark):
    page = "<body><div class=top>Menu of {0}</div><article><p>Story {0}</p><p>Part {0}</p></article></body>"
    assert site_pages(spark, [("http://h.t/x", page.format(i % 3)) for i in range(30)]) == [f"Story {i % 3} Part {i % 3}" for i in range(30)]


def test_long_texts(spark):
    """Long texts (a line of 3,000 words, 20,000 lines) beside short ones give each operator its plain answer."""
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    texts = {1: " ".join(words), 2: " ".join(words[:1500] + ["x"] + words[1500:]), 3: "short", 4: "\n".join(["one two three four five six seven eight nine"] * 20_000)}
    docs = table(spark, texts).cache()
    linked = {r.doc_id: r.component_id for r in jaccard_join.link(docs).collect()}
    assert linked == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 0, 4: 19_999}
    items = spark.createDataFrame([(7, " ".join(words[100:120]))], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.contaminated) for r in decontamination.scan(docs, items).collect()} == {1: (20, False), 2: (20, False), 3: (0, False), 4: (0, False)}
    learned = {"a": b"w12 w34 w56 w789", "b": b"one two three four short"}
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, learned).collect()} == {1: "a", 2: "a", 3: "b", 4: "b"}
    assert quality.document_statistics(docs).count() == 4
    prints = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    assert prints[1].near_next > 0.5 and prints[1].n_chars == len(texts[1])
    docs.unpersist()
