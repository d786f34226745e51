"""Corpus operators against brute force on small tables with nulls, empty and repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.duck import DATA, check
from tilth.llm import decontamination, fingerprints, html_extraction, jaccard_join, language_id, line_dedup, packing, quality, queries, substring_dedup, suffix_arrays, token_counts

SF = str(DATA / "sf0.001")
SCHEMA = "doc_id long, text string, lang string, id long, key long, n int, first string, words string, h long, u long, d long, k string, low string"


def table(spark, texts, schema=SCHEMA):
    rows = texts if isinstance(texts, list) else list(texts.items())
    return spark.createDataFrame([(i, t, None, 1, 2, 3, "x", "y", 4, 5, 6, "z", "w") for i, t in rows], schema).repartition(3)


def near_copies(seed=1, n=60, words=60, edits=(0, 1, 2, 3, 6, 12)):
    """A group of near copies whose links often miss its middle, exact copies, unlike texts, and odd ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    base = [word() for _ in range(words)]
    out, made = {}, [base]
    for i in range(n):
        w = list(rnd.choice(made))
        for _ in range(rnd.choice(edits)):
            w[rnd.randrange(len(w))] = word()
        made.append(w)
        out[100 + i] = " ".join(w)
    out |= {1: None, 2: "", 3: "one", 4: "One", 5: "one two", 6: "  \n ", 7: out[110], 8: " ".join(word() for _ in range(400))}
    return out


def test_suffix_arrays_equal_sorted_suffixes():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(40):
        lanes = [[rnd.randint(1, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(0, 40))] + [0] for _ in range(rnd.randint(1, 9))]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lanes])])
        got = suffix_arrays.suffix_arrays(np.array([x for lane in lanes for x in lane]), starts)
        for i, lane in enumerate(lanes):
            assert (got[starts[i] : starts[i + 1]] - starts[i]).tolist() == sorted(range(len(lane)), key=lambda p: lane[p:])


@pytest.mark.parametrize(("local", "block"), [(8, 32), (2, 3)])
def test_repeated_substrings(spark, local, block):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(20, 90)))
    parts = [word() for _ in range(12)]
    texts = {i: "".join(rnd.choice(parts) if rnd.random() < 0.6 else word() for _ in range(rnd.randint(0, 6))) for i in range(80)}
    texts |= {90: None, 91: "", 92: texts[5], 93: texts[5], 94: "x" * 300, 95: "x" * 120, 96: "a" * 49, 97: "a" * 49}
    seen, expected = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        windows = [b[j : j + 50] for j in range(len(b) - 49)]
        gone = bytearray(len(b))
        for j, w in enumerate(windows):
            if w in seen:
                gone[j : j + 50] = b"\1" * 50
        seen |= set(windows)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        expected[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = substring_dedup.remove_repeats(table(spark, texts), local=local, block=block).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in got} == expected


def test_repeated_rows_do_not_remove_each_other(spark):
    got = substring_dedup.remove_repeats(table(spark, [(1, "q" * 60), (1, "q" * 60), (None, "z" * 60), (2, "z" * 60)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 0), (1, 0), (2, 60)]


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 1, 70)])
def test_components_equal_brute_force(spark, seed, width, percent):
    texts = near_copies(seed, 120)
    got = jaccard_join.link(table(spark, texts), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, width, percent)


def test_lines_equal_sql(spark):
    check(line_dedup.query(spark, SF), line_dedup.ORACLE_SQL, "sf0.001")


def test_lines_edge_cases(spark):
    nine = "a b c d e f g h i"
    texts = [(1, nine + "\n\nshort line"), (2, nine.replace("e", "X") + "\nshort line\n" + nine + " j"), (3, None), (4, ""), (5, "a b c d f g h i"), (5, "a b c d f g h i"), (6, "a b X d e f g Y i"), (7, "short  line \nother")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.key) for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert got == {1: (nine + "\n\nshort line", 3, 0, 2), 2: ("", 3, 3, 2), 3: (None, 0, 0, 2), 4: ("", 1, 0, 2), 5: ("", 1, 1, 2), 6: ("a b X d e f g Y i", 1, 0, 2), 7: ("other", 2, 1, 2)}
    assert line_dedup.dedup_lines(table(spark, texts)).count() == len(texts)


def brute_kept(texts):
    """Words of the lines (one a text, by id) with no earlier line within one edit of a word."""
    lines = [tuple(texts[i].split()) for i in sorted(texts)]
    cut = lambda w: {w[:p] + w[p + 1 :] for p in range(len(w))}
    near = lambda a, b: a == b or (min(len(a), len(b)) >= line_dedup.MIN_WORDS and ((len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or a in cut(b) or b in cut(a)))
    return [w for j, w in enumerate(lines) if not any(near(v, w) for v in lines[:j])]


@pytest.mark.parametrize("seed", range(4))
def test_lines_equal_brute_force(spark, seed):
    """Families of one line: a word more, less, other or moved, so that partners of one line are often two edits apart."""
    line = "a b c d e f g h i j".split()
    more = lambda p, w, x=line: [*x[:p], w, *x[p:]]
    lines = [more(7, "u"), line, more(3, "v")]
    if seed:
        rnd = random.Random(seed)
        lines += [more(p, f"n{p}") for p in range(11)] + [more(rnd.randrange(10), x, line[:p] + line[p + 1 :]) for p, x in enumerate(line)]
        lines += [line[:p] + line[p + 1 :] for p in rnd.sample(range(10), 4)] + [[*line[:p], "o", *line[p + 1 :]] for p in rnd.sample(range(10), 4)]
        lines += [more(rnd.randrange(12), "m", rnd.choice(lines)) for _ in range(20)] + [["s", "t", "u"], ["s", "t", "u", "v"], line[:7], line[:8]]
        rnd.shuffle(lines)
    texts = {i: " ".join(w) for i, w in enumerate(lines)}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert [tuple(got[i].split()) for i in sorted(got) if got[i]] == brute_kept(texts)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["Éa", "b2"]
    bench = {i: " ".join(rnd.choice(words) for _ in range(n)) for i, n in enumerate([20, 14, 13, 12, 3, 1, 40])}
    docs = {i: ", ".join([*(rnd.choice(words) for _ in range(30)), rnd.choice(list(bench.values())).upper(), *(rnd.choice(words) for _ in range(i))]) for i in range(30)}
    docs |= {100: None, 101: "", 102: "...", 103: bench[2]}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for i, t in bench.items():
        w = split(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    expected = {}
    for i, t in docs.items():
        w, items = split(t), set()
        hit = [False] * len(w)
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if found := windows.get(tuple(w[j : j + k])):
                    items |= found
                    hit[j : j + k] = [True] * k
        n = sum(hit)
        expected[i] = (len(w), n, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), n > 0 and 20 * n >= len(w))
    items = spark.createDataFrame([*bench.items(), (50, None), (None, "w1 w2"), (0, bench[0])], "item_id long, text string")
    for limit in (1 << 20, 0):  # broadcast, and joined
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
        got = decontamination.scan(table(spark, docs), items).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == expected
    clean = decontamination.scan(table(spark, {1: "x y " + bench[2] + " z"}), items, spans=True).first()
    assert clean.clean_text.split()[:2] == ["x", "y"] and clean.n_hit >= 13


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    texts = near_copies(9, 40)
    got = {r.doc_id: r for r in fingerprints.fingerprint(table(spark, texts)).collect()}
    ids = sorted(texts)
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, x = texts[i] or "", texts[after] or ""
        h = len(t) // 2
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + x[:h]).encode()).hexdigest()
        same = got[i].fingerprint == got[after].fingerprint
        assert (got[i].near_next == 1.0) == same and 0 <= got[i].near_edited <= 1
    assert got[7].fingerprint == got[110].fingerprint != got[8].fingerprint
    assert got[1].fingerprint == got[2].fingerprint == ""
    assert fingerprints.fingerprint(table(spark, {5: "only one"})).first().near_next == 1.0


def test_languages(spark):
    got = language_id.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    texts = {"en": b"the cat and the dog ", "fr": "le chat et le chien là ".encode()}
    rows = language_id.identify(table(spark, {1: "the dog", 2: "LÀ le chien", 3: None, 4: "", 5: "123 !!", 6: "日本"}), texts).collect()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id != 6} == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language_id.identify(table(spark, {1: "abc"}), {}).collect()} == {"und"}


def test_quality(spark):
    got = quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)
    stats = quality.document_statistics(table(spark, {1: None, 2: "", 3: "a"}))
    none = quality.fit(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(stats, none).collect()] == [0.5] * 3


ODD = "a\x1cb <|endoftext|> I'm  12²½ é 漢字\n\nx<|startoftext|>y   Σας \t"


def test_token_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = near_copies() | {200: ODD, 201: "word " * 3000, 202: "y" * 5000}
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, texts), path).collect()}
    tokenizer = token_counts.tokenizer(path)
    for i, t in texts.items():
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 1024)


def test_packing(spark):
    import zlib

    import numpy as np
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = near_copies() | {200: ODD, 201: "word " * 5000, 202: "y" * 5000}
    got = packing.pack(table(spark, texts), packing.tokenizer_encoder(path)).collect()
    tokenizer = token_counts.tokenizer(path)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in pieces] == [(k, s, min(2048, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 2048))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 5, 4, 7, 5)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 5)]
    bins = packing.BestFit(10, 1)
    assert [bins.place(n) for n in (6, 5, 5)] == [(0, 0), (1, 0), (1, 5)]


def test_html(spark):
    pages = [
        ("https://a.b/1", "<html><head><title>T</title></head><body><nav>Menu</nav><div class='ad'>Buy</div><article><h1>One &amp; two</h1><p>A <b>bold</b>\n word<p>next&nbsp;x<br>y<div id=comments><p>hi</div></article><footer>c</footer>"),
        ("https://a.b/2", None), (None, ""), ("https://a.b/3", "<p>plain <script>var t='</p>'</script>text"),
    ]
    rows = spark.createDataFrame([(i, u, h, "q") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(rows).collect()}
    assert got == {0: ("One & two A bold word next x y", 30), 1: ("", 0), 2: ("", 0), 3: ("plain text", 10)}


def test_style_tree_drops_what_a_site_repeats(spark):
    rows = [(i, f"http://s.t/{i}", f"<body><div>Home About Us</div><div><p>Story {i} about {i * 7}</p><p>More {i * i}</p></div><div>All rights</div></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} about {i * 7} More {i * i}" for i in range(20)}


def extracted(spark, pages):
    rows = spark.createDataFrame([(i, f"http://s.t/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extraction.extract(rows).orderBy("page_id").collect()]


def test_style_tree_drops_what_a_site_repeats_inside_main(spark):
    block = "<div>Read our terms</div>"
    pages = [f"<body><main><div><p>Story {i} about {i * 7}</p></div>{block}<article><p>Part {i * i}</p>{block}</article></main></body>" for i in range(20)]
    assert extracted(spark, pages) == [f"Story {i} about {i * 7} Part {i * i}" for i in range(20)]
    assert extracted(spark, ["<body><main>Always the same</main></body>"] * 20) == ["Always the same"] * 20


def test_comments_marked_up_as_articles(spark):
    comments = "<div id=comments><article>I think</article><article class=comment-body>so too</article></div>"
    related = "<div class=related><article>Other</article></div>"
    pages = [
        f"<body><article>The story</article>{comments}{related}</body>",
        f"<body><div>A story without an article</div>{comments}{related}</body>",
        f"<body>Skip<div class=with-sidebar><article class=tag-social>The story</article>{comments}</div></body>",
        "<body><article>The story</article><article class=comment>I think</article></body>",
    ]
    assert extracted(spark, pages) == ["The story", "A story without an article", "The story", "The story"]


def test_empty_tables(spark):
    docs = table(spark, {1: "x"}).where("false")
    import public_tokenizers

    frames = [
        fingerprints.fingerprint(docs), language_id.identify(docs, {"en": b"abc"}), substring_dedup.remove_repeats(docs), token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")),
        packing.pack(docs, packing.tokenizer_encoder(public_tokenizers.path("word_bpe_49k.json"))), decontamination.scan(docs, docs.select(F.col("doc_id").alias("item_id"), "text")), jaccard_join.link(docs), line_dedup.dedup_lines(docs),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
