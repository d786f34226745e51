"""The style tree against a plain one, what it removes by itself, and pages that strain it."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.duck import DATA
from tilth.llm import html_extraction as H


def skip(node):
    return node.tag in H._WITHOUT_TEXT


def plain_importance(pages):
    """{(site, path): importance} from [(host, html)], by walking each page's tree for each branch."""
    sites = defaultdict(list)
    for host, html in pages:
        sites[host].append(html)
        sites[H._ALL].append(html)
    out = {}
    for site, htmls in sites.items():
        signs = {H.signature(h) for h in htmls}
        if len(signs) < H.MIN_PAGES:
            continue
        on, above = defaultdict(set), {}
        for h in htmls:
            root = H.tree(h)
            for path, look, feature in H.own_features(root, skip):
                on[path, look, feature].add(H.signature(h))
            above |= H.ancestors(root, skip)
        base, total, mass, styles = math.log(len(signs)), Counter(), Counter(), defaultdict(list)
        for (path, look, _), pages_ in on.items():
            k = len(pages_)
            if look:
                styles[path].append(k)
            else:
                for a in above[path]:
                    total[a] += k
                    mass[a] += k * math.log(k) / base
        whole = 1 - mass[0] / total[0]
        for path, n in total.items():
            if path and whole > 0:
                s = sum(styles[path])
                style = -sum(k / s * math.log(k / s) for k in styles[path]) / base if s else 0.0
                out[site, path] = ((1 - H.PRESENTATION) * (1 - mass[path] / n) + H.PRESENTATION * style) / whole
    return out


def test_figures_equal_a_plain_tree(spark):
    rnd = random.Random(3)
    word = lambda n: " ".join(f"w{rnd.randrange(60)}" for _ in range(n))

    def page(host):
        extra = "".join(rnd.choice([f"<p>{word(4)}. {word(3)}</p>", f"<ul><li>{word(2)}<li><a href=/{word(1)}>{word(1)}</a></ul>", f"<div class={rnd.choice('ab')}>{word(6)}; {word(2)}</div>"]) for _ in range(rnd.randrange(5)))
        return host, f"<html><body><div class=top>Menu of {host}</div>{extra}<p>{word(30)}</p><footer>&copy; {host}, {rnd.choice('xyz')}</footer><script>1</script></body></html>"

    pages = [page(f"h{min(rnd.randrange(5), rnd.randrange(5))}") for _ in range(80)]
    pages += [pages[0], pages[0]]
    frame = spark.createDataFrame(pages, "host string, html string").repartition(3)
    got = {(r.site, r.path): r.importance for r in H.figures(frame).collect()}
    want = plain_importance(pages)
    assert got.keys() == want.keys() and len({s for s, _ in want}) > 2
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_the_tree_alone_removes_menus_adverts_and_footers(spark):
    """Without names, tags and main elements, of all pages together; no article goes."""
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select(F.lit("one").alias("host"), "html")
    low = set(H.low_paths(pages).first().low)
    gone, had = Counter(), Counter()
    for row in pages.collect():
        for node in H._reach(H.tree(row.html), skip):
            kind = node.tag if node.tag in ("nav", "footer", "article") else "advert" if node.named == H.WHOLLY and node.tag == "div" else None
            if kind:
                had[kind] += 1
                gone[kind] += node.path in low
    assert gone["article"] == 0 and all(gone[k] >= 0.9 * had[k] > 0 for k in ("nav", "footer", "advert"))


def text_of(html):
    return H.main_text(H.tree(html), set())


def test_deep_and_wide_pages():
    start = time.process_time()
    deep = "<body><article><p>Story" + "<div>" * 30_000 + "deep"
    root = H.tree(deep)
    assert len({*H.own_features(root, skip)}) < 60_000 and max(map(len, H.ancestors(root, skip).values())) <= H.MAX_DEPTH + 1
    assert H.main_text(root, set()) == "Story deep"
    assert text_of("<body>" + "<div>x</div>" * 30_000).count("x") == 30_000
    assert time.process_time() - start < 10


def test_wrappers_keep_their_story():
    story = "A story with many words in it, told at length to the end"
    assert text_of(f"<body><form id=f><h1>T</h1><p>{story}</p></form></body>") == f"T {story}"
    assert text_of(f"<body><form><article><p>{story}</p></article></form></body>") == story
    assert text_of(f"<main><div class=search>{story}</div><div class=search>Find</div></main>") == story
    assert text_of(f"<body><div class=widget><p>{story}</p></div><form><label>Name</label></form></body>") == story
    assert text_of(f"<body><div>{story}</div><div class=comments>{story} {story} {story}</div></body>") == story


def _same(node, other):
    """Whether two trees agree in tags, paths, judgements, links and texts."""
    stack = [(node, other)]
    while stack:
        a, b = stack.pop()
        if isinstance(a, str) or isinstance(b, str):
            if a != b:
                return False
            continue
        if (a.tag, a.path, a.comment, a.main, a.named, a.links, len(a.children)) != (b.tag, b.path, b.comment, b.main, b.named, b.links, len(b.children)):
            return False
        stack += zip(a.children, b.children, strict=True)
    return True


def test_plain_markup_is_read_as_the_parser_reads_it():
    bits = ["<p>", "</p>", '<div class="ad x">', "</div >", "a &amp; b", '<script>x="</p>"</script>', "<SCRIPT>", "</ script>", "<!-- c -->", "<!-->", "< ", "&lt", "<br/>", '<img src="a&amp;b"/>', "<a href=x>", '<a href="y" b>', "</a>", "<style/>", "</>", "<li>", "</ul>", '<main id="Main">', "<p a=\"b\"c>", "<!doctype html>"]
    pick = random.Random(5)
    plain = 0
    for _ in range(3000):
        html = "".join(pick.choice(bits) for _ in range(pick.randint(1, 8)))
        fed, read = H.TreeBuilder(), H.TreeBuilder()
        fed.feed(html)
        fed.close()
        if read.read(html):
            plain += 1
            assert _same(fed.root, read.root), html
        assert _same(fed.root, H.tree(html)), html
    assert plain > 500
