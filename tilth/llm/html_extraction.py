"""Operator 9: main text of web pages by site style trees.

The trees of a site's pages are merged: nodes of the same path (tags with their classes, from the root)
meet. A node's content features are the phrases of its own text, and the targets of its links and
images; the importance of a feature is 1 less the entropy of the pages that it occurs on, to the base of the
site's pages. The content importance of a branch is the mean over all features in it, bottom-up, and is put
together with the importance of its presentation, the entropy of its sequences of child tags over pages.
A branch that has less than LOW_IMPORTANCE of the importance that its site's pages have as a whole is removed
from each page, inside main elements too. Near copies of a page count once: pages are told apart by the least
hash of their longer texts, which near copies share.

Each page is of two sites: its host, whose figures count from MIN_PAGES such pages on, and all hosts together,
whose trees merge where their templates agree. Text below MAX_DEPTH levels counts for the branch at that depth.

Tags and names that say what a branch is (menu, advert, comment, ...) are features beside the figures:
such branches go, also with the articles in them, but a name of several words of which only some say
so (site-menu, but also share-capital), a name that can also hold a story (search, widget, ...) and a form
go only if the branch has no more than half of the page's text.
Of a page with article or main elements elsewhere only these are kept, without the branches in them
that the site repeats. The element itself stays whatever the site repeats and whatever it is called, but
for articles called comments. Where all main elements are in branches called noise (a wrapper can be
called after its sidebar), they count against the rest of the page by the length of the text.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined by one space in page order.

Null and empty html give an empty text; a null url is a host of its own. Unclosed, stray and cut-off
tags are read as browsers do, roughly. Repeated pages are each returned. An empty table gives an empty
result; extra columns are not read. Only a host's low-importance paths travel back to its pages, to each
of SALTS parts of it, so a host with very many pages is split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Set
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import materialize, release, table

#: Importance of a branch, as part of its site's, below which it goes; pages that a host needs before its figures count.
LOW_IMPORTANCE, MIN_PAGES = 0.8, 8
#: The part of presentation in a branch's importance.
PRESENTATION = 0.15
#: Levels of a tree that have paths of their own, and parts that a host's pages are dealt in.
MAX_DEPTH, SALTS = 48, 32
_ALL = "all hosts"

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
NOISE_TAGS = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "object", "menu", "dialog", "canvas", "audio", "video", "map"}
NOISE_NAMES = {
    "ad", "ads", "adbox", "adsbygoogle", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "masthead", "header", "footer", "contentinfo", "copyright",
    "sidebar", "aside", "complementary", "widget", "widgets", "related", "recommended", "recommendations", "share", "sharing", "social", "tags",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form",
    "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "discussion",
}
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "discussion"}
MAIN_TAGS = {"article", "main"}
MAIN_NAMES = {"main", "articlebody", "maincontent"}
#: Names that can also hold a story.
OPEN_NAMES = {"search", "widget", "widgets", "form", "overlay", "modal", "alert", "notice", "notices"}
#: How a branch is named: not as noise, in some words of a name, or by a whole name.
PLAIN, PARTLY, WHOLLY = 0, 1, 2
#: Start tags that close an open element, up to the given containers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Containers beyond which a start tag of a block doesn't close a paragraph, tags that have no place of their own, and attributes that name.
_AROUND_P = {"button", "td", "th", "table", "body"} | MAIN_TAGS
_PLACELESS = INLINE | {"p", "li", "tr", "td", "dt", "dd"}
_NAMING = ("class", "id", "role", "itemprop")
#: Markup that needs no rules for errors, with the text after it: an end tag, a start tag (name, attributes, slash), or what is skipped.
_PLAIN = re.compile(r"""<(?:/([a-z][a-z0-9]*)[ \t\n\r\f]*|([a-z][a-z0-9]*)((?:[ \t\n\r\f]+[a-z][a-z0-9_:-]*(?:="[^"]*")?)*)[ \t\n\r\f]*(/?)|!--[^>]*--|!doctype[^>]*)>([^<]*)""", re.ASCII | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9_:-]*)(?:="([^"]*)")?""", re.ASCII | re.IGNORECASE)
#: The ends of elements whose content is no markup.
_RAW_END = {tag: re.compile(rf"</\s*{tag}", re.IGNORECASE) for tag in ("script", "style")}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z0-9]+")
_ENDS = re.compile(r"[.!?|\u00b7\u2022\u00a9\u2013\u2014]+")
_LONG = re.compile(r">([^<>]{40,})<")
_MASK = (1 << 63) - 1


class Node:
    __slots__ = ("children", "comment", "depth", "kinds", "large", "links", "main", "named", "parent", "path", "size", "tag")

    def __init__(self, tag: str, said: str, parent: Node | None, place: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        names, self.comment, self.main, self.named = _judged_names(tag, said)
        # a path is the hash of its parent's and its own step; below MAX_DEPTH it is that of the level above
        self.path = 0 if not parent else parent.path if self.depth > MAX_DEPTH else xxhash.xxh64_intdigest(f"{tag}{place}.{names}", parent.path) & _MASK
        self.children: list[Node | str] = []
        self.kinds: dict[str, int] = {}
        self.links: list[str] = []
        self.size, self.large = 0, False


@lru_cache(1 << 14)
def _judged_names(tag: str, said: str) -> tuple[str, bool, bool, int]:
    """The names an element has, in order, whether they say comments or main text, and how they say noise."""
    names = sorted(set(said.split()))
    parts = [_NAME.findall(n) for n in names]
    whole = {"".join(p) for p in parts}
    words = {w for p in parts for w in p}
    comment = bool(words & COMMENT_NAMES)
    main = tag == "main" or bool(whole & MAIN_NAMES) or (tag == "article" and not comment)
    return ".".join(names), comment, main, WHOLLY if whole & (NOISE_NAMES - OPEN_NAMES) else PARTLY if words & NOISE_NAMES else PLAIN


class TreeBuilder(HTMLParser):
    """The element tree of a page; paths carry tags, classes and, for containers, the place among like siblings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", "", None, "")
        self.nodes = [self.root]
        self.open: Counter[str] = Counter()

    def read(self, html: str) -> bool:
        """Read a page of plain markup as feed() and close() would, in fewer steps; False where the page needs their rules."""
        at = html.find("<")
        if at < 0:
            at = len(html)
        if at:
            self.handle_data(unescape(html[:at]))
        while at < len(html):
            if not (m := _PLAIN.match(html, at)):
                return False
            end, start, attrs, closed, text = m.groups()
            at = m.end()
            if start:
                start = start.lower()
                said = [(k.lower(), unescape(v) if "&" in v else v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else []
                if closed:
                    self.handle_startendtag(start, said)
                else:
                    self.handle_starttag(start, said)
                    if start in _RAW_END:  # its content is one text up to its end
                        stop, at = _RAW_END[start].search(html, m.start(5)), m.start(5)
                        if not stop:
                            return False
                        text, at = html[at : stop.start()], stop.start()
                        if "<!--" in text or not (after := _PLAIN.match(html, at)) or (after[1] or "").lower() != start:
                            return False
                        if text:
                            self.handle_data(text)
                        continue
            elif end:
                self.handle_endtag(end.lower())
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
        return True

    def _leave(self, node: Node) -> None:
        """Close all elements down to and with this one."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags: set[str], until: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE and tag != "br":
            if self.open["p"]:
                self._close({"p"}, _AROUND_P)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        target = next((v for k, v in attrs if v and k == ("src" if tag == "img" else "href")), None) if attrs and tag in ("a", "img") else None
        if target:
            self.at.links.append(target)
        if tag in VOID:
            self.at.children.append("\n" if tag in ("br", "hr") else "")
            return
        said = " ".join([v.lower() for k, v in attrs if v and k in _NAMING]) if attrs else ""
        kind = 0
        if tag not in _PLACELESS:
            kind = self.at.kinds.get(tag, 0)
            self.at.kinds[tag] = kind + 1
        node = Node(tag, said, self.at, "" if tag in _PLACELESS else str(kind))
        self.nodes.append(node)
        self.at.children.append(node)
        self.open[tag] += 1
        self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while self.open[tag] and node.parent is not None:
            if node.tag == tag:
                self._leave(node)
                return
            if tag in INLINE and node.tag not in INLINE:
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = TreeBuilder()
    if not builder.read(html):
        builder = TreeBuilder()
        builder.feed(html)
        builder.close()
    root = builder.root
    for node in reversed(builder.nodes):  # each after its parent
        size = 0
        for c in node.children:
            if isinstance(c, str):
                size += len(c)
            elif not ((c.tag in NOISE_TAGS and c.tag != "form") or c.named == WHOLLY):
                size += c.size
        node.size = size
    for node in _reach(root, lambda n: 2 * n.size <= root.size):
        node.large = True
    return root


def named_noise(node: Node, held: Set[Node]) -> bool:
    """Whether tag or names say that the branch is none of the main text; held branches are not judged by names."""
    if node.tag in NOISE_TAGS:
        return node.tag != "form" or not node.large
    if node.main or node in held or node.tag in ("#", "html", "body"):
        return False
    return node.tag == "header" or node.named == WHOLLY or (node.named == PARTLY and not node.large)


def _reach(root: Node, closed: Callable[[Node], bool]) -> Iterator[Node]:
    """Nodes in page order that are in no closed branch."""
    stack = [root]
    while stack:
        node = stack.pop()
        if not closed(node):
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def holders(root: Node) -> set[Node]:
    """Main elements and everything above them, but for those in branches whose tag or names say comments and the like."""
    out: set[Node] = set()
    for node in _reach(root, lambda n: (n.tag in NOISE_TAGS and not (n.tag == "form" and n.large)) or (not n.main and n.tag not in ("#", "html", "body") and n.comment)):
        if node.main:
            while node is not None and node not in out:
                out.add(node)
                node = node.parent
    return out


def judged(root: Node) -> tuple[list[Node], set[Node], Callable[[Node], bool]]:
    """The page's outermost main elements, they and all others with what is above them, and what is noise by tag or names."""
    held = holders(root)
    strict, kind = (lambda n: named_noise(n, frozenset())), (lambda n: named_noise(n, held))
    outermost = lambda noise: [n for n in _reach(root, lambda n: noise(n) or (n.parent is not None and n.parent.main)) if n.main]
    if not held or (mains := outermost(strict)):
        return (mains if held else []), held, strict
    mains = outermost(kind)
    if sum(len(t) for m in mains for t in texts(m, kind)) > sum(map(len, texts(root, strict))):
        return mains, held, kind
    return [], held, strict


def texts(node: Node, skip) -> list[str]:
    """Blocks of a branch in page order, without the branches that skip() names."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := _SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0 and node.tag not in INLINE:
            end()
        while i < len(node.children):
            child = node.children[i]
            i += 1
            if isinstance(child, str):
                run.append(child)
            elif not skip(child):
                stack.append((node, i))
                stack.append((child, 0))
                break
        else:
            if node.tag not in INLINE:
                end()
    end()
    return out


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) & _MASK


def own_features(root: Node, skip: Callable[[Node], bool]) -> Iterator[tuple[int, bool, int]]:
    """Path of a block-level node, whether the feature is of its presentation, and the feature's hash, for branches that skip() doesn't name.

    Inline elements' text and links are those of the block around them.
    """
    stack: list[tuple[Node, Node]] = [(root, root)]
    runs: dict[int, list[str]] = {}
    while stack:
        node, block = stack.pop()
        if node.tag not in INLINE:
            block = node
            yield node.path, True, _hash(" ".join(c.tag for c in node.children if isinstance(c, Node) and c.tag not in INLINE))
        run = runs.setdefault(block.path, [])
        for link in node.links:
            yield block.path, False, _hash(link, 1)
        for child in reversed(node.children):
            if isinstance(child, str):
                run.append(child)
            elif not skip(child):
                stack.append((child, block))
    for path, run in runs.items():
        for text in run:
            for phrase in _ENDS.split(text.lower()):
                if words := phrase.split():
                    yield path, False, _hash(" ".join(words))


def ancestors(root: Node, skip: Callable[[Node], bool]) -> dict[int, list[int]]:
    """Each path of a page with itself and those above it."""
    out: dict[int, list[int]] = {}
    for node in _reach(root, skip):
        if node.path not in out:
            out[node.path] = [*(out[node.parent.path] if node.parent else []), node.path]
    return out


def signature(html: str) -> int:
    """The least hash of a page's longer texts between tags: near copies mostly share it."""
    return min((_hash(t, 2) for t in _LONG.findall(html)), default=_hash(html, 3)) & 0x7FFFFFFF


def main_text(root: Node, low: set[int]) -> str:
    """The page's main text, given the host's low-importance paths."""
    mains, held, noise = judged(root)
    skip = lambda n: noise(n) or (n.path in low and n.tag not in ("html", "body") and not (mains and n in held))
    return " ".join(t for m in mains or [root] for t in texts(m, skip))


#: Branches that hold no text of the page; all others are judged by the tree.
_WITHOUT_TEXT = {"head", "script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "audio", "video", "map", "select", "textarea"}


def figures(pages: DataFrame) -> DataFrame:
    """site, path and importance (as part of its site's) of the merged nodes of pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, counts, signs, rows, above = [], [], [], [], {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                root, skip = tree(html or ""), (lambda n: n.tag in _WITHOUT_TEXT)
                own = {*own_features(root, skip)}
                rows.extend(own)
                hosts.append(host)
                counts.append(len(own))
                signs.append(signature(html or ""))
                above |= ancestors(root, skip)
            # chains go as rows of their own, without host: a path and one above it
            chain = [(path, None, up) for path, ups in above.items() for up in ups]
            page = np.repeat(np.arange(len(hosts)), counts)
            pad = lambda x: pa.concat_arrays([x.take(pa.array(page)), pa.nulls(len(chain), x.type)])  # noqa: E731, B023
            path, look, feature = zip(*rows, *chain, strict=True) if rows or chain else ((), (), ())
            yield pa.RecordBatch.from_arrays([pad(pa.array(hosts, pa.string())), pa.array(path, pa.int64()), pa.array(look, pa.bool_()), pa.array(feature, pa.int64()), pad(pa.array(signs, pa.int32()))], names=["host", "path", "look", "feature", "page"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, path long, look boolean, feature long, page int")
    # copies within a host are put together first; the pages of all hosts are then summed from those of each
    once = materialize(seen.distinct())
    chains = materialize(once.where("look is null").select("path", F.col("feature").alias("above")).distinct())
    once_, once = once, once.where("look is not null")
    by_host = once.groupBy(F.col("host").alias("site"), "path", "look", "feature").agg(F.count("*").alias("k"))
    everywhere = once.groupBy("path", "look", "feature").agg(F.count_distinct("page").alias("k")).select(F.lit(_ALL).alias("site"), "path", "look", "feature", "k")
    root = once.where("path = 0 and look")
    size = root.groupBy(F.col("host").alias("site")).agg(F.count_distinct("page").alias("pages")).union(root.agg(F.count_distinct("page").alias("pages")).select(F.lit(_ALL), "pages"))
    size = materialize(size.where(F.col("pages") >= MIN_PAGES))
    spread = by_host.union(everywhere).groupBy("site", "path", "look").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    spread = materialize(spread.join(size, "site"))
    release(once_)
    # contents of a branch: sums over all paths below it
    deep = spread.where("not look").join(chains, "path").select("site", F.col("above").alias("path"), "n", (F.col("klogk") / F.log("pages")).alias("h"))
    content = deep.groupBy("site", "path").agg((1 - F.sum("h") / F.sum("n")).alias("content"))
    look = spread.where("look").select("site", "path", ((F.log("n") - F.col("klogk") / F.col("n")) / F.log("pages")).alias("style"))
    own = materialize(content.join(look, ["site", "path"], "left").select("site", "path", "content", ((1 - PRESENTATION) * F.col("content") + PRESENTATION * F.coalesce("style", F.lit(0.0))).alias("both")))
    whole = own.where("path = 0").select("site", F.col("content").alias("whole"))
    return own.where("path != 0").join(whole, "site").where("whole > 0").select("site", "path", (F.col("both") / F.col("whole")).alias("importance"))


def low_paths(pages: DataFrame) -> DataFrame:
    """host, low: the paths of low importance on each host's pages, by the host's own figures or those of all hosts."""
    low = materialize(figures(pages).where(F.col("importance") < LOW_IMPORTANCE).select("site", "path"))
    hosts = pages.select("host").distinct()
    own = low.where(F.col("site") != _ALL).groupBy(F.col("site").alias("host")).agg(F.collect_set("path").alias("own"))
    shared = low.where(F.col("site") == _ALL).agg(F.collect_set("path").alias("shared"))
    both = hosts.join(own, "host", "left").crossJoin(shared)  # one row
    empty = F.array().cast("array<long>")
    return both.select("host", F.array_union(F.coalesce("own", empty), F.coalesce("shared", empty)).alias("low"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt"))
    low = materialize(low_paths(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(tree(h or ""), set(p or ())) for h, p in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return pages.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
