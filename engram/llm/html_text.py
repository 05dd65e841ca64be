"""Main text of web pages by a tree-structured graphical model (op10).

The nodes are a page's block elements and its text blocks, each content or boilerplate. A node's own potential is what its
tag, the words of its class and id and the shape of its text say for either label; a potential on each edge says how
labels pass from parent to child, one for elements that begin a section by their tag or name and one for all others. Sum-product messages go from the leaves to the root and back, after which each text
block has its exact marginal, and blocks that are likelier content than not are the page's text. The potentials are
counts, smoothed by one half, over labelled pages of two kinds: examples made by rule (`labelled_pages`), and a bounded
sample of the given pages, labelled by their sectioning elements (`by_structure`).
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common

#: Elements within a line of text, elements without content, and elements whose content is not page text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mrow ms msqrt msub msup mtext munder object q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is raw text up to the end tag, or to the end of the page.
SKIPPED = frozenset("script style title noscript textarea iframe noframes".split())
#: Their content is markup that is not shown; it ends at the latest where the element around it ends.
HIDDEN = frozenset("template svg select datalist canvas".split())
#: Elements by which a page says itself what is its text and what is not.
SECTIONS = {"article": 1, "main": 1, "nav": 0, "aside": 0, "footer": 0, "form": 0, "dialog": 0, "menu": 0}
MARKED = frozenset([*SECTIONS, "section", "header", "search"])
#: What a start tag closes if it is open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that a start tag's search for something to close does not leave.
SCOPE = frozenset("html body table ul ol dl article section div main aside nav header footer form blockquote".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>", re.S)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_LABEL = re.compile(r"\bdata-label=\"(\w+)\"")
_PART = re.compile(r"[a-z]+")


@dataclass
class Node:
    parent: int
    traits: tuple[str, ...]
    label: int | None = None
    text: list[str] | None = None
    linked: int = 0
    tag: str = ""
    marked: int = 0  # whether a tag or a name says that a section begins here


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)

    def texts(self) -> list[tuple[int, str]]:
        return [(i, n.text) for i, n in enumerate(self.nodes) if n.text is not None]


def _names(attributes: str) -> list[str]:
    return [w for m in _NAME.finditer(attributes) for w in _PART.findall(m[1].lower()) if len(w) > 1]


def _shape(text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    return (f"length:{min(int(math.log2(n + 1)), 10) // 2}", f"links:{min(3, 4 * linked // max(n, 1))}", f"end:{int(text[-1] in '.!?:;…')}")


def parse(source: str) -> Page:
    """Block elements and text blocks in page order, parents first. Tags need not match; nothing fails."""
    page = Page([Node(-1, ("tag:#root",), tag="#root")])
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements, inline ones with the node of their block
    # Where open elements of a name, all but inline ones, and those that end a search stand in the stack: so no tag looks
    # through it, and a page of any depth is read in one pass.
    places: dict[str, list[int]] = {}
    outer, scopes = [0], [0]
    block, links, hidden = 0, 0, 0
    held: list[str] = []
    held_links = 0

    def flush() -> None:
        nonlocal held, held_links
        text = " ".join("".join(held).split())
        if text:
            page.nodes.append(Node(block, _shape(text, held_links), page.nodes[block].label, text))
        held, held_links = [], 0

    def pop(to: int) -> None:
        nonlocal block, links, hidden
        for name, _ in stack[to:]:
            links -= name == "a"
            hidden -= name in HIDDEN
            places[name].pop()
        del stack[to:]
        while outer[-1] >= to:
            outer.pop()
        while scopes[-1] >= to:
            scopes.pop()
        block = stack[-1][1]

    def push(name: str) -> None:
        nonlocal links, hidden
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            outer.append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        links += name == "a"
        hidden += name in HIDDEN
        stack.append((name, block))

    def put(raw: str) -> None:
        nonlocal held_links
        if hidden:
            return
        text = html.unescape(raw) if "&" in raw else raw
        held.append(text)
        if links:
            held_links += len(text)

    def last(name: str) -> int:
        """Place of the innermost open element of a name, or 0."""
        return places[name][-1] if places.get(name) else 0

    at, stop = 0, source.rfind(">") + 1  # behind it no tag ends
    if "<!--" in source[stop:]:
        stop = len(source)
    while (m := _TAG.search(source, at, stop)) is not None:
        if m.start() > at:
            put(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attributes = m[3] if m[2] else m[6]
        inline = name in INLINE or name in HIDDEN
        if m[1] or m[4]:
            depth = last(name)
            if name in INLINE and outer[-1] > depth:
                continue
            if not inline and not (hidden and not depth):
                flush()
            if depth:
                pop(depth)
            continue
        if name in SKIPPED:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            held.append(" ")
            continue
        if name == "br":
            held.append(" ")
            continue
        if inline:
            if name not in VOID and not attributes.endswith("/"):
                push(name)
            continue
        if hidden:  # nothing in there makes a block
            continue
        flush()
        shut = CLOSES.get(name, ())
        while (i := max(map(last, ("p", *shut)))) > scopes[-1]:
            pop(i)
            if stack[i - 1][0] not in shut:
                break
        # Formatting that a paragraph left open does not reach into the next one.
        while stack[-1][0] in INLINE:
            pop(len(stack) - 1)
        if name in VOID:
            continue
        label = _LABEL.search(attributes)
        own = (label[1] == "content") * 1 if label else page.nodes[block].label
        names = _names(attributes)
        page.nodes.append(Node(block, (f"tag:{name}", *(f"name:{w}" for w in names)), own, tag=name, marked=int(bool(names) or name in MARKED)))
        block = len(page.nodes) - 1
        push(name)
    if at < len(source):
        put(source[at:])
    flush()
    return page


class Model:
    """Log potentials: own[trait] for (boilerplate, content), edge[child marked][parent][child], and the root's."""

    def __init__(self, own: dict[str, tuple[float, float]], edge: tuple, root: tuple[float, float]):
        self.own, self.edge, self.root = own, edge, root

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node, by messages to the root and back."""
        nodes = page.nodes
        n = len(nodes)
        zero = (0.0, 0.0)
        edges = [(e[0][0], e[0][1], e[1][0], e[1][1]) for e in self.edge]
        belief = []
        for node in nodes:
            x = y = 0.0
            for t in node.traits:
                p = self.own.get(t, zero)
                x += p[0]
                y += p[1]
            belief.append([x, y])
        belief[0][0] += self.root[0]
        belief[0][1] += self.root[1]
        up: list[tuple[float, float]] = [zero] * n
        for i in range(n - 1, 0, -1):
            x, y = belief[i]
            e00, e01, e10, e11 = edges[nodes[i].marked]
            m = (_add(x + e00, y + e01), _add(x + e10, y + e11))
            up[i] = m
            parent = belief[nodes[i].parent]
            parent[0] += m[0]
            parent[1] += m[1]
        for i in range(1, n):
            p = belief[nodes[i].parent]
            x, y = p[0] - up[i][0], p[1] - up[i][1]
            e00, e01, e10, e11 = edges[nodes[i].marked]
            belief[i][0] += _add(x + e00, y + e10)
            belief[i][1] += _add(x + e01, y + e11)
            top = max(belief[i])
            belief[i][0] -= top
            belief[i][1] -= top
        return [1 / (1 + math.exp(max(-60.0, min(60.0, b[0] - b[1])))) for b in belief]

    def extract(self, source: str | None) -> str:
        page = parse(source or "")
        p = self.marginals(page)
        return "\n".join(text for i, text in page.texts() if p[i] >= 0.5)


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def by_structure(source: str | None) -> Page | None:
    """A page labelled by its own sectioning elements, or None if no text of it stands in an article or main element.

    Inside article and main is content, but for what is again inside nav, aside, footer, form, dialog, menu, or has a
    class or id that names comments; all else is boilerplate.
    """
    page = parse(source or "")
    for node in page.nodes:
        above = page.nodes[node.parent].label if node.parent >= 0 else 0
        node.label = SECTIONS.get(node.tag, above) if above != 0 or SECTIONS.get(node.tag) == 1 else 0
        if any(t in ("name:comment", "name:comments") for t in node.traits):
            node.label = 0
    return page if any(n.label for n in page.nodes if n.text is not None) else None


def accuracy(model: Model, pages: list[Page]) -> tuple[int, float]:
    """(text blocks, share of them whose marginal is on the side of their label) of labelled pages."""
    right = [(p >= 0.5) == bool(n.label) for page in pages for n, p in zip(page.nodes, model.marginals(page), strict=True) if n.text is not None]
    return len(right), sum(right) / max(len(right), 1)


def train(pages: list[Page]) -> Model:
    """Counts over labelled pages; labels hold for what is inside. An element without one has that of most of its text."""
    traits, labels, edges, roots = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        nodes = page.nodes
        weight = [[0, 0] for _ in nodes]
        for i in range(len(nodes) - 1, -1, -1):
            node = nodes[i]
            if node.text is not None and node.label is not None:
                weight[i][node.label] += len(node.text)
            if node.parent >= 0:
                weight[node.parent][0] += weight[i][0]
                weight[node.parent][1] += weight[i][1]
        got = [n.label if n.label is not None else int(w[1] >= w[0]) for n, w in zip(nodes, weight, strict=True)]
        roots[got[0]] += 1
        for node, y in zip(nodes, got, strict=True):
            labels[y, node.text is None] += 1
            traits.update((t, y) for t in node.traits)
            if node.parent >= 0:
                edges[node.marked, got[node.parent], y] += 1
    own = {}
    for t, _ in traits:
        block = t.startswith(("tag:", "name:"))
        own[t] = tuple(math.log((traits[t, y] + 0.5) / (labels[y, block] + 1)) for y in (0, 1))
    edge = tuple(tuple(tuple(math.log((edges[m, p, c] + 0.5) / (edges[m, p, 0] + edges[m, p, 1] + 1)) for c in (0, 1)) for p in (0, 1)) for m in (0, 1))
    return Model(own, edge, tuple(math.log((roots[y] + 0.5) / (sum(roots.values()) + 1)) for y in (0, 1)))


#: What pages are made of, for labelled examples: boilerplate by kind, as (tag, attributes, inner form).
BOILERPLATE = [
    ("nav", "", "menu"), ("nav", 'class="main-nav"', "menu"), ("ul", 'class="menu"', "items"), ("div", 'id="navbar"', "menu"), ("header", "", "heading"), ("header", 'class="site-header"', "menu"),
    ("div", 'class="breadcrumb breadcrumbs"', "links"), ("footer", "", "note"), ("footer", 'class="site-footer"', "menu"), ("div", 'id="footer"', "links"), ("div", 'class="copyright"', "note"),
    ("aside", "", "prose"), ("aside", 'class="sidebar"', "menu"), ("div", 'id="sidebar"', "prose"), ("div", 'class="widget"', "items"), ("div", 'class="ad"', "prose"), ("div", 'class="ads advert advertisement"', "prose"),
    ("div", 'class="banner promo sponsored"', "prose"), ("div", 'class="cookie-notice"', "prose"), ("div", 'id="consent" class="notice"', "prose"), ("div", 'class="popup modal"', "prose"), ("section", 'class="newsletter subscribe"', "form"),
    ("form", "", "form"), ("form", 'class="search"', "form"), ("div", 'class="login"', "form"), ("section", 'id="comments"', "comments"), ("div", 'class="comments comment-list"', "comments"), ("ol", 'class="commentlist"', "items"),
    ("div", 'class="reply responses discussion"', "comments"), ("div", 'class="related recommended"', "items"), ("div", 'class="share social"', "links"), ("div", 'class="tags meta pagination pager"', "links"), ("div", 'role="navigation"', "menu"), ("div", 'role="complementary"', "prose"),
]
CONTENT = [
    ("article", ""), ("main", ""), ("article", 'class="post"'), ("div", 'class="content"'), ("div", 'id="content" class="main"'), ("div", 'class="entry-content"'), ("div", 'class="article-body"'), ("section", 'class="story text"'), ("div", 'role="main"'), ("article", 'class="article entry"'),
]
_PROSE = "the river rose in spring and people moved their boats to higher ground before the water reached the old stone bridge".split()


def labelled_pages() -> list[Page]:
    """Example pages, each kind of boilerplate around and inside each kind of content, labelled by data-label attributes."""

    def prose(k: int, n: int) -> str:
        w = [_PROSE[(k * 7 + i * (k % 5 + 1)) % len(_PROSE)] for i in range(n)]
        return " ".join(w).capitalize() + "."

    def inner(form: str, k: int) -> str:
        word = lambda i: _PROSE[(k + i) % len(_PROSE)]
        return {
            "menu": "<ul>" + "".join(f'<li><a href="/{word(i)}">{word(i)}</a></li>' for i in range(6)) + "</ul>",
            "items": "".join(f'<li><a href="/{word(i)}">{prose(k + i, 4)}</a></li>' for i in range(4)),
            "links": " | ".join(f'<a href="/{word(i)}">{word(i)}</a>' for i in range(4)),
            "heading": f"<h2>{word(0)} {word(1)}</h2>" + f'<a href="/">{word(2)}</a>',
            "note": f"&copy; {word(0)} {word(1)} &middot; {prose(k, 5)}",
            "prose": prose(k, 9) if k % 2 else f"<p>{prose(k, 14)}</p>",
            "form": f'<label>{word(0)}</label><input name="q"><button>{word(1)}</button><p>{prose(k, 6)}</p>',
            "comments": "".join(f'<div class="comment"><p>{prose(k + i, 12)}</p></div>' for i in range(2)),
        }[form]

    pages = []
    for k, ((tag, attributes), (a, b)) in enumerate(itertools.product(CONTENT, zip(BOILERPLATE, BOILERPLATE[11:] + BOILERPLATE[:11], strict=True))):
        # What stands after a page's text in an element of its own is labelled by that element alone.
        around = [f'<{t} {x} data-label="boilerplate">{inner(f, k + i)}</{t}>' for i, (t, x, f) in enumerate((a, b))]
        body = f"<h1>{prose(k, 5)[:-1]}</h1>" + "".join(f"<p>{prose(k + i, 8 + 11 * (i % 4))}</p>" for i in range(5))
        body += [f"<h2>{prose(k, 3)[:-1]}</h2><p>{prose(k, 40)}</p>", f"<ul><li>{prose(k, 6)}</li><li>{prose(k + 1, 5)}</li></ul>", f"<blockquote>{prose(k, 15)}</blockquote>", f"<table><tr><td>{prose(k, 2)}</td><td>12</td></tr></table>", f"<p><b>{prose(k, 6)}</b><br></p>", f"<pre>{prose(k, 9)}</pre>"][k % 6]
        # Text of an article may be linked, as a whole too.
        links_ = f'<ul><li><a href="/x">{prose(k, 6)}</a></li><li><a href="/y">{prose(k + 2, 4)}</a></li></ul>'
        body += [links_, f'<p>See <a href="/x">{prose(k, 9)}</a></p>', links_, f'<div class="note">{prose(k, 7)}</div>'][k % 4]
        within = around[1] if k % 3 == 0 else ""
        after = around[1] if k % 3 else ""
        pages.append(parse(f"<html><body>{around[0]}<{tag} {attributes} data-label=\"content\">{body}{within}</{tag}>{after}</body></html>"))
    return pages


def sampled(pages: DataFrame, rows: int, most_chars: int, folds: int = 5, held_out: int = 0) -> list[str]:
    """At most `rows` pages of at most `most_chars` characters each, outside the held-out fold of page ids, in hash order.

    Only hashes are ordered; the pages follow by a join.
    """
    some = pages.where((F.length("html") <= most_chars) & (F.crc32(F.col("page_id").cast("string")) % folds != held_out))
    some = some.select("html", F.xxhash64("html").alias("hash"))
    chosen = some.select("hash").distinct().orderBy("hash").limit(rows)
    found = some.join(F.broadcast(chosen), "hash").groupBy("hash").agg(F.min("html").alias("html")).orderBy("hash")
    return [r.html for r in found.collect()]


def fit(pages: DataFrame, rows: int = 200, most_chars: int = 50_000) -> Model:
    """The model of the examples and of a bounded sample of pages; pages that say nothing by their structure teach nothing."""
    found = [page for x in sampled(pages, rows, most_chars) if (page := by_structure(x)) is not None]
    return train([*labelled_pages(), *found])


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (blocks joined by one line feed) and n_chars for every row of `pages`, from the whole html.

    A null or empty page, or one without content, has an empty text. Character references are decoded and white space
    within a block is one space. Repeated rows each get a row, null ids and urls stay null, other columns are not read,
    and an empty table gives no rows. Broken markup never fails: tags that match nothing are left out.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or fit(pages))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in common.rows(batches, text="html"):
            text = [model.extract(x) for x in part["html"]]
            yield common.table(schema, {"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(x) for x in text]})

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of pages; see `main_text` for nulls and broken markup."""
    return main_text(common.read(spark, sf_dir, "pages"))
