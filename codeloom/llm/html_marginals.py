"""Main text of web pages by a tree-structured graphical model over the DOM.

The block elements of a page are the nodes of a tree; each is content or not. A node's potential comes from its tag, its
names (class, id, role), its own text and links; an edge's potential depends on both labels and on whether the child
looks like the start of page furniture, of the article, or like neither. Sum-product messages from the leaves to the
root and back give exact marginals, and blocks of marginal over one half make up the text. Weights are fitted to
labelled pages by the gradient of the likelihood: labelled minus expected counts, the latter from the same messages.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Elements by their role in HTML.
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset address details summary dialog menu center hgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head noscript template svg select button object canvas audio video datalist map".split())
#: What can stand in a head; any other start tag, or text, ends an open one.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "summary"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("html body table ul ol dl div section article aside nav header footer main form td th blockquote".split())

#: Starts of class, id and role names.
NAMES = {
    "menu": "nav menu breadcrumb crumb toolbar topbar navbar skip pagination pager tabs toc",
    "frame": "header masthead footer foot sidebar side rail widget copyright colophon sitemap",
    "advert": "ad ads advert adv sponsor promo banner dfp outbrain taboola affiliate",
    "notice": "cookie consent notice gdpr alert popup modal overlay newsletter subscribe signup login paywall disclaimer hidden",
    "talk": "comment comments disqus reply replies respond discussion feedback review",
    "extra": "related share social recommend more tags tag author byline meta rating print trending",
    "content": "article content main post story entry hentry body text page single prose",
}
#: Words that name furniture, but also stand among the names of articles.
WEAK = frozenset("tag author byline meta more print rating trending".split())
#: Starts of names that file an article under a term, and ends by which such a name means a group of its own.
TERMS = frozenset("tag author category cat topic type status format series".split())
GROUPS = frozenset("list cloud box bio info links menu nav card block area items".split())
_NAME_OF = {start: kind for kind, starts in NAMES.items() for start in starts.split()}
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
TAGS = {t: t for t in "p li td div section article main nav header footer aside form ul table blockquote pre body figure".split()}
TAGS |= {"ol": "ul", "dl": "ul", "dd": "li", "dt": "li", "th": "td", "tr": "table", "tbody": "table", "thead": "table", "html": "body", "figcaption": "figure", "menu": "nav"} | {f"h{i}": "h" for i in range(1, 7)}

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
#: A whole attribute, so that nothing is looked for inside the value of another one.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: The attribute by which labelled pages mark furniture; the model does not see it.
NOT_CONTENT = "data-other"
_WORD = re.compile(r"[a-z]+")
_CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


@dataclass
class Node:
    tag: str
    parent: int
    names: frozenset[str]
    chars: int = 0
    links: int = 0
    stops: int = 0
    children: int = 0
    label: int = -1


@dataclass
class Page:
    """Nodes, parents first; parts are (node, text) in page order, text None for a break."""

    nodes: list[Node] = field(default_factory=list)
    parts: list[tuple[int, str | None]] = field(default_factory=list)


def _names(attributes: str) -> frozenset[str]:
    found = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("notice")
        elif name in ("class", "id", "role"):
            for token in value.split():
                found |= _token_kinds(_WORD.findall(token))
    if "content" in found:
        found.discard("weak")  # `entry-content more`
        if len(found) > 1:
            found.discard("content")  # `content-sidebar`, `post-comments`
    return frozenset("extra" if kind == "weak" else kind for kind in found)


def _token_kinds(words: list[str]) -> set[str]:
    """What the words of one name say; `weak` where they speak of furniture only if nothing else speaks of content."""
    kinds = [_NAME_OF.get(word) or _NAME_OF.get(word.rstrip("s")) for word in words]
    if len(words) > 1 and words[0] in TERMS and words[-1] not in GROUPS and kinds[-1] in (None, "content"):
        return set()  # `tag-rome`, `author-bob`, `type-post`: what the article is filed under
    out = {"weak" if word.rstrip("s") in WEAK else kind for word, kind in zip(words, kinds) if kind}
    if out == {"weak", "content"}:
        return {"content"} if kinds[-1] == "content" else {"extra"}  # `meta-post` and `post-meta`
    return out


def parse(text: str) -> Page:
    """The block tree of a page, however badly nested; linear in its length."""
    page = Page([Node("body", -1, frozenset())])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block they stand in
    places: dict[str, list[int]] = {}  # of the open elements of a tag, on the stack
    dropped, link = 0, 0
    at = 0

    def say(raw: str) -> None:
        if dropped or not raw:
            return
        said = html_lib.unescape(raw) if "&" in raw else raw
        node = page.nodes[stack[-1][1]]
        n = len(said) - said.count(" ")
        node.chars += n
        node.stops += said.count(". ") + said.count(".\n") + said.rstrip().endswith((".", "!", "?")) + said.count(", ")
        if link:
            node.links += n
        page.parts.append((stack[-1][1], said))

    def close(index: int) -> None:
        nonlocal dropped, link
        while len(stack) > index:
            tag, block = stack.pop()
            if stack:
                places[tag].pop()
            dropped -= tag in DROPPED
            link -= tag == "a"
            if tag in BLOCKS:
                page.parts.append((block, None))

    def find(tags: set[str] | frozenset[str], stop: frozenset[str]) -> int:
        # the last open element of these tags, unless one of `stop` stands inside it
        found = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if not found:
            return 0
        return found if found >= max((places[t][-1] for t in stop if places.get(t)), default=0) else 0

    while (m := _TOKEN.search(text, at)) is not None:
        if stack[-1][0] == "head" and text[at:m.start()].strip():
            close(len(stack) - 1)
        say(text[at:m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            # an end tag closes its element if one is open; inline tags do not reach out of their block
            if i := find({tag}, frozenset() if tag in BLOCKS or tag in DROPPED else SCOPES):
                close(i)
            elif tag in ("br", "p"):
                page.parts.append((stack[-1][1], None))
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag in RAW:
            end = _CLOSERS[tag].search(text, at)
            close_at = text.find(">", end.end()) if end else -1
            at = close_at + 1 if close_at >= 0 else len(text)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                page.parts.append((stack[-1][1], None))
            continue
        if tag == "a" and (i := find({"a"}, SCOPES)):
            close(i)
        if tag in CLOSES_P and (i := find({"p"}, SCOPES)):
            close(i)
        if tag in CLOSED_BY and (i := find(CLOSED_BY[tag], SCOPES - CLOSED_BY[tag])):
            close(i)
        if m.group(3).endswith("/") and tag not in BLOCKS:
            continue
        block = stack[-1][1]
        if tag in BLOCKS:
            page.parts.append((block, None))
            if not dropped and tag not in ("html", "body"):
                page.nodes.append(Node(tag, block, _names(m.group(3)), label=0 if NOT_CONTENT in m.group(3) else -1))
                page.nodes[block].children += 1
                block = len(page.nodes) - 1
        dropped += tag in DROPPED
        link += tag == "a"
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, block))
        if tag == "body":
            dropped = 0  # an unclosed head ends here
            stack[:] = [("html", 0), (tag, 0)]
            places = {tag: [1]}
            link = 0
    if stack[-1][0] == "head" and text[at:].strip():
        close(len(stack) - 1)
    say(text[at:])
    return page


def _step(value: float, bounds: tuple[float, ...]) -> int:
    return sum(value >= b for b in bounds)


def node_features(page: Page, i: int) -> list[str]:
    node = page.nodes[i]
    out = ["bias", f"tag={TAGS.get(node.tag, 'other')}", f"chars={_step(node.chars, (1, 25, 80, 250))}"]
    out += [f"name={n}" for n in node.names]
    if node.chars:
        out += [f"links={_step(node.links / node.chars, (0.01, 0.3, 0.7))}", f"stops={_step(node.stops, (1, 3))}", f"tag={TAGS.get(node.tag, 'other')},links={node.links > 0.5 * node.chars}"]
    return out


def edge_kind(node: Node) -> str:
    if node.tag in FURNITURE or node.names and "content" not in node.names:
        return "furniture"
    return "article" if node.tag in ("article", "main") or node.names else "plain"


class TreeModel:
    """Weights of node features (log odds of content) and of (edge kind, parent label, child label)."""

    def __init__(self):
        self.node: dict[str, float] = {}
        self.edge: dict[tuple[str, int, int], float] = {(k, a, b): (0.5 if a == b else 0.0) for k in ("plain", "article", "furniture") for a in (0, 1) for b in (0, 1)}

    def marginals(self, page: Page) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """P(content) of each node, and P(parent label, child label) in the order 00 01 10 11 of each edge."""
        nodes, n = page.nodes, len(page.nodes)
        own = [math.exp(min(30.0, max(-30.0, sum(self.node.get(f, 0.0) for f in node_features(page, i))))) for i in range(n)]
        factor = {k: tuple(math.exp(self.edge[k, a, b]) for a in (0, 1) for b in (0, 1)) for k in ("plain", "article", "furniture")}
        kinds = [factor[edge_kind(node)] for node in nodes]
        # upward: beliefs of each subtree as the odds 1:r, scaled to sum 1
        up = [(1 / (1 + o), o / (1 + o)) for o in own]
        sent: list[tuple[float, float]] = [(0.5, 0.5)] * n
        for i in range(n - 1, 0, -1):
            p, e, (u0, u1) = nodes[i].parent, kinds[i], up[i]
            m0, m1 = e[0] * u0 + e[1] * u1, e[2] * u0 + e[3] * u1
            s = m0 + m1
            sent[i] = (m0 / s, m1 / s)
            b0, b1 = up[p][0] * m0, up[p][1] * m1
            s = b0 + b1 or 1e-300
            up[p] = (max(b0 / s, 1e-200), max(b1 / s, 1e-200))
        # downward: what a node believes without the message of the child
        out, joint = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
        full = list(up)
        out[0] = up[0][1]
        for i in range(1, n):
            p, e = nodes[i].parent, kinds[i]
            r0, r1 = full[p][0] / sent[i][0], full[p][1] / sent[i][1]
            u0, u1 = up[i]
            j = (r0 * e[0] * u0, r0 * e[1] * u1, r1 * e[2] * u0, r1 * e[3] * u1)
            s = sum(j) or 1e-300
            joint[i] = (j[0] / s, j[1] / s, j[2] / s, j[3] / s)
            out[i] = joint[i][1] + joint[i][3]
            full[i] = (max(1 - out[i], 1e-200), max(out[i], 1e-200))
        return out, joint

    def fit(self, pages: list[Page], rounds: int = 40, rate: float = 0.4, decay: float = 0.01) -> "TreeModel":
        square: dict = {}
        for _ in range(rounds):
            grad: dict = {}
            for page in pages:
                p, joint = self.marginals(page)
                for i, node in enumerate(page.nodes):
                    for f in node_features(page, i):
                        grad[f] = grad.get(f, 0.0) + node.label - p[i]
                    if i:
                        kind, seen = edge_kind(node), 2 * page.nodes[node.parent].label + node.label
                        for k in range(4):
                            key = (kind, k // 2, k % 2)
                            grad[key] = grad.get(key, 0.0) + (k == seen) - joint[i][k]
            for key, g in grad.items():
                weights = self.edge if isinstance(key, tuple) else self.node
                g = g / len(pages) - decay * weights.get(key, 0.0)
                square[key] = square.get(key, 1e-8) + g * g
                weights[key] = weights.get(key, 0.0) + rate * g / math.sqrt(square[key])
        return self

    def extract(self, text: str | None) -> str:
        """The main text of a page; empty for null, for empty pages and for pages without content."""
        if not text:
            return ""
        page = parse(text)
        p, _ = self.marginals(page)
        out = [" " if t is None else t for i, t in page.parts if t is None or p[i] > 0.5]
        return " ".join("".join(out).split())


def labelled_page(rng: random.Random) -> str:
    """A page of random layout; elements that are not content carry the attribute NOT_CONTENT."""
    x = NOT_CONTENT

    def words(least: int, most: int, link: bool = False) -> str:
        made = []
        for i in range(rng.randint(least, most)):
            w = "".join(rng.choice(("an", "er", "st", "io", "ta", "el", "on", "ri", "de")) for _ in range(rng.randint(1, 4)))
            if link and rng.random() < 0.3:
                w = f'<a href="/{w}">{w}</a>'
            made.append(w + (rng.choice((".", ",", "", "", "", "", "", "")) if i % 7 == 6 else ""))
        return (" ".join(made)).capitalize() + ("." if most > 8 else "")

    def named(tag: str, names: tuple[str, ...], inner: str, plain: float = 0.15, content: bool = False) -> str:
        name = "" if rng.random() < plain else f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"'
        return f"<{tag}{name}{'' if content else ' ' + x}>{inner}</{tag}>"

    def links(least: int, most: int, mark: str = " data-other") -> str:
        return f"<ul{mark}>" + "".join(f'<li{mark}><a href="/{i}">{words(1, 4)}</a></li>' for i in range(rng.randint(least, most))) + "</ul>"

    def closed(text: str, tag: str = "p") -> str:
        return f"<{tag}>{text}" + (f"</{tag}>" if rng.random() < 0.8 else "")

    def body() -> str:
        out = [closed(words(2, 9), f"h{rng.randint(1, 2)}") + "</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((0, 1, 1, 2, 4, 8))):
            kind = rng.random()
            if kind < 0.7:
                out.append(closed(rng.choice(("", "", "<b>")) + words(1, 80, rng.random() < 0.3) + rng.choice(("", "", "<br>"))))
            elif kind < 0.8:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{words(2, 25, True)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{closed(words(5, 40))}</blockquote>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 8)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                out.append(f"<div>{words(5, 60)}</div>")
            if rng.random() < 0.08:
                out.append(named("div", ("ad", "advert", "promo-box", "ad-slot"), words(2, 25), 0))
            if rng.random() < 0.05:
                out.append(named("div", ("share", "social-links", "related"), links(2, 5), 0))
        return "".join(out) or words(3, 60)

    def comments() -> str:
        one = lambda: f'<div class="comment" {x}><p {x}>{words(3, 40)}</p></div>'
        return named(rng.choice(("section", "div", "ol")), ("comments", "comment-list", "disqus_thread", "discussion"), f"<h3 {x}>Comments</h3>" + "".join(one() for _ in range(rng.randint(1, 4))), 0)

    def maybe(chance: float, make) -> str:
        return make() if rng.random() < chance else ""

    notice = lambda: named("div", ("cookie-notice", "consent", "alert", "newsletter", "popup"), f"<p {x}>{words(4, 30)}</p>", 0)
    form = lambda: f"<form {x}>{words(1, 6)}<input name=q><label>{words(1, 3)}</label></form>"
    nav = lambda: named(rng.choice(("nav", "nav", "div", "ul")), ("menu", "nav", "breadcrumbs", "topbar"), links(3, 9), 0.3)
    head = lambda: named(rng.choice(("header", "header", "div")), ("header", "masthead", "site-header"), f"<h1 {x}>{words(1, 4)}</h1>" + maybe(0.5, nav) + maybe(0.3, form), 0)
    ad = lambda: named("div", ("ad", "ads", "banner", "sponsored", "advert-top"), words(2, 30), 0)
    aside = lambda: named(rng.choice(("aside", "aside", "div")), ("sidebar", "widget", "rail"), f"<h3 {x}>{words(1, 3)}</h3>" + links(2, 7) + maybe(0.4, lambda: f"<p {x}>{words(3, 30)}</p>"), 0)
    foot = lambda: named(rng.choice(("footer", "footer", "footer", "div")), ("footer", "site-footer", "copyright"), rng.choice((f"&copy; {words(2, 20)}", f"<p {x}>&copy; {words(3, 25)}</p>" + links(2, 5))), 0)
    tag, names = rng.choice((("article", ("post", "story", "x")), ("article", ("entry", "x")), ("main", ("content", "x")), ("div", ("content", "article-body", "post", "entry-content")), ("section", ("story", "main")), ("div", ("x", "wrap", "c1"))))
    filed = (" type-post hentry category-news tag-x", " hentry tag-x", " author-x", " meta-post", " more", "")
    names = tuple(n + rng.choice(filed) for n in names)
    article = named(tag, names, body() + maybe(0.1, comments), 0.6 if tag in ("article", "main") else 0, content=True)
    if rng.random() < 0.15:
        article = body()
    if rng.random() < 0.3:
        article = f"<div class=\"{rng.choice(('wrap', 'container', 'row', 'page'))}\">{article}</div>"
    parts = maybe(0.4, head) + maybe(0.7, nav) + maybe(0.2, notice) + maybe(0.5, ad) + article + maybe(0.3, comments) + maybe(0.4, aside) + maybe(0.15, form) + maybe(0.7, foot)
    return f"<html><head><title>{words(1, 5)}</title></head><body>{parts}" + maybe(0.8, lambda: "</body></html>")


def labelled(text: str) -> Page:
    """A labelled page: what stands in an element with the attribute NOT_CONTENT is not content, all else is."""
    page = parse(text)
    for i, node in enumerate(page.nodes):
        node.label = int(not (i and (node.label == 0 or page.nodes[node.parent].label == 0)))
    return page


@lru_cache(maxsize=4)
def trained(pages: int = 300, seed: int = 6) -> TreeModel:
    """A model fitted to so many labelled pages."""
    rng = random.Random(seed)
    return TreeModel().fit([labelled(labelled_page(rng)) for _ in range(pages)])


def extract_text(pages: DataFrame, model: TreeModel, html_col: str = "html") -> DataFrame:
    """pages packed as `row` (all columns) with `text`; repeated rows are read each, null html gives an empty text."""

    @F.pandas_udf("string")
    def main_text(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([model.extract(t) for t in texts], dtype=object)

    return pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), main_text(F.col(html_col)).alias("text"))


def op6_query(pages: DataFrame) -> DataFrame:
    return extract_text(pages, trained()).select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
