"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of DOM elements and runs of text, read in one pass whose time grows with the page's
length, whatever is in it. Every node has a hidden state, content or not;
features of the element (its tag, all that the words of its class, id and role speak of, how much of its text is
in links, how long its text is, whether it wraps the article) give node potentials, and each parent and child share a potential that depends on
what kind of element the child is. Messages pass once from the leaves up and once from the root down
(sum-product, in logarithms), which gives every node's exact marginal; text whose marginal is at least
``KEEP`` is content.

Potentials are estimated by counting over labelled pages: ``labelled_pages`` writes small pages in many
layouts (semantic tags, classed divisions, tables, bare paragraphs, with menus, banners, side columns,
notices, adverts, forms, reader comments, and with wrappers, bodies and articles whose class names speak of
those) and knows which of their parts are the article. Smoothed counts
give the class priors, the likelihood of each feature and the transitions.

Defined results: null or empty html gives the empty text; unclosed and misnested elements are closed as
browsers close them; character references are decoded in text; repeated rows give a row each; an empty
table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import functools
import html as _html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import shipped, table

KEEP = 0.5
TRAIN_PAGES = 600  #: labelled pages that the potentials are counted over
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())  #: no tags are read until their end tag
UNSEEN = frozenset("noscript template select svg annotation annotation-xml".split())  #: left out up to their own end tag; without one they are empty
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp object canvas math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle mpadded semantics".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an opening tag of the key closes an open element of the values, unless one of the stops is nearer
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
_RULES = {tag: [key for key, (closes, stops) in _CLOSES.items() if tag in closes | stops] for key, (closes, stops) in _CLOSES.items() for tag in closes | stops}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul body".split())
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_BLANK = " \t\n\r\f"
#: what a word in class, id, role or itemprop speaks of
_SAYS = {
    "comment": "comment reply replie discussion discuss disqus respond response respondent reader",
    "ad": "ad advert advertisement advertising sponsor sponsored promo promoted promotion banner outbrain taboola adsense adslot",
    "notice": "cookie consent gdpr notice alert modal popup overlay subscribe subscription newsletter paywall toast",
    "nav": "nav navigation navbar menu breadcrumb crumb toolbar tab pager pagination skip topnav subnav sitemap",
    "side": "side sidebar aside rail widget related recommended recommendation recommend trending popular share sharing social tag meta byline bio",
    "foot": "foot footer copyright legal contentinfo colophon",
    "head": "head header masthead logo topbar branding",
    "form": "form search login signin signup contact",
    "main": "article content post entry hentry story main body text prose",
    "": "box wrapper wrap container list block section area inner outer wide bar page site layout col column left right top bottom item row title link button icon slot unit the of by",
}
_WORDS = {w: kind for kind, words in _SAYS.items() for w in words.split()}
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@functools.lru_cache(20_000)
def _said(word: str) -> frozenset[str]:
    """What a word speaks of, itself or as a compound of known words; its plural counts as the word."""
    for w in (word, word.removesuffix("s"), word.removesuffix("es")):
        if w in _WORDS:
            return frozenset({_WORDS[w]} - {""})
    if len(word) <= 40:  # class names are words; longer runs of letters are no compounds
        parts: list = [frozenset()] + [None] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - 14), end):
                if parts[start] is not None and end - start > 2 and word[start:end].removesuffix("s") in _WORDS:
                    parts[end] = parts[start] | ({_WORDS[word[start:end].removesuffix("s")]} - {""})
                    break
        if parts[-1] is not None:
            return parts[-1]
    return frozenset()


@functools.lru_cache(20_000)
def _name_kinds(name: str) -> tuple[frozenset[str], bool]:
    """What one name speaks of, and whether it is a single word."""
    words = _PARTS.findall(name)
    return frozenset().union(*(_said(w.lower()) for w in words)), len(words) == 1


NOTHING: frozenset[str] = frozenset()


class Node:
    __slots__ = ("tag", "kinds", "names_main", "parent", "children", "text", "chars", "linked", "titled", "wide", "under", "inside")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.kinds, self.names_main = _kinds(attrs) if attrs else (NOTHING, False)
        self.children: list[Node] = []
        self.text: str | None = None  # of runs of text
        self.chars = self.linked = 0
        self.titled = tag == "h1"  # whether it holds a first heading
        self.wide = False  # whether it wraps the article
        self.under = NOTHING  # what the ancestors that wrap no article speak of, this node included
        self.inside = False  # whether an ancestor or the node is an article


def _kinds(attrs: str) -> tuple[frozenset[str], bool]:
    """What an element's names speak of, and whether one name of a single word says article. Where
    single words say something, compounds of other names say nothing: post beside tag-sponsor."""
    if "=" not in attrs and "hidden" not in attrs.lower():
        return NOTHING, False
    whole, part = set(), set()
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name == "hidden":
            return frozenset({"hidden"}), False
        if name in _NAMED:
            for word in (m[2] or m[3] or m[4] or "").split():
                kinds, single = _name_kinds(word) if len(word) < 200 else (NOTHING, False)
                (whole if single else part).update(kinds)
    return frozenset(whole if "main" in whole else whole | part), "main" in whole


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """The place of the ``>`` of the tag whose name ends at ``at``, -1 without one. Quotes count where
    they open a value; one that is not closed, or only by the quote that opens the value of a later tag, does
    not. missing: quotes that do not occur from here on."""
    start = at
    while True:
        m = _STOP.search(page, at)
        if not m:
            return -1
        i, c = m.start(), m[0]
        if c == ">":
            return i
        at = before = i + 1
        while before > start + 1 and page[before - 2] in _BLANK:
            before -= 1
        if page[before - 2] != "=" or c in missing:
            continue
        close = page.find(c, at)
        if close < 0:
            missing.add(c)
        elif not (page[close - 1] == "=" and close + 1 < len(page) and page[close + 1] not in _BLANK + "/>" and page.find("<", at, close) > page.find(">", at, close) >= 0):
            at = close + 1


def tokens(page: str) -> list[tuple]:
    """(None, text), (tag, attributes) of opening and ("/" + tag, "") of closing tags, in order. What
    stands in elements that hold no tags, in comments and declarations is left out."""
    out, at, missing = [], 0, set()
    while True:
        i = page.find("<", at)
        while 0 <= i and not (page[i + 1 : i + 2].isalpha() and page[i + 1] < "\x7f" or page[i + 1 : i + 2] in ("/", "!", "?") and page[i + 2 : i + 3]):
            i = page.find("<", i + 1)
        if i < 0:
            out.append((None, page[at:]))
            return out
        if i > at:
            out.append((None, page[at:i]))
        closing = page[i + 1] == "/"
        name = _TAG.match(page, i + 1 + closing)
        if page.startswith("<!--", i):
            at = page.find("-->", i + 2) + 3
            if at < 3:
                return out
            out.append(("!", ""))
            continue
        if name is None:  # a declaration, or a closing tag without a name
            at = page.find(">", i) + 1
            if not at:
                return out
            out.append(("!", ""))
            continue
        end = _tag_end(page, name.end(), missing)
        if end < 0:
            return out
        tag, at = name[0].lower(), end + 1
        out.append(("/" + tag, "") if closing else (tag, page[name.end() : end]))
        if tag in RAW and not closing:
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            if not close:
                return out
            at = close.start()


def _past(toks: list[tuple]) -> dict[int, int]:
    """Where each closed element that is left out ends, by the place of its opening tag."""
    ends, open_ = {}, {}
    for i, (tag, attrs) in enumerate(toks):
        if tag in UNSEEN and not (tag == "svg" and attrs.endswith("/")):
            open_.setdefault(tag, []).append(i)
        elif tag is not None and tag[0] == "/" and open_.get(tag[1:]):
            ends[open_[tag[1:]].pop()] = i
    return ends


def parse(page: str) -> Node:
    """The tree of a page; adjacent pieces of text stay apart where elements or comments lie between."""
    root = now = Node("#root", "", None)
    toks = tokens(page)
    past = _past(toks) if any(t in UNSEEN for t, _ in toks) else {}
    # what is open, so that no search climbs past what it will close: elements by tag, inline ones by tag
    # within each block, and of each rule of _CLOSES those that it names
    depth: dict[str, int] = {}
    scopes: list[tuple[Node, dict[str, int]]] = [(root, {})]
    ruled: dict[str, list[Node]] = {key: [] for key in _CLOSES}

    def open_(x: Node) -> None:
        nonlocal now
        now = x
        depth[x.tag] = depth.get(x.tag, 0) + 1
        if x.tag in INLINE:
            scopes[-1][1][x.tag] = scopes[-1][1].get(x.tag, 0) + 1
        else:
            scopes.append((x, {}))
        for key in _RULES.get(x.tag, ()):
            ruled[key].append(x)

    def up(x: Node) -> None:
        """Closes elements up to and with x."""
        nonlocal now
        while True:
            depth[now.tag] -= 1
            if now.tag in INLINE:
                scopes[-1][1][now.tag] -= 1
            else:
                scopes.pop()
            for key in _RULES.get(now.tag, ()):
                ruled[key].pop()
            done, now = now is x, now.parent
            if done:
                return

    i = -1
    while i + 1 < len(toks):
        i += 1
        tag, attrs = toks[i]
        if tag is None:
            blank = attrs.isspace()
            if attrs and (not blank or now.children):
                leaf = Node("#text", "", now)
                leaf.text = " " if blank else attrs
                now.children.append(leaf)
            continue
        if tag == "!":
            continue
        if tag[0] == "/":  # an end tag closes up to the nearest open element of its name, past inline ones only
            tag = tag[1:]
            if scopes[-1][1].get(tag) if tag in INLINE else any(depth.get(h) for h in HEADS) if tag in HEADS else depth.get(tag):
                x = now
                while x.tag != tag and not (tag in HEADS and x.tag in HEADS):
                    x = x.parent
                up(x)
            continue
        if tag in _ENDS_P and scopes[-1][0].tag == "p":
            up(scopes[-1][0])
        if tag in _CLOSES:
            last = None
            for x in reversed(ruled[tag]):
                if x.tag in _CLOSES[tag][1]:
                    break
                last = x
            if last is not None:
                up(last)
        node = Node(tag, attrs, now)
        now.children.append(node)
        if tag in RAW:
            i += 1  # to the closing tag; without one the page ends here
        elif tag in UNSEEN:
            i = past.get(i, i)
        elif tag not in VOID and not (tag in ("svg", "math") and attrs.endswith("/")):
            open_(node)
    return root


#: tags that speak as names do
_SPEAKS = {"nav": "nav", "menu": "nav", "aside": "side", "footer": "foot", "header": "head", "form": "form", "button": "form", "label": "form"}
_ARTICLE = frozenset(("article", "main"))


def flat(root: Node) -> list[Node]:
    """Nodes, each after its parent; sums of text and what ancestors say filled in."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(x.children))
    for x in reversed(out):
        if x.text is not None:
            x.chars = len(x.text.strip())
        if x.tag == "a":
            x.linked = x.chars
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.linked += x.linked
            x.parent.titled |= x.titled
    total = root.chars or 1
    for x in reversed(out):  # what wraps: the page, an article of weight and all around it
        chrome = x.kinds - {"main"}
        is_article = (x.tag in _ARTICLE and not chrome) or x.names_main
        x.wide |= x.tag in ("#root", "html", "body") or (x.titled and x.chars >= 0.5 * total) or x.chars >= 0.9 * total or (is_article and (x.titled or x.chars >= 0.4 * total))
        if x.parent is not None and x.wide:
            x.parent.wide = True
    for x in out:
        if x.parent is not None:
            x.under, x.inside = x.parent.under, x.parent.inside
        if x.text is None and not x.wide and not (x.inside and x.titled and x.tag == "header"):
            spoken = x.kinds - {"main"} or ({_SPEAKS[x.tag]} if x.tag in _SPEAKS else NOTHING)
            if spoken:
                x.under = x.under | spoken
        x.inside |= x.tag in _ARTICLE or x.names_main
    return out


_TAG_GROUP = {t: t for t in "#root #text article main section div p nav header footer aside form table td ul ol li blockquote pre figure figcaption body head a button dl details address".split()} | {t: "heading" for t in HEADS} | {t: "inline" for t in INLINE if t != "a"} | {t: "raw" for t in RAW | UNSEEN} | {t: "void" for t in VOID}


def features(x: Node) -> tuple[str, ...]:
    size = min(6, int(math.log2(x.chars + 1)) // 2)
    around = (f"inside:{x.inside}", *(f"under:{k}" for k in sorted(x.under) or "-"))
    if x.tag == "#text":
        return (f"text:{size}", f"in:{_TAG_GROUP.get(x.parent.tag, 'other')}", *around)
    density = 0 if not x.chars else 1 + min(3, int(4 * x.linked / x.chars))
    kinds = (f"kind:{k}:{x.wide}" for k in sorted(x.kinds) or "-")
    return (f"tag:{_TAG_GROUP.get(x.tag, 'other')}", f"size:{size}", f"links:{density}", *kinds, *around)


class TreeModel:
    """State 1 is content."""

    def __init__(self):
        self.node: dict[str, np.ndarray] = {}
        self.edge: dict[str, np.ndarray] = {}
        self.plain = np.zeros(2)
        self.plain_edge = np.zeros((2, 2))

    def fit(self, pages: list[tuple[list[Node], list[int]]], smooth: float = 0.5) -> TreeModel:
        """pages: nodes and their states."""
        seen, of, edges, prior = {}, {}, {}, np.full(2, smooth)
        for nodes, states in pages:
            state = {id(x): s for x, s in zip(nodes, states)}
            for x, s in zip(nodes, states):
                prior[s] += 1
                for f in features(x):
                    seen.setdefault(f, np.full(2, smooth))[s] += 1
                    of.setdefault(f.partition(":")[0], np.full(2, 8 * smooth))[s] += 1
                if x.parent is not None:
                    edges.setdefault(_TAG_GROUP.get(x.tag, "other"), np.full((2, 2), smooth))[state[id(x.parent)], s] += 1
        self.node = {f: np.log(n / of[f.partition(":")[0]]) for f, n in seen.items()}
        self.edge = {t: np.log(n / n.sum(axis=1, keepdims=True)) for t, n in edges.items()}
        total = sum(edges.values())
        self.plain_edge = np.log(total / total.sum(axis=1, keepdims=True))
        return self

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node. Two numbers a message, in plain floats."""
        n = len(nodes)
        place = {id(x): i for i, x in enumerate(nodes)}
        own, pair, parent = [None] * n, [None] * n, [-1] * n
        zero = np.zeros(2)
        for i, x in enumerate(nodes):
            a = b = 0.0
            for f in features(x):
                v = self.node.get(f, zero)
                a, b = a + v[0], b + v[1]
            own[i] = [float(a), float(b)]
            pair[i] = self.edge.get(_TAG_GROUP.get(x.tag, "other"), self.plain_edge).tolist()
            parent[i] = place[id(x.parent)] if x.parent is not None else -1
        up = [None] * n
        for i in range(n - 1, 0, -1):  # children come after parents
            e, o = pair[i], own[i]
            up[i] = (_add(e[0][0] + o[0], e[0][1] + o[1]), _add(e[1][0] + o[0], e[1][1] + o[1]))
            p = own[parent[i]]
            p[0] += up[i][0]
            p[1] += up[i][1]
        # own now holds each node's evidence from itself and below
        belief = [None] * n
        belief[0] = own[0]
        for i in range(1, n):
            b, u, e, o = belief[parent[i]], up[i], pair[i], own[i]
            c0, c1 = b[0] - u[0], b[1] - u[1]
            t = max(c0, c1)
            c0, c1 = c0 - t, c1 - t
            belief[i] = (_add(c0 + e[0][0], c1 + e[1][0]) + o[0], _add(c0 + e[0][1], c1 + e[1][1]) + o[1])
        return [1 / (1 + math.exp(min(700.0, b[0] - b[1]))) for b in belief]


def _add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


_SPACE = re.compile(r"\s+")


def blocks(nodes: list[Node], keep: list[bool]) -> list[str]:
    """Texts of blocks in page order: runs of kept text without a block element's edge or a kept-out
    part between them."""
    kept = {id(x): k for x, k in zip(nodes, keep)}
    out, run = [], []

    def end() -> None:
        if run:
            s = _SPACE.sub(" ", _html.unescape("".join(run))).strip()
            if s:
                out.append(s)
            run.clear()

    stack: list[tuple[Node, bool]] = [(nodes[0], False)]
    while stack:
        x, leaving = stack.pop()
        if x.text is not None:
            if kept[id(x)] or x.text == " " and run:
                run.append(x.text)
            continue
        if x.tag == "br":
            run.append(" ")
        elif x.tag not in INLINE:
            end()
        if not leaving and x.tag not in VOID:
            stack.append((x, True))
            stack.extend((c, False) for c in reversed(x.children))
    end()
    return out


def extract(page: str | None, model: TreeModel) -> str:
    if not page:
        return ""
    nodes = flat(parse(page))
    p = model.marginals(nodes)
    return " ".join(blocks(nodes, [x.tag == "#text" and q >= KEEP for x, q in zip(nodes, p)]))


# --- labelled pages -------------------------------------------------------------------------------

_MARK = "\x02"  # stands before text that is content


def labelled_pages(count: int = TRAIN_PAGES, seed: int = 17) -> list[tuple[str, None]]:
    """Pages in which every run of text that is content begins with _MARK."""
    r = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice("abcdefghiklmnoprstuvz") for _ in range(r.randint(1, 9))) for _ in range(r.randint(lo, hi)))

    def prose(mark: str) -> str:
        """Paragraph text with inline elements."""
        parts = []
        for _ in range(r.randint(1, 3)):
            parts.append(mark + words(1, 60) + r.choice(["", ".", ".", "?"]))
            if r.random() < 0.25:
                t = r.choice(["b", "i", "em", "strong", "span", "code"])
                parts.append(f"<{t}>{mark}{words(1, 6)}</{t}>")
            if r.random() < 0.15:
                parts.append(f'<a href="/x">{mark}{words(1, 4)}</a>')
        return " ".join(parts)

    def article_body() -> str:
        c, out = _MARK, []
        if r.random() < 0.8:
            title = f"<h1>{c}{words(1, 12)}</h1>"
            out.append(title if r.random() < 0.85 else f"<header>{title}</header>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.7:
                body = prose(c) if r.random() < 0.7 else f"{c}{words(1, 3)}."
                if r.random() < 0.15:
                    body = f"<b>{body}<br>"  # not closed
                out.append(f"<p>{body}" + ("</p>" if r.random() < 0.85 else ""))
            elif k < 0.78:
                out.append(f"<h{r.randint(2, 4)}>{c}{words(1, 8)}</h{r.randint(2, 4)}>")
            elif k < 0.84:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li>{c}{words(1, 20)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif k < 0.88:
                out.append(f"<blockquote><p>{c}{words(4, 40)}</p></blockquote>")
            elif k < 0.91:
                out.append(f"<pre>{c}{words(3, 30)}</pre>")
            elif k < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}{words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif k < 0.97:
                out.append(r.choice([ad, notice, side, share])())
            else:
                out.append(f"<div>{prose(c)}</div>")
        return "".join(out)

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def block(names: list[str], tags: list[str], body: str) -> str:
        t = r.choice(tags)
        a = f' {r.choice(["class", "id", "class"])}="{r.choice(names)}"' if t in ("div", "section", "p", "ul", "table", "span") or r.random() < 0.5 else ""
        return f"<{t}{a}>{body}</{t}>"

    def plain() -> str:
        return "".join(f"<p>{words(1, 40)}</p>" for _ in range(r.randint(1, 3))) if r.random() < 0.6 else words(1, 30)

    def nav() -> str:
        return block(["nav", "main-menu", "breadcrumbs", "topnav", "menu"], ["nav", "nav", "div", "ul"], links(r.randint(3, 9)))

    def ad() -> str:
        return block(["ad", "ads", "advert", "ad-slot", "sponsored", "promo"], ["div", "div", "aside", "section"], plain())

    def notice() -> str:
        return block(["cookie-notice", "notice", "consent", "newsletter", "alert", "subscribe-box"], ["div", "section", "aside"], plain() + (f"<button>{words(1, 2)}</button>" if r.random() < 0.5 else ""))

    def side() -> str:
        return block(["sidebar", "related", "widget", "right-rail", "recommended"], ["aside", "div", "section"], f"<h{r.randint(2, 4)}>{words(1, 4)}</h3>" + (links(r.randint(2, 6)) if r.random() < 0.5 else plain()))

    def share() -> str:
        return block(["share", "social", "tags", "meta"], ["div", "ul", "p"], links(r.randint(2, 5)) if r.random() < 0.6 else words(1, 6))

    def header() -> str:
        return block(["header", "masthead", "site-header", "topbar"], ["header", "header", "div"], f"<h1>{words(1, 4)}</h1>" * (r.random() < 0.3) + words(1, 8) + nav() * (r.random() < 0.5))

    def footer() -> str:
        return block(["footer", "site-footer", "copyright", "legal"], ["footer", "footer", "div"], r.choice([f"&copy; {words(2, 30)}", f"<p>&copy; {words(2, 12)}</p>" + links(r.randint(2, 6)), plain()]))

    def form() -> str:
        return block(["search-form", "login", "signup", "contact-form"], ["form", "form", "div"], f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>" + plain() * (r.random() < 0.4))

    def comments() -> str:
        one = lambda: block(["comment", "reply", "comment-body"], ["div", "li", "article"], f"<b>{words(1, 2)}</b><p>{words(3, 60)}</p>")
        return block(["comments", "comment-list", "discussion", "responses"], ["section", "div", "section"], f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))

    def hidden() -> str:
        return f"<div hidden>{plain()}</div>"

    def strange() -> str:
        """Class names that speak of a page's other parts, on what wraps the article."""
        parts = ["sidebar", "header", "social", "ad", "nav", "menu", "footer", "widget", "form", "notice", "promo", "meta", "share", "search", "tag"]
        kinds = ["layout", "wide", "wrapper", "container", "page", "with", "no", "news", "site", "main", "grid"]
        return " ".join(r.choice(["{0}-{1}", "{1}-{0}", "{1}-{0}-{2}", "{0}_{1}"]).format(r.choice(parts), r.choice(kinds), r.choice(kinds)) for _ in range(r.randint(1, 2)))

    pages = []
    for _ in range(count):
        layout = r.random()
        body = article_body()
        if r.random() < 0.2:
            body += comments()
        if layout < 0.5:
            named = r.choice(["", "", "", ' class="post"', f' class="post {strange()}"', f' class="{strange()} entry"'])
            core = f"<article{named}>{body}</article>"
        elif layout < 0.62:
            core = f"<main>{body}</main>"
        elif layout < 0.85:
            core = f'<div {r.choice(["class", "id"])}="{r.choice(["content", "post", "entry-content", "article-body", "story", "main"])}">{body}</div>'
        else:
            core = body
        if r.random() < 0.15:
            core = f'<div class="{strange()}">{core}</div>'
        before = [f() for f in (header, nav, ad, notice, form, side, hidden) if r.random() < 0.4]
        after = [f() for f in (side, ad, form, comments, share, notice, footer) if r.random() < 0.4]
        r.shuffle(before)
        whole = f"{''.join(before)}{'<!-- x -->' * (r.random() < 0.3)}{core}{''.join(after)}"
        if r.random() < 0.15:
            whole = r.choice(['<div class="{0}">{1}</div>', '<form id="{0}">{1}</form>']).format(strange(), whole)
        named = f' class="{strange()}"' if r.random() < 0.3 else ""
        pages.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(1, 8)}</title><style>p{{}}</style><script>var t=1</script></head><body{named}>{whole}</body></html>")
    return pages


def _states(nodes: list[Node]) -> list[int]:
    """Text is content where it is marked, elements where most of their text is."""
    amount = {id(x): [0, 0] for x in nodes}
    for x in reversed(nodes):
        if x.text is not None and x.text != " ":
            marked = _MARK in x.text
            amount[id(x)][marked] += x.chars
        if x.parent is not None:
            for i in (0, 1):
                amount[id(x.parent)][i] += amount[id(x)][i]
    out = []
    for x in nodes:
        a, b = amount[id(x)]
        out.append(int(b > a) if a or b else -1)
    place = {id(x): i for i, x in enumerate(nodes)}
    for i, x in enumerate(nodes):  # what has no text is as its parent
        if out[i] < 0:
            out[i] = out[place[id(x.parent)]] if x.parent is not None else 0
    return out


_MODELS: dict[tuple, TreeModel] = {}


def trained(pages: int = TRAIN_PAGES) -> TreeModel:
    if pages not in _MODELS:
        got = []
        for page in labelled_pages(pages):
            nodes = flat(parse(page))
            got.append((nodes, _states(nodes)))
        _MODELS[pages] = TreeModel().fit(got)
    return _MODELS[pages]


TEXTS = "page_id long, url string, text string, n_chars long"


def main_texts(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    from pyspark.sql import functions as F

    shipped(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t.as_py(), model) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, TEXTS)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"), trained())


ORACLES = {}
QUERIES = {"op9_main_text": op9_main_text}
