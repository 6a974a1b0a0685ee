"""HTML extraction with a tree-structured graphical model over DOM nodes.

Every element is a binary variable (content or not). Its features give it two scores; each edge between
parent and child gives a 2x2 potential that depends on whether the child is a section of its own.
Sum-product messages go from the leaves to the root and back; the marginals decide which text blocks are
content. Weights are fitted by the gradient of the exact conditional likelihood of labelled pages.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of raw text (an unclosed one runs to the end of the page, as in HTML), and elements whose inside is never content.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN = frozenset("svg select template noscript".split())
#: An opening tag of these ends an open svg, unless in its foreignObject.
BREAKOUT = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that hold running text: a parent of many such characters is where the article is, whatever its tag.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure li dt dd".split())
#: Elements that are sections of their own.
SECTIONS = frozenset("nav header footer aside form dialog".split())
#: An opening tag closes these open elements, up to a border.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
BORDERS = frozenset("ul ol dl table menu dir".split())
#: Tags and name parts with a weight of their own.
TAGS = tuple("article main section div p h1 h2 h3 h4 ul ol li a b i em strong span table tr td nav header footer aside form button label pre code blockquote figure figcaption details dl dd dt time body html other".split())
CUES = (
    ("ad", "ads", "advert", "advertisement", "adsense", "banner", "promo", "sponsor", "sponsored", "promotion"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "crumbs", "tabs", "pagination", "pager", "toc", "skip"),
    ("header", "masthead", "topbar", "branding", "logo", "sitehead"),
    ("footer", "foot", "bottom", "copyright", "legal", "colophon"),
    ("sidebar", "side", "aside", "widget", "related", "recommended", "recommendations", "popular", "trending", "more", "rail"),
    ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "gdpr", "newsletter", "subscribe", "signup", "overlay", "paywall"),
    ("share", "social", "sharing", "follow", "tools", "toolbar", "login", "search"),
    ("comment", "comments", "respond", "reply", "replies", "disqus", "discussion", "reviews"),
    ("content", "article", "post", "entry", "story", "main", "body", "text", "prose", "page"),
)
_CUE = {w: i for i, group in enumerate(CUES) for w in group}
_TAG = {t: i for i, t in enumerate(TAGS)}
_ARTICLE, _INLINE = frozenset(("article", "main")), frozenset("b i em strong span a code time".split())
ROLES = {"navigation": 1, "banner": 2, "contentinfo": 3, "complementary": 4, "search": 6, "main": 8, "article": 8, "dialog": 5, "alert": 5}
N_FEATURES = len(TAGS) + len(CUES) + 19
#: Training pages (drawn by a rule from a fixed seed) and gradient steps.
PAGES, STEPS = 400, 200

_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN))})\b", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?![^\s/>])", re.I) for tag in RAW}


@dataclass
class Page:
    """Elements in page order and text blocks with the element they belong to."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    keep: list[str | None] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def tag_ends(source: str) -> tuple[list[int], list[int]]:
    """Places of all quotes and ``>``, and for each the place of the ``>`` that ends a tag whose attributes go on
    there, quoted values skipped; -1 where none does. One walk from the end: an unbalanced quote costs nothing more."""
    places = [m.start() for m in _QUOTE_OR_END.finditer(source)]
    ends = [-1] * (len(places) + 1)
    later = {'"': -1, "'": -1}  # index of the next quote of each kind
    for k in range(len(places) - 1, -1, -1):
        c = source[places[k]]
        if c == ">":
            ends[k] = places[k]
        else:
            ends[k] = ends[later[c] + 1] if later[c] >= 0 else -1
            later[c] = k
    return places, ends


def tokens(source: str) -> Iterator[tuple[str, str, str, str, int]]:
    """Text before a tag, "/" if it closes, its name, its attributes, its place. Comments and the like have no
    name; raw text is left out; the last text may have no tag. Time is linear in the page's length."""
    at, look, end = 0, 0, len(source)
    places, ends = tag_ends(source)
    last = source.rfind(">")
    while at < end:
        place = source.find("<", look)
        if place < 0:
            yield source[at:], "", "", "", end
            return
        close, tag, attributes = "", "", ""
        m = _NAME.match(source, place)
        if source.startswith("<!--", place):
            stop = source.find("-->", place + 4)
            stop = end if stop < 0 else stop + 3
        elif m:
            stop = ends[bisect_left(places, m.end())] + 1
            close, tag, attributes = "/" if source[place + 1] == "/" else "", m[1].lower(), source[m.end() : stop - 1]
        else:
            stop = source.find(">", place) + 1 if source[place + 1 : place + 2] in ("!", "?") and place < last else 0
        if not stop:  # no tag: text
            look = place + 1
            continue
        before, at = source[at:place], stop
        if tag in RAW and not close and not attributes.endswith("/"):
            raw = _RAW_END[tag].search(source, at)
            stop = source.find(">", raw.end()) + 1 if raw else 0
            at = stop or end
        look = at
        yield before, close, tag, attributes, place


def closed(source: str) -> set[int]:
    """Places of the opening tags of hidden elements that have a closing tag."""
    if not _HIDDEN.search(source):
        return set()
    waiting: dict[str, list[int]] = {tag: [] for tag in HIDDEN}
    out = set()
    for _, end, tag, attributes, place in tokens(source):
        if tag in HIDDEN:
            if not end and not attributes.endswith("/"):
                waiting[tag].append(place)
            elif end and waiting[tag]:
                out.add(waiting[tag].pop())
    return out


def parse(source: str) -> Page:
    """A tolerant parser: one pass over tags; unknown, unclosed and misnested elements never fail. The text of
    hidden elements is left out; one without a closing tag hides nothing."""
    page = Page()
    stack: list[int] = []
    opened: dict[str, int] = {}
    owners: list[int] = []  # beside the stack: the nearest block element, or the outermost element
    links = hidden = 0
    pending: list[str] = []
    owner = -1

    def flush() -> None:
        nonlocal pending
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            if text:
                page.blocks.append((owner, text))
            pending = []

    def open_(tag: str, attributes: str) -> None:
        node = len(page.tag)
        page.parent.append(stack[-1] if stack else -1)
        page.depth.append(len(stack))
        page.tag.append(tag)
        names, keep = "", None
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                key = m[1].lower()
                if key in ("class", "id", "role", "aria-label", "itemprop", "hidden", "style", "data-label"):
                    value = (m[2] or "").strip("\"'")
                    if key == "data-label":
                        keep = value
                    elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
                        names += " hidden:"
                    elif key == "role":
                        names += " role:" + value.lower()
                    elif key != "style":
                        names += " " + value.lower()
        page.names.append(names)
        page.keep.append(keep)
        page.chars.append(0)
        page.link_chars.append(0)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(node)
        owners.append(node if tag in BLOCK or not owners else owners[-1])

    def close(at: int) -> None:
        nonlocal links, hidden
        while len(stack) > at:
            owners.pop()
            tag = page.tag[stack.pop()]
            opened[tag] -= 1
            if tag == "a":
                links -= 1
            hidden -= tag in HIDDEN

    def text(part: str) -> None:
        nonlocal owner
        if not part or hidden:
            return
        if not pending:
            owner = owners[-1] if owners else -1
        pending.append(part)
        if stack:
            n = len(part) - part.count(" ")
            page.chars[stack[-1]] += n
            if links:
                page.link_chars[stack[-1]] += n

    hides = closed(source)
    for before, end, tag, attributes, place in tokens(source):
        text(before)
        if not tag:
            continue
        if end:
            if not opened.get(tag):
                if tag in BLOCK:
                    flush()
                continue
            i = next(i for i in range(len(stack) - 1, -1, -1) if page.tag[stack[i]] == tag)
            if tag in BLOCK or any(page.tag[n] in BLOCK for n in stack[i:]):
                flush()
            close(i)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in RAW or (tag in HIDDEN and place not in hides):
            continue
        if tag in BREAKOUT and opened.get("svg") and not opened.get("foreignobject"):
            close(next(i for i, n in enumerate(stack) if page.tag[n] == "svg"))
        if tag in BLOCK:
            flush()
            if owners and page.tag[owners[-1]] == "p":  # a block ends an open paragraph
                close(bisect_left(stack, owners[-1]))  # elements are numbered in page order, so the stack rises
        for i in range(len(stack) - 1, -1, -1):
            if tag not in CLOSES or page.tag[stack[i]] in BORDERS or not any(opened.get(t) for t in CLOSES[tag]):
                break
            if page.tag[stack[i]] in CLOSES[tag]:
                close(i)
                if tag not in ("tr", "tbody", "tfoot", "td", "th"):
                    break
        if tag in VOID or (attributes.endswith("/") and (hidden or opened.get("math"))):
            continue
        open_(tag, attributes)
        links += tag == "a"
        hidden += tag in HIDDEN
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """(elements, N_FEATURES): tag, name cues, amounts of text and links in the subtree, and place."""
    n = len(page.tag)
    chars, links = np.array(page.chars, dtype=np.float64), np.array(page.link_chars, dtype=np.float64)
    parent = page.parent
    total, linked, children = chars.copy(), links.copy(), np.zeros(n)
    total, linked, children = total.tolist(), linked.tolist(), children.tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if p >= 0:
            total[p] += total[i]
            linked[p] += linked[i]
            children[p] += 1
    prose, heads = np.zeros(n), np.zeros(n)  # characters outside links in a node's own prose children; an h1 among them
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if p >= 0 and page.tag[i] in PROSE and not page.names[i]:
            prose[p] += max(total[i] - 2 * linked[i], 0)
            heads[p] = heads[p] or page.tag[i] == "h1"
    prose /= max(prose.max(initial=0), 1)
    total, linked, children = np.array(total), np.array(linked), np.array(children)
    x = np.zeros((n, N_FEATURES))
    base = len(TAGS)
    tail = base + len(CUES)
    tags, last = page.tag, len(TAGS) - 1
    x[np.arange(n), [_TAG.get(t, last) for t in tags]] = 1
    for i, names in enumerate(page.names):
        if names:
            for part in _PART.findall(names):
                cue = _CUE.get(part)
                if cue is not None:
                    x[i, base + cue] = 1
            if "role:" in names:
                for role, cue in ROLES.items():
                    if "role:" + role in names:
                        x[i, base + cue] = 1
            x[i, tail + 12] = "hidden:" in names
    density = linked / np.maximum(total, 1)
    x[:, tail] = 1
    x[:, tail + 1] = np.log1p(total) / 5
    x[:, tail + 2] = density
    x[:, tail + 3] = density > 0.6
    x[:, tail + 4] = (total > 0) & (total < 20)
    x[:, tail + 5] = total > 200
    x[:, tail + 6] = total == 0
    x[:, tail + 7] = np.minimum(children, 10) / 10
    x[:, tail + 8] = np.minimum(np.array(page.depth, dtype=np.float64), 20) / 10
    x[:, tail + 9] = np.arange(n) / max(n, 1)
    x[:, tail + 10] = total / max(float(chars.sum()), 1)
    x[:, tail + 11] = [p >= 0 and tags[p] in _ARTICLE for p in parent]
    x[:, tail + 13] = [t in _INLINE for t in tags]
    x[:, tail + 14] = prose
    x[:, tail + 15] = [prose[p] if p >= 0 else 0 for p in parent]
    x[:, tail + 16] = heads
    # in the open: in no section and in nothing named like clutter, but for elements with most of the page's text
    plain, outside = np.maximum(total - linked, 0), [True] * n
    most = plain > plain.max(initial=0) / 2
    clutter = x[:, base : tail - 1].any(1) & ~most
    for i in range(n):
        p = parent[i]
        outside[i] = (p < 0 or outside[p]) and not clutter[i] and tags[i] not in SECTIONS
    x[:, tail + 17] = outside
    x[:, tail + 18] = np.where(outside, np.log1p(plain) / 5, 0)
    return x


def edge_kinds(page: Page) -> np.ndarray:
    """Kinds of edges: the child is an own section, another block, or inline."""
    return np.array([0 if t in SECTIONS or n else 1 if t in BLOCK else 2 for t, n in zip(page.tag, page.names, strict=True)], dtype=np.int64)


@dataclass
class Forest:
    """Several pages as one forest, by depth, so that messages pass a whole level at once."""

    x: np.ndarray
    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]

    @staticmethod
    def of(pages: list[Page]) -> Forest:
        at = np.cumsum([0] + [len(p.tag) for p in pages])
        parent = np.concatenate([np.where(np.array(p.parent, dtype=np.int64) >= 0, np.array(p.parent, dtype=np.int64) + a, -1) for p, a in zip(pages, at, strict=False)] or [np.empty(0, np.int64)])
        depth = np.concatenate([np.array(p.depth, dtype=np.int64) for p in pages] or [np.empty(0, np.int64)])
        by = np.argsort(depth, kind="stable")
        border = np.searchsorted(depth[by], np.arange((depth.max() if len(depth) else -1) + 2))
        levels = [by[a:b] for a, b in zip(border[:-1], border[1:], strict=True)]
        return Forest(np.concatenate([features(p) for p in pages] or [np.empty((0, N_FEATURES))]), parent,
                      np.concatenate([edge_kinds(p) for p in pages] or [np.empty(0, np.int64)]), levels)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def sum_product(forest: Forest, unary: np.ndarray, pairwise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all nodes (n, 2) and, by node, of its edge to the parent (n, 2, 2; zeros for roots).

    ``unary``: (n, 2) log scores; ``pairwise``: (kinds, 2, 2) log potentials [parent, child].
    """
    n = len(unary)
    up = unary.copy()  # own score and all messages from children
    message = np.zeros((n, 2))  # from a node to its parent
    for level in forest.levels[:0:-1]:
        child = level[forest.parent[level] >= 0]
        m = _log_sum(pairwise[forest.kind[child]] + up[child][:, None, :], 2)
        message[child] = m
        np.add.at(up, forest.parent[child], m)
    belief = up.copy()
    edge = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        child = level[forest.parent[level] >= 0]
        p = forest.parent[child]
        rest = belief[p] - message[child]  # the parent's belief without this child's message
        joint = rest[:, :, None] + pairwise[forest.kind[child]] + up[child][:, None, :]
        belief[child] = _log_sum(joint, 1)
        joint -= joint.max((1, 2), keepdims=True)
        e = np.exp(joint)
        edge[child] = e / e.sum((1, 2), keepdims=True)
    belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(1, keepdims=True), edge


@dataclass
class Model:
    weight: np.ndarray  # (N_FEATURES,): score of content over not
    pairwise: np.ndarray  # (kinds, 2, 2)

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """Probability of content of all elements of the pages, in a row."""
        forest = Forest.of(pages)
        if not len(forest.x):
            return np.empty(0)
        unary = np.stack([np.zeros(len(forest.x)), forest.x @ self.weight], 1)
        return sum_product(forest, unary, self.pairwise)[0][:, 1]


def labels_of(page: Page) -> np.ndarray:
    """1 for elements under ``data-label=content`` that are not under a nearer other label."""
    out = np.zeros(len(page.tag), dtype=np.int64)
    for i, (p, k) in enumerate(zip(page.parent, page.keep, strict=True)):
        out[i] = k == "content" if k is not None else (out[p] if p >= 0 else 0)
    return out


def train(pages: list[str], steps: int = STEPS, rate: float = 0.15, decay: float = 1e-3) -> Model:
    """Adam on the conditional log likelihood of labelled pages (elements marked by ``data-label``)."""
    parsed = [parse(p) for p in pages]
    forest = Forest.of(parsed)
    y = np.concatenate([labels_of(p) for p in parsed])
    weight, pairwise = np.zeros(N_FEATURES), np.zeros((3, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    truth = np.zeros((3, 2, 2))
    np.add.at(truth, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    moments = [np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros((3, 2, 2)), np.zeros((3, 2, 2))]
    for step in range(1, steps + 1):
        unary = np.stack([np.zeros(len(y)), forest.x @ weight], 1)
        p, edge = sum_product(forest, unary, pairwise)
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, forest.kind[child], edge[child])
        gradients = ((forest.x.T @ (y - p[:, 1])) / len(pages) - decay * weight, (truth - expected) / len(pages) - decay * pairwise)
        for k, (v, g) in enumerate(zip((weight, pairwise), gradients, strict=True)):
            m, s = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(weight, pairwise)


#: Shapes of training pages: the article in an element of its own; its parts right in the body (or in a nameless
#: wrapper of the whole page); an article with a header and footer of its own; one long paragraph.
SHAPES = ("wrapped", "bare", "own header", "one paragraph")


def labelled_pages(n: int = PAGES, seed: int = 29, shapes: tuple[str, ...] = ("wrapped", *SHAPES)) -> list[str]:
    """Training pages with labelled parts, drawn by a rule: an article of paragraphs, headings, lists, quotes and
    tables of any length, among menus, headers, footers, sidebars, notices, adverts, forms and comments. An article's
    own header (title and byline) is content, its own footer is not. Shapes take turns."""
    draw = random.Random(seed)
    syllables = "ba ce di fo gu la me ni po ru sa te vi xo zu ar en il on us".split()

    def words(low: int, high: int) -> str:
        out = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(low, high))]
        return " ".join(out).capitalize() + draw.choice([".", ".", "", "!", "&amp;", " ***"])

    def paragraph() -> str:
        size = draw.choice([(1, 2), (2, 8), (10, 40), (40, 160)])
        inner = words(*size)
        style = draw.random()
        if style < 0.15:
            inner = f"<b>{inner}</b>"
        elif style < 0.25:
            inner += f" <a href='/x'>{words(1, 3)}</a> <em>{words(1, 3)}</em>"
        elif style < 0.35:
            inner = f"<b>{inner}<br>"
        return f"<p>{inner}" + ("</p>" if draw.random() < 0.85 else "")

    def part() -> str:
        kind = draw.random()
        if kind < 0.75:
            return paragraph()
        if kind < 0.83:
            return f"<h2>{words(2, 6)}</h2>"
        if kind < 0.9:
            tag = draw.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{words(1, 15)}</li>" for _ in range(draw.randint(1, 6))) + f"</{tag}>"
        if kind < 0.94:
            return f"<blockquote>{paragraph()}</blockquote>"
        if kind < 0.97:
            return f"<pre>{words(3, 12)}</pre>"
        return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(draw.randint(1, 4))) + "</table>"

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(draw.randint(low, high))) + "</ul>"

    def other(*names: str, tag: str = "div", body: str | None = None) -> str:
        return f'<{tag} data-label="other" class="{draw.choice(names)}">{body if body is not None else paragraph()}</{tag}>'

    def clutter() -> str:
        return draw.choice([
            lambda: other("ad", "ads", "banner-ad", "sponsored", body=words(3, 30)),
            lambda: other("ad", "promo"),
            lambda: f'<aside data-label="other">{paragraph()}{links(2, 6)}</aside>',
            lambda: other("sidebar", "related", "widget popular", body=f"<h3>{words(1, 3)}</h3>{links(2, 8)}"),
            lambda: other("cookie-notice", "consent", "newsletter", "alert notice", body=f"<p>{words(5, 25)}</p><button>{words(1, 2)}</button>"),
            lambda: f'<form data-label="other"><label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>',
            lambda: other("share", "social", body=links(2, 5)),
            lambda: other("breadcrumb", "pagination", body=" ".join(f'<a href="/">{words(1, 2)}</a>' for _ in range(draw.randint(2, 5)))),
        ])()

    def comments() -> str:
        return f'<{(tag := draw.choice(["section", "div", "aside"]))} data-label="other" id="comments" class="{draw.choice(["comments", "reader-comments", "discussion"])}">' + "".join(
            f'<div class="comment"><b>{words(1, 2)}</b><p>{words(3, 60)}</p></div>' for _ in range(draw.randint(1, 6))) + f"</{tag}>"

    def own(tag: str, body: str, label: str) -> str:
        name = draw.choice(["", "", f' class="entry-{tag}"', f' class="post-{tag}"', f' class="article-{tag}"'])
        return f'<{tag} data-label="{label}"{name}>{body}</{tag}>'

    pages = []
    for i in range(n):
        shape = shapes[i % len(shapes)]
        body = [f"<h1>{words(2, 9)}</h1>"] if draw.random() < (0.5 if shape == "one paragraph" else 0.9) else []
        parts = [part() for _ in range(draw.choice([1, 2, 4, 8, 16]))]
        if shape == "bare":
            parts = [f"<p>{words(20, 120)}</p>" for _ in range(draw.choice([1, 2, 3]))] + parts
        elif shape == "one paragraph":
            parts = [f"<p>{words(30, 300)}</p>"]
        if draw.random() < 0.35:
            parts.insert(draw.randint(0, len(parts)), clutter())
        if shape == "own header" or (shape != "wrapped" and draw.random() < 0.3):
            byline = draw.choice([f"<p>{words(2, 5)}</p>", f"<time>{words(1, 3)}</time>", f"<p>{words(2, 4)} <a href='/x'>{words(1, 2)}</a></p>", ""])
            body = [own("header", f"<h1>{words(2, 9)}</h1>{byline}", "content")]
            if shape == "own header":
                parts.append(own("footer", draw.choice([f"<p>{words(2, 20)}</p>", f"{words(2, 8)}{links(1, 4)}", words(2, 12)]), "other"))
        if draw.random() < 0.15 and shape != "bare":
            parts.append(comments())
        tag, name = draw.choice([("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'), ("section", ' class="entry"')])
        bare = shape == "bare" or (shape == "one paragraph" and draw.random() < 0.5)
        article = "".join(body + parts) if bare else f'<{tag}{name} data-label="content">' + "".join(body + parts) + f"</{tag}>"
        top = [f'<nav data-label="other">{links(2, 9)}</nav>'] if draw.random() < 0.7 else [other("menu", "navbar", body=links(3, 9))]
        if draw.random() < 0.5:
            top.insert(0, f'<header data-label="other"><div class="logo">{words(1, 3)}</div>{paragraph() if draw.random() < 0.4 else ""}</header>')
        top += [clutter() for _ in range(draw.choice([0, 1, 1, 2]))]
        bottom = [clutter() for _ in range(draw.choice([0, 0, 1, 2]))]
        if draw.random() < 0.3:
            bottom.insert(0, comments())
        bottom.append(f'<footer data-label="other">&copy; {words(1, 3)} &middot; {words(2, 20)}</footer>' if draw.random() < 0.8 else other("footer", "copyright"))
        wrap, label = draw.choice([("", ""), ("", ""), ('<div id="wrapper"{}>', "</div>"), ("<div><div{}>", "</div></div>")]), ' data-label="content"' if bare else ""
        pages.append(f"<!DOCTYPE html><html><head><title>x</title></head><body{'' if wrap[0] else label}>" + wrap[0].format(label) + "".join(top) + article + "".join(bottom) + wrap[1]
                     + ("</body></html>" if draw.random() < 0.9 else ""))
    return pages


def texts(sources: list[str | None], model: Model, least: float = 0.5, group: int = 256) -> list[str]:
    """Main texts: blocks whose element is content with probability ``least``, joined by empty lines."""
    out: list[str] = []
    for i in range(0, len(sources), group):
        pages = [parse(s or "") for s in sources[i : i + group]]
        p = model.marginals(pages)
        at = 0
        for page in pages:
            own = p[at : at + len(page.tag)]
            at += len(page.tag)
            out.append("\n\n".join(t for node, t in page.blocks if (own[node] >= least if node >= 0 else True)))
    return out


def extract(pages: DataFrame, model: Model | None = None, source: str = "html", page_id: str = "page_id", url: str = "url", least: float = 0.5) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (the main text, empty if none) and n_chars.

    Null and empty pages give an empty text; a source without any tag is its own text; repeated rows are
    extracted each; null ids and urls stay. A page is parsed whole, whatever its length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))  # a few kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch.column(2).to_pylist(), shared.value, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
