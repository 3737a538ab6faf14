"""Main text of web pages, by gradient-boosted trees over nodes of the document tree.

Each block element is a node with features of its tag and attribute tokens, of its
ancestors' tokens, its depth, its place among its siblings, and the text, tag, link and
paragraph density of its subtree. Boosted trees, fitted on generated pages whose nodes are
labelled by construction, give each node the probabilities of lying above the main text
(OUT), in it (IN) or in a part to be cut (CUT). The best consistent labelling is found on the
tree: below IN only IN or CUT, below CUT only CUT, so a choice never contradicts an
ancestor's. Scripts, styles and the head hold no text.

Defined cases: a null, empty or text-less page gives an empty text; broken markup is read
as far as it goes (open elements end where their ancestors do); pages of any length and
depth are read whole, without recursion; extra columns stay, and a column of the result's
name is replaced; repeated rows are plain rows; an empty table gives an empty table."""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.common import as_texts, byte_slices, ship

OUT, IN, CUT = range(3)

# What elements are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SILENT = frozenset("script style head title template svg math iframe noscript object audio video canvas".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                  "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
TAGS = ("html", "body", "main", "article", "section", "div", "p", "h1", "h2", "header", "footer", "nav", "aside", "form", "ul", "ol", "li",
        "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "button", "dl", "dd", "dt", "h3", "select")
# Beginnings of class, id and role tokens, by what they hint at.
HINTS = (
    ("content", "article main content post entry story body text prose page".split()),
    ("nav", "nav menu breadcrumb tabs toc pagination pager skip".split()),
    ("header", "header masthead top logo brand".split()),
    ("footer", "footer foot copyright legal bottom colophon contentinfo".split()),
    ("side", "side aside related widget recommend trending popular more complementary".split()),
    ("ad", "ad ads advert advertisement sponsor sponsored promo promoted banner".split()),
    ("notice", "cookie notice consent gdpr popup modal alert newsletter subscribe paywall overlay dialog".split()),
    ("form", "form search login signup contact field".split()),
    ("comment", "comment comments disqus reply replies discussion respond reader".split()),
    ("share", "share social follow tools toolbar".split()),
)
TAG_HINTS = {"article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "dialog": 6, "form": 7, "button": 7, "select": 7,
             "fieldset": 7}
WIDE = {w for _, ws in HINTS for w in ws if len(w) >= 6}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTR = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=50_000)
def hints(attrs: str) -> tuple[int, ...]:
    """Counts of attribute tokens by hint, and whether the element is hidden."""
    out, hidden = [0] * len(HINTS), 0
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("hidden", "aria-hidden", "style"):
            hidden |= name == "hidden" or value == "true" or bool(re.search(r"display\s*:\s*none", value))
            continue
        for token in {t.lower() for t in TOKEN.findall(value)}:
            for k, (_, words) in enumerate(HINTS):
                if token in words or any(w in WIDE and token.startswith(w) for w in words):
                    out[k] += 1
    return (*out, int(hidden))


class Page:
    """Block elements of a page in document order, and its text pieces."""

    def __init__(self, source: str):
        self.tag, self.parent, self.hint, self.silent = ["#root"], [-1], [hints("")], [False]
        self.links = [0]  # characters in links
        self.pieces: list[tuple[int, str]] = []  # node and text; a boundary is a space of node -1
        self.label: list[str] = [""]
        self._read(source)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.hint.append(hints(attrs) if attrs.strip() else self.hint[0])
        self.silent.append(self.silent[parent] or tag in SILENT)
        self.links.append(0)
        self.label.append(attrs[-2:-1] if " data-y=" in attrs else "")
        return len(self.tag) - 1

    def _text(self, stack: list[tuple[str, int]], text: str) -> None:
        node = stack[-1][1]
        if text and not self.silent[node]:
            if "&" in text:
                text = entities.unescape(text)
            self.pieces.append((node, text))
            if self.depth_a:
                self.links[node] += len(text)

    def _read(self, source: str) -> None:
        stack, at, n = [("#root", 0)], 0, len(source)
        self.depth_a = 0
        counts: dict[str, int] = {}

        def pop() -> None:
            name, _ = stack.pop()
            counts[name] -= 1
            if name == "a":
                self.depth_a -= 1
            if name not in INLINE:
                self.pieces.append((-1, " "))

        def pop_to(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
            """Close up to the innermost of ``names`` unless an element of ``stop`` lies above it."""
            if not any(counts.get(x) for x in names):
                return
            k = len(stack) - 1
            while k > 0 and stack[k][0] not in names:
                if stack[k][0] in stop:
                    return
                k -= 1
            if k > 0:
                while len(stack) > k:
                    pop()

        while at < n:
            m = TAG.search(source, at)
            if m is None:
                self._text(stack, source[at:])
                break
            if m.start() > at:
                self._text(stack, source[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name == "br":
                    self.pieces.append((-1, " "))
                else:
                    pop_to((name,), ("table", "td", "th") if name in ("li", "p", *INLINE) else ())
                continue
            attrs = m[3] or m[6] or ""
            if name in BLOCK:
                pop_to(("p",), ("table", "td", "th", "li", "div", "section", "article", "button"))
            if name == "li":
                pop_to(("li",), ("ul", "ol", "menu"))
            elif name in ("dt", "dd"):
                pop_to(("dt", "dd"), ("dl",))
            elif name == "tr":
                pop_to(("tr",), ("table",))
            elif name in ("td", "th"):
                pop_to(("td", "th"), ("tr", "table"))
            elif name in ("option", "optgroup"):
                pop_to(("option",), ("select",))
            elif name == "body":
                pop_to(("head",), ())
            if name in VOID or (attrs.endswith("/") and name not in BLOCK and name not in INLINE):
                if name not in ("wbr", "img"):
                    self.pieces.append((-1, " "))
                continue
            if name in INLINE:
                stack.append((name, stack[-1][1]))
                self.depth_a += name == "a"
            else:
                self.pieces.append((-1, " "))
                stack.append((name, self._open(name, attrs, stack[-1][1])))
            counts[name] = counts.get(name, 0) + 1
            if name in RAW:
                end = re.compile(f"</{name}", re.I).search(source, at)
                stop = end.start() if end else n
                if name in ("title", "textarea"):
                    self._text(stack, source[at:stop])
                at = stop


def node_features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of the pages, and each page's first node."""
    first = np.cumsum([0] + [len(p.tag) for p in pages])
    n = int(first[-1])
    parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first)])
    root = first[:-1]
    parent[root] = root
    page = np.repeat(np.arange(len(pages)), np.diff(first))
    kind = {t: i for i, t in enumerate(TAGS)}
    tag = np.array([kind.get(t, len(TAGS)) for p in pages for t in p.tag])
    hint = np.array([h for p in pages for h in p.hint], float)
    for i, t in enumerate(t for p in pages for t in p.tag):  # an element's name is a hint as well
        if t in TAG_HINTS:
            hint[i, TAG_HINTS[t]] += 1
    own = np.zeros(n)
    stops = np.zeros(n)
    for p, f in zip(pages, first):
        for node, text in p.pieces:
            if node >= 0:
                own[f + node] += len(text)
                stops[f + node] += text.count(".") + text.count(",")
    links = np.array([x for p in pages for x in p.links], float)
    depth, index, kids = np.zeros(n), np.zeros(n), np.zeros(n)
    up, para = np.zeros_like(hint), (tag == kind["p"]).astype(float)
    up_main = np.zeros(n)
    sub = np.stack([own, links, np.ones(n), para, own * para, stops], 1)
    par = parent.tolist()
    semantic = np.isin(tag, [kind["main"], kind["article"]])
    starts = set(root.tolist())
    for i in range(n):
        if i not in starts:
            q = par[i]
            depth[i] = depth[q] + 1
            index[i] = kids[q]
            kids[q] += 1
            up[i] = np.maximum(up[q], hint[q])
            up_main[i] = up_main[q] + semantic[q]
    for i in range(n - 1, -1, -1):
        if i not in starts:
            sub[par[i]] += sub[i]
    whole = sub[root][page]
    over = sub[parent]
    ratio = lambda a, b: a / np.maximum(b, 1.0)
    chars, link, tags, paras, para_chars, marks = sub.T
    inner = np.zeros_like(hint)  # hints of the children
    np.add.at(inner, parent, hint)
    inner[root] -= hint[root]
    same = np.zeros((n, len(TAGS) + 1))
    np.add.at(same, (parent, tag), 1)
    # sibling statistics
    sib = kids[parent]
    numbers = np.stack([
        np.minimum(depth, 30), index, ratio(index, sib), sib, kids, np.log1p(chars), np.log1p(own), ratio(link, chars), ratio(chars, tags),
        ratio(paras, tags), ratio(para_chars, chars), ratio(marks * 100, chars), ratio(chars, whole[:, 0]), ratio(chars, over[:, 0]),
        ratio(same[parent, tag], sib), ratio(link, whole[:, 1]), up_main, sub[:, 3]], 1)
    return np.concatenate([np.eye(len(TAGS) + 1)[tag], np.eye(len(TAGS) + 1)[tag[parent]], hint, up, np.minimum(inner, 5), numbers], 1), first


# ---- boosted trees ---------------------------------------------------------------------------------

ROUNDS, DEPTH, BINS, RATE = 24, 4, 32, 0.3


class Trees:
    """Gradient boosting with the multinomial loss: per round one tree of fixed depth a class,
    on histograms of binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int = 3):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        score, target = np.zeros((len(x), classes)), np.eye(classes)[y]
        self.feature, self.cut, self.value = [], [], []
        for _ in range(ROUNDS):
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for c in range(classes):
                f, t, v = self._tree(b, target[:, c] - p[:, c], p[:, c] * (1 - p[:, c]))
                self.feature.append(f), self.cut.append(t), self.value.append(v)
                score[:, c] += v[self._leaf(b, f, t)]
        self.classes = classes

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T)], 1).astype(np.uint8)

    @staticmethod
    def _leaf(b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return node - (2 ** DEPTH - 1)

    @staticmethod
    def _tree(b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, d = b.shape
        feature, cut = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, 255)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, base = 2 ** level, 2 ** level - 1
            cell = (node[:, None] * d + np.arange(d)) * BINS + b
            g = np.bincount(cell.ravel(), np.repeat(grad, d), width * d * BINS).reshape(width, d, BINS).cumsum(axis=2)
            h = np.bincount(cell.ravel(), np.repeat(hess, d), width * d * BINS).reshape(width, d, BINS).cumsum(axis=2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt ** 2 / (ht + 1)
            best = gain.reshape(width, -1).argmax(axis=1)
            feature[base:base + width], cut[base:base + width] = best // BINS, best % BINS
            node = 2 * node + (b[np.arange(n), feature[base + node]] > cut[base + node])
        value = RATE * np.bincount(node, grad, 2 ** DEPTH) / (np.bincount(node, hess, 2 ** DEPTH) + 1)
        return feature, cut, value

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        b, score = self.binned(x), np.zeros((len(x), self.classes))
        for i, (f, t, v) in enumerate(zip(self.feature, self.cut, self.value)):
            score[:, i % self.classes] += v[self._leaf(b, f, t)]
        score -= score.max(axis=1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def decode(parent: list[int], score: np.ndarray) -> np.ndarray:
    """Labels of highest total score with no contradiction between a node and an ancestor."""
    n = len(parent)
    best = score.copy()  # of the subtree, by the node's label
    for i in range(n - 1, 0, -1):
        o, k, c = best[i]
        up = best[parent[i]]
        up[OUT] += max(o, k, c)
        up[IN] += max(k, c)
        up[CUT] += c
    out = np.empty(n, np.int64)
    out[0] = int(np.argmax(best[0][:2]))
    for i in range(1, n):
        above = out[parent[i]]
        out[i] = above + int(np.argmax(best[i][above:]))
    return out


# ---- generated pages ---------------------------------------------------------------------------------

def training_page(rng: np.random.Generator) -> str:
    """A page of random structure whose elements carry their labels (data-y: O, I or C)."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    letters = np.array(list("abcdefghiklmnoprstuvéäñ"))
    known = ["".join(letters[rng.integers(0, len(letters), n)]) for n in rng.integers(1, 9, 60)]
    known += [w + mark for w in known[:20] for mark in ",."]

    def word() -> str:
        return known[int(rng.integers(60))]

    def words(a: int, b: int) -> str:
        return " ".join([known[i] for i in rng.integers(0, len(known), int(rng.integers(a, b)))]).capitalize() + pick(".", "")

    def el(tag: str, y: str, body: str, *names: str) -> str:
        attr = ""
        if names and names != ("",):
            attr = f' {pick("class", "class", "class", "id", "role")}="{pick(*names)}{pick("", "", " " + word(), "-" + word(), "-1")}"'
        return f'<{tag}{attr} data-y="{y}">{body}</{tag}>'

    def para(y: str, a: int = 4, b: int = 60) -> str:
        body = words(1, 5) if chance(0.2) else words(a, b * (int(250 ** rng.random()) if y == "I" and chance(0.1) else 1))
        if chance(0.1):
            return f'<p data-y="{y}"><b>{body}<br>'  # a heading of sorts, left open
        if chance(0.3):
            body = f"{words(1, 9)} {pick('<b>', '<em>', '<a href=x>', '<span>')}{words(1, 6)}"  # left open: broken markup
            body += pick("", "</b></em></a></span>", "<br>" + words(1, 20))
        return f'<p data-y="{y}">{body}{pick("", "</p>")}'

    def links(y: str, a: int = 2, b: int = 9) -> str:
        item = lambda: el("li", y, f'<a href="/{word()}">{words(1, 4)}</a>')
        return el(pick("ul", "ul", "ol"), y, "".join(item() for _ in range(int(rng.integers(a, b)))))

    def cut_part() -> str:
        kind = int(rng.integers(0, 10))
        some = lambda: "".join(pick(para("C"), links("C"), el("div", "C", words(1, 40)), el("h3", "C", words(1, 5)), words(1, 40))
                               for _ in range(int(rng.integers(1, 4))))
        if kind == 0:
            return pick(el("nav", "C", links("C")), el("div", "C", links("C"), "menu", "nav", "navbar", "breadcrumb", "main-nav", "navigation"),
                        el("nav", "C", links("C"), "menu", "main-menu"))
        if kind == 1:
            return pick(el("div", "C", some(), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner"),
                        el("aside", "C", some(), "ad", "sponsor"), el("div", "C", words(3, 60), "ad", "ad", "ads", "advert"))
        if kind == 2:
            return el(pick("div", "section"), "C", some() + pick("", el("button", "C", words(1, 3))), "cookie-notice", "cookie-banner", "notice",
                      "consent", "newsletter", "popup", "modal", "alert", "gdpr")
        if kind == 3:
            return pick(el("aside", "C", some()), el(pick("aside", "div", "section"), "C", some(), "sidebar", "related", "widget", "side-bar",
                                                     "recommended", "trending", "related-posts"))
        if kind == 4:
            return el("form", "C", pick(words(1, 12), para("C"), el("label", "C", words(1, 3))) + '<input name="q">' + pick("", el("button", "C", words(1, 3))),
                      "", "search", "login", "subscribe", "contact-form")
        if kind in (5, 6):
            one = lambda: el(pick("div", "li", "article"), "C", "".join(para("C", 3, 60) for _ in range(int(rng.integers(1, 3)))), "comment", "reply")
            return el(pick("section", "div", "ol"), "C", pick("", el("h2", "C", words(1, 3))) + "".join(one() for _ in range(int(rng.integers(1, 6)))),
                      "comments", "comment-list", "discussion", "reader-comments", "disqus_thread", "responses-comments")
        if kind == 7:
            return el("div", "C", pick(words(1, 6), links("C")), "share", "social", "share-tools", "pagination", "breadcrumbs")
        if kind == 8:
            return pick(el("footer", "C", some()), el("div", "C", some(), "footer", "site-footer", "copyright", "page-footer"),
                        el("footer", "C", "&copy; " + words(2, 30)))
        return pick(el("header", "C", pick(el("h1", "C", words(1, 4)), words(1, 5), para("C", 3, 20)) + pick("", cut_nav())),
                    el("div", "C", words(1, 12), "header", "masthead", "topbar", "site-header", "logo"))

    def cut_nav() -> str:
        return el("nav", "C", links("C"))

    def block() -> str:
        kind = rng.random()
        if kind < 0.75:
            return para("I")
        return pick(lambda: el("ul", "I", "".join(el("li", "I", words(2, 30)) for _ in range(int(rng.integers(1, 6))))),
                    lambda: el("blockquote", "I", pick(para("I"), words(3, 40))), lambda: el(pick("h2", "h3", "h4"), "I", words(1, 8)),
                    lambda: el("pre", "I", words(3, 30)), lambda: el("div", "I", pick(words(2, 50), para("I"))),
                    lambda: el("table", "I", el("tr", "I", "".join(el("td", "I", words(1, 6)) for _ in range(3)))),
                    lambda: el("figure", "I", "<img src=x>" + el("figcaption", "I", words(2, 15))))()

    body = "".join(block() for _ in range(int(rng.integers(1, 14))))
    if chance(0.15):
        body += pick(words(3, 40), "")
    if chance(0.6):
        body = pick(el("h1", "I", words(1, 9)), el("header", "I", el("h1", "I", words(1, 9)))) + body
    if chance(0.2):  # parts to be cut inside of the article
        body = pick(body + cut_part(), pick(cut_part(), "") + body, body + cut_part() + "".join(block() for _ in range(3)))
    where = rng.random()
    if where < 0.55:
        main = el("article", "I", pick(body, body, el("div", "I", body, "content", "entry", "body", "article-body")), "", "", "post", "article", "story")
    elif where < 0.9:
        main = el(pick("div", "section", "main"), "I", body, "content", "post", "article", "entry-content", "main-content", "story-body", "post-text")
    elif where < 0.95:
        main = el("main", "I", body)
    else:
        main = body
    if chance(0.4) and where < 0.95:
        around = pick(main + cut_part(), cut_part() + main, cut_part() + main + cut_part())
        main = pick(el("main", "O", around), el("div", "O", around, "", "wrapper", "container", "row", "page", "content", "site"))
    parts = [cut_part() for _ in range(int(rng.integers(0, 5)))]
    before = int(rng.integers(0, len(parts) + 1))
    inside = "".join(parts[:before]) + main + "".join(parts[before:])
    if chance(0.2):
        inside = el("div", "O", inside, "", "wrapper", "page", "container", "site")
    y = "I" if where >= 0.95 and "data-y=\"O\"" not in inside else "O"
    end = pick("", "</body></html>")
    return (f'<!DOCTYPE html><html lang="en" data-y="O"><head data-y="C"><title data-y="C">{words(1, 9)}</title><style data-y="C">p{{}}</style>'
            f'<script data-y="C">var t="</p>";</script></head><body data-y="{y}"><!-- x -->{inside}{end}')


TRAINING_PAGES = 800


@lru_cache(maxsize=1)
def model() -> Trees:
    rng = np.random.default_rng(42)
    pages = [Page(training_page(rng)) for _ in range(TRAINING_PAGES)]
    x, _ = node_features(pages)
    y = np.array([{"I": IN, "C": CUT}.get(label, OUT) for p in pages for label in p.label])
    return Trees(x, y)


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    x, first = node_features(pages)
    score = trees.log_probabilities(x)
    out = []
    for p, f in zip(pages, first):
        label = decode(p.parent, score[f:f + len(p.tag)]).tolist()
        out.append(" ".join("".join([t if node < 0 or label[node] == IN else "" for node, t in p.pieces]).split()))
    return out


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """Add ``to``: the main text of each page."""
    trees = model()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, out = pc.binary_length(batch.cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False), []
            for at, n in byte_slices(sizes + 1, 1 << 20):
                out += main_texts(as_texts(batch[at:n]), trees)
            yield pa.array(out, pa.string())

    return pages.withColumn(to, run(F.col(html)))


ship(__name__)
