"""Web pages as node tables: a forgiving HTML reader and numeric features of every node."""

from __future__ import annotations

import html
import re

import numpy as np

#: Fixed values of the HTML standard: elements without content, elements with raw text, elements that never show text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript iframe noembed noframes svg math object canvas audio video textarea select option datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements nested deeper have their content taken as that of the last open one.
DEEPEST = 512
#: Start tags that end an open element of the kinds named, unless one of the walls stands between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: What tokens of class, id, role and itemprop hint at.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs pagination pager toc skip links sitemap",
    "head": "header masthead topbar banner branding logo hero toolbar site",
    "foot": "footer foot bottom copyright legal colophon imprint credits",
    "side": "sidebar side aside widget widgets rail related recommended recommendations more trending popular teaser teasers complementary",
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted banner outbrain taboola dfp affiliate",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall warning disclaimer message bar",
    "form": "form search searchbox login signup signin subscribe subscription newsletter contact register poll input",
    "comment": "comment comments reply replies respond discussion disqus thread responses reader",
    "share": "share sharing social tags tag tools buttons follow print rating meta byline author date",
    "content": "article content post entry story main body text page blog news document prose copy headline title maincontent articlebody",
}
_HINT = {}
for _k, (_name, _tokens) in enumerate(HINTS.items()):
    for _t in _tokens.split():
        _HINT[_t] = _HINT.get(_t, 0) | 1 << _k

KINDS = (
    "#text p div span a li ul ol nav header footer aside article main section form h1 h2 h3 h4 table td tr blockquote pre figure figcaption button label input b i em strong body html address dl dt dd br img"
).split()
_KIND = {t: k for k, t in enumerate(KINDS)}
GROUPS = np.array([0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 16, 16, 17, 17, 17, 18, 18, 19, 19, 20, 20, 20, 3, 3, 3, 3, 21, 21, 18, 6, 5, 5, 3, 19, 22])
N_GROUPS = 23


class Page:
    """Nodes in page order as parallel lists. A text node's `text` is its decoded text; breaks says where blocks end."""

    __slots__ = ("kind", "parent", "hints", "text", "tag", "mark", "marks", "in_link")

    def __init__(self):
        self.kind: list[int] = []
        self.parent: list[int] = []
        self.hints: list[int] = []
        self.text: list[str] = []
        self.tag: list[str] = []
        self.in_link: list[bool] = []
        #: Number of the block that a node's text belongs to: it grows with every tag that is not inline.
        self.mark: list[int] = []
        self.marks = 0

    def add(self, tag: str, parent: int, hints: int = 0, text: str = "", in_link: bool = False) -> int:
        self.kind.append(_KIND.get(tag, len(KINDS)))
        self.parent.append(parent)
        self.hints.append(hints)
        self.text.append(text)
        self.tag.append(tag)
        self.mark.append(self.marks)
        self.in_link.append(in_link)
        return len(self.kind) - 1


#: Bit of the hints that says that there is a class, id, role or itemprop at all.
NAMED = 1 << len(HINTS)


def hints_of(attributes: str) -> int:
    out = 0
    for m in _NAMES.finditer(attributes):
        for t in _TOKEN.findall(m[1] or m[2] or m[3] or ""):
            out |= _HINT.get(t.lower(), 0) | NAMED
    return out


def read_page(source: str, labelled: bool = False) -> Page:
    """Any string makes a page: unknown or unclosed tags, stray ends and cut-off markup are taken as they come."""
    page, open_, at, n = Page(), [], 0, len(source)
    root = page.add("html", -1)
    open_.append(("html", root, False))
    unseen = 0  # open elements that never show text

    def say(text: str) -> None:
        if text and not unseen and not text.isspace():
            page.add("#text", open_[-1][1], 0, html.unescape(text), any(o[0] == "a" for o in open_))
        elif text and not unseen and len(page.kind) and page.tag[-1] == "#text" and page.mark[-1] == page.marks:
            page.text[-1] += " "

    def close(upto: int) -> None:
        nonlocal unseen
        while len(open_) > upto:
            unseen -= open_.pop()[2]

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        m = _TAG.match(source, lt)
        if not m:
            nxt = source.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            say(source[at:nxt])
            at = nxt
            continue
        say(source[at:lt])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, ending, attributes = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        inline = name in INLINE
        if not inline:
            page.marks += 1
        elif name == "br" and page.tag[-1] == "#text" and page.mark[-1] == page.marks:
            page.text[-1] += " "
        if ending:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == name:
                    close(k)
                    break
                if inline and open_[k][0] not in INLINE:
                    break
            continue
        if name in ENDS_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == "p":
                    close(k)
                    break
                if open_[k][0] not in INLINE:
                    break
        if name in CLOSES:
            kinds, walls = CLOSES[name]
            cut = None
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] in walls:
                    break
                if open_[k][0] in kinds:
                    cut = k
            if cut:
                close(cut)
        if name in ("html", "body") and any(o[0] == name for o in open_):
            continue
        if name == "body":
            close(1)
        node = page.add(name, open_[-1][1], hints_of(attributes) if attributes else 0)
        if labelled and (k := attributes.find("data-region=")) >= 0:
            page.hints[node] |= 1 << (20 + (attributes[k + 13] == "d"))
        if len(open_) >= DEEPEST or name in VOID or attributes.endswith("/") and name in ("path", "use", "circle", "rect"):
            continue
        hidden = name in UNSEEN
        open_.append((name, node, hidden))
        unseen += hidden
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else n
    return page


N_FEATURES = 2 * N_GROUPS + 3 * len(HINTS) + 20


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row per node of all pages, parents counted over all pages, first node of each page)."""
    sizes = np.array([len(p.kind) for p in pages])
    first = np.cumsum(sizes) - sizes
    kind = np.concatenate([np.array(p.kind) for p in pages])
    parent = np.concatenate([np.array(p.parent) + f * (np.array(p.parent) >= 0) for p, f in zip(pages, first, strict=True)])
    hints = np.concatenate([np.array(p.hints) for p in pages])
    named = (hints & NAMED > 0).astype(float)
    hints &= NAMED - 1
    length = np.array([len(t) for p in pages for t in p.text], float)
    linked = length * np.array([x for p in pages for x in p.in_link], float)
    stops = np.array([t.count(". ") + t.count(", ") + t.endswith((".", "!", "?")) if t else 0 for p in pages for t in p.text], float)
    symbols = np.array(["©" in t for p in pages for t in p.text], float)
    n, is_root = len(kind), parent < 0
    up = np.where(is_root, np.arange(n), parent)
    depth, hop, above = np.zeros(n), np.arange(n), np.zeros(n, np.int64)
    while (alive := ~is_root[hop]).any():
        depth += alive
        hop = up[hop]
        above |= np.where(alive, hints[hop], 0)
    # a parent comes before its children, so subtree sums add up from the last level to the first
    text, link, marks, nodes, syms, links = length.copy(), linked.copy(), stops.copy(), np.ones(n), symbols.copy(), (kind == _KIND["a"]).astype(float)
    for d in range(int(depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(depth == d)
        for total in (text, link, marks, nodes, syms, links):
            total += np.bincount(up[at], total[at], minlength=n)
    page_of = np.repeat(np.arange(len(pages)), sizes)
    whole = text[first][page_of]
    group = GROUPS[kind]
    children = np.bincount(up[~is_root], minlength=n).astype(float)
    order = np.zeros(n)
    seen = np.flatnonzero(~is_root)
    by = seen[np.argsort(up[seen], kind="stable")]
    starts = np.flatnonzero(np.r_[True, up[by][1:] != up[by][:-1]]) if len(by) else np.empty(0, int)
    order[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)])) if len(by) else 0
    same = np.unique(up * (len(KINDS) + 1) + kind, return_inverse=True)[1]
    alike = np.bincount(same)[same]
    X = np.zeros((n, N_FEATURES), np.float32)
    X[np.arange(n), group] = 1
    X[np.arange(n), N_GROUPS + group[up]] = 1
    at = 2 * N_GROUPS
    for bits in (hints, np.where(is_root, 0, hints[up]), above):
        X[:, at : at + len(HINTS)] = bits[:, None] >> np.arange(len(HINTS)) & 1
        at += len(HINTS)
    siblings = np.maximum(children[up], 1)
    density = text / nodes
    X[:, at:] = np.stack([
        np.log1p(text), np.log1p(nodes), density, link / np.maximum(text, 1), marks / np.maximum(text, 1) * 100, links / nodes, syms,
        depth, order, siblings, order / siblings, alike / siblings, text / np.maximum(text[up], 1), text / np.maximum(whole, 1),
        link[up] / np.maximum(text[up], 1), np.log1p(text[up]), density[up], named, named[up], (np.arange(n) - first[page_of]) / np.maximum(sizes[page_of], 1),
    ], 1)
    return X, parent, first
