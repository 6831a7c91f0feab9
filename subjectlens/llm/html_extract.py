"""Main text of web pages: boosted trees over DOM nodes, decoded so that no node contradicts its ancestors."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjectlens.llm.html_dom import INLINE, Page, features, read_page
from subjectlens.llm.shared import need, read, text_of

#: Pages that the trees are trained on: made by a rule here, with labels, from a fixed seed.
TRAINING_PAGES, SEED = 1000, 7
ROUNDS, DEPTH, BINS, RATE, L2, COLUMNS = 40, 4, 32, 0.3, 1.0, 0.4
#: A node's subtree is left out, kept, or holds both.
DROP, KEEP, MIXED = 0, 1, 2


# ---------------------------------------------------------------- training pages


class Maker:
    """Invented pages. Regions carry data-region="k" (main text) or "d" (anything else)."""

    def __init__(self, rng: random.Random, vocabulary: int = 4000):
        self.r = rng
        syllable = lambda: rng.choice("bcdfghklmnprstvz") + rng.choice("aeiouéöà") + rng.choice(["", "n", "r", "st"])
        self.known = ["".join(syllable() for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
        self.known += [w + mark for w in self.known[: vocabulary // 3] for mark in (",", ".", "%%%")[: 1 + (len(w) > 3)]]

    def words(self, low: int, high: int, end: str = ".") -> str:
        out = " ".join(self.r.choices(self.known, k=self.r.randint(low, high)))
        return out[:1].upper() + out[1:] + (end if self.r.random() < 0.8 else "")

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def name(self, *tokens: str) -> str:
        """Attributes of a region: often none."""
        t = self.r.choice(tokens)
        t = self.pick(t, t, f"{t}-{self.pick('box', 'wrap', 'inner', 'area', '1')}", f"site-{t}", f"{t}_block")
        return self.pick("", f' class="{t}"', f' class="{t}"', f' class="{t}"', f' id="{t}"', f' class="x {t}"', f' class="c{self.r.randint(1, 99)}"')

    def links(self) -> str:
        each = [f'<a href="/{k}">{self.words(1, 3, "")}</a>' for k in range(self.r.randint(2, 9))]
        return self.pick("<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>", "<ul>" + "".join(f"<li>{x}" for x in each) + "</ul>", " | ".join(each), "".join(f"<div>{x}</div>" for x in each))

    def region(self, tag: str, attributes: str, body: str, keep: bool = False) -> str:
        tag = "div" if tag == "p" and re.search(r"<(p|div|ul|h\d)\b", body) else tag
        return f'<{tag}{attributes} data-region="{"k" if keep else "d"}">{body}</{tag}>'

    def menu(self) -> str:
        return self.region(self.pick("nav", "nav", "div", "ul"), self.name("nav", "menu", "navbar", "breadcrumb"), self.links())

    def header(self) -> str:
        body = self.pick(f"<h2>{self.words(1, 4, '')}</h2>", f"<div>{self.words(1, 4, '')}</div>", f'<a href="/">{self.words(1, 3, "")}</a>') + self.pick("", f"<p>{self.words(3, 9)}</p>", self.links())
        return self.region(self.pick("header", "header", "div"), self.name("header", "masthead", "banner", "topbar"), body)

    def footer(self) -> str:
        body = self.pick(f"&copy; {self.words(1, 3, '')} &middot; {self.words(3, 9)}", f"<p>&copy; 2024 {self.words(2, 8)}</p>", f"<p>{self.words(4, 12)}</p>" + self.links(), self.links())
        return self.region(self.pick("footer", "footer", "footer", "div"), self.name("footer", "copyright", "bottom"), body)

    def side(self) -> str:
        body = f"<h3>{self.words(1, 4, '')}</h3>" + self.pick(self.links(), f"<p>{self.words(6, 30)}</p>", f"<p>{self.words(6, 20)}</p>" + self.links())
        tag = self.pick("aside", "aside", "div", "section")
        return self.region(tag, self.name("sidebar", "related", "widget", "recommended", "trending") if tag != "aside" else self.pick("", self.name("sidebar", "related")), body)

    def ad(self) -> str:
        body = self.pick(self.words(3, 14), f"<p>{self.words(3, 20)}</p>", f'<a href="http://x">{self.words(2, 8)}</a>', f"<b>{self.words(1, 3)}</b> {self.words(4, 12)}")
        return self.region(self.pick("div", "div", "aside", "section", "p"), f' class="{self.pick("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement")}"', body)

    def notice(self) -> str:
        body = self.pick(self.words(5, 25), f"<p>{self.words(5, 30)}</p>") + self.pick("", f"<button>{self.words(1, 2, '')}</button>", f'<a href="/p">{self.words(1, 3, "")}</a>')
        return self.region(self.pick("div", "section", "p", "div"), f' {self.pick("class", "id")}="{self.pick("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr-banner", "paywall", "notification")}"', body)

    def form(self) -> str:
        body = self.pick("", f"<h3>{self.words(1, 4, '')}</h3>", f"<p>{self.words(3, 14)}</p>") + f"<label>{self.words(1, 3, '')}</label><input name=q>" + self.pick("", f"<select><option>{self.words(1, 2, '')}</select>") + f"<button>{self.words(1, 2, '')}</button>"
        if self.r.random() < 0.75:
            return self.region("form", self.name("search", "newsletter", "login", "subscribe"), body)
        return self.region("div", f' class="{self.pick("newsletter", "subscribe", "search-form", "login")}"', f"<form>{body}</form>")

    def comments(self) -> str:
        one = lambda: self.pick(f"<p>{self.words(4, 40)}</p>", f"<b>{self.words(1, 2, '')}</b><p>{self.words(5, 60)}</p>", f"{self.words(4, 30)}")
        kind = self.pick("comment", "reply", "comment-body")
        body = self.pick("", f"<h3>{self.words(1, 3, '')}</h3>") + "".join(self.pick(f'<div class="{kind}">{one()}</div>', f"<li>{one()}</li>") for _ in range(self.r.randint(1, 6)))
        return self.region(self.pick("div", "section", "ol"), f' {self.pick("class", "id")}="{self.pick("comments", "comment-list", "discussion", "responses", "reader-comments", "disqus")}"', body)

    def share(self) -> str:
        return self.region(self.pick("div", "ul"), f' class="{self.pick("share", "social", "share-buttons", "tags", "post-tags")}"', self.links())

    def paragraph(self) -> str:
        t = self.words(1, 6) if self.r.random() < 0.2 else self.words(5, 110)
        t = t.replace(" ", self.pick(" ", " ", " ", " ", " ", " ", " ", " | ", "*** "))
        t = self.pick(t, t, t, f"<b>{t}<br>", f"{t} <a href='/x'>{self.words(1, 4, '')}</a> {self.words(2, 20)}", f"<em>{t}</em> {self.words(3, 30)}", f"{t}<br>{self.words(2, 20)}")
        return self.pick(f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}</p>", f"<p>{t}", f"<div>{t}</div>")

    def article(self) -> str:
        parts = [self.pick(f"<h1>{self.words(2, 14, '')}</h1>", f"<h1>{self.words(2, 14, '')}</h1>", f"<h2>{self.words(2, 10, '')}</h2>", "")]
        plain, tiny = self.r.random() < 0.3, self.r.random() < 0.25
        if tiny:
            t = self.words(1, 9)
            parts = [f"<h1>{t}</h1>"] + [self.pick(f"<p>{x}</p>", f"<p><b>{x}<br>", f"<p>{x}") for x in [t, *(self.words(2, 16) for _ in range(self.r.randint(0, 2)))]]
        for _ in range(0 if tiny else self.r.choice([1, 1, 2, 3, 4, 6, 9, 14, 30])):
            x = self.r.random() * (0.5 if plain else 1)
            if x < 0.76:
                parts.append(self.paragraph())
            elif x < 0.84:
                tag = self.pick("h2", "h3")
                parts.append(f"<{tag}>{self.words(1, 8, '')}</{tag}>" + self.paragraph())
            elif x < 0.89:
                tag = self.pick("ul", "ol")
                parts.append(f"<{tag}>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>")
            elif x < 0.93:
                parts.append(f"<blockquote><p>{self.words(5, 40)}</p></blockquote>")
            elif x < 0.96:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5, '')}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 4))) + "</table>")
            else:
                parts.append(f"<pre>{self.words(3, 20)}</pre>")
        if self.r.random() < 0.25:
            parts.insert(self.r.randint(1, len(parts)), self.r.choice([self.ad, self.ad, self.side, self.form, self.notice, self.share])())
        if self.r.random() < 0.12:
            parts.append(self.r.choice([self.comments, self.share])())
        body = "".join(parts)
        if self.r.random() < 0.2:
            body = f"<div{self.pick('', self.name('content', 'body', 'text'))}>{body}</div>"
        tag = self.pick("article", "article", "article", "main", "div", "section")
        names = self.name("article", "content", "post", "entry", "story", "main")
        return self.region(tag, names if tag in ("article", "main") else f' class="{self.pick("article", "content", "post", "entry-content", "story", "main-content", "article-body")}"', body, True)

    def page(self) -> str:
        before = [f() for f in (self.menu, self.header, self.notice, self.ad, self.form, self.side) if self.r.random() < 0.45]
        after = [f() for f in (self.comments, self.side, self.form, self.ad, self.notice, self.share) if self.r.random() < 0.3]
        self.r.shuffle(before)
        self.r.shuffle(after)
        if self.r.random() < 0.9:
            after.append(self.footer())
        article = self.article()
        if self.r.random() < 0.25:
            article = f"<div{self.name('main', 'container', 'page')}>{article}{''.join(after[:1])}</div>"
            after = after[1:]
        body = "".join(before) + ("<!-- ad -->" if self.r.random() < 0.5 else "") + article + "".join(after)
        if self.r.random() < 0.25:
            body = f"<div{self.name('wrapper', 'container', 'page')}>{body}</div>"
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head if self.r.random() < 0.8 else ''}<body>{body}</body></html>"


def labels_of(page: Page) -> np.ndarray:
    """State of each node of a training page."""
    n = len(page.kind)
    kept, region = np.zeros((n, 2), bool), [0] * n
    for i in range(n):
        h = page.hints[i] >> 20
        region[i] = (DROP if h & 2 else KEEP) if h else region[page.parent[i]] if i else DROP
    for i in range(n - 1, -1, -1):
        if page.tag[i] == "#text" or not kept[i].any():
            kept[i, region[i]] = True
        if i:
            kept[page.parent[i]] |= kept[i]
    return np.where(kept.all(1), MIXED, np.where(kept[:, KEEP], KEEP, DROP))


# ---------------------------------------------------------------- boosted trees


class Trees:
    """Gradient-boosted trees with a softmax over the node states: histogram splits, level by level, depth DEPTH."""

    def __init__(self, n_classes: int = 3):
        self.n_classes, self.trees = n_classes, []

    def fit(self, X: np.ndarray, y: np.ndarray) -> Trees:
        n, f = X.shape
        self.edges = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        B = np.stack([np.searchsorted(e, X[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        score, onehot, rng = np.zeros((n, self.n_classes)), np.eye(self.n_classes)[y], np.random.default_rng(SEED)
        for _ in range(ROUNDS):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k in range(self.n_classes):
                use = np.sort(rng.choice(f, int(COLUMNS * f), replace=False))
                tree = self._grow(B[:, use], use, p[:, k] - onehot[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6))
                self.trees.append((k, tree))
                score[:, k] += self._run(tree, X)
        return self

    def _grow(self, B: np.ndarray, use: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        n, f = B.shape
        node, width, flat = np.zeros(n, np.int64), f * BINS, B + np.arange(f) * BINS
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for d in range(DEPTH):
            k = 2**d
            at = (node[:, None] * width + flat).ravel()
            G = np.bincount(at, np.repeat(g, f), k * width).reshape(k, f, BINS).cumsum(2)
            H = np.bincount(at, np.repeat(h, f), k * width).reshape(k, f, BINS).cumsum(2)
            G_all, H_all = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + L2) + (G_all - G) ** 2 / (H_all - H + L2) - G_all**2 / (H_all + L2)
            gain[(H < 1) | (H_all - H < 1)] = 0
            best = gain.reshape(k, -1).argmax(1)
            go = np.zeros(n, np.int64)
            for i, b in enumerate(best.tolist()):
                j, bin_ = divmod(b, BINS)
                if gain[i, j, bin_] > 1e-9 and bin_ < len(self.edges[use[j]]):
                    feature[k - 1 + i], cut[k - 1 + i] = use[j], self.edges[use[j]][bin_]
                    mine = node == i
                    go[mine] = B[mine, j] > bin_
            node = node * 2 + go
        G, H = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        return feature, cut.astype(np.float32), -RATE * G / (H + L2)

    @staticmethod
    def _run(tree: tuple, X: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        rows, at = np.arange(len(X)), np.zeros(len(X), np.int64)
        for _ in range(DEPTH):
            at = at * 2 + 1 + (X[rows, feature[at]] > cut[at])
        return leaf[at - (2**DEPTH - 1)]

    def log_probability(self, X: np.ndarray) -> np.ndarray:
        score = np.zeros((len(X), self.n_classes))
        for k, tree in self.trees:
            score[:, k] += self._run(tree, X)
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))


@lru_cache(maxsize=1)
def trained_trees() -> Trees:
    rng = random.Random(SEED)
    maker = Maker(rng)
    pages = [read_page(maker.page(), labelled=True) for _ in range(TRAINING_PAGES)]
    X, _, _ = features(pages)
    return Trees().fit(X, np.concatenate([labels_of(p) for p in pages]))


# ---------------------------------------------------------------- decoding


def decode(log_p: np.ndarray, parent: list[int], tag: list[str]) -> list[bool]:
    """Which nodes are kept, by the most likely consistent labelling.

    Below a dropped node all is dropped, below a kept one all is kept; only a mixed node's children are free. Text and
    inline elements follow the element that they are in, unless it also holds blocks, and are never mixed. The best
    total is found from the leaves up and read off from the root down.
    """
    n = len(parent)
    total = log_p.tolist()
    free, blocks = [0.0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        blocks[parent[i]] |= blocks[i] or not (tag[i] == "#text" or tag[i] in INLINE)
    for i in range(n - 1, 0, -1):
        t, up = total[i], parent[i]
        if not blocks[i]:
            t[MIXED] = -1e9
            if not blocks[up]:
                t[DROP] = t[KEEP] = 0.0
        t[MIXED] += free[i]
        total[up][DROP] += t[DROP]
        total[up][KEEP] += t[KEEP]
        free[up] += max(t)
    total[0][MIXED] += free[0]
    state = [0] * n
    for i in range(n):
        above = state[parent[i]] if i else MIXED
        state[i] = above if above != MIXED else max(range(3), key=total[i].__getitem__)
    return [s == KEEP for s in state]


def main_text(page: Page, keep: list[bool]) -> str:
    """Kept text by block, white space as single spaces, blocks joined by line breaks."""
    blocks, last = [], None
    for i, t in enumerate(page.text):
        if t and keep[i] and page.tag[i] == "#text":
            if page.mark[i] == last:
                blocks[-1] += t
            else:
                blocks.append(t)
            last = page.mark[i]
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(sources: list[str], trees: Trees) -> list[str]:
    pages = [read_page(s) for s in sources]
    if not pages:
        return []
    X, _, first = features(pages)
    log_p = trees.log_probability(X)
    return [main_text(p, decode(log_p[f : f + len(p.kind)], p.parent, p.tag)) for p, f in zip(pages, first.tolist(), strict=True)]


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text (empty if there is none) and n_chars (its code points).

    Null html counts as empty; rows that repeat an id are read one by one; an empty table gives an empty result; further
    columns are ignored. The text of elements nested deeper than html_dom.DEEPEST is read as the text of that depth.
    """
    pages = need(pages, "page_id", "url", "html")
    trees = pages.sparkSession.sparkContext.broadcast(trained_trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                text = extract(part.column(2).to_pylist(), trees.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))
