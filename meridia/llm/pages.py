"""HTML extraction by wrapper induction: pages of a host are aligned; what stays the same is template."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "pre", "blockquote", "section", "article", "main", "figure", "figcaption", "body", "html", "header", "footer", "nav", "aside", "form", "hr", "thead", "tbody"}
SKIP = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg"}
NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "sidebar", "menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "header", "footer", "cookie", "cookies", "consent", "notice", "popup", "modal", "comment", "comments", "share", "social", "related", "newsletter", "subscribe", "promo", "sponsored"}
LAYOUT = {"sidebar", "menu", "nav", "navbar", "header", "footer", "banner"}  # such words also stand on wrappers of a whole page
SHORT = 4096  # cells of an alignment table up to which lists are faster than numpy
DEPTH = 150  # deeper nodes are not aligned
PAGES = 8  # pages of a host that its wrapper is made from, at most
SHARE = 0.75  # of these pages must agree on a text


class Node:
    __slots__ = ("tag", "label", "hints", "hidden", "kids", "sig", "size", "holds")

    def __init__(self, tag: str, label: str, hints: frozenset, hidden: bool) -> None:
        self.tag, self.label, self.hints, self.hidden, self.kids = tag, label, hints, hidden, []
        self.sig, self.size, self.holds = 0, 0, False

    def noise(self, total: int, inside: bool) -> bool:
        """Whether tag or class words mark noise. Layout words do not where the node holds an article, or nearly all text of a page without one."""
        if self.hidden:
            return True
        hints = self.hints | {"header"} if self.tag == "header" else self.hints
        if inside:
            return bool(hints - {"header"})
        if self.tag in ("html", "body"):
            return False
        return bool(hints - LAYOUT) or bool(hints) and not self.holds and 5 * self.size <= 4 * total


class Tree(HTMLParser):
    """A forgiving DOM: a block start ends an open paragraph, an unknown end tag is ignored."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "#root", frozenset(), False)
        self.open, self.at, self.all = [self.root], {}, [self.root]
        self.feed(html)
        self.close()
        for n in reversed(self.all):  # children before parents
            digest = xxhash.xxh64()
            for k in n.kids:
                if isinstance(k, Node):
                    n.size += k.size
                    n.holds = n.holds or k.holds or k.tag in ("article", "main") and not k.hints
                    if k.sig:
                        digest.update(k.sig.to_bytes(8, "little"))
                elif k := " ".join(k.split()):
                    n.size += len(k)
                    digest.update(k.encode("utf-8", "replace"))
            n.sig = digest.intdigest() if n.size else 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and self.at.get("p"):
            self.handle_endtag("p")
        if tag == "li" and self.open[-1].tag == "li":
            self.handle_endtag("li")
        marks = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        hints = NOISE.intersection(marks.replace("_", "-").replace("-", " ").split()) if marks else ()
        node = Node(tag, f"{tag} {marks}" if marks else tag, frozenset(hints), tag in SKIP or any(k == "hidden" for k, _ in attrs))
        self.open[-1].kids.append(node)
        self.all.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.at[tag] = self.at.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.at.get(tag):
            while True:
                n = self.open.pop()
                self.at[n.tag] -= 1
                if n.tag == tag:
                    return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


class Slot:
    """A node of a wrapper: the texts that pages have there."""

    __slots__ = ("label", "texts", "kids")

    def __init__(self, label: str, texts: Counter, kids: list) -> None:
        self.label, self.texts, self.kids = label, texts, kids

    @staticmethod
    def of(n: Node, depth: int = DEPTH) -> Slot:
        return Slot(n.label, Counter([n.sig]), [Slot.of(k, depth - 1) for k in n.kids if isinstance(k, Node) and k.size] if depth else [])

    def packed(self, pages: int) -> list | None:
        """[label, constant text or 0, number of pages, children]; slots without constant text below go."""
        kids = [k for s in self.kids if (k := s.packed(pages))]
        (sig, n), seen = self.texts.most_common(1)[0], sum(self.texts.values())
        const = n >= 2 and n >= SHARE * max(seen, min(pages, 2))
        return [self.label, sig if const else 0, n, kids] if const or kids else None


def _short(p: list[tuple[str, Collection[int]]], q: list[tuple[str, int]]) -> list[tuple[int, int]]:
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    gain = [[(3 if t in own else 2) if a == b else 0 for b, t in q] for a, own in p]
    for r in range(len(p) - 1, -1, -1):
        row, under, g = best[r], best[r + 1], gain[r]
        for s in range(len(q) - 1, -1, -1):
            row[s] = max(under[s], row[s + 1], under[s + 1] + g[s] if g[s] else 0)
    r = s = 0
    pairs = []
    while r < len(p) and s < len(q):
        if gain[r][s] and best[r][s] == best[r + 1][s + 1] + gain[r][s]:
            pairs.append((r, s))
            r, s = r + 1, s + 1
        elif best[r][s] == best[r + 1][s]:
            r += 1
        else:
            s += 1
    return pairs


def aligned(x: list[tuple[str, Collection[int]]], y: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists of label and text (x: texts): index pairs of equal label, in order, those with equal text before others.

    Lists of any length are aligned by the same table, which only its making tells apart: short ones get it as lists,
    others a row at a time by numpy, with every few rows kept and those between made again on the way back, so that
    memory grows with the power 1.5 of the lists' length.
    """
    i = 0
    while i < min(len(x), len(y)) and x[i][0] == y[i][0] and y[i][1] in x[i][1]:
        i += 1
    pairs, p, q = [(k, k) for k in range(i)], x[i:], y[i:]
    if len(p) * len(q) <= SHORT:
        return pairs + [(i + r, i + s) for r, s in _short(p, q)]
    codes: dict[str, int] = {}
    labels = np.array([codes.setdefault(s, len(codes)) for s, _ in q], np.int64)
    texts, n, step = np.array([t for _, t in q], np.uint64), len(q), math.isqrt(len(p)) + 1

    def gains(r: int) -> np.ndarray:
        label, own = p[r]
        gain = np.where(labels == codes.get(label, -1), 2, 0)
        same = np.zeros(n, bool)
        for t in own:
            same |= texts == np.uint64(t)
        return gain + (same & (gain > 0))

    def row(under: np.ndarray, gain: np.ndarray) -> np.ndarray:
        out = np.zeros(n + 1, np.int64)
        out[:n] = np.maximum.accumulate(np.maximum(under[:n], np.where(gain > 0, under[1:] + gain, 0))[::-1])[::-1]
        return out

    kept, best = {len(p): np.zeros(n + 1, np.int64)}, np.zeros(n + 1, np.int64)
    for r in range(len(p) - 1, -1, -1):
        best = row(best, gains(r))
        if r % step == 0:
            kept[r] = best
    s = 0
    for lo in range(0, len(p), step):
        hi = min(lo + step, len(p))
        gain, rows = [gains(r) for r in range(lo, hi)], [kept[hi]]
        for g in reversed(gain):
            rows.append(row(rows[-1], g))
        rows.reverse()
        r = lo
        while r < hi and s < n:
            here, under, g = rows[r - lo], rows[r - lo + 1], gain[r - lo][s]
            if g and here[s] == under[s + 1] + g:
                pairs.append((i + r, i + s))
                r, s = r + 1, s + 1
            elif here[s] == under[s]:
                r += 1
            else:
                s += 1
    return pairs


def merge(slot: Slot, node: Node) -> None:
    """Adds a page to a wrapper."""
    todo = [(slot, node, DEPTH)]
    while todo:
        a, n, depth = todo.pop()
        kids = [k for k in n.kids if isinstance(k, Node) and k.size]
        pairs = aligned([(s.label, s.texts) for s in a.kids], [(k.label, k.sig) for k in kids])
        by, out, done = {j: i for i, j in pairs}, [], 0
        for j, k in enumerate(kids):
            if j in by:
                out += a.kids[done : by[j] + 1]
                done = by[j] + 1
                s = a.kids[by[j]]
                s.texts[k.sig] += 1
                if depth:
                    todo.append((s, k, depth - 1))
            else:
                out.append(Slot.of(k, max(0, depth - 1)))
        a.kids = out + a.kids[done:]


def leaves(root: Node) -> set[int]:
    """Texts of the nodes that hold text and no further node with text."""
    out, todo = set(), [root]
    while todo:
        n = todo.pop()
        kids = [k for k in n.kids if isinstance(k, Node) and k.size]
        todo += kids
        if n.size and not kids:
            out.add(n.sig)
    return out


def unlike(trees: list[Node]) -> list[Node]:
    """Trees without near copies of one before: apart from texts that all have, two kept ones share half at most."""
    texts = [leaves(t) for t in trees]
    common = set.intersection(*texts) if texts else set()
    kept: list[tuple[Node, set[int]]] = []
    for t, own in zip(trees, texts):
        own = own - common
        if own and all(2 * len(own & o) <= min(len(own), len(o)) for _, o in kept):
            kept.append((t, own))
    return [t for t, _ in kept]


def induce(pages: list[str]) -> str | None:
    """The wrapper of some pages of a host, as JSON; none without two unlike pages."""
    trees = unlike([Tree(p).root for p in pages])
    if len(trees) < 2:
        return None
    root = Slot.of(trees[0])
    for t in trees[1:]:
        merge(root, t)
    return json.dumps([len(trees), root.packed(len(trees)) or ["#root", 0, 0, []]])


def constant(page: Node, wrapper: list, least: int, found: dict[int, int]) -> None:
    """Marks the nodes of page that the wrapper holds with the same text, by the number of pages that agree."""
    todo = [(page, wrapper)]
    while todo:
        a, w = todo.pop()
        kids = [k for k in a.kids if isinstance(k, Node) and k.size]
        for i, j in aligned([(k.label, (k.sig,)) for k in kids], [(s[0], s[1]) for s in w[3]]):
            if kids[i].sig == w[3][j][1] and w[3][j][2] >= least:
                found[id(kids[i])] = w[3][j][2]
            else:
                todo.append((kids[i], w[3][j]))


def content(root: Node) -> list[Node]:
    """Where the content is hinted to be: the outermost articles, else main elements, else the whole page."""
    for tag in ("article", "main"):
        out, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.tag == tag and not n.hints - {"header"} and not n.hidden:
                out.append(n)
            elif not n.noise(root.size, False):
                todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))
        if any(n.size for n in out):
            return out
    return [root]


def main_text(html: str, wrapper: list | None) -> str:
    """The blocks of the content slots."""
    root = Tree(html).root
    tops = content(root)
    inside = tops[0] is not root
    template: dict[int, int] = {}
    if wrapper:
        constant(root, wrapper[1], max(3, round(SHARE * wrapper[0])) if inside else 2, template)
    blocks: list[list[str]] = [[]]
    todo: list = list(reversed(tops))
    while todo:
        n = todo.pop()
        if n is None:
            blocks.append([])
        elif isinstance(n, str):
            blocks[-1].append(n)
        elif n.tag == "br":
            blocks[-1].append(" ")
        elif id(n) not in template and not n.noise(root.size, inside):
            edge = n.tag in BLOCK
            if edge:
                blocks.append([])
                todo.append(None)
            todo.extend(reversed(n.kids))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return F.when(host != "", host)


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper, from up to PAGES different pages of each host.

    The pages are picked by hash, one per residue class, in one partial aggregate; only these are gathered, and
    near copies among them count once.
    """
    p = pages.filter("host is not null and html is not null").select("host", "html", F.xxhash64("html").alias("h"))
    picks = p.groupBy("host").agg(F.array(*[F.min(F.when(F.pmod("h", F.lit(PAGES)) == i, F.col("h"))) for i in range(PAGES)]).alias("m"))
    picks = staged(picks.select("host", F.explode("m").alias("h")).filter("h is not null"))
    chosen = p.join(picks, ["host", "h"]).groupBy("host", "h").agg(F.min("html").alias("html"))
    made = chosen.groupBy("host").applyInPandas(lambda g: pd.DataFrame({"host": g["host"][:1], "wrapper": [induce(g.sort_values("h")["html"].tolist())]}), "host string, wrapper string")
    return staged(made.filter("wrapper is not null"))


def page_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    For each host some pages are aligned by simple tree matching into a wrapper: a node whose text most of them
    share is template, the others are slots. Every page is aligned with its host's wrapper; its content is what
    is not template, within its article (or main element) if it has one, without what tags or class words mark
    as noise. Inside an article three pages at least must agree on a template node. A host with fewer than two
    unlike pages has no wrapper. Null html is empty and gives an empty text; a null url has no host; repeated
    rows give repeated results; an empty table gives none; other columns are not read. The join with wrappers is
    a left join that Spark may split where a host is hot.
    """
    p = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    found = wrappers(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list] = {}
        for b in batches:
            text = []
            for h, w in zip(b["html"], b["wrapper"]):
                if isinstance(w, str) and w not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[w] = json.loads(w)
                text.append(main_text(h, seen.get(w) if isinstance(w, str) else None) if isinstance(h, str) else "")
            yield pd.DataFrame({"page_id": b["page_id"].array, "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return p.join(found, "host", "left").select("page_id", "url", "html", "wrapper").mapInPandas(run, "page_id long, url string, text string, n_chars long")
