"""Main text of HTML pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page becomes nodes in document order (comments, scripts and styles aside). Features of a node: subtree text, tags and
their density, link density, depth, place among siblings and the siblings' density, tag group, tokens of class and id
attributes. The trees give each node log-odds of being content; the decoder then picks, from the root, for each node
'keep all', 'drop all' or 'decide below' with the greatest sum over the tree, so that nothing within a kept or dropped
node is decided otherwise.

Training pages (a bounded sample) label themselves: nodes in <article> or <main> are content, the rest isn't; these tags
are not among the features, so pages without them are judged by their structure.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import small_batches

#: Pages for training; the bound of the sample.
MAX_TRAIN = 400
PENALTY = 1.0
TOKENS = 16
OPEN = re.compile(r"<(?:(!--)|!\w|(/?)([a-zA-Z][a-zA-Z0-9-]*))")
#: What follows a tag's name, with quoted values; possessive, so a tag that never closes is read once.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN = re.compile(r"([^<>]*+)>")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
GROUPS = {t: i for i, g in enumerate((["p"], ["a"], ["li", "dt", "dd"], ["ul", "ol", "dl"], ["div", "section"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["b", "i", "em", "strong", "span", "u"], ["table", "tr", "td", "th", "tbody"], ["blockquote", "pre", "code"], ["form", "button", "select", "label"])) for t in g}
INLINE = frozenset(["a", "b", "i", "em", "strong", "span", "u", "code", "small", "sub", "sup", "label", "abbr", "cite", "q"])
CLOSES = {"p": frozenset(["p", "div", "ul", "ol", "table", "section", "article", "main", "nav", "footer", "header", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "hr"]), "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
CLOSED_BY = frozenset().union(*CLOSES.values())
LABELS = frozenset(["article", "main"])
N_FEATURES = 18 + 11 + TOKENS


def parts(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Begin, end, whether it closes, name and attributes of tags; comments, declarations, scripts and styles have no name.

    Each mark that ends a comment, script or quoted value is looked for until it isn't found once, and a tag that doesn't end makes
    the rest of the page be read without quoted values, so the time is linear in the page, however it is broken."""
    at, rest, open_ended = 0, REST, set()
    while m := OPEN.search(html, at):
        begin, at = m.span()
        name = (m[3] or "").lower()
        if not name:
            mark = "-->" if m[1] else ">"
            end = -1 if mark in open_ended else html.find(mark, at)
            if end < 0:
                open_ended.add(mark)
                continue
            at = end + len(mark)
            yield begin, at, False, "", ""
            continue
        tail = rest.match(html, at)
        if tail is None and rest is REST:
            rest = PLAIN
            tail = rest.match(html, at)
        if tail is None:
            continue
        at = tail.end()
        if name in RAW and not m[2] and name not in open_ended:
            if end := RAW[name].search(html, at):
                at = end.end()
                yield begin, at, False, "", ""
                continue
            open_ended.add(name)
        yield begin, at, bool(m[2]), name, tail[1]
    return


class Page:
    """Nodes in document order: parent, depth, end of subtree, tag, token buckets; and text segments (node, text)."""

    __slots__ = ("depth", "end", "parent", "segments", "tag", "tokens")

    def __init__(self, html: str) -> None:
        parent, depth, end, tag, tokens, segments, stack = [-1], [0], [0], ["#root"], [0], [], [0]
        at = 0

        def text(a: int, z: int) -> None:
            if a < z and (t := html[a:z].strip()):
                lead, tail = html[a].isspace(), html[z - 1].isspace()
                segments.append((stack[-1], " " * lead + t + " " * tail))

        opened: Counter = Counter()  # names on the stack
        wall = [0]  # of each place on the stack, the nearest at or below it that isn't inline

        def close(k: int) -> None:
            for i in stack[k:]:
                end[i] = len(parent)
                opened[tag[i]] -= 1
            del stack[k:], wall[k:]

        for begin, stop, closing, name, attributes in parts(html):
            text(at, begin)
            at = stop
            if not name:
                continue
            if closing:
                if name in VOID or not opened[name]:
                    continue
                k = len(stack) - 1
                while tag[stack[k]] != name:
                    k -= 1
                close(k)
                continue
            # an open paragraph or item ends where one can't go on; inline elements that were left open end with it
            k = wall[-1] if name in CLOSED_BY else 0
            while k > 0:
                t = tag[stack[k]]
                if name in CLOSES.get(t, ()):
                    close(k)
                    break
                if t not in CLOSES:
                    break
                k = wall[k - 1]
            bucket = 0
            if attributes:
                for a, b, c in ATTR.findall(attributes):
                    for w in re.findall(r"[a-z]+", (a or b or c).lower()):
                        bucket |= 1 << (sum(w.encode()) * 31 + len(w)) % TOKENS
            parent.append(stack[-1])
            depth.append(len(stack))
            end.append(0)
            tag.append(name)
            tokens.append(bucket)
            if name in VOID or attributes.endswith("/"):
                end[-1] = len(parent)
                if name in ("br", "hr"):
                    segments.append((stack[-1], "\n"))
            else:
                wall.append(wall[-1] if name in INLINE else len(stack))
                stack.append(len(parent) - 1)
                opened[name] += 1
        text(at, len(html))
        for i in stack:
            end[i] = len(parent)
        self.parent, self.depth, self.end = np.array(parent), np.array(depth), np.array(end)
        self.tag, self.tokens, self.segments = tag, np.array(tokens), segments

    def labels(self) -> np.ndarray | None:
        """1 for nodes in <article> or <main>; None where the page has neither."""
        out = np.zeros(len(self.tag))
        for i, t in enumerate(self.tag):
            if t in LABELS:
                out[i : self.end[i]] = 1
        return out if out.any() else None

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of features, and which nodes have text."""
        n = len(self.tag)
        own, words, points, link = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        a = np.zeros(n + 1)
        group = np.array([GROUPS.get(t, 10) for t in self.tag])
        for i in np.flatnonzero(group == 1):
            a[i] += 1
            a[self.end[i]] -= 1
        in_link = np.cumsum(a)[:n] > 0
        for i, t in self.segments:
            own[i] += len(t)
            words[i] += t.count(" ") + 1
            points[i] += t.count(".") + t.count(",")
        link[in_link] = own[in_link]
        idx = np.arange(n)
        sub = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[self.end] - c[idx]
        chars, tags, links, w, pts = sub(own), self.end - idx, sub(link), sub(words), sub(points)
        par = np.maximum(self.parent, 0)
        kids = np.bincount(par[1:], minlength=n)
        order = np.zeros(n)
        if n > 1:
            by = np.argsort(par[1:], kind="stable") + 1
            p = par[by]
            first = np.concatenate([[True], p[1:] != p[:-1]])
            order[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        density, linkness = chars / tags, links / np.maximum(chars, 1)
        rest_chars, rest_tags, rest_links = chars[par] - chars, np.maximum(tags[par] - tags, 1), links[par] - links
        same = np.zeros(n)
        key = par * 16 + group
        u, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
        same[:] = cnt[inv] / np.maximum(kids[par], 1)
        total = max(1.0, chars[0])
        x = np.empty((n, N_FEATURES), np.float32)
        cols = (np.log1p(chars), np.log1p(own), tags, density, linkness, self.depth, order, kids[par], kids, same, rest_chars / rest_tags, rest_links / np.maximum(rest_chars, 1), chars / total, pts / np.maximum(w, 1), w / np.maximum(tags, 1), density[par], linkness[par], idx / n)
        for k, c in enumerate(cols):
            x[:, k] = c
        x[:, 18:29] = group[:, None] == np.arange(11)
        x[:, 29:] = (self.tokens[:, None] >> np.arange(TOKENS)) & 1
        return x, chars > 0


class Trees:
    """Boosted regression trees of one depth for the logistic loss, on quantile bins."""

    def __init__(self, n_trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32) -> None:
        self.n_trees, self.depth, self.rate, self.bins = n_trees, depth, rate, bins
        self.feature, self.cut, self.leaf, self.base = [], [], [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(x), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, feature, cut = np.zeros(len(x), np.int64), np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                base, width = 2**level - 1, 2**level
                best, gain = [(0, np.inf)] * width, np.zeros(width)
                for k in range(x.shape[1]):
                    if not len(cuts[k]):
                        continue
                    key = node * self.bins + b[:, k]
                    gs, hs = (np.cumsum(np.bincount(key, v, width * self.bins).reshape(width, -1), 1) for v in (g, h))
                    score = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    score = score[:, : len(cuts[k])]
                    top = score.argmax(1)
                    for j in range(width):
                        if score[j, top[j]] > gain[j] + 1e-9:
                            gain[j], best[j] = score[j, top[j]], (k, float(cuts[k][top[j]]))
                for j, (k, c) in enumerate(best):
                    feature[base + j], cut[base + j] = k, c
                node = node * 2 + (x[np.arange(len(x)), feature[base + node]] > cut[base + node])
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = self.rate * gs / (hs + 1)
            f += leaf[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            f += leaf[node]
        return f


def decode(parent: np.ndarray, depth: np.ndarray, logit: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Whether each node is kept: the consistent choice with the greatest sum. A node counts logit if it is kept and
    -logit if it is dropped, within a kept or dropped subtree as at its top; a node that leaves the choice to its
    children costs `penalty` and is itself dropped from the sum. parent is -1 at roots; parents come before children."""
    n = len(parent)
    keep, drop, mixed = logit.astype(np.float64).copy(), -logit.astype(np.float64), np.full(n, -penalty)
    kids = np.bincount(parent[parent >= 0], minlength=n) > 0
    mixed[~kids] = -np.inf
    by = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[by], np.arange(depth.max(initial=0) + 2))
    best = np.zeros(n)
    for d in range(depth.max(initial=0), -1, -1):
        i = by[bounds[d] : bounds[d + 1]]
        best[i] = np.maximum(np.maximum(keep[i], drop[i]), mixed[i])
        up = i[parent[i] >= 0]
        for a, v in ((keep, keep), (drop, drop), (mixed, best)):
            np.add.at(a, parent[up], v[up])
    state = np.zeros(n, np.int8)  # 1 kept, 2 dropped, 0 decided below
    for d in range(depth.max(initial=0) + 1):
        i = by[bounds[d] : bounds[d + 1]]
        own = np.where(mixed[i] > np.maximum(keep[i], drop[i]), 0, np.where(keep[i] > drop[i], 1, 2))
        above = np.where(parent[i] >= 0, state[np.maximum(parent[i], 0)], 0)
        state[i] = np.where(above > 0, above, own)
    return state == 1


def page_text(page: Page, kept: np.ndarray) -> str:
    """Text of kept nodes; blocks are on lines of their own."""
    out, last, blocks = [], None, list(range(len(page.tag)))
    for i, t in enumerate(page.tag):
        if t in INLINE:
            blocks[i] = blocks[page.parent[i]]
    for i, t in page.segments:
        if not kept[i]:
            continue
        block = blocks[i]
        if last is not None and block != last:
            out.append("\n")
        out.append(t)
        last = block
    text = unescape("".join(out)).replace("\xa0", " ")
    return "\n".join(x for line in text.split("\n") if (x := " ".join(line.split())))


def train(pages: list[str]) -> Trees | None:
    """Trees from pages that have <article> or <main>; None where there is none."""
    xs, ys = [], []
    for html in pages:
        page = Page(html)
        y = page.labels()
        if y is not None:
            x, full = page.features()
            xs.append(x[full])
            ys.append(y[full])
    return Trees().fit(np.concatenate(xs), np.concatenate(ys)) if xs else None


def model_for(pages: DataFrame, limit: int = MAX_TRAIN) -> Trees | None:
    """Trees trained on at most `limit` pages, chosen by a hash of their ids; of rows that repeat an id, the least html."""
    ids = [r[0] for r in pages.filter("page_id is not null and html is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id", F.lit(5)), "page_id").limit(limit).collect()]
    rows = pages.filter(F.col("page_id").isin(ids) & F.col("html").isNotNull()).groupBy("page_id").agg(F.min("html").alias("html")).collect() if ids else []  # a row per id
    return train([r["html"] for r in sorted(rows, key=lambda r: r["page_id"])])


def extract(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """Rows (page_id, text, n_nodes, n_kept) for every page.

    A null html gives a null text and no nodes; an empty one an empty text. Broken markup is read as browsers would in the
    common cases (open paragraphs and items end, stray end tags are dropped, text after the last tag counts); a tag that a page breaks off in is text. Pages are read whole, in time linear in their length. Repeated
    rows are each extracted; a null page_id is kept; further columns are ignored; an empty table stays empty. If no page
    of the sample has labels, all text of a page is kept; a node whose sums tie is dropped, and decided as a whole rather than below."""
    m = model or model_for(pages)
    shared = pages.sparkSession.sparkContext.broadcast(vars(m) if m else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees() if shared.value else None
        if trees:
            vars(trees).update(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = [None if h is None else Page(h) for h in part.column(1).to_pylist()]
                docs = [p for p in found if p]
                sizes = [len(p.tag) for p in docs]
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
                if docs:
                    feats = [p.features() for p in docs]
                    logit = np.zeros(at[-1])
                    full = np.concatenate([f for _, f in feats])
                    if full.any():
                        logit[full] = trees.logit(np.concatenate([x for x, _ in feats])[full]) if trees else 1.0
                    parent = np.concatenate([np.where(p.parent >= 0, p.parent + s, -1) for p, s in zip(docs, at[:-1], strict=True)])
                    kept = decode(parent, np.concatenate([p.depth for p in docs]), logit)
                ks = iter([kept[a:z] for a, z in zip(at[:-1], at[1:], strict=True)] if docs else [])
                rows = [(None, 0, 0) if p is None else (page_text(p, q := next(ks)), len(q), int(q.sum())) for p in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["page_id", "text", "n_nodes", "n_kept"])

    small_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, text string, n_nodes bigint, n_kept bigint")
