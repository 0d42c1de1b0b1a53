from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
import pytest
from checks import DATA

from corpusloom.llm import dom, urlrules


def consistent(parent, logit, penalty):
    """Best total over all consistent choices, tried out: each node kept, dropped or mixed."""
    n, best = len(parent), -np.inf
    kids = [[j for j in range(n) if parent[j] == i] for i in range(n)]
    for s in itertools.product((0, 1, 2), repeat=n):
        ok = all(not (s[i] == 0 and not kids[i]) for i in range(n)) and all(parent[i] < 0 or s[parent[i]] == 0 or s[i] == s[parent[i]] for i in range(n))
        if ok:
            best = max(best, sum(logit[i] if s[i] == 1 else -logit[i] if s[i] == 2 else -penalty for i in range(n)))
    return best


def test_decoder_finds_the_best_consistent_choice():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 7)
        parent = np.array([-1] + [r.randint(0, i - 1) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        logit = np.array([r.uniform(-3, 3) for _ in range(n)])
        kept = dom.decode(parent, depth, logit, 0.7)
        # kept subtrees are whole; every other top of a subtree is dropped or mixed: the best total with these is the best of all
        assert all(kept[i] or not kept[parent[i]] for i in range(1, n))
        state = kept.astype(int)
        mixed = np.zeros(n, bool)
        for i in range(n - 1, -1, -1):
            mixed[i] = not kept[i] and any(kept[j] or mixed[j] for j in range(n) if parent[j] == i)
        total = sum(logit[i] if state[i] else -0.7 if mixed[i] else -logit[i] for i in range(n))
        best = consistent(parent, logit, 0.7)
        # a mixed node whose children are all dropped isn't told from a dropped one by the result; it never pays
        assert total <= best + 1e-9 and (abs(total - best) < 1e-9 or not kept.any() or mixed.any())


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = dom.Trees().fit(x[:3000], y[:3000])
    assert ((m.logit(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.95


def test_held_out_pages(spark):
    rows = [r.html for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("html").collect()]
    m = dom.train(rows[:120])
    right = total = 0
    for h in rows[120:]:
        p = dom.Page(h)
        x, full = p.features()
        logit = np.zeros(len(full))
        logit[full] = m.logit(x[full])
        kept, y = dom.decode(p.parent, p.depth, logit), p.labels()
        right, total = right + (kept[full] == (y[full] > 0)).sum(), total + full.sum()
    assert right / total > 0.97
    h = '<html><body><nav><a href="/">Home</a></nav><div><h1>A title here</h1>' + "<p>This is a long paragraph, with many words and some points. It goes on and on, and tells a story.</p>" * 5 + '</div><footer>&copy; x</footer></body></html>'
    p = dom.Page(h)
    x, full = p.features()
    logit = np.zeros(len(full))
    logit[full] = m.logit(x[full])
    assert "long paragraph" in dom.page_text(p, dom.decode(p.parent, p.depth, logit))


def test_parser():
    p = dom.Page('<p class=ad>one<p>two<br>three<b>four</p><script>var a="</p>";</script><!-- <p>no</p> --><ul><li>a<li>b</ul></nope>tail &amp; end<img src="x>y">')
    assert [t for t in p.tag] == ["#root", "p", "p", "br", "b", "ul", "li", "li", "img"]
    assert dom.page_text(p, np.ones(len(p.tag), bool)) == "one\ntwo\nthreefour\na\nb\ntail & end"
    assert (p.end[1], p.end[5]) == (2, 8)


def test_html_edge_cases(spark):
    good = "<article>" + "<p>Many words, in a row. And more of them, here.</p>" * 4 + "</article><nav><a>x</a></nav>"
    rows = [(1, good, "a"), (1, good, "a"), (2, None, "a"), (3, "", "a"), (None, good, None), (4, "plain text only", "a"), (5, "<<<>>><p", "a"), (6, "<div>" * 3000 + "deep" + "</div>" * 3000, "a"), (7, "<p>" + "word " * 200_000 + "</p>", "a"), (8, "<!-- never closed <p>x</p>", "a")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    got = {r.page_id: r for r in dom.extract(pages).collect()}
    assert dom.extract(pages).count() == 10 and got[2].text is None and got[2].n_nodes == 0 and got[3].text == ""
    assert dom.extract(pages.limit(0)).count() == 0
    bare = dom.extract(pages.filter("page_id = 4")).collect()[0]
    assert bare.text == "plain text only"


def brute_rules(baskets, min_count, min_conf):
    sets = {}
    for items, bad in baskets:
        for n in range(1, len(items) + 1):
            for c in itertools.combinations(sorted(items), n):
                a, b = sets.get(c, (0, 0))
                sets[c] = (a + 1, b + bad)
    rules = {c: b / a for c, (a, b) in sets.items() if b >= min_count and b / a >= min_conf}
    return {c: v for c, v in rules.items() if not any(set(d) < set(c) and rules[d] >= v for d in rules)}


def urls(n):
    r = random.Random(1)
    rows = []
    for i in range(n):
        host = r.choice(["shop", "news", "blog"]) + "." + r.choice(["alpha", "beta", "gamma"]) + ".com"
        path = r.choice(["offer", "win", "item"])
        bad = (("shop" in host and path == "win") and r.random() < 0.9) or r.random() < 0.05
        rows.append((i, f"http://{host}/{path}/{i}?id={i}", int(bad)))
    return rows


def test_rules_equal_brute_force(spark):
    rows = urls(600)
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows], "doc_id bigint, quality int, toxic int")
    rules = urlrules.mine(pages, labels, 0.0, 10, 0.6)
    items = {r.page_id: r.t for r in pages.select("page_id", urlrules.tokens(pages["url"]).alias("t")).collect()}
    want = brute_rules([(items[i], b) for i, _, b in rows], 10, 0.6)
    got = {tuple(r["items"]): r.confidence for r in rules.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and ("h:shop", "p:win") in got
    out = {r.page_id: r for r in urlrules.match(pages, rules).collect()}
    for i, _, _ in rows:
        held = [c for c in want if set(c) <= set(items[i])]
        assert out[i].blocked == bool(held)
        if held:
            assert out[i].rule == min((-want[c], " ".join(c)) for c in held)[1]


def test_url_edge_cases(spark):
    rows = urls(200)
    pages = spark.createDataFrame([(*r[:2], "x") for r in rows] + [(900, None, "x"), (901, "", "x"), (None, "http://shop.alpha.com/win/1", "x"), (902, "not a url at all", None), (903, "http://shop.alpha.com/win/" + "z" * 100_000, "x"), (1, rows[1][1], "x")], "page_id bigint, url string, token string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows] + [(None, 0, 1), (5, None, None), (5, 1, rows[5][2])], "doc_id bigint, quality int, toxic int")
    rules = urlrules.mine(pages, labels, 0.0, 5, 0.6)
    out = urlrules.match(pages, rules)
    assert out.count() == pages.count()
    got = {r.page_id: r.blocked for r in out.collect()}
    assert got[900] is False and got[901] is False and got[902] is False and got[None] is True and got[903] is True
    assert urlrules.match(pages.limit(0), rules).count() == 0
    empty = urlrules.mine(pages, labels.limit(0))
    assert empty.count() == 0 and urlrules.match(pages, empty).filter("blocked").count() == 0
    assert urlrules.filter_urls(pages, labels.limit(3)).filter("blocked").count() == 0


@pytest.mark.parametrize("html", [
    "<p>hello</p><a " + "n" * 1_000_000,
    "<a " * 300_000 + '"',
    '<a "' * 250_000,
    "<!--" * 250_000,
    "<script>" * 100_000 + "</script",
    "<style " * 100_000,
    "<" * 1_000_000,
    "<b>" * 60_000 + "</p>" * 60_000,
    "<p><div>" + "<b>x" * 30_000 + "<p></p>" * 30_000,
])
def test_broken_pages_take_linear_time(html):
    began = time.time()
    page = dom.Page(html)
    page.features()
    dom.page_text(page, dom.decode(page.parent, page.depth, np.ones(len(page.tag))))
    assert time.time() - began < 15


def test_page_cut_within_a_tag_keeps_its_text():
    p = dom.Page("<p>hello</p><div>more <b>text</b> <a href='x")
    assert dom.page_text(p, np.ones(len(p.tag), bool)).replace("\n", " ").startswith("hello more text")
    p = dom.Page('<p>one</p><a href="x>two</a><p>three</p>')
    assert "three" in dom.page_text(p, np.ones(len(p.tag), bool))


def slow_extract(html, trees):
    """One page, node by node: log-odds by walking each tree, the best consistent choice by recursion."""
    page = dom.Page(html)
    x, full = page.features()
    logit = [0.0] * len(full)
    for i in np.flatnonzero(full):
        logit[i] = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            node = 0
            for level in range(trees.depth):
                at = 2**level - 1 + node
                node = node * 2 + int(x[i, feature[at]] > cut[at])
            logit[i] += leaf[node]
    kids = [[j for j in range(len(full)) if page.parent[j] == i] for i in range(len(full))]

    def whole(i):
        return logit[i] + sum(map(whole, kids[i]))

    def best(i):
        """Greatest sum of the subtree and the nodes kept."""
        w = whole(i)
        below = [best(j) for j in kids[i]]
        mixed = sum(v for v, _ in below) - dom.PENALTY if below else -math.inf
        if mixed > max(w, -w) + 1e-9:
            return mixed, {n for _, k in below for n in k}
        return (w, set(range(i, page.end[i]))) if w > -w else (-w, set())

    kept = best(0)[1]
    return dom.page_text(page, np.array([i in kept for i in range(len(full))])), len(full), len(kept)


def test_extract_equals_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    trees = dom.model_for(pages)
    got = {r.page_id: (r.text, r.n_nodes, r.n_kept) for r in dom.extract(pages).collect()}
    assert got == {r.page_id: slow_extract(r.html, trees) for r in pages.collect()} and any(n > k > 0 for _, n, k in got.values())


def test_training_sample_has_one_row_an_id(spark):
    page = "<article><p>Many words, in a row.</p></article><nav><a>x</a></nav>"
    pages = spark.createDataFrame([(7, page + " " * i) for i in range(500)] + [(8, None)], "page_id bigint, html string")
    assert dom.model_for(pages, 1) is not None


def test_tokens_shared_by_all_urls_are_mined_as_one(spark):
    """Thirty query parts in every bad URL would be 2^30 frequent sets; rules have one of them each."""
    shared = "&".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30))
    rows = [(i, f"http://spam.example/x?{shared}", 1) for i in range(60)] + [(100 + i, f"http://good.example/y{i % 9}", 0) for i in range(60)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows], "doc_id bigint, quality int, toxic int")
    rules = urlrules.mine(pages, labels, 0.0, 10, 0.6).collect()
    assert all(len(r["items"]) == 1 and r.support == 60 and r.confidence == 1.0 for r in rules) and len(rules) == 32
    got = urlrules.match(pages, urlrules.mine(pages, labels, 0.0, 10, 0.6))
    assert {r.page_id for r in got.filter("blocked").collect()} == set(range(60))
