import itertools
import random
import re

import numpy as np
import pytest
from conftest import DATA
from sparkloom.llm import html_extract as hx
from sparkloom.llm.dom import Page


def brute_marginals(parent, score, edge, kind):
    n = len(parent)
    total, one = 0.0, np.zeros(n)
    for state in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(s * z for s, z in zip(state, score)) + sum(edge[kind[i], state[parent[i]], state[i]] for i in range(1, n)))
        total += p
        one += p * np.array(state)
    return one / total


@pytest.mark.parametrize("seed", range(4))
def test_messages_give_exact_marginals(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    parent = [-1] + [r.randrange(i) for i in range(1, n)]
    score, edge = [r.gauss(0, 2) for _ in range(n)], np.array([[[r.gauss(0, 1) for _ in range(2)] for _ in range(2)] for _ in range(3)])
    kind = [r.randrange(3) for _ in range(n)]
    got, pairs = hx.marginals(parent, score, edge, kind)
    assert got == pytest.approx(brute_marginals(parent, score, edge, kind).tolist())
    assert all(pairs[i][1] + pairs[i][3] == pytest.approx(got[i]) and pairs[i][2] + pairs[i][3] == pytest.approx(got[parent[i]]) for i in range(1, n))


def test_messages_over_many_trees_at_once():
    r = random.Random(9)
    sizes = [1, 7, 3, 1, 20, 40]
    parents = [[-1] + [r.randrange(i) for i in range(1, n)] for n in sizes]
    kinds = [[r.randrange(3) for _ in range(n)] for n in sizes]
    scores = [[r.gauss(0, 2) for _ in range(n)] for n in sizes]
    edge = np.array([[[r.gauss(0, 1) for _ in range(2)] for _ in range(2)] for _ in range(3)])
    trees = hx.Trees(parents, kinds)
    got, pairs = trees.marginals(np.concatenate(scores)[trees.order], edge)
    want = [hx.marginals(p, s, edge, k) for p, s, k in zip(parents, scores, kinds)]
    assert got == pytest.approx(np.concatenate([w[0] for w in want])[trees.order])
    flat = np.array([x for w in want for x in w[1]])[trees.order].reshape(-1, 2, 2)
    assert np.allclose(pairs[len(sizes) :], flat[len(sizes) :])


@pytest.mark.parametrize("source", ["<a " * 350_000, "<span>" * 87_000 + "</b>" * 130_000, "<p " + "x" * 10**6 + ">", "<p " + "x " * 500_000 + ">", "<dl><dt><dl>" + "<span>" * 87_000 + "<dd>" * 130_000, "<a b='" * 170_000, "</" * 500_000, "<script>" * 130_000])
def test_a_megabyte_of_broken_markup_takes_seconds(source):
    import time

    t = time.time()
    weight, edge = hx.model()
    hx.main_text(source, weight, np.array(edge))
    assert time.time() - t < 15


def test_wide_and_deep_trees_stay_finite():
    got, _ = hx.marginals([-1] + [0] * 50_000, [0.5] * 50_001, np.array([[[2.0, -2], [-2, 2]]]), [0] * 50_001)
    assert np.isfinite(got).all()
    got, _ = hx.marginals([-1, *range(5000)], [0.5] * 5001, np.array([[[2.0, -2], [-2, 2]]]), [0] * 5001)
    assert np.isfinite(got).all()


def test_held_out_labelled_pages():
    assert right_share(random.Random(12345), None) > 0.98


def test_held_out_pages_with_names_of_no_list():
    assert right_share(random.Random(54321), 1) > 0.96


def right_share(r, invented):
    weight, edge = hx.model()
    right, n = 0, 0
    for _ in range(150):
        page, label = hx.labelled_page(r, invented)
        on, kind = hx.features(page)
        p, _ = hx.marginals(page.parent, [sum(weight[f] for f in x) for x in on], np.array(edge), kind)
        right += sum((a > 0.5) == bool(b) for a, b in zip(p, label))
        n += len(label)
    return right / n


PAGES = {
    "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>Shop now</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two <b>three</b> four five six.<p>Next &lt;b&gt; one here it is.</article><footer>&copy; me</footer>": "A & B\nOne two three four five six.\nNext <b> one here it is.",
    "<article><p>Some text that is long enough to read.</p><script>var a='</p>x';</script><style>p{}</style><aside class=sidebar><h3>Related</h3><ul><li><a href=/>More of it</a></li></ul></aside><p>And here is some more of the text.</p></article><section class=comments><h2>Comments</h2><div class=comment><p>Nice post!</p></div></section>": "Some text that is long enough to read.\nAnd here is some more of the text.",
    "<body><div class=page-x><div class=lead-zone><h1>Title of it</h1><p>A first paragraph with a number of words in it, as they have.</p><p>A second one that goes on for a while and says no more than the first.</p></div><div class='feedback-thread'><div class='one-voice'><b>Al</b><p>first!!</p></div><div class='one-voice'><b>Bo</b><p>me too, thanks a lot</p></div></div><div class='site-legal'>All rights reserved 2024 by us.</div></div></body>": "Title of it\nA first paragraph with a number of words in it, as they have.\nA second one that goes on for a while and says no more than the first.",
    "<article><h1>T of it</h1><p>Many words stand here, and some more.</p></article><div class='feedback-thread'>first!! I was here before you</div><div class='site-legal'>All rights reserved, every one of them</div>": "T of it\nMany words stand here, and some more.",
    "just text, no markup &amp; all": "just text, no markup & all",
    "": "",
    None: "",
}


def test_pages(spark):
    rows = [(i, "u", h, 0) for i, h in enumerate(PAGES)] + [(None, None, "<p", 0), (7, "r", "x", 0), (7, "r", "x", 0), (8, None, "<article>" + "<p>many words stand here</p>" * 20_000, 0)]
    got = hx.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert len(got) == len(rows)
    assert [r["text"] for r in sorted((r for r in got if r["page_id"] is not None), key=lambda r: r["page_id"])][: len(PAGES)] == list(PAGES.values())
    assert next(r["text"] for r in got if r["page_id"] == 8) == "\n".join(["many words stand here"] * 20_000)
    assert hx.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_driver_pages_against_their_markup(spark):
    import html

    def article(h):
        m = re.search(r"<article>(.*?)(</article>|$)", h, re.S)
        t = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\0", m[1])))
        return "\n".join(b for b in (re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(x)).strip(" ") for x in t.split("\0")) if b)

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in hx.extract_main_text(pages).collect()} == want


def test_parser_on_broken_markup():
    r = random.Random(2)
    bits = ["<p>", "</p>", "<b>", "<div class='x", "a < b", "&amp;&bogus;", "<!-- ", "-->", "<script>", "</script>", "<li>", "</ul>", "text ", "<a href=x>", "</", "<br/>", "<table><tr><td>", '"']
    for _ in range(300):
        source = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        page = Page(source)
        assert len(page.tag) == len(page.parent) == len(page.words) and all(p < i for i, p in enumerate(page.parent))
