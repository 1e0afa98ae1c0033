"""Main text of web pages by a tree-structured graphical model.

A variable per element says whether its own text is main text. Node potentials
are log-linear in the element's name, its class, id and role words, its text and link
sizes, and where it stands: beside or outside what holds the article or its title,
early or late in the page's text, among siblings made like it. An edge potential
couples each element with its parent, one for elements that set themselves apart
by name, one for others; those without text are free. The DOM is a tree, so sum-product messages up to the root and down again give exact
marginals. Parameters are trained by gradient ascent on the likelihood of labelled
pages, which takes the same messages. Text whose element is more likely content
than not is kept, a line for each block.

The labelled pages are made here from a fixed seed: layouts of articles among
menus, headers, footers, sidebars, notices, adverts, forms and comments, with the
elements of the article marked. TRAIN_PAGES bounds them. Many of their class and id
names are invented, so that names the model doesn't know are no sign of an article.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_arrow
from sparkloom.llm.dom import HEADINGS, RAW, Page, block_text

TRAIN_PAGES, ROUNDS, RATE, DECAY = 600, 250, 0.3, 1e-4

# Words of class, id and role attributes, by what they speak of.
NAMES = {
    "advert": "ad ads adv advert advertisement adsense adslot banner dfp promo promotion sponsor sponsored".split(),
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination tabs toc toolbar".split(),
    "frame": "copyright footer foot header masthead site-footer site-header top topbar logo".split(),
    "side": "aside complementary related recommended rail sidebar side widget trending popular teaser".split(),
    "notice": "alert consent cookie cookies gdpr modal notice overlay popup newsletter subscribe paywall".split(),
    "comment": "comment comments disqus reply replies respond discussion".split(),
    "share": "social share sharing follow tags author-bio".split(),
    "content": "article article-body body content entry main post story text article-content post-content entry-content".split(),
}
WORDS = {w: kind for kind, words in NAMES.items() for w in words}
TAGS = "#root html head body article main section div p span a b i em strong u small h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th blockquote pre code figure figcaption header footer nav aside form input button select option label textarea script style noscript title img br hr details summary dialog menu template iframe".split()
KINDS = list(NAMES)
SIZES = (1, 3, 10, 25, 60)
FEATURES = ["bias", *(f"tag {t}" for t in [*TAGS, "other"]), *(f"name {k}" for k in KINDS), *(f"size {s}" for s in SIZES), "links", "some links", "head", "page with holder", "below holder", "below other", "outside holder", "holds title", "beside title", "page with title", "outside title", "before all", "after all", "named twin", "legal", "alone", "of half the page", "unknown name"]
HOLDERS, OTHERS = frozenset(["article", "main"]), frozenset("aside dialog footer form head header menu nav".split())
SECTIONS = frozenset("article aside body dialog footer form header main menu nav section".split())
# What notices of rights say.
RIGHTS = ("©", "copyright", "rights reserved", "droits réservés", "rechte vorbehalten", "derechos reservados")
PLACE = {f: i for i, f in enumerate(FEATURES)}


def features(page: Page) -> tuple[list[list[int]], list[int]]:
    """Of each element the indices into FEATURES, and the kind of its edge: 0 without text, 1 with a name of its own, 2 plain."""
    n = len(page.tag)
    own, total, linked, rights, title = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    children: list[dict[tuple[str, str], int]] = [{} for _ in range(n)]
    begun, said_so_far = [-1] * n, 0
    for node, text in page.text:
        if text and not text.isspace():
            size = text.count(" ") + 1
            own[node] += size
            if begun[node] < 0:
                begun[node] = said_so_far
            said_so_far += size
            if size <= 40 and any(r in text.lower() for r in RIGHTS):
                rights[node] = True
    for i in range(n - 1, -1, -1):
        tag = page.tag[i]
        total[i] += own[i]
        if tag == "a":
            linked[i] = total[i]
        if i:
            j = page.parent[i]
            total[j] += total[i]
            linked[j] += linked[i]
            rights[j] |= rights[i] and total[i] <= 40
            if begun[i] >= 0 and not 0 <= begun[j] <= begun[i]:
                begun[j] = begun[i]
            if page.words[i] and total[i]:
                made = (tag, page.words[i])
                children[j][made] = children[j].get(made, 0) + 1
    out, kinds_of = [], []
    # Below which kind of named element each one stands: 1 one that holds articles, 2 another; the nearest counts.
    below, named = [0] * n, [0] * n
    kinds: list[set[str]] = []
    for i in range(n):
        tag, words = page.tag[i], page.words[i]
        kinds.append({WORDS[w] for token in words.split() for w in (token, *token.replace("_", "-").split("-")) if w in WORDS} if words else set())
        said = kinds[i]
        named[i] = 2 if tag in OTHERS or said and said != {"content"} else 1 if tag in HOLDERS or said else 0
        below[i] = named[page.parent[i]] or below[page.parent[i]] if i else 0
    holder, whole = 1 in named, max(1, total[0])
    first_title = next((i for i in range(n) if page.tag[i] == "h1" and total[i] and below[i] != 2), 0)
    beside = page.parent[first_title] if first_title else -1
    inside = [i == beside for i in range(n)]
    above = first_title
    while above > 0:
        title[above] = True
        above = page.parent[above]
    for i in range(n):
        tag, words = page.tag[i], page.words[i]
        kinds_of.append(0 if not total[i] else 1 if words or tag in SECTIONS else 2)
        on = [0, PLACE.get(f"tag {tag}", PLACE["tag other"])]
        if words:
            on += [PLACE[f"name {k}"] for k in sorted(kinds[i])] or [PLACE["unknown name"]]
        on += [PLACE[f"size {s}"] for s in SIZES if total[i] >= s]
        if linked[i] * 2 > total[i]:
            on.append(PLACE["links"])
        if linked[i] * 5 > total[i]:
            on.append(PLACE["some links"])
        if tag in HEADINGS and total[i]:
            on.append(PLACE["head"])
        if holder:
            on.append(PLACE["page with holder"])
            if below[i] != 1 and named[i] != 1:
                on.append(PLACE["outside holder"])
        if below[i]:
            on.append(PLACE["below holder" if below[i] == 1 else "below other"])
        if first_title:
            on.append(PLACE["page with title"])
            if title[i]:
                on.append(PLACE["holds title"])
            elif i and page.parent[i] == beside:
                on.append(PLACE["beside title"])
            if i and beside > 0 and inside[page.parent[i]]:
                inside[i] = True
            elif not inside[i] and not title[i]:
                on.append(PLACE["outside title"])
        if total[i]:
            if (begun[i] + total[i]) * 5 < whole:
                on.append(PLACE["before all"])
            if begun[i] * 5 > whole * 3:
                on.append(PLACE["after all"])
            if total[i] * 2 > whole:
                on.append(PLACE["of half the page"])
        if words and i and children[page.parent[i]].get((tag, words), 0) > 1:
            on.append(PLACE["named twin"])
        if rights[i]:
            on.append(PLACE["legal"])
        if n == 1:
            on.append(PLACE["alone"])
        out.append(on)
    return out, kinds_of


def marginals(parent: list[int], score: list[float], edge: np.ndarray, kind: list[int]) -> tuple[list[float], list[list[float]]]:
    """Of each element, the probability of being content; of each element and its parent, that of (0,0), (0,1), (1,0), (1,1), the parent first. score: the node potentials' log odds; edge[kind, parent, own]: logs. Parents come before children."""
    n = len(parent)
    by_kind = [(a, b, c, d) for (a, b), (c, d) in np.exp(edge - edge.max(axis=(1, 2), keepdims=True)).tolist()]
    # Beliefs from below: of the two states, relative to their sum.
    up1, up0 = [0.0] * n, [0.0] * n
    for i in range(n):
        z = max(-30.0, min(30.0, score[i]))
        up1[i] = p = 1.0 / (1.0 + 2.718281828459045 ** -z)
        up0[i] = 1.0 - p
    to0, to1 = [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        e00, e01, e10, e11 = by_kind[kind[i]]
        a, b = up0[i], up1[i]
        m0, m1 = e00 * a + e01 * b, e10 * a + e11 * b
        s = m0 + m1
        to0[i], to1[i] = m0 / s, m1 / s
        j = parent[i]
        a, b = up0[j] * to0[i], up1[j] * to1[i]
        s = a + b
        up0[j], up1[j] = (a / s, b / s) if s > 0 else (0.5, 0.5)
    out, pairs = [0.0] * n, [[0.0] * 4] * n
    full0, full1 = [0.0] * n, [0.0] * n
    full0[0], full1[0] = up0[0], up1[0]
    out[0] = up1[0]
    for i in range(1, n):
        j = parent[i]
        e00, e01, e10, e11 = by_kind[kind[i]]
        # The parent's belief without this child.
        a, b = full0[j] / max(to0[i], 1e-300), full1[j] / max(to1[i], 1e-300)
        q = [a * e00 * up0[i], a * e01 * up1[i], b * e10 * up0[i], b * e11 * up1[i]]
        s = q[0] + q[1] + q[2] + q[3]
        q = [x / s for x in q] if s > 0 else [0.25] * 4
        pairs[i] = q
        full0[i], full1[i] = q[0] + q[2], q[1] + q[3]
        out[i] = full1[i]
    return out, pairs


def labelled_page(r: random.Random, invented: float | None = None) -> tuple[Page, list[int]]:
    """A made page and a label for each element: 1 inside the element marked x-main, but 0 in those marked x-not; the marks are taken off. invented: the share of names from no list, by chance if None."""
    word = lambda: "".join(r.choice(("la", "ten", "or", "mi", "su", "re", "ion", "ka", "the", "é", "en")) for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(r.randint(a, b)))
    strange = r.choice((0, 0, 0.3, 1)) if invented is None else invented  # the share of names that are invented
    known = lambda kind: r.choice(NAMES[kind]) if r.random() >= strange else f"{word()}{r.choice(('-', '_', ''))}x{word()}"
    name = lambda kind: r.choice(["", *(f' class="{known(kind)}"' for _ in range(4)), f' id="{known(kind)}-{r.randint(1, 9)}"'])
    named = lambda kind: r.choice((f' class="{known(kind)}"', f' id="{known(kind)}"', f' class="box {known(kind)}-{word()}"'))

    def inline(a: int, b: int) -> str:
        text = say(a, b)
        return r.choice((text, text, f"{text} <a href='/{word()}'>{say(1, 3)}</a> {say(1, 9)}", f"<b>{say(1, 6)}</b> {text}", f"{text} <em>{say(1, 3)}</em>", f"<b>{text}", f"<span>{text}</span>", f"{text}<br>{say(1, 12)}"))

    def boiler() -> str:
        return r.choice(
            (
                lambda: f"<nav{name('menu')}><ul>{links(2, 9)}</ul></nav>",
                lambda: f"<div{named('menu')}><ul>{links(2, 9)}</ul></div>",
                lambda: f"<div{named('advert')}>{r.choice((say(2, 14), f'<p>{say(3, 12)}</p>', f'<a>{say(2, 9)}</a>'))}</div>",
                lambda: f"<aside{name('side')}><h3>{say(1, 4)}</h3>{r.choice((f'<ul>{links(2, 6)}</ul>', f'<p>{say(4, 30)}</p>'))}</aside>",
                lambda: f"<div{named('side')}><h2>{say(1, 4)}</h2><p>{say(4, 30)}</p></div>",
                lambda: f"<div{named('notice')}><p>{say(4, 25)}</p><button>{say(1, 2)}</button></div>",
                lambda: f"<form{name('notice')}><label>{say(1, 3)}</label><input name=q><button>{say(1, 2)}</button><p>{say(2, 9)}</p></form>",
                lambda: f"<script>var a='{word()}';</script><style>p{{}}</style>",
                lambda: f"<div{named('share')}><a>{say(1, 1)}</a> <a>{say(1, 1)}</a></div>",
            )
        )()

    def comments() -> str:
        own = r.choice(("comment", "reply")) if r.random() >= strange else word()
        one = lambda: f"<div class='{own}'>{r.choice(('', f'<b>{say(1, 2)}</b>'))}<p>{say(3, 60)}</p></div>"
        return f"<{(t := r.choice(('section', 'div', 'ol')))}{named('comment')}><h2>{say(1, 3)}</h2>{''.join(one() for _ in range(r.randint(1, 4)))}</{t}>"

    short, long = r.choice(((1, 2), (1, 8), (4, 70), (4, 70), (20, 200)))

    def block() -> str:
        return r.choice(
            (
                *[lambda: f"<p>{inline(short, long)}{r.choice(('</p>', '</p>', ''))}"] * 12,
                lambda: f"<h{(k := r.randint(2, 4))}>{say(1, 8)}</h{k}>",
                lambda: "<ul>" + "".join(f"<li>{inline(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                lambda: f"<blockquote><p>{say(5, 40)}</p></blockquote>",
                lambda: f"<pre>{say(3, 20)}</pre>",
                lambda: f"<table><tr><th>{say(1, 2)}</th><td>{say(1, 9)}</td></tr></table>",
                lambda: f"<figure><img src=x><figcaption>{say(2, 9)}</figcaption></figure>",
                lambda: f"<div>{say(4, 40)}</div>",
                lambda: f"<p>{say(1, 3)}</p>",
            )
        )()

    blocks = [block() for _ in range(r.choice((0, 1, 2, 5, 9, 20, 50)))]
    for _ in range(r.choice((0, 0, 1, 2, 3))):
        blocks.insert(r.randint(0, len(blocks)), mark_first(boiler(), "x-not"))
    body = (f"<h1>{say(1, 12)}</h1>" if r.random() < 0.8 else "") + "".join(blocks)
    holder = r.choice(("article", "article", "article", "main", "div", "section"))
    mark = name("content") if holder != "div" else named("content")
    main = mark_first(f"<{holder}{mark}>{body}</{holder}>", "x-main")
    if r.random() < 0.15:  # nothing holds the article together
        main = "".join(mark_first(b, "x-main") if "x-not" not in b else b for b in [f"<h1>{say(1, 12)}</h1>", *blocks])
    before = "".join(boiler() for _ in range(r.randint(0, 3)))
    if r.random() < 0.5:
        before = f"<header{name('frame')}><a>{say(1, 2)}</a>{r.choice(('', f'<p>{say(1, 6)}</p>', f'<h1>{say(1, 3)}</h1>'))}</header>" + before
    after = "".join(boiler() for _ in range(r.randint(0, 2))) + (comments() if r.random() < 0.4 else "")
    if r.random() < 0.8:
        foot = f"footer{name('frame')}" if r.random() >= strange / 2 else f"div{named('frame')}"
        after += f"<{foot}>{r.choice((f'&copy; {say(2, 14)}', f'{say(1, 4)}. {r.choice(RIGHTS[2:])} {say(0, 9)}', f'<p>{say(2, 25)}</p>', f'<ul>{links(1, 5)}</ul>', f'<div>{say(2, 9)} <a>{say(1, 2)}</a></div>'))}</{foot.split()[0]}>"
    middle = f"<div class='{r.choice(('page', 'wrap', 'container', 'row'))}'>{before}{main}{after}</div>" if r.random() < 0.4 else before + main + after
    head = f"<head><title>{say(1, 6)}</title><style>p{{margin:0}}</style><script>var x='{word()}';</script></head>" if r.random() < 0.8 else ""
    source = middle if r.random() < 0.2 else f"<html>{head}<body>{middle}" + r.choice(("</body></html>", ""))
    if r.random() < 0.04:  # no markup at all: the text is all there is
        return Page(say(1, 60)), [1]
    page = Page(source)
    label = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        words = page.words[i]
        label[i] = 1 if "x-main" in words else 0 if "x-not" in words else label[page.parent[i]]
        page.words[i] = words.replace("x-main", "").replace("x-not", "").strip()
    return page, label


def mark_first(source: str, role: str) -> str:
    """source with a role on its first element."""
    return re.sub(r"^<(\w+)", rf"<\1 role={role}", source)


class Trees:
    """Some trees as one array, a level after the other, for messages over all of them at once."""

    def __init__(self, parents: list[list[int]], kinds: list[list[int]]) -> None:
        begin = np.cumsum([0, *map(len, parents)])
        parent = np.concatenate([np.array(p) + b for p, b in zip(parents, begin)])
        is_root = np.zeros(len(parent), bool)
        is_root[begin[:-1]] = True
        depth = np.zeros(len(parent), int)
        for i in np.flatnonzero(~is_root).tolist():
            depth[i] = depth[parent[i]] + 1
        self.order = np.argsort(depth, kind="stable")
        place = np.empty(len(parent), int)
        place[self.order] = np.arange(len(parent))
        self.parent = np.where(is_root, -1, place[parent])[self.order]
        self.kind = np.concatenate([np.array(k) for k in kinds])[self.order]
        self.level = np.concatenate(([0], np.cumsum(np.bincount(depth))))

    def marginals(self, score: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As marginals(), in the order of the levels; the rows of roots in the second have no meaning."""
        n = len(score)
        up = np.stack((np.zeros(n), np.clip(score, -30, 30)), axis=1)
        to = np.zeros((n, 2))
        levels = list(zip(self.level[:-1], self.level[1:]))
        for a, b in reversed(levels[1:]):
            m = np.logaddexp(*np.moveaxis(edge[self.kind[a:b]] + up[a:b, None, :], 2, 0))
            to[a:b] = m - m.max(axis=1, keepdims=True)
            np.add.at(up, self.parent[a:b], to[a:b])
        full, pairs = np.zeros((n, 2)), np.zeros((n, 2, 2))
        a, b = levels[0]
        full[a:b] = up[a:b] - np.logaddexp(up[a:b, 0], up[a:b, 1])[:, None]
        for a, b in levels[1:]:
            q = (full[self.parent[a:b]] - to[a:b])[:, :, None] + edge[self.kind[a:b]] + up[a:b, None, :]
            q = np.exp(q - q.max(axis=(1, 2), keepdims=True))
            q /= q.sum(axis=(1, 2), keepdims=True)
            pairs[a:b] = q
            full[a:b] = np.log(np.maximum(q.sum(axis=1), 1e-300))
        return np.exp(full[:, 1]), pairs


@functools.cache
def model(pages: int = TRAIN_PAGES, rounds: int = ROUNDS, seed: int = 7) -> tuple[list[float], list[list[float]]]:
    """Node weights and edge logs, by gradient ascent with per-parameter rates (AdaGrad) over the labelled pages."""
    r = random.Random(seed)
    data = []
    for _ in range(pages):
        page, label = labelled_page(r)
        data.append((page.parent, *features(page), label))
    weight, edge = np.zeros(len(FEATURES)), np.array([[[0.0, 0], [0, 0]], *[[[0.5, -0.5], [-0.5, 0.5]]] * 2])
    wsum, esum = np.full(len(FEATURES), 1e-6), np.full(edge.shape, 1e-6)
    trees = Trees([d[0] for d in data], [d[2] for d in data])
    on = [x for d in data for x in d[1]]
    on = [on[i] for i in trees.order.tolist()]
    col, row = np.array([f for x in on for f in x]), np.repeat(np.arange(len(on)), [len(x) for x in on])
    label = np.array([y for d in data for y in d[3]])[trees.order]
    n, below = len(label), slice(trees.level[1], None)
    kind, parent = trees.kind[below], trees.parent[below]
    for _ in range(rounds):
        prob, pairs = trees.marginals(np.bincount(row, weights=weight[col], minlength=n), edge)
        gw = np.bincount(col, weights=(label - prob)[row], minlength=len(FEATURES))
        ge = np.zeros(edge.shape)
        np.add.at(ge, kind, -pairs[below])
        np.add.at(ge, (kind, label[parent], label[below]), 1)
        ge[0] = 0
        gw, ge = gw / n - DECAY * weight, ge / n - DECAY * edge
        wsum, esum = wsum + gw**2, esum + ge**2
        weight += RATE * gw / np.sqrt(wsum)
        edge += RATE * ge / np.sqrt(esum)
    return weight.tolist(), edge.tolist()


def main_text(source: str, weight: list[float], edge: np.ndarray) -> str:
    page = Page(source)
    on, kind = features(page)
    prob, _ = marginals(page.parent, [sum(weight[f] for f in x) for x in on], edge, kind)
    out, parts = [], []
    for node, text in page.text:
        if text is None:
            if parts and (line := block_text(parts)):
                out.append(line)
            parts = []
        elif prob[node] > 0.5 and page.tag[node] not in RAW:
            parts.append(text)
    if parts and (line := block_text(parts)):
        out.append(line)
    return "\n".join(out)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: the id, url, text.

    A null html is empty, and its text too. Character references are decoded, runs
    of [\\x20\\x09-\\x0D] in a block (and br) become one space, and blocks are
    joined by a line feed. Unclosed and stray tags are read as browsers do; a tag
    that never ends is no text, nor is what follows it. A page without any markup
    is all text. A page may be of any length, and its markup as deep or broken as
    it likes: the work is linear in it. Other columns are not read, whatever their
    names; rows repeat as given, and an empty table gives an empty result.
    """
    bounded_arrow(pages.sparkSession)
    weight, logs = model()
    edge = np.array(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "", weight, edge) for h in batch.column("_h").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_u"), pa.array(texts, pa.string())], names=["_id", "_u", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_u"), F.col(html_col).alias("_h")).mapInArrow(run, f"_id {kinds[0]}, _u {kinds[1]}, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_u").alias(url_col), "text")
