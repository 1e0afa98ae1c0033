import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from sparkloom.llm import ctw

SCHEMA = "doc_id bigint, text string, score int, _t string"


class Tree:
    """Context-tree weighting by its definition: a dictionary of counts by context and bits."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, collections.Counter()
        for t in texts:
            for context, byte in self.steps(t):
                for bit in range(8):
                    for d in range(depth + 1):
                        self.n[context[:d], (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1] += 1
        self.children = collections.defaultdict(set)
        for c, b, _ in list(self.n):
            if c:
                self.children[c[:-1], b].add(c)
        self.memo = {}

    def steps(self, t):
        data = bytes([255]) * self.depth + t.lower() + bytes([255])
        for i in range(self.depth, len(data)):
            yield data[i - self.depth : i][::-1], data[i]

    def kt(self, c, b):
        n0, n1 = self.n[c, b, 0], self.n[c, b, 1]
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def weighted(self, c, b):
        if (c, b) not in self.memo:
            own = self.kt(c, b)
            if len(c) < self.depth:
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(self.weighted(x, b) for x in self.children[c, b]))
            self.memo[c, b] = own
        return self.memo[c, b]

    def predict(self, context, b, one, d=0):
        c = context[:d]
        n0, n1 = self.n[c, b, 0], self.n[c, b, 1]
        if n0 + n1 == 0:
            return None if d else 0.5
        p = ((n1 if one else n0) + 0.5) / (n0 + n1 + 1)
        below = self.predict(context, b, one, d + 1) if d < self.depth else None
        if below is None:
            return p
        stop = math.exp(math.log(0.5) + self.kt(c, b) - self.weighted(c, b))
        return stop * p + (1 - stop) * below

    def score(self, t):
        return sum(math.log10(self.predict(c, (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1)) for c, byte in self.steps(t) for k in range(8))


def made(seed, n=60):
    r = random.Random(seed)
    say = lambda: " ".join(r.choice(("ab", "Abc", "é", "cab", "d\ne")) for _ in range(r.randint(0, 25)))
    rows = [(i, say()) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (None, "ab"), (None, None), (3, rows[3][1]), (3, rows[3][1]), (1002, "zq \x00\x0b x"), (1003, "ab " * 20_000)]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


@pytest.mark.parametrize("seed,depth", [(0, 3), (1, 4), (2, 6)])
def test_score_against_definition(spark, monkeypatch, seed, depth):
    rows = made(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    got = ctw.score_texts(df, depth=depth).collect()
    assert len(got) == len(rows)
    tree = Tree([(t or "").encode() for i, t in rows if not held(i)], depth)
    want = sorted((-1 if i is None else i, tree.score((t or "").encode())) for i, t in rows if len(t or "") < 1000)
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got if r["n_bytes"] < 1000)
    assert [w[0] for w in want] == [h[0] for h in have]
    assert [h[1] for h in have] == pytest.approx([w[1] for w in want], rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("most", [10, 10**6])
def test_base_columns_and_both_ways(spark, most):
    rows = made(4)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, ctw.score_texts(df, broadcast_rows=most, block_bytes=500).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=repr)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for i, t in rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_both_ways_agree(spark):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in made(5)], SCHEMA)
    a, b = (sorted((r["doc_id"] or -1, r["score"]) for r in ctw.score_texts(df, broadcast_rows=most, block_bytes=500).collect()) for most in (10, 10**6))
    assert a == b


def test_empty_and_untrained(spark):
    assert ctw.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    out = next(i for i in range(100) if held(i))
    got = ctw.score_texts(spark.createDataFrame([(out, "ab", 0, "x")], SCHEMA)).collect()
    assert got[0]["bits_per_byte"] == pytest.approx(8) and got[0]["train_tokens"] == 0 and got[0]["n_known"] == 0


def test_it_is_a_distribution():
    r = random.Random(1)
    texts = ["".join(r.choice("abc ") for _ in range(50)).encode() for _ in range(10)]
    keys, _ = ctw.strings_of(texts, 3)
    context = np.unique(keys >> 8)[7]
    every = np.unique(np.concatenate((keys, (context << 8) + np.arange(256))))
    v, n = ctw.tallied(keys)
    count = np.where(np.isin(every, v), n[np.minimum(np.searchsorted(v, every), len(v) - 1)], 0)
    upper = ctw.Nodes(*ctw.second(every, count, 3))
    first = ctw.Nodes(*upper.sums())
    p = 10 ** ctw.log10_of(every, count, 3, upper, first, ctw.Nodes(*first.sums()))
    assert p[every >> 8 == context].sum() == pytest.approx(1)
