import random
import re

import pytest
from sparkloom.llm import decontaminate
from sparkloom.llm.queries import F


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, span=10):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            x = words(text)
            m = min(len(x), span)
            grams = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if m else set()
            for k in range(len(w) - m + 1) if m else ():
                if tuple(w[k : k + m]) in grams:
                    hit.update(range(k, k + m))
                    ids.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0, "n") for i, t in docs], "doc_id bigint, text string, n_words int, spans string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, t int")
    got = decontaminate.find_contamination(d, b, **kw).select("doc_id", "n_words", decontaminate.n_covered(F.col("spans")), F.array_sort("items"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made(seed, n_docs=40):
    r = random.Random(seed)
    vocabulary = ["a", "B", "c1", "dé", "É", "f"]
    say = lambda n: r.choice((" ", "-", "\n\x7f")).join(r.choice(vocabulary) for _ in range(n))
    items = [(k, say(r.choice((0, 1, 2, 3, 5, 9, 10, 11, 14, 30)))) for k in range(12)] + [(3, say(12)), (None, say(10)), (99, None), (98, "...")]
    long = [t for _, t in items if t and len(words(t)) > 6]
    docs = [(i, f"{say(r.randint(0, 30))} {r.choice(long)}, {say(r.randint(0, 30))} {r.choice(long)[:20]}") for i in range(n_docs)]
    return docs + [(None, None), (7, ""), (8, docs[0][1]), (8, docs[0][1]), (9, "!?")], items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [16 << 20, 40])
def test_against_brute_force(spark, seed, block):
    docs, items = made(seed)
    # Short items of common words hit everything, so half of the runs go without them.
    items = [x for x in items if seed % 2 or not x[1] or len(words(x[1])) > 4]
    assert found(spark, docs, items, block_bytes=block) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_long_text_and_repeats(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    docs = [(1, "x " * 300_000 + passage + " y" * 300_000), (2, (passage + " ") * 50), (3, " ".join(passage.split()[:9]))]
    assert found(spark, docs, [(1, passage), (2, passage)]) == brute(docs, [(1, passage), (2, passage)])


@pytest.mark.parametrize("seed", range(5))
def test_every_long_shared_span_has_a_kept_gram(seed):
    r = random.Random(seed)
    shared = [f"s{r.randint(0, 3)}" for _ in range(10)]
    texts = [" ".join([f"a{r.random()}" for _ in range(r.randint(0, 9))] + shared + [f"b{r.random()}" for _ in range(r.randint(0, 9))]).encode() for _ in range(2)]
    kept = []
    for t in texts:
        h, first = decontaminate.words_of([t])
        kept.append(set(decontaminate.kept_grams(h, first, 10, 5)[1].tolist()))
    assert kept[0] & kept[1]


def test_carry(spark):
    d = spark.createDataFrame([(1, "a b c", "s")], "doc_id bigint, text string, source string")
    b = spark.createDataFrame([(1, "b c"), (2, "a b"), (3, "z z")], "item_id bigint, text string")
    for block in (1 << 20, 3):
        got = decontaminate.find_contamination(d, b, block_bytes=block, carry=("doc_id", "text", "source")).collect()
        assert [(r["doc_id"], r["text"], r["source"], sorted(r["items"])) for r in got] == [(1, "a b c", "s", ["1", "2"])]


def test_equal_words_take_linear_time():
    """20,000 equal words against an item of as many, and against many items that repeat them."""
    import time

    texts = [b"a " * 20_000, b"b a " * 10_000]
    block = decontaminate.Block(["x", *map(str, range(200))], [texts[0], *[b"a " * 300 + b"b a " * 100] * 200], 10, 5)
    t = time.time()
    start, end, of, text, item = block.hits(*decontaminate.words_of(texts))
    assert time.time() - t < 5
    assert list(zip(start, end, of)) == [(0, 20_000, 0), (0, 20_000, 1)]
    assert sorted(zip(text.tolist(), item.tolist())) == sorted([(0, 0), *((k, i) for k in range(2) for i in range(1, 201))])
