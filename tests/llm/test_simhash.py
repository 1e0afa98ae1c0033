import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from sparkloom.llm import components, simhash


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(n, pairs):
    up = list(range(n))
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_query_against_brute_force(spark):
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(("Aa", "b", "cé", "D", "e")) for _ in range(n))
    base = [say(n) for n in (0, 1, 2, 3, 4, 30, 400, 400)]
    rows = [(i, r.choice(base) + r.choice(("", " x", "\t\n"))) for i in range(60)] + [(100, None), (101, " "), (99, None), (102, "long " * 50_000), (103, "long " * 50_001), (7, base[5]), (7, base[5])]
    got = simhash.simhash_components(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, _fp int, root string")).collect()
    prints = [brute_print(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = components_of(len(rows), near)
    low = {x: min(rows[k][0] for k in range(len(rows)) if root[k] == x) for x in set(root)}
    assert sorted(map(tuple, got)) == sorted((rows[k][0], f"{prints[k]:016x}", low[root[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("hot", [3, 20_000])
@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_links_against_all_pairs(spark, monkeypatch, hot, budget):
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    monkeypatch.setattr(simhash, "JOINED_ROWS", 40)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    r = random.Random(budget)
    values = {0, 1, (1 << 64) - 1}
    for _ in range(25):
        c = r.getrandbits(64)
        for _ in range(12):
            v = c
            for _ in range(r.randint(0, 6)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "_fp bigint"), budget).collect()
    assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() >= 1 for u, v in links)
    at = {v: k for k, v in enumerate(signed)}
    want = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= budget]
    assert components_of(len(values), [(at[u], at[v]) for u, v in links]) == components_of(len(values), want)


def test_buckets_have_a_bound():
    """After the last cut a bucket's bits leave fewer than HOT_ROWS values at the query's budget."""
    masks = {k: 0 for k in range(1)}
    for _ in range(simhash.CUTS + 1):
        masks = {new: mask for parts in simhash.cut_again(masks, 2).values() for new, _, mask in parts}
    assert 2 ** max(64 - m.bit_count() for m in masks.values()) < simhash.HOT_ROWS and len(masks) == 81


def test_components(spark):
    r = random.Random(0)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(150)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()))
    root = components_of(1200, pairs)
    assert got == {x: root[x] for p in pairs if p[0] != p[1] for x in p}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_near_duplicates(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 200))]
        for edits in (0, 1, 2, len(base) // 4):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(900, None), (901, " "), (902, "a b"), (903, "A b"), (904, "a c"), (905, rows[0][1]), (905, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, sketch int")
    kept = sorted(x[0] for x in simhash.drop_near_duplicates(docs).select("doc_id").collect())
    sets = [shingles(t) for _, t in rows]
    like = lambda a, b: not (a or b) or len(a & b) >= 0.8 * len(a | b) > 0
    root = components_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if like(sets[a], sets[b])])
    assert kept == sorted(rows[k][0] for k in set(root))
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []


def test_sketches_tell_similarity(spark):
    """The share of equal bins is near the similarity, and no pair at 0.8 or more is passed over."""
    r = random.Random(1)
    texts = []
    for k in range(120):
        w = [f"w{r.randrange(10**6)}" for _ in range(r.choice((5, 8, 40, 300, 3000)))]
        texts += [w, w[: int(len(w) * r.uniform(0.6, 1))] + [f"x{r.randrange(10**6)}" for _ in range(r.randint(0, 3))]]
    rows = simhash.signatures(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "_k bigint, _t string"), 5).collect()
    sketch = {x["_k"]: np.frombuffer(x["sketch"], np.uint8)[None] for x in rows}
    sets = [shingles(" ".join(w)) for w in texts]
    assert all(x["n"] == len(sets[x["_k"]]) for x in rows)
    told = 0
    for i in range(0, len(texts), 2):
        j = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
        p, _, share = simhash.sketch_pairs(sketch[i], sketch[i + 1], np.ones((1, 1), bool), 0.8)
        assert len(p) or j < 0.8
        told += len(p)
        if len(p) and len(sets[i]) > 250:
            assert abs(share[0] - j) < 0.1
    assert told < 120
    assert np.all(simhash.BITS.sum(axis=1) == [bin(b).count("1") for b in range(256)])


def test_null_ids_and_empty_tables(spark):
    schema = "doc_id bigint, text string, _low string, component_id int"
    rows = [(None, "a b c d", "x", 1), (5, "a b c d", "x", 1), (7, "A b  c d", "x", 1), (None, "p q r s t u", "x", 1), (None, None, "x", 1), (None, "", "x", 1)]
    got = simhash.simhash_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["fingerprint"] == "0" * 16) for r in got) == [(0, 0, False), (0, 0, True), (0, 0, True), (0, 5, False), (5, 5, False), (7, 5, False)]
    assert simhash.simhash_components(spark.createDataFrame([], schema)).collect() == []
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, schema)).collect()
    # The row without an id goes for the one with the smallest; of those that have none, one key stays.
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:1]) for r in kept) in ([(0, ""), (0, "p"), (5, "a")], [(0, ""), (0, ""), (0, "p"), (5, "a")])


def kept_and_wanted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    kept = sorted(x[0] for x in simhash.drop_near_duplicates(docs).select("doc_id").collect())
    sets = [shingles(t) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return kept, sorted(set(components_of(len(texts), near))), near


def test_near_duplicates_by_one_run_of_words(spark):
    """Texts appended, cut off or with another tail, at similarities just above and below 0.8."""
    r = random.Random(11)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(150):
        w = say(r.randint(60, 600))
        cut = int(len(w) * r.uniform(0.01, 0.23))
        texts += [" ".join(w), " ".join((w + say(cut), w[: len(w) - cut], w[: len(w) - cut // 2] + say(cut // 2))[k % 3])]
    kept, want, near = kept_and_wanted(spark, texts)
    assert kept == want and 100 < len(near) < 150


def test_near_duplicates_of_moved_sentences(spark):
    """The same words in each text of a group; one of them is just too far from two that are alike."""
    r = random.Random(12)
    texts = []
    for _ in range(80):
        lines = [" ".join(f"w{r.randrange(10**6)}" for _ in range(10)) for _ in range(25)]
        for moves in (0, 1, 3):
            w = list(lines)
            for _ in range(moves):
                w.insert(r.randrange(24), w.pop(r.randrange(25)))
            texts.append(" ".join(w))
    kept, want, near = kept_and_wanted(spark, texts)
    assert kept == want and len(near) >= 70


@pytest.mark.parametrize("cell, first", [(1024, 16), (9, 1)])
def test_near_duplicates_that_only_a_base_links(spark, monkeypatch, cell, first):
    """Copies at about 0.86 to their base and 0.73 to each other; small cells and few partners take several rounds."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "CELL_SHINGLES", 200 * cell)
    monkeypatch.setattr(simhash, "FIRST", first)
    r = random.Random(13)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(200):
        w = list(base)
        for at in r.sample(range(200), 3):
            w[at] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    kept, want, near = kept_and_wanted(spark, texts)
    assert kept == want and len(near) > 200


def test_hot_buckets_that_are_connected_reach_no_task(spark):
    """Of 3,000 rows in one bucket and 4 in another, only those in different components are compared, each pair of them."""
    rows = spark.range(3004).select(F.col("id").alias("_k"), F.lit(7).alias("n"), F.lit(bytes(simhash.BINS)).alias("sketch"), F.array(F.when(F.col("id") < 3000, 1).otherwise(2).cast("bigint")).alias("bands"))
    buckets = rows.select(F.when(F.col("_k") < 3000, 1).otherwise(2).cast("bigint").alias("key"), "_k", "n")
    roots = rows.where("_k < 3000").select(F.col("_k").alias("u"), F.lit(0).cast("bigint").alias("root"))
    got = simhash.open_pairs(buckets, roots, rows, 0.8, 16).collect()
    pairs = [tuple(sorted((r["members"][p], r["members"][q]), reverse=True)) for r in got for p, q in zip(r["p"], r["q"])]
    assert sorted(pairs) == [(a, b) for a in range(3001, 3004) for b in range(3000, a)] and not any(r["more"] for r in got)


def test_near_duplicates_have_simhashes(spark):
    """Tables and further bits are those that over half of the shingles' hashes have, and differ as the angle between the sets says."""
    r = random.Random(21)
    texts = [[f"w{r.randrange(10**6)}" for _ in range(n)] for n in (0, 1, 4, 5, 6, 12, 300, 700)]
    texts += [texts[-1] + [f"x{r.randrange(10**6)}" for _ in range(170)]]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "_k bigint, _t string")
    got = sorted(simhash.signatures(rows, 5).collect())
    sets = {x["_k"]: np.frombuffer(x["_s"], np.uint64).tolist() for x in simhash.shingle_sets(rows, 5).collect()}
    bits = simhash.TABLES * simhash.TABLE_BITS + simhash.PRINT_BITS
    steps = simhash.mixed(np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(simhash.BASE)).tolist()
    whole = []
    for x in got:
        hashes = [b"".join(int(simhash.mixed(np.array([(p + s) % 2**64], np.uint64))[0]).to_bytes(8, "little") for s in steps) for p in sets[x["_k"]]]
        ones = [sum(h[b // 8] >> (7 - b % 8) & 1 for h in hashes) for b in range(bits)]
        want = [2 * n > len(hashes) for n in ones]
        each, last = simhash.TABLE_BITS, simhash.TABLES * simhash.TABLE_BITS
        assert x["bands"] == [(t << each) + sum(want[t * each + j] << j for j in range(each)) for t in range(simhash.TABLES)]
        tail = np.packbits(np.array(want[last:])).tobytes()
        assert np.array([x["high"], x["low"]], np.int64).tobytes() == tail
        whole.append(np.array(want))
    apart = np.arccos(len(set(sets[7]) & set(sets[8])) / (len(sets[7]) * len(sets[8])) ** 0.5) / np.pi
    assert 0.13 < apart < 0.16 and abs((whole[7] != whole[8]).mean() - apart) < 0.04 and 0.45 < (whole[6] != whole[7]).mean() < 0.55


@pytest.mark.parametrize("size, most", [(1 << 18, 20_000), (40, 20_000), (30, 25)])
def test_rows_that_meet(spark, monkeypatch, size, most):
    """A row is passed on in a bucket if another one's further bits are close, whatever the pieces; one of a large bucket always."""
    monkeypatch.setattr(simhash, "MET_ROWS", size)
    monkeypatch.setattr(simhash, "MET_MOST", most)
    r = random.Random(size + most)
    rows = []
    for k in range(260):
        print_ = r.choice(rows)[1] if rows and r.random() < 0.5 else r.getrandbits(128)
        for _ in range(r.randint(0, 50)):
            print_ ^= 1 << r.randrange(128)
        rows.append((k, print_, [t << 12 | (0 if k % 3 == 0 else r.randrange(9)) for t in range(3)]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(k, 5, signed(p >> 64), signed(p & (1 << 64) - 1), keys) for k, p, keys in rows], "_k bigint, n int, high bigint, low bigint, bands array<bigint>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted((x["key"], x["_k"]) for x in simhash.met(table).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for key in {x for _, _, keys in rows for x in keys}:
        own = [(k, p) for k, p, keys in rows if key in keys]
        want |= {(key, k) for k, p in own if len(own) > most or any(j != k and (p ^ q).bit_count() <= simhash.APART for j, q in own)}
    assert got == sorted(want) and len(want) < 780


def joined(plan, key):
    """Rows that the joins by this key made, all in all."""
    name, below = plan.nodeName(), [plan.children().apply(i) for i in range(plan.children().size())]
    below += [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else []
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name and re.search(rf"Join \[{key}#", plan.simpleString(100)) else 0
    return own + sum(joined(x, key) for x in below)


def test_hubs_cost_a_row_each(spark, monkeypatch):
    """However many buckets the rows of a large group of near copies share, no more pairs with hubs are joined than it has rows."""
    made, plain = [], simhash.materialize

    def materialize(df, name):
        if name == "pairs":
            df.collect()
            made.append(joined(df._jdf.queryExecution().executedPlan(), "v"))
        return plain(df, name)

    monkeypatch.setattr(simhash, "materialize", materialize)
    r = random.Random(31)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in r.sample(range(150), 2):
            w[at] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    kept, want, near = kept_and_wanted(spark, texts)
    assert kept == want and len(near) > 100
    assert 0 < made[0] <= len(texts)


@pytest.mark.parametrize("size, most", [(1 << 14, 4096), (50, 40)])
def test_buckets_lose_no_pair(spark, monkeypatch, size, most):
    """Buckets without the rows that have no pair there give the same pairs, each once, as whole ones; rows of a large bucket stay."""
    monkeypatch.setattr(simhash, "ALIKE_ROWS", size)
    monkeypatch.setattr(simhash, "ALIKE_MOST", most)
    r = random.Random(32)
    texts = ["", " ", "a b"]
    for _ in range(4):
        base = [f"w{r.randrange(10**6)}" for _ in range(100)]
        for _ in range(20):
            w = list(base)
            for at in r.sample(range(100), r.randint(1, 8)):
                w[at] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(w[: r.randint(70, 100)]))
    rows = simhash.materialize(simhash.signatures(spark.createDataFrame(list(enumerate(texts)), "_k bigint, _t string"), 5), "signatures")
    spread = rows.select(F.explode("bands").alias("key"), "_k", "n", "high", "low")
    left = simhash.materialize(simhash.alike(spread, rows, 0.8), "buckets")
    none = spark.createDataFrame([], "u bigint, root bigint")
    pairs = lambda buckets: sorted(tuple(sorted((x["members"][p], x["members"][q]))) for x in simhash.open_pairs(buckets, none, rows, 0.8, 1000).collect() for p, q in zip(x["p"], x["q"]))
    whole, got = pairs(spread), pairs(left)
    # Pairs whose sizes are too far apart go with no row's sketch.
    n = {x["_k"]: x["n"] for x in rows.collect()}
    sized = lambda found: [(a, b) for a, b in found if min(n[a], n[b]) >= 0.8 * max(n[a], n[b])]
    assert sized(got) == sized(whole) and len(set(got)) == len(got) > 100 and (0, 1) in got
    assert left.count() < spread.count() / 2
