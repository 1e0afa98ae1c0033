import hashlib
import random
import re

import pytest
from conftest import DATA, same_rows
from sparkloom.llm import exact_dedup, queries, source_mix

SCHEMA = "doc_id bigint, text string, source string, _n int, part string, size string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name]))


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def rows_with_extras(rows):
    return [(*r, 1, "x", "y") for r in rows]


CASES = [
    [],
    [(1, None, "a"), (2, "", "a"), (None, "", None), (3, " ", "b"), (4, "\t\n ", "b")],
    [(None, "t", None), (None, "t", None), (5, "t", "a"), (5, "t", "a")],
    [(i, "a  b" if i % 2 else "a\nb", "a") for i in range(9)] + [(100, "x " * 200_000, "c"), (101, "x  " * 200_000, "c")],
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("hot", [2, 10_000])
def test_exact_cases(spark, monkeypatch, case, hot):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    df = spark.createDataFrame(rows_with_extras(CASES[case]), SCHEMA)
    got = exact_dedup.content_sort_dedup(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(CASES[case])


def test_exact_hot_group_and_carry(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 20)
    rows = [(i, "same  text" if i % 3 == 0 else f"t {i % 40}", "s") for i in range(300)]
    df = spark.createDataFrame(rows_with_extras(rows), SCHEMA)
    got = exact_dedup.content_sort_dedup(df, carry=tuple(df.columns))
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.collect()), key=repr) == brute_exact(rows)
    assert sorted((r["doc_id"], r["text"], r["source"], r["_n"], r["part"], r["size"]) for r in got.collect()) == sorted(rows_with_extras(rows)[i][:3] + (1, "x", "y") for i in range(300))


def brute_mix(rows, weights=(3, 1, 2), share=1.5, repeats=2):
    sizes = {}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, held = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in held]
        level = (budget - sum(held.values())) / sum(w[s] for s in open_) if open_ else 0
        above = [s for s in open_ if level * w[s] >= repeats * sizes[s]]
        if not above:
            break
        held |= {s: float(repeats * sizes[s]) for s in above}
    target = {s: held.get(s, level * w[s]) for s in order}
    queue, taken = [], {}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = {s: sorted((md5(f"mix{'null' if i is None else i}:{'null' if t is None else md5(t)}"), count(t), i is None, i or 0) for i, t, x in rows if x == s) for s in order}
    for k, s in enumerate(order):
        at = 0
        for place, (_, n, *_) in enumerate(docs[s]):
            at += n
            queue += [((at + e * sizes[s]) / target[s], k, e, place, n) for e in range(repeats) if n and target[s]]
    left = int(budget)
    for _, k, _, place, n in sorted(queue):
        got = min(n, left)
        taken[k, place] = taken.get((k, place), 0) + got
        left -= got
    return sorted(((None if null else i, s, n, sizes[s], round(target[s], 6), taken.get((k, place), 0)) for k, s in enumerate(order) for place, (_, n, null, i) in enumerate(docs[s])), key=repr)


def test_mix_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice((0, 1, 5, 90)))), r.choice(["b", "a", None, "é", "Z", "hot", "hot", "hot"])) for i in range(400)] + [(500, None, "a"), (501, "x\ty\x0bz", "only")]
    df = spark.createDataFrame(rows_with_extras(rows), SCHEMA).repartition(3)
    got = source_mix.mix_sources(df)
    assert sorted(((x["doc_id"], x["source"], x["size"], x["source_size"], round(x["target"], 6), x["taken"]) for x in got.collect()), key=repr) == brute_mix(rows)
    # Each source is at its target but for a document.
    assert got.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).where("abs(`sum(taken)` - `max(target)`) > `max(size)`").count() == 0
    assert got.agg({"taken": "sum"}).first()[0] == int(1.5 * got.agg({"size": "sum"}).first()[0])
    again = source_mix.mix_sources(df.repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, "a b", "a"), (2, "a b", "a"), (None, "c", "b"), (None, "c", "b")]])
def test_mix_cases(spark, rows):
    got = source_mix.mix_sources(spark.createDataFrame(rows_with_extras(rows), SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) <= 1.5 * sum(r["size"] for r in got)


def test_mix_is_cut_by_the_queue(spark, monkeypatch):
    """Without the cut of the sorted queue all copies are taken, and over the budget."""
    df = spark.createDataFrame(rows_with_extras([(i, "a b c", "s" if i % 2 else "t") for i in range(40)]), SCHEMA)
    assert sum(r["taken"] for r in source_mix.mix_sources(df).collect()) == 180
    monkeypatch.setattr(source_mix, "served_until", lambda copies, budget: None)
    assert sum(r["taken"] for r in source_mix.mix_sources(df).collect()) == 240


def test_mix_spreads_rows_without_an_id(spark):
    """Rows that share id, text and source are dealt over the partitions, and all of the source's words are counted."""
    df = spark.range(3000).selectExpr("cast(null as bigint) AS doc_id", "'w w' AS text", "if(id % 10 < 7, 'hot', 'cold') AS source")
    got = source_mix.mix_sources(df)
    assert got.agg({"taken": "sum"}).first()[0] == 9000 and {tuple(r) for r in got.select("source", "source_size").distinct().collect()} == {("hot", 4200), ("cold", 1800)}
    assert got.where("taken > 2 * size OR taken < 0").count() == 0
    long = source_mix.mix_sources(spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "w", "a")], "doc_id bigint, text string, source string")).collect()
    assert sorted((r["doc_id"], r["size"]) for r in long) == [(1, 300_000), (2, 1)]
