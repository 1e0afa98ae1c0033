import hashlib
import random

import pytest
from sparkloom.llm import suffix_dedup as sd


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            seen.setdefault(t[k : k + length], []).append((d, k))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, k in places:
                gone[d].update(range(k, k + length))
    out = []
    for (i, _), t, g in zip(rows, texts, gone):
        runs = sum(1 for k in g if k - 1 not in g)
        out.append((i, len(t), len(g), runs, hashlib.sha256(bytes(b for k, b in enumerate(t) if k not in g)).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, length):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id bigint, text string, _k int, spans string").repartition(3)
    got = sd.remove_repeats(df, length).collect()
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=repr)


def made(seed, length):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abé \n") for _ in range(n))
    passages = [say(r.randint(length // 2, 3 * length)) for _ in range(5)]
    rows = []
    for i in range(40):
        parts = [say(r.randint(0, 2 * length)) for _ in range(3)]
        p = r.choice(passages)
        a, b = sorted(r.sample(range(len(p)), 2))
        rows.append((i, parts[0] + r.choice((p, p[a:b], p[: a + 1] + "#" + p[a + 2 :])) + parts[1] + r.choice(passages)[a:] + parts[2]))
    rows += [(50, rows[0][1]), (51, rows[1][1]), (51, rows[1][1]), (52, None), (53, ""), (None, rows[2][1][5:]), (None, None), (54, "aa" * 3 * length), (55, "ab" * length), (56, "x" * length), (57, "x" * length), (58, "y" * (length + 1))]
    return rows


@pytest.mark.parametrize("seed,length", [(0, 40), (1, 40), (2, 25), (3, 100)])
def test_against_brute_force(spark, seed, length):
    rows = made(seed, length)
    assert run(spark, rows, length) == brute(rows, length)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 300)
    rows = made(7, 40)
    assert run(spark, rows, 40) == brute(rows, 40)


def test_empty_table(spark):
    assert run(spark, [], 40) == []


def test_levels_merge_geometrically(spark):
    family = sd.SuffixFamily(spark)
    sizes = []
    for b in range(5):
        matched = family.add(spark.range(b * 10, b * 10 + 15).selectExpr("id % 7 as head", "id as key"))
        assert sorted(r[0] for r in matched.collect()) == ([] if b == 0 else list(range(b * 10, b * 10 + 5)))
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1]]
    for _, files in family.levels:
        rows = [r for p in sorted(files) for r in spark.read.parquet(f"{family.folder}/{files[p]}").collect()]
        assert [r["head"] for r in rows] == sorted(r["head"] for r in rows) and len({tuple(r) for r in rows}) == len(rows)


def test_a_stored_family_takes_another_batch(spark, tmp_path):
    """Opened again it knows what it had; what the batch repeats is found against all levels, and with itself."""
    r = random.Random(4)
    rows = [(r.getrandbits(63), r.getrandbits(63)) for _ in range(4000)] + [(5, k) for k in range(2000)]
    table = lambda some: spark.createDataFrame(some, "head bigint, key bigint")
    folder = f"file://{tmp_path}/family"
    seen = set()
    for b in range(6):
        some = r.sample(rows, 900)
        some += some[:20]
        got = sd.SuffixFamily(spark, folder).add(table(some))
        assert sorted(x[0] for x in got.collect()) == sorted({k for h, k in some if (h, k) in seen} | {k for _, k in some[:20]})
        seen |= set(some)
    assert [s for s, _ in sd.SuffixFamily(spark, folder).levels] == [4, 2]


def brute_shared(rows, passage):
    """Words of each row that stand in a run of `passage` words that a row with another id or text has too."""
    texts = [(t or "").lower().split() for _, t in rows]
    seen = {}
    for d, w in enumerate(texts):
        for k in range(len(w) - passage + 1):
            seen.setdefault(tuple(w[k : k + passage]), []).append((d, k))
    hit = [set() for _ in texts]
    for places in seen.values():
        if len({rows[d] for d, _ in places}) > 1:
            for d, k in places:
                hit[d].update(range(k, k + passage))
    return [len(h) for h in hit]


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages_against_brute_force(spark, seed):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(("Aa", "b", "cé", "D", "e", "\n")) for _ in range(n))
    passages = [say(r.randint(8, 30)) for _ in range(4)]
    rows = [(i, f"{say(r.randint(0, 25))} {r.choice(passages)} {say(r.randint(0, 25))} {r.choice(passages)[:20]}") for i in range(25)]
    rows += [(30, rows[0][1]), (31, (say(12) + " ") * 4), (32, None), (32, None), (33, say(200)), (33, say(200)), (34, rows[0][1][5:])]
    rows += [rows[3], rows[3], (35, "z " * 40), (36, "y " * 40), (37, "y " * 9)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 40, passage=10).collect()
    covered = sorted((x["doc_id"], x["n_bytes"], sum(s["end"] - s["start"] for s in x["shared"])) for x in got)
    assert covered == sorted((i, len((t or "").encode()), n) for (i, t), n in zip(rows, brute_shared(rows, 10)))
