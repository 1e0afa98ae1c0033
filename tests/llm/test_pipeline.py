import random
import re
import zlib

import corpus_pipeline
import numpy as np
from conftest import DATA
from pyspark.sql import functions as F
from sparkloom.llm import toxicity as tx
from test_decontaminate import brute as brute_hits
from test_exact_mix import brute_mix
from test_simhash import components_of, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def written(spark, folder, docs, labels, items):
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def made(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("la", "to", "mi", "ren", "sha", "ing")) for _ in range(r.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(25))) for k in range(3)]
    docs, labels = [], []
    for i in range(260):
        w = [word() for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.2
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(("grobbel", "snarp", "grobnik")))
        docs.append((i, " ".join(w), r.choice(("s0", "s0", "s1", None))))
        labels.append((i, int(toxic)))
    for i in range(260, 290):
        t = docs[r.randrange(200)][1]
        kind = i % 3
        docs.append((i, t.replace(" ", "\n", 3) if kind == 0 else t + " " + word() if kind == 1 else t + " " + items[i % 3][1], "s1"))
    return docs + [(400, None, "s1"), (401, "", None)], labels, items


def test_against_brute_force(spark, tmp_path):
    docs, labels, items = made()
    written(spark, tmp_path, docs, labels, items)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)

    train = [(t, y) for (i, t, _), (_, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 3 != 1]
    by_hash = {r["doc_id"]: r["h"] for r in spark.range(500).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).collect()}
    order = sorted((by_hash[i], t, y) for (i, t, _), (_, y) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 3 != 1)
    assert len(order) == len(train)
    net = tx.train([t.encode() for _, t, _ in order], np.array([y for _, _, y in order]))
    score = tx.document_scores([(t or "").encode() for _, t, _ in docs], net)
    left = [d for d, s in zip(docs, score) if s < corpus_pipeline.TOXIC]
    truth = dict(labels)
    assert sum(truth.get(d[0], 0) for d in left) <= 3 and sum(1 - truth[i] for i in truth) - 3 <= sum(1 for d in left if d[0] < 260)

    seen, unique = set(), []
    for d in sorted(left, key=lambda d: d[0]):
        if (t := re.sub(r"[\x20\x09-\x0D]+", " ", d[1] or "")) not in seen:
            seen.add(t)
            unique.append(d)
    sets = [shingles(d[1]) for d in unique]
    like = lambda a, b: not (a or b) or len(a & b) >= 0.8 * len(a | b) > 0
    root = components_of(len(unique), [(a, b) for a in range(len(unique)) for b in range(a) if like(sets[a], sets[b])])
    distinct = [unique[k] for k in sorted(set(root))]
    hit = {h[0] for h in brute_hits([d[:2] for d in distinct], items) if h[2]}
    clean = [d for d in distinct if d[0] not in hit]
    assert len(hit) >= 5 and len(distinct) < len(unique) < len(left) < len(docs)
    assert got == sorted(((i, s, n, z, t, k) for i, s, n, z, t, k in ((i, s, n, z, t, k) for i, s, n, z, t, k in brute_mix(clean)) if k), key=repr) or [(g[0], g[1], g[2], g[3], round(g[4], 6), g[5]) for g in got] == [x for x in brute_mix(clean) if x[5]]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).schema == docs.schema
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).collect() == []


def test_empty_documents(spark, tmp_path):
    written(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = ["score", "kept", "spans", "items", "_gone", "_k", "_id", "_t", "held_out", "n_words", "size", "taken", "sketch", "in_text"]
    more = docs.withColumns({c: F.lit(c) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, DATA)
        assert got.columns == more.columns
        assert sorted(map(tuple, got.select(docs.columns).collect())) == sorted(map(tuple, stage(spark, docs, DATA).collect()))
        assert got.select(*names).distinct().collect() == [tuple(names)]
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(str, last(spark, more, DATA).collect())) == sorted(map(str, last(spark, docs, DATA).collect()))
