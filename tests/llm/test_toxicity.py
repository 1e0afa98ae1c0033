import random
import re
import zlib

import numpy as np
import pytest
from sparkloom.llm import toxicity as tx

SCHEMA = "doc_id bigint, text string, lang string, score int, _t string"


def corpus(n=500, seed=0):
    r = random.Random(seed)
    syllables = ["la", "to", "mi", "ren", "sha", "ing", "é"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(3, 150))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(("Grobbel", "grobnik", "SNARP", "grob" + word())))
        docs.append((i, " ".join(w), "x", 0, "y"))
        labels.append((i, int(toxic)))
    return docs, labels


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(9001, None, None, 0, ""), (9002, "", None, 0, ""), (None, "la to mi", None, 0, ""), (9003, "la to " * 30_000 + "grobbel grobnik snarp", None, 0, ""), (9004, "la to " * 30_000, None, 0, "")]
    got = tx.score_toxicity(spark.createDataFrame(docs + extra, SCHEMA), spark.createDataFrame(labels + [(None, 1), (4, None), (5, labels[5][1])], "doc_id bigint, toxic int")).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(r["held_out"] == is_held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([(s >= 0.7) == t for s, t in held]) > 0.95
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[9003] > 0.7 > by_id[9004] and by_id[9001] == by_id[9002]


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame(docs, SCHEMA)
    other = [(i, 1 - y if is_held(i) else y) for i, y in labels]
    a, b = (sorted(map(tuple, tx.score_toxicity(df, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect())) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(0, None)]])
def test_without_labels(spark, labels):
    docs, _ = corpus(12)
    got = tx.score_toxicity(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == 12 and len({round(r["score"], 6) for r in got}) == 1 and got[0]["score"] < 0.7
    assert tx.score_toxicity(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect() == []


def test_windows_cover_all_words_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        words = tx.Words([b"", b"a b " * 3, b"w " * n])
        text, start, length = words.windows()
        own = sorted((s, s + k) for t, s, k in zip(text, start, length) if t == 2)
        covered = {x for a, b in own for x in range(a, b)}
        assert covered == set(range(words.first[2], words.first[3]))
        assert all(a[1] - b[0] >= tx.WINDOW - tx.STRIDE for a, b in zip(own, own[1:]))
        assert 0 not in text


def test_gradients_against_differences():
    r = np.random.default_rng(0)
    texts = [b"la grobbel to mi", b"to la", b"mi mi ren grob la sha ing"]
    words = tx.Words(texts)
    net = tx.train(texts, np.array([1, 0, 1]), seed=1)
    net = {k: v.astype(np.float64) + r.normal(size=v.shape) * 0.1 for k, v in net.items()}
    _, start, length = words.windows()
    label = np.array([1.0, 0, 1])

    def loss(net):
        _, _, _, z = tx.window_logits(words, net)
        return np.mean(np.logaddexp(0, z.astype(float)) - label * z)

    grads, sparse = tx.gradients(words, net, start, length, label)
    for k in ("wf", "ub", "cf", "bb", "att", "att_b", "att_v", "out", "out_b"):
        at = tuple(r.integers(0, s) for s in net[k].shape)
        up, down = ({**net, k: net[k].copy()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(grads[k][at], abs=2e-3)
    row, g = sparse["word"]
    up, down = ({**net, "word": net["word"].copy()} for _ in range(2))
    up["word"][row[0], 1] += 1e-2
    down["word"][row[0], 1] -= 1e-2
    assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(g[row == row[0], 1].sum(), abs=2e-3)


def plain_score(text, net):
    """The score by its definition: a word, a gram, a window and a step at a time, all in double precision."""
    net = {k: v.astype(float) for k, v in net.items()}
    s = lambda x: 1 / (1 + np.exp(-x))
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    rows = []
    for w in words:
        line, low = [2, *w, 3], np.full(tx.CHAR_DIM, -9.0)
        for k in tx.GRAMS:
            for i in range(len(line) - k + 1):
                h = k
                for b in line[i : i + k]:
                    h = (h * tx.BASE + b) % 2**64
                low = np.maximum(low, net["char"][int(tx.mixed(np.array([h], np.uint64))[0]) % tx.BUCKETS])
        word = tx.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        rows.append(np.concatenate((net["word"][int(word) % tx.BUCKETS], low)))
    n, best = tx.HIDDEN, None
    starts = range(0, len(words) - tx.WINDOW, tx.STRIDE) if len(words) > tx.WINDOW else ()
    for at in {*starts, max(len(words) - tx.WINDOW, 0)} if words else ():
        window, states = rows[at : at + tx.WINDOW], {}
        for d, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            h = np.zeros(n)
            for t in order:
                g, q = window[t] @ net[f"w{d}"] + net[f"b{d}"], h @ net[f"u{d}"]
                z, r = s(g[:n] + q[:n]), s(g[n : 2 * n] + q[n : 2 * n])
                h = (1 - z) * np.tanh(g[2 * n :] + r * (q[2 * n :] + net[f"c{d}"])) + z * h
                states[d, t] = h
        both = np.array([np.concatenate((states["f", t], states["b", t])) for t in range(len(window))])
        a = np.exp(np.tanh(both @ net["att"] + net["att_b"]) @ net["att_v"])
        logit = a @ both / a.sum() @ net["out"] + net["out_b"][0]
        best = logit if best is None else max(best, logit)
    return s(net["out_b"][0] if best is None else best)


def test_scores_against_brute_force(monkeypatch):
    """Slices and chunks far smaller than a text change nothing."""
    docs, labels = corpus(60, seed=4)
    texts = [t.encode() for _, t, *_ in docs]
    net = tx.train(texts[:40], np.array([y for _, y in labels[:40]]))
    some = texts[40:] + [b"", b" \t", b"a", "É ß".encode(), b"w " * 32, b"w " * 33, (b"la Grobbel mi " * 40)]
    want = [plain_score(t, net) for t in some]
    assert max(want) - min(want) > 0.5
    assert tx.document_scores(some, net) == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(tx, "SLICE", 3)
    monkeypatch.setattr(tx, "CHUNK_BYTES", 200)
    assert tx.document_scores(some, net) == pytest.approx(want, abs=1e-4)
