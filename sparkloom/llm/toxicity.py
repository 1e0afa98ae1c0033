"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Inputs of a word are its own embedding and, from characters, the maximum over the
embeddings of its byte 3-, 4- and 5-grams with word borders; both are hashed
tables. Two GRUs read a window of words in either direction, attention pools their
states, and the window's logit is linear in the pool. A document is cut into
windows of WINDOW words, each STRIDE after the one before and the last at its end,
and scores as its highest window; a text without words scores as an empty window.

The network is trained in numpy, in one task, from at most train_docs labelled
texts of at most train_bytes bytes each, those with the smallest hash of their id.
Tables start from the document frequencies of words and grams among those texts:
the lower bound of their log odds. A document's label is taught to its highest
window, and of a clean document to its CLEAN_WINDOWS highest, found anew in each
round. Scoring is per row, in vectorised chunks, and
each distinct word of a chunk is embedded once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_arrow
from sparkloom.llm.decontaminate import WORD_BYTE, chunks
from sparkloom.llm.rolling import BASE, mixed, runs, word_hashes

TRAIN_DOCS, TRAIN_BYTES = 4000, 16 << 10
WINDOW, STRIDE = 32, 8
BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 1 << 16, 4, 4, 16, 8
GRAMS = (3, 4, 5)
CHUNK_BYTES = 1 << 20
#: Windows that the network reads at once: their states take 8 MB, so that two workers of an executor stay small beside its heap.
SLICE = 1024
BATCH, ROUNDS, STEPS, RATE = 64, 8, 1000, 0.01
#: Windows that a clean text is taught by in each round, for all of theirs are clean; a toxic text is by one.
CLEAN_WINDOWS = 3


class Words:
    """The words of some texts: distinct ones, their rows in the tables, and where each text's words begin."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"\0".join(texts).lower()
        buf = np.frombuffer(joined, np.uint8)
        start, end = runs(WORD_BYTE[buf])
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
        self.first = np.concatenate(([0], np.searchsorted(start, ends)))
        hashes = word_hashes(buf, start, end)
        distinct, at, self.of = np.unique(hashes, return_index=True, return_inverse=True)
        self.row = (distinct % np.uint64(BUCKETS)).astype(np.int64)
        # The distinct words in a row, each between borders.
        size = end[at] - start[at] + 2
        self.at = np.concatenate(([0], np.cumsum(size)))
        inner = np.repeat(start[at] - 1 - self.at[:-1], size) + np.arange(self.at[-1])
        self.line = buf[np.clip(inner, 0, max(len(buf) - 1, 0))].astype(np.uint64) if len(buf) else np.zeros(0, np.uint64)
        self.line[self.at[:-1]] = 2
        self.line[self.at[1:] - 1] = 3

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each gram length: the word and the table row of each gram, words in order."""
        word = np.repeat(np.arange(len(self.row)), np.diff(self.at))
        for k in GRAMS:
            n = len(self.line) - k + 1
            if n <= 0:
                continue
            inside = word[:n] == word[k - 1 :]
            h = np.full(n, k, np.uint64)
            for j in range(k):
                h = h * np.uint64(BASE) + self.line[j : n + j]
            yield word[:n][inside], (mixed(h[inside]) % np.uint64(BUCKETS)).astype(np.int64)

    def inputs(self, net: dict[str, np.ndarray]) -> np.ndarray:
        """An input row for each distinct word."""
        low = np.full((len(self.row), CHAR_DIM), -9.0, np.float32)
        for word, row in self.grams():
            if len(word):
                edge = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                own = word[edge]
                low[own] = np.maximum(low[own], np.maximum.reduceat(net["char"][row], edge, axis=0))
        return np.concatenate((net["word"][self.row], low), axis=1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of each window; texts without words have none."""
        size = np.diff(self.first)
        count = np.where(size > WINDOW, -(-(size - WINDOW) // STRIDE) + 1, (size > 0).astype(int))
        text = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size[text], WINDOW)
        return text, self.first[text] + np.minimum(nth * STRIDE, size[text] - length), length


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def read(gates: list[np.ndarray], u: np.ndarray, bias: np.ndarray) -> list[np.ndarray]:
    """States of a GRU after each step; gates: the input's part of each step, (windows, 3 HIDDEN)."""
    n = HIDDEN
    h = np.zeros((len(gates[0]), n), np.float32)
    out = []
    for g in gates:
        q = h @ u
        zr = sigmoid(g[:, : 2 * n] + q[:, : 2 * n])
        new = np.tanh(g[:, 2 * n :] + zr[:, n:] * (q[:, 2 * n :] + bias))
        h = new + zr[:, :n] * (h - new)
        out.append(h)
    return out


def pooled_logits(states: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    """states: (steps, windows, 2 HIDDEN)."""
    s = np.tanh(states @ net["att"] + net["att_b"]) @ net["att_v"]
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    return np.einsum("tw,twh->wh", a, states) @ net["out"] + net["out_b"][0]


def window_logits(words: Words, net: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows as from Words.windows(), and their logits."""
    text, start, length = words.windows()
    logits = np.zeros(len(text), np.float32)
    if len(text):
        x = words.inputs(net)
        parts = [(x @ net[f"w{d}"] + net[f"b{d}"]).astype(np.float32) for d in "fb"]
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            for some in (own[i : i + SLICE] for i in range(0, len(own), SLICE)):
                of = [words.of[start[some] + t] for t in range(size)]
                ahead = read([parts[0][o] for o in of], net["uf"], net["cf"])
                back = read([parts[1][o] for o in reversed(of)], net["ub"], net["cb"])
                logits[some] = pooled_logits(np.concatenate((np.stack(ahead), np.stack(back[::-1])), axis=2), net)
    return text, start, length, logits


def document_scores(texts: list[bytes], net: dict[str, np.ndarray]) -> np.ndarray:
    out = np.full(len(texts), net["out_b"][0], np.float32)
    for begin, end in chunks(texts, CHUNK_BYTES):
        text, _, _, logits = window_logits(Words(texts[begin:end]), net)
        best = np.full(end - begin, -np.inf, np.float32)
        np.maximum.at(best, text, logits)
        out[begin:end] = np.where(np.isinf(best), out[begin:end], best)
    return 1.0 / (1.0 + np.exp(-out.astype(np.float64)))


def bound(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Lower bound of the log odds of what stands in so many toxic and clean texts, if above zero; else the upper, if below."""
    t, c = toxic + 0.5, clean + 0.5
    odds = np.log(t / (n_toxic + 1)) - np.log(c / (n_clean + 1))
    wide = 2 * np.sqrt(1 / t + 1 / c)
    return np.where(odds > 0, np.maximum(odds - wide, 0), np.minimum(odds + wide, 0)) / 3


def train(texts: list[bytes], label: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """The network's parameters. Without texts of both labels, all scores are one and the same: the share of toxic ones, smoothed."""
    r = np.random.default_rng(seed)
    make = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    dim = WORD_DIM + CHAR_DIM
    net = {"word": np.zeros((BUCKETS, WORD_DIM), np.float32), "char": np.zeros((BUCKETS, CHAR_DIM), np.float32)}
    for d in "fb":
        net |= {f"w{d}": make(dim, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": make(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(HIDDEN, np.float32)}
    net |= {"att": make(2 * HIDDEN, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": make(ATTENTION), "out": make(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
    n_toxic = int(label.sum())
    n_clean = len(label) - n_toxic
    net["out_b"][0] = np.log((n_toxic + 0.5) / (n_clean + 4.5))
    if not n_toxic or not n_clean:
        net["out"][:] = 0
        return net
    words = Words(texts)
    of_text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    # In how many toxic and clean texts each table row stands, a few texts at a time.
    seen = {"word": np.zeros((2, BUCKETS)), "char": np.zeros((2, BUCKETS))}
    for i in range(0, len(texts), 64):
        part = slice(words.first[i], words.first[min(i + 64, len(texts))])
        if part.start == part.stop:
            continue
        own, at = np.unique(words.of[part], return_inverse=True)
        sub = Subset(words, own)
        pair = np.unique(of_text[part] * len(own) + at)
        doc, word = pair // len(own), pair % len(own)
        lo = np.searchsorted(sub.word, word)
        n = np.searchsorted(sub.word, word, "right") - lo
        spread = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for name, of, row in (("word", doc, words.row[own][word]), ("char", np.repeat(doc, n), sub.row[spread])):
            once = np.unique(of * BUCKETS + row)
            np.add.at(seen[name], (label[once // BUCKETS], once % BUCKETS), 1)
    for name, (c, t) in seen.items():
        known = t + c >= 2
        net[name][:, 0] = np.where(known, bound(t, c, n_toxic, n_clean), 0)
        net[name][:, 1:] = np.where(known[:, None], r.normal(size=(BUCKETS, net[name].shape[1] - 1)) * 0.1, 0)
    dense = [k for k in net if k not in ("word", "char")]
    m, v = {k: np.zeros_like(net[k]) for k in dense}, {k: np.zeros_like(net[k]) for k in dense}
    square = {k: np.full(BUCKETS, 1e-2, np.float32) for k in ("word", "char")}
    text, start, length = words.windows()
    has = np.unique(text)
    first = words.inputs(net)
    signal = np.maximum(first[:, 0], first[:, WORD_DIM])
    high = np.array([signal[words.of[a : a + n]].max() for a, n in zip(start, length)])
    del first, signal
    step, rounds = 0, 0
    steps = max(STEPS, ROUNDS * -(-len(has) // BATCH))
    while step < steps:
        if rounds:
            high = window_logits(words, net)[3]
        order = np.lexsort((-high, text))
        nth = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        picked = order[nth < np.where(label[text[order]] == 1, 1, CLEAN_WINDOWS)]
        for _ in range(max(1, -(-steps // ROUNDS // max(1, -(-len(picked) // BATCH))))):
            r.shuffle(picked)
            for i in range(0, len(picked), BATCH):
                some = picked[i : i + BATCH]
                step += 1
                grads, sparse = gradients(words, net, start[some], length[some], label[text[some]].astype(np.float32))
                for k in dense:
                    g = grads[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    net[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                for k, (row, g) in sparse.items():
                    rows, back = np.unique(row, return_inverse=True)
                    total = np.zeros((len(rows), g.shape[1]), np.float32)
                    np.add.at(total, back, g)
                    total *= np.any(net[k][rows] != 0, axis=1)[:, None]
                    square[k][rows] += (total**2).mean(axis=1)
                    net[k][rows] -= 0.02 * total / np.sqrt(square[k][rows])[:, None]
        rounds += 1
    return net


def gradients(words: Words, net: dict[str, np.ndarray], start: np.ndarray, length: np.ndarray, label: np.ndarray):
    """Of the mean cross entropy of some windows, by backpropagation through time; and of the table rows, by table."""
    n, steps = HIDDEN, int(length.max())
    mask = (np.arange(steps)[:, None] < length).astype(np.float32)
    ids = words.of[np.minimum(start + np.arange(steps)[:, None], start + length - 1)]
    own, back = np.unique(ids, return_inverse=True)
    back = back.reshape(ids.shape)
    # The inputs of these words, and which gram gave each maximum.
    sub = Subset(words, own)
    low, which = sub.pooled(net["char"])
    x = np.concatenate((net["word"][words.row[own]], low), axis=1)
    xs = x[back]
    grads = {k: np.zeros_like(v) for k, v in net.items() if k not in ("word", "char")}
    dx = np.zeros_like(xs)
    tapes, states = {}, {}
    for d, turn in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((len(start), n), np.float32)
        tape, out = [], np.zeros((steps, len(start), n), np.float32)
        gates = xs @ net[f"w{d}"] + net[f"b{d}"]
        for t in turn:
            g, q = gates[t], h @ net[f"u{d}"]
            z, rr = sigmoid(g[:, :n] + q[:, :n]), sigmoid(g[:, n : 2 * n] + q[:, n : 2 * n])
            inner = q[:, 2 * n :] + net[f"c{d}"]
            new = np.tanh(g[:, 2 * n :] + rr * inner)
            tape.append((t, h, z, rr, inner, new))
            h = mask[t][:, None] * (new + z * (h - new)) + (1 - mask[t][:, None]) * h
            out[t] = h
        tapes[d], states[d] = tape, out
    s = np.concatenate((states["f"], states["b"]), axis=2)
    act = np.tanh(s @ net["att"] + net["att_b"])
    e = act @ net["att_v"] + (mask - 1) * 1e4
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pool = np.einsum("tw,twh->wh", a, s)
    p = 1 / (1 + np.exp(-(pool @ net["out"] + net["out_b"][0])))
    dlogit = ((p - label) / len(label)).astype(np.float32)
    grads["out"], grads["out_b"] = pool.T @ dlogit, np.array([dlogit.sum()], np.float32)
    dpool = dlogit[:, None] * net["out"]
    ds = a[:, :, None] * dpool
    da = np.einsum("twh,wh->tw", s, dpool)
    de = a * (da - (a * da).sum(axis=0))
    grads["att_v"] = np.einsum("twk,tw->k", act, de)
    dact = de[:, :, None] * net["att_v"] * (1 - act**2)
    grads["att"], grads["att_b"] = np.einsum("twh,twk->hk", s, dact), dact.sum(axis=(0, 1))
    ds = ds + dact @ net["att"].T
    for d, part in (("f", ds[:, :, :n]), ("b", ds[:, :, n:])):
        dh = np.zeros((len(start), n), np.float32)
        u = net[f"u{d}"]
        for t, h, z, rr, inner, new in reversed(tapes[d]):
            dh = dh + part[t]
            keep, dh = (1 - mask[t][:, None]) * dh, mask[t][:, None] * dh
            dn = dh * (1 - z) * (1 - new**2)
            dz, dr = dh * (h - new) * z * (1 - z), dn * inner * rr * (1 - rr)
            dg = np.concatenate((dz, dr, dn), axis=1)
            dq = np.concatenate((dz, dr, dn * rr), axis=1)
            grads[f"u{d}"] += h.T @ dq
            grads[f"c{d}"] += (dn * rr).sum(axis=0)
            grads[f"w{d}"] += xs[t].T @ dg
            grads[f"b{d}"] += dg.sum(axis=0)
            dx[t] += dg @ net[f"w{d}"].T
            dh = keep + dh * z + dq @ u.T
    by_word = np.zeros_like(x)
    np.add.at(by_word, back.ravel(), dx.reshape(-1, dx.shape[2]))
    rows, g = [], []
    for j in range(CHAR_DIM):
        part = np.zeros((len(own), CHAR_DIM), np.float32)
        part[:, j] = by_word[:, WORD_DIM + j]
        rows.append(which[:, j])
        g.append(part)
    return grads, {"word": (words.row[own], by_word[:, :WORD_DIM]), "char": (np.concatenate(rows), np.concatenate(g))}


class Subset:
    """Some distinct words of a Words, with their grams."""

    def __init__(self, words: Words, own: np.ndarray) -> None:
        size = np.diff(words.at)[own]
        at = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(words.at[own] - at[:-1], size) + np.arange(at[-1])
        sub = Words.__new__(Words)
        sub.row, sub.at, sub.line = words.row[own], at, words.line[place]
        got = [np.concatenate(x) for x in zip(*sub.grams())]
        order = np.argsort(got[0], kind="stable")
        self.word, self.row = got[0][order], got[1][order]

    def pooled(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word and dimension, the largest value over its grams, and the table row that has it."""
        v = table[self.row]
        edge = np.flatnonzero(np.concatenate(([True], self.word[1:] != self.word[:-1])))
        top = np.maximum.reduceat(v, edge, axis=0)
        n = np.diff(np.concatenate((edge, [len(v)])))
        is_top = v == np.repeat(top, n, axis=0)
        place = np.where(is_top, np.arange(len(v))[:, None], len(v))
        return top, self.row[np.minimum.reduceat(place, edge, axis=0)]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    fold_of: tuple[int, int] = (3, 1),
    train_docs: int = TRAIN_DOCS,
    train_bytes: int = TRAIN_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    label_id_col: str = "doc_id",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: the id, held_out, score, and the columns named in carry.

    Rows whose crc32 of the id as text, modulo fold_of[0], is fold_of[1] are held
    out: their labels are never read. A null id has the crc of the empty text and
    no label. A null text is empty. Labels may be null or missing (unlabelled) or
    repeated (the largest counts). Without usable labels, as with an empty table
    of them, all scores are equal; without documents there are no rows. Texts of
    any length are scored whole, but labelled ones over train_bytes teach nothing.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    held = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(fold_of[0])) == fold_of[1]
    known = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).select(F.col(label_id_col).alias("_l"), F.col(label_col).cast("int").alias("_y")).where(~held(F.col("_l")))
    sample = known.groupBy("_l").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_l"), "_l").limit(train_docs)
    # At most train_docs labels are broadcast, and train_docs texts of train_bytes come to one task.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.octet_length("_t") <= train_bytes)
    rows = texts.join(F.broadcast(sample), F.col("_id") == F.col("_l")).orderBy(F.xxhash64("_id"), "_id", "_t").limit(train_docs).select("_t", "_y")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in batch.to_pylist()]
        net = train([r["_t"].encode() for r in got], np.array([min(1, max(0, r["_y"])) for r in got], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    # One task, or none for no rows; the parameters are some 2 MB.
    got = rows.coalesce(1).mapInArrow(fit, "net binary").collect()
    net = pickle.loads(got[0][0]) if got else train([], np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parameters = shared.value
        for batch in batches:
            got = document_scores([(t or "").encode() for t in batch.column("_t").to_pylist()], parameters)
            yield pa.RecordBatch.from_arrays([c for c, f in zip(batch.columns, batch.schema) if f.name != "_t" or "_t" in kept] + [pa.array(got, pa.float64())], names=[f.name for f in batch.schema if f.name != "_t" or "_t" in kept] + ["_s"])

    kept = {"_t"} if text_col in carry else set()
    others = [c for c in carry if c != text_col]
    rows_in = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in others])
    kind = {f.name: f.dataType.simpleString() for f in rows_in.schema}
    schema = ", ".join(f"`{c}` {k}" for c, k in kind.items() if c != "_t" or kept) + ", _s double"
    scored = rows_in.mapInArrow(run, schema)
    return scored.select(F.col("_id").alias(id_col), held(F.col("_id")).alias("held_out"), F.col("_s").alias("score"), *[F.col("_t" if c == text_col else f"_c_{c}").alias(c) for c in carry if c != id_col])
