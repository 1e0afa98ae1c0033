"""Benchmark decontamination by winnowing.

Texts become lower-cased words. Of each SPAN-GRAM+1 successive hashes of GRAM
words the smallest is kept, so any SPAN successive words that a document shares
with an item hold a kept hash in common. Kept hashes of documents are looked up
among those of the items; each hit is extended to the windows of SPAN words around
it, and those that an item has too count, with all their words. An item of fewer than SPAN words is a window as
a whole: for its length every gram of a document is kept (windows of one).

Items are a stated query set. They go to the executors in blocks of at most
block_bytes of text (one item, if that is longer), and every document meets every
block; neither texts nor fingerprints of documents are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Shared, bounded_arrow
from sparkloom.llm.rolling import BASE, gram_hashes, mixed, runs, window_min, word_hashes

SPAN, GRAM = 10, 5
#: Bytes of item texts that one broadcast holds, and bytes of documents hashed at once.
BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 2 << 20
WORD_BYTE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more entry than texts)."""
    joined = b"\0".join(texts).lower()
    buf = np.frombuffer(joined, np.uint8)
    start, end = runs(WORD_BYTE[buf])
    hashes = word_hashes(buf, start, end)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
    return hashes, np.concatenate(([0], np.searchsorted(start, ends)))


def kept_grams(words: np.ndarray, first: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that winnowing keeps; first as from words_of. No window crosses a text's end."""
    h = gram_hashes(words, gram)
    if not len(h):
        return np.zeros(0, int), h
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    w = span - gram + 1
    low = window_min(h, w)
    if not len(low):
        return np.zeros(0, int), h[:0]
    inside = text[: len(low)] == text[span - 1 :]
    # A gram is kept if it is the smallest of some window; windows that cross texts don't count.
    best = np.concatenate((np.zeros(w - 1, np.uint64), np.where(inside, low, np.uint64(0)), np.zeros(w - 1, np.uint64)))
    most = ~window_min(~best, w)
    place = np.flatnonzero((most == h) & (most > 0))
    return place, h[place]


class Block:
    """Fingerprints of some items, by window length: the kept grams, and the windows with their items."""

    def __init__(self, ids: list, texts: list[bytes], span: int, gram: int) -> None:
        self.ids, self.span = ids, span
        words, first = words_of(texts)
        size = np.diff(first)
        item = np.repeat(np.arange(len(texts)), size)
        self.sets: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for s in sorted({min(int(n), span) for n in size if n}):
            k = min(gram, s) if s == span else s
            own = size >= span if s == span else size == s
            place, kept = kept_grams(words, first, s, k)
            windows = gram_hashes(words, s)
            inside = item[: len(windows)] == item[s - 1 :]
            inside &= own[item[: len(windows)]]
            self.sets.append((s, k, np.unique(kept[own[item[place]]]), *distinct_pairs(windows[inside], item[: len(windows)][inside])))

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of some texts' words: the maximal runs of hit words (start, end, text), in words of the text; and text and item of each pair.

        A kept gram of a text that is one of an item's opens the windows around it;
        of these each is looked up whole, so the work is a text's words times the
        window's length, whatever repeats.
        """
        n = len(first) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        covered = np.zeros(len(words) + 1, np.int64)
        found: list[np.ndarray] = []
        for span, gram, kept, windows, items in self.sets:
            place, h = kept_grams(words, first, span, gram)
            at = place[member(kept, h)]
            if not len(at):
                continue
            start = np.unique((at[:, None] - np.arange(span - gram + 1)).ravel())
            start = start[(start >= 0) & (start + span <= len(words))]
            start = start[text[start] == text[start + span - 1]]
            whole = np.zeros(len(start), np.uint64)
            for j in range(span):
                whole = whole * np.uint64(BASE) + words[start + j]
            whole = mixed(whole)
            ok = member(windows, whole)
            start, whole = start[ok], whole[ok]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + span, -1)
            # Each window of a text once, with all of its items.
            of, whole = distinct_pairs(text[start], whole)
            lo, hi = np.searchsorted(windows, whole, "left"), np.searchsorted(windows, whole, "right")
            for i in range(0, len(of), 1 << 16):
                count = (hi - lo)[i : i + (1 << 16)]
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                which = items[np.repeat(lo[i : i + (1 << 16)], count) + nth]
                found.append(np.unique(np.repeat(of[i : i + (1 << 16)], count) * len(self.ids) + which))
        hit = np.cumsum(covered)[:-1] > 0
        # A run ends where its text does.
        edge = np.zeros(len(words) + 1, bool)
        edge[first[:-1]] = True
        begin = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1])))) if len(hit) else np.zeros(0, int)
        stop = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False])))) + 1 if len(hit) else begin
        of = text[begin] if len(begin) else begin
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return (begin - first[of], stop - first[of], of, *np.divmod(pairs, max(1, len(self.ids))))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs in order, each once."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def member(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of asked are in values, which are in order."""
    if not len(values):
        return np.zeros(len(asked), bool)
    return values[np.minimum(np.searchsorted(values, asked), len(values) - 1)] == asked


def chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes, or of one text."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _scan(block, every: bool, carry: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("_t").to_pylist()]
            sizes, spans, items = np.zeros(len(texts), np.int64), [[] for _ in texts], [set() for _ in texts]
            for begin, end in chunks(texts, CHUNK_BYTES):
                words, first = words_of(texts[begin:end])
                sizes[begin:end] = np.diff(first)
                a, e, of, text, item = (x.tolist() for x in index.hits(words, first))
                for i, j, k in zip(a, e, of):
                    spans[begin + k].append({"start": i, "end": j})
                for k, i in zip(text, item):
                    items[begin + k].add(index.ids[i])
            out = pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_th"), *(batch.column(c) for c in carry), pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([list(x) for x in items], pa.list_(pa.string()))],
                names=["_id", "_th", *carry, "n_words", "spans", "items"],
            )
            yield out if every else out.filter(pa.array([bool(x) for x in spans]))

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: the id, n_words, spans (array of start and end in words, in order; those of different blocks of items may overlap), items (array of the item ids, as strings), and the columns named in carry.

    A null text has no words, and neither has a null item, which no document can
    contain. An item without an id counts as "null". Items repeated under one id
    count once. A text may be of any length, and repeat itself or an item's words
    as often as it likes: the work is linear in its words. Other columns are not
    read, whatever their names; empty tables on either side give empty spans or
    no rows.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    others = [f"_c_{c}" for c in carry]
    scan_of = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    kinds = {f.name: f.dataType.simpleString() for f in scan_of.schema}
    found_columns = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    schema = f"_id {kinds['_id']}, _th bigint, {found_columns}"
    full = f"_id {kinds['_id']}, _th bigint, {''.join(f'`{c}` {kinds[c]}, ' for c in others)}{found_columns}"
    passes = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        block = Shared(spark, Block([r["i"] for r in rows], [r["t"].encode() for r in rows], span, gram))
        passes.append(scan_of.mapInArrow(_scan(block, True, tuple(others)), full) if blocks == 1 else scan_of.mapInArrow(_scan(block, False), schema))
    if blocks == 1:
        out = passes[0]
    else:
        # Rows of the same id and text have the same hits.
        none = Shared(spark, Block([], [], span, gram))
        every = scan_of.mapInArrow(_scan(none, True, tuple(others)), full).drop("spans", "items")
        found = passes[0]
        for p in passes[1:]:
            found = found.union(p)
        merged = found.groupBy(F.col("_id").alias("_i2"), F.col("_th").alias("_t2")).agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        out = every.join(merged, F.col("_id").eqNullSafe(F.col("_i2")) & (F.col("_th") == F.col("_t2")), "left").withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(F.col("_id").alias(id_col), "n_words", "spans", "items", *[F.col(f"_c_{c}").alias(c) for c in carry if c != id_col])


def n_covered(spans):
    """Words in any of the spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda acc, s: F.struct(F.greatest(acc["to"], s["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n")),
        lambda acc: acc["n"],
    )
