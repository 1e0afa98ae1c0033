"""Near-duplicates by SimHash, linked by a self-join of binary tries.

A fingerprint bit is set if it is set in over half of the 64-bit hashes of a
text's word shingles. Links are pairs of fingerprints that differ in few bits.
Fingerprints are cut into budget + 1 blocks of bits: two that link agree on one
block at least, so for each block, rotated to the top, they meet below one node
of the trie at that block's depth. From there pairs of nodes are traversed
together, the differing bits add up, and a pair is dropped once they exceed the
budget. Nodes are ranges of a sorted array, so a trie takes no more than its
values, and the traversal runs over many pairs at once in bounded pieces.

Only distinct fingerprints are joined. Within a task links fold into a forest,
so a cluster of n fingerprints gives n links at most, not n squared, and
components over all blocks come from a distributed star algorithm. A block value
that very many fingerprints share is cut again by the same argument, on the
remaining bits, until no bucket is large.

The pipeline's stage links texts by the Jaccard similarity of their shingles. At
0.8 some ten of 64 bits differ, so its fingerprints are longer: texts meet in
tables of a few bits each and stay candidates if further bits are close, and an
exact check of the sets decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_arrow, discard, grouped, materialize, shuffle_partitions
from sparkloom.llm.components import connected_components
from sparkloom.llm.rolling import BASE, gram_hashes, mixed

#: A bucket is cut again if it has more than this many fingerprints, CUTS times at most; fingerprints that a task joins at once.
HOT_ROWS, CUTS, JOINED_ROWS = 20_000, 3, 1 << 18
#: Node pairs that are expanded at once.
PAIRS = 100_000
#: The hash's seed, which is that of Spark's xxhash64().
SEED = 42
#: Near-duplicates of texts meet if all TABLE_BITS bits of their SimHashes in one of TABLES tables are equal: at a similarity of 0.8, where 0.1515 of the bits differ, all but one in a million pairs.
TABLES, TABLE_BITS = 96, 12
#: Further bits of a SimHash, of which those that meet may differ in APART: at 0.8 they differ in 19.4 on average, with a standard deviation of 4.1; unrelated texts in 64.
PRINT_BITS, APART = 128, 40
#: Rows of tables that a task compares at once, and those of a bucket beyond which it isn't compared but passed on whole.
MET_ROWS, MET_MOST = 1 << 18, 20_000
#: The same where their sketches are compared.
ALIKE_ROWS, ALIKE_MOST = 1 << 14, 4096
#: Bins of a sketch, and those that are compared first.
BINS, PREFIX = 512, 64
#: Standard deviations by which the share of equal bins may fall short of the similarity.
SLACK = 5
#: Partners that a row is tested with in the first round over open buckets, and how many times more in each further one.
FIRST, FURTHER = 16, 64
#: Rows, and shingles, of a part of a bucket; a task compares two parts at a time.
CELL, CELL_SHINGLES = 4096, 2_000_000
#: Pairs go as records of about this many at most: the rows that they are of, and the places of both ends among these.
RECORD_PAIRS, PAIRS_OF = 1 << 18, "cell bigint, key bigint, members array<bigint>, p array<int>, q array<int>, more boolean"
BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit SimHash of a lower-cased text; no words: 0; fewer than shingle words: of the whole sequence."""
    from xxhash import xxh64_digest

    words = text.split()  # of bytes: at \x20 and \x09-\x0D only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_digest(line, SEED)]
    else:
        space = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        start = [0, *(space[: len(words) - shingle] + 1).tolist()]
        end = [*space[shingle - 1 :].tolist(), len(line)]
        hashes = [xxh64_digest(line[a:b], SEED) for a, b in zip(start, end)]
    got = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    if len(got) < 300:
        ones = BITS[got].sum(axis=0).ravel()
    else:
        ones = np.concatenate([np.bincount(got[:, j], minlength=256) @ BITS for j in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(_id, _fp) for each row; null texts are empty."""
    bounded_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint((t or "").encode().lower(), shingle) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(got, pa.int64())], names=["_id", "_fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, _fp bigint")


def split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where, in the sorted ranges [lo, hi) that agree above this bit, the bit turns to 1."""
    one = (values[lo] >> np.uint64(bit)) << np.uint64(bit) | np.uint64(1 << bit)
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        mid = (a + b) >> 1
        below = open_ & (values[np.minimum(mid, len(values) - 1)] < one)
        a = np.where(below, mid + 1, a)
        b = np.where(open_ & ~below, mid, b)
    return a


class Forest:
    """Components of the places of an array, as links come in."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            self.parent[x] = self.parent[up]
            x = self.parent[x]

    def one(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return int(x)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            np.minimum.at(self.parent, a, b)


def trie_links(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: int, budget: int, forest: Forest) -> None:
    """Links all places of values (sorted, distinct within a range) that differ in at most `budget` bits and stand in one range. Each range agrees on all bits from `top` on."""
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(top - 1, lo[i : i + PAIRS], hi[i : i + PAIRS], lo[i : i + PAIRS], hi[i : i + PAIRS], np.zeros(len(lo[i : i + PAIRS]), np.int8)) for i in range(0, len(lo), PAIRS)]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            forest.link(a[near], b[near])
            alo, ahi, blo, bhi, err = (x[~single] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or bit < 0:
            continue
        am, bm = split(values, alo, ahi, bit), split(values, blo, bhi, bit)
        same = (alo == blo) & (ahi == bhi)
        out = []
        for (a0, a1), (b0, b1), add in (((alo, am), (blo, bm), 0), ((am, ahi), (bm, bhi), 0), ((alo, am), (bm, bhi), 1), ((am, ahi), (blo, bm), 1)):
            ok = (a0 < a1) & (b0 < b1) & (err + add <= budget)
            if add and a0 is am:
                ok &= ~same  # the mirror of the pair before
            if not add:
                ok &= ~((a0 == b0) & (a1 == b1) & (a1 - a0 == 1))  # a value with itself
            out.append((a0[ok], a1[ok], b0[ok], b1[ok], (err + add)[ok]))
        nxt = [np.concatenate(x) for x in zip(*out)]
        for i in range(0, len(nxt[0]), PAIRS):
            stack.append((bit - 1, *(x[i : i + PAIRS] for x in nxt)))


def cuts(bits: int, parts: int) -> list[int]:
    """Widths of `parts` nearly equal blocks."""
    return [bits // parts + (i < bits % parts) for i in range(parts)]


def _joined(budget: int, top_of: dict[int, tuple[int, int]]):
    def joined(got: pa.Table) -> pa.RecordBatch:
        kind, key, more, value = (got.column(c).to_numpy() for c in ("kind", "key", "more", "value"))
        value = value.view(np.uint64)
        order = np.lexsort((value, more, key, kind))
        kind, key, more, value = kind[order], key[order], more[order], value[order]
        new = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]) | (more[1:] != more[:-1]))))
        end = np.concatenate((new[1:], [len(value)]))
        forest = Forest(len(value))
        tops = np.array([top_of[int(k)][0] for k in kind[new]])
        for top in np.unique(tops):
            own = tops == top
            trie_links(value, new[own], end[own], int(top), budget, forest)
        root = forest.find(np.arange(len(value)))
        linked = np.flatnonzero(root != np.arange(len(value)))
        turn = np.array([top_of[int(k)][1] for k in kind[linked]], np.uint64)
        undo = lambda x: (x >> turn) | (x << ((np.uint64(64) - turn) & np.uint64(63)))
        return pa.RecordBatch.from_arrays([pa.array(undo(value[linked]).view(np.int64)), pa.array(undo(value[root[linked]]).view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole buckets, JOINED_ROWS or a bucket at a time: the bucket, and a rotated fingerprint."""
        held, rows = [], 0
        for bucket in grouped(batches, "bucket"):
            if rows and rows + bucket.num_rows > JOINED_ROWS:
                yield joined(pa.concat_tables(held))
                held, rows = [], 0
            held.append(bucket)
            rows += bucket.num_rows
        if rows:
            yield joined(pa.concat_tables(held))

    return run


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (_k, _t): (_k, n, bands, places, high, low, sketch), of the set of word shingles (of the whole sequence, if that is shorter).

    n: the set's size. A bit of the SimHash is set if it is set in over half of the
    set's hashes; two sets differ in a bit with a chance of the angle between them
    over pi, wherever the edits are. bands: its first bits as keys of TABLES tables;
    places: these bits alone, as two bytes for each table; high, low: the PRINT_BITS after these. sketch: another hash deals the set into
    BINS bins, with a byte of each bin's smallest value, 0 for none.
    """
    from sparkloom.llm.ctw import words_of
    from sparkloom.llm.decontaminate import chunks

    tables, each, bins = TABLES, TABLE_BITS, BINS
    bits = tables * each + PRINT_BITS
    steps = mixed(np.arange(1, bits // 64 + 1, dtype=np.uint64) * np.uint64(BASE))
    shift = np.uint64(64 - (bins - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("_t").to_pylist()]
            prints = np.zeros((len(texts), bits), bool)
            sketch = np.zeros((len(texts), bins), np.uint8)
            count = np.zeros(len(texts), np.int32)
            at = 0
            for a, b in chunks(texts, 2 << 20):
                words, size = words_of(texts[a:b])
                words = words.view(np.uint64)
                grams = gram_hashes(words, shingle)
                end = np.cumsum(size)
                for e, n in zip(end.tolist(), size.tolist()):
                    if n:
                        pieces = np.unique(grams[e - n : e - shingle + 1]) if n >= shingle else gram_hashes(words[e - n : e], n)
                        count[at] = len(pieces)
                        prints[at] = majority(pieces, steps)
                        h = np.sort(mixed(pieces ^ np.uint64(BASE)))
                        of = h >> shift
                        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                        sketch[at, of[first].astype(np.int64)] = (h[first] % np.uint64(254)).astype(np.uint8) + 1
                    at += 1
            places = prints[:, : tables * each].reshape(-1, tables, each) @ (1 << np.arange(each))
            keys = places + (np.arange(tables) << each)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tables * len(texts) + 1, tables), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            two = np.packbits(prints[:, tables * each :], axis=1).view(np.int64)
            columns = [batch.column("_k"), pa.array(count), lists, pa.array([x.tobytes() for x in places.astype(np.uint16)], pa.binary()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array([x.tobytes() for x in sketch], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_k", "n", "bands", "places", "high", "low", "sketch"])

    return docs.mapInArrow(run, "_k bigint, n int, bands array<bigint>, places binary, high bigint, low bigint, sketch binary")


def majority(pieces: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The bits that over half of the pieces' hashes have, 64 for each of the steps."""
    ones = np.zeros(64 * len(steps), np.int64)
    for i in range(0, len(pieces), 255):  # so many that a byte counts them
        ones += np.unpackbits(mixed(pieces[i : i + 255, None] + steps).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return 2 * ones > len(pieces)


def close_by(key: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> np.ndarray:
    """Whether a row has another with its key (rows are in order of it) that the test finds close, given the places of pairs; of keys with over `most` rows, all count."""
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(new, len(key)))
    start, size = np.repeat(new, size), np.repeat(size, size)
    near = size > most

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        hit = test(i, j)
        near[i[hit]] = near[j[hit]] = True

    # Around each bucket as a ring: a row that has no other yet meets the d-th after it, and the d-th before it where that has one already.
    left, d = np.flatnonzero(size > 1), 0
    while len(left):
        d += 1
        left = left[~near[left] & (2 * d <= size[left])]
        own, first = size[left], start[left]
        meet(left, first + (left - first + d) % own)
        before = first + (left - first - d) % own
        meet(left[near[before]], before[near[before]])
    return near


def close_rows(rows: DataFrame, test_of: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]], size: int, most: int) -> DataFrame:
    """(key, _k, n, high, low): of rows, by buckets of equal keys, those that are close by another one of theirs; of a bucket of over `most`, all. test_of: close_by()'s test for some rows; `size` are compared at once."""
    names = ["key", "_k", "n", "high", "low"]

    def kept(got: pa.Table) -> pa.RecordBatch:
        near = pa.array(close_by(got.column("key").to_numpy(), test_of(got), most))
        return pa.RecordBatch.from_arrays([got.column(c).combine_chunks().filter(near) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, large = [], 0, None
        for batch in batches:
            if large is not None:  # the rest of a large bucket
                end = int(np.searchsorted(batch.column("key").to_numpy(), large, "right"))
                yield batch.slice(0, end).select(names)
                batch, large = batch.slice(end), large if end == batch.num_rows else None
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < size:
                continue
            got = pa.Table.from_batches(held)
            key = got.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield kept(got.slice(0, cut))
            held, rows = got.slice(cut).to_batches(), rows - cut
            if rows > most:
                yield from (x.select(names) for x in held)
                held, rows, large = [], 0, int(key[-1])
        if rows:
            yield kept(pa.Table.from_batches(held))

    return rows.repartition(shuffle_partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "key bigint, _k bigint, n int, high bigint, low bigint")


def met(rows: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(key, _k, n, high, low): the rows of each table's buckets that are close by another one of theirs, for their further bits differ in APART at most and their sizes allow the similarity; of a bucket of over MET_MOST, all."""

    def test_of(got: pa.Table):
        high, low = (got.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))  # of signed values the absolute ones would be counted
        n = got.column("n").to_numpy()

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.bitwise_count(high[i] ^ high[j]) + np.bitwise_count(low[i] ^ low[j]) <= APART
            at = np.flatnonzero(out)
            out[at] = np.minimum(n[i[at]], n[j[at]]) >= similarity * np.maximum(n[i[at]], n[j[at]])
            return out

        return test

    return close_rows(rows.select(F.explode("bands").alias("key"), "_k", "n", "high", "low"), test_of, MET_ROWS, MET_MOST)


def alike(buckets: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """buckets (key, _k, n, high, low) with the rows only that have another one in the bucket whose set may be similar by size and sketch (of rows), and with which they share no table before it; a bucket of over ALIKE_MOST stays whole.

    No pair that open_pairs() would return is lost: it makes the same tests.
    """

    def test_of(got: pa.Table):
        table, n = got.column("key").to_numpy() >> TABLE_BITS, got.column("n").to_numpy()
        sketch, places = (np.frombuffer(b"".join(got.column(c).to_pylist()), kind).reshape(got.num_rows, -1) for c, kind in (("sketch", np.uint8), ("places", np.uint16)))

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
            for bins in (PREFIX, 0, BINS):
                left = np.flatnonzero(out)
                for k in range(0, len(left), 4096):
                    at = left[k : k + 4096]
                    if bins:
                        a, b = sketch[i[at], :bins], sketch[j[at], :bins]
                        out[at] = near_enough(((a == b) & (a > 0)).sum(axis=1), ((a > 0) | (b > 0)).sum(axis=1), similarity)
                    else:
                        out[at] = (places[i[at]] == places[j[at]]).argmax(axis=1) == table[i[at]]
            return out

        return test

    return close_rows(buckets.join(rows.select("_k", "places", "sketch"), "_k"), test_of, ALIKE_ROWS, ALIKE_MOST)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (_k, _t): (_k, _s), the distinct hashes of each text's shingles in order, as 8 bytes each."""
    from sparkloom.llm.ctw import words_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t in batch.column("_t").to_pylist():
                words = words_of([(t or "").encode()])[0].view(np.uint64)
                got.append(np.unique(gram_hashes(words, min(shingle, len(words)))).tobytes() if len(words) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(got, pa.binary())], names=["_k", "_s"])

    return docs.mapInArrow(run, "_k bigint, _s binary")


def near_enough(same: np.ndarray, either: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may be similar of whose bins so many agree, of so many that either has: SLACK standard deviations are allowed."""
    return same >= similarity * either - SLACK * np.sqrt(similarity * (1 - similarity) * either)


def sketch_pairs(x: np.ndarray, y: np.ndarray, ok: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the sketches x and y, and the share of bins that agree, of the pairs of ok that may be similar: tested on the first PREFIX bins, then on all."""
    p, q = np.zeros(0, int), np.zeros(0, int)
    one, two = x[:, :PREFIX], y[:, :PREFIX]
    full = [(s > 0).astype(np.float32) for s in (one, two)]
    both = full[0] @ full[1].T
    either = full[0].sum(axis=1)[:, None] + full[1].sum(axis=1)[None] - both
    two = np.where(two > 0, two, np.uint8(255))  # no bin without a value agrees
    same = (one[:, None, :] == two[None]).sum(axis=2, dtype=np.int32)
    p, q = np.nonzero(ok & near_enough(same, either, similarity))
    share = np.zeros(len(p))
    keep = np.zeros(len(p), bool)
    for i in range(0, len(p), 4096):
        a, b = x[p[i : i + 4096]], y[q[i : i + 4096]]
        same = ((a == b) & (a > 0)).sum(axis=1)
        either = ((a > 0) | (b > 0)).sum(axis=1)
        share[i : i + 4096] = same / np.maximum(either, 1)
        keep[i : i + 4096] = near_enough(same, either, similarity)
    return p[keep], q[keep], share[keep]


def hub_pairs(buckets: DataFrame) -> DataFrame:
    """buckets (key, _k, n, high, low): records of PAIRS_OF for each row and the nearest of the smallest and largest rows of its buckets, by their further bits.

    It is the nearest before anything is joined to it, so a row makes one pair
    however many buckets it is in and however many rows these have.
    """
    row = F.struct("_k", "high", "low")
    ends = buckets.groupBy("key").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))

    def pair(end: str) -> Column:
        apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{end}.{c}"))) for c in ("high", "low"))
        return F.when((F.col(f"{end}._k") != F.col("_k")) & (apart <= APART), F.struct(apart.alias("apart"), F.col(f"{end}._k").alias("v")))

    met = buckets.join(ends, "key").select(F.col("_k").alias("u"), "n", F.least(pair("lo"), pair("hi")).alias("x")).where("x is not null")
    best = met.groupBy("u").agg(F.min("x").alias("x"), F.max("n").alias("n")).select("u", "n", F.col("x.v").alias("v"))
    # A hub's rows are dealt into parts, so that no task has all of a hot one's.
    parts = best.groupBy("v").agg(by_size().alias("parts"))
    cells = best.join(parts, "v").select("u", "v", F.xxhash64("v", F.pmod(F.xxhash64("u"), F.col("parts"))).alias("cell")).groupBy("cell", "v").agg(F.collect_list("u").alias("us"))
    return cells.select("cell", F.lit(None).cast("bigint").alias("key"), F.concat(F.array("v"), "us").alias("members"), F.sequence(F.lit(1), F.size("us")).alias("p"), F.array_repeat(F.lit(0), F.size("us")).alias("q"), F.lit(False).alias("more"))


def by_size():
    """The number of parts for a group of rows with n shingles each."""
    return F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum(F.col("n") + 1) / CELL_SHINGLES)).cast("int")


def open_pairs(buckets: DataFrame, roots: DataFrame, rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """buckets (key, _k, n): records of PAIRS_OF, as a table, for the pairs of a bucket in different components whose sketches may be those of similar sets.

    A pair belongs to the first table that it shares, so it comes once. Each row has
    its `most` closest such partners of a cell; more tells that it has others. A
    bucket with rows of one component only comes to no task, and a large one is
    dealt into cells of two of its parts each, so that each pair has a cell.
    """
    spark = buckets.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in grouped(batches, "cell"):
            own, node, root = (got.column(c).to_numpy() for c in ("own", "_k", "root"))
            cell, key, one_part = got.column("cell")[0].as_py(), got.column("key")[0].as_py(), got.column("i")[0].as_py() == got.column("j")[0].as_py()
            sketch = np.frombuffer(b"".join(got.column("sketch").to_pylist()), np.uint8).reshape(len(own), -1)
            bands = got.column("bands").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
            names, which, count = np.unique(root, return_inverse=True, return_counts=True)
            rest = np.flatnonzero(which != np.argmax(count))  # each pair has an end outside the largest component
            outside = np.zeros(len(own), bool)
            outside[rest] = True
            step = max(1, (16 << 20) // (len(own) * PREFIX))
            ps, qs, over, held = [], [], False, 0
            for at in range(0, len(rest), step):
                x = rest[at : at + step]
                # A pair with both ends outside is met from its first.
                ok = (root[x, None] != root[None]) & (~outside[None] | (np.arange(len(own))[None] > x[:, None]))
                if not one_part:
                    ok &= own[x, None] != own[None]
                p, q, share = sketch_pairs(sketch[x], sketch, ok, similarity)
                first = np.zeros(len(p), bool)
                for i in range(0, len(p), 1 << 14):
                    a, b = bands[x[p[i : i + (1 << 14)]]], bands[q[i : i + (1 << 14)]]
                    first[i : i + (1 << 14)] = a[np.arange(len(a)), (a == b).argmax(axis=1)] == key
                p, q, share = p[first], q[first], share[first]
                # The closest of each row.
                order = np.lexsort((-share, p))
                p, q = p[order], q[order]
                nth = np.arange(len(p)) - np.searchsorted(p, p)
                over |= bool((nth >= most).any())
                ps.append(x[p[nth < most]])
                qs.append(q[nth < most])
                held += len(ps[-1])
                if held > RECORD_PAIRS:
                    yield record(cell, len(ps) + at, key, node, ps, qs, over)
                    ps, qs, held = [], [], 0
            if held:
                yield record(cell, -1, key, node, ps, qs, over)

    state = materialize(buckets.join(roots.select(F.col("u").alias("_k"), "root"), "_k", "left").select("key", "_k", "n", F.coalesce("root", "_k").alias("root")), "state")
    open_keys = state.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), by_size().alias("parts")).where("a < b").select("key", "parts")
    dealt = state.join(open_keys, "key").withColumn("own", F.pmod(F.xxhash64("_k"), F.col("parts")).cast("int"))
    dealt = dealt.select("key", "_k", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"))
    dealt = dealt.select("key", "_k", "root", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j")).withColumn("cell", F.xxhash64("key", "i", "j"))
    cells = dealt.join(rows.select("_k", "bands", "sketch"), "_k").repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "_k")
    out = materialize(cells.mapInArrow(run, PAIRS_OF), "pairs")
    discard(state)
    return out


def record(cell: int, number: int, key: int, node: np.ndarray, ps: list[np.ndarray], qs: list[np.ndarray], more: bool) -> pa.RecordBatch:
    """Some pairs of a cell's rows as one record."""
    p, q = np.concatenate(ps), np.concatenate(qs)
    places, at = np.unique(np.concatenate((p, q)), return_inverse=True)
    name = int(mixed(np.array([(cell + number) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])
    columns = [pa.array([name]), pa.array([key]), pa.array([node[places]], pa.list_(pa.int64())), pa.array([at[: len(p)].astype(np.int32)], pa.list_(pa.int32())), pa.array([at[len(p) :].astype(np.int32)], pa.list_(pa.int32())), pa.array([more])]
    return pa.RecordBatch.from_arrays(columns, names=["cell", "key", "members", "p", "q", "more"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) with the components of those pairs of the records whose sets have this Jaccard similarity, as a table; sets: (_k, _s).

    A record's sets come to one task once each, however many pairs they are in. A
    pair that verified links of the record connect already isn't tested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in grouped(batches, "cell"):
            is_set = np.array(got.column("_s").is_valid())
            held = {k: np.frombuffer(b, np.uint64) for k, b in zip(got.column("_k").to_pylist(), got.column("_s").to_pylist()) if b is not None}
            for row in np.flatnonzero(~is_set).tolist():
                members, p, q = (got.column(c)[row].values.to_numpy() for c in ("members", "p", "q"))
                own = [held[k] for k in members.tolist()]
                forest, out = Forest(len(own)), []
                for i, (a, b) in enumerate(zip(p.tolist(), q.tolist())):
                    x, y = own[a], own[b]
                    if len(x) > len(y):
                        x, y = y, x
                    if len(x) < similarity * len(y) or forest.one(a) == forest.one(b):
                        continue
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                    if common >= similarity * (len(x) + len(y) - common):
                        forest.parent[max(forest.one(a), forest.one(b))] = min(forest.one(a), forest.one(b))
                        out.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(members[p[out]]), pa.array(members[q[out]])], names=["u", "v"])

    spark = pairs.sparkSession
    none = lambda kind: F.lit(None).cast(kind)
    members = pairs.select("cell", F.explode("members").alias("_k"))
    whole = members.join(sets, "_k").select("cell", "_k", "_s", none("array<bigint>").alias("members"), none("array<int>").alias("p"), none("array<int>").alias("q"))
    both = whole.union(pairs.select("cell", none("bigint"), none("binary"), "members", "p", "q"))
    return materialize(both.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(run, "u bigint, v bigint"), "links")


def similar_components(keyed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """keyed (_k, _t): (u, root) of the rows that a chain of similar pairs links; the pairs are those whose SimHashes meet.

    Only pairs with a verified link ever count as connected. Buckets lose the rows
    that are like none of theirs. Then each row meets
    the nearest of its buckets' smallest and largest keys, which joins groups of
    near copies without their square of pairs. Then all pairs of a bucket that are
    still in different components follow, the closest of each row first and a
    growing number of them a round, until no row has any left.
    """
    rows = materialize(signatures(keyed, shingle), "signatures")
    near = materialize(met(rows, similarity).distinct(), "near")
    sketches = materialize(rows.select("_k", "bands", "places", "sketch").join(near.select("_k").distinct(), "_k", "left_semi").dropDuplicates(["_k"]), "sketches")
    discard(rows)
    buckets = materialize(alike(near, sketches, similarity), "buckets")
    discard(near)
    sets = materialize(shingle_sets(keyed.join(buckets.select("_k").distinct(), "_k", "left_semi"), shingle).dropDuplicates(["_k"]), "shingles")
    pairs = materialize(hub_pairs(buckets), "pairs")
    links = verified(pairs, sets, similarity)
    roots = connected_components(links)
    discard(pairs, links)
    most = FIRST
    while True:
        pairs = open_pairs(buckets, roots, sketches, similarity, most)
        n, more = pairs.agg(F.count("*"), F.max("more")).first()
        if n:
            links = verified(pairs, sets, similarity)
            before, roots = roots, connected_components(roots.select("u", F.col("root").alias("v")).union(links))
            discard(links, before)
        if more:  # of other buckets all pairs have been tested
            done, buckets = buckets, materialize(buckets.join(pairs.where("more").select("key").distinct(), "key", "left_semi"), "buckets")
            discard(done)
        discard(pairs)
        if not more:
            break
        most *= FURTHER
    discard(buckets, sketches, sets)
    return roots


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that go: (_k, component_id), _k as row_key() of the id and text. A group is a component of links, and its smallest id stays.

    Rows link if the Jaccard similarity of their sets of shingles (of hashes;
    lower-cased words between white space) is `similarity` or more. Candidates are
    found by SimHashes of these sets, see similar_components(). Texts of fewer
    words than a shingle have one shingle, the whole sequence; texts without words
    are alike. Rows equal in id and text stay or go together; a row without an id
    stays only if its component has no id.
    """
    bounded_arrow(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).withColumn("_k", row_key("_id", "_t"))
    roots = similar_components(keyed.select("_k", "_t"), shingle, similarity)
    members = materialize(keyed.select("_k", "_id").join(roots.withColumnRenamed("u", "_u"), F.col("_k") == F.col("_u")).select("_k", "_id", "root"), "members")
    order = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_k").alias("k"))
    least = members.groupBy(F.col("root").alias("_r")).agg(F.min(order).alias("m"))
    return members.join(least, F.col("root") == F.col("_r")).where(F.col("_k") != F.col("m.k")).select("_k", F.col("m.i").alias("component_id")).distinct()


def row_key(id_col: str, text_col: str):
    """A row's address: a hash of its id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() leaves, all columns."""
    name = "k" * (max(map(len, docs.columns)) + 1)  # longer than any of theirs
    gone = near_duplicates(docs, shingle, similarity, id_col=id_col, text_col=text_col).select(F.col("_k").alias(name))
    return docs.join(gone, row_key(id_col, text_col) == F.col(name), "left_anti")


def cut_again(masks: dict[int, int], budget: int) -> dict[int, list[tuple[int, int, int]]]:
    """Of each kind of bucket, which agrees on the bits of its mask: the kinds that a cut of its other bits into budget + 1 blocks makes, with the block's bits and those that then agree."""
    out, number = {}, max(masks)
    for kind, mask in masks.items():
        left = [b for b in range(63, -1, -1) if not mask >> b & 1]
        at, made = 0, []
        for w in cuts(len(left), budget + 1):
            block = sum(1 << b for b in left[at : at + w])
            number += 1
            made.append((number, block, mask | block))
            at += w
        out[kind] = made
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, budget: int) -> DataFrame:
    """fps (_fp): links (u, v) whose components are those of all pairs that differ in at most `budget` bits.

    A bucket holds the fingerprints, rotated, that agree on a block of bits at the
    top. One of over HOT_ROWS is cut again by the same argument, on its other bits,
    and so on until it is small or CUTS times: with a budget of 2 the bits that are
    then left make 16,384 values at most, so no bucket is larger than HOT_ROWS,
    whatever the fingerprints. Buckets of later cuts agree on more bits
    than the top ones; these are rotated only within the traversal's reach.
    """
    spark = fps.sparkSession
    n, widths = shuffle_partitions(spark), cuts(64, budget + 1)
    turned, masks, top_of, at = [], {}, {}, 0
    for kind, w in enumerate(widths):
        rot = F.col("_fp") if not at else F.shiftleft("_fp", at).bitwiseOR(F.shiftrightunsigned("_fp", 64 - at))
        turned.append(F.struct(F.lit(kind).alias("kind"), F.shiftrightunsigned(rot, 64 - w).alias("key"), F.lit(0).cast("bigint").alias("more"), rot.alias("value")))
        masks[kind], top_of[kind] = ((1 << w) - 1) << (64 - w), (64 - w, at)
        at += w
    rows, done = fps.select(F.explode(F.array(*turned)).alias("x")).select("x.*"), []
    for _ in range(CUTS):
        hot = materialize(rows.groupBy("kind", "key", "more").count().where(F.col("count") > HOT_ROWS).select("kind", "key", "more"), "hot")
        if not hot.count():
            break
        done.append(rows.join(hot, ["kind", "key", "more"], "left_anti"))
        made = cut_again(masks, budget)
        top_of |= {new: top_of[kind] for kind, parts in made.items() for new, _, _ in parts}
        of = F.lit(None).cast("array<struct<kind:int,more:bigint>>")
        for kind, parts in made.items():
            of = F.when(F.col("kind") == kind, F.array(*[F.struct(F.lit(new).alias("kind"), F.xxhash64("more", F.col("value").bitwiseAND(F.lit(signed(block)))).alias("more")) for new, block, _ in parts])).otherwise(of)
        rows = rows.join(hot, ["kind", "key", "more"], "left_semi").select(F.explode(of).alias("y"), "key", "value").select("y.kind", "key", "y.more", "value")
        masks = {new: mask for parts in made.values() for new, _, mask in parts}
    for more in done:
        rows = rows.unionByName(more)
    spread = rows.select("kind", "key", "more", "value", F.xxhash64("kind", "key", "more").alias("bucket")).repartition(n, "bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(_joined(budget, top_of), "u bigint, v bigint")


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Null and empty texts have fingerprint zero, and link like any other; texts of
    any length are read whole. Null ids
    are passed over for component_id, which is null only if all of a component
    are. Repeated rows come out repeated. Other columns are not read; an empty
    table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("_fp").agg(F.min("_id").alias("_low")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("_fp"), budget))
    labelled = distinct.join(roots, F.col("_fp") == F.col("u"), "left").select("_fp", "_low", "root")
    least = labelled.where("root is not null").groupBy(F.col("root").alias("_r")).agg(F.min("_low").alias("_least"))
    by_print = labelled.join(least, F.col("root") == F.col("_r"), "left").select(F.col("_fp").alias("_f2"), F.when(F.col("root").isNull(), F.col("_low")).otherwise(F.col("_least")).alias("component_id"))
    return prints.join(by_print, F.col("_fp") == F.col("_f2")).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
