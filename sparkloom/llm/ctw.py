"""Language-model scores by context-tree weighting over bytes.

Texts are lower-cased bytes, each text with an end, and DEPTH ends before its
first byte. A byte is eight binary decisions, so a context of d bytes and the
bits so far make a node, with a Krichevsky-Trofimov estimate from its counts of
zeros and ones. A node's weighted probability is half its own estimate and half
the product of those of its children, the contexts one byte longer; predicting,
that is a mixture of the estimates of all depths, by their posterior weights. A
context without training counts says nothing, and the mixture stops above it.
Minus the base-2 logarithm of the mixture, summed over a byte's bits, is its code
length.

All counts follow from those of strings of DEPTH + 1 bytes. Each task counts its
own texts' strings, with those of held-out texts at zero, and counts are summed by
string. The tree is built by subtree: all strings whose nearest three context bytes
are the same stand in one task; the sums that they send upward make the nodes of
their two nearest bytes, a table that comes back to the tasks below, and those of
the nearest byte, of which there are 256 times 255 at most. Each string then has a
code length, and a text's score is a lookup of its strings.

All executors read the tables of strings and words if these have at most
`broadcast_rows` rows each. Otherwise texts are dealt into blocks, each block asks for the strings and
words that it has, and the answers meet the texts again by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Shared, bounded_arrow, discard, materialize, scratch_path, shuffle_partitions, write_table
from sparkloom.llm.decontaminate import chunks
from sparkloom.llm.rolling import BASE, runs, word_hashes

DEPTH = 6
END = 255
CHUNK_BYTES = 1 << 20
#: Strings, and words, that every worker holds (12 to 16 bytes each, and 4 to 11 for the index); and, beyond, bytes of text in a block.
BROADCAST_ROWS, BLOCK_BYTES = 8_000_000, 32 << 20
#: New entries that a task holds before it folds them into its sums.
FOLD = 800_000
LOG_HALF = np.log(0.5)
NODE_COLUMNS = ("node", "n0", "n1", "below")
SPACE_BYTE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def strings_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts and each end, the byte below its context, nearest byte first, as a number; and how many each text has."""
    border = bytes([END]) * depth
    joined = border + (bytes([END]) + border).join(t.lower() for t in texts) + bytes([END])
    buf = np.frombuffer(joined, np.uint8)
    size = np.array([len(t) + 1 for t in texts])
    at = np.ones(len(buf), bool)
    begin = np.cumsum(size + depth) - size - depth
    for j in range(depth):
        at[begin + j] = False
    n = len(buf) - depth
    out = buf[depth:].astype(np.int64)
    for d in range(1, depth + 1):
        out |= buf[depth - d : depth - d + n].astype(np.int64) << 8 * (depth - d + 1)
    return out[at[depth:]], size


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, and how many each text has."""
    joined = b" ".join(texts).lower()
    buf = np.frombuffer(joined, np.uint8)
    start, end = runs(~SPACE_BYTE[buf])
    ends = np.cumsum([len(t) + 1 for t in texts])
    count = np.diff(np.concatenate(([0], np.searchsorted(start, ends))))
    return word_hashes(buf, start, end).view(np.int64), count


def tallied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each stands there."""
    v = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, int)
    return v[at], np.diff(np.concatenate((at, [len(v)])))


class Tally:
    """Sums of counts by value."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.new = 0

    def add(self, values: np.ndarray, train: bool) -> None:
        v, n = tallied(values)
        self.parts.append((v, n if train else np.zeros(len(n), np.int64)))
        self.new += len(v)
        if self.new > FOLD:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate([p[0] for p in self.parts] or [np.zeros(0, np.int64)])
        n = np.concatenate([p[1] for p in self.parts] or [np.zeros(0, np.int64)])
        self.parts, self.new = [], 0
        order = np.argsort(v, kind="stable")
        v, n = v[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, int)
        self.parts = [(v[at], np.add.reduceat(n, at) if len(at) else n)]
        return self.parts[0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series at x + 8, and down again."""
    down = np.ones_like(x)
    for i in range(8):
        down = down * np.where(x < 8, x + i, 1.0)
    y = np.where(x < 8, x + 8, x)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(down)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Nodes:
    """Nodes in order of their number, with counts of zeros and ones and the weighted probability of their children."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        """below: None for leaves."""
        self.node, self.n0, self.n1 = node, n0, n1
        estimate = log_kt(n0, n1)
        self.weighted = estimate if below is None else np.logaddexp(LOG_HALF + estimate, LOG_HALF + below)
        self.stop = np.exp(LOG_HALF + estimate - self.weighted) if below is not None else np.ones(len(node))
        self.one = (n1 + 0.5) / (n0 + n1 + 1)
        self.seen = n0 + n1 > 0

    def mixed(self, at: np.ndarray, bit: np.ndarray, prob: np.ndarray | None, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each bit, given that of the nodes below and whether those were seen; and whether these were."""
        own = np.where(bit == 1, self.one[at], 1 - self.one[at])
        if prob is not None:
            stop = self.stop[at]
            own = np.where(seen, stop * own + (1 - stop) * prob, own)
        return own, self.seen[at]

    def sums(self) -> tuple[np.ndarray, ...]:
        """By the node above: its number, zeros, ones, and the children's weighted probabilities."""
        return summed((self.node >> 16 << 8) | (self.node & 255), self.n0, self.n1, self.weighted)


def summed(node: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    distinct, of = np.unique(node, return_inverse=True)
    return distinct, *(np.bincount(of, weights=v, minlength=len(distinct)) for v in values)


def number(context: np.ndarray, byte: np.ndarray, bit: int) -> np.ndarray:
    """Of the node: the context, and a one before the bits that are known."""
    return context << 8 | (1 << bit) | (byte >> (8 - bit))


def subtrees(keys: np.ndarray, count: np.ndarray, depth: int, bit: int) -> list[tuple[Nodes, np.ndarray]]:
    """Nodes of depths 3 to depth with so many bits known, deepest first; and of each key, which node is its own."""
    out, below = [], None
    byte = keys & 255
    one = (byte >> (7 - bit)) & 1
    for d in range(depth, 2, -1):
        node, of = np.unique(number(keys >> 8 * (depth + 1 - d), byte, bit), return_inverse=True)
        n1 = np.bincount(of, weights=count * one, minlength=len(node))
        nodes = Nodes(node, np.bincount(of, weights=count, minlength=len(node)) - n1, n1, below if below is None else below[3])
        out.append((nodes, of))
        below = nodes.sums()
    return out


def parts(keys: np.ndarray, depth: int, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of sorted keys with whole subtrees of depth 3, of `most` keys or one subtree."""
    near = keys >> 8 * (depth - 2)
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1]))), [len(keys)])) if len(keys) else np.zeros(1, int)
    begin = 0
    for a, b in zip(edge[:-1], edge[1:]):
        if b - begin > most and a > begin:
            yield begin, a
            begin = a
    if begin < len(keys):
        yield begin, len(keys)


def second(keys: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """For nodes of depth 2, all bits: what these keys, whole subtrees of depth 3, add to zeros, ones and the children's weighted probabilities."""
    got = []
    for a, b in parts(keys, depth):
        for bit in range(8):
            got.append(subtrees(keys[a:b], count[a:b], depth, bit)[-1][0].sums())
    return summed(*(np.concatenate([g[i] for g in got]) for i in range(4)))


def log10_of(keys: np.ndarray, count: np.ndarray, depth: int, upper: Nodes, first: Nodes, root: Nodes) -> np.ndarray:
    """log10 of each key's byte after its context. keys: sorted, whole subtrees of depth 3; upper: the nodes of depth 2 above them."""
    out = np.zeros(len(keys))
    for a, b in parts(keys, depth):
        k = keys[a:b]
        byte = k & 255
        for bit in range(8):
            one = (byte >> (7 - bit)) & 1
            prob = seen = None
            for nodes, of in subtrees(k, count[a:b], depth, bit):
                prob, seen = nodes.mixed(of, one, prob, seen)
            for nodes, context in ((upper, k >> 8 * (depth - 1)), (first, k >> 8 * depth), (root, np.zeros(b - a, np.int64))):
                prob, seen = nodes.mixed(np.searchsorted(nodes.node, number(context, byte, bit)), one, prob, seen)
            out[a:b] += np.log10(np.where(seen, prob, 0.5))
    return out


class HashIndex:
    """Finds places in an array of distinct longs."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, (len(keys) * 4 // 3).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        for i in range(0, len(keys), 1 << 20):
            left = np.arange(i, min(i + (1 << 20), len(keys)), dtype=np.int32)
            slot = self.slots(keys[left])
            while len(left):
                free = self.table[slot] < 0
                self.table[slot[free]] = left[free]
                lost = self.table[slot] != left
                slot, left = (slot[lost] + 1) & (len(self.table) - 1), left[lost]

    @staticmethod
    def of(model: Model, name: str) -> HashIndex:
        """A model's index of its strings or words, made once in a worker."""
        if not hasattr(model, f"_{name}"):
            setattr(model, f"_{name}", HashIndex(getattr(model, name)))
        return getattr(model, f"_{name}")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        slot = self.slots(keys)
        out = self.table[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, int)
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & (len(self.table) - 1)
            got = self.table[slot]
            out[wrong] = got
            still = (got >= 0) & (self.keys[got] != keys[wrong])
            wrong, slot = wrong[still], slot[still]
        return out


class Model:
    """What scoring looks up: code lengths of strings, counts of words, and the totals of the base."""

    def __init__(self, strings: np.ndarray, code: np.ndarray, words: np.ndarray, count: np.ndarray, ends: int, tokens: int, distinct: int, depth: int) -> None:
        self.strings, self.code, self.words = strings, code, words
        # The last one, at -1, is for words that aren't there.
        self.logs = np.append(np.log10(count + 1.0), 0.0)
        self.ends, self.tokens, self.distinct, self.depth = ends, tokens, distinct, depth

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Columns of a result, by text."""
        strings, words = HashIndex.of(self, "strings"), HashIndex.of(self, "words")
        n = len(texts)
        out = {"n_tokens": np.zeros(n, np.int64), "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n)}
        bottom = np.log10(float(self.tokens + self.distinct + 1))
        for a, b in chunks(texts, CHUNK_BYTES):
            keys, size = strings_of(texts[a:b], self.depth)
            at = strings.find(keys)
            if len(at) and at.min() < 0:
                raise ValueError("a string is missing from the model")
            begin = np.cumsum(size) - size
            out["score"][a:b] = np.add.reduceat(self.code[at].astype(np.float64), begin)
            keys, size = words_of(texts[a:b])
            at = words.find(keys)
            of = np.repeat(np.arange(b - a), size)
            out["n_tokens"][a:b] = size + 1
            out["n_known"][a:b] = np.bincount(of, weights=at >= 0, minlength=b - a).astype(np.int64) + (self.ends > 0)
            out["base_score"][a:b] = np.bincount(of, weights=self.logs[at], minlength=b - a) + np.log10(self.ends + 1.0) - (size + 1) * bottom
        return out


def _held(c: Column, fold: tuple[int, int]) -> Column:
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(fold[0])) == fold[1]


def _rows(columns: dict[str, np.ndarray], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for i in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + size]) for v in columns.values()], names=list(columns))


class Stored:
    """A model as tables in the shared folder. A worker reads it once, when it first scores."""

    def __init__(self, strings: str, words: str, *totals: int) -> None:
        self.strings, self.words, self.totals = strings, words, totals

    def model(self) -> Model:
        if not hasattr(self, "_model"):
            self._model = Model(*self.columns(self.strings, "value", "code"), *self.columns(self.words, "value", "n"), *self.totals)
        return self._model

    @staticmethod
    def columns(folder: str, *names: str) -> list[np.ndarray]:
        """Columns of a Parquet table; a folder that isn't there is an empty one."""
        import pyarrow.dataset
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return [np.zeros(0, np.int64) for _ in names]
        got = pyarrow.dataset.dataset(root, filesystem=store, format="parquet").to_table(columns=list(names))
        return [c.to_numpy() for c in got.columns]


def tallies(docs: DataFrame, depth: int) -> DataFrame:
    """docs (_t, _held): (kind, value, n): strings (0), words (1) and the number of texts (2) of the training rows; strings of held-out rows have n = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, ends = (Tally(), Tally()), 0
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("_t").to_pylist()]
            held = np.array(batch.column("_held").to_pylist(), bool)
            ends += int((~held).sum())
            for train in (True, False):
                some = [texts[i] for i in np.flatnonzero(held != train)]
                for a, b in chunks(some, CHUNK_BYTES):
                    got[0].add(strings_of(some[a:b], depth)[0], train)
                    if train:
                        got[1].add(words_of(some[a:b])[0], True)
        for kind, tally in enumerate(got):
            value, n = tally.fold()
            yield from _rows({"kind": np.full(len(value), kind, np.int8), "value": value, "n": n})
        yield from _rows({"kind": np.array([2], np.int8), "value": np.array([0]), "n": np.array([ends])})

    rows = docs.mapInArrow(run, "kind tinyint, value bigint, n bigint")
    # Tasks have summed already; a partial sum before the shuffle would find nothing.
    spark = docs.sparkSession
    dealt = rows.repartition(shuffle_partitions(spark), "kind", "value")
    path = scratch_path(spark, "tallies")
    write_table(dealt.groupBy("kind", "value").agg(F.sum("n").alias("n")), path, "kind")
    out = spark.read.schema("value bigint, n bigint, kind tinyint").parquet(path)
    out.scratch_path = path
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """A task's strings in order, and their counts."""
    got = [(b.column("value").to_numpy(), b.column("n").to_numpy()) for b in batches]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, n = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(value)
    return value[order], n[order]


def code_lengths(strings: DataFrame, depth: int) -> DataFrame:
    """strings (value, n): (value, code), the log10 of each string's last byte after its context, in single precision."""
    spark = strings.sparkSession
    n = shuffle_partitions(spark)
    near = F.shiftright("value", 8 * (depth - 2)).alias("near")
    dealt = strings.select("value", "n", near)

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = _whole(batches)
        if len(value):
            yield from _rows(dict(zip(NODE_COLUMNS, second(value, count, depth))))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(dict(zip(NODE_COLUMNS, Nodes(*(batch.column(c).to_numpy() for c in NODE_COLUMNS)).sums())))

    kinds = "node bigint, n0 double, n1 double, below double"
    total = [F.sum(c).alias(c) for c in NODE_COLUMNS[1:]]
    # A row for each two nearest bytes and bits: 65,536 times 255 at most, so they stay a table.
    upper = materialize(dealt.repartition(n, "near").mapInArrow(upward, kinds).groupBy("node").agg(*total), "nodes")
    # A row for each nearest byte and bits: 256 times 255 at most.
    rows = upper.mapInArrow(further, kinds).groupBy("node").agg(*total).orderBy("node").toPandas()
    first = Nodes(*(rows[c].to_numpy() for c in NODE_COLUMNS))
    root = Nodes(*first.sums())

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        got = [b.filter(b.column("node").is_valid()) for b in held]
        value, count = _whole(b.filter(b.column("value").is_valid()) for b in held)
        if len(value):
            columns = [np.concatenate([b.column(c).to_numpy() for b in got]) for c in NODE_COLUMNS]
            _, at = np.unique(columns[0], return_index=True)
            above = Nodes(*(c[at] for c in columns))
            yield from _rows({"value": value, "code": log10_of(value, count, depth, above, first, root).astype(np.float32)})

    # Each group of strings with the nodes above it.
    above = dealt.select("near").distinct().join(upper, F.shiftright("near", 8) == F.shiftright("node", 8)).select("near", F.lit(None).cast("bigint").alias("value"), F.lit(None).cast("bigint").alias("n"), *NODE_COLUMNS)
    both = dealt.select("near", "value", "n", F.lit(None).cast("bigint").alias("node"), *[F.lit(None).cast("double").alias(c) for c in NODE_COLUMNS[1:]]).union(above)
    codes = materialize(both.repartition(n, "near").mapInArrow(downward, "value bigint, code float"), "codes")
    discard(upper)
    return codes


def score_texts(docs: DataFrame, depth: int = DEPTH, fold: tuple[int, int] = (7, 2), id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: the id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose crc32 of the id as text, modulo fold[0], is fold[1] are held out:
    they are scored, not learnt. A null id has the crc of the empty text. A null
    text is empty: one token, the end. Repeated rows are learnt as often. Without
    training rows every bit costs one bit. The score counts the end as a byte, and
    so does bits_per_byte. Texts of any length are learnt and scored whole. Other
    columns are not read, whatever their names; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), _held(F.col(id_col), fold).alias("_held"))
    tally = tallies(rows.select("_t", "_held"), depth)
    codes = code_lengths(tally.where("kind = 0"), depth)
    words = tally.where("kind = 1").select("value", "n")
    ends = tally.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_words, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, distinct = total + ends, n_words + (ends > 0)
    columns = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _held boolean, _n bigint, " + ", ".join(f"{c} {k}" for c, k in columns.items())

    def scored(model: Model, batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch | pa.Table:
        texts = [(t or "").encode() for t in batch.column("_t").to_pylist()]
        got = model.score(texts)
        arrays = [batch.column("_id"), batch.column("_held"), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(got[c]) for c in columns)]
        return type(batch).from_arrays(arrays, names=["_id", "_held", "_n", *columns])

    if max(n_words, codes.count()) <= broadcast_rows:
        # Totals and paths only; the tables are read where they are needed.
        shared = Shared(spark, Stored(codes.scratch_path, f"{tally.scratch_path}/kind=1", ends, tokens, distinct, depth))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield scored(shared.value.model(), batch)

        out = rows.mapInArrow(run, schema)
    else:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
        blocks = -(-size // block_bytes) + 1
        dealt = rows.withColumn("_b", F.pmod(F.xxhash64("_id", "_t"), F.lit(blocks)))

        def asked(table: pa.Table) -> pa.Table:
            texts = [(t or "").encode() for t in table.column("_t").to_pylist()]
            tally = Tally(), Tally()
            for a, b in chunks(texts, CHUNK_BYTES):
                tally[0].add(strings_of(texts[a:b], depth)[0], False)
                tally[1].add(words_of(texts[a:b])[0], False)
            values = [t.fold()[0] for t in tally]
            block = table.column("_b")[0].as_py()
            return pa.table({"_b": np.full(sum(map(len, values)), block), "kind": np.repeat(np.array([0, 1], np.int8), [len(v) for v in values]), "value": np.concatenate(values)})

        requests = dealt.select("_t", "_b").groupBy("_b").applyInArrow(asked, "_b bigint, kind tinyint, value bigint")
        known = codes.select(F.lit(0).cast("tinyint").alias("kind"), "value", F.col("code").alias("x")).union(words.select(F.lit(1).cast("tinyint"), "value", F.col("n").cast("double")))
        answers = requests.join(known, ["kind", "value"]).select("_b", "kind", "value", "x")

        def met(texts: pa.Table, found: pa.Table) -> pa.Table:
            part = {k: found.filter(pa.compute.equal(found.column("kind"), k)) for k in (0, 1)}
            value, x = ([part[k].column(c).to_numpy() for k in (0, 1)] for c in ("value", "x"))
            return scored(Model(value[0], x[0].astype(np.float32), value[1], x[1], ends, tokens, distinct, depth), texts)

        out = dealt.groupBy("_b").cogroup(answers.groupBy("_b")).applyInArrow(met, schema)
    bits = -F.col("score") * float(np.log2(10)) / (F.col("_n") + 1)
    return out.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", F.col("_n").alias("n_bytes"), bits.alias("bits_per_byte"))
