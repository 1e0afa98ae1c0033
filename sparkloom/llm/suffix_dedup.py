"""Removal of long repeated byte strings, with a logarithmic family of suffix arrays.

Sampled suffixes. Of each `reach` successive positions the one whose `gram` units
hash smallest (of equals the first) is an anchor, so what a window of `length`
units has as its anchor depends on the window's own units alone: equal windows
have their anchors at the same place. A suffix array here holds the suffixes at
the anchors, one for reach / 2 units or so, in the order of their first eight bytes
and, where these are equal, of a hash of their first length - reach + 1 units,
which lie inside every window of that anchor: suffixes that can take part in a
long match are neighbours. (Every byte's suffix would be many times the input.)

The family. An array is cut at splitters, sampled once, into parts that are sorted
files in a shared folder. A new batch is dealt to the parts, sorted, and scanned
together with each existing level's file of that part, for neighbours that are
equal; it then becomes a level, and two levels of equal size merge into one of
twice that, so there are log(batches) levels and each entry is rewritten as often.
Levels are never shuffled. A manifest beside the files names them, so a family can
be opened again later and take another batch.

Exactness. The suffixes whose keys matched are candidates; each stands for the
run of windows that share the anchor. If the units of the whole run are the same
as those of another, all of its windows repeat. Else, where a key has different
runs, every window of one run of each kind is hashed and counted. Runs of the
first kind are counted, not listed, so n copies of a passage cost n rows.
Hashes have 64 bits; equal hashes of equal lengths count as equal strings.

Units are bytes, for the strings that go, or words, for passages that documents
share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_arrow, delete_path, discard, grouped, materialize, scratch_path, shuffle_partitions, write_table
from sparkloom.llm.rolling import mixed, prefix_hashes, span_hashes, window_min

LENGTH, REACH, GRAM = 400, 112, 16
#: The same in words, for passages that documents share.
PASSAGE, PASSAGE_REACH, PASSAGE_GRAM = 50, 40, 4
#: Units of text hashed at once; a longer text goes in overlapping pieces.
CHUNK_BYTES, CHUNK_WORDS = 1 << 20, 1 << 18
#: A table goes into the family in so many batches.
BATCHES = 4
#: An anchor's place takes the low bits of a position's rank, its hash the others.
PLACE_BITS = 24
#: Suffixes that the splitters are sampled from, and entries that a task sorts at once.
SAMPLE, SORTED_AT_ONCE = 20_000, 1 << 20


def row_key(id_col: str, text_col: str) -> Column:
    """Rows are addressed by a hash of id and text; rows equal in both have equal results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def units_of(texts: list[bytes], words: bool) -> list[np.ndarray]:
    """The bytes of each text, or the hashes of its words between white space, lower-cased."""
    if not words:
        return [np.frombuffer(t, np.uint8) for t in texts]
    from sparkloom.llm.ctw import words_of

    hashes, size = words_of(texts)
    return np.split(hashes.view(np.uint64), np.cumsum(size)[:-1]) if len(texts) else []


def pieces(texts: list[np.ndarray], length: int, most: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (text, offset, units) of about `most` units; every window of `length` lies in exactly one piece."""
    got, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), most):
            part = t[at : at + most + length - 1]
            if size and size + len(part) > most:
                yield got
                got, size = [], 0
            got.append((i, at, part))
            size += len(part)
    if got:
        yield got


def entries_of(texts: list[np.ndarray], length: int, reach: int, gram: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: text, first window's place, number of windows, the suffix's first eight bytes and key, hash of the run."""
    key_units = length - reach + 1
    for group in pieces(texts, length, most):
        buf = np.concatenate([p[2] for p in group])
        size = np.array([len(p[2]) for p in group])
        end = np.cumsum(size)
        prefix = prefix_hashes(buf)
        at = np.arange(len(buf) - gram + 1)
        rank = span_hashes(prefix, at, at + gram) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | at.astype(np.uint64)
        low = window_min(rank, reach)
        # Places where a window fits into its piece.
        starts = np.concatenate([np.arange(e - s, e - length + 1) for s, e in zip(size, end)])
        piece = np.repeat(np.arange(len(group)), size - length + 1)
        anchor = (low[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]))))
        first, anchor, piece = starts[new], anchor[new], piece[new]
        count = np.diff(np.concatenate((new, [len(starts)])))
        begin = buf[anchor].astype(np.uint64)
        if buf.dtype == np.uint8:
            for j in range(1, 8):
                begin = begin << np.uint64(8) | (buf[anchor + j] if j < key_units else np.uint8(0)).astype(np.uint64)
        key = span_hashes(prefix, anchor, anchor + key_units)
        whole = span_hashes(prefix, first, first + count + length - 1)
        whole = mixed(whole + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
        text = np.array([p[0] for p in group])[piece]
        offset = np.array([p[1] for p in group])[piece] - (end - size)[piece]
        yield text, first + offset, count, begin, key, whole


def suffix_entries(docs: DataFrame, words: bool, length: int, reach: int, gram: int, batches: int) -> DataFrame:
    """docs (_k, _t): (_k, first, count, head, key, run, batch). head and key are unsigned, kept in signed columns."""
    most = CHUNK_WORDS if words else CHUNK_BYTES

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            keys = batch.column("_k").to_numpy()
            texts = units_of([(t or "").encode() for t in batch.column("_t").to_pylist()], words)
            for text, first, count, head, key, whole in entries_of(texts, length, reach, gram, most):
                own = keys[text]
                columns = [own, first.astype(np.int32), count.astype(np.int32), head.view(np.int64), key.view(np.int64), whole.view(np.int64), (own % batches).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_k", "first", "count", "head", "key", "run", "batch"])

    return docs.mapInArrow(run, "_k bigint, first int, count int, head bigint, key bigint, run bigint, batch int")


class SuffixFamily:
    """Levels of sorted suffixes (head, key) in a folder of the shared store; each level has taken in a power of two of batches."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        """Opens the family that stands in the folder, or begins one; without a folder it lasts as long as the application."""
        self.spark = spark
        self.folder = folder or scratch_path(spark, "family")
        self.splitters: list[int] | None = None
        #: Number of batches, and the file of each part, largest first.
        self.levels: list[tuple[int, dict[int, str]]] = []
        path = self._path("manifest.json")
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(path):
            stream = store.open(path)
            kept = json.loads(bytes(stream.readAllBytes()))
            stream.close()
            self.splitters = kept["splitters"]
            self.levels = [(n, {int(p): f for p, f in files.items()}) for n, files in kept["levels"]]

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _save(self) -> None:
        path = self._path("manifest.json")
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        stream.write(bytearray(json.dumps({"splitters": self.splitters, "levels": self.levels}).encode()))
        stream.close()

    def _split(self, batch: DataFrame) -> None:
        """Splitters from a sample of at most a few SAMPLE suffixes, four times as many as tasks."""
        n = batch.count()
        rows = batch.select("head").sample(min(1.0, SAMPLE / max(n, 1)), seed=1).collect()
        heads = np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))
        parts = 4 * shuffle_partitions(self.spark)
        self.splitters = [int(heads[len(heads) * i // parts]) for i in range(1, parts)] if len(heads) else []

    def add(self, batch: DataFrame) -> DataFrame:
        """batch (head, key): the distinct keys that it has twice or that a level has, as a table; then it is a level itself."""
        if self.splitters is None:
            self._split(batch)
        spark, folder, splitters = self.spark, self.folder, np.array(self.splitters, np.uint64)
        # Levels that the new one takes up.
        size, taken = 1, []
        while self.levels and self.levels[-1][0] == size:
            taken.append(self.levels.pop())
            size *= 2
        others = self.levels

        def deal(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Distinct suffixes of a piece, with their parts; a head that fills several parts is dealt over them by key."""
            held, rows = [], 0
            for group in groups:
                held.append(group)
                rows += group.num_rows
                if rows >= SORTED_AT_ONCE:
                    yield dealt(held)
                    held, rows = [], 0
            if rows:
                yield dealt(held)

        def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            head, key = (np.concatenate([g.column(c).to_numpy() for g in held]).view(np.uint64) for c in ("head", "key"))
            head, key, n = distinct(head, key)
            lo, hi = np.searchsorted(splitters, head, "left"), np.searchsorted(splitters, head, "right")
            part = lo + (key % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(part), pa.array(head.view(np.int64)), pa.array(key.view(np.int64)), pa.array(n > 1)], names=["part", "head", "key", "again"])

        def scan(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs, parquet

            store, root = fs.FileSystem.from_uri(folder)
            store.create_dir(root, recursive=True)
            read = lambda name: tuple(c.to_numpy().view(np.uint64) for c in parquet.read_table(f"{root}/{name}", filesystem=store).columns)
            for rows in grouped(groups, "part"):
                part = rows.column("part")[0].as_py()
                rows = rows.filter(rows.column("key").is_valid())
                head, key = (rows.column(c).to_numpy().view(np.uint64) for c in ("head", "key"))
                again = rows.column("again").to_numpy(zero_copy_only=False).astype(bool)
                twice = distinct(head[again], key[again])[:2]
                head, key, n = distinct(head, key)
                found = (n > 1) | in_both(head, key, *twice)
                merged = head, key
                for files in [f for _, f in others] + [f for _, f in taken]:
                    found |= in_both(head, key, *read(files[part]))
                for _, files in taken:
                    old = read(files[part])
                    merged = distinct(np.concatenate((merged[0], old[0])), np.concatenate((merged[1], old[1])))[:2]
                name = f"level-{part}-{uuid.uuid4().hex}.parquet"
                parquet.write_table(pa.table({"head": merged[0].view(np.int64), "key": merged[1].view(np.int64)}), f"{root}/{name}", filesystem=store)
                keys = key[found].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * (len(keys) + 1)), pa.array([name] + [None] * len(keys), pa.string()), pa.array(np.concatenate(([0], keys)))], names=["part", "file", "key"])

        every = spark.range(len(splitters) + 1).selectExpr("id AS part", "cast(null AS bigint) AS head", "cast(null AS bigint) AS key", "false AS again")
        spread = batch.select("head", "key").mapInArrow(deal, "part bigint, head bigint, key bigint, again boolean").union(every)
        rows = spread.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part")
        out = materialize(rows.mapInArrow(scan, "part bigint, file string, key bigint"), "matched")
        self.levels.append((size, {r["part"]: r["file"] for r in out.where("file IS NOT NULL").select("part", "file").collect()}))  # a row for each part
        self._save()
        for _, files in taken:
            for name in files.values():
                delete_path(spark, f"{folder}/{name}")
        matched = out.where("file IS NULL").select("key")
        matched.scratch_path = out.scratch_path
        return matched

    def close(self) -> None:
        """Deletes the family."""
        delete_path(self.spark, self.folder)
        self.levels = []


def distinct(head: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in order, each once, and how often each was there."""
    order = np.lexsort((key, head))
    head, key = head[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (key[1:] != key[:-1])))) if len(head) else np.zeros(0, int)
    return head[new], key[new], np.diff(np.concatenate((new, [len(head)])))


def in_both(head: np.ndarray, key: np.ndarray, other_head: np.ndarray, other_key: np.ndarray) -> np.ndarray:
    """Which of the distinct suffixes in order are among the others, by one scan of both: equal ones are neighbours."""
    n = len(head)
    h, k = np.concatenate((head, other_head)), np.concatenate((key, other_key))
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (k[1:] == k[:-1]))
    out = np.zeros(n, bool)
    out[order[same][order[same] < n]] = True
    return out


def merged_spans(places: DataFrame) -> DataFrame:
    """places (_k, start, end): (_k, spans), the maximal runs in order. A row holds one text's places."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            lists = batch.column("_p")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            start, end = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "end"))
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            # Each text in a range of numbers of its own, so that the last end so far is a running maximum.
            apart = row * (int(end.max()) + 1) if len(end) else row
            far = np.maximum.accumulate(end + apart)
            first = np.flatnonzero(np.concatenate(([True], (start + apart)[1:] > far[:-1]))) if len(row) else row
            last = np.concatenate((first[1:] - 1, [len(row) - 1])) if len(row) else row
            spans = pa.StructArray.from_arrays([pa.array(start[first]), pa.array((far - apart)[last])], names=["start", "end"])
            offsets = np.searchsorted(row[first], np.arange(len(lists) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["_k", "spans"])

    return places.groupBy("_k").agg(F.collect_list(F.struct("start", "end")).alias("_p")).mapInArrow(run, "_k bigint, spans array<struct<start:bigint,end:bigint>>")


def window_rows(docs: DataFrame, wanted: DataFrame, words: bool, length: int) -> DataFrame:
    """wanted (_k, first, count, lo, hi): (hash, _k, start, lo, hi) of each of these windows of the texts."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups:
            texts = units_of([t.encode() for t in batch.column("_t").to_pylist()], words)
            for i, (key, data) in enumerate(zip(batch.column("_k").to_pylist(), texts)):
                ranges = batch.column("_w")[i].values
                first, size, lo, hi = (ranges.field(c).to_numpy() for c in ("first", "count", "lo", "hi"))
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                h = span_hashes(prefix_hashes(data), at, at + length)
                columns = [h.view(np.int64), np.full(len(at), key, np.int64), at.astype(np.int32), np.repeat(lo, size), np.repeat(hi, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hash", "_k", "start", "lo", "hi"])

    ranges = wanted.groupBy("_k").agg(F.collect_list(F.struct("first", "count", "lo", "hi")).alias("_w"))
    return docs.join(ranges, "_k").select("_k", "_t", "_w").mapInArrow(run, "hash bigint, _k bigint, start int, lo bigint, hi bigint")


def repeated_spans(docs: DataFrame, words: bool, length: int, reach: int, gram: int, batches: int) -> DataFrame:
    """docs (_k, _t): (_k, spans) of the texts that have any unit covered by a string of `length` units that also starts elsewhere; of words, in a text of another key."""
    spark = docs.sparkSession
    path = scratch_path(spark, "suffixes")
    columns = "_k bigint, first int, count int, head bigint, key bigint, run bigint, batch int"
    write_table(suffix_entries(docs, words, length, reach, gram, batches), path, "batch")
    entries = spark.read.schema(columns).parquet(path)
    family, matched = SuffixFamily(spark), []
    for b in range(batches):
        matched.append(family.add(entries.where(F.col("batch") == b).select("head", "key")))
    family.close()
    found = matched[0]
    for m in matched[1:]:
        found = found.union(m)
    # As a table of its own, so that Spark can split a key with very many suffixes.
    keys = materialize(found.distinct(), "keys")
    hits = materialize(entries.select("_k", "first", "count", "key", "run").join(keys, "key", "left_semi"), "hits")
    delete_path(spark, path)
    discard(keys, *matched)
    # One row for each kind of run of a key, with the first that has it.
    repeats = F.col("lo") < F.col("hi") if words else F.col("n") > 1
    kinds = hits.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.min(F.struct("_k", "first", "count")).alias("one"))
    kinds = materialize(kinds.withColumn("repeats", repeats), "kinds")
    whole = hits.join(kinds.where("repeats").select("key", "run"), ["key", "run"], "left_semi").select("_k", F.col("first").alias("start"), (F.col("first") + F.col("count") + (length - 1)).alias("end"))
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("key")
    mixed_up = kinds.join(several, "key", "left_semi")
    wanted = mixed_up.select("one.*", "lo", "hi")
    if words:  # a run that only one text has, but several times, is wanted at each of its places
        own = mixed_up.where("n > 1 AND NOT repeats").select("key", "run", "lo", "hi")
        wanted = wanted.union(hits.join(own, ["key", "run"]).select("_k", "first", "count", "lo", "hi"))
    windows = materialize(window_rows(docs, wanted, words, length), "windows")
    counted = windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    again = materialize(counted.where(repeats).select("hash"), "again")
    single = windows.join(again, "hash", "left_semi").select("_k", "start", (F.col("start") + length).alias("end"))
    out = materialize(merged_spans(whole.union(single)), "spans")
    discard(hits, kinds, windows, again)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: the id, n_bytes, spans (maximal removed runs, in bytes), kept (the remaining bytes, binary), shared (runs of words, from 0).

    A null text is empty and has no spans; nor has one shorter than `length`.
    Windows that overlap count, also inside one text, and all copies of a string
    go, judged on the input. shared has the words that stand in a run of `passage`
    successive words that another document has too, wherever; words are those
    between white space, A-Z in lower case, and rows equal in id and text are one
    document there. A null id is an id like others; repeated rows are copies of
    each other. Texts may be of any length. Other columns are not read, whatever
    their names; an empty table is empty.
    """
    bounded_arrow(docs.sparkSession)
    reach = max(1, min(REACH, length * 2 // 5))
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_k", row_key("_id", "_t"))
    texts = keyed.select("_k", "_t")
    spans = repeated_spans(texts, False, length, reach, min(GRAM, length - reach + 1), batches)
    reach = max(1, min(PASSAGE_REACH, passage * 4 // 5))
    shared = repeated_spans(texts, True, passage, reach, min(PASSAGE_GRAM, passage - reach + 1), 1)
    both = spans.select("_k", "spans", F.lit(None).cast(shared.schema["spans"].dataType).alias("shared")).union(shared.select("_k", F.lit(None).cast(spans.schema["spans"].dataType), "spans"))
    found = both.groupBy(F.col("_k").alias("_k2")).agg(F.first("spans", True).alias("spans"), F.first("shared", True).alias("shared"))
    joined = keyed.join(found, F.col("_k") == F.col("_k2"), "left")
    data = F.encode("_t", "UTF-8")
    size = F.octet_length("_t")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    got = F.coalesce("spans", none)
    # What lies between the spans.
    begin = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(got, lambda s: s["end"]))
    end = F.concat(F.transform(got, lambda s: s["start"]), F.array(size.cast("bigint")))
    parts = F.zip_with(begin, end, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.when(F.col("spans").isNull(), data).otherwise(F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x)))
    return joined.select(F.col("_id").alias(id_col), size.cast("long").alias("n_bytes"), got.alias("spans"), kept.alias("kept"), F.coalesce("shared", none).alias("shared"))
