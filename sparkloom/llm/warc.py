"""WARC archives: written beside an index, read back by coalesced byte ranges.

A record is one gzip member. Each task writes archives of its own into the
shared folder and returns an index row per record: file, offset, length, URL,
digest. The index is written as a table before anything is read. Readers get the
index rows that were selected, in order of file and offset, join ranges that lie
close together into one read, and cut the members out of it.

Files are named for the attempt that wrote them, so a task that runs twice
leaves an archive that no index row names, and nothing is overwritten.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_arrow, materialize, scratch_path, shuffle_partitions

#: Payloads from this size on may be stored once and revisited.
REVISIT_BYTES = 1000
#: Ranges this close are read together, up to READ_BYTES; an archive is closed at FILE_BYTES.
GAP_BYTES, READ_BYTES, FILE_BYTES = 64 << 10, 4 << 20, 256 << 20
#: A table of repeated payloads up to this many rows (about 60 bytes each) is broadcast; beyond it, joined by a shuffle.
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page)}>"


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC/1.1 record of a page, compressed. What can't stand in a header line is percent-encoded."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head += [f"X-Page: {page}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one compressed record."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(warc["Content-Length"])]
    if raw[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    cut = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:])
    return warc, http, block[cut + 4 :]


def with_refers(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(_id, _url, _h, _d, _ref): the digest, and for revisits the page whose payload is the same."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_h"))
    digested = base.withColumn("_d", F.sha1("_h"))
    large = F.octet_length("_h") >= REVISIT_BYTES
    again = materialize(digested.where(large).groupBy(F.col("_d").alias("_d2")).agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_d2", "_keep"), "payloads")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    ref = F.when(large & ~F.col("_id").eqNullSafe(F.col("_keep")), F.col("_keep"))
    return digested.join(again, F.col("_d") == F.col("_d2"), "left").select("_id", "_url", "_h", "_d", ref.alias("_ref"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row into folder; the index: file, offset, length, url, digest, page, record_type, refers_to.

    The payload is the html in UTF-8; null is empty. Of rows with the same payload
    of REVISIT_BYTES or more, those with the largest id are responses and the
    others revisits; a null id is the largest only if there is no other. Rows
    repeated with the same id are records of their own, of the same type. A null
    url is left out of the record. A payload may be of any length that a row can
    have; one record at a time is held whole. Other columns are not read, whatever
    their names; an empty table writes no archive and has an empty index.
    """
    bounded_arrow(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page, url, payload, digest, ref in zip(*(batch.column(c).to_pylist() for c in ("_id", "_url", "_h", "_d", "_ref"))):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)
                data = record(str(page), url, payload, digest, None if ref is None else str(ref))
                out.write(data)
                rows.append((name, at, len(data), url, digest, page, "response" if ref is None else "revisit", ref))
                at += len(data)
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), batch.schema.field("_id").type, pa.string(), batch.schema.field("_ref").type]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "offset", "length", "url", "digest", "page", "record_type", "refers_to"])
        if out is not None:
            out.close()

    kind = pages.schema[id_col].dataType.simpleString()
    rows = with_refers(pages, id_col, url_col, html_col)
    index = rows.mapInArrow(run, f"file string, offset bigint, length bigint, url string, digest string, page {kind}, record_type string, refers_to {kind}")
    return materialize(index, "warc-index")


def read_warc(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records of the index rows given: page, url, record_type, refers_to, payload_bytes, payload_digest, and payload if asked for.

    Bytes and digest of a response are those of the payload read; a revisit has
    no payload of its own, and its bytes and digest are those its headers state.
    """
    spark = index.sparkSession
    bounded_arrow(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        file, name = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            sizes, digests, kinds, bodies = [], [], [], []
            i = 0
            while i < len(files):
                j, end = i + 1, offsets[i] + lengths[i]
                while j < len(files) and files[j] == files[i] and 0 <= offsets[j] - end <= GAP_BYTES and offsets[j] + lengths[j] - offsets[i] <= READ_BYTES:
                    end = offsets[j] + lengths[j]
                    j += 1
                if files[i] != name:
                    if file is not None:
                        file.close()
                    file, name = store.open_input_file(files[i]), files[i]
                data = file.read_at(end - offsets[i], offsets[i])
                for k in range(i, j):
                    a = offsets[k] - offsets[i]
                    warc, http, body = parse(data[a : a + lengths[k]])
                    response = warc["WARC-Type"] == "response"
                    kinds.append(warc["WARC-Type"])
                    sizes.append(len(body) if response else int(http["Content-Length"]))
                    digests.append(hashlib.sha1(body).hexdigest() if response else warc["WARC-Payload-Digest"].removeprefix("sha1:"))
                    if payload:
                        bodies.append(body if response else None)
                i = j
            cols = [batch.column("page"), batch.column("url"), pa.array(kinds, pa.string()), batch.column("refers_to"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]
            names = ["page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(bodies, pa.binary())] * payload, names=names + ["payload"] * payload)
        if file is not None:
            file.close()

    kind = index.schema["page"].dataType.simpleString()
    # A part of a file to a task, not a whole file.
    part = F.floor(F.col("offset") / (16 << 20))
    rows = index.select("file", "offset", "length", "url", "page", "refers_to").repartition(shuffle_partitions(spark), "file", part).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(run, f"page {kind}, url string, record_type string, refers_to {kind}, payload_bytes bigint, payload_digest string" + ", payload binary" * payload)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages and reads all their records back, without the payloads."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder, payload=False)
