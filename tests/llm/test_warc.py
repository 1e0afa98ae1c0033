import gzip
import hashlib

import pytest
from sparkloom.llm import warc

BIG = "x" * 999 + "é"
CASES = [
    [],
    [(1, "http://a/b c\r\nX: y", None), (2, None, ""), (3, "é", BIG), (9, "u", BIG), (4, "u", BIG), (None, "u", BIG), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "v", "y\r\n\r\nz" * 300_000)],
    [(None, "a", BIG), (None, "b", BIG), (1, "c", BIG * 2), (1, "c", BIG * 2)],
]


def brute(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x[0] for x in rows if x[0] is not None and (x[2] or "") == (h or "")]
        ref = max(ids) if len(b) >= 1000 and ids and i != max(ids) else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id bigint, url string, html string, digest int, page string").repartition(2)


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("most", [0, 100_000])
def test_round_trip(spark, monkeypatch, tmp_path, case, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = CASES[case]
    folder = f"file://{tmp_path}/w"
    index = warc.write_warc(frame(spark, rows), folder)
    got = warc.read_warc(index, folder).collect()
    assert sorted(((r["page"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute(rows)
    want = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all(bytes(r["payload"]) == want[r["payload_digest"]] for r in got if r["record_type"] == "response")
    assert sorted((r["url"] for r in got), key=repr) == sorted((u for _, u, _ in rows), key=repr)
    assert all(r["digest"] == hashlib.sha1(x).hexdigest() for r in index.collect() for x in [want[r["digest"]]])


def test_archives_are_standard_gzip_members(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_warc(frame(spark, CASES[1]), folder).collect()
    for r in index:
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["length"])).startswith(b"WARC/1.1\r\nWARC-Type: ")
    whole = b"".join(gzip.open(p).read() for p in {r["file"] for r in index})
    assert whole.count(b"WARC/1.1\r\n") == len(index)


def test_selected_records_only(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_warc(frame(spark, CASES[1]), folder)
    assert [r["page"] for r in warc.read_warc(index.where("page = 7"), folder).collect()] == [7]
