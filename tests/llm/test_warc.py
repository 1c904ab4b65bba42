import base64
import gzip
import hashlib
import os

from tokenweir.llm import warc
from tokenweir.llm.common import new_path

SCHEMA = "page_id long, url string, html string, payload_bytes long, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)


ROWS = [
    (1, "https://a.example/x?y#z", "<p>one</p>"),
    (2, "https://a.example/", "<p>one</p>"),
    (3, None, None),
    (4, "http://b.example/two\r\nX: y", ""),
    (5, "http://b.example", "WARC/1.1\r\nWARC-Type: request\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n"),
    (6, "http://b.example/ü", "größer 日本語 🙂\r\n\r\n" * 2000),
]


def test_round_trip(spark):
    got = {r.page_id: r for r in warc.round_trip(pages(spark, ROWS)).collect()}
    assert len(got) == len(ROWS)
    first = {}
    for i, _, html in ROWS:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), digest)
        owner = first.setdefault(digest, i)
        assert (r.record_type, r.refers_to) == (("response", None) if owner == i else ("revisit", owner))


def test_small_payloads_stay_responses(spark):
    got = warc.round_trip(pages(spark, ROWS), min_revisit_bytes=100).collect()
    assert {r.record_type for r in got} == {"response"}


def test_files_and_nested_captures(spark):
    path = new_path(spark, "warc-test")
    warc.write_warc(pages(spark, ROWS), path)
    folder = path.removeprefix("file://")
    raw = b"".join(gzip.decompress(open(f"{folder}/{f}", "rb").read()) for f in sorted(os.listdir(folder)) if f.endswith(".gz"))
    kinds = [h["warc-type"][0] for h, _ in warc.parse([raw])]
    assert sorted(kinds) == sorted(["request", "metadata"] * 6 + ["response"] * 4 + ["revisit"] * 2)
    captures = {r.metadata.fields["page-id"]: r for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert captures["6"].response.payload.decode() == ROWS[5][2]
    assert captures["1"].request.payload == b"" and captures["1"].target_uri == ROWS[0][1]


def test_repeated_ids_and_empty(spark):
    got = warc.round_trip(pages(spark, [(1, "u", "a"), (1, "u", "a"), (None, "u", "b")])).collect()
    assert sorted(r.record_type for r in got) == ["response", "response", "revisit"]
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_pieces_of_files():
    """A member per record, members in one piece, plain files, any size of piece, cut ends."""
    records = [f"WARC/1.1\r\nWARC-Type: t\r\nContent-Length: {n}\r\n\r\n".encode() + b"WARC/x\r\n\r\n"[: n % 9].ljust(n, b"b") + b"\r\n\r\n" for n in (0, 5, 8, 3000)]
    want = [(len(r) and int(r.split(b"Length: ")[1].split(b"\r")[0])) for r in records]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), b"".join(map(gzip.compress, records)) + b"rest"):
        for step in (1, 7, 100, 1 << 18):
            assert [len(block) for _, block in warc.parse(warc.unpacked(data, step))] == want
    assert len(list(warc.parse(warc.unpacked(b"".join(records)[:-100])))) == 3
    assert list(warc.parse([b"WARC/1.1\r\nContent-Length: x\r\n\r\n"])) == [({"content-length": ["x"]}, b"")]


def test_more_than_a_file_and_a_batch(spark, monkeypatch):
    """Pages beyond FILE_BYTES and BATCH_BYTES, a very long page, and the join beyond the broadcast bound."""
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 2)
    rows = [(i, f"http://c.example/{i}", f"page {i % 30} " * 40) for i in range(90)] + [(100, "u", "long " * 200_000)]
    path = new_path(spark, "warc-test")
    warc.write_warc(pages(spark, rows), path, file_bytes=20_000)
    assert len(os.listdir(path.removeprefix("file://"))) > 8
    got = {r.page_id: r for r in warc.resolve_revisits(warc.assemble(warc.read_warc(spark, path))).collect()}
    assert len(got) == 91 and got[100].payload_bytes == 1_000_000
    assert all((got[i].record_type, got[i].refers_to) == (("response", None) if i < 30 else ("revisit", i % 30)) for i in range(90))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "u", "a", 5, "k"), (2, "u", "a", 6, "k"), (2, "u", "b", 7, "k")], "page_id long, url string, html string, __key long, digest string")
    got = sorted(tuple(r) for r in warc.round_trip(docs).select("page_id", "record_type", "refers_to").collect() if r.page_id == 1 or r.record_type)
    assert got[0] == (1, "response", None) and (2, "revisit", 1) in got and len(got) == 3
