"""WARC files and the salvage reader; registered queries next to their SQL; the pipeline."""

import gzip

import pytest
from compare import compare, duck

from clickloom.llm import queries, sql, warc

SMALL = "/root/testdata/sf0.001"


def record(n: int, body: bytes) -> bytes:
    import hashlib

    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}\r\n"
            f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_salvage(pack):
    parts = [pack(record(i, bytes([65 + i]) * (50 + i))) for i in range(6)]
    whole = b"".join(parts)
    assert [x[0] for x in warc.salvage(whole)] == ["record"] * 6
    broken = bytearray(whole)
    at = len(parts[0]) + len(parts[1])
    broken[at + len(parts[2]) // 2] ^= 0xFF
    got = list(warc.salvage(bytes(broken)))
    ids = [x[3]["warc-record-id"] for x in got if x[0] == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
    assert [(x[1], x[2]) for x in got if x[0] == "gap"] == [(at, at + len(parts[2]))]
    for cut in (0, 3, len(whole) - 5):
        spans = [(x[1], x[2]) for x in warc.salvage(whole[cut:] if cut < 10 else whole[:cut])]
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"junk")] == ["gap"]


def ids(found) -> list[str]:
    return [x[3]["warc-record-id"][10:-1] for x in found if x[0] == "record"]


def test_salvage_inside_members():
    """A damaged record of a member loses only itself; of a damaged member what lies before the damage is kept."""
    import random

    rng = random.Random(5)
    parts = [record(i, bytes(rng.randrange(256) for _ in range(3000))) for i in range(4)]
    whole = b"".join(parts)
    hurt = bytearray(whole)
    hurt[len(parts[0]) + 500] ^= 1
    member, behind = gzip.compress(bytes(hurt)), gzip.compress(record(9, b"behind"))
    got = list(warc.salvage(member + behind))
    assert ids(got) == ["0", "2", "3", "9"]
    gaps = [x for x in got if x[0] == "gap"]
    assert [(x[1], x[2]) for x in gaps] == [(0, len(member))]
    assert f"bytes {len(parts[0])}-{len(parts[0]) + len(parts[1])} of the member" in gaps[0][3]

    member = gzip.compress(whole)
    short = list(warc.salvage(member[: len(member) * 5 // 8]))
    assert ids(short) == ["0", "1"] and [(x[1], x[2]) for x in short if x[0] == "gap"] == [(0, len(member) * 5 // 8)]
    # the checksum fails, but no record shows damage: a header may be wrong
    bad_sum = member[:-6] + bytes([member[-6] ^ 1]) + member[-5:]
    assert ids(warc.salvage(bad_sum + behind)) == ["9"]
    torn = bytearray(member)
    torn[len(member) * 5 // 8] ^= 0xFF
    assert set(ids(warc.salvage(bytes(torn) + behind))) >= {"0", "1", "9"}
    # without digests a member's own checks must hold, unless it is only cut off
    unchecked = gzip.compress(whole.replace(b"Block-Digest: sha1", b"Other-Digest: sha1"))
    assert ids(warc.salvage(unchecked)) == ["0", "1", "2", "3"] and ids(warc.salvage(unchecked[:-20])) == ["0", "1", "2"]


def test_long_headers(spark):
    """A url of over a mebibyte comes back, and a page that does not is an error."""
    rows = [(1, "http://a/" + "u" * (3 << 20), "x" * 2000), (2, "http://b/", "x" * 2000), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write(pages)
    found = {r.record_id: r for r in warc.read_back(pages, path).collect()}
    assert found["<urn:page:1>"].url == rows[0][1] and found["<urn:page:1>"].refers_to == "<urn:page:2>"
    with pytest.raises(RuntimeError, match="3 records"):
        warc.read_back(pages.unionByName(pages), path)
    assert list(warc.salvage(b"WARC/1.1\r\n folded\r\n\r\n"))[0][0] == "gap"


@pytest.mark.parametrize("form", ["hex", "HEX", "base32", "BASE32", "md5", "unknown"])
def test_digest_forms_and_folded_lines(form):
    import base64
    import hashlib

    def written(data: bytes) -> str:
        raw = hashlib.sha1(data).digest()
        return {"hex": "sha1:" + raw.hex(), "HEX": "SHA1:" + raw.hex().upper(), "base32": "sha1:" + base64.b32encode(raw).decode().lower(),
                "BASE32": "sha1:" + base64.b32encode(raw).decode(), "md5": "md5:" + "0" * 32, "unknown": "sha1:?"}[form]

    body = b"<p>text</p>" * 9
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    one = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI:\r\n http://a/b\r\n\tc\r\n"
           f"WARC-Payload-Digest: {written(body)}\r\nWARC-Block-Digest: {written(block)}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    got = list(warc.salvage(one + one))
    assert [x[0] for x in got] == ["record"] * 2 and got[0][3]["warc-target-uri"] == "http://a/b c"
    if form not in ("md5", "unknown"):
        assert [x[0] for x in warc.salvage(one.replace(b"text", b"tent"))] == ["gap"]
    revisit = ("record", 0, 1, {"warc-type": "revisit", "warc-payload-digest": "sha1:" + base64.b32encode(b"x" * 20).decode()}, b"")
    assert warc._row("", revisit, False)[9] == (b"x" * 20).hex()


def test_odd_pages(spark):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, "u", big), (2, None, big), (3, "a b\r\nX: y", None), (4, "u", ""), (None, "u", big), (5, "u", "x" * 999), (6, "u", "x" * 999), (6, "u", "x" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read(warc.archives(spark, warc.write(pages))).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    kinds = {r.record_id: (r.record_type, r.refers_to) for r in got}
    assert kinds["<urn:page:1>"] == kinds["<urn:page:null>"] == ("revisit", "<urn:page:2>")
    assert all(kinds[f"<urn:page:{i}>"] == ("response", None) for i in (2, 3, 4, 5, 6))
    assert next(r.payload for r in got if r.record_id == "<urn:page:2>") == big.encode()
    assert warc.read(warc.archives(spark, warc.write(pages.limit(0)))).count() == 0


def test_members_and_padding(spark):
    """One gzip member a record, whole for standard tools; a record of over 16 MiB keeps its last byte."""
    rows = [(1, "u", "ab" * 700), (2, "u", "x" * (17 << 20)), (3, "u", ""), (4, "u", "é" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write(pages.coalesce(1))
    files = [r.content for r in warc.archives(spark, path).collect()]
    assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == 4
    assert {r.record_id: r.payload_bytes for r in warc.read(warc.archives(spark, path)).collect()} == {
        f"<urn:page:{i}>": len(t.encode()) for i, _, t in rows
    }
    spans = [(x[0], x[1], x[2]) for f in files for x in warc.salvage(f)]
    assert all(s[0] == "record" for s in spans) and sum(s[2] - s[1] for s in spans) == sum(map(len, files))
    plain = warc.write(pages, members=False)
    assert warc.read(warc.archives(spark, plain)).count() == 4


@pytest.mark.parametrize("name", list(sql.SQL))
def test_query_equals_sql(spark, name):
    assert compare(queries.Q[name](spark, SMALL), duck(SMALL), sql.SQL[name]) is None


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, SMALL)
        assert after.columns == docs.columns
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert 0 < len(out) < docs.count() and all(r.decoded == r.text for r in out)
