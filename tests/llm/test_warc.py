import base64
import gzip
import hashlib

import pytest

from ragscale.llm.warc import MAGIC, _Window, archive_round_trip, owned_records, page_record, plan_records, read_archives, write_archives

SCHEMA = "page_id bigint, url string, html string, key string, path string, sha1 string"
PAGES = [
    (1, "http://a/1", "<p>eins</p>"), (2, "http://a/ö 2\r\nX: y", "<p>eins</p>"), (3, None, None), (4, "http://a/4", ""),
    (5, "http://a/5", "x" * 300_000), (None, "http://a/n", "<p>eins</p>"), (None, None, "only null ids"),
    (7, "u", "ü\r\n\r\nWARC/1.1\r\n"), (9, "r", "twice"), (9, "r", "twice"), (8, "r", "twice"), (10, "z", "\x1f\x8b\x08 WARC/1."),
]


def frame(spark, pages):
    return spark.createDataFrame([(*p, "k", "p", "s") for p in pages], SCHEMA)


def brute(pages):
    out = []
    for i, _, html in pages:
        html = html or ""
        ids = [j for j, _, h in pages if (h or "") == html and j is not None]
        to = max(ids) if ids and max(ids) != i else None
        data = html.encode()
        out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", str(to)))
    return sorted(out)


@pytest.mark.parametrize("range_bytes", [97, 4 << 20])
def test_round_trip(spark, tmp_path, range_bytes):
    manifest = write_archives(plan_records(frame(spark, PAGES)).coalesce(2), f"file://{tmp_path}/w")
    got = read_archives(manifest, range_bytes=range_bytes).collect()
    assert sorted((str(r.key and int(r.key)), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == brute(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(bytes(r.payload) == html[int(r.key)] for r in got if r.record_type == "response" and r.key)
    assert {r.url for r in got if r.key == "1"} == {"http://a/1"} and {r.url for r in got if r.key == "3"} == {None}
    assert all("\r" not in (r.url or "") for r in got)
    assert sum(r["records"] for r in manifest.collect()) == len(PAGES) == len({(r.path, r.offset) for r in got})


def test_query_form_and_empty(spark, tmp_path):
    back = archive_round_trip(frame(spark, PAGES), f"{tmp_path}/w", columns=["key", "record_type"])
    assert dict(back.dtypes)["page_id"] == "bigint" and back.count() == len(PAGES)
    assert archive_round_trip(frame(spark, []), f"{tmp_path}/v").collect() == []


class _Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_magic_inside_a_member_is_no_record():
    inner = page_record(5, "u", b"inner", hashlib.sha1(b"inner").hexdigest(), None, "d")
    noise = bytes((i * 197 + i // 7) % 256 for i in range(500))
    blocks = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" + noise + MAGIC + noise + inner + noise, b"WARC/1.1\r\n\r\nlast"]
    members = [gzip.compress(b, compresslevel=0) for b in blocks]  # stored bytes: magic and a whole member show inside
    data = b"".join(members)
    assert data.count(MAGIC) > 2
    for size in (50, 333, len(data)):
        found = []
        for start in range(0, len(data), size):
            found += [o for o, _ in owned_records(_Window(_Bytes(data), start, len(data)), start, min(start + size, len(data)))]
        assert found == [0, len(members[0])]


def test_damage_is_loud(spark, tmp_path):
    plan = plan_records(frame(spark, PAGES[:1])).collect()[0].asDict() | {"sha1": hashlib.sha1(b"other").hexdigest()}
    bad = spark.createDataFrame([plan], "key bigint, url string, payload binary, sha1 string, refers_to bigint")
    with pytest.raises(Exception, match="differs from its digest"):
        read_archives(write_archives(bad, f"{tmp_path}/w")).collect()


def foreign():
    """Hand-made records in the forms that other writers use, and what they hold: (id, url, payload or None, digest)."""
    body = "größe\r\n\r\nmore".encode()
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    chunks = b"5;x=1\r\n" + body[:5] + b"\r\n" + hex(len(body) - 5)[2:].encode() + b"\r\n" + body[5:] + b"\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    out = []

    def add(fields, block, want, eol=b"\r\n", version=b"WARC/1.0", length=None):
        head = [version, *fields, b"Content-Length: " + str(len(block) if length is None else length).encode()]
        out.append((gzip.compress(eol.join(head) + eol + eol + block + b"\r\n\r\n"), want))

    add([b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:0>"], b"software: x\r\n", None)
    add([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:1>", b"WARC-Target-URI: http://a/1"], http + body, ("urn:uuid:1", "http://a/1", body, sha))  # no digest, no HTTP length
    add([b"WARC-Type:response", b"warc-record-id:<urn:uuid:2>", b"WARC-Target-URI:<http://a/2>", b"WARC-Payload-Digest:sha1:" + sha.lower().encode()], http + body, ("urn:uuid:2", "http://a/2", body, sha))
    add([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:3>", b"WARC-Target-URI: http://a/", b" 3", b"WARC-Payload-Digest: sha1:" + hashlib.sha1(body).hexdigest().encode()],
        b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks, ("urn:uuid:3", "http://a/ 3", body, sha))
    add([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:4>", b"WARC-Payload-Digest: md5:00", b"Broken line"], b"HTTP/1.0 200\n\n" + body, ("urn:uuid:4", None, body, sha), eol=b"\n")
    add([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:5>"], b"no http header", ("urn:uuid:5", None, b"no http header", base64.b32encode(hashlib.sha1(b"no http header").digest()).decode()), version=b"WARC/0.18")
    add([b"WARC-Type: revisit", b"WARC-Record-ID: <urn:uuid:6>", b"WARC-Refers-To: <urn:uuid:1>"], http, ("urn:uuid:6", None, None, None))
    add([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:7>", b"WARC-Payload-Digest: sha1:" + b"A" * 32], http + body, "differs")
    add([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:8>"], http, "shorter", length=9999)
    add([b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:9>"], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nnot chunked", ("urn:uuid:9", None, b"not chunked", base64.b32encode(hashlib.sha1(b"not chunked").digest()).decode()))
    return out


@pytest.mark.parametrize("range_bytes", [61, 4 << 20])
def test_archives_from_elsewhere(spark, tmp_path, range_bytes):
    records = foreign()
    data = b"".join(r for r, _ in records)
    (tmp_path / "x.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, bytes bigint")
    got = sorted(read_archives(manifest, range_bytes=range_bytes, rejects=True).collect(), key=lambda r: r.offset)
    starts = [sum(len(r) for r, _ in records[:i]) for i in range(len(records))]
    want = [(at, w) for at, (_, w) in zip(starts, records) if w is not None]
    assert [r.offset for r in got] == [at for at, _ in want]
    for r, (_, w) in zip(got, want):
        if isinstance(w, str):
            assert w in r.error and r.key is None and r.payload is None
        else:
            assert (r.key, r.url, None if r.payload is None else bytes(r.payload), r.payload_digest, r.error) == (*w, None)
    assert [r.refers_to for r in got if r.record_type == "revisit"] == ["urn:uuid:1"]
    with pytest.raises(Exception, match="differs from its digest|shorter than its length"):
        read_archives(manifest, range_bytes=range_bytes).collect()


def test_empty_keys_are_not_null(spark, tmp_path):
    rows = spark.createDataFrame([("", "u", "a"), (None, "u", "b"), ("x y/ü", "u", "c")], "page_id string, url string, html string")
    back = archive_round_trip(rows, f"{tmp_path}/w").collect()
    assert {(r.page_id, bytes(r.payload)) for r in back} == {("", b"a"), (None, b"b"), ("x y/ü", b"c")}
