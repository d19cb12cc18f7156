"""Web archives: one gzip member for each record, written in parallel and read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, functions as F

from ragscale.session import materialize

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
BLOCK = 1 << 20
EPOCH = "1970-01-01T00:00:00Z"  # pages carry no time of their own
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``key, url, payload, sha1, refers_to``: what to write for each row.

    Of rows with equal payloads the one with the largest key is the response and the others refer to it; repeated rows
    with that key are all responses. Rows with a null key refer to the largest key, or are responses if there is
    none. A null payload is the empty one. The sizes of groups don't matter: the largest key is a combined aggregate,
    and adaptive execution can split the join.
    """
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    largest = rows.groupBy("sha1").agg(F.max("key").alias("largest"))
    return rows.join(largest, "sha1").select(
        "key", "url", "payload", "sha1", F.when(~F.col("key").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to")
    )


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(key, url: str | None, payload: bytes, sha1: str, refers_to, date: str) -> bytes:
    """The gzip member of one page; a revisit keeps the response's HTTP header but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _urn(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]%~")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()))
    fields.append(("Content-Type", "application/http;msgtype=response"))
    if refers_to is None:
        return _record("response", fields, http + payload)
    return _record("revisit", [*fields, ("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)], http)


NO_KEY = "<urn:page-without-key>"


def _urn(key) -> str:
    return NO_KEY if key is None else f"<urn:page:{quote(str(key))}>"


def write_archives(records: DataFrame, folder: str, date: str = EPOCH) -> DataFrame:
    """Archives of ``plan_records`` rows, one file for each task, under ``folder`` (shared by all executors).

    Returns the written manifest ``path, bytes, records``. Every attempt of a task writes a file of its own and
    only files in the manifest count, so lost executors and repeated tasks leave nothing twice.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = FileSystem.from_uri(folder)
        name, out, size, count = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    size += out.write(_record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                size += out.write(page_record(*row, date))
                count += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([count])], names=["path", "bytes", "records"])

    rows = records.select("key", "url", "payload", "sha1", "refers_to")
    return materialize(rows.mapInArrow(task, "path string, bytes bigint, records bigint"), "manifest")


class _Window:
    """Bytes of a file from a start on, read as far as needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, bytearray()

    def to(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.data += self.file.read_at(end - have, have)

    def piece(self, a: int, b: int) -> bytes:
        self.to(b)
        return bytes(self.data[a - self.start : b - self.start])

    def find(self, a: int, end: int) -> int:
        """The first gzip magic at or after ``a`` that starts before ``end``; -1 if there is none."""
        self.to(end + len(MAGIC) - 1)
        at = self.data.find(MAGIC, a - self.start, end - self.start + len(MAGIC) - 1)
        return -1 if at < 0 else at + self.start


def member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record whose gzip member starts at ``at`` and the member's end, or None if no record starts there."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    step = 4096  # enough to judge most headers
    while not unpack.eof:
        piece = window.piece(pos, pos + step)
        if not piece:
            return None
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            return None
        if pos == at and not (out[0].startswith(b"WARC/") or b"WARC/".startswith(out[0])):
            return None
        pos, step = pos + len(piece), BLOCK
    end = pos - len(unpack.unused_data)
    record = b"".join(out)
    follows = window.piece(end, end + len(MAGIC))
    if not record.startswith(b"WARC/") or not split_head(record)[1] or follows not in (b"", MAGIC):
        return None
    return record, end


def owned_records(window: _Window, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every record that starts in ``[start, end)``."""
    at = start
    while at < end and (at := window.find(at, end)) >= 0:
        found = member(window, at)
        if found is None:
            at += 1
            continue
        yield at, found[0]
        at = found[1]


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name: white space around values is optional, folded lines go on, the first of a name counts."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t"):
            if name is not None:
                out[name] = (out[name] + " " + line.strip()).strip()
            continue
        key, colon, value = line.partition(":")
        name = key.strip().lower() if colon and key.strip().lower() not in out else None
        if name is not None:
            out[name] = value.strip()
    return out


def split_head(data: bytes) -> tuple[bytes, bytes]:
    """What comes before and after the first empty line."""
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := data.find(mark)) >= 0]
    if not ends:
        return data, b""
    at, n = min(ends)
    return data[:at], data[at + n :]


def dechunked(body: bytes) -> bytes:
    """The content of a body in chunked transfer coding; one that isn't is itself (archives often store it decoded)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at : end if end >= 0 else len(body)].split(b";")[0].strip(), 16)
        except ValueError:
            return body
        if end < 0 or size < 0 or len(body) < end + 2 + size:
            return body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return body
        at += 2


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stated_sha1(field: str | None) -> str | None:
    """The base32 SHA-1 that a digest field states, in whichever of the two usual forms; None for other digests."""
    kind, _, value = (field or "").partition(":")
    if kind.strip().lower() != "sha1":
        return None
    value = value.strip()
    if len(value) == 40:
        try:
            return base64.b32encode(bytes.fromhex(value)).decode()
        except ValueError:
            return None
    return value.upper()


def parse(record: bytes) -> dict | None:
    """Fields of a response or revisit record; None for other kinds. Raises ValueError if the record contradicts itself.

    A payload is what follows the HTTP header, without chunked transfer coding, or the whole block if there is no such
    header. Digests may be missing or of another kind; the payload's own is returned then, null for a revisit.
    """
    head, rest = split_head(record)
    fields = headers(head)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError(f"block of {fields.get('warc-record-id')} is shorter than its length {length or 'that is missing'}")
    block = rest[: int(length)]
    http, payload = split_head(block) if block.startswith(b"HTTP/") else (b"", block)
    told = headers(http)
    raw = payload
    if "chunked" in told.get("transfer-encoding", "").lower():
        payload = dechunked(payload)
    stated, size = stated_sha1(fields.get("warc-payload-digest")), told.get("content-length", "")
    if kind == "response":
        own = sha1_base32(payload)
        if stated is not None and stated not in (own, sha1_base32(raw)):
            raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
        stated, size = own, len(payload)
    else:
        size = int(size) if size.isdigit() else None
    return {
        "key": _key(fields.get("warc-record-id")), "url": fields.get("warc-target-uri", "").removeprefix("<").removesuffix(">") or None,
        "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": stated,
        "record_type": kind, "refers_to": _key(fields.get("warc-refers-to")) if kind == "revisit" else None, "error": None,
    }


def _key(urn: str | None) -> str | None:
    if urn is None or urn == NO_KEY:
        return None
    if urn.startswith("<urn:page:"):
        return unquote(urn.removeprefix("<urn:page:").removesuffix(">"))
    return urn.removeprefix("<").removesuffix(">")


FIELDS = {"key": pa.string(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "error": pa.string()}


def read_archives(manifest: DataFrame, columns: list[str] | None = None, range_bytes: int = RANGE_BYTES, rejects: bool = False) -> DataFrame:
    """Records of the archives in ``manifest`` (``path``, ``bytes``): the ``columns`` of FIELDS, and ``path, offset``.

    A task gets byte ranges, looks in each for gzip magic, takes a place for a record's start only if a WARC header
    unpacks there and another member or the file's end follows the member, and owns the records that start inside its
    range, reading past the range's end to finish the last. Archives may come from elsewhere, see ``parse``; keys that
    weren't written here are record ids without brackets. A damaged record raises, or with ``rejects`` becomes a row with
    nothing but ``error``, path and offset. Memory is one range and one record.
    """
    names = list(FIELDS) if columns is None else [*columns, *(["error"] if rejects and "error" not in columns else [])]
    tasks = manifest.select(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    ranges = manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))).alias("start")
    ).repartition(int(tasks), "path", "start")  # a stated number: adaptive execution would see few bytes and make one task

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, local = FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(local) as file:
                    for offset, record in owned_records(_Window(file, start, size), start, min(start + range_bytes, size)):
                        try:
                            told = parse(record)
                        except ValueError as wrong:
                            if not rejects:
                                raise
                            told = dict.fromkeys(FIELDS) | {"error": str(wrong)}
                        if told is not None:
                            rows.append([*(told[n] for n in names), path, offset])
                            held += len(record)
                        if held > 2 * range_bytes:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    types = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "bigint"}
    schema = ", ".join(f"{n} {types[FIELDS[n]]}" for n in names)
    return ranges.mapInArrow(task, f"{schema}, path string, offset bigint")


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    kinds = [*(FIELDS[n] for n in names), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*names, "path", "offset"])


def archive_folder(spark: SparkSession) -> str:
    from ragscale.session import work_path

    return work_path(spark, "warc")


def archive_round_trip(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", columns: list[str] | None = None) -> DataFrame:
    """Write every page as a record and read the archives back; the key has its own type again.

    Nulls, ties and repeated rows: see ``plan_records``. Characters of a URL that a header line can't hold come back
    percent-encoded. Extra columns are not written. No pages give no records.
    """
    kind = pages.schema[key].dataType
    manifest = write_archives(plan_records(pages, key, url, payload), folder)
    back = read_archives(manifest, columns)
    return back.withColumns({c: F.col(c).cast(kind) for c in ("key", "refers_to") if c in back.columns}).withColumnRenamed("key", key)
