"""WARC archives: one gzip member per record, written by Spark tasks and read back sequentially.

The reader inflates a file chunk by chunk (at most CHUNK bytes out of each call), takes one member as
one record, frames it by its Content-Length and checks the digests it bears. A task writes files named
after its attempt; Spark's committed manifest tells which attempts count, so lost executors leave no
half archive in the result. Archives go to a folder that pyarrow.fs can open from every executor.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is the
response and the others are revisits which refer to it. Defined cases when writing: a null html is an
empty payload; a null url leaves out the target; a null page_id is never the response of a group that
has another; rows that repeat a page_id with an equal payload are all response if that id is the
group's largest; an empty table gives no archives and an empty result; further columns are ignored.
Defined cases when reading other archives: records of any type (warcinfo, request, metadata, ...) come
out under their type; a digest that is absent or of another algorithm is not checked, and the record's
digest is then that of its payload (of a revisit: null); header bytes that are no UTF-8 are read as
Latin-1, and lines that begin with a blank continue the one before; an HTTP head without a (valid)
Content-Length leaves the payload as long as the block makes it, a revisit's length then being null;
blocks that are not HTTP messages are payload as a whole; the response of a page is the HTTP body as
archived. What breaks framing or fails a digest raises BadRecord, which names the file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("8f2c0c5e-55c1-4c0c-9d0a-3f6f0d9a7b11")
CHUNK = 1 << 20


class BadRecord(ValueError):
    """A record that breaks framing or fails a digest."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, str(page_id))}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member. A revisit keeps the HTTP head, with the payload's full length, and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time; the compressed file is never held whole, and no call inflates more than CHUNK bytes."""
    rest, inflate, parts = b"", None, []
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            if inflate is not None:
                raise BadRecord("the last member is cut off")
            return
        inflate = inflate or zlib.decompressobj(31)
        try:
            parts.append(inflate.decompress(data, CHUNK))
        except zlib.error as e:
            raise BadRecord(f"no gzip member: {e}") from e
        if inflate.eof:
            rest, inflate = inflate.unused_data, None
            yield b"".join(parts)
            parts = []
        else:
            rest = inflate.unconsumed_tail


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """The first line and the fields (lower-case names; the first of a repeated one counts) of a head."""
    try:
        text = head.decode()
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    first, *lines = text.split("\r\n")
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in " \t" and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower() if colon and name.strip().lower() not in found else None
        if name:
            found[name] = value.strip()
    return first, found


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and value.isascii() and value.isdigit() else None


def _sha1(value: str | None) -> bytes | None:
    """The digest that a header states, if it is a SHA-1, in base 32 or hexadecimal."""
    kind, _, stated = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        raw = bytes.fromhex(stated) if len(stated) == 40 else base64.b32decode(stated.upper())
    except ValueError as e:
        raise BadRecord("digest header") from e
    if len(raw) != 20:
        raise BadRecord("digest header")
    return raw


def _checked(data: bytes, stated: str | None, what: str) -> None:
    want = _sha1(stated)
    if want is not None and hashlib.sha1(data).digest() != want:
        raise BadRecord(what)


def parse(raw: bytes) -> dict:
    """Headers of one record with payload, payload_bytes and digest (hex SHA-1 of the full payload, or null), framed by Content-Length, digests checked."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, found = _fields(head)
    length = _number(found.get("content-length"))
    if not blank or not version.startswith("WARC/"):
        raise BadRecord("no WARC head")
    if length is None or "warc-type" not in found:
        raise BadRecord("no content-length or type")
    block = rest[:length]
    if len(block) < length or rest[length:] != b"\r\n\r\n":
        raise BadRecord("content-length does not frame the record")
    _checked(block, found.get("warc-block-digest"), "block digest")
    kind, stated = found["warc-type"], found.get("warc-payload-digest")
    is_http = found.get("content-type", "").lower().startswith("application/http") or kind == "revisit"
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    full = _number(_fields(http)[1].get("content-length"))
    if kind == "revisit":
        digest = _sha1(stated)
        return found | {"payload": payload, "payload_bytes": full, "digest": digest and digest.hex()}
    _checked(payload, stated, "payload digest")
    if full is not None and full != len(payload):
        raise BadRecord("payload length")
    return found | {"payload": payload, "payload_bytes": len(payload), "digest": hashlib.sha1(payload).hexdigest()}


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1) and refers_to (null for a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    narrow = sized.where(F.octet_length("payload") >= least).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = cut(groups, "warc-groups")  # plain on both sides of the join, so that AQE may split a hot payload
    return sized.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", F.expr("if(response <> page_id or page_id is null, response, null)").alias("refers_to"))


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 128 << 20) -> DataFrame:
    """Write the records as .warc.gz files of about roll_bytes; gives the manifest (path, records, bytes)."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, made = None, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{len(made):04d}-{task.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    made.append([f"{folder}/{name}", 0, 0])
                made[-1][1] += 1
                made[-1][2] += out.write(make_record(page_id, url, payload, refers_to))
                if made[-1][2] >= roll_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return cut(records.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in column path, read sequentially, one file at a time in each task."""
    paths = manifest.select("path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches):
        from pyarrow import fs

        names = ["record_type", "page_id", "url", "refers_to", "digest", "payload_bytes", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(inner, compression=None) as stream:
                    for nth, raw in enumerate(members(stream)):
                        try:
                            r = parse(raw)
                        except BadRecord as e:
                            raise BadRecord(f"record {nth} of {path}: {e}") from e
                        rows.append((r["warc-type"], _number(r.get("x-page-id")), r.get("warc-target-uri"), _number(r.get("x-refers-to-page-id")), r["digest"], r["payload_bytes"], r["payload"] if with_payload else None))
                        held += len(r["payload"]) if with_payload else 200
                        if held >= CHUNK * 4:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return paths.mapInArrow(run, "record_type string, page_id bigint, url string, refers_to bigint, digest string, payload_bytes bigint, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder and read every record back (without payloads, which the reader has checked)."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages), folder), with_payload=False)
