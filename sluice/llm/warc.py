"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Writing.  Each task writes gzip archives, a member for each record, under names of its attempt; the
manifest that Spark commits names those of finished attempts only, so a repeated task does no harm.
Of records with equal payloads of some length, that with the largest id is a response and the others
are revisits that refer to it.

Reading.  A record counts if its member unpacks with a right checksum, its version line, header and
length agree and its digests hold.  Otherwise the reader looks for the next member or version line
from which a whole record can be read, goes on there and logs the bytes between as quarantined.

Defined results: a null payload is empty; null ids rank below all others, and if a group has only
null ids all its records are responses, as are repeated rows of the largest id; a null address is
written as an empty one; an empty table makes no archive; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh_path, maybe_broadcast, need, written

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Size at which a writer begins another archive.
ARCHIVE_BYTES = 64 << 20
MANIFEST = "file string, records long, bytes long"
RECORDS = "kind string, file string, start long, end long, reason string, record_type string, source_id string, uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"
#: Tasks that read archives at most; each takes its share of them one after the other.
READERS = 20_000
_READ = 1 << 20
_GZIP = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records ---------------------------------------------------------------------------------


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: object) -> str:
    """A header value: JSON keeps null apart from text and has no line ends."""
    return json.dumps(value, ensure_ascii=True)


def _record_id(source_id: object, record_type: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_line(source_id)} {record_type} {payload_digest}')}>"


def _uri(uri: str | None) -> str:
    """An address fit for a header line: white space, controls and what is not ASCII are percent-encoded."""
    return quote(uri or "", safe="!#$%&'()*+,/:;=?@[]~")


def _whole(lines: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(record_type: str, source_id: object, uri: str | None, payload: bytes, refers_to: object, stamp: str = "1970-01-01T00:00:00Z", refers_uri: str | None = None) -> bytes:
    """One WARC record.  A revisit holds the HTTP head only; digest and length are of the full payload.

    Standard headers say what other readers need; X- headers keep ids, lengths and the address as given.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if record_type == "revisit" else head + payload
    digest = _sha1(payload)
    lines = [f"WARC-Type: {record_type}", f"WARC-Record-ID: {_record_id(source_id, record_type, digest)}", f"WARC-Date: {stamp}", f"WARC-Target-URI: {_uri(uri)}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", f"X-Payload-Length: {len(payload)}", f"X-Source-ID: {_line(source_id)}"]
    if _uri(uri) != (uri or ""):
        lines.append(f"X-Target-URI: {_line(uri)}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, 'response', digest)}", f"WARC-Refers-To-Target-URI: {_uri(refers_uri)}", f"WARC-Refers-To-Date: {stamp}", f"X-Refers-To-Source-ID: {_line(refers_to)}"]
    return _whole([*lines, "Content-Type: application/http; msgtype=response"], block)


def archive_info(name: str, stamp: str = "1970-01-01T00:00:00Z") -> bytes:
    """The record that an archive begins with."""
    block = b"format: WARC File Format 1.1\r\nsoftware: sluice\r\n"
    return _whole(["WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(name, 'warcinfo', '')}", f"WARC-Date: {stamp}", f"WARC-Filename: {_uri(name)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/warc-fields"], block)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damage(Exception):
    """Why bytes are no record."""


class _File:
    """Random reads from a file with a window, so a task holds a record and not an archive."""

    def __init__(self, handle, size: int) -> None:
        self.handle, self.size, self.at, self.data = handle, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if start < self.at or start + n > self.at + len(self.data):
            self.handle.seek(start)
            self.at, self.data = start, self.handle.read(max(n, min(_READ, self.size - start)))
        return self.data[start - self.at : start - self.at + n]


def _member(file: _File, start: int) -> tuple[bytes, int]:
    unpack, out, at = zlib.decompressobj(31), [], start
    while not unpack.eof:
        data = file.get(at, 1 << 16)
        if not data:
            raise Damage("member ends early")
        try:
            out.append(unpack.decompress(data))
        except zlib.error as e:
            raise Damage(f"member: {e}") from None
        if len(out) == 1 and not _VERSION.match(out[0][:10]) and len(out[0]) >= 10:
            raise Damage("no version line")
        at += len(data)
    return b"".join(out), at - len(unpack.unused_data)


def _header(head: bytes) -> dict[str, str]:
    if not _VERSION.match(head):
        raise Damage("no version line")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without a colon")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields


def _length(fields: dict[str, str]) -> int:
    if not fields.get("content-length", "").isdigit():
        raise Damage("no content length")
    return int(fields["content-length"])


def _checked(fields: dict[str, str], block: bytes) -> dict:
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _sha1(block):
        raise Damage("block digest differs")
    kind = fields.get("warc-type")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields.get("warc-payload-digest", "")
    if payload is not None:
        if digest and digest != _sha1(payload):
            raise Damage("payload digest differs")
        told = hashlib.sha1(payload).hexdigest()
    else:
        try:
            told = base64.b32decode(digest.removeprefix("sha1:")).hex() or None
        except ValueError:
            raise Damage("payload digest is not base32") from None
    size = fields.get("x-payload-length", "")
    try:
        named = {k: json.loads(fields[k]) if k in fields else None for k in ("x-source-id", "x-target-uri", "x-refers-to-source-id")}
    except ValueError:
        named = {k: fields.get(k) for k in ("x-source-id", "x-target-uri", "x-refers-to-source-id")}
    named["x-target-uri"] = named["x-target-uri"] if "x-target-uri" in fields else fields.get("warc-target-uri")
    text = lambda v: None if v is None else str(v)
    return {"record_type": kind, "source_id": text(named["x-source-id"]), "uri": text(named["x-target-uri"]), "payload_bytes": len(payload) if payload is not None else int(size) if size.isdigit() else None, "payload_digest": told, "refers_to": text(named["x-refers-to-source-id"]), "payload": payload}


def _one(file: _File, start: int) -> tuple[dict, int]:
    """The record at ``start`` and where the next one begins, or Damage."""
    if file.get(start, 3) == _GZIP:
        data, end = _member(file, start)
        head, gap, rest = data.partition(b"\r\n\r\n")
        if not gap:
            raise Damage("header does not end")
        fields = _header(head)
        n = _length(fields)
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise Damage("length differs")
        return _checked(fields, rest[:n]), end
    if not _VERSION.match(file.get(start, 10)):
        raise Damage("neither a member nor a version line")
    n, head = 1 << 12, b""
    while b"\r\n\r\n" not in head:
        if n > len(head) and head and start + len(head) >= file.size:
            raise Damage("header does not end")
        n *= 2
        head = file.get(start, n)
    head = head.partition(b"\r\n\r\n")[0]
    fields = _header(head)
    n, at = _length(fields), start + len(head) + 4
    if at + n + 4 > file.size:
        raise Damage("record ends early")
    block = file.get(at, n + 4)
    if block[n:] != b"\r\n\r\n":
        raise Damage("length differs")
    return _checked(fields, block[:n]), at + n + 4


def _next(file: _File, start: int) -> int:
    """The next place from ``start`` on that could begin a record; the file's end if there is none."""
    at = start
    while at < file.size:
        data = file.get(at, _READ)
        version = _VERSION.search(data)
        found = [i for i in (data.find(_GZIP), version.start() if version else -1) if i >= 0]
        if found:
            return at + min(found)
        if at + len(data) >= file.size:
            break
        at += len(data) - 9
    return file.size


def salvage(handle, size: int) -> Iterator[dict]:
    """Records and quarantined gaps of an archive, in order, with their places."""
    file, at = _File(handle, size), 0
    while at < size:
        try:
            found, end = _one(file, at)
            yield {"kind": "info" if found["record_type"] == "warcinfo" else "record", "start": at, "end": end, "reason": None} | found
            at = end
            continue
        except Damage as e:
            start, reason = at, str(e)
        at = _next(file, start + 1)
        while at < size:
            try:
                _one(file, at)
                break
            except Damage:
                at = _next(file, at + 1)
        yield {"kind": "gap", "start": start, "end": at, "reason": reason}


# --- tables ----------------------------------------------------------------------------------


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        attempt = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        made: list[list] = []
        out = None
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                if out is None or made[-1][2] >= limit:
                    if out is not None:
                        out.close()
                    name = f"{attempt}-{len(made):04d}.warc.gz"
                    made.append([f"{folder}/{name}", 0, 0])
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    info = _gzip(archive_info(name))
                    out.write(info)
                    made[-1][2] += len(info)
                data = _gzip(record(row["record_type"], row["source_id"], row["uri"], row["payload"] or b"", row["refers_to"], refers_uri=row["refers_uri"]))
                out.write(data)
                made[-1][1] += 1
                made[-1][2] += len(data)
        if out is not None:
            out.close()
        files, records, sizes = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row; gives the manifest ``file, records, bytes``."""
    need(pages, id_col, url_col, payload_col)
    folder = folder or fresh_path(pages.sparkSession, "warc")
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("source_id"), F.col(url_col).alias("uri"), F.encode(text, "utf-8").alias("payload"))
    rows = rows.withColumn("_digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    groups = written(rows.filter("_digest is not null").groupBy("_digest").agg(F.max("source_id").alias("_first"), F.max_by("uri", "source_id").alias("_first_uri"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "copies")
    typed = rows.join(maybe_broadcast(groups), "_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("source_id").eqNullSafe(F.col("_first"))
    typed = typed.select(F.when(again, "revisit").otherwise("response").alias("record_type"), "source_id", "uri", "payload", F.when(again, F.col("_first")).alias("refers_to"), F.when(again, F.col("_first_uri")).alias("refers_uri"))
    return written(typed.mapInArrow(_write(folder, archive_bytes), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in RECORDS.split(", ")]

    def block(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    for batch in batches:
        for uri in batch.column("file").to_pylist():
            fs, path = _open(uri)
            rows, held = [], 0
            with fs.open_input_file(path) as handle:
                for row in salvage(handle, handle.size()):
                    rows.append(row | {"file": uri})
                    held += len(row.get("payload") or b"")
                    if held >= 8 << 20 or len(rows) >= 1000:
                        yield block(rows)
                        rows, held = [], 0
            if rows:
                yield block(rows)


def read_archives(files: DataFrame, info: bool = False) -> DataFrame:
    """Records and gaps of the archives named by the column ``file``; see ``kind`` and ``reason``.

    Archives are dealt out by their number, a task for each up to READERS tasks.  ``info``: also the
    records that tell of the archives themselves.
    """
    need(files, "file")
    paths = files.select("file").filter("file is not null")
    found = paths.repartition(max(1, min(paths.count(), READERS))).mapInArrow(_read, RECORDS)
    return found if info else found.filter("kind <> 'info'")
