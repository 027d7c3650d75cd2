"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: pages with equal payloads of at least REVISIT_BYTES share one response record, that of the
largest page_id; the others become revisit records, which hold headers only. Each task writes its own files,
one gzip member a record, under names no other attempt uses, and returns what it wrote; only
listed files are read, so files of lost attempts do no harm.

Reading: files are cut into byte ranges. A task scans its range for gzip magic, accepts a
candidate only if it decodes to a WARC header, and owns the records that start in its range,
reading past its end to finish the last one. Records of any type and origin are read (warcinfo, request,
metadata and others too), header names in any case, SHA-1 digests in hexadecimal or base32. A record
follows the one before it at once; where it does not, where a record does not decode to its end or where a payload
does not match its digest, the file is damaged: this is an error, or with ``damaged='skip'`` such records are
left out or marked.

Defined results: a null html is an empty payload; a null url has no target header; null page ids
are kept, and count as smallest when a response is chosen; of repeated rows with the largest page_id exactly
one is the response; an empty table gives no rows. Only page_id, url and html are read. Of a record from
elsewhere page_id and refers_to are null (record_id and refers_to_id say which it is); the payload of an HTTP message is
what follows its head, that of any other record its block; a revisit has no payload, and payload_bytes
from its HTTP head, null without; a payload digest that is missing or of another kind is replaced by the SHA-1 of
the payload, or null for a revisit. Files are reached through pyarrow's file systems, by the URI of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm.common import bounded_join, scratch_path, store

REVISIT_BYTES = 1000
#: A file is closed after so many bytes, and read in ranges of so many.
FILE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
READ_TASKS = 10_000
MAGIC, STEP = b"\x1f\x8b\x08", 1 << 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def _page_id(record_id: str) -> int | None:
    own = re.fullmatch(r"<urn:page:(-?\d*):\d+>", record_id or "")
    return int(own[1]) if own and own[1] else None


def record(page_id, row, url, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC record; ``refers``: the record id of the response for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_record_id(page_id, row)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers:
        head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, file_bytes: int):
    def write(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, written, records = None, 0, 0
        for batch in batches:
            for page_id, row, url, html, digest, ref_id, ref_row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, written, records = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                refers = _record_id(ref_id, ref_row) if ref_row is not None and ref_row != row else None
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(record(page_id, row, url, (html or "").encode(), digest, refers)) + deflate.flush()
                out.write(member)
                written, records = written + len(member), records + 1
                if written >= file_bytes:
                    out.close()
                    yield pa.record_batch([[f"{folder}/{name}"], [written], [records]], names=["path", "bytes", "records"])
                    out = None
        if out is not None:
            out.close()
            yield pa.record_batch([[f"{folder}/{name}"], [written], [records]], names=["path", "bytes", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; a table of path, bytes, records, one row per file."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    rows = store(rows, "pages")
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("has_id"), "page_id", "row"))
    equal = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(last.alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
    equal = store(equal.select("digest", "n", F.col("r.page_id").alias("ref_id"), F.col("r.row").alias("ref_row")), "equal")
    joined = bounded_join(rows, equal, "digest", "n")
    ready = joined.select("page_id", "row", "url", "html", "digest", "ref_id", "ref_row")
    return store(ready.mapInArrow(_writer(folder, file_bytes), "path string, bytes long, records long"), "manifest")


class Damaged(ValueError):
    """A file that does not hold what it should."""


def _begins(piece: bytes) -> bool:
    """Whether a gzip member begins here whose first bytes are a WARC header's. No more is decoded, so
    damage further on does not hide it."""
    try:
        return zlib.decompressobj(31).decompress(piece, 5) == b"WARC/"
    except zlib.error:
        return False


def members(source, size: int, start: int, end: int, strict: bool = False):
    """The decoded gzip members of a WARC file that start in [start, end).

    With ``strict`` a record that does not decode to its end and bytes between records are errors.
    """
    data = source.read_at(min(size, end + len(MAGIC)) - start, start)
    at, due = 0, 0 if strict and start == 0 else None  # due: where the next record must start
    while (at := data.find(MAGIC, at)) >= 0 and start + at < end:
        if not _begins(data[at : at + STEP] if len(data) - at >= STEP else source.read_at(min(STEP, size - start - at), start + at)):
            at += 1
            continue
        inflate, out, fed = zlib.decompressobj(31), bytearray(), 0
        try:
            while not inflate.eof:
                piece = data[at + fed : at + fed + STEP] or source.read_at(min(STEP, size - start - at - fed), start + at + fed)
                if not piece:
                    raise zlib.error("cut off")
                fed += len(piece)
                out += inflate.decompress(piece)
        except zlib.error as error:
            if strict:
                raise Damaged(f"record at byte {start + at}: {error}") from error
            at += 1
            continue
        if strict and due is not None and at != due:
            raise Damaged(f"no record from byte {start + due} to {start + at}")
        yield bytes(out)
        at += fed - len(inflate.unused_data)
        due = at if strict else None
    if strict and due is not None and start + due < min(size, end):
        raise Damaged(f"no record from byte {start + due} on")
    # The next range's first record must follow the last one here.
    if strict and due is not None and end <= start + due < size and not _begins(source.read_at(min(STEP, size - start - due), start + due)):
        raise Damaged(f"no record at byte {start + due}")


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Fields by lower-cased name; a line that begins with white space goes on with the one before."""
    fields, name = {}, ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += " " + line.decode("utf-8", "replace").strip()
        elif b":" in line:
            name, value = (x.strip() for x in line.decode("utf-8", "replace").split(":", 1))
            name = name.lower()
            fields[name] = value
    return fields


def _sha1(digest: str | None) -> str | None:
    """A SHA-1 digest in hexadecimal from a labelled one in hexadecimal or base32; None for another kind."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def parse(member: bytes) -> dict:
    """The fields of a WARC record; digest_ok: whether the payload has its digest, None if that can't be told."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = _headers(head.split(b"\r\n")[1:])
    size, record_id, kind = int(fields.get("content-length", len(rest))), fields.get("warc-record-id"), fields.get("warc-type", "")
    if len(rest) < size:
        raise Damaged(f"record {record_id} has {len(rest)} bytes of {size}")
    block = rest[:size]
    http, payload = {}, block
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(top.split(b"\r\n")[1:])
    digest, ok, n = _sha1(fields.get("warc-payload-digest")), None, None
    if kind == "revisit":
        payload, stated = None, http.get("content-length", "")
        n = int(stated) if stated.isdigit() else None
    else:
        own, n = hashlib.sha1(payload).hexdigest(), len(payload)
        # Some writers take the digest of a chunked or cut payload before, some after that.
        if digest and "transfer-encoding" not in http and "warc-truncated" not in fields:
            ok = own == digest
        digest = digest or own
    refers = fields.get("warc-refers-to")
    return {
        "page_id": _page_id(record_id), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": _page_id(refers), "url": fields.get("warc-target-uri"),
        "record_id": record_id, "refers_to_id": refers, "date": fields.get("warc-date"), "digest_ok": ok, "payload": payload,
    }


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, refers_to_id string, date string, digest_ok boolean, path string, payload binary"
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _reader(schema: str, strict: bool):
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def read(batches):
        for batch in batches:
            for path, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as source:
                    rows, held = [], 0
                    try:
                        for member in members(source, size, start, end, strict):
                            try:
                                rows.append(parse(member) | {"path": path})
                            except Damaged:
                                if strict:
                                    raise
                                continue
                            if strict and rows[-1]["digest_ok"] is False:
                                raise Damaged(f"payload of {rows[-1]['record_id']} does not match its digest")
                            held += len(member)
                            if held >= STEP * 64:
                                yield pa.RecordBatch.from_pylist(rows, schema=fields)
                                rows, held = [], 0
                    except Damaged as error:
                        raise Damaged(f"{path}: {error}") from error
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return read


def read_archives(manifest: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES, damaged: str = "raise") -> DataFrame:
    """The records of the files in ``manifest`` (path, bytes). Damaged files are errors, or with
    damaged='skip' what can be read of them is given."""
    if damaged not in ("raise", "skip"):
        raise ValueError(f"damaged: {damaged}")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.select("path", "bytes", starts.alias("start"))
    ranges = ranges.select("path", "bytes", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    schema = RECORDS if with_payload else RECORDS.removesuffix(", payload binary")
    # A range a task, up to READ_TASKS: without a number Spark would merge these few bytes of rows into one task.
    tasks = min(max(1, ranges.count()), READ_TASKS)
    return ranges.repartition(tasks, "path", "start").mapInArrow(_reader(schema, damaged == "raise"), schema)


def checked(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` stored, if each file gave as many as ``manifest`` says; else an error."""
    records = store(records, "records")
    found = records.groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    short = manifest.join(found, "path", "left").where(F.coalesce("found", F.lit(0)) != F.col("records")).first()
    if short is not None:
        raise Damaged(f"{short.path} holds {short.found or 0} of {short.records} records")
    return records


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record read back."""
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    records = checked(manifest, read_archives(manifest, with_payload=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""
