"""WARC archives: write, normalise monolithic gzip files, read by offset index.

``write_archives`` writes one record per row into archives that are a single gzip stream
each, as crawlers without record-level compression leave them. ``normalise`` inflates such a
stream once, block by block, rewrites every record as a gzip member of its own and puts a
sidecar index (``<archive>.idx``, one JSON line per record: where its member starts, how long
it is, what it is) beside the new archive. ``read_records`` fetches any rows of that index by
seeking. Archives lie in a folder that driver and executors share; each task attempt writes
files of its own, and only those in a committed table of archives count, so lost executors
and repeated attempts leave nothing but files that nobody reads.

Defined results: a NULL payload is empty; a row without id has a record id of its own, reads
back without id and, among equal payloads, never is the one referred to (equal payloads
without any id are all responses); rows that repeat an id share its record id, and all rows
of the largest id of a group are responses; a NULL url has no target header and reads back
as NULL; control characters and spaces of a url are percent-encoded; other columns of the
input, whatever their names, are ignored; records are copied block by block, and a very long
one is held in its compressed form only, until it is known to be whole; an empty table gives no archive and no rows; a stream that ends or breaks
in the middle keeps its whole records and adds one index row of type ``damaged``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alloy.llm.common import HOT_SHARE, staged
from alloy.session import DEFAULT_BROADCAST_BYTES, FILE_TO_MEMORY, estimated_bytes

#: bytes of records after which a task begins its next archive
ARCHIVE_BYTES = 256 << 20
#: bytes read or inflated at a time
BLOCK = 1 << 16
#: bytes of payload that a reading task sends at a time
BATCH_BYTES = 8 << 20
#: index rows that a task sends at a time
ROWS = 4096
#: fixed values: the format's line end and the profile of records without payload
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, n_records long, n_bytes long"
INDEX = "archive string, offset long, length long, record_id string, type string, uri string, payload_digest string"
RECORDS = ("record_id string, type string, uri string, payload_digest string, refers_to string, payload_bytes long, "
           "payload binary")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared place, from inside a task."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def base32_digest(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ---- writing -------------------------------------------------------------------------
def record(kind: str, record_id: str, uri: str | None, digest: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One response, or one revisit: the headers of the answer without its payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + 2 * CRLF + block + 2 * CRLF


def with_originals(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` (id, url, payload, digest) and ``original``: the largest id of the rows with an
    equal payload of at least ``least_bytes`` bytes, NULL where nothing repeats.

    Digests that repeat are the only ones to be looked up. If they fit the broadcast bound,
    no payload moves; else the at most HOT_SHARE digests that hold 1/HOT_SHARE of all rows
    each are broadcast and the other rows meet the rest in a shuffle join."""
    groups = (rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
              .agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")))
    groups = staged(groups.filter((F.col("n") > 1) & F.col("original").isNotNull()), "repeats")
    if estimated_bytes(groups) * FILE_TO_MEMORY <= DEFAULT_BROADCAST_BYTES:
        return rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    total = rows.count()
    is_hot = F.col("n") * HOT_SHARE >= F.lit(total)
    hot, cold = F.broadcast(groups.filter(is_hot).drop("n")), groups.filter(~is_hot).drop("n")
    rest = rows.join(hot.select("digest"), "digest", "left_anti")
    return rows.join(hot, "digest").unionByName(rest.join(cold, "digest", "left"))


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``archive, n_records, n_bytes`` of the archives written below ``folder``, each one gzip
    stream. Of equal payloads the row with the largest id is a response, the others are
    revisits that refer to it."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = with_originals(rows.withColumn("digest", F.unhex(F.sha1("payload"))), least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        done = []
        for batch in batches:
            for page, url, payload, digest, original in zip(*(batch.column(k) for k in range(5)), strict=True):
                page, original, payload = page.as_py(), original.as_py(), payload.as_py()
                revisit = original is not None and original != page
                own = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
                raw = record("revisit" if revisit else "response", own, url.as_py(), base32_digest(digest.as_py()), payload,
                             f"urn:page:{original}" if revisit else None, date)
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, path = opened(name)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out, packer, count, size = system.open_output_stream(path, compression=None), zlib.compressobj(6, wbits=31), 0, 0
                out.write(packer.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "n_records", "n_bytes"), d, strict=True)) for d in done], pa.schema(
            [("archive", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return staged(rows.select("id", "url", "payload", "digest", "original").mapInArrow(run, ARCHIVES), "archives")


# ---- reading -------------------------------------------------------------------------
class Inflated:
    """The bytes of an archive: one gzip stream, several members in a row, or plain."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.buffer, self.ended, self.damaged = raw, b"", False, False
        first = raw.read(BLOCK)
        self.plain = not first.startswith(b"\x1f\x8b")
        self.unpacker = zlib.decompressobj(wbits=31)
        self.waiting = first

    def more(self) -> bool:
        """Add up to a block to the buffer; false at the end."""
        while not self.ended:
            waiting = self.waiting or self.raw.read(BLOCK)
            self.waiting = b""
            if not waiting:
                self.ended = True
                self.damaged |= not self.plain and not self.unpacker.eof
                return False
            if self.plain:
                self.buffer += waiting
                return True
            if self.unpacker.eof:  # the next member
                self.unpacker = zlib.decompressobj(wbits=31)
            try:
                fresh = self.unpacker.decompress(waiting, BLOCK)
            except zlib.error:
                self.ended = self.damaged = True
                return False
            self.waiting = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if fresh:
                self.buffer += fresh
                return True
        return False

    def upto(self, mark: bytes) -> bytes | None:
        """All up to the next ``mark`` and the mark; None if there is none."""
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                return None
        found, self.buffer = self.buffer[:at + len(mark)], self.buffer[at + len(mark):]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, block by block, or as many as there are."""
        while size:
            if not self.buffer and not self.more():
                return
            part, self.buffer = self.buffer[:size], self.buffer[size:]
            size -= len(part)
            yield part


def header_fields(head: bytes) -> dict[str, str]:
    """Names in lower case; of a name that repeats, the first."""
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


class Entry(NamedTuple):
    offset: int
    length: int
    record_id: str | None
    type: str
    uri: str | None
    payload_digest: str | None


def bare(identifier: str | None) -> str | None:
    return None if identifier is None else identifier.strip("<>")


def rewritten(source: Inflated, target: BinaryIO) -> Iterator[Entry]:
    """Copy each whole record of ``source`` to ``target`` as a member of its own."""
    offset = 0
    while True:
        while source.buffer.startswith(CRLF) or (len(source.buffer) < 2 and source.more()):
            if source.buffer.startswith(CRLF):
                source.buffer = source.buffer[2:]
        head = source.upto(2 * CRLF)
        if head is None:
            if source.buffer or source.damaged:
                yield Entry(offset, 0, None, "damaged", None, None)
            return
        fields = header_fields(head)
        size = fields.get("content-length", "")
        if not head.startswith(b"WARC/") or not size.isdecimal():
            yield Entry(offset, 0, None, "damaged", None, None)
            return
        packer = zlib.compressobj(6, wbits=31)
        # held back, compressed, until the record is known to be whole
        parts, left = [packer.compress(head)], int(size)
        for part in source.take(left):
            parts.append(packer.compress(part))
            left -= len(part)
        if left:
            yield Entry(offset, 0, None, "damaged", None, None)
            return
        parts += [packer.compress(2 * CRLF), packer.flush()]
        length = 0
        for packed in parts:
            target.write(packed)
            length += len(packed)
        yield Entry(offset, length, bare(fields.get("warc-record-id")), fields.get("warc-type", ""),
                    fields.get("warc-target-uri"), fields.get("warc-payload-digest"))
        offset += length


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """As many ranges of ``keys`` as there are archives, for a task each."""
    return df.repartitionByRange(max(1, df.agg(F.count_distinct("archive")).first()[0]), *keys)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The offset index of the archives named in column ``archive``, rewritten below ``folder``
    with one member per record; the same index lies beside each new archive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *(
            (c, pa.string()) for c in ("record_id", "type", "uri", "payload_digest"))])
        for old in (a for batch in batches for a in batch.column(0).to_pylist()):
            name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            (source, at), (target, to) = opened(old), opened(name)
            target.create_dir(to.rsplit("/", 1)[0], recursive=True)
            rows: list[dict] = []
            with source.open_input_stream(at, compression=None) as raw, target.open_output_stream(to, compression=None) as out, \
                    target.open_output_stream(to + ".idx", compression=None) as index:
                for entry in rewritten(Inflated(raw), out):
                    line = entry._asdict()
                    index.write(json.dumps(line).encode() + b"\n")
                    rows.append(line | {"archive": name})
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return staged(dealt(archives.select("archive"), "archive").mapInArrow(run, INDEX), "warc-index")


def parsed(member: bytes) -> dict:
    """A record from its gzip member; ``payload`` is NULL in a revisit, whose length its HTTP
    header tells."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(2 * CRLF)
    fields = header_fields(head)
    block = rest[:int(fields["content-length"])]
    found = {"record_id": bare(fields.get("warc-record-id")), "type": fields.get("warc-type", ""),
             "uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest"),
             "refers_to": bare(fields.get("warc-refers-to")), "payload_bytes": len(block), "payload": block}
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(2 * CRLF)
        told = header_fields(http).get("content-length", "")
        revisit = found["type"] == "revisit"
        found |= {"payload": None if revisit else payload,
                  "payload_bytes": int(told) if revisit and told.isdecimal() else len(payload)}
        if not revisit:
            digest = "sha1:" + base32_digest(hashlib.sha1(payload).digest())
            if found["payload_digest"] not in (None, digest):
                raise ValueError(f"record {found['record_id']}: payload does not have its digest")
            found["payload_digest"] = digest
    return found


def read_records(index: DataFrame) -> DataFrame:
    """The records that rows of an offset index (any of them) point to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.string()) for c in ("record_id", "type", "uri", "payload_digest", "refers_to")),
                            ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        handle = at = None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if archive != at:
                    if handle is not None:
                        handle.close()
                    system, path = opened(archive)
                    handle, at = system.open_input_file(path), archive
                handle.seek(offset)
                rows.append(parsed(handle.read(length)))
                held += rows[-1]["payload_bytes"]
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if handle is not None:
            handle.close()

    whole = index.filter(F.col("type") != "damaged")
    return dealt(whole.select("archive", "offset", "length"), "archive", "offset").mapInArrow(run, RECORDS)
