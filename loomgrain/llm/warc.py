"""Operator 3: WARC archives: a writer with revisit records and a salvage reader.

The writer puts one gzip member a record into archives in the shared folder; each
task writes its own files and returns their names, and only names that a finished
task returned are read. The reader checks every record (gzip checksum, lengths,
digests), also where a gzip member has several. After a failed check it searches
for the next gzip member that starts with a version line and for the next version
line of a plain record, goes on from whichever comes first and reports the bytes
between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A header that does not end within this many bytes is damaged.
MAX_HEADER = 1 << 20
#: Bytes that the inflater is fed at once, so that what follows a member is not copied with it.
SLICE = 1 << 16
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_ID = re.compile(r"<urn:page:(-?\d+)>")

READ_SCHEMA = (
    "archive string, offset long, length long, gap string, record_type string, page_id long, target_uri string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit holds the HTTP header alone; its payload is in the record that it refers to."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if record_type == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


@dataclass
class Record:
    """A checked record and the number of bytes that it takes in its (decompressed) stream."""

    fields: dict[str, str]
    payload: bytes
    full_length: int
    size: int

    @property
    def digest(self) -> str:
        return self.fields.get("warc-payload-digest", "").removeprefix("sha1:")


def parse_record(data: bytes, at: int = 0) -> Record:
    """The record that starts at ``at``; ValueError says which check failed."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2, version.end() + MAX_HEADER)
    if end < 0:
        raise ValueError("header not ended")
    fields = _fields(data[version.end() : end])
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start, size = end + 4, int(fields["content-length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":  # nothing is copied before its length is known to fit
        raise ValueError("length does not fit")
    block = data[start : start + size]
    if (own := fields.get("warc-block-digest")) and own != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(_fields(http).get("content-length", len(payload)))
    if fields.get("warc-type") == "response":
        want = fields.get("warc-payload-digest")
        if want and want != f"sha1:{base32_sha1(payload)}":
            raise ValueError("payload digest does not fit")
        full = len(payload)
    return Record(fields, payload, full, start + size + 4 - at)


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member that starts at ``at`` and its compressed length; checksum and length are checked by zlib."""
    engine, out, end = zlib.decompressobj(31), [], at
    try:
        while not engine.eof and end < len(data):
            piece = data[end : end + SLICE]
            out.append(engine.decompress(piece))
            end += len(piece)
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not engine.eof:
        raise ValueError("gzip member not ended")
    return b"".join(out), end - at - len(engine.unused_data)


def _next_member(data: bytes, at: int, end: int) -> int:
    """Where the next gzip member of records may start, at or after ``at``; ``end`` if none does before it."""
    while (at := data.find(MAGIC, at, end + len(MAGIC) - 1)) >= 0:
        try:
            # enough to see the version line; the whole member is checked when it is read
            if _VERSION_LINE.match(zlib.decompressobj(31).decompress(data[at : at + 4096], 16)):
                return at
        except zlib.error:
            pass
        at += 1
    return end


def _inside(raw: bytes) -> list[Record | str]:
    """The records of one gzip member, with a reason for each gap between them; ValueError if none is good."""
    out: list[Record | str] = []
    at, good = 0, False
    while at < len(raw):
        try:
            record = parse_record(raw, at)
        except ValueError as e:
            if not out or not isinstance(out[-1], str):
                out.append(str(e))
            found = _VERSION_LINE.search(raw, at + 1)
            at = found.start() if found else len(raw)
            continue
        out.append(record)
        at += record.size
        good = True
    if not good:
        raise ValueError(out[0] if out else "no version line")
    return out


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(offset, length, record) of each good record and (offset, length, reason) of each quarantined gap.

    Offsets and lengths are bytes of the archive as stored; together they cover all of it.
    Of several records or gaps inside one gzip member the last has its length and the others have 0.
    The time is in proportion to the archive: each record is copied once, and each search goes on
    from where the one before it ended.
    """
    view, at = memoryview(data), 0
    bad_from, reason = -1, ""
    line = -1  # the next version line of a plain record, as far as it was searched
    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                raw, size = _member(view, at)
                found = _inside(raw)
            elif not _VERSION_LINE.match(data, at):
                raise ValueError("no gzip member" if data[:2] == MAGIC[:2] else "no version line")
            else:
                found = [parse_record(data, at)]
                size = found[0].size
        except ValueError as e:
            if bad_from < 0:
                bad_from, reason = at, str(e)
            if line <= at:
                m = _VERSION_LINE.search(data, at + 1)
                line = m.start() if m else len(data)
            at = _next_member(data, at + 1, line)
            continue
        if bad_from >= 0:
            yield bad_from, at - bad_from, reason
            bad_from = -1
        for k, x in enumerate(found, 1):
            yield at, size if k == len(found) else 0, x
        at += size
    if bad_from >= 0:
        yield bad_from, len(data) - bad_from, reason


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def mark_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, refers_to: of equal payloads the largest page_id is the response.

    Payloads of fewer than ``min_payload`` bytes are all responses, and so are rows
    that repeat the largest page_id and, if all page_ids of a payload are null, all its rows.
    """
    own = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("key", F.unhex(F.sha2("payload", 256)))
    # only payloads that repeat have anything to refer to; a written table lets the join deal the
    # pages anew and split a payload that half of them share
    first = own.groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select("key", "first"), "warc-repeated")
    again = (F.length("payload") >= min_payload) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return own.join(first, "key", "left").select(
        "page_id", "url", "payload",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, path: str, roll_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``records`` (page_id, url, payload, record_type, refers_to) below ``path``.

    Returns a written table with one row for each committed archive: archive, records, bytes.
    ``roll_bytes`` bounds the uncompressed size of an archive up to its last record.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        done: list[tuple[str, int, int]] = []
        out, name, count, raw, size = None, "", 0, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{path}/{name}", count, size))
            out = None

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(k)[i].as_py() for k in range(5)]
                data = build_record(*row, date)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name, count, raw, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(data) + packer.flush()
                out.write(packed)
                count, raw, size = count + 1, raw + len(data), size + len(packed)
                if raw >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict(
            {"archive": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]},
            pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
        )

    chosen = records.select("page_id", "url", "payload", "record_type", "refers_to")
    return materialise(chosen.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(archives: DataFrame, with_payload: bool = True, tasks: int | None = None) -> DataFrame:
    """Records and gaps (READ_SCHEMA) of the archives named in column ``archive``.

    For a gap, ``gap`` has the reason and the record columns are null. An archive
    is read whole by one task, so its size bounds the task's memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, READ_SCHEMA.split(", "), strict=True)])

        def number(text: str | None) -> int | None:
            found = _ID.fullmatch(text or "")
            return int(found[1]) if found else None

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, where = _open(path)
                with fs.open_input_file(where) as f:
                    data = f.read()
                rows: list[tuple] = []
                held = 0
                for offset, length, r in salvage(data):
                    if isinstance(r, str):
                        rows.append((path, offset, length, r, *[None] * 7))
                    else:
                        body = r.payload if with_payload and r.fields.get("warc-type") != "revisit" else None
                        rows.append((path, offset, length, None, r.fields.get("warc-type"), number(r.fields.get("warc-record-id")), r.fields.get("warc-target-uri"),
                                     number(r.fields.get("warc-refers-to")), r.full_length, r.digest, body))
                        held += len(body or b"")
                    if held > 16 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    names = archives.select("archive")
    n = tasks or max(1, min(10_000, names.count()))
    return names.repartition(n).mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame, path: str | None = None, min_payload: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives and return what the salvage reader finds in them.

    page_id, payload_bytes and payload_digest (of the full payload, for revisits
    too), record_type, refers_to. A null html is an empty payload, a null url gives
    a record without target, a null page_id comes back as null. Every row gives a
    record, repeated ones too; empty tables give no rows; other columns are not
    read. Rows come back only from archives, so damage would show as missing rows
    and gaps.
    """
    path = path or scratch(pages.sparkSession, "warc")
    manifest = write_archives(mark_revisits(pages, min_payload), path, roll_bytes)
    found = read_archives(manifest, with_payload=False)
    return found.where("gap IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
