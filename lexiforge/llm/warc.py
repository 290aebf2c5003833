"""WARC archives: a writer with revisit records, and a salvage reader.

The reader takes archives whole or damaged, compressed by member or plain.  Where a member or record fails its checks
(gzip trailer, version line, header, length, block digest) it searches for the next valid member or version line,
goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, join_counted, scratch_path

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: A writer begins a new archive when one has grown to this many bytes.
ARCHIVE_BYTES = 16 << 20
#: Tasks that read the archives of a manifest, at most.
MOST_TASKS = 50_000
#: Date of the records: part of the data, so that a task that runs again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."


def base32_sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", base32_sha1(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit that keeps the HTTP header alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", base32_sha1(payload)),
        ("WARC-Refers-To", "" if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", "" if refers_to is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return make_record(kind, headers, http + payload if refers_to is None else http)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), block and end of the record at ``at``; ValueError if it fails a check."""
    if data[at : at + len(VERSION)] != VERSION:
        raise ValueError("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise ValueError("header without end")
    lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("malformed header line")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdecimal():
        raise ValueError("no content length")
    begin = head_end + 4
    end = begin + int(size)
    block = data[begin:end]
    if len(block) < int(size):
        raise ValueError("truncated block")
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record without end")
    stated = fields.get("warc-block-digest")
    if stated and stated.startswith("sha1:") and stated != base32_sha1(block):
        raise ValueError("block digest differs")
    return fields, block, end + 4


def read_member(data: bytes, at: int) -> tuple[bytes, int]:
    unpacker = zlib.decompressobj(31)
    try:
        plain = unpacker.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from e
    if not unpacker.eof:
        raise ValueError("truncated member")
    return plain, len(data) - len(unpacker.unused_data)


def opens_member(data: bytes, at: int) -> bool:
    """Whether a gzip member that begins with a version line stands at ``at``."""
    try:
        return zlib.decompressobj(31).decompress(memoryview(data)[at : at + 4096], 16).startswith(VERSION)
    except zlib.error:
        return False


def next_start(data: bytes, at: int) -> int:
    """The next place after ``at`` where a member or version line begins; the end of data if there is none."""
    member = data.find(MEMBER, at + 1)
    while member >= 0 and not opens_member(data, member):
        member = data.find(MEMBER, member + 1)
    line = data.find(b"\n" + VERSION, at)
    return min([x for x in (member, line + 1 if line >= 0 else -1) if x >= 0], default=len(data))


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """Every record and gap of an archive in order: (``record`` or ``gap``, offset, length, fields, block, reason)."""
    at = 0
    while at < len(data):
        try:
            if data[at : at + 3] == MEMBER:
                plain, end = read_member(data, at)
                inside, found = 0, []
                while inside < len(plain):
                    try:
                        fields, block, stop = parse_record(plain, inside)
                        found.append(("record", at, end - at, fields, block, ""))
                    except ValueError as e:
                        stop = next_start(plain, inside)
                        found.append(("gap", at, end - at, {}, plain[inside:stop], f"inside a member at {inside}: {e}"))
                    inside = stop
                yield from found
            else:
                fields, block, end = parse_record(data, at)
                yield "record", at, end - at, fields, block, ""
        except ValueError as e:
            end = next_start(data, at)
            yield "gap", at, end - at, {}, data[at:end], str(e)
        at = end


def with_decisions(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """``page_id, url, html, refers_to``: the response's page_id for records that become revisits."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    keyed = rows.select("page_id", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"), F.octet_length("html").alias("size"))
    keyed = keyed.filter((F.col("size") >= least) & F.col("page_id").isNotNull())
    known = cut(keyed.select("page_id", "digest"), "warc-digests")
    first = known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    # copies only; a page id that stands in several rows has one decision for each of its payloads
    revisits = join_counted(known, cut(first, "warc-copies"), ["digest"], "n").filter("refers_to is not null").select("page_id", "digest", "refers_to").filter(F.col("page_id") != F.col("refers_to")).distinct()
    own = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    return own.join(revisits, ["page_id", "digest"], "left").drop("digest")


MANIFEST = "archive string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``folder/*.warc.gz``, a member a record; returns the manifest ``archive, records, bytes``.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest id is the response and the others
    revisit it.  ``folder`` must be seen by all executors.  Archives are named after the attempt that wrote them, and the
    manifest lists those of the attempts that count: what a lost task leaves behind is in no manifest.
    """
    schema = to_arrow_schema(StructType.fromDDL(MANIFEST))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        store, base = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        done, out, name, records, size = [], None, "", 0, 0

        def close() -> None:
            out.close()
            store.move(f"{base}/{name}.tmp", f"{base}/{name}")
            done.append((name, records, size))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, records, size = f"pages-{part:06d}-{attempt}-{len(done):05d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}.tmp", compression=None)
                    head = gzip_member(make_record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(head)
                    size += len(head)
                data = gzip_member(page_record(page_id, url, html.encode(), refers_to))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    rows = with_decisions(pages, id_col, url_col, html_col, least).select("page_id", "url", "html", "refers_to")
    return cut(rows.mapInArrow(write, MANIFEST), "warc-manifest")


RECORDS = "archive string, offset long, length long, kind string, record_type string, page_id long, refers_to long, url string, payload binary, payload_bytes long, payload_digest string, reason string"


def number(value: str | None) -> int | None:
    tail = (value or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdecimal() else None


def page_rows(path: str, data: bytes, payload: bool) -> list[tuple]:
    """Rows of ``RECORDS`` of an archive: its pages' records and its gaps."""
    rows = []
    for kind, offset, length, fields, block, reason in salvage(data):
        if kind == "gap":
            rows.append((path, offset, length, kind, None, None, None, None, None, None, None, reason))
            continue
        record_type = fields.get("warc-type")
        if record_type not in ("response", "revisit"):
            continue
        http, _, body = block.partition(b"\r\n\r\n")
        if record_type == "response":
            size, digest = len(body), hashlib.sha1(body).hexdigest()
        else:
            stated = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(stated[0]) if stated else None
            digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
        rows.append((path, offset, length, kind, record_type, number(fields.get("warc-record-id")), number(fields.get("warc-refers-to")), fields.get("warc-target-uri"), body if payload else None, size, digest, None))
    return rows


def in_batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 1000], strict=True), schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records (kind ``record``) and quarantined gaps (kind ``gap``, with reason) of ``folder/*.warc.gz`` and ``*.warc``.

    Of a revisit, size and digest of the full payload come from its header fields.
    """
    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from in_batches(page_rows(path, content.as_py(), payload), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path", "content")
    return files.mapInArrow(read, RECORDS)


class LostRecords(ValueError):
    """An archive that does not hold the records that its manifest states."""


def read_listed(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """As ``read_archives``, of the archives that a manifest lists and no others.

    Raises, with the gaps' reasons, if an archive does not give the records that the manifest states.
    """
    schema = to_arrow_schema(StructType.fromDDL(RECORDS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        store, base = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, stated in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    rows = page_rows(name, f.read(), payload)
                if (found := sum(r[3] == "record" for r in rows)) != stated:
                    raise LostRecords(f"{name} gives {found} of {stated} records; gaps: {[(r[1], r[2], r[-1]) for r in rows if r[3] == 'gap'][:20]}")
                yield from in_batches(rows, schema)

    return manifest.select("archive", "records").repartition(max(1, min(MOST_TASKS, manifest.count()))).mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, as read back from archives.

    Defined results: null html is an empty payload; pages with a null id are always responses; rows that repeat the
    response's id and payload are responses too; an empty table writes and reads nothing; other columns are ignored.
    """
    folder = scratch_path(spark, "warc")
    records = read_listed(write_archives(pages, folder), folder, payload=False).filter("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
