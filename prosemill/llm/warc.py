"""WARC archives: writer, normaliser of monolithic gzip files, and reader.

``write_archives`` writes one record per row into archives that are each one
gzip stream, as many crawlers and re-packers leave them: such a file can only be
read from its start. ``normalise`` inflates the whole stream once, rewrites
every record as a gzip member of its own and writes a sidecar index of offsets
beside it. ``read_archives`` takes the index and reads members one at a time,
checks digests, and gives the records as rows.

Records with equal payloads (of at least ``min_bytes``) are written once: the
row with the largest id is a response, the others are revisits that refer to it.

Scale: archives have a bounded size and each is one task's work; inflating and
rewriting are streams of ``STEP`` bytes, so memory does not grow with an archive
but with its largest record. Payloads do not meet for deduplication: digests are
grouped with partial aggregation, and rows meet their group's largest id in a
join whose hot keys can be split. Files are written under names of the task
attempt and only those that a finished task reports are used, so lost executors
and repeated attempts do no harm. The folder is the shared one; it is reached by
its URI, in whatever store it is.

Defined results: a null payload is an empty one; rows that tie at the largest id
are all responses; a null id never is the largest unless the group has no other;
white space in urls is escaped; a record that is damaged raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .shared import new_folder, written

STEP = 1 << 20
_END = b"\r\n\r\n"


@dataclass(frozen=True)
class WarcRules:
    #: Payload bytes after which an archive is closed.
    archive_bytes: int = 64 << 20
    #: Payloads of fewer bytes are never revisits.
    min_bytes: int = 0
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def record(kind: str, row_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record with its closing blank lines."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{row_id} {url} {digest}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-Id: {'' if row_id is None else row_id}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _END + block + _END


def marked_revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows (id, url, payload) with their group's largest id (``first``, null where the payload stands alone)."""
    keyed = rows.withColumn("key", F.sha1("payload"))
    groups = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null").select("key", "first")
    return keyed.join(groups, "key", "left").select("id", "url", "payload", F.when(F.octet_length("payload") >= min_bytes, F.col("first")).alias("first"))


def write_archives(rows: DataFrame, folder: str, rules: WarcRules | None = None) -> DataFrame:
    """Write (id, url, payload, first) rows; returns a manifest of ``path``, ``records``, ``bytes``. Lazy: each run writes new files."""
    rules = rules or WarcRules()

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        task = f"{context.partitionId()}-{context.taskAttemptId()}"
        part, out = 0, None
        made: list[tuple[str, int, int]] = []

        def finish():
            out.write(packer.flush())
            out.close()
            made.append((name, records, size))

        for b in T.chunks(batches, "payload"):
            for row_id, url, payload, first in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "first")), strict=True):
                if out is None:
                    name, part, records, size = f"mono-{task}-{part}.warc.gz", part + 1, 0, 0
                    out, packer = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(rules.level, wbits=31)
                data = payload.encode()
                kind = "response" if first is None or row_id == first else "revisit"
                out.write(packer.compress(record(kind, row_id, url, data, payload_digest(data), first, rules.date)))
                records, size = records + 1, size + len(data)
                if size >= rules.archive_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "records", "bytes"])

    return rows.select("id", "url", "payload", "first").mapInArrow(run, "path string, records bigint, bytes bigint")


def inflated(read) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in steps."""
    unpack = zlib.decompressobj(wbits=31)
    while data := read(STEP):
        while data:
            yield unpack.decompress(data, STEP)
            while unpack.unconsumed_tail:
                yield unpack.decompress(unpack.unconsumed_tail, STEP)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(wbits=31)
            elif not data:
                break


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.I)


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with their closing blank lines, from pieces of an inflated stream."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while len(held) >= max(need, 1):
            if not need:
                while held[:2] == b"\r\n":
                    del held[:2]
                end = held.find(_END)
                if end < 0:
                    break
                m = _LENGTH.search(held, 0, end + 2)
                if not held.startswith(b"WARC/") or m is None:
                    raise ValueError("not a WARC record")
                need = end + 4 + int(m[1]) + 4
                continue
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if need or held.strip():
        raise ValueError("the stream ends inside a record")


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive of ``manifest`` with one gzip member per record and a sidecar; returns ``path``, ``index``, ``records``."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            made = []
            for path in b.column("path").to_pylist():
                name = f"{path.removesuffix('.warc.gz').removeprefix('mono-')}-{attempt}.warc.gz"
                at, count = 0, 0
                with store.open_input_stream(f"{base}/{path}", compression=None) as source, store.open_output_stream(f"{base}/{name}", compression=None) as out, store.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for whole in records(inflated(source.read)):
                        packer = zlib.compressobj(level, wbits=31)
                        member = packer.compress(whole) + packer.flush()
                        out.write(member)
                        index.write(f"{at} {len(member)}\n".encode())
                        at, count = at + len(member), count + 1
                made.append((name, f"{name}.idx", count))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.int64())], names=["path", "index", "records"])

    return manifest.select("path").mapInArrow(run, "path string, index string, records bigint")


def parse_record(member: bytes) -> dict:
    """Fields of a record from its own gzip member; a response's digest is checked."""
    whole = zlib.decompress(member, wbits=31)
    head, _, rest = whole.partition(_END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_END)
    full = int(_LENGTH.search(b"\r\n" + http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != full or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    return {
        "page_id": int(fields["page-id"]) if fields["page-id"] else None,
        "url": fields["warc-target-uri"],
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": int(fields["refers-to-page"]) if revisit else None,
        "payload": None if revisit else payload,
    }


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of normalised archives, read member by member through their sidecars."""
    schema = _READ if payload else _READ.remove(6)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, sidecar in zip(b.column("path").to_pylist(), b.column("index").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{sidecar}", compression=None) as s:
                    places = [tuple(map(int, line.split())) for line in s.read().decode().splitlines()]
                with store.open_input_file(f"{base}/{path}") as source:
                    rows, size = [], 0
                    for at, length in places:
                        rows.append(parse_record(source.read_at(length, at)))
                        size += rows[-1]["payload_bytes"]
                        if size > STEP:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    text = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    return index.select("path", "index").mapInArrow(run, text)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: WarcRules | None = None) -> DataFrame:
    """Write the pages, normalise the archives, and read the records back (without payloads)."""
    rules = rules or WarcRules()
    spark = pages.sparkSession
    T.prepare(spark)
    folder = new_folder(spark, "warc")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    manifest = written(write_archives(marked_revisits(rows, rules.min_bytes), folder, rules), "manifest")
    archives = max(1, manifest.count())
    index = written(normalise(manifest.repartition(archives), folder, rules.level), "index")
    drop_archives(manifest, folder)
    return read_archives(index.repartition(archives), folder, payload=False)


def drop_archives(manifest: DataFrame, folder: str) -> None:
    """Delete the monolithic archives of a manifest, on the executors."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                if store.get_file_info(f"{base}/{path}").type == fs.FileType.File:
                    store.delete_file(f"{base}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    manifest.select("path").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
