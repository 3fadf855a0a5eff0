"""Legacy archive converter: ARC files to WARC files.

Pages are written as ARC archives (version 1 and 2, one gzip member per record). The converter parses the header line
that the archive's version prescribes, takes exactly the declared number of bytes, and synthesises what a WARC record
needs and ARC lacks: an identifier (a name-based UUID of archive and record), an ISO timestamp from the 14-digit date,
the record type and the digests. Of records with equal payloads of at least ``least_bytes`` the one with the largest
page id is a response and the others are revisits of it; all others are responses.

Every archive is converted by one task, in two passes over it: the first lists (digest, page id, place), a map-side
combined aggregate finds the response of each digest, and the second writes the records. Only narrow rows are
shuffled; a payload shared by a third of all pages is one row per task there. Files appear when complete, so a task
that runs again replaces its own file.

Nulls: a null body is an empty payload, a null address is written as ``unknown:``, and a null page id has no header of
its own and comes back as null (it is the response only if no page with that payload has an id). Of rows that repeat
the largest page id, the last in the archives is the response.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SharedFile, filesystem, raw, shared_folder, store, values

#: The field lists of the two ARC versions, and the WARC profile of revisits.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    least_bytes: int = 1000
    #: ARC versions, by turns over the archives.
    versions: tuple[int, ...] = (1, 2)
    #: Date of pages that carry none.
    date: str = "20200101000000"
    level: int = 3


def member(data: bytes, level: int) -> bytes:
    """One gzip member without a time, so that reruns give the same bytes."""
    return gzip.compress(data, level, mtime=0)


def arc_head(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 ledgerloom\n{' '.join(FIELDS[version])}\n\n".encode()
    line = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain"}
    return arc_line(line, version, len(body)) + body + b"\n"


def arc_line(found: dict[str, str], version: int, length: int) -> bytes:
    line = {**found, "Archive-length": str(length)}
    return (" ".join(line.get(f, "-") for f in FIELDS[version]) + "\n").encode()


def http(page_id: int | None, payload: bytes) -> bytes:
    number = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + number + b"Content-Length: %d\r\n\r\n" % len(payload)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    body: bytes
    head: bytes

    @property
    def payload(self) -> bytes:
        return self.body[len(self.head) :]


class ArcError(ValueError):
    """The archive does not follow its own header lines."""


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of one archive after its version block."""
    version = None
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").split()
        # The first record describes the file in the version-1 shape or in its own; its block names the version.
        names = FIELDS[version] if version else FIELDS[1] if len(parts) == len(FIELDS[1]) else FIELDS[2]
        if len(parts) != len(names):
            raise ArcError(f"expected {len(names)} header fields, found {len(parts)}")
        found = dict(zip(names, parts))
        if not found["Archive-length"].isdigit():
            raise ArcError("the declared length is not a number")
        length = int(found["Archive-length"])
        body = stream.read(length)
        if len(body) != length:
            raise ArcError("the archive ends before the declared length")
        if version is None:
            version = int(body.split(None, 1)[0])
            if version not in FIELDS:
                raise ArcError(f"unknown version {version}")
            continue
        end = body.find(b"\r\n\r\n")
        yield ArcRecord(found["URL"], found["IP-address"], found["Archive-date"], body, body[: end + 4] if end >= 0 else b"")


def header_value(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb": *([^\r\n]*)", head)
    return found[1].decode() if found else None


def opened(path: str) -> BinaryIO:
    where, name = filesystem(path)
    return gzip.GzipFile(fileobj=where.open_input_stream(name, compression=None))


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{n}')}>"


def sha1_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(archive: str, n: int, record: ArcRecord, refers: tuple[str, int, int | None] | None) -> bytes:
    """The WARC record of an ARC record; ``refers``: (archive, number, page id) of the response that it revisits."""
    block = record.head if refers else record.body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(archive, n)}",
        f"WARC-Date: {iso(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: {sha1_name(record.payload)}",
        f"WARC-Block-Digest: {sha1_name(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(*refers[:2])}"]
        if refers[2] is not None:
            lines.append(f"X-Refers-To-Page-Id: {refers[2]}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        head = [line]
        while (line := stream.readline()).strip():
            head.append(line)
        header = b"".join(head)
        yield header, stream.read(int(header_value(header, b"Content-Length")))


def write_arcs(pages: DataFrame, folder: str, shape: Archive) -> DataFrame:
    """``pages``: (page_id, url, body). One archive per partition; a stored table (archive, records)."""

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, count = None, 0
        part = TaskContext.get().partitionId()
        version, name = shape.versions[part % len(shape.versions)], f"part-{part:06d}.arc.gz"
        for batch in batches:
            for page, url, body in zip(values(batch, "page_id"), values(batch, "url"), raw(batch, "body")):
                if file is None:
                    file = SharedFile(folder, name)
                    file.write(member(arc_head(name, version, shape.date), shape.level))
                payload = body or b""
                content = http(page, payload) + payload
                safe = quote(url, safe="".join(map(chr, range(33, 127)))) if url else "unknown:"
                line = {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": shape.date, "Content-type": "text/html", "Result-code": "200", "Filename": name}
                file.write(member(arc_line(line, version, len(content)) + content + b"\n", shape.level))
                count += 1
        if file:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count])], ["archive", "records"])

    return store(pages.mapInArrow(written, "archive string, records long"), "arc-manifest")


def list_records(archives: DataFrame, shape: Archive) -> DataFrame:
    """(archive, n, page_id, size, digest) of every ARC record, in one task per archive."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in values(batch, "archive"):
                rows = []
                for n, record in enumerate(read_arc(opened(archive))):
                    page = header_value(record.head, b"X-Page-Id")
                    payload = record.payload
                    rows.append((archive, n, None if page is None else int(page), len(payload), hashlib.sha1(payload).digest()))
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                if rows:
                    yield pa.RecordBatch.from_arrays(arrays, ["archive", "n", "page_id", "size", "digest"])

    return spread(archives).mapInArrow(listed, "archive string, n long, page_id long, size long, digest binary")


def spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, files.count()))


def convert(archives: DataFrame, folder: str, shape: Archive = Archive()) -> DataFrame:
    """Write one WARC file per ARC archive; a stored table (warc, records)."""
    records = store(list_records(archives, shape), "arc-records")
    large = records.where(F.col("size") >= shape.least_bytes)
    lead = F.max(F.struct("page_id", "archive", "n")).alias("lead")
    leads = large.groupBy("digest", "size").agg(lead, F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisits = large.join(leads, ["digest", "size"]).where((F.col("lead.archive") != F.col("archive")) | (F.col("lead.n") != F.col("n")))
    # Every archive has a row, so that archives without revisits are converted too.
    marks = revisits.select("archive", "n", "lead").unionByName(archives.select("archive"), allowMissingColumns=True)

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"archive": None}

        def finish(upto: int | None = None, refers: tuple | None = None) -> None:
            """Write the records before ``upto`` as responses and that one as a revisit; all if there is none."""
            for n, record in state["records"]:
                mark = refers if n == upto else None
                state["file"].write(member(warc_record(state["archive"], n, record, mark), shape.level))
                state["count"] = n + 1
                if n == upto:
                    return

        def close() -> pa.RecordBatch:
            finish()
            state["file"].close()
            return pa.RecordBatch.from_arrays([pa.array([state["path"]]), pa.array([state["count"]])], ["warc", "records"])

        for batch in batches:
            for archive, n, lead in zip(*(values(batch, c) for c in ("archive", "n", "lead"))):
                if archive != state["archive"]:
                    if state["archive"]:
                        yield close()
                    name = archive.rsplit("/", 1)[1].replace(".arc.gz", ".warc.gz")
                    state = {
                        "archive": archive,
                        "records": enumerate(read_arc(opened(archive))),
                        "file": SharedFile(folder, name),
                        "path": f"{folder}/{name}",
                        "count": 0,
                    }
                if n is not None:
                    finish(n, (lead["archive"], lead["n"], lead["page_id"]))
        if state["archive"]:
            yield close()

    dealt = marks.repartition(max(1, archives.count()), "archive").sortWithinPartitions("archive", "n")
    return store(dealt.mapInArrow(written, "warc string, records long"), "warc-manifest")


def read_back(warcs: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every WARC record. The payload of a
    response is hashed anew and must agree with its header; a revisit has its figures in its headers."""

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in values(batch, "warc"):
                rows = []
                for header, block in read_warc(opened(path)):
                    head = block[: block.find(b"\r\n\r\n") + 4]
                    kind, claimed = header_value(header, b"WARC-Type"), header_value(header, b"WARC-Payload-Digest")
                    size = int(header_value(head, b"Content-Length"))
                    if kind == "response" and (sha1_name(block[len(head) :]) != claimed or len(block) - len(head) != size):
                        raise ValueError(f"{path}: a payload does not agree with its record")
                    digest = base64.b32decode(claimed.removeprefix("sha1:")).hex()
                    rows.append((number(header_value(head, b"X-Page-Id")), size, digest, kind, number(header_value(header, b"X-Refers-To-Page-Id"))))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [c.split()[0] for c in schema.split(", ")]
    return spread(warcs).mapInArrow(read, schema)


def archive_pages(
    pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", folder: str | None = None, shape: Archive = Archive()
) -> DataFrame:
    """Write the pages as ARC archives, convert them to WARC and read those back."""
    folder = folder or shared_folder(pages.sparkSession, "archives")
    picked = pages.select(pages[key].cast("long").alias("page_id"), pages[url].alias("url"), pages[body].alias("body"))
    return read_back(convert(write_arcs(picked, f"{folder}/arc", shape), f"{folder}/warc", shape))


