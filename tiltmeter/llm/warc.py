"""Web archives packed in ZIP files: written by Spark tasks, read back through the ZIP directories without extraction.

An archive is a ZIP file whose members are stored, not compressed: ``archive/*.warc.gz`` with one gzip member per
record, and ``indexes/*.cdx`` with one line per record (offset and length inside its archive member). The reader takes
the end of the file, follows the central directory (or its ZIP64 form), finds where the stored members lie, splits the
index into record ranges, spreads those over the cluster and reads each range on its own.

Paths go through pyarrow's file systems, so archives may lie wherever pyarrow can reach.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.llm.common import short_batches, text_column, written
from tiltmeter.session import checkpoint_dir

#: Payloads below this many bytes are never replaced by a reference.
REVISIT_BYTES = 100
#: An archive is closed beyond this many bytes.
ARCHIVE_BYTES = 256 << 20
GZIP_LEVEL = 3
#: Index lines and records are read in ranges of about so many bytes.
RANGE_BYTES = 4 << 20

END, END64_LOCATOR, END64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# ---------------------------------------------------------------- ZIP


class ZipWriter:
    """Stored members written one after the other; the sizes follow in a descriptor, so nothing is held back.

    ``zip64`` writes the wide directory records even where the narrow ones would do.
    """

    def __init__(self, sink, zip64: bool = False) -> None:
        self.sink, self.zip64, self.at, self.entries = sink, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.entries.append([raw, self.at, 0, 0])
        # Wide local sizes announce that the descriptor holds eight-byte fields.
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8 | 0x800, 0, 0, 33, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        entry = self.entries[-1]
        entry[2] = zlib.crc32(data, entry[2])
        entry[3] += len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.entries[-1]
        self._put(b"PK\7\10" + struct.pack("<IQQ", crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.entries:
            wide = self.zip64 or size >= FULL32 or offset >= FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            narrow = (FULL32, FULL32, FULL32) if wide else (size, size, offset)
            head = struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8 | 0x800, 0, 0, 33, crc, *narrow[:2], len(raw), len(extra), 0, 0, 0, 0, narrow[2])
            self._put(CENTRAL + head + raw + extra)
        size, n, end = self.at - start, len(self.entries), self.at
        if self.zip64 or n >= FULL16 or start >= FULL32 or size >= FULL32:
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(END64_LOCATOR + struct.pack("<IQI", 0, end, 1))
            n, size, start = FULL16, FULL32, FULL32
        self._put(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def read_at(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    return source.read(length)


def zip_members(source, size: int) -> list[tuple[str, int, int, int]]:
    """(name, offset of the data, length, crc) of the stored members, from the directory at the end of the file."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read_at(source, tail_at, size - tail_at)
    place = tail.rfind(END)
    while place >= 0 and (place + 22 > len(tail) or place + 22 + struct.unpack_from("<H", tail, place + 20)[0] != len(tail)):
        place = tail.rfind(END, 0, place)
    if place < 0:
        raise ValueError("no end of a ZIP directory")
    n, length, start = struct.unpack_from("<HII", tail, place + 10)
    if FULL16 == n or FULL32 in (length, start):
        at = tail_at + place - 20
        locator = read_at(source, at, 20) if at >= 0 else b""
        if locator[:4] == END64_LOCATOR:
            record = read_at(source, struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ValueError("the ZIP64 locator points at something else")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, members, at = read_at(source, start, length), [], 0
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("a broken entry of the ZIP directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        crc, packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIIHHH", directory, at + 16)
        (offset,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        packed, plain, offset = _widened(extra, packed, plain, offset)
        at += 46 + name_n + extra_n + comment_n
        if method or flags & 1 or packed != plain:
            continue  # compressed or encrypted members cannot be read by range
        local = read_at(source, offset, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no member where the directory says: {name}")
        members.append((name, offset + 30 + sum(struct.unpack_from("<HH", local, 26)), plain, crc))
    return members


def _widened(extra: bytes, packed: int, plain: int, offset: int) -> tuple[int, int, int]:
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            place = at + 4
            if plain == FULL32:
                (plain,), place = struct.unpack_from("<Q", extra, place), place + 8
            if packed == FULL32:
                (packed,), place = struct.unpack_from("<Q", extra, place), place + 8
            if offset == FULL32:
                (offset,) = struct.unpack_from("<Q", extra, place)
            break
        at += 4 + length
    return packed, plain, offset


# ---------------------------------------------------------------- records


def _clean(value) -> str:
    return "".join(" " if c in "\r\n" else c for c in str(value))


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A response, or a revisit that keeps the HTTP head (with the length of the payload) and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    body = http if revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record; the payload of a revisit is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    web = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
    page = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") if name in fields else ""
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": int(page("warc-record-id")) if page("warc-record-id") else None,
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": int(page("warc-refers-to")) if page("warc-refers-to") else None,
        "payload": None if revisit else payload,
        "payload_bytes": int(web["content-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
    }


# ---------------------------------------------------------------- Spark


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Write a record per row of ``page_id, url, html`` and return the archives: ``path``, ``size``, ``records``.

    Of rows with equal payloads of at least REVISIT_BYTES bytes the one with the smallest page_id is the response and
    the others are revisits of it; rows that repeat this very page_id are responses too. NULL html is an empty payload,
    a NULL url is left out, a NULL page_id never becomes what others refer to unless all of the group are NULL, in
    which case all are responses. No rows, no archives. Other columns are not read. A task that is run again writes
    under another name; only archives in the returned table count.
    """
    short_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", text_column(pages, "html").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    first = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    marked = rows.join(first, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    marked = marked.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "size", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        done, archive = [], None
        for batch in batches:
            for page_id, url, html, digest, size, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if archive is None:
                    archive = _Archive(system, base, zip64)
                archive.add(page_id, url, (html or "").encode(), digest, size, refers_to)
                if archive.zip.at > archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "size", "records"])

    return written(marked.mapInArrow(write, "path string, size long, records long"))


class _Archive:
    def __init__(self, system, base: str, zip64: bool) -> None:
        system.create_dir(base, recursive=True)
        self.path = f"{base.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        self.sink = system.open_output_stream(self.path)
        self.zip = ZipWriter(self.sink, zip64)
        self.zip.begin("archive/data.warc.gz")
        self.index, self.within = [], 0

    def add(self, page_id, url, payload: bytes, digest: str, size: int, refers_to) -> None:
        raw = gzip.compress(record_bytes(page_id, url, payload, digest, size, refers_to), GZIP_LEVEL, mtime=0)
        self.index.append(b"%012d %010d\n" % (self.within, len(raw)))
        self.zip.write(raw)
        self.within += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.zip.end()
        self.zip.begin("indexes/data.cdx")
        for at in range(0, len(self.index), 4096):
            self.zip.write(b"".join(self.index[at : at + 4096]))
        self.zip.end()
        self.zip.close()
        self.sink.close()
        return self.path, self.zip.at, len(self.index)


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``, ``size``: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload.

    The directory of each archive is read first and its index is cut into ranges of whole records; the ranges are then
    spread over the cluster. The digest and length of a response are those of the bytes read, of a revisit those in
    its head. Without ``payloads`` that column is left empty.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(path) as source:
                    members = {name: (at, length) for name, at, length, _ in zip_members(source, size)}
                    ranges = []
                    for name, (at, length) in members.items():
                        data = members.get(name.replace("indexes/", "archive/").replace(".cdx", ".warc.gz"))
                        if name.startswith("indexes/") and data:
                            ranges += [(path, *r) for r in _ranges(source, at, length, data[0], range_bytes)]
                for at in range(0, len(ranges), 1024):
                    columns = list(zip(*ranges[at : at + 1024]))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, start, lengths in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                with system.open_input_file(path) as source:
                    raw, at, rows = read_at(source, start, sum(lengths)), 0, []
                for length in lengths:
                    row = parse_record(gzip.decompress(raw[at : at + length]))
                    rows.append(row if payloads else row | {"payload": None})
                    at += length
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ranges = archives.select("path", "size").mapInArrow(locate, "path string, start long, lengths array<long>")
    # The ranges are few and small rows that stand for many bytes, so the number of their tasks is named: as many as
    # there are cores to use, or as keep a task to sixteen ranges.
    some = -(-(archives.agg(F.sum("size")).first()[0] or 0) // range_bytes)
    tasks = max(1, -(-some // 16), min(some, archives.sparkSession.sparkContext.defaultParallelism))
    ranges = ranges.repartition(tasks, F.col("path"), F.col("start"))
    return ranges.mapInArrow(
        fetch,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary",
    )


def _ranges(source, at: int, length: int, data_at: int, range_bytes: int) -> Iterator[tuple[int, list[int]]]:
    """Runs of records as (offset in the file, lengths), from index lines read piece by piece."""
    start, total, lengths, line = data_at, 0, [], 24
    for place in range(0, length, line * 65536):
        piece = read_at(source, at + place, min(line * 65536, length - place))
        for entry in piece.splitlines():
            offset, size = (int(x) for x in entry.split())
            if lengths and total + size > range_bytes:
                yield start, lengths
                total, lengths = 0, []
            if not lengths:
                start = data_at + offset
            lengths.append(size)
            total += size
    if lengths:
        yield start, lengths


def archive_folder(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/archives/{uuid.uuid4().hex}"
