"""WARC archives: a writer with revisit records, and a reader that salvages what damaged files still hold.

Writing: equal payloads are stored once. The record of the largest id is the response; the others refer to it. Each
record is a gzip member of its own; tasks write files of about ``file_bytes`` straight to the shared folder and hand in
the names of finished files, so only files of committed tasks are ever read, whatever attempts died before.

Reading: a record is good if its header parses, its block has the stated length and end, and its block and payload
digests agree. Where this fails, the reader searches for the next gzip magic or version line at which a good record
starts, in the file and inside the unpacked bytes of a member, goes on there, and reports the bytes between as a gap.
Of a member that does not unpack, or whose checksum is wrong, records with an agreeing block digest are kept. What follows
a place where the packed stream itself cannot be read on is lost up to the next member, and reported. Plain and
packed records may alternate in a file. Memory: one record and two windows, whatever the length of files and members;
a very long text is one record.

Edge cases: a null text has an empty payload; rows that share the largest id of a payload are all responses; a null
id is a response only if its payload has no other id; an empty table gives no records; a file of noise is one gap.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlabel.llm.common import new_folder, store

_WINDOW = 1 << 20  # bytes of a file held at once
_PIECE = 1 << 16
_KEPT = 8 << 20  # a member of up to so many unpacked bytes is unpacked once, others twice
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d")
_FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+$")
_DEMANDED = ("warc-type", "warc-record-id", "warc-date")
_VERSION_START = re.compile(rb"WARC/\d")
_VERSION = re.compile(rb"WARC/\d+\.\d+$")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing ------------------------------------------------------------------------------------------------


def _header_value(text: str) -> str:
    """Line breaks and other control characters would end a header early."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit keeps the head of the HTTP message, with the full payload's length, and no payload."""
    digest = base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = "none" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_value(url) if url else f'urn:page:{name}'}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(record: bytes, level: int = 6) -> bytes:
    maker = zlib.compressobj(level, zlib.DEFLATED, 31)
    return maker.compress(record) + maker.flush()


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    least_bytes: int = 0,
    file_bytes: int = 64 << 20,
    date: str = "2020-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row; returns (path, bytes, records) of the files, in the shared folder.

    Payloads of fewer than ``least_bytes`` are always responses. Only payloads that occur twice are joined back, by
    digest; Spark broadcasts them if they are few and splits a payload that very many pages have otherwise.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text.cast("binary").alias("payload"))
    digests = pages.select(F.col(id_col).alias("id"), F.unhex(F.sha1(text.cast("binary"))).alias("digest"), F.octet_length(text).alias("n"))
    several = digests.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("k"))
    several = store(several.filter("k > 1 AND original IS NOT NULL").select("digest", "original"), "warc-originals")
    rows = rows.withColumn("own", F.unhex(F.sha1("payload"))).join(several, F.col("own") == F.col("digest"), "left")
    refers = F.when(F.col("id").eqNullSafe(F.col("original")), F.lit(None)).otherwise(F.col("original"))
    folder = new_folder(pages.sparkSession, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        context, files, out = TaskContext.get(), [], None
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        for table in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in table.columns)):
                if out is None:
                    files.append([f"{root}/{name}-{len(files):04d}.warc.gz", 0, 0])
                    out = system.open_output_stream(files[-1][0], compression=None)
                member = packed(record_bytes(page_id, url, payload, refers_to, date))
                out.write(member)
                files[-1][1] += len(member)
                files[-1][2] += 1
                if files[-1][1] >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files)], ["path", "bytes", "records"])

    written = rows.select("id", "url", "payload", refers.alias("refers_to")).mapInArrow(run, "path string, bytes long, records long")
    # the scheme of the folder goes with the paths, for readers elsewhere
    scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else ""
    return store(written.withColumn("path", F.concat(F.lit(scheme), "path")), "archive-files")


# --- reading ------------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """Why no good record starts here."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    payload: bytes = field(repr=False, default=b"")
    payload_bytes: int = 0


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at a place in ``data`` and the place after it; raises :class:`Damaged` if any check fails."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    first, *lines = data[at:end].split(b"\r\n")
    if not _VERSION.match(first):
        raise Damaged("no version line")
    headers = {}
    name = b""
    for line in lines:
        if name and line[:1] in (b" ", b"\t"):  # goes on from the line before
            headers[name.decode()] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        name = name.strip().lower()
        if not colon or not _FIELD.match(name) or _VERSION.match(line):
            raise Damaged("broken header line")
        headers[name.decode()] = value.strip().decode("utf-8", "replace")
    if not all(headers.get(x) for x in _DEMANDED):
        raise Damaged("demanded header is missing")
    if not headers.get("content-length", "").isdecimal():
        raise Damaged("no content length")
    begin, after = end + 4, end + 4 + int(headers["content-length"])
    if data[after : after + 4] != b"\r\n\r\n":
        raise Damaged("block without end")
    block = data[begin:after]
    if not _agrees(headers.get("warc-block-digest"), block):
        raise Damaged("block digest")
    record = Record(headers, block, block, len(block))
    if headers.get("content-type", "").startswith("application/http"):
        head, gap, body = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("no end of HTTP head")
        record.payload, record.payload_bytes = body, len(body)
        if headers.get("warc-type") == "revisit":
            stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            record.payload_bytes = int(stated[1]) if stated else 0
    if headers.get("warc-type") != "revisit" and not _agrees(headers.get("warc-payload-digest"), record.payload):
        raise Damaged("payload digest")
    return record, after + 4


def _agrees(stated: str | None, data: bytes) -> bool:
    """Whether a SHA-1 digest fits; other kinds of digest are not checked."""
    return not stated or not stated.startswith("sha1:") or stated[5:].upper() == base32_sha1(data)


@dataclass
class Stretch:
    """A record and where it was, or a gap (no record) and its reason. Inner places count unpacked bytes of a member."""

    offset: int
    length: int
    record: Record | None = None
    reason: str | None = None
    inner_offset: int | None = None
    inner_length: int | None = None


def read_record(read, at: int, size: int) -> tuple[Record, int]:
    """The record at a place of ``size`` bytes behind ``read(offset, n)``, and the place after it."""
    if read(at, 5) != b"WARC/":
        raise Damaged("no version line")
    head = b""
    while b"\r\n\r\n" not in head:
        chunk = read(at + len(head), _PIECE)
        if not chunk or len(head) > _WINDOW:
            raise Damaged("header without end")
        head += chunk
    length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,15})[ \t]*\r", head[: head.index(b"\r\n\r\n") + 1])
    if not length:
        raise Damaged("no content length")
    total = head.index(b"\r\n\r\n") + 8 + int(length[1])
    if at + total > size:
        raise Damaged("block without end")
    record, n = parse_record(head[:total] + read(at + len(head), max(0, total - len(head))))
    return record, at + n


def next_match(pattern: re.Pattern, read, at: int, size: int) -> int:
    """The first place from ``at`` on where a short pattern matches, or ``size``."""
    while at < size:
        m = pattern.search(read(at, _PIECE + 8))
        if m and m.start() < _PIECE:
            return at + m.start()
        at += _PIECE
    return size


class Unpacked:
    """The bytes of a gzip member, unpacked as far as they can be, read forwards in pieces.

    ``check`` goes through the member once: ``size`` bytes come out, ``stop`` is the place in the file where the member
    ends or cannot be unpacked any further, ``reason`` says why it is broken.
    """

    def __init__(self, read, at: int):
        self.file, self.begin = read, self._data_start(read, at)
        self.base, self.held, self.rest = 0, b"", None
        self.check()

    @staticmethod
    def _data_start(read, at: int) -> int:
        head = read(at, 1 << 17)
        if len(head) < 18 or head[2] != 8 or head[3] & 0xE0:
            raise Damaged("member without header")
        end = 10
        if head[3] & 4:
            end += 2 + int.from_bytes(head[10:12], "little")
        for flag in (8, 16):  # name, comment
            if head[3] & flag:
                end = head.find(b"\0", end) + 1
                if not end:
                    raise Damaged("member without header")
        return at + end + (2 if head[3] & 2 else 0)

    def _pieces(self) -> Iterator[bytes]:
        """Unpacked pieces; sets ``stop``, and ``reason`` if the packed bytes break off or make no sense."""
        maker, place, size, data = zlib.decompressobj(-15), self.begin, _PIECE, b""
        self.reason = None
        while not maker.eof:
            chunk = self.file(place, size)
            if not chunk and len(data) < _WINDOW:  # nor is output waiting
                self.reason = "member without end"
                break
            before = maker.copy()
            try:
                data = maker.decompress(chunk, _WINDOW)
            except zlib.error as e:
                if len(chunk) <= 1:
                    self.reason = f"member: {e}"
                    break
                maker, size = before, 256 if size > 256 else 1  # come as near to the damage as possible
                continue
            place += len(chunk) - len(maker.unused_data if maker.eof else maker.unconsumed_tail)
            yield data
        self.stop = place

    def check(self) -> None:
        crc, self.size, parts = 0, 0, []
        for piece in self._pieces():
            crc = zlib.crc32(piece, crc)
            self.size += len(piece)
            if self.size <= _KEPT:
                parts.append(piece)
        if not self.reason:
            end = self.file(self.stop, 8)
            if end == crc.to_bytes(4, "little") + (self.size & 0xFFFFFFFF).to_bytes(4, "little"):
                self.stop += 8
            else:
                self.reason = "member checksum"
        if self.size <= _KEPT:
            self.held = b"".join(parts)

    def read(self, at: int, n: int) -> bytes:
        """Bytes from a place that has not been passed by ``forget``."""
        end = min(at + n, self.size)
        if end > self.base + len(self.held):
            if self.rest is None:
                state = self.stop, self.reason
                self.rest = self._pieces()
                self.stop, self.reason = state
            parts, have = [self.held], self.base + len(self.held)
            while have < end:
                parts.append(next(self.rest))
                have += len(parts[-1])
            self.held = b"".join(parts)
        return self.held[at - self.base : max(end, at) - self.base]

    def forget(self, at: int) -> None:
        if at - self.base >= _WINDOW:
            self.base, self.held = at, self.held[at - self.base :]


class Salvage:
    """Records and gaps of one file, read through ``read(offset, n)``.

    A member that unpacks wholly gives every good record in it; bytes between them are gaps in unpacked bytes. Of a
    broken member the records count whose block digest is stated and agrees, before the damage and, if unpacking goes
    on, after it. The search for the next member begins right behind the start of a broken one, since damage may make
    it run into others; a record that it has already given is not given again.
    """

    def __init__(self, read, size: int):
        self._source, self.size = read, size
        self._from, self._held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Bytes of the file, through a window."""
        end = min(at + n, self.size)
        if at < self._from or end > self._from + len(self._held):
            self._from, self._held = at, self._source(at, max(n, _WINDOW))
        return self._held[at - self._from : max(end, at) - self._from]

    def _inside(self, at: int, data: Unpacked) -> Iterator[Stretch]:
        """Records and gaps in a member."""
        place, gap, length = 0, None, data.stop - at
        while place < data.size:
            try:
                record, after = read_record(data.read, place, data.size)
                if data.reason and not record.headers.get("warc-block-digest", "").startswith("sha1:"):
                    raise Damaged("record without digest in a broken member")
            except Damaged as e:
                gap = gap or (place, str(e))
                place = next_match(_VERSION_START, data.read, place + 1, data.size)
                data.forget(place)
                continue
            if gap:
                yield Stretch(at, length, None, gap[1], gap[0], place - gap[0])
                gap = None
            yield Stretch(at, length, record, None, place, after - place)
            place = after
            data.forget(place)
        if gap:
            yield Stretch(at, length, None, gap[1], gap[0], data.size - gap[0])

    def _at(self, place: int) -> tuple[Iterable[Stretch], int, str | None]:
        """What starts here, with at least one good record: its stretches (a list if plain), its end, why it is broken."""
        start = self.read(place, 5)
        if start == b"WARC/":
            record, after = read_record(self.read, place, self.size)
            return [Stretch(place, after - place, record)], after, None
        if not start.startswith(b"\x1f\x8b\x08"):
            raise Damaged("no member or version line")
        data = Unpacked(self.read, place)
        inside, first = self._inside(place, data), []
        for stretch in inside:
            first.append(stretch)
            if stretch.record:
                return itertools.chain(first, inside), data.stop, data.reason
        raise Damaged(data.reason or (first[0].reason if first else "empty member"))

    def stretches(self) -> Iterator[Stretch]:
        place, gap = 0, None  # start and reason of the gap that the place is in
        told, told_end = set(), 0  # records that a broken member has given, and where it stopped
        while place < self.size:
            try:
                found, after, reason = self._at(place)
                if isinstance(found, list) and place < told_end and found[0].record.headers["warc-record-id"] in told:
                    raise Damaged("record of a broken member, stored as it is")
            except Damaged as e:
                gap = gap or (place, str(e))
                place = next_match(_START, self.read, place + 1, self.size)
                continue
            if gap and gap[0] < place:
                yield Stretch(gap[0], place - gap[0], None, gap[1])
            gap = None
            if not reason:
                yield from found
                place = after
                continue
            told, told_end = set(), after
            for stretch in found:
                if stretch.record:
                    told.add(stretch.record.headers["warc-record-id"])
                yield stretch
            gap, place = (after, reason), next_match(_START, self.read, place + 1, self.size)
        if gap and gap[0] < self.size:
            yield Stretch(gap[0], self.size - gap[0], None, gap[1])

    def __iter__(self) -> Iterator[tuple[int, int, list[Record], str | None]]:
        """(offset, length, records, reason): a good record, or a gap with none and its reason."""
        for s in self.stretches():
            yield s.offset, s.length, [s.record] if s.record else [], s.reason


_SCHEMA = (
    "path string, offset long, length long, inner_offset long, inner_length long, gap string, record_type string, record_id string, refers_to string, uri string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the files in column ``path``, and their gaps (``gap`` has the reason, all else is null).

    A file is read by one task, a window at a time; the writer above keeps files to ``file_bytes``. ``offset`` and
    ``length`` are those of the gzip member or plain record in the file, or of the quarantined bytes; ``inner_offset``
    and ``inner_length`` are places in the unpacked bytes of the member, null outside of members.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def rows_of(path: str) -> Iterator[tuple]:
        system, place = pafs.FileSystem.from_uri(path)
        with system.open_input_file(place) as file:
            for s in Salvage(lambda at, n: file.read_at(n, at), file.size()).stretches():
                where = path, s.offset, s.length, s.inner_offset, s.inner_length
                if s.record is None:
                    yield (*where, s.reason, *[None] * 7)
                    continue
                h = s.record.headers
                digest = h.get("warc-payload-digest", "")
                if h.get("warc-type") != "revisit":
                    digest = f"sha1:{base32_sha1(s.record.payload)}"
                yield (
                    *(*where, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to")),
                    *(h.get("warc-target-uri"), s.record.payload_bytes, digest.removeprefix("sha1:")),
                    s.record.payload if with_payload and h.get("warc-type") != "revisit" else None,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for table in batches:
            for path in table.column(0).to_pylist():
                rows, size = [], 0
                for row in rows_of(path):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size >= 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    n = files.count()
    return files.select("path").repartition(max(1, min(n, 10_000))).mapInArrow(run, _SCHEMA)
