"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writing deals the pages out to tasks, each of which writes archives of about ``ARCHIVE_BYTES`` to the
shared folder: a dictionary trained on the archive's first records, a ``warcinfo`` record, then a record
per page. Names are new for each attempt, and the manifest that Spark commits says which archives count.
Reading goes through an archive frame by frame and checks what it meets: frame sizes and checksums, the
version line, required headers, lengths, and payload digests of responses. Anything wrong raises
``WarcError`` with the archive and offset.

Defined cases: a null payload is empty, a null url has no target header, a null ``page_id`` has no page
header and is read back as null; it is never what others refer to. Rows that repeat the id which a group
of equal payloads refers to are responses like it. An empty table makes no archives. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearword.llm.storage import Scratch, open_input, open_output

#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
#: A dictionary's size, and how many bytes of an archive's first records it is trained on.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 1 << 20
LEVEL = 3
#: A record that has more is refused by the writer, a frame that says so by the reader.
LARGEST_RECORD = 2 << 30
SALTS = 16

#: Fixed values of the two formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NAMESPACE = 0x6E772D7761726300 << 64  # the upper half of the record ids of pages with an id
_NULL = np.iinfo(np.int64).min
MANIFEST = "file string, n_records long, n_bytes long"


class WarcError(ValueError):
    """An archive that breaks the format."""


@dataclass
class Record:
    headers: dict[bytes, bytes]
    block: bytes
    offset: int


def record_id(page_id: int | None, extra: str = "") -> str:
    """The URN of a page's record; for pages without id, one made of ``extra``."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, extra)}>"
    return f"<urn:uuid:{uuid.UUID(int=_NAMESPACE | (page_id & (1 << 64) - 1))}>"


def page_of(urn: bytes) -> int | None:
    """The page id in such an URN."""
    value = uuid.UUID(urn.decode().strip("<>")).int
    if value >> 64 != _NAMESPACE >> 64:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def http_block(payload: bytes, n_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes + payload


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record, its Content-Length added."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """The record of one page: its payload, or as a revisit the HTTP headers alone."""
    payload = row["html"] or b""
    refers = row["refers_to"]
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(row["page_id"], f"{row['url']} {digest}")), ("WARC-Date", date)]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    if row["page_id"] is not None:
        headers.append(("WARC-Page-ID", str(row["page_id"])))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers is not None:
        headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(refers))]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    return record_bytes(headers, http_block(b"" if refers is not None else payload, len(payload)))


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples, or None where they are too few for one."""
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """Writes one archive; records before the dictionary exists wait in memory, SAMPLE_BYTES at most and one more."""

    def __init__(self, uri: str, date: str):
        self.uri, self._out = uri, open_output(uri)
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        self._waiting: list[bytes] | None = [record_bytes(headers, b"format: WARC File Format 1.1\r\n")]
        self._held = self.raw = self.n = 0

    def add(self, record: bytes) -> None:
        if len(record) > LARGEST_RECORD:
            raise WarcError(f"a record of {len(record)} bytes; {LARGEST_RECORD} at most can be read")
        self.raw += len(record)
        self.n += 1
        if self._waiting is None:
            self._out.write(self._compressor.compress(record))
            return
        self._waiting.append(record)
        self._held += len(record)
        if self._held >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        dictionary = train([r[:8192] for r in self._waiting])
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
            self._out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self._compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for record in self._waiting:
            self._out.write(self._compressor.compress(record))
        self._waiting = None

    def close(self) -> None:
        if self._waiting is not None:
            self._start()
        self._out.close()


class _Window:
    """Bytes of a stream from ``at`` on, read as they are asked for."""

    def __init__(self, stream, name: str, step: int = 4 << 20):
        self._stream, self.name, self._step, self._data, self._lo, self.at = stream, name, step, b"", 0, 0

    def peek(self, n: int, ahead: int = 0) -> bytes:
        """Up to ``n`` bytes from ``at + ahead``; fewer only at the end."""
        need = self.at - self._lo + ahead + n
        if need > len(self._data):
            parts, have = [self._data[self.at - self._lo :]], len(self._data) - (self.at - self._lo)
            self._lo = self.at
            while have < ahead + n and (more := self._stream.read(max(self._step, ahead + n - have))):
                parts.append(more)
                have += len(more)
            self._data = b"".join(parts)
        a = self.at - self._lo + ahead
        return self._data[a : a + n]

    def fail(self, what: str) -> WarcError:
        return WarcError(f"{self.name}, offset {self.at}: {what}")


def _frame_size(window: _Window) -> tuple[int, int]:
    """(compressed bytes, content bytes) of the frame at the window's place, by its header and block headers."""
    head = window.peek(18)
    try:
        header = zstandard.frame_header_size(head)
        parameters = zstandard.get_frame_parameters(head)
    except zstandard.ZstdError as e:
        raise window.fail(f"no frame header ({e})") from None
    at = header
    while True:
        b = window.peek(3, at)
        if len(b) < 3:
            raise window.fail("the frame is cut off")
        word = int.from_bytes(b, "little")
        kind, size = word >> 1 & 3, word >> 3
        if kind == 3:
            raise window.fail("a block of reserved type")
        at += 3 + (1 if kind == 1 else size)
        if word & 1:
            break
    return at + 4 * parameters.has_checksum, parameters.content_size


def frames(stream, name: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame after the dictionary, if one leads."""
    window = _Window(stream, name)
    decompressor = zstandard.ZstdDecompressor()
    while head := window.peek(8):
        if len(head) < 8:
            raise window.fail("stray bytes at the end")
        magic, size = struct.unpack("<II", head)
        if magic == DICTIONARY_MAGIC and window.at == 0:
            raw = window.peek(size, 8)
            if len(raw) < size:
                raise window.fail("the dictionary is cut off")
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            window.at += 8 + size
        elif magic >> 4 == 0x184D2A5:
            window.at += 8 + size
        elif magic == FRAME_MAGIC:
            packed, content = _frame_size(window)
            if 0 <= content <= LARGEST_RECORD or content == zstandard.CONTENTSIZE_UNKNOWN:
                data = window.peek(packed)
            else:
                raise window.fail(f"a frame of {content} bytes")
            if len(data) < packed:
                raise window.fail("the frame is cut off")
            try:
                out = decompressor.decompress(data) if content != zstandard.CONTENTSIZE_UNKNOWN else decompressor.decompressobj().decompress(data)
            except zstandard.ZstdError as e:
                raise window.fail(f"the frame doesn't decode ({e})") from None
            yield window.at, out
            window.at += packed
        else:
            raise window.fail(f"no frame starts here (magic {magic:#x})")


def parse(content: bytes, name: str = "", offset: int = 0) -> Record:
    """The one record of a frame, its headers and lengths checked."""
    fail = lambda what: WarcError(f"{name}, offset {offset}: {what}")
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in VERSIONS:
        raise fail("no WARC version line")
    headers: dict[bytes, bytes] = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        key = key.strip().lower()
        if not colon or not key:
            raise fail(f"a bad header line {line[:60]!r}")
        if key in headers and key in REQUIRED:
            raise fail(f"{key.decode()} twice")
        headers[key] = value.strip()
    if missing := [k.decode() for k in REQUIRED if not headers.get(k)]:
        raise fail(f"no {', '.join(missing)}")
    if not headers[b"content-length"].isdigit():
        raise fail("Content-Length is no number")
    length = int(headers[b"content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise fail(f"Content-Length is {length}, but the frame holds {len(rest) - 4} bytes and its end")
    return Record(headers, rest[:length], offset)


def payload_of(record: Record, name: str = "") -> tuple[bytes | None, int, str | None]:
    """(payload, its full length, hex SHA-1) of a response or revisit; the payload of a revisit is None."""
    fail = lambda what: WarcError(f"{name}, offset {record.offset}: {what}")
    head, gap, body = record.block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
    if not gap or not head.startswith(b"HTTP/") or not found:
        raise fail("no HTTP head with a length")
    length = int(found[1])
    digest = record.headers.get(b"warc-payload-digest")
    said = base64.b32decode(digest.removeprefix(b"sha1:")).hex() if digest and digest.startswith(b"sha1:") else None
    if record.headers[b"warc-type"] == b"revisit":
        if b"warc-refers-to" not in record.headers or b"warc-profile" not in record.headers or body:
            raise fail("a revisit without reference or with a payload")
        return None, length, said
    if len(body) != length:
        raise fail(f"the HTTP length is {length}, but the payload has {len(body)} bytes")
    sha = hashlib.sha1(body, usedforsecurity=False).hexdigest()
    if said is not None and said != sha:
        raise fail("the payload isn't what its digest says")
    return body, length, sha


def assigned(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """The pages with digest and refers_to: for equal payloads of at least ``least`` bytes, the largest page_id, except on that page."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", html.alias("html")).withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.octet_length("html"))
    apart = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # payloads that are in no group are spread by their page
    own = own.withColumn("key", F.when(F.col("n_bytes") >= least, F.col("digest")).otherwise(apart))
    groups = own.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 AND last IS NOT NULL")
    salted = groups.select(F.col("digest").alias("key"), "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html); returns the manifest, a row per archive: file, n_records, n_bytes before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if writer is None:
                        writer = Writer(f"{folder}/part-{part:06d}-{len(made):05d}-{uuid.uuid4().hex}.warc.zst", date)
                    writer.add(page_record(row, date))
                    if writer.raw >= archive_bytes:
                        writer.close()
                        made.append(writer)
                        writer = None
        if writer is not None:
            writer.close()
            made.append(writer)
        if made:
            yield pa.RecordBatch.from_pylist([{"file": w.uri, "n_records": w.n, "n_bytes": w.raw} for w in made])

    return Scratch(pages.sparkSession, "warc-manifest").cut(assigned(pages, least).mapInArrow(run, MANIFEST), "manifest")


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """A row per response and revisit record of the archives in column ``file``, or in ``file`` and ``content`` (as from Spark's binaryFile).

    page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to, file, offset, and payload
    (null for revisits) unless ``payload`` is False. Other record types are checked and left out.
    """
    names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    if payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def rows(name: str, stream) -> Iterator[tuple[list, int]]:
        for offset, content in frames(stream, name):
            record = parse(content, name, offset)
            kind, get = record.headers[b"warc-type"], record.headers.get
            if kind not in (b"response", b"revisit"):
                continue
            body, size, digest = payload_of(record, name)
            page, refers, uri = get(b"warc-page-id"), get(b"warc-refers-to"), get(b"warc-target-uri")
            row = [int(page) if page else None, uri.decode() if uri is not None else None, size, digest, kind.decode(), page_of(refers) if refers else None, name, offset]
            yield row + [body] * payload, len(content) if payload else 200

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("file")[k].as_py()
                stream = pa.BufferReader(batch.column("content")[k].as_buffer()) if "content" in batch.schema.names else open_input(name)
                held, size = [], 0
                for row, n in rows(name, stream):
                    held.append(row)
                    size += n
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)

    spark = files.sparkSession
    dealt = files.select(*[c for c in files.columns if c in ("file", "content")])
    dealt = dealt if "content" in dealt.columns else dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long" + ", payload binary" * payload)


def read_folder(spark, folder: str, payload: bool = True) -> DataFrame:
    """All archives ``*.warc.zst`` below a folder of any store that Spark reads; each archive must fit in a task's memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder)
    return read(files.select(F.col("path").alias("file"), "content"), payload)
