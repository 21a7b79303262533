"""WARC archives: written by tasks as gzip members, read back by byte ranges.

Writing. Rows whose payloads are equal (by SHA-256 of the bytes) share one
stored payload: the row with the smallest key is a response record, the others
are revisit records that name it; payloads under ``min_bytes`` are all stored.
Each record is a gzip member of its own. A task writes files under names that
no other attempt has and returns them; a table of the files of successful
tasks is the archive's list, so what a lost attempt leaves is never read.

Reading. A task gets a range of bytes of a file. It scans for the gzip magic,
tries each place as a member, and takes it for one if it inflates (with its
checksum) to whole WARC records; it owns the members that start in its range
and reads beyond the end to finish the last one. A payload may itself hold a
member (an archive in an archive, stored without compression), which a task
that starts inside it would take for a record; such records start before the
end of the last record of an earlier range, which one row for each range
shows, and are taken out.

Files are opened by ``pyarrow.fs`` (local or shared folders, HDFS, S3, GCS).

Defined results: a null payload is an empty one; rows that repeat the
smallest key of a payload are all responses; null keys come after all others (where a
payload has only null keys, all are responses); a null or empty URL is
replaced by the record's own name; characters that no header may hold are
percent-encoded in URLs; an empty table gives an empty archive and no rows; other columns
are not read. A file cut short gives the records that are whole; bytes that
are no member are passed over.
"""

from __future__ import annotations

import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectrum.llm.common import written
from prospectrum.sources.tables import shared_dir

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
#: Profile of revisit records that stand for an equal payload.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed once it has so many bytes.
FILE_BYTES = 1 << 30
_CHUNK, _STEP, _BATCH_BYTES, _BATCH_ROWS = 1 << 20, 1 << 15, 4 << 20, 2000
_NAME = "urn:record:"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))

RECORD = "path string, range long, offset long, end long, record_type string, record_id string, target_uri string, date string, refers_to_id string, payload_digest string, payload_bytes long, intact boolean, payload binary"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri)


def record_name(key: str | None, digest: str) -> str:
    return _NAME + digest + (":" + quote(key, safe="") if key is not None else "")


def key_of(name: str | None) -> str | None:
    """The key in a record's name, None where it has none."""
    digest, found, key = (name or "").removeprefix(_NAME).partition(":")
    return unquote(key) if found else None


def member(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in [*fields, ("Content-Length", str(len(block)))])
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


def page_member(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool, date: str, level: int = 6) -> bytes:
    """A page as a response or a revisit record."""
    name = record_name(key, digest)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", quote(url, safe=_PRINTABLE) if url else name)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<{record_name(refers_to, digest)}>")]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(fields, head if revisit else head + payload, level)


def base32_sha1(payload: bytes) -> str:
    return b32encode(sha1(payload, usedforsecurity=False).digest()).decode()


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Writes an archive into the shared folder; (path, bytes, records) of its
    files. date: of the capture, in all records."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_bytes
    firsts = rows.where(large).groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = written(firsts.select(F.col("sha").alias("of"), "first"), "repeated-payloads")
    named = rows.join(firsts, (rows["sha"] == firsts["of"]) & large, "left")
    revisit = F.col("first").isNotNull() & F.coalesce(F.col("key") != F.col("first"), F.lit(True))
    named = named.select(F.col("key").cast("string"), "url", "payload", F.col("first").cast("string"), revisit.alias("revisit"))
    folder = f"{shared_dir(pages.sparkSession)}/archive-{uuid.uuid4().hex}"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, n, fs = None, None, 0, 0, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

        for batch in batches:
            for k, u, p, first, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs, inside = filesystem(folder)
                    fs.create_dir(inside, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, n = fs.open_output_stream(f"{inside}/{name}", compression=None), f"{folder}/{name}", 0
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
                    out.write(info)
                    size = len(info)
                one = page_member(k, u, p, base32_sha1(p), first, again, date, level)
                out.write(one)
                size, n = size + len(one), n + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(named.mapInArrow(kept, "path string, bytes long, records long"), "archive-files")


class _Window:
    """A file's bytes by position, read in chunks, mostly forwards."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos on; fewer before the end only at a chunk's end."""
        if not self.base <= pos < self.base + len(self.data):
            self.file.seek(pos)
            self.base, self.data = pos, self.file.read(min(_CHUNK, max(0, self.size - pos)))
        return self.data[pos - self.base : pos - self.base + n]

    def find(self, pos: int, end: int) -> int:
        """Where the magic next starts in [pos, end), or end."""
        while pos < end:
            piece = self.at(pos, _CHUNK)
            if len(piece) < len(MAGIC):  # at a chunk's end: read on from here
                self.base, self.data = pos, b""
                piece = self.at(pos, _CHUNK)
                if len(piece) < len(MAGIC):
                    return end
            found = piece.find(MAGIC)
            if found >= 0:
                return min(pos + found, end)
            pos += len(piece) - len(MAGIC) + 1
        return end


def inflate(window: _Window, pos: int) -> tuple[int, bytes] | None:
    """End and content of the member at pos; None if it is none of WARC records."""
    machine, out, at, known = zlib.decompressobj(31), [], pos, False
    while not machine.eof:
        piece = window.at(at, _STEP)
        if not piece:
            return None  # cut short
        try:
            out.append(machine.decompress(piece))
        except zlib.error:
            return None
        at += len(piece)
        if not known:
            head = b"".join(out)[:5]
            if head != b"WARC/"[: len(head)]:
                return None
            known = len(head) == 5
    return at - len(machine.unused_data), b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; folded lines are joined."""
    found, last = {}, None
    for line in head.split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            found[last] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            found.setdefault(last, value.strip())
    return found


def records(data: bytes) -> list[tuple[dict[str, str], bytes]] | None:
    """Headers and block of each record of a member; None unless all are whole."""
    out, pos = [], 0
    while pos < len(data):
        stop = data.find(b"\r\n\r\n", pos)
        if not data.startswith(b"WARC/", pos) or stop < 0:
            return None
        fields = _fields(data[pos:stop].partition(b"\r\n")[2])
        length = fields.get("content-length", "")
        begin = stop + 4
        if not (length.isascii() and length.isdigit()) or begin + int(length) > len(data):
            return None
        pos = begin + int(length)
        out.append((fields, data[begin:pos]))
        while data.startswith(b"\r\n", pos):
            pos += 2
    return out or None


def members(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, int, list[tuple[dict[str, str], bytes]]]]:
    """(start, end, records) of the members that start in [start, end)."""
    window, pos = _Window(file, size), start
    while (pos := window.find(pos, end)) < end:
        whole = inflate(window, pos)
        found = whole and records(whole[1])
        if found:
            yield pos, whole[0], found
        pos = whole[0] if found else pos + 1


def _row(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """The columns of a record, from record_type on."""
    body, stated = block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        stated = _fields(head.partition(b"\r\n")[2]).get("content-length")
    written_digest = fields.get("warc-payload-digest")
    name = lambda x: x.strip("<>") if x is not None else None
    first = (fields.get("warc-type"), name(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-date"), name(fields.get("warc-refers-to")))
    if first[0] == "revisit":
        size = int(stated) if stated and stated.isascii() and stated.isdigit() else None
        return (*first, written_digest.rpartition(":")[2] if written_digest else None, size, None, None)
    digest = base32_sha1(body)
    intact = written_digest.rpartition(":")[2] == digest if written_digest and written_digest.lower().startswith("sha1:") else None
    return (*first, digest, len(body), intact, body if payloads else None)


def read(spark: SparkSession, files: DataFrame, split_bytes: int | None = None, payloads: bool = True) -> DataFrame:
    """One row for each record (``RECORD``) of files (path, bytes).

    split_bytes: of a task's range (default: spark.sql.files.maxPartitionBytes).
    payload_bytes and payload_digest (SHA-1 in base 32) are those of the full
    payload: computed where it is stored, from the headers of a revisit; intact:
    whether a stored payload has the digest of its header.
    """
    if split_bytes is None:
        split_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    step = F.lit(split_bytes).cast("long")
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start"))
    ranges = ranges.select("path", "bytes", "start", F.least(F.col("start") + step, F.col("bytes")).alias("stop"))
    ranges = ranges.repartition(max(1, ranges.count()))  # a task for each

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, size, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, inside = filesystem(path)
                with fs.open_input_file(inside) as file:
                    for at, end, found in members(file, start, stop, size):
                        for fields, block in found:
                            rows.append((path, start, at, end, *_row(fields, block, payloads)))
                            held += len(block) if payloads else 0
                        if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    found = written(ranges.mapInArrow(decoded, RECORD), "records")
    ends = found.groupBy("path", "range").agg(F.min("offset").alias("first"), F.max("end").alias("last"))
    so_far = F.max("last").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    inside = ends.withColumn("before", so_far).where("first < before").select("path", "range", "before")
    if not inside.isEmpty():  # members of payloads
        found = found.join(inside, ["path", "range"], "left").where("before is null or offset >= before").select(found.columns)
    return found


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.bool_(), pa.binary()]
_NAMES = [column.split()[0] for column in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def listed(spark: SparkSession, folder: str, pattern: str = "*.warc.gz") -> DataFrame:
    """(path, bytes) of the archives of a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def key_column(name: str) -> Column:
    """key_of as a column, of a column of record names."""
    key = F.substring_index(F.substring(F.col(name), len(_NAME) + 1, 1 << 30), ":", -1)
    return F.when(F.col(name).startswith(_NAME) & F.substring(F.col(name), len(_NAME) + 1, 1 << 30).contains(":"), F.url_decode(F.replace(key, F.lit("+"), F.lit("%2B"))))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of all
    pages, as read back from an archive of them."""
    kind = pages.schema[key].dataType
    back = read(pages.sparkSession, write(pages, key, url, payload, min_bytes), payloads=False).where("record_type in ('response', 'revisit')")
    refers = F.when(F.col("record_type") == "revisit", key_column("refers_to_id").cast(kind))
    return back.select(key_column("record_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))
