"""WARC archives compressed by Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: rows with equal payloads (SHA-256 and length) are one group; the row with the smallest id is a
``response`` record, the others are ``revisit`` records that refer to it and hold no payload. Each task
writes its rows to archives of its own in the shared folder. An archive begins with a skippable frame
(magic 0x184D2A5D) that holds a dictionary trained on its first records, itself compressed, followed by a
``warcinfo`` record and the others, a frame each.

Reading: a task streams an archive through a small buffer, loads the dictionary if the first frame is
one, decodes a frame at a time and checks it: version line, header syntax, mandatory fields,
Content-Length against the record's length, the closing blank lines, the HTTP length and the SHA-1 of
the payload, a frame holding exactly one record.

Recovery: an archive's name holds the task attempt, and only archives listed by finished tasks (the
manifest, a stored table) are read, so a lost or repeated attempt leaves nothing but an unread file.

Defined results: a null payload is empty. Empty payloads are equal to each other. Rows that repeat the
smallest id of their group are all responses (one record written again). Rows with a null id are written
with a record id of their own kind and read back as null; they revisit the smallest id of their group, and
are responses where no row of the group has one. A null URL is written as ``about:blank``; control
characters and spaces in a URL are percent-encoded. An empty table gives no archives and no rows. Very
long payloads are held one at a time. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import shared_dir, stored

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = 0xFD2FB528

#: Size of a trained dictionary, bytes and records of the sample it is trained on (an archive's first records).
DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 512 << 10
SAMPLE_RECORDS = 512

#: A task begins another archive beyond this many compressed bytes.
ARCHIVE_BYTES = 256 << 20

#: Bytes read at a time; a frame's unread rest is copied once a frame, so this is small.
READ_BYTES = 64 << 10

#: A group with more than this share of all repeated rows is hot; there are fewer than 1 / HOT of them.
HOT = 0.001

RECORD_ID = "urn:x-row:"
NO_ID = "urn:x-row-without-id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


# ---------------------------------------------------------------- which rows are responses
def planned(pages: DataFrame, id: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """``(id, url, payload, n_bytes, sha1, refers_to)``: the payload of responses, what revisits refer to.

    Equal payloads are counted map-side. Only groups of two rows or more are joined to the rows again;
    the hot ones, of which there are fewer than ``1 / HOT``, by broadcast, so no task gets their rows.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n_bytes"), F.unhex(F.sha2("payload", 256)).alias("key"))
    groups = rows.where(F.col("n_bytes") >= min_bytes).groupBy("key", "n_bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where(F.col("n") > 1), "payload-groups")
    total = groups.agg(F.sum("n")).first()[0]
    if total:
        hot = F.broadcast(groups.where(F.col("n") > total * HOT).select("key", "n_bytes", F.col("first").alias("hot_first"), F.lit(True).alias("hot")))
        rest = groups.where(F.col("n") <= total * HOT).select(F.col("key").alias("met"), F.col("first").alias("rest_first"))
        rows = rows.join(hot, ["key", "n_bytes"], "left")
        # a hot row looks for a key that no group has, another one for each row
        own = F.when(F.col("hot"), F.concat(F.lit("hot").cast("binary"), F.monotonically_increasing_id().cast("string").cast("binary"))).otherwise(F.col("key"))
        rows = rows.withColumn("own", own).join(rest, F.col("own") == F.col("met"), "left")
        first = F.coalesce("hot_first", "rest_first")
        refers = F.when(~F.col("id").eqNullSafe(first), first)
    else:
        refers = F.lit(None).cast(rows.schema["id"].dataType)
    rows = rows.withColumn("refers_to", refers)
    return rows.select("id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "n_bytes",
                       F.sha1("payload").alias("sha1"), "refers_to")


# ---------------------------------------------------------------- writing
def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(id) -> str:
    return NO_ID if id is None else RECORD_ID + urllib.parse.quote(str(id), safe="")


def row_id(column: str) -> Column:
    """The id a record was written for; null for records of rows without one, or of other software.

    ``quote`` leaves no plus sign, so decoding it as a form value is exact.
    """
    return F.when(F.col(column).startswith(RECORD_ID), F.url_decode(F.substring(column, len(RECORD_ID) + 1, 1 << 30)))


def safe_uri(url: str | None) -> str:
    return "about:blank" if url is None else "".join(c if " " < c and c != "\x7f" else urllib.parse.quote(c) for c in url)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def row_record(row: dict, date: str) -> bytes:
    """The record of one row of :func:`planned`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id(row['id'])}>"), ("WARC-Date", date),
              ("WARC-Target-URI", safe_uri(row["url"])), ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(row["sha1"]))),
              ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Refers-To", f"<{record_id(row['refers_to'])}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return record(fields, http if revisit else http + row["payload"])


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for the samples; None where they are too few or too small to train on."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8) if size >= 256 else None
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """One archive: the dictionary's frame, then a frame per record."""

    def __init__(self, stream, samples: list[bytes], date: str):
        self.stream, self.size, self.records = stream, 0, 0
        dictionary = trained([s[:SAMPLE_BYTES // 8] for s in samples])
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
            self._put(DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        info = b"format: WARC File Format 1.1\r\n"
        self.add(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{hashlib.sha1(date.encode()).hexdigest()}>"),
                         ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info), 0)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, data: bytes, rows: int = 1) -> None:
        self._put(self.compressor.compress(data))
        self.records += rows


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows of :func:`planned`; the manifest ``(path, n_records, n_bytes)`` of what finished tasks wrote."""
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        waiting: list[bytes] = []
        held = number = 0
        archive = None

        def begin() -> ArchiveWriter:
            path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            made = ArchiveWriter(files.open_output_stream(f"{base}/{path}", compression=None), waiting, date)
            made.path = path
            for data in waiting:
                made.add(data)
            waiting.clear()
            return made

        def end(done: ArchiveWriter) -> pa.RecordBatch:
            done.stream.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{done.path}"], "n_records": pa.array([done.records], pa.int64()), "n_bytes": pa.array([done.size], pa.int64())})

        for batch in batches:
            for at in range(batch.num_rows):
                data = row_record({n: batch.column(c)[at].as_py() for c, n in enumerate(names)}, date)
                if archive is not None:
                    archive.add(data)
                else:  # an archive's first records wait for its dictionary
                    waiting.append(data)
                    held += len(data)
                    if held >= SAMPLE_BYTES or len(waiting) >= SAMPLE_RECORDS:
                        archive = begin()
                if archive is not None and archive.size >= archive_bytes:
                    yield end(archive)
                    archive, held, number = None, 0, number + 1
        if waiting:
            archive = begin()
        if archive is not None:
            yield end(archive)

    return stored(rows.mapInArrow(work, "path string, n_records bigint, n_bytes bigint"), "manifest")


# ---------------------------------------------------------------- reading
class BadArchive(ValueError):
    """An archive or record that breaks the format."""


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """Decoded frames with their number, skippable frames left out; the first may hold the dictionary."""
    rest, number, decompressor = b"", 0, zstandard.ZstdDecompressor()

    def filled(size: int) -> bytes:
        nonlocal rest
        while len(rest) < size and (more := stream.read(max(READ_BYTES, size - len(rest)))):
            rest += more
        return rest

    while filled(4):
        if len(rest) < 4:
            raise BadArchive("bytes after the last frame")
        magic = int.from_bytes(rest[:4], "little")
        if magic in SKIPPABLE:
            if len(filled(8)) < 8:
                raise BadArchive("cut inside a skippable frame")
            size = 8 + int.from_bytes(rest[4:8], "little")
            if len(filled(size)) < size:
                raise BadArchive("cut inside a skippable frame")
            data, rest = rest[8:size], rest[size:]
            if magic == DICTIONARY_MAGIC and number == 0:
                if int.from_bytes(data[:4], "little") == ZSTD_MAGIC:
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        elif magic == ZSTD_MAGIC:
            one, out = decompressor.decompressobj(), []
            while not one.eof:
                if not filled(1):
                    raise BadArchive("cut inside a frame")
                try:
                    out.append(one.decompress(rest))
                except zstandard.ZstdError as error:
                    raise BadArchive(f"frame does not decode: {error}") from error
                rest = one.unused_data if one.eof else b""
            yield number, b"".join(out)
        else:
            raise BadArchive("neither a Zstandard nor a skippable frame")
        number += 1


@dataclass
class Record:
    version: str
    fields: dict[str, str]  # names in lower case
    block: bytes


def header_fields(lines: list[bytes]) -> dict[str, str]:
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"not a header field: {line[:60]!r}")
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return fields


def length_of(fields: dict[str, str]) -> int:
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise BadArchive("Content-Length is not a number")
    return int(size)


def parse(data: bytes) -> Record:
    """One record from the content of one frame, its header and length checked."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise BadArchive("no end of the header")
    version, *lines = data[:end].split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive(f"not a version line: {version[:20]!r}")
    fields = header_fields(lines)
    missing = [m for m in MANDATORY if not fields.get(m)]
    if missing:
        raise BadArchive(f"missing fields: {missing}")
    size = length_of(fields)
    if len(data) != end + 4 + size + 4 or data[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length does not match the record's length")
    return Record(version.decode(), fields, data[end + 4 : -4])


def content(found: Record) -> tuple[bytes | None, int, str]:
    """Payload (None for revisits), its full length, its bare base32 digest; checked where there is a payload."""
    end = found.block.find(b"\r\n\r\n")
    if end < 0 or not found.block.startswith(b"HTTP/"):
        raise BadArchive("no HTTP header in the block")
    size = length_of(header_fields(found.block[:end].split(b"\r\n")[1:]))
    stated = found.fields.get("warc-payload-digest", "")
    if not stated.startswith("sha1:"):
        raise BadArchive("no SHA-1 payload digest")
    if found.fields["warc-type"] == "revisit":
        if len(found.block) != end + 4 or not found.fields.get("warc-refers-to"):
            raise BadArchive("a revisit holds a payload or refers to nothing")
        return None, size, stated[5:]
    payload = found.block[end + 4 :]
    if len(payload) != size:
        raise BadArchive("HTTP Content-Length does not match the payload")
    if base32(hashlib.sha1(payload).digest()) != stated[5:]:
        raise BadArchive("payload digest does not match")
    return payload, size, stated[5:]


def bare(uri: str | None) -> str | None:
    return uri[1:-1] if uri and uri.startswith("<") and uri.endswith(">") else uri


READ_SCHEMA = ("archive string, frame bigint, record_id string, record_type string, target_uri string, date string, "
               "payload binary, payload_bytes bigint, payload_digest string, refers_to string, error string")


def read_archive(path: str, payloads: bool = True, strict: bool = True) -> Iterator[dict]:
    """The ``response`` and ``revisit`` records of one archive, one at a time.

    Not ``strict``: a record that breaks the format is a row with ``error`` and its frame number, and
    reading goes on with the next frame; bytes that are no frame end the archive with such a row.
    """
    files, name = pyarrow.fs.FileSystem.from_uri(path)
    number = -1
    with files.open_input_stream(name, compression=None) as stream:
        try:
            for number, data in frames(stream):
                try:
                    found = parse(data)
                    kind = found.fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload, size, digest = content(found)
                except BadArchive as error:
                    if strict:
                        raise
                    yield {"archive": path, "frame": number, "error": str(error)}
                    continue
                yield {"archive": path, "frame": number, "record_id": bare(found.fields["warc-record-id"]), "record_type": kind,
                       "target_uri": found.fields.get("warc-target-uri"), "date": found.fields["warc-date"],
                       "payload": payload if payloads else None, "payload_bytes": size, "payload_digest": digest,
                       "refers_to": bare(found.fields.get("warc-refers-to"))}
        except BadArchive as error:
            if strict:
                raise BadArchive(f"{path}, after frame {number}: {error}") from error
            yield {"archive": path, "frame": number + 1, "error": str(error)}


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True, strict: bool = True,
                  batch_rows: int = 500, batch_bytes: int = 4 << 20) -> DataFrame:
    """All records (``READ_SCHEMA``) of the archives in ``manifest.path``, an archive a task at a time."""
    count = manifest.count()
    names = [f.split(" ")[0] for f in READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[f.split(" ")[1]]) for n, f in zip(names, READ_SCHEMA.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in read_archive(path, payloads, strict):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= batch_rows or held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("path").repartition(max(1, count)).mapInArrow(work, READ_SCHEMA)


def archive(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
            folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row to ``folder`` (default: one in the shared folder); the manifest."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return write_archives(planned(pages, id, url, payload, min_bytes), folder, archive_bytes=archive_bytes)


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record per row and reads them back: ``(<id>, payload_bytes, payload_digest, record_type, refers_to)``."""
    kind = pages.schema[id].dataType
    back = read_archives(pages.sparkSession, archive(pages, id, url, payload, min_bytes), payloads=False)
    return back.select(row_id("record_id").cast(kind).alias(id), "payload_bytes", "payload_digest", "record_type", row_id("refers_to").cast(kind).alias("refers_to"))
