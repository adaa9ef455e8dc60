"""Monolithic gzip normaliser for WARC files.

A WARC that was compressed as one gzip stream can't be read at random.  The
normaliser inflates such a stream once, front to back, with a bounded buffer,
rewrites every record as a gzip member of its own, and writes a sidecar index of
the members' offsets.  Files that have members already (one or more records each)
are read the same way.  Where a header can't be read, the stream is passed over up to
the next line that begins a record.  A file is one task's work, as its stream can't be
split.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_fs, replacing
from .runtime import cut, small_batches

CHUNK = 1 << 18
LEVEL = 6
#: Tasks that files are spread over at most; each does its files one after another.
TASKS = 20000

INDEX = (
    "source string, file string, record long, offset long, length long, type string, uri string, id string, "
    "content_length long, status string"
)


# Writing


def record_bytes(page_id, url: str | None, html: str | None) -> bytes:
    """A WARC resource record; one without content, of type metadata, if html is null."""
    body = b"" if html is None else html.encode()
    head = ["WARC/1.0", "WARC-Type: " + ("metadata" if html is None else "resource")]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_monolithic(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = 1
) -> DataFrame:
    """(path) of files that hold a partition's pages each, as one gzip stream.

    A null id or url has no header line, a null html makes a record without content; empty
    and very long ones, ties and repeated rows are records like any other.  A partition
    without rows has no file, an empty table none at all.  Columns that aren't named aren't
    read.
    """
    rows = small_batches(pages).select(
        F.spark_partition_id().alias("part"), F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/{first.column('part')[0].as_py():06d}.warc.gz"
        with replacing(path) as out:
            squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
            batch = first
            while batch is not None:
                for i, u, t in zip(batch.column("id"), batch.column("url"), batch.column("html")):
                    out.write(squeeze.compress(record_bytes(i.as_py(), u.as_py(), t.as_py())))
                batch = next(batches, None)
            out.write(squeeze.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return rows.mapInArrow(write, "path string")


# Normalising


class Damaged(Exception):
    """The stream can't be read on from here."""


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """Bytes of a gzip file of any number of members, in bounded pieces."""
    member, data = zlib.decompressobj(31), b""
    started = False
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if started and not member.eof:
                    raise Damaged("truncated")
                return
        if member.eof:
            data = data.lstrip(b"\0")  # padding between members
            if not data:
                continue
            member, started = zlib.decompressobj(31), False
        try:
            out = member.decompress(data, chunk)
        except zlib.error as e:
            raise Damaged("corrupt") from e
        started = True
        data = member.unused_data if member.eof else member.unconsumed_tail
        if out:
            yield out


class Pieces:
    """A stream of byte pieces, read by line or by count; ``at`` is the place in what is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def more(self) -> bool:
        got = next(self.pieces, None)
        if got is None:
            return False
        self.held, self.at = self.held[self.at :] + got, 0
        return True

    def give_back(self, data: bytes) -> None:
        self.held, self.at = data + self.held[self.at :], 0

    def line(self) -> bytes | None:
        """The next line with its end, however long; None at the end of the stream."""
        seen = 0
        while (end := self.held.find(b"\n", self.at + seen)) < 0:
            seen = len(self.held) - self.at
            if not self.more():
                return None
        got, self.at = self.held[self.at : end + 1], end + 1
        return got

    def next_record(self) -> bool:
        """Pass everything up to the next line that begins a record; False if there is none."""
        while (found := self.held.find(b"\nWARC/1.", self.at)) < 0:
            self.at = max(self.at, len(self.held) - 8)
            if not self.more():
                return False
        self.at = found + 1
        return True

    def take(self, count: int) -> Iterator[bytes]:
        while count:
            if self.at == len(self.held) and not self.more():
                raise Damaged("truncated")
            got = self.held[self.at : self.at + count]
            self.at += len(got)
            count -= len(got)
            yield got

    def skip_breaks(self) -> bool:
        """Pass line ends; False at the end of the stream."""
        while True:
            while self.at < len(self.held):
                if self.held[self.at] not in b"\r\n":
                    return True
                self.at += 1
            if not self.more():
                return False


@dataclass
class Entry:
    offset: int
    length: int
    type: str | None
    uri: str | None
    id: str | None
    content_length: int


def fields_of(head: bytes) -> dict[str, str]:
    """Fields of a header by their names in lower case; a line that begins with white space goes on with the one before."""
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def read_header(pieces: Pieces) -> bytes | None:
    """A record's header with the blank line behind it; None if no header stands here.

    Only what looks like a header is held: the version line, then lines that have a colon
    or go on with the one before.
    """
    got = []
    while (line := pieces.line()) is not None:
        bare = line.rstrip(b"\r\n")
        if not got and not bare.startswith(b"WARC/1."):
            pieces.give_back(b"\n")
            return None
        got.append(line)
        if not bare:
            return b"".join(got)
        if len(got) > 1 and b":" not in bare and not (len(got) > 2 and bare[:1] in b" \t"):
            pieces.give_back(b"\n" + line)  # it may begin a record
            return None
    raise Damaged("truncated")


def rewrite(stream, out, level: int = LEVEL, chunk: int = CHUNK) -> tuple[list[Entry], str]:
    """Every whole record of ``stream`` as a member of ``out``; their places and how it ended.

    A record that the stream breaks off in is left out.  A header that can't be read, or
    gives no length, is passed over with all up to the next line that begins a record.
    """
    entries: list[Entry] = []
    at, skipped = 0, False
    try:
        pieces = Pieces(inflate(stream, chunk))
        while pieces.skip_breaks():
            head = read_header(pieces)
            fields = fields_of(head) if head else {}
            length = fields.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                skipped = True
                if head:
                    pieces.give_back(b"\n")
                if not pieces.next_record():
                    break
                continue
            size = int(length)
            squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
            # a member is held until its record is known to be whole; it is one record's
            # header and compressed size, the only thing here that isn't bounded by the chunk
            member = [squeeze.compress(head)]
            member += [squeeze.compress(p) for p in pieces.take(size)]
            member += [squeeze.compress(b"\r\n\r\n"), squeeze.flush()]
            length = sum(map(len, member))
            for m in member:
                out.write(m)
            entries.append(Entry(at, length, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id"), size))
            at += length
    except Damaged as e:
        return entries, str(e)
    return entries, "skipped" if skipped else "whole"


def normalise(files: DataFrame, folder: str, path: str = "path", level: int = LEVEL) -> DataFrame:
    """One row for each record of each file: where it lies in its rewritten file.

    Writes ``<name>.warc.gz`` and its sidecar ``<name>.warc.gz.idx`` (a JSON line
    per record) to ``folder``; a file's name is that of its source with a hash of
    the source's whole path.  ``status`` is how the source was read: whole; skipped, if
    something in it that isn't a record was passed over; truncated or corrupt, if the
    stream ends early, and then all records before the damage are kept.  A source without
    records gives an empty file, an empty index and no rows.  Records may be empty or of
    any length, and repeated ones are all kept.  Null paths are passed over; a repeated
    path is done once; an empty table gives no rows; other columns aren't read, whatever
    their names.  The result is computed at once, as the files have to be there.
    """
    todo = cut(files.select(F.col(path).alias("path")).filter("path IS NOT NULL").distinct())
    count = todo.count()
    if not count:
        return files.sparkSession.createDataFrame([], INDEX)
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3, pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                name = source.rpartition("/")[2].removesuffix(".gz").removesuffix(".warc")
                target = f"{folder}/{name}-{zlib.crc32(source.encode()):08x}.warc.gz"
                fs, where = open_fs(source)
                with fs.open_input_stream(where, compression=None) as stream, replacing(target) as out:
                    entries, status = rewrite(stream, out, level)
                with replacing(target + ".idx") as out:
                    for e in entries:
                        out.write(json.dumps(e.__dict__).encode() + b"\n")
                if entries:
                    rows = [
                        (source, target, k, e.offset, e.length, e.type, e.uri, e.id, e.content_length, status)
                        for k, e in enumerate(entries)
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return cut(todo.repartition(min(count, TASKS)).mapInArrow(run, INDEX))


# Reading at random


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder, one row for each record."""
    lines = spark.read.schema("offset long, length long, type string, uri string, id string, content_length long").json(
        f"{folder}/*.idx"
    )
    return lines.withColumn("file", F.regexp_replace(F.input_file_name(), r"\.idx$", ""))


def read_member(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Fields and content of the record whose member lies there."""
    stream.seek(offset)
    data = zlib.decompress(stream.read(length), 31)
    end = re.search(rb"\n\r?\n", data).end()
    fields = fields_of(data[:end])
    return fields, data[end : end + int(fields["content-length"])]


def read_pages(index: DataFrame) -> DataFrame:
    """(page_id, url, html, content_length) of each indexed record, read by its offset alone.

    ``page_id`` is the record id as a string, without the mark of ``write_monolithic``'s
    ids; a record without an id or a target has null there, a metadata record null html.
    Bytes that aren't UTF-8 are replaced.  Every row of the index is read, repeated ones
    each time; an empty index gives no rows; its other columns aren't read.
    """
    schema = "page_id string, url string, html string, content_length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stream = None, None
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != held:
                    if stream:
                        stream.close()
                    fs, path = open_fs(file)
                    held, stream = file, fs.open_input_file(path)
                fields, body = read_member(stream, offset, length)
                key = fields.get("warc-record-id")
                if key is not None and key.startswith("<urn:page:"):
                    key = key[10:].removesuffix(">")
                html = None if fields.get("warc-type") == "metadata" else body.decode("utf-8", "replace")
                rows.append((key, fields.get("warc-target-uri"), html, int(fields["content-length"])))
                size += len(body)
                if size > 8 << 20:
                    yield _pages(rows)
                    rows, size = [], 0
            if rows:
                yield _pages(rows)

    return index.select("file", "offset", "length").mapInArrow(run, schema)


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "html", "content_length"]
    )
