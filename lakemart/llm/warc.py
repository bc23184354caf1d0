"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL keys into compressed blocks; each index file ends
with a sparse directory of its blocks. A lookup binary-searches the files' first keys, the
directory and the block, then reads one range of the archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import stored
from lakemart.session import work_folder

BLOCK_LINES = 1_000
ARCHIVE_BYTES = 512 << 20
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the profile that the format names for a capture with an equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63) - 1


def file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """``http://www.example.com:80/a?b#c`` becomes ``com,example,www:80)/a?b``; null is empty."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#", 1)[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    host = host.rsplit("@", 1)[-1].lower()
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (slash or "/") + path


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, a gzip member of its own. A revisit holds the response's headers without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict:
    """The fields of a compressed record; the payload of a response is checked against its digest."""
    data = zlib.decompress(raw, 31)
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: _number(fields.get(name))
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": length,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
    }


def _number(urn: str | None) -> int | None:
    value = urn and urn[len("<urn:page:") : -1]
    return int(value) if value and value != "None" else None


class Archive:
    """Appends records to files of bounded size in a folder; file names are new for each attempt of a task."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.stream, self.at = None, 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.stream is None or self.at >= ARCHIVE_BYTES:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        place = self.name, self.at
        self.stream.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write every page as a record; a row per capture: ``key``, ``page_id``, ``file``, ``offset``, ``length``.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest id is the response and the others revisit it. Rows that share that smallest id
    are all responses; null ids come last, and a payload of null ids alone has responses only.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    first = rows.groupBy(F.col("sha").alias("same")).agg(F.min("page_id").alias("first"))
    paired = rows.join(first, F.col("sha") == F.col("same"))
    revisit = (F.octet_length("html") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    paired = paired.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches):
        archive = Archive(folder)
        for batch in batches:
            out = []
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4))):
                payload = html.encode()
                data = record(page_id, url, payload, digest_of(payload), refers_to, refers_to is not None)
                file, offset = archive.add(data)
                out.append((url_key(url), page_id, file, offset, len(data)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "page_id", "file", "offset", "length"])
        archive.close()

    return paired.mapInArrow(write, "key string, page_id long, file string, offset long, length long")


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, int, str]]:
    """Write the index; returns (first key, first id, file) of each index file in order, one for each partition at most.

    Captures are cut into ranges by (key, id), so the captures of one host or URL share a
    range or many as their number asks for.
    """

    def write(batches):
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name, first, directory, lines, at = f"{uuid.uuid4().hex}.idx", None, [], [], 0
        stream = None

        def flush():
            nonlocal lines, at, stream, first
            if not lines:
                return
            if stream is None:
                stream, first = fs.open_output_stream(f"{path}/{name}", compression=None), lines[0]
            data = zlib.compress(json.dumps(lines).encode())
            stream.write(data)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            at += len(data)
            lines = []

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(5))):
                lines.append([key, NO_ID if page_id is None else page_id, file, offset, length])
                if len(lines) >= block_lines:
                    flush()
        flush()
        if stream is not None:
            data = zlib.compress(json.dumps(directory).encode())
            stream.write(data + len(data).to_bytes(8, "big"))
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([None if first[1] == NO_ID else first[1]], pa.int64()), pa.array([name])], ["key", "page_id", "file"])

    order = ["key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "length")
    written = stored(ranged.mapInArrow(write, "key string, page_id long, file string"), "index")
    return sorted((r["key"], NO_ID if r["page_id"] is None else r["page_id"], r["file"]) for r in written.collect())


class CaptureIndex:
    """Lookups in an index; keeps a few directories, blocks and open archives."""

    def __init__(self, files: list[tuple[str, int, str]], index_folder: str, archive_folder: str, keep: int = 64):
        self.files, self.keep = files, keep
        self.starts = [(f[0], f[1]) for f in files]
        self.index_fs, self.index_path = file_system(index_folder)
        self.archive_fs, self.archive_path = file_system(archive_folder)
        self.cache: OrderedDict = OrderedDict()

    def _kept(self, key, make):
        if key in self.cache:
            self.cache.move_to_end(key)
        else:
            self.cache[key] = make()
            while len(self.cache) > self.keep:
                self.cache.popitem(last=False)
        return self.cache[key]

    def _file(self, fs, path):
        return self._kept(("file", path), lambda: fs.open_input_file(path))

    def _range(self, fs, path: str, offset: int, length: int) -> bytes:
        file = self._file(fs, path)
        file.seek(offset)
        return file.read(length)

    def _directory(self, name: str) -> list:
        path = f"{self.index_path}/{name}"
        size = self._file(self.index_fs, path).size()
        length = int.from_bytes(self._range(self.index_fs, path, size - 8, 8), "big")
        blocks = json.loads(zlib.decompress(self._range(self.index_fs, path, size - 8 - length, length)))
        return [(b[0], b[1]) for b in blocks], blocks

    def captures(self, key: str, page_id: int | None):
        """(file, offset, length) of all captures of a key and id, ties over block and file edges included."""
        wanted = (key, NO_ID if page_id is None else page_id)
        shard = max(0, bisect.bisect_left(self.starts, wanted) - 1)
        while shard < len(self.files) and self.starts[shard] <= wanted:
            name = self.files[shard][2]
            firsts, blocks = self._kept(("directory", name), lambda: self._directory(name))
            number = max(0, bisect.bisect_left(firsts, wanted) - 1)
            while number < len(blocks) and firsts[number] <= wanted:
                _, _, at, length = blocks[number]
                lines = self._kept(
                    ("block", name, number),
                    lambda: json.loads(zlib.decompress(self._range(self.index_fs, f"{self.index_path}/{name}", at, length))),
                )
                place = bisect.bisect_left(lines, wanted, key=lambda x: (x[0], x[1]))
                while place < len(lines) and (lines[place][0], lines[place][1]) == wanted:
                    yield tuple(lines[place][2:])
                    place += 1
                number += 1
            shard += 1

    def read(self, capture: tuple[str, int, int]) -> dict:
        file, offset, length = capture
        return parse(self._range(self.archive_fs, f"{self.archive_path}/{file}", offset, length))


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(wanted: DataFrame, files: list[tuple[str, int, str]], index_folder: str, archive_folder: str) -> DataFrame:
    """The records of all captures of the (``key``, ``page_id``) pairs wanted, found by the index.

    Pairs are sorted by range first, so a task meets each block of the index once.
    """
    names = [part.split()[0] for part in RECORD.split(", ")]

    def read(batches):
        index = CaptureIndex(files, index_folder, archive_folder)
        for batch in batches:
            out = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for capture in index.captures(key, page_id):
                    found = index.read(capture)
                    out.append([found[n] for n in names])
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    order = ["key", "page_id"]
    return wanted.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder, index them and read every capture back through the index.

    Null html is an empty payload, a null url an empty key. A repeated row is a capture of its own.
    An empty table gives no rows. Only the three named columns are read.
    """
    spark = pages.sparkSession
    archives, index = work_folder(spark, "warc"), work_folder(spark, "cdx")
    captures = stored(write_archives(pages, archives, least_bytes, id_column, url_column, html_column), "captures")
    files = build_index(captures, index)
    return read_captures(captures, files, index, archives)
