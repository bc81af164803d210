"""WARC archives with a two-level capture index.

Pages are written as gzip members of archive files in the shared folder. The
index sorts captures by reversed-host URL key into compressed blocks; every
index part ends with the sparse directory of its blocks (first key, offset,
length). A lookup finds the part, bisects its directory, reads the one block by
range, bisects there and then reads the record by range from its archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.session import scratch_path, written

#: Captures in one index block.
BLOCK_LINES = 1000
#: Bytes after which a task starts another archive.
ARCHIVE_BYTES = 1 << 30
_CAPTURES = "page_id long, url_key string, archive string, at long, size long"


def url_key(url: str | None) -> str:
    """Key that sorts captures by domain: ``com,example,www)/path?query``. Null gives an empty key."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def with_originals(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, payload, refers_to, revisit)``: pages of equal payload point to the one of largest id.

    Payloads below ``min_bytes`` are all responses. Rows that repeat id and
    payload are all responses. A null html is an empty payload; a null id is
    smaller than any other.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("content", F.sha2("payload", 256))
    # Counted ahead of the shuffle, so a payload of a third of all pages is one small row of each task.
    largest = rows.groupBy("content").agg(F.max("page_id").alias("largest"))
    is_copy = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return rows.join(largest, "content").select("page_id", "url", "payload", F.when(is_copy, F.col("largest")).alias("refers_to"), is_copy.alias("revisit"))


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``with_originals`` to archives under ``folder``; one row per capture says where it lies.

    File names are new for each task attempt and only those of finished
    attempts are named in the result, so a lost executor leaves no wrong entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        out, name, at = None, "", 0
        for batch in batches:
            found = []
            for page, url, payload, refers, revisit in zip(*[batch.column(i) for i in range(5)], strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                url = url.as_py()
                member = gzip.compress(record(page.as_py(), url, payload.as_py(), refers.as_py(), revisit.as_py(), date), 6, mtime=0)
                out.write(member)
                found.append((page.as_py(), url_key(url), name, at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)], _NAMES) if found else _EMPTY
        if out is not None:
            out.close()

    return rows.mapInArrow(run, _CAPTURES)


_NAMES = ["page_id", "url_key", "archive", "at", "size"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_EMPTY = pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], _NAMES)


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures into index parts under ``folder``; one row per part: first key and file name.

    A key in the index is the URL key and the page id, so one URL with a third
    of all captures is spread over parts like any others.
    """
    keyed = captures.withColumn("page_id", F.coalesce("page_id", F.lit(-(2**63))))
    ordered = keyed.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        out, name, at, lines, directory = None, f"{uuid.uuid4().hex}.idx", 0, [], []

        def flush() -> int:
            packed = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
            directory.append([lines[0][:2], at, len(packed)])
            out.write(packed)
            lines.clear()
            return at + len(packed)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append([row["url_key"], row["page_id"], row["archive"], row["at"], row["size"]])
                if len(lines) >= block_lines:
                    at = flush()
        if out is None:
            return
        if lines:
            at = flush()
        packed = zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), 6)
        out.write(packed)
        out.write(len(packed).to_bytes(8, "big"))
        out.close()
        first = directory[0][0]
        yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], ["url_key", "page_id", "part"])

    return ordered.select(*_NAMES).mapInArrow(run, "url_key string, page_id long, part string")


class IndexPart:
    """One index part: its directory in memory, its blocks read by range, the last one kept."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size()
        size = int.from_bytes(self.file.read_at(8, end - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(size, end - 8 - size)))
        self.firsts = [tuple(x[0]) for x in self.directory]
        self.block, self.lines, self.keys = -1, [], []

    def find(self, key: tuple[str, int]) -> list | None:
        n = bisect.bisect_right(self.firsts, key) - 1
        if n < 0:
            return None
        if n != self.block:
            _, at, size = self.directory[n]
            self.block, self.lines = n, [json.loads(x) for x in zlib.decompress(self.file.read_at(size, at)).decode().split("\n")]
            self.keys = [tuple(x[:2]) for x in self.lines]
        i = bisect.bisect_left(self.keys, key)
        return self.lines[i] if i < len(self.keys) and self.keys[i] == key else None


def lookup(wanted: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """Where each wanted ``(page_id, url)`` lies; captures that aren't in the index are left out.

    The list of parts, one short row for each index task, goes with the tasks;
    directories and blocks are read from the shared folder. Wanted keys are
    sorted first, so a task reads neighbouring blocks once.
    """
    listed = sorted((r["url_key"], r["page_id"], r["part"]) for r in parts.collect())
    firsts = [(k, p) for k, p, _ in listed]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [-(2**63) if x is None else x for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string())], ["page_id", "url_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        name, part = None, None
        for batch in batches:
            found = []
            for page, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = bisect.bisect_right(firsts, (key, page)) - 1
                if n < 0:
                    continue
                if listed[n][2] != name:
                    name = listed[n][2]
                    part = IndexPart(fs, f"{root}/{name}")
                line = part.find((key, page))
                if line:
                    found.append((page, key, *line[2:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)], _NAMES) if found else _EMPTY

    asked = wanted.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(keys, "page_id long, url_key string")
    return asked.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id").mapInArrow(run, _CAPTURES)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Read captures by range, in file order: ``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)``.

    Length and digest are those of the full payload; a revisit carries no payload itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        name, file = None, None
        for batch in batches:
            rows = {c: [] for c in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")}
            for place in batch.to_pylist():
                if place["archive"] != name:
                    name, file = place["archive"], fs.open_input_file(f"{root}/{place['archive']}")
                headers, http, payload = parse(gzip.decompress(file.read_at(place["size"], place["at"])))
                kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
                head = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and payload_digest(payload) != digest:
                    raise ValueError(f"record {place['page_id']} is damaged")
                rows["page_id"].append(None if place["page_id"] == -(2**63) else place["page_id"])
                rows["url"].append(headers.get("WARC-Target-URI"))
                rows["record_type"].append(kind)
                rows["refers_to"].append(int(refers.split(":")[-1].rstrip(">")) if refers and "None" not in refers else None)
                rows["payload_bytes"].append(int(head["Content-Length"]))
                rows["payload_digest"].append(digest)
                rows["payload"].append(payload if kind == "response" else None)
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), types, strict=True)], list(rows))

    near = places.repartition("archive", F.expr(f"at div {1 << 24}")).sortWithinPartitions("archive", "at")
    return near.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages, index them, look every page up again and read its record.

    Result and null rules as in ``with_originals`` and ``read_records``; pages
    that repeat id and URL are read as often as they were written. An empty
    table gives no rows. Archives and index stay in the shared folder.
    """
    folder = scratch_path(pages.sparkSession, "archive")
    captures = written(write_archives(with_originals(pages, min_bytes, id_col, url_col, html_col), f"{folder}/data"), "captures")
    parts = written(write_index(captures, f"{folder}/index"), "index-parts")
    wanted = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return read_records(lookup(wanted, parts, f"{folder}/index"), f"{folder}/data")
