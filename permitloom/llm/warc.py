"""WARC archives with a two-level capture index.

Writing: each partition of pages becomes one archive of gzip members, a record per page.  Of
pages with equal payloads the one with the smallest id is a ``response`` record and the others
are ``revisit`` records that refer to it and carry its HTTP head only.

Index: captures are sorted by their key, the URL with its host reversed (com,example,www)/path,
and cut into compressed blocks of ``LINES`` lines in one file per range of keys.  A sparse
directory holds each block's first key, offset and length, and a file's directory is at its
end.  A lookup finds the file among the ranges, binary-searches the directory, reads the
first block that can hold the key, binary-searches its lines, and goes on to the next block
while lines are equal.  Reading pages back then fetches each
record by offset, with the records of an archive in order of offset.

An attempt of a task writes files of its own, and only those of the attempt that Spark
accepts are ever named, so a lost executor's or a late attempt's files are never read.

A null html is an empty payload; a null url is the empty url (key ``)``); equal urls keep a
capture each and are told apart by page id.  A null page id counts as the smallest and is read
back as null.  Repeated pages keep a record each; of equal payloads of one smallest id, each
with that id is a response.  A payload is the bytes of the column's string, valid UTF-8 or
not; in a url, bytes that are no UTF-8 are replaced.  A long payload is one record, held whole
by the one task that writes or reads it.  An empty table gives no archives and no index.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permitloom.llm.common import forget, scratch, written
from permitloom.operators.files import file_system

LINES = 1000
LEVEL = 4
#: Bytes of an archive that one task reads, and rows that one task looks up.
READ_BYTES, LOOKUPS = 16 << 20, 100_000
#: A neighbour's records within this many bytes are read along with a record.
READ_AHEAD = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_TAIL = 16
#: Stands for a null page id in archives and index.
NO_ID = -(1 << 63)


def url_key(url: Column) -> Column:
    """The sort key of a URL column: reversed host, port if any, then path and query without fragment."""
    plain = F.coalesce(url, F.lit(""))
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)"
    host = F.lower(F.regexp_extract(plain, pattern, 1))
    rest = F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, 3)).otherwise(plain)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_extract(plain, pattern, 2), F.lit(")"), rest)


def payload_digest(html: Column) -> Column:
    """SHA-1 of the payload's bytes, in hex."""
    return F.sha1(html)


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        # A line break or a lone surrogate has no place in a head.
        f"WARC-Target-URI: {json.dumps(url)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Target-URI: {json.dumps(refers_url)[1:-1]}", f"WARC-Refers-To-Date: {DATE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parse_record(member: bytes) -> dict:
    """Head fields (lower-case names), payload and its full length, of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    fields["warc-target-uri"] = json.loads(f'"{fields["warc-target-uri"]}"')
    return {"fields": fields, "payload": payload, "payload_bytes": size}


class _File:
    """A file in the shared folder, of this attempt alone."""

    def __init__(self, folder: str, kind: str, ending: str):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        self.path = f"{base}/{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{ending}"
        self._out = fs.open_output_stream(self.path, compression=None)
        self.at = 0

    def write(self, data: bytes) -> tuple[int, int]:
        self._out.write(data)
        start = self.at
        self.at += len(data)
        return start, len(data)

    def close(self) -> None:
        self._out.close()


CAPTURES = "url_key string, page_id long, url string, record_type string, digest string, file string, at long, size long"


def write_archives(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; returns the captures, a row per record (a table in the shared folder)."""
    rows = pages.select(F.coalesce(F.col(page).cast("long"), F.lit(NO_ID)).alias("page_id"), F.make_valid_utf8(F.coalesce(url, F.lit(""))).alias("url"), F.coalesce(html, F.lit("")).cast("binary").alias("html"))
    light = written(rows.select("page_id", "url", payload_digest(F.col("html")).alias("digest")), "digests")
    # As a table, so that a payload that many pages share is split as a skewed join's key.
    groups = written(light.groupBy("digest").agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "groups")
    # Only copies of another page are marked; a page's payload goes to one place, by its unique id.
    copies = light.join(groups, "digest").where("page_id != first.page_id").dropDuplicates(["page_id", "digest"]).select(F.col("digest").alias("of"), "page_id", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    rows = rows.withColumn("digest", payload_digest(F.col("html")))
    copies = copies.withColumnRenamed("page_id", "copy")
    marked = rows.join(copies, (F.col("page_id") == F.col("copy")) & (F.col("digest") == F.col("of")), "left")
    marked = marked.select("page_id", "url", url_key(F.col("url")).alias("url_key"), "html", "digest", "refers_to", "refers_url").sortWithinPartitions("page_id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out = out or _File(folder, "pages", "warc.gz")
                found = []
                for x in batch.to_pylist():
                    digest = base32(x["digest"])
                    at, size = out.write(record(x["page_id"], x["url"], x["html"], digest, x["refers_to"], x["refers_url"]))
                    found.append((x["url_key"], x["page_id"], x["url"], "response" if x["refers_to"] is None else "revisit", digest, out.path, at, size))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["url_key", "page_id", "url", "record_type", "digest", "file", "at", "size"])
        if out:
            out.close()

    captures = written(marked.mapInArrow(run, CAPTURES), "captures")
    forget(light, groups)
    return captures


def _line(x: dict) -> str:
    return json.dumps([x["url_key"], x["page_id"], x["url"], x["record_type"], x["digest"], x["file"], x["at"], x["size"]])


def write_index(captures: DataFrame, folder: str) -> list[dict]:
    """Write the index files; returns the ranges: a dict per file with its first key and page, path and blocks.

    There is one range for each partition of the sort.
    """
    ordered = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, directory = None, [], []

        def block():
            data = zlib.compress("\n".join(_line(x) for x in held).encode(), LEVEL)
            directory.append([held[0]["url_key"], held[0]["page_id"], *out.write(data)])
            held.clear()

        for batch in batches:
            for x in batch.to_pylist():
                out = out or _File(folder, "index", "cdx")
                held.append(x)
                if len(held) == LINES:
                    block()
        if out:
            if held:
                block()
            at, size = out.write(zlib.compress(json.dumps(directory).encode(), LEVEL))
            out.write(np.array([at, size], "<u8").tobytes())
            out.close()
            yield pa.RecordBatch.from_pydict({"url_key": [directory[0][0]], "page_id": [directory[0][1]], "path": [out.path], "blocks": [len(directory)]})

    ranges = ordered.mapInArrow(run, "url_key string, page_id long, path string, blocks long").collect()
    # Keys are compared as UTF-8 bytes, as Spark sorts them.
    return sorted((r.asDict() for r in ranges), key=lambda r: (r["url_key"].encode(), r["page_id"]))


class IndexFile:
    """Lookups in one index file: directory in memory, the last block kept."""

    def __init__(self, folder: str, path: str):
        fs, _ = file_system(folder)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at, length = np.frombuffer(self.file.read_at(_TAIL, size - _TAIL), "<u8").tolist()
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, at)))
        self.firsts = [(k.encode(), p) for k, p, _, _ in self.directory]
        self.kept, self.lines, self.keys = -1, [], []

    def _block(self, k: int) -> None:
        if k != self.kept:
            _, _, at, size = self.directory[k]
            self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(size, at)).decode().split("\n")]
            self.keys = [(x[0].encode(), x[1]) for x in self.lines]
            self.kept = k

    def captures(self, key: str, page_id: int | None = None) -> list[list]:
        """The lines with this key (and page): url_key, page_id, url, record_type, digest, file, at, size."""
        want = (key.encode(), page_id if page_id is not None else NO_ID)
        # Equal lines may fill the end of the block before the first that starts with them, and whole ones after it.
        k = max(0, bisect.bisect_left(self.firsts, want) - 1)
        out = []
        while k < len(self.directory):
            self._block(k)
            i = bisect.bisect_left(self.keys, want)
            while i < len(self.keys) and self.keys[i][0] == want[0] and (page_id is None or self.keys[i][1] == page_id):
                out.append(self.lines[i])
                i += 1
            if i < len(self.keys):
                break
            k += 1
        return out


def _tasks(df: DataFrame, least: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, least)


def lookup(wanted: DataFrame, ranges: list[dict], folder: str, url: str = "url", page: str = "page_id") -> DataFrame:
    """The capture of each wanted url and page: page_id, record_type, digest, file, at, size.

    Wanted rows are sorted by key, so that a block is read once for all rows it answers.
    """
    firsts = [(r["url_key"].encode(), r["page_id"]) for r in ranges]
    paths = [r["path"] for r in ranges]
    rows = wanted.select(url_key(F.col(url)).alias("url_key"), F.coalesce(F.col(page).cast("long"), F.lit(NO_ID)).alias("page_id")).distinct()
    # By number: rows are small and the blocks that they ask for are not, so their own bytes say nothing.
    tasks = _tasks(wanted, -(-wanted.count() // LOOKUPS))
    rows = rows.repartitionByRange(tasks, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, index = -1, None
        for batch in batches:
            found = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = bisect.bisect_right(firsts, (key.encode(), page_id)) - 1
                if k < 0:
                    continue
                if k != opened:
                    opened, index = k, IndexFile(folder, paths[k])
                found += [(x[1], x[3], x[4], x[5], x[6], x[7]) for x in index.captures(key, page_id)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["page_id", "record_type", "digest", "file", "at", "size"])

    return rows.mapInArrow(run, "page_id long, record_type string, digest string, file string, at long, size long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of captures.

    An archive's records are read in order of offset, ``READ_BYTES`` of it by a task; each is
    checked against its own digest.
    """
    rows = written(captures.select("file", "at", "size"), "pointers")
    total = rows.agg(F.sum("size")).first()[0] or 0
    part = F.floor(F.col("at") / F.lit(READ_BYTES))
    rows = rows.repartition(_tasks(rows, -(-total // READ_BYTES)), "file", part).sortWithinPartitions("file", "at")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, held, begin = None, None, b"", 0
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                found = []
                for name, at, size in zip(*(whole.slice(start, 512).column(k).to_pylist() for k in range(3)), strict=True):
                    if name != path:
                        fs, _ = file_system(folder)
                        path, file, held, begin = name, fs.open_input_file(name), b"", 0
                    if not begin <= at <= at + size <= begin + len(held):
                        held, begin = file.read_at(max(size, READ_AHEAD), at), at
                    x = parse_record(held[at - begin : at - begin + size])
                    f = x["fields"]
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    revisit = f["warc-type"] == "revisit"
                    if not revisit and base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode() != digest:
                        raise ValueError(f"{name} at {at}: the payload does not match its digest")
                    page_id, first = int(f["warc-page-id"]), int(f["warc-refers-to-page-id"]) if revisit else NO_ID
                    found.append((None if page_id == NO_ID else page_id, f["warc-target-uri"], x["payload_bytes"], digest, f["warc-type"], None if first == NO_ID else first, None if revisit else x["payload"]))
                c = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1]), pa.array(c[2]), pa.array(c[3]), pa.array(c[4]), pa.array(c[5], pa.int64()), pa.array(c[6], pa.binary())], names=names)

    return rows.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, list[dict]]:
    """Write archives and index of ``pages`` to a fresh folder: the folder and the index's ranges."""
    folder = scratch(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, page, url, html)
    ranges = write_index(captures, folder)
    forget(captures)
    return folder, ranges
