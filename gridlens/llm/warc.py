"""WARC records in ZIP packages, and a reader of such packages.

A package is a ZIP file with two stored (uncompressed) members: archive/data.warc.gz
holds the records, each gzip-compressed on its own, indexes/index.cdxj one line per record
with its offset and length inside the archive.  The reader parses the end record,
the ZIP64 records and the central directory from the tail of the file, finds the
members, reads the index, and then fetches single records by byte range.  Nothing
is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.shared import scratch, table, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 32 << 20
U16, U32 = 0xFFFF, 0xFFFFFFFF


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


# Writing


class Package:
    """Writes one ZIP file front to back; all header fields that can grow are in ZIP64 form."""

    def __init__(self, out):
        self.out, self.members, self.open = out, [], None

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = {"name": raw, "header": self.out.tell(), "crc": 0, "size": 0}
        # sizes follow the data in a descriptor (flag bit 3); the extra field announces that they have 8 bytes
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.out.write(struct.pack("<4s5H3L2H", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, U32, U32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Appends to the open member; returns the offset inside it."""
        at = self.open["size"]
        self.out.write(data)
        self.open["crc"] = zlib.crc32(data, self.open["crc"])
        self.open["size"] += len(data)
        return at

    def end(self) -> None:
        m = self.open
        self.out.write(struct.pack("<4sLQQ", b"PK\x07\x08", m["crc"], m["size"], m["size"]))
        self.members.append(m)

    def close(self) -> None:
        start = self.out.tell()
        for m in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["header"])
            fixed = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, m["crc"], U32, U32, len(m["name"]), len(extra), 0, 0, 0, 0, U32)
            self.out.write(fixed + m["name"] + extra)
        size, n, end = self.out.tell() - start, len(self.members), self.out.tell()
        self.out.write(struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
        self.out.write(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
        self.out.write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, U16, U16, U32, U32, 0))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value) -> str:
    """A header value on one line."""
    return " ".join(str("" if value is None else value).split())


def record_bytes(page_id, url, payload: bytes, first) -> bytes:
    """One WARC record: a response with its payload, or a revisit of page `first` with the HTTP head only.

    Ids are texts and stand percent-encoded in their headers; a null id has no header.
    """
    kind = "response" if first is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id, safe='')}")
    if first is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{first}')}>",
            f"X-Refers-To-Page: {quote(first, safe='')}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages plus `_first`: the smallest page_id with the same payload where this page revisits it, else null.

    Payloads of fewer than `least` bytes are never revisits.  Rows that repeat the
    smallest page_id are all responses; a null page_id is never the first, and a
    payload seen only under null ids has no first.  Digests are combined before
    the shuffle, and only those with two pages or more take part in the join.
    """
    rows = pages.withColumn("_sha", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    long = rows.where(F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least)
    seen = long.groupBy("_sha").agg(F.min("page_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    repeated = written(seen.where("_n > 1 and _least is not null").select(F.col("_sha").alias("_s"), "_least"), "digests")
    joined = rows.join(repeated, F.col("_sha") == F.col("_s"), "left")
    large = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least
    first = F.when(large & ~F.col("page_id").eqNullSafe(F.col("_least")), F.col("_least"))
    return joined.select(*pages.columns, first.alias("_first"))


def write_packages(pages: DataFrame, path: str, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes all pages as packages below `path`; returns the manifest (package, bytes, records), itself a stored table.

    A null html is an empty payload, a null url an empty line.  Ids may have any type
    that Spark casts to a text and back; they are compared in their own type and stored
    as texts.  Repeated rows are stored each.  An empty table gives an empty manifest.
    A task that runs twice writes under new names; the manifest lists the packages of
    the attempts that were committed, and the reader opens no others.
    """
    rows = with_first(pages.select("page_id", "url", "html"), least)
    rows = rows.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "html", F.col("_first").cast("string"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        state = None

        def finish() -> pa.RecordBatch:
            package, out, name, index = state
            package.end()
            package.begin(INDEX)
            package.write("".join(index).encode())
            package.end()
            package.close()
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([size], pa.int64()), pa.array([len(index)], pa.int64())], ["package", "bytes", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if state is None:
                    name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{folder}/{name}")
                    state = (Package(out), out, name, [])
                    state[0].begin(ARCHIVE)
                package, _, _, index = state
                raw = gzip.compress(record_bytes(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "surrogatepass"), row["_first"]), 1, mtime=0)
                at = package.write(raw)
                index.append(json.dumps({"page": row["page_id"], "offset": at, "length": len(raw)}) + "\n")
                if at + len(raw) >= package_bytes:
                    yield finish()
                    state = None
        if state is not None:
            yield finish()

    return written(rows.mapInArrow(write, "package string, bytes long, records long"), "packages")


# Reading


class Archive:
    """Random access to a ZIP file through its directory."""

    def __init__(self, file, size: int):
        self.file = file
        self.members = {m["name"]: m for m in self._directory(size)}

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"the package ends before byte {at + length}")
        return data

    def _directory(self, size: int) -> Iterator[dict]:
        tail_at = max(0, size - 22 - U16)
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        n, length, start = struct.unpack_from("<HLL", tail, at + 10)
        if U16 == n or U32 in (length, start):
            end_at = tail_at + at - 20
            mark, _, record, _ = struct.unpack("<4sLQL", self.read(end_at, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, *_, n, length, start = struct.unpack("<4sQHHLLQQQQ", self.read(record, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
        directory, at = self.read(start, length), 0
        for _ in range(n):
            mark, _, _, flags, method, _, _, crc, packed, full, n_name, n_extra, n_note, _, _, _, header = struct.unpack_from("<4s6H3L5H2L", directory, at)
            if mark != b"PK\x01\x02":
                raise ValueError("damaged ZIP directory")
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            wide, k = b"", 0
            while k + 4 <= len(extra):
                kind, size_k = struct.unpack_from("<HH", extra, k)
                if kind == 1:
                    wide = extra[k + 4 : k + 4 + size_k]
                k += 4 + size_k
            values = []
            for v in (full, packed, header):  # only the fields at their limit stand in the ZIP64 field, in this order
                if v == U32:
                    v, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
                values.append(v)
            yield {"name": name, "method": method, "crc": crc, "size": values[0], "packed": values[1], "header": values[2]}
            at += 46 + n_name + n_extra + n_note

    def start(self, name: str) -> int:
        """First data byte of a stored member."""
        member = self.members.get(name)
        if member is None or member["method"] != 0:
            raise ValueError(f"no stored member {name}")
        fixed = self.read(member["header"], 30)
        if fixed[:4] != b"PK\x03\x04":
            raise ValueError("damaged ZIP member header")
        n_name, n_extra = struct.unpack_from("<HH", fixed, 26)
        return member["header"] + 30 + n_name + n_extra


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one compressed record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


RECORD_SCHEMA = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def runs_of(entries: list[dict], bytes_per_read: int) -> list[list[dict]]:
    """Neighbouring index entries of at most bytes_per_read together, or one entry that is longer."""
    runs, size = [], 0
    for entry in entries:
        if not runs or size + entry["length"] > bytes_per_read:
            runs.append([])
            size = 0
        runs[-1].append(entry)
        size += entry["length"]
    return runs


def read_packages(manifest: DataFrame, id_type: str = "bigint", bytes_per_read: int = 1 << 20, bytes_per_batch: int = 16 << 20, bytes_per_task: int = 8 << 20) -> DataFrame:
    """One row per record of the listed packages; `payload` is null for revisits, ids are cast to `id_type`.

    A first pass reads directories and indexes only and gives runs of records by their
    stored bytes; the runs are dealt out evenly and read by byte range.  Rows leave a
    task once their payloads reach bytes_per_batch.  An empty manifest gives no rows.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = open_store(row["package"])
                with store.open_input_file(name) as file:
                    archive = Archive(file, row["bytes"])
                    base = archive.start(ARCHIVE)
                    index = archive.read(archive.start(INDEX), archive.members[INDEX]["size"])
                if zlib.crc32(index) != archive.members[INDEX]["crc"]:
                    raise ValueError(f"damaged index in {row['package']}")
                entries = [json.loads(x) for x in index.decode().splitlines()]
                runs = runs_of(entries, bytes_per_read)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["package"]] * len(runs)), pa.array([base + r[0]["offset"] for r in runs], pa.int64()), pa.array([[e["length"] for e in r] for r in runs], pa.list_(pa.int64()))],
                    ["package", "at", "lengths"],
                )

    def records(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = open_store(row["package"])
                with store.open_input_file(name) as file:
                    file.seek(row["at"])
                    data = file.read(sum(row["lengths"]))
                rows, at, held = [], 0, 0
                for length in row["lengths"]:
                    h, block = parse_record(data[at : at + length])
                    at += length
                    payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                    page_id, refers_to = (unquote(h[key]) if key in h else None for key in ("x-page-id", "x-refers-to-page"))
                    rows.append((page_id, h["warc-target-uri"], h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"]), refers_to, payload))
                    held += len(payload or b"")
                    if held >= bytes_per_batch:
                        yield records(rows)
                        rows, held = [], 0
                if rows:
                    yield records(rows)

    runs = manifest.select("package", "bytes").mapInArrow(locate, "package string, at long, lengths array<long>")
    # runs are small rows that stand for much reading: dealt by the bytes of the packages, which adaptive execution doesn't see
    parts = 1 + (manifest.agg(F.sum("bytes")).first()[0] or 0) // bytes_per_task
    found = runs.repartition(parts, F.xxhash64("package", "at")).mapInArrow(fetch, RECORD_SCHEMA)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    manifest = write_packages(pages, scratch(spark, "warc"))
    return read_packages(manifest, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 takes five bits a letter: five hexadecimal digits of the SHA-1 give four letters
OP8_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM coalesce(least, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM coalesce(least, page_id) THEN least END AS refers_to FROM q"""
