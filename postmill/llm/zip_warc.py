"""WARC records in ZIP packages: written, listed from their directories, and read by byte ranges.

A package is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member
per record, and ``indexes/index.cdxj``, one line per record with its offset and length within the
archive. The reader parses the end-of-directory record (ZIP64 where there is one), the central
directory and the local headers, takes the index, and then reads each record by its own range:
nothing is extracted and no package is read whole.

Packages are put under a name of their own per task attempt, and only those whose names a
finished task returned are read, so a repeated or lost task leaves no record twice; the packages
of attempts that did not finish are removed once all is written.

A null payload is empty. Of records with equal payloads of ``REVISIT_BYTES`` or more, those with the
smallest id are responses and the others revisit it; shorter ones are all responses. Repeated rows
each have a record, under one record id where page and payload are equal. Rows with a null id are
written, and refer to nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, strings, text_batches, written

REVISIT_BYTES = 100
#: A task begins a new package after this many bytes of archive.
PACKAGE_BYTES = 64 << 20
#: What a task reads of one package in a row, and bytes of text to a byte of archive, about.
PIECE_BYTES, UNPACKED = 1 << 20, 4
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_LIMIT32 = 0xFFFFFFFF


def _files(uri: str):
    """A file system and the path in it; local, HDFS and object stores by their URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


# ---- ZIP --------------------------------------------------------------------------------------


class ZipWriter:
    """Stored members, one after the other; sizes of a streamed member follow in its ZIP64 data descriptor."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])  # name, header offset, size, checksum
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, _LIMIT32, _LIMIT32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Add to the member; its size so far."""
        m = self.members[-1]
        self._put(data)
        m[2], m[3] = m[2] + len(data), zlib.crc32(data, m[3])
        return m[2]

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        begin = self.at
        for raw, offset, size, crc in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, _LIMIT32, _LIMIT32, len(raw), len(extra), 0, 0, 0, 0, _LIMIT32) + raw + extra)
        size, end, n = self.at - begin, self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, _LIMIT32), _LIMIT32, 0))


def read_range(f: BinaryIO, offset: int, length: int) -> bytes:
    f.seek(offset)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"{length} bytes at {offset} asked for, {len(data)} found")
    return data


def zip_members(f: BinaryIO, size: int) -> dict[str, tuple[int, int, int]]:
    """Name -> (compression method, offset of the member's data, its stored size), from the directories."""
    tail_at = max(0, size - 65_557)
    tail = read_range(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, begin = struct.unpack_from("<HII", tail, end + 10)
    where = tail_at + end - 20
    if where >= 0 and 0 in (0xFFFF - n, _LIMIT32 - length, _LIMIT32 - begin):
        mark, _, record, _ = struct.unpack("<IIQI", read_range(f, where, 20))
        if mark == 0x07064B50:
            head = read_range(f, record, 56)
            if head[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, length, begin = struct.unpack_from("<QQQ", head, 32)
    directory, at, out = read_range(f, begin, length), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, full, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_n].decode()
        extra, k = directory[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while k + 4 <= len(extra):
            kind, field_n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{field_n // 8}Q", extra, k + 4))
                full = next(wide) if full == _LIMIT32 else full
                packed = next(wide) if packed == _LIMIT32 else packed
                header = next(wide) if header == _LIMIT32 else header
            k += 4 + field_n
        local = read_range(f, header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        out[name] = (method, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + name_n + extra_n + note_n
    return out


# ---- WARC -------------------------------------------------------------------------------------


def record_id(page: str | None, digest: str) -> str:
    """The id of a page's record, the same wherever it is worked out; one of its own for a page without an id."""
    made = uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f"{digest}/{quote(page, safe='')}")
    return f"<urn:uuid:{made}>"


def warc_record(kind: str, page: str | None, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member: an HTTP response, of which a revisit has the head alone."""
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in uri)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", *([f"X-Page-Id: {quote(page)}"] if page is not None else [])]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {quote(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _fields(lines: list[str]) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines)


def parse_warc(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one gzip-packed record."""
    data = zlib.decompress(raw, 31)
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = _fields(lines)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    end = block.index(b"\r\n\r\n")
    _, *lines = block[:end].decode().split("\r\n")
    return head, _fields(lines), block[end + 4 :]


class _Package:
    """One open package; records are appended, then index and directories."""

    def __init__(self, folder: str):
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.uri, self.index, self.size = f"{folder}/{name}", [], 0
        self.out = files.open_output_stream(f"{path}/{name}")
        self.zip = ZipWriter(self.out)
        self.zip.begin(ARCHIVE)

    def add(self, record: bytes, page: str | None) -> None:
        begin, self.size = self.size, self.zip.write(record)
        self.index.append(json.dumps({"page": page, "offset": begin, "length": len(record)}))

    def close(self) -> tuple[str, int, int]:
        self.zip.end()
        self.zip.begin(INDEX)
        self.zip.write("\n".join(self.index).encode())
        self.zip.end()
        self.zip.close()
        self.out.close()
        return self.uri, self.zip.at, len(self.index)


def _write(folder: str, most: int):
    def apply(batches: Iterator[pa.RecordBatch]):
        package, done = None, []
        for batch in batches:
            for page, uri, html, digest, kind, refers in zip(*(c.to_pylist() for c in (batch.column(0), *map(strings, batch.columns[1:4]))), *(c.to_pylist() for c in batch.columns[4:])):
                package = package or _Package(folder)
                package.add(warc_record(kind, page, uri, html.encode("utf-8", "surrogatepass"), digest, refers), page)
                if package.size >= most:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["package", "bytes", "records"])

    return apply


def payload_types(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """``pages`` with payload_digest, record_type and refers_to (as text)."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(payload_col).cast("string").alias("payload"), *(F.col(c) for c in ("uri",) if c in pages.columns))
    rows = rows.withColumn("payload", payload).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    # Only digests that several records share; the table is cut so that a hot digest's rows can be split in the join.
    firsts = written(
        rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= REVISIT_BYTES)
    return (rows.join(firsts, "digest", "left")
            .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first"))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row's record; the finished packages as (package, bytes, records)."""
    text_batches(pages.sparkSession, 256)
    typed = payload_types(pages.withColumn("uri", F.col(url_col).cast("string")), id_col, payload_col)
    done = written(
        typed.select(F.col("id").cast("string").alias("page"), "uri", "payload", "digest", "record_type", F.col("refers_to").cast("string").alias("refers"))
        .mapInArrow(_write(folder, package_bytes), "package string, bytes bigint, records bigint"), "packages")
    if not done.isEmpty():
        remove_leftovers(done, folder)
    return done


def remove_leftovers(packages: DataFrame, folder: str) -> None:
    """Remove the packages of a folder that no finished task returned; for use once nothing writes there any more."""

    def remove(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = _files(f"{folder}/{name}")
                files.delete_file(path)
            yield batch

    name = lambda c: F.substring_index(c, "/", -1).alias("name")
    there = packages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select(name("path"))
    there.join(packages.select(name("package")), "name", "left_anti").mapInArrow(remove, "name string").count()


def _locate(batches):
    for batch in batches:
        for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            files, path = _files(uri)
            with files.open_input_file(path) as f:
                members = zip_members(f, size)
                method, begin, length = members[INDEX]
                base = members[ARCHIVE]
                if method or base[0]:
                    raise ValueError(f"{uri}: members must be stored")
                lines = [json.loads(x) for x in read_range(f, begin, length).decode().splitlines()]
            for k in range(0, len(lines), 10_000):
                part = lines[k : k + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(part)), pa.array([base[1] + x["offset"] for x in part], pa.int64()), pa.array([x["length"] for x in part], pa.int64())],
                    names=["package", "offset", "length"])


def _read(batches):
    files, at, f = None, None, None
    for batch in batches:
        rows = []
        for uri, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
            if uri != at:
                if f:
                    f.close()
                files, path = _files(uri)
                f, at = files.open_input_file(path), uri
            head, http, body = parse_warc(read_range(f, offset, length))
            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"{uri}: payload at {offset} does not have the digest it was written with")
            page, refers = (x if x is None else unquote(x) for x in (head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")))
            rows.append((page, head["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, refers, body))
        if rows:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             names=["page", "uri", "payload_bytes", "payload_digest", "record_type", "refers", "payload"])
    if f:
        f.close()


def read_packages(packages: DataFrame) -> DataFrame:
    """(page, uri, payload_bytes, payload_digest, record_type, refers, payload) of every record of (package, bytes) rows.

    Each package's directories and index are read first; then its records' ranges are dealt out in
    pieces of a few megabytes, sorted by place, so that one large package is read by many tasks.
    There are as many tasks as the packages' bytes fill splits of the session's size, taking one
    byte here for ``UNPACKED`` of text: the rows that are shuffled are too small to tell.
    """
    spark = packages.sparkSession
    text_batches(spark, 256)
    split = max(1, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() // UNPACKED)
    tasks = max(1, -(-(packages.agg(F.sum("bytes")).first()[0] or 0) // split))
    places = packages.select("package", "bytes").mapInArrow(_locate, "package string, offset bigint, length bigint")
    piece = F.floor(F.col("offset") / min(PIECE_BYTES, split))
    dealt = places.withColumn("piece", piece).repartition(tasks, "package", "piece").sortWithinPartitions("package", "offset")
    return dealt.select("package", "offset", "length").mapInArrow(
        _read, "page string, uri string, payload_bytes bigint, payload_digest string, record_type string, refers string, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record of a ZIP package and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = write_packages(pages, new_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    return read_packages(packages).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS g FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM f
"""
