"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a seek table in a skippable frame ends each
archive (the seekable format of the Zstandard project), and an index maps every record id
to its frame and to the offset within the decompressed frame. Tasks write archives to the
shared folder under names of their own attempt; only the index rows that Spark commits
name an archive, so a lost executor leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, staged

FRAME_BYTES, ARCHIVE_BYTES, LEVEL = 1 << 20, 64 << 20, 3
#: Archives that a task reads, once there are enough for all cores.
ARCHIVES_A_TASK = 4
LEAST_BYTES = 100
#: Of monotonically_increasing_id(): what stands above these bits is the partition that a row was in.
PART_BITS = 33
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122


DATE = "1970-01-01T00:00:00Z"


def target_of(page_id: str | None, url: str | None) -> str:
    return (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")


def escaped(page_id: str) -> str:
    """An id as a header's field holds it: on one line."""
    return page_id.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unescaped(field: str | None) -> str | None:
    return None if field is None else field.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


def record_name(row: int, page_id: str | None, target: str, digest: str) -> str:
    """The id of a record: of its row's key too, so that equal rows have records of their own."""
    return f"urn:uuid:{uuid.uuid5(SPACE, f'{row}/{page_id}/{target}/{digest}')}"


def record(row: int, page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: dict | None) -> tuple[str, bytes]:
    """The record id and the record of a page. refers_to: row, id and url of a revisit's response; a revisit has the HTTP header of the full payload, without it."""
    target = target_of(page_id, url)
    name = record_name(row, page_id, target, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to:
        first = target_of(refers_to["id"], refers_to["url"])
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_name(refers_to['row'], refers_to['id'], first, digest)}>"), ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", escaped(refers_to["id"]))]
    fields += [("X-Page-ID", escaped(page_id))] if page_id is not None else []
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + block + b"\r\n\r\n"


def parse(data: memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at an offset of a decompressed frame."""
    raw = bytes(data[at : at + 65536])
    end = raw.find(b"\r\n\r\n")
    while end < 0 and len(raw) < len(data) - at:
        raw = bytes(data[at : at + 4 * len(raw)])
        end = raw.find(b"\r\n\r\n")
    first, *lines = raw[:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no record starts here")
    head = dict(x.split(": ", 1) for x in lines)
    start = at + end + 4
    stop = start + int(head["Content-Length"])
    return head, bytes(data[start:stop]), stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame of (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame of an open archive."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the archive has no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    table, out, at = file.read(n * width), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


class _Archive:
    """An archive being written, and the index rows of its records."""

    def __init__(self, folder: str) -> None:
        self.uri = posixpath.join(folder, f"{uuid.uuid4().hex}.warc.zst")
        files, path = pafs.FileSystem.from_uri(self.uri)
        self.out, self.packer = files.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.frame: list[bytes] = []
        self.fill = self.plain = self.packed = 0
        self.rows: list[tuple] = []
        self.waiting: list[tuple] = []

    def add(self, page_id: str | None, name: str, data: bytes) -> None:
        self.waiting.append((page_id, name, self.uri, len(self.frames), self.packed, self.fill, len(data)))
        self.frame.append(data)
        self.fill += len(data)
        if self.fill >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.out.write(packed)
            self.frames.append((len(packed), self.fill))
            self.rows += self.waiting
            self.plain, self.packed = self.plain + self.fill, self.packed + len(packed)
            self.frame, self.waiting, self.fill = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.rows


INDEX = pa.schema([("page_id", pa.string()), ("record_id", pa.string()), ("archive", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def _fates(uri: str, part: int) -> dict[int, dict]:
    """row -> the response that it revisits, of the rows of one part."""
    files, path = pafs.FileSystem.from_uri(posixpath.join(uri, f"part={part}"))
    if files.get_file_info(path).type == pafs.FileType.NotFound:
        return {}
    table = pq.read_table(path, filesystem=files, partitioning=None, columns=["row", "refers_to"])
    return dict(zip(table.column("row").to_pylist(), table.column("refers_to").to_pylist(), strict=True))


def _write(folder: str, fates: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, part, own = None, None, {}
        rows = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), INDEX.types)], schema=INDEX)
        for batch in batches:
            for k in range(len(batch)):
                row, page_id, url, payload, digest = (batch.column(c)[k].as_py() for c in range(5))
                if row >> PART_BITS != part:  # rows come in parts, one after another
                    part = row >> PART_BITS
                    own = _fates(fates, part)
                archive = archive or _Archive(folder)
                archive.add(page_id, *record(row, page_id, url, payload, digest, own.get(row)))
                if archive.plain >= ARCHIVE_BYTES:
                    yield rows(archive.close())
                    archive = None
        if archive:
            yield rows(archive.close())

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes a record per row into archives in the folder (a URI) now; returns the index, a table.

    Among rows with equal payloads of least_bytes or more, the one with the least id is a
    response and the others are revisits of it; of rows that repeat this id, one. Rows
    without id can be revisits; if no row of a payload has an id, all are responses.
    """
    spark = pages.sparkSession
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit("").cast("binary"))
    whole = pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    whole = staged(whole.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload")), "pages")
    # Keys, not payloads, are shuffled. Decisions lie in files by the part of a row's key, and a task that writes pages reads those of its parts.
    keyed = whole.where(F.col("size") >= least_bytes).select("row", "id", "url", "digest")
    known = F.when(F.col("id").isNotNull(), F.struct("id", "row", "url"))
    repeated = keyed.groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    fate = keyed.select("row", "digest").join(staged(repeated, "repeated"), "digest").where("row <> first.row").select("row", F.struct(F.col("first.row").alias("row"), F.col("first.id").cast("string").alias("id"), F.col("first.url").alias("url")).alias("refers_to"))
    fates = new_folder(spark, "fates")
    fate.withColumn("part", F.shiftright("row", PART_BITS)).repartition("part").write.partitionBy("part").parquet(fates)
    rows = whole.select("row", F.col("id").cast("string").alias("id"), "url", "payload", "digest")
    schema = "page_id string, record_id string, archive string, frame int, frame_start long, offset long, length long"
    return staged(rows.mapInArrow(_write(folder, fates), schema), "index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            files, path = pafs.FileSystem.from_uri(uri)
            with files.open_input_file(path) as file:
                for start, packed, plain in read_seek_table(file):
                    file.seek(start)
                    data = memoryview(zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain))
                    out, at = [], 0
                    while at < len(data):
                        head, block, at = parse(data, at)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{uri}: {head['WARC-Record-ID']} is damaged")
                        out.append((unescaped(head.get("X-Page-ID")), head["WARC-Target-URI"], size, digest, head["WARC-Type"], unescaped(head.get("X-Refers-To-Page-ID")), None if head["WARC-Type"] == "revisit" else payload))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), READ.types)], schema=READ)


READ = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def read_archives(index: DataFrame, id_type: str | T.DataType = "long", with_payload: bool = True) -> DataFrame:
    """A row per record of the archives that the index names, read frame by frame; each payload is checked against its digest."""
    columns = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    names = index.select("archive").distinct()
    n = names.count()
    # Names are few bytes, archives are not: a number of tasks that is asked for isn't coalesced.
    names = names.repartition(max(1, min(n, max(2 * index.sparkSession.sparkContext.defaultParallelism, n // ARCHIVES_A_TASK))))

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _read(batches):
            yield batch if with_payload else batch.select(READ.names[:-1])

    found = names.mapInArrow(slim, columns if with_payload else columns.removesuffix(", payload binary"))
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def fetch(row) -> tuple[dict[str, str], bytes]:
    """Header and block of one index row: reads and decompresses its frame only."""
    files, path = pafs.FileSystem.from_uri(row["archive"])
    with files.open_input_file(path) as file:
        start, packed, plain = read_seek_table(file)[row["frame"]]
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    return parse(memoryview(data), row["offset"])[:2]


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives of pages to a new shared folder, then reads them back.

    Per row of pages: the id, payload_bytes, payload_digest, record_type, refers_to. A null
    html is an empty payload; empty and short ones are never revisits; a null id stays null;
    ids and urls may hold line breaks, which are escaped in the archives; repeated rows each get their record; an empty table gives an empty result; other columns
    are ignored.
    """
    index = write_archives(pages, new_folder(pages.sparkSession, "warc"), id_col, url_col, html_col)
    found = read_archives(index, pages.schema[id_col].dataType, with_payload=False)
    return found.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL of op7 over the table pages.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first, row_number() OVER (PARTITION BY s ORDER BY page_id) AS k FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest, CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND k > 1 THEN first END AS refers_to FROM f
"""
