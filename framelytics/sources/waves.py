"""A data source of 16-bit PCM wave files that are read by byte ranges and written by tasks.

`register(spark)` makes the format "waves" known. A table has media_id, n and y: the file, the
sample's number and the mean of its channels in -1..1. Files are opened by pyarrow's file
systems. A written clip is a folder of its id with files named by their first sample; files
named so are read as parts of the clip that is their folder's name.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "media_id string, n long, y double"
#: Bytes of a task's share when reading, of a file when writing, and of what is decoded at once.
PART_BYTES, FILE_BYTES, BATCH_BYTES = 32_000_000, 64_000_000, 1_000_000
_PART = re.compile(r"n(\d+)-[0-9a-f]+\.wav")


@dataclass
class Range(InputPartition):
    """Byte ranges (path, first, end) of files."""

    ranges: list[tuple[str, int, int]]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system, and the path there; of a path without a scheme the local one, which all machines then share."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), posixpath.normpath(uri))


def header(file, size: int) -> tuple[int, int, int]:
    """(channels, where the samples begin, where they end) of an open 16-bit PCM file."""
    file.seek(0)
    if (start := file.read(12))[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise ValueError("not a wave file")
    at, channels = 12, 0
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            kind, channels, _, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            if bits != 16 or kind not in (1, 0xFFFE):
                raise ValueError("only 16-bit PCM is read")
        if name == b"data":
            if not channels:
                raise ValueError("samples come before their format")
            return channels, at + 8, min(size, at + 8 + length)  # a length that was never filled in ends with the file
        at += 8 + length + length % 2
    raise ValueError("a wave file without samples")


class WaveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.part = options["path"], int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[Range]:
        """Ranges of about partBytes: long files are cut, short ones share a task. Only names and sizes are looked at."""
        files, path = _open(self.path)
        found = files.get_file_info(path)
        infos = [found] if found.is_file else files.get_file_info(pafs.FileSelector(path, recursive=True))
        out, own, room = [], [], self.part
        for info in sorted((i for i in infos if i.is_file and i.path.lower().endswith(".wav")), key=lambda i: i.path):
            at = 0
            while at < info.size:
                end = min(info.size, at + room)
                own.append((info.path, at, end))
                room -= end - at
                at = end
                if not room:
                    out.append(Range(own))
                    own, room = [], self.part
        return [*out, Range(own)] if own or not out else out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The samples whose first byte is in the ranges."""
        files, _ = _open(self.path)
        for path, first, end in partition.ranges:
            part = _PART.fullmatch(posixpath.basename(path))
            name = unquote(posixpath.basename(posixpath.dirname(path))) if part else path
            with files.open_input_file(path) as file:
                channels, begin, last = header(file, file.size())
                frame = 2 * channels
                lo, hi = (-(-max(0, min(x, last) - begin) // frame) for x in (first, end))
                hi = min(hi, (last - begin) // frame)
                step = max(1, BATCH_BYTES // frame)
                for at in range(lo, hi, step):
                    some = min(step, hi - at)
                    file.seek(begin + at * frame)
                    y = np.frombuffer(file.read(some * frame), "<i2").reshape(-1, channels).mean(axis=1) / 32768
                    n = np.arange(at, at + some) + (int(part[1]) if part else 0)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * some, pa.string()), pa.array(n), pa.array(y)], names=["media_id", "n", "y"])


@dataclass
class Written(WriterCommitMessage):
    """Files as they are now called, and as they shall be."""

    renames: list[tuple[str, str]]


class WaveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.rate = options["path"], int(options.get("rate", 44100))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A file for each run of successive samples of a clip, under a hidden name until the job commits."""
        files, path = _open(self.path)
        renames: list[tuple[str, str]] = []
        clip, first, data = None, 0, bytearray()

        def close() -> None:
            if not data:
                return
            folder, own = posixpath.join(path, quote(str(clip), safe="")), uuid.uuid4().hex[:12]
            hidden, name = posixpath.join(folder, f".n{first}-{own}"), posixpath.join(folder, f"n{first}-{own}.wav")
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(hidden) as out:
                out.write(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, self.rate, 2 * self.rate, 2, 16) + b"data" + struct.pack("<I", len(data)))
                out.write(bytes(data))
            renames.append((hidden, name))
            data.clear()

        for batch in batches:
            ids, n, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).fill_null(0.0).to_numpy()
            values = np.clip(np.rint(y * 32768), -32768, 32767).astype("<i2")
            cuts = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1] or n[k] != n[k - 1] + 1], len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if ids[a] != clip or n[a] != first + len(data) // 2 or len(data) >= FILE_BYTES:
                    close()
                    clip, first = ids[a], int(n[a])
                data.extend(values[a:b].tobytes())
        close()
        return Written(renames)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = _open(self.path)
        for hidden, name in (r for m in messages if m for r in m.renames):
            files.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = _open(self.path)
        for hidden, _ in (r for m in messages if m for r in m.renames):
            files.delete_file(hidden)


class Waves(DataSource):
    """path; partBytes when reading; rate when writing."""

    @classmethod
    def name(cls) -> str:
        return "waves"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options)

    def writer(self, schema, overwrite: bool) -> WaveWriter:
        if overwrite:
            raise ValueError("a folder of waves is only added to")
        return WaveWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Waves)


def read_waves(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Samples of a wave file, or of all below a folder, each task reading about part_bytes."""
    register(spark)
    return spark.read.format("waves").option("path", path).option("partBytes", part_bytes).load()


def write_waves(samples: DataFrame, path: str, rate: int = 44100) -> None:
    """Samples (media_id, n, y) as 16-bit files of a range of samples each; clips are sorted by ranges, so a long one is written by many tasks."""
    register(samples.sparkSession)
    ordered = samples.selectExpr("cast(media_id AS string) AS media_id", "cast(n AS long) AS n", "cast(y AS double) AS y").repartitionByRange("media_id", "n").sortWithinPartitions("media_id", "n")
    ordered.write.format("waves").option("path", path).option("rate", rate).mode("append").save()
