"""FASTA and FASTQ files as a Spark data source: spark.read.format("fastx").load(path).

Plain files are read in byte ranges, each by a task of its own: a range begins at the first record that starts in it and
ends where the next range begins. gzip and bzip2 files stream through one task each. No file is ever held whole.
"""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

SCHEMA = "path string, offset long, name string, seq string, quality string"
SPLIT = 64 << 20
ROWS = 10_000
CHUNK = 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int  # -1: the whole file, as it cannot be split


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[fs.FileInfo]:
    """The file, or the directory's files but hidden ones, in order of name."""
    system, where = located(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def lines(stream, offset: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of a stream that stands at a line's beginning."""
    held = b""
    while chunk := stream.read(CHUNK):
        *whole, held = (held + chunk).split(b"\n")
        for line in whole:
            yield offset, line.rstrip(b"\r")
            offset += len(line) + 1
    if held:
        yield offset, held.rstrip(b"\r")


def records(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, str, str, str | None]]:
    """(offset, name, sequence, quality) of FASTA and FASTQ records, both over several lines; quality None for FASTA."""
    began, name, seq = 0, None, []
    for offset, line in rows:
        if line[:1] in (b">", b"@"):
            if name is not None:
                yield began, name, b"".join(seq).decode("ascii"), None
            words = line[1:].split(None, 1)
            began, name, seq = offset, words[0].decode() if words else "", []
        elif line[:1] == b"+" and name is not None:
            bases, quality = b"".join(seq), b""
            while len(quality) < len(bases) and (more := next(rows, None)) is not None:
                quality += more[1].strip()
            if len(quality) != len(bases):
                raise ValueError(f"record {name}: quality has {len(quality)} symbols for {len(bases)} bases")
            yield began, name, bases.decode("ascii"), quality.decode("ascii")
            name, seq = None, []
        elif name is not None:
            seq.append(line.strip())
        elif line.strip():
            raise ValueError(f"no record at byte {offset}")
    if name is not None:
        yield began, name, b"".join(seq).decode("ascii"), None


def first_record(stream, at: int, size: int) -> int:
    """The first byte from `at` on at which a record starts, or the file's size.

    A FASTA record starts with ">". In FASTQ "@" may also begin a quality, so a start is a line with "@" whose second
    next begins with "+" and whose first and third next are equally long; this is certain for records of four lines.
    """
    if at == 0:
        return 0
    stream.seek(0)
    fasta = stream.read(1) == b">"
    stream.seek(at - 1)
    rows = lines(stream, at - 1)
    next(rows, None)  # the line that goes on from before, or the end of it
    window: list[tuple[int, bytes]] = []
    for row in rows:
        if fasta and row[1][:1] == b">":
            return row[0]
        window = [*window[-3:], row]
        if not fasta and len(window) == 4 and window[0][1][:1] == b"@" and window[2][1][:1] == b"+" and len(window[1][1]) == len(window[3][1]):
            return window[0][0]
    return size


class FastxReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        out = []
        for f in files_of(self.path):
            system, _ = located(self.path)
            with system.open_input_file(f.path) as s:
                packed = s.read(3)[:2] in (b"\x1f\x8b", b"BZ")
            if packed or not self.split:
                out.append(Range(f.path, 0, -1))
            else:
                out += [Range(f.path, at, min(at + self.split, f.size)) for at in range(0, f.size, self.split)]
        return out or [Range("", 0, 0)]

    def _found(self, part: Range) -> Iterator[tuple[int, str, str, str | None]]:
        system, _ = located(self.path)
        with system.open_input_file(part.path) as s:
            if part.end < 0:
                head = s.read(2)
                s.seek(0)
                yield from records(lines(gzip.GzipFile(fileobj=s) if head == b"\x1f\x8b" else bz2.BZ2File(s) if head == b"BZ" else s, 0))
                return
            size = s.size()
            start, end = first_record(s, part.start, size), first_record(s, part.end, size) if part.end < size else size
            if start >= end:
                return
            s.seek(start)
            for record in records(lines(s, start)):
                if record[0] >= end:
                    if record[0] > end:
                        break
                    return
                yield record
            if end < size:
                raise ValueError(f"{part.path}: records are not of four lines; read with splitBytes 0")

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        kinds, rows = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), []
        names = ["path", "offset", "name", "seq", "quality"]
        for record in self._found(part):
            rows.append((part.path, *record))
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Fastx(DataSource):
    """Options: path, splitBytes (0: files are not split, as FASTQ over more than four lines a record needs)."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


def read_fastx(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, offset (of the record in its file's text), name, seq, quality of every record of a file or a directory's files.

    An empty file has no rows. A FASTQ record over several lines is an error where it meets a range's end.
    """
    ship(spark)
    spark.dataSource.register(Fastx)
    return spark.read.format("fastx").option("splitBytes", split).load(path)
