"""Files opened inside tasks as streams, plain or compressed by gzip, xz or zstd (told by their first bytes; members may be joined)."""

from __future__ import annotations

import gzip
import io
import lzma
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class _Zstd(io.RawIOBase):
    """The bytes of joined zstd frames; a last frame that is not whole raises, which the library's own stream does not."""

    def __init__(self, raw):
        import zstandard

        self.raw, self.new, self.frame, self.left = raw, zstandard.ZstdDecompressor().decompressobj, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.left:
            data = self.raw.read(1 << 16)
            if not data:
                if self.frame is not None and not self.frame.eof:
                    raise EOFError("a zstd frame ended early")
                return 0
            parts = []
            while data:
                if self.frame is None or self.frame.eof:
                    self.frame = self.new()
                parts.append(self.frame.decompress(data))
                data = self.frame.unused_data if self.frame.eof else b""
            self.left = b"".join(parts)
        n = min(len(buffer), len(self.left))
        buffer[:n], self.left = self.left[:n], self.left[n:]
        return n


def open_plain(uri: str):
    """A binary stream of the decompressed bytes of a file on any file system that Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    raw = io.BufferedReader(system.open_input_stream(path, compression=None), 1 << 20)
    magic = raw.peek(6)
    if magic[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=raw)
    if magic[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMAFile(raw)
    if magic[:4] == b"\x28\xb5\x2f\xfd":
        return io.BufferedReader(_Zstd(raw), 1 << 20)
    return raw


def open_range(uri: str, start: int):
    """A context with (lines with their offsets, whether the file is compressed, its first byte).

    The lines of a plain file are those that start at `start` or later; of a compressed one, all, with offsets in what is
    decompressed (and none is read if start is not 0).
    """
    from contextlib import contextmanager

    @contextmanager
    def opened():
        from pyarrow import fs

        name = "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
        system, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
        with system.open_input_file(path) as whole:
            head = whole.read(1 << 16)
            compressed = head[:2] == b"\x1f\x8b" or head[:6] == b"\xfd7zXZ\x00" or head[:4] == b"\x28\xb5\x2f\xfd"
            if compressed:
                if start:
                    yield iter(()), True, b""
                else:
                    with open_plain(uri) as stream:
                        yield _offsets(stream, 0), True, b""
                return
            whole.seek(max(0, start - 1))
            stream, at = io.BufferedReader(whole, 1 << 20), start
            if start:
                at = start - 1 + len(stream.readline())  # what is left of the line before
            yield _offsets(stream, at), False, head.lstrip()[:1]

    return opened()


def _offsets(stream, at: int) -> Iterator[tuple[int, bytes]]:
    for line in stream:
        yield at, line
        at += len(line)


def listed(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files of paths, patterns and folders (without what starts with . or _); a path that has none raises."""
    return [name for name, _ in listed_with_sizes(spark, paths)]


def listed_with_sizes(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """As listed(), with the files' bytes."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = p.getFileSystem(spark._jsc.hadoopConfiguration())
        hits = list(system.globStatus(p) or [])
        inner = [x for h in hits for x in (system.listStatus(h.getPath()) if h.isDirectory() else [h])]
        names = sorted((x.getPath().toString(), x.getLen()) for x in inner if x.isFile() and not (len(inner) > 1 and x.getPath().getName()[:1] in "._"))
        if not names:
            raise FileNotFoundError(path)
        out += names
    return out


def each_file(spark: SparkSession, paths: list[str], schema: str, rows: Callable[[str, object], Iterator[tuple]], most: int = 8 << 20) -> DataFrame:
    """The rows that rows(path, stream) yields for each file, in batches of about `most` characters.  A file is a task of its
    own and is read as a stream; only paths are listed here, contents are not."""
    found = listed(spark, paths)
    files = spark.createDataFrame([(x,) for x in found], "path string").repartition(len(found), "path")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for f, x in zip(arrow, zip(*some, strict=True), strict=True)], schema=arrow)

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                some, size = [], 0
                with open_plain(path) as stream:
                    for row in rows(path, stream):
                        some.append(row)
                        size += 64 + sum(len(x) for x in row if isinstance(x, str))
                        if size >= most:
                            yield batch(some)
                            some, size = [], 0
                if some:
                    yield batch(some)

    return files.mapInArrow(run, schema)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line, text): lines are numbered from 1 within a file."""

    def rows(path, stream):
        for n, line in enumerate(stream, 1):
            yield path, n, line.decode("utf-8").rstrip("\r\n")

    return each_file(spark, paths, "path string, line long, text string", rows)
