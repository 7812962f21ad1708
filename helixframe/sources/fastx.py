"""FASTA and FASTQ files, plain or compressed.

Plain files are read in byte ranges, each a task: a range has the records that start in it, and starts with the first of
them, so a file of any size gives many tasks and the same rows however it is split.  Compressed files are one task each.  All are
read as streams; a record must fit a task (a genome's contig need not: it is read in blocks).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import each_file, listed_with_sizes, open_range

RECORD = "path string, record long, header string, seq string, error string"
#: Bytes of a plain file that one task reads.
SPLIT = 128 << 20


def parse(lines: Iterator[tuple[int, bytes]], path: str, end: int | None = None) -> Iterator[tuple[int, str, str]]:
    """(offset, header, sequence) of lines with their offsets, up to the first record that starts at `end` or beyond; white space
    inside sequences goes, other lines than records raise."""
    at, header, parts = 0, None, []
    for offset, line in lines:
        text = line.strip()
        if not text:
            continue
        if text[:1] == b">":
            if header is not None:
                yield at, header, b"".join(parts).decode()
                header = None
            if end is not None and offset >= end:
                return
            at, header, parts = offset, text[1:].decode().strip(), []
        elif header is not None:
            parts.append(b"".join(text.split()))
        elif text[:1] == b"@":
            if end is not None and offset >= end:
                return
            rest = [next(lines, (0, None))[1] for _ in range(3)]
            if None in rest or rest[1][:1] != b"+" or len(rest[0].strip()) != len(rest[2].strip()):
                raise ValueError(f"{path}: broken FASTQ record at byte {offset}")
            yield offset, text[1:].decode().strip(), rest[0].strip().decode()
        else:
            raise ValueError(f"{path}: neither FASTA nor FASTQ at byte {offset}")
    if header is not None:
        yield at, header, b"".join(parts).decode()


def _from_first_record(lines: Iterator[tuple[int, bytes]], fastq: bool) -> Iterator[tuple[int, bytes]]:
    """Lines from the first that starts a record.  A FASTQ header is told from a quality line that starts with @ by the line after
    the next, which starts with + (a sequence does not), and by equal lengths."""
    held: list[tuple[int, bytes]] = []
    for x in lines:
        held.append(x)
        if not fastq:
            if x[1][:1] == b">":
                yield x
                yield from lines
                return
            held.clear()
        elif len(held) == 4:
            a, b, c, d = (line for _, line in held)
            if a[:1] == b"@" and c[:1] == b"+" and len(b.strip()) == len(d.strip()):
                yield from held
                yield from lines
                return
            held.pop(0)


def records(uri: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str, str]]:
    """The records that start in a range of a file's bytes; of a compressed file, all in its first range and none in others."""
    with open_range(uri, start) as (lines, compressed, first):
        if compressed:
            if not start:
                yield from parse(lines, uri)
        else:
            yield from parse(lines if not start else _from_first_record(lines, first == b"@"), uri, end)


class SequenceRange(InputPartition):
    def __init__(self, uri: str, start: int, end: int):
        super().__init__((uri, start, end))


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.split, self.keep = json.loads(options["files"]), int(options["split"]), options["errors"] == "true"

    def partitions(self) -> list[InputPartition]:
        return [SequenceRange(uri, i, i + self.split) for uri, size in self.files for i in range(0, max(size, 1), self.split)]

    def read(self, partition: SequenceRange) -> Iterator[tuple]:
        uri, start, end = partition.value
        try:
            for at, header, seq in records(uri, start, end):
                yield uri, at, header, seq, None
        except (ValueError, OSError, EOFError) as wrong:  # a broken or vanished file, not a lost executor
            if not self.keep:
                raise
            yield uri, -1, None, None, f"{type(wrong).__name__}: {wrong}"
        except Exception as wrong:  # the libraries of codecs raise errors of their own
            if not self.keep or type(wrong).__module__.split(".")[0] not in ("zlib", "lzma", "_lzma", "zstandard", "gzip"):
                raise
            yield uri, -1, None, None, f"{type(wrong).__name__}: {wrong}"


class SequenceSource(DataSource):
    """Format `sequences`."""

    @classmethod
    def name(cls) -> str:
        return "sequences"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return SequenceReader(self.options)


def read_sequences(spark: SparkSession, paths: list[str], split: int = SPLIT, errors: bool = False) -> DataFrame:
    """(path, record, header, seq): `record` is the offset of a record in its file's (decompressed) bytes.

    With `errors`, a file that breaks does not end the job: where it breaks, its rows end with one whose `error` says why (and
    record is -1), so that what is whole can be told from what is not by one read.
    """
    spark.dataSource.register(SequenceSource)
    found = json.dumps(listed_with_sizes(spark, paths))
    rows = spark.read.format("sequences").option("files", found).option("split", split).option("errors", str(errors).lower()).load()
    return rows if errors else rows.drop("error")


def read_genome(spark: SparkSession, paths: list[str], block: int = 1 << 16) -> DataFrame:
    """(contig, place, block, bases): contigs in blocks of `block` bases, the last one shorter; a contig is named by the first
    word of its header, `place` is the order of files and records.  No contig is ever one string.

    Contigs that repeat, and files that are no FASTA or hold nothing, raise.
    """
    from ..functions.sequence import first_token

    order = {p: i for i, p in enumerate(paths)}

    def rows(path, stream):
        number = next((i for p, i in order.items() if path.endswith(p.rsplit(":", 1)[-1].lstrip("/"))), 0)
        header, at, n, parts, size = None, -1, 0, [], 0
        for i, line in enumerate(stream):
            text = line.strip()
            if not i and text[:1] == b"@":
                raise ValueError(f"{path}: a genome must be FASTA")
            if text[:1] == b">":
                if header is not None and (parts or not n):
                    yield header, (number << 32) + at, n, b"".join(parts).decode()
                header, at, n, parts, size = text[1:].decode().strip(), at + 1, 0, [], 0
            elif text and header is None:
                raise ValueError(f"{path}: neither FASTA nor FASTQ at line {i + 1}")
            elif text:
                parts.append(b"".join(text.split()))
                size += len(parts[-1])
                while size >= block:
                    whole = b"".join(parts)
                    yield header, (number << 32) + at, n, whole[:block].decode()
                    n, parts, size = n + 1, [whole[block:]] if size > block else [], size - block
        if header is None:
            raise ValueError(f"{path}: no sequences")
        if parts or not n:
            yield header, (number << 32) + at, n, b"".join(parts).decode()

    found = each_file(spark, paths, "header string, place long, block long, bases string", rows).select(first_token(F.col("header")).alias("contig"), "place", "block", "bases")
    twice = found.where("block = 0").groupBy("contig").count().where("count > 1").limit(10).collect()
    if twice:
        raise ValueError("contigs repeat: " + ", ".join(r[0] for r in twice))
    return found
