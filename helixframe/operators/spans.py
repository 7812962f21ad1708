"""Counting against records in one pass: neighbouring windows travel together, as spans that share a minimizer.

A window's minimizer is the least hash of its canonical m-mers, which its reverse complement shares, so equal k-mers of records and
reads meet in one bucket.  A span (the windows in a row with one minimizer) takes its bases once, two bits each, and a number: of a
record its target, of reads their distinct sequence.  Windows of a sequence are made once, however many datasets have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut
from .index import _CODE, blocks, canonical, window_codes

#: Places by minimizer; what a task holds at once is the records' k-mers of one of them.
BUCKETS = 1024
#: Windows that a span has at most, and windows of reads that are looked up at once.
LONGEST, AT_ONCE = 200, 1 << 21
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_SCHEMA = "bucket int, side int, numbers binary, windows binary, bases binary"


def minimizer_length(k: int) -> int:
    """Short k-mers are their own minimizers: there would be too few shorter ones to deal out by."""
    return k if k < 15 else min(k - 6, 13)


def _spans(raw: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first base, windows, bucket) of the spans of a block."""
    code = _CODE[raw]
    n = len(code) - k + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    at = np.flatnonzero(bad[k:] == bad[:n])
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 3
    where, words = window_codes(raw, m)
    hashes = np.full(len(code) - m + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    mixed = words[0] * _MIX[0]
    hashes[where] = mixed ^ (mixed >> np.uint64(29))
    least = hashes[:n].copy()
    for j in range(1, k - m + 1):
        np.minimum(least, hashes[j : j + n], out=least)
    least = least[at]
    fresh = np.append(True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]))
    starts = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    starts = np.flatnonzero(fresh | (place % LONGEST == 0))
    return at[starts], np.diff(np.append(starts, len(at))), ((least[starts] * _MIX[1]) >> np.uint64(32)).astype(np.int64) % BUCKETS


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers by the place of their bytes, so that Spark's codec finds the high ones equal."""
    return np.ascontiguousarray(numbers, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def spans(rows: DataFrame, number: str, seq: str, k: int, side: int, block: int = 1 << 20) -> DataFrame:
    """(bucket, side, numbers, windows, bases): a row for each bucket of a block of sequences, with all its spans."""
    m = minimizer_length(k)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for raw, row in blocks(batch.column(1), k, block):
                first, windows, bucket = _spans(raw, k, m)
                if not len(first):
                    continue
                order = np.argsort(bucket, kind="stable")
                first, windows, bucket = first[order], windows[order], bucket[order]
                sizes = windows + k - 1
                ends = np.cumsum(sizes)
                two = _CODE[raw][np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1])]
                numbers, heads = own[row[first]], np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                out: tuple = ([], [], [])
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
                    part = two[ends[a] - sizes[a] : ends[b - 1]]
                    four = np.concatenate([part, np.zeros(-len(part) % 4, dtype=np.uint8)]).reshape(-1, 4)
                    out[0].append(_planes(numbers[a:b]))
                    out[1].append(windows[a:b].astype(np.uint8).tobytes())
                    out[2].append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[heads], pa.int32()), pa.array(np.full(len(heads), side), pa.int32()), *(pa.array(x, pa.binary()) for x in out)], names=["bucket", "side", "numbers", "windows", "bases"])

    return rows.where(F.col(number).isNotNull()).select(F.col(number).cast("long"), seq).mapInArrow(run, _SCHEMA)


def _windows(parts: list[tuple[bytes, bytes, bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, k-mer) of each window of some rows of spans(); k-mers as whole numbers, above 31 bases as 16 bytes."""
    numbers, windows, codes = [], [], []
    for raw, counts, bases in parts:
        numbers.append(_numbers(raw))
        windows.append(np.frombuffer(counts, dtype=np.uint8).astype(np.int64))
        four = np.frombuffer(bases, dtype=np.uint8)
        codes.append(np.column_stack([four & 3, four >> 2 & 3, four >> 4 & 3, four >> 6]).ravel()[: int((windows[-1] + k - 1).sum())])
    many = np.concatenate(windows)
    before = np.cumsum(many + k - 1) - (many + k - 1)
    at = np.repeat(before - (np.cumsum(many) - many), many) + np.arange(many.sum())
    words = canonical(np.concatenate(codes), at, k)
    return np.repeat(np.concatenate(numbers), many), words[0] if len(words) == 1 else np.column_stack(words).astype(">u8").view("S16").ravel()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of rows by keys, where each group of equal ones begins in it)."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(fresh)


def _owned(parts: list[tuple[bytes, bytes, bytes]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer, target) of the k-mers of a bucket that one target only has, in order."""
    target, ck = _windows(parts, k)
    order, starts = _groups(ck)
    low, high = np.minimum.reduceat(target[order], starts), np.maximum.reduceat(target[order], starts)
    only = low == high
    return ck[order][starts][only], low[only]


def owned_windows(both: DataFrame, k: int) -> DataFrame:
    """(number, target, windows) of spans of records (side 0) and of reads (side 1): how many windows of a read's sequence belong to
    one target only, in parts that are to be summed.  A bucket's records are held, its reads pass by."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, mine, held, size = None, [], [], 0
        table: tuple | None = None

        def looked_up() -> Iterator[pa.RecordBatch]:
            nonlocal table, held, size
            parts, held, size = held, [], 0
            if not parts or not mine:
                return
            if table is None:
                table = _owned(mine, k)
            if not len(table[0]):
                return
            number, ck = _windows(parts, k)
            place = np.minimum(np.searchsorted(table[0], ck), len(table[0]) - 1)
            hit = table[0][place] == ck
            number, target = number[hit], table[1][place[hit]]
            if len(number):
                order, starts = _groups(number, target)
                yield pa.RecordBatch.from_arrays([pa.array(number[order][starts]), pa.array(target[order][starts]), pa.array(np.diff(np.append(starts, len(order))))], names=["number", "target", "windows"])

        for batch in batches:
            places, sides = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (bucket, side) in enumerate(zip(places, sides, strict=True)):
                if bucket != now:
                    yield from looked_up()
                    now, mine, table = bucket, [], None
                part = tuple(batch.column(c)[i].as_py() for c in (2, 3, 4))
                if side == 0:
                    mine.append(part)
                    continue
                held.append(part)
                size += 4 * len(part[2])
                if size >= AT_ONCE:
                    yield from looked_up()
        yield from looked_up()

    return both.repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(run, "number long, target long, windows long")


def _by_number(records: DataFrame, target: str, seq: str) -> tuple[DataFrame, DataFrame | None]:
    """((number, _seq), names (_name, number)) of records; whole numbers are their own."""
    if isinstance(records.schema[target].dataType, T.IntegralType):
        return records.select(F.col(target).alias("number"), F.col(seq).alias("_seq")), None
    names = cut(records.select(F.col(target).alias("_name")).where("_name is not null").distinct().withColumn("number", F.monotonically_increasing_id()))
    return records.select(F.col(target).alias("_name"), F.col(seq).alias("_seq")).join(names, "_name").select("number", "_seq"), names


def _by_name(found: DataFrame, names: DataFrame | None, records: DataFrame, target: str) -> DataFrame:
    """found with its column `number` as the target again."""
    if names is None:
        return found.withColumn("number", F.col("number").cast(records.schema[target].dataType)).withColumnRenamed("number", target)
    return found.join(names, "number").drop("number").withColumnRenamed("_name", target)


def unique_counts(records: DataFrame, target_table: DataFrame, target: str, seq: str, k: int) -> DataFrame:
    """target_table with unique_kmers, as index.unique_counts() has it with index.owners() of the records."""
    numbered, names = _by_number(records, target, seq)

    def run(batches) -> Iterator[pa.RecordBatch]:
        def counted(parts) -> pa.RecordBatch:
            targets, n = np.unique(_owned(parts, k)[1], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(targets), pa.array(n)], names=["number", "unique_kmers"])

        now, mine = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now and mine:
                    yield counted(mine)
                    mine = []
                now = bucket
                mine.append(tuple(batch.column(c)[i].as_py() for c in (2, 3, 4)))
        if mine:
            yield counted(mine)

    parts = spans(numbered, "number", "_seq", k, 0).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "number long, unique_kmers long")
    n = _by_name(parts.groupBy("number").agg(F.sum("unique_kmers").alias("unique_kmers")), names, records, target)
    return target_table.join(n, target, "left").withColumn("unique_kmers", F.coalesce("unique_kmers", F.lit(0)))


def count_records(reads: DataFrame, records: DataFrame, dataset: str, seq: str, weight: str, k: int, target: str = "target", record_seq: str = "seq", bases: Column | None = None) -> DataFrame:
    """(dataset, target, raw), as quantify.count_targets() has it with index.owners() of the same records.

    Distinct sequences of reads are written with their datasets' sums and numbered; spans carry the numbers, so neither the number
    of datasets nor that of equal reads multiplies k-mers.  A k-mer that is everywhere is a span of each distinct sequence in one
    bucket, whose task reads them in pieces.  Where `seq` is not the sequence but a key that decides it, `bases` makes it of the
    key, once for each.
    """
    sums = reads.groupBy(dataset, F.col(seq).alias("_seq")).agg(F.sum(F.col(weight).cast("long")).alias("_w"))
    kept = cut(sums.groupBy("_seq").agg(F.collect_list(F.struct(F.col(dataset).alias("d"), F.col("_w").alias("w"))).alias("_sums")).withColumn("number", F.monotonically_increasing_id()))
    distinct = kept.select("number", "_seq") if bases is None else kept.select("number", F.col("_seq").alias(seq)).select("number", bases.alias("_seq"))
    numbered, names = _by_number(records, target, record_seq)
    both = spans(numbered, "number", "_seq", k, 0).unionByName(spans(distinct, "number", "_seq", k, 1))
    hits = owned_windows(both, k).repartition("number").groupBy("number", "target").agg(F.sum("windows").alias("windows"))
    each = hits.join(kept.select("number", "_sums"), "number").select("target", "windows", F.explode("_sums").alias("s"))
    raw = each.groupBy(F.col("s.d").alias(dataset), F.col("target").alias("number")).agg(F.sum(F.col("s.w") * F.col("windows")).alias("raw"))
    return _by_name(raw, names, records, target).select(dataset, target, "raw")
