"""Vector code compression: product quantisation in whole numbers, with codebooks learned by an RDD tree of sums.

Vectors become whole numbers, floor(scale * x), and are cut into equal consecutive parts; each part position has a codebook.
Rows are first written as blocks: columns of numbers, one array for each component, so a block is read in NumPy without
a copy.  A round broadcasts the codebooks; each block finds its parts' nearest entries, with distances added up component
by component, and adds its numbers and counts into int64 tensors by np.add.at; treeAggregate merges the tensors of tasks
level by level, so the driver gets a few of them.  Broadcasts and tensors have parts x entries x width numbers, whatever
the number of rows.  Sums of whole numbers are the same in any order, so a lost task that runs again changes nothing.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped.  The dimension is that of
the kept vector with the least id whose length the parts divide; kept vectors that differ have no code and no error (null)
and no part in learning.  Codebooks start from the vectors with the least ids, null ids last, ties by the vector; with fewer
vectors than entries they have as many entries as there are vectors.  Equal distances go to the lower entry, an entry
without parts stays, and sums are divided downwards.  Components of any size are exact (beyond 2^24 after scaling in
Python's integers); an error beyond 64 bits is null.  Repeated rows count each; an empty table gives an empty result and empty
codebooks; other columns pass through, and `out` is a struct of the name asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, forget

#: Numbers in a block: 4 MB of 32-bit ones.
BLOCK = 1 << 20
#: Rows whose distances are held at a time.
STEP = 1024
#: Numbers below this are handled in 64 bits: squares of differences, summed over a part, fit.
SMALL = 1 << 24

CODE = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty and all of its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: int64, or Python integers if one of them is too large for that."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if np.abs(scaled).max(initial=0.0) < SMALL:
        return scaled.astype(np.int64)
    return np.array([floor(x * scale) if isfinite(x * scale) else int(x) * scale for x in values.tolist()], dtype=object)


def matrix(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, which): a row of whole numbers for each list of `width` components, and the places of these lists."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    which = np.flatnonzero((lengths == width) & (width > 0))
    values = column.take(pa.array(which)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return whole(values, scale).reshape(len(which), max(width, 1) if len(which) else 0), which


def distances(block: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, rows x entries, of a part: block is components x rows, entries is entries x components."""
    total = np.zeros((block.shape[1], len(entries)), dtype=np.result_type(block, entries))
    for d in range(block.shape[0]):
        gap = block[d][:, None] - entries[:, d][None, :]
        total += gap * gap
    return total


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance), both parts x rows, of a columnar block (components x rows); book: parts x entries x width."""
    parts, _, width = book.shape
    n = block.shape[1]
    entry, least = np.zeros((parts, n), dtype=np.int64), np.zeros((parts, n), dtype=np.result_type(block, book))
    for i in range(0, n, STEP):
        some = block[:, i : i + STEP]
        for p in range(parts):
            d = distances(some[p * width : (p + 1) * width], book[p])
            entry[p, i : i + STEP] = best = d.argmin(axis=1)  # the first of the least
            least[p, i : i + STEP] = d[np.arange(len(best)), best]
    return entry, least


def add_block(tensors: tuple[np.ndarray, np.ndarray] | None, block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """tensors (sums: parts x entries x width; counts: parts x entries) with a block added."""
    sums, counts = tensors if tensors else (np.zeros(book.shape, dtype=np.result_type(block, book)), np.zeros(book.shape[:2], dtype=np.int64))
    if block.dtype == object and sums.dtype != object:
        sums = sums.astype(object)
    entry, _ = nearest(block, book)
    width = book.shape[2]
    for p in range(book.shape[0]):
        np.add.at(counts[p], entry[p], 1)
        for d in range(width):
            np.add.at(sums[p, :, d], entry[p], block[p * width + d])
    return sums, counts


def merge(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a if b is None else b
    return a[0] + b[0], a[1] + b[1]


def moved(book: np.ndarray, tensors: tuple | None) -> np.ndarray:
    """The codebooks after a round: means, divided downwards; entries without parts stay."""
    if tensors is None:
        return book
    sums, counts = tensors
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], book)


def read_block(raw: bytes, rows: int, width: int) -> np.ndarray:
    """components x rows; 32-bit numbers, or decimal text where they are larger."""
    if raw[:1] == b"t":
        return np.array([int(x) for x in raw[1:].split(b",")], dtype=object).reshape(width, rows)
    return np.frombuffer(raw, dtype=np.int32, offset=4).reshape(width, rows).astype(np.int64)


def write_block(numbers: np.ndarray) -> bytes:
    if numbers.dtype == object:
        return b"t" + ",".join(map(str, numbers.ravel().tolist())).encode()
    return b"i32 " + np.ascontiguousarray(numbers, dtype=np.int32).tobytes()


def blocks(vectors: DataFrame, vector: str, width: int, scale: int) -> DataFrame:
    """(rows, block): columnar blocks of the vectors of `width` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, _ = matrix(batch.column(0), width, scale)
            step = max(1, BLOCK // width)
            some = [numbers[i : i + step] for i in range(0, len(numbers), step)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in some], pa.int64()), pa.array([write_block(x.T) for x in some], pa.binary())], names=["rows", "block"])

    return vectors.select(vector).mapInArrow(run, "rows long, block binary")


def first_book(kept: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> tuple[np.ndarray, int]:
    """(codebooks of the least ids, dimension); no more than `entries` vectors are brought to the driver."""
    ranked = kept.where(F.size(vector) % parts == 0).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    order = [F.col("k").asc_nulls_last(), F.col("v")]
    lead = ranked.orderBy(*order).limit(1).collect()
    if not lead:
        return np.zeros((parts, 0, 0), dtype=np.int64), 0
    width = len(lead[0].v)
    rows = ranked.where(F.size("v") == width).orderBy(*order).limit(entries).collect()
    numbers = whole(np.array([r.v for r in rows], dtype=float).ravel(), scale).reshape(len(rows), parts, width // parts)
    return numbers.transpose(1, 0, 2).copy(), width


def learn(kept: DataFrame, key: str, vector: str, parts: int, entries: int, rounds: int, scale: int, depth: int = 2) -> tuple[np.ndarray, int]:
    """(codebooks: parts x entries x width, dimension)."""
    book, width = first_book(kept, key, vector, parts, entries, scale)
    if not width:
        return book, width
    table = cut(blocks(kept, vector, width, scale))
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(book)
        found = table.rdd.treeAggregate(None, lambda t, r, s=shared: add_block(t, read_block(bytes(r.block), r.rows, width), s.value), merge, depth)
        book = moved(book, found)
        shared.unpersist()
    forget(table)
    return book, width


def encode(kept: DataFrame, vector: str, book: np.ndarray, width: int, scale: int, out: str = "coded") -> DataFrame:
    """kept with the struct column `out`: code, two hex digits a part, and error, the sum of squared distances."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at, kind = kept.columns.index(vector), to_arrow_schema(CODE)
    shared = kept.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            step = max(1, BLOCK // max(width, 1))
            for i in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(i, step)
                numbers, which = matrix(batch.column(at), width, scale)
                codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
                if len(which):
                    entry, least = nearest(numbers.T, shared.value)
                    for k, code, error in zip(which.tolist(), entry.T.astype(np.uint8), least.sum(axis=0).tolist(), strict=True):
                        codes[k], errors[k] = code.tobytes().hex(), error if error < 1 << 63 else None
                struct = pa.StructArray.from_arrays([pa.array(codes, kind.field(0).type), pa.array(errors, kind.field(1).type)], names=kind.names)
                yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, CODE)]))


def compress(df: DataFrame, key: str, vector: str, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, out: str = "coded") -> tuple[DataFrame, np.ndarray]:
    """(the usable rows of df with the struct column `out`, codebooks); at most 256 entries, as a code has a byte a part."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = df.where(usable(F.col(vector)))
    book, width = learn(kept, key, vector, parts, entries, rounds, scale)
    return encode(kept, vector, book, width, scale, out), book


def digest(book: np.ndarray) -> str:
    """SHA-256 of all numbers by part, entry and place, in decimal with commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
