"""What the training-data operators share: lineage cuts, pass-through Arrow maps, guarded broadcasts, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut, forget  # noqa: F401

#: A-Z, and what they become; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
#: Words are runs of digits, a-z and whatever is not ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 500_000


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased words by the ALNUM rule."""
    return raw.translate(_ALNUM_TABLE).split() if raw else []


def spaced_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words by the SPACED rule."""
    return raw.lower().split() if raw else []


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that clashes with none of df's, in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes each, so memory follows single texts and not batches."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(1, int(sizes.sum()) // most + 2) * most, side="left") + 1
    start = 0
    for end in [*np.unique(np.clip(cuts, 1, batch.num_rows)).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = max(start, end)


def annotate(
    df: DataFrame, text: str, out: str, kind: T.StructType, make: Callable[[], Callable[[list], list[tuple]]], others: tuple[str, ...] = ()
) -> DataFrame:
    """df with the struct column `out`, made of the column `text` (and `others`) by Arrow batches; where df has a column of that
    name, in any case, the new one gets the next free name (free_name), and df's passes through.

    `make` runs once a task and returns a function from a list of bytes (or None) to a list of tuples; with
    `others`, it also gets a list for each of them.  All columns of df pass through untouched.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = free_name(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    at, rest = df.columns.index(text), [df.columns.index(c) for c in others]
    names = [f.name for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        types = to_arrow_schema(kind)
        for whole in batches:
            for batch in pieces(whole, at):
                col = batch.column(at)
                got = f(bytes_of(col) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.to_pylist(), *(batch.column(i).to_pylist() for i in rest))
                arrays = [pa.array(list(x), type=types.field(k).type) for k, x in enumerate(zip(*got, strict=True))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, names=names)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its counted rows are within the bound; else Spark shuffles it."""
    return F.broadcast(df) if rows <= most else df


#: Slots of a key filter: its bitmap has 8 MB, whatever the number of keys.
SLOTS = 1 << 26


def key_bitmap(slots: DataFrame, slot: str) -> np.ndarray:
    """The bits of a column of numbers from 0 to SLOTS - 1, as bytes of a fixed total size; keys that share a slot are told apart later."""
    x = F.col(slot) + 1
    parts = slots.where(F.col(slot).isNotNull()).groupBy(F.bitmap_bucket_number(x).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    out = np.zeros(SLOTS >> 3, dtype=np.uint8)
    for r in parts:  # at most SLOTS / 32,768 rows of 4 kB
        raw = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        out[(r.part - 1) * 4096 : (r.part - 1) * 4096 + len(raw)] = raw
    return out


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def bounded_sample(df: DataFrame, by: list[Column], bound: int, seed: int = 7, slots: int = 1 << 16) -> DataFrame:
    """All rows if there are no more than `bound`, else exactly `bound`: those with the least hashes of the values `by`.

    Hashes are counted in `slots` ranges; whole ranges are taken up to the one that crosses the bound, and of that one the
    least.  So the same rows are taken on every run, but for rows that are equal in all of `by`.
    """
    if df.limit(bound + 1).count() <= bound:
        return df
    h = F.xxhash64(F.lit(seed), *by)
    slot = F.pmod(F.shiftright(h, 8), F.lit(slots))
    left = bound
    for r in sorted(df.groupBy(slot.alias("slot")).count().collect()):  # at most `slots` rows
        if r["count"] > left:
            edge = df.where(slot == r.slot).orderBy(h).limit(left)
            return df.where(slot < r.slot).unionByName(edge) if left else df.where(slot < r.slot)
        left -= r["count"]
    return df


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def key_text(c: Column) -> Column:
    return c.cast("string")
