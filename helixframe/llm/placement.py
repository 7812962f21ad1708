"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (start and stride from a hash of its
name); shards take turns claiming the first free slot of their order until the table is full.  A shard of weight w
takes w turns a round.  The table's size is a parameter, so its broadcast is bounded; a row's slot is a hash of its key,
so placement is one lookup, with no shuffle, and adding a shard moves few rows.

Defined results: a null key is placed by the hash of the fallback column (all nulls: of the empty string); equal keys
share a shard; very long keys and texts are hashed whole; an empty table gives an empty result; extra columns pass through,
but for those that are named like an output column, in any case: the output takes their place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Prime, and over a hundred slots for each of up to 600 shards.
SLOTS = 65_537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> np.ndarray:
    """The shard's number in each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards need distinct names, at least one and at most one for each slot")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("each shard needs a weight of at least 1")
    start = [_number(x, "start") % slots for x in shards]
    stride = [_number(x, "stride") % (slots - 1) + 1 for x in shards]
    table, step, left = np.full(slots, -1, dtype=np.int32), [0] * len(shards), slots
    while left:
        for s, many in enumerate(turns):
            for _ in range(min(many, left)):
                while table[at := (start[s] + step[s] * stride[s]) % slots] >= 0:
                    step[s] += 1
                table[at] = s
                step[s] += 1
                left -= 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """From the first 60 bits of the MD5 of the key's text, which any engine can repeat."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(df: DataFrame, key: str, shards: list[str], fallback: str | None = None, slots: int = SLOTS, weights: list[int] | None = None, slot_out: str = "slot", out: str = "shard") -> DataFrame:
    """df with the slot of each row's key and the number of the shard that claimed it."""
    table = fill(shards, slots, weights)
    # all helper columns are free of clashes with df; a column of df named like an output is replaced by it
    look, number, at = (free_name(df, x) for x in ("_slot_key", "_slot_number", "_slot_at"))
    # an Arrow table becomes a local relation; a list of rows would start Python workers on every executor, which then stay
    lookup = df.sparkSession.createDataFrame(pa.table({look: np.arange(slots), number: table}))
    value = F.coalesce(F.col(f"`{key}`").cast("string"), *([F.col(f"`{fallback}`").cast("string")] if fallback else []), F.lit(""))
    # the lookup has `slots` rows, whatever the input
    got = df.withColumn(at, slot_of(value, slots)).join(F.broadcast(lookup), F.col(at) == F.col(look))
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_out.lower(), out.lower())]
    return got.select(*rest, F.col(at).alias(slot_out), F.col(number).alias(out))
