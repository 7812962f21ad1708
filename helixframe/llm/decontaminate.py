"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

The build side are each item's windows (runs of `width` words; an item with fewer is one window), as sets of shingles
(runs of `shingle` words; a shorter window is one).  Shingles are ordered by rarity: by how many distinct windows hold
them, ties by the shingle.  All of a window's shingles must occur where it does, so the prefix filter needs one token of
it: its rarest shingle.  Documents meet windows only by prefix tokens; the positional and length bounds drop places where
a window can't fit around its token, and what is left is compared word by word.

Where the items' texts are counted to be at most `most_bytes`, their index is broadcast and documents are read once, with
no shuffle.  Beyond that the same join is made by shuffles: windows are never collected; documents send the places whose
token may be a prefix token (by a bitmap of fixed size, the only broadcast) with the words around them, these meet the
windows on the token, and hits go back to documents by a digest of the text.

Defined results: a null or wordless text has no words and no hit; items with a null id, null text or no words take no
part; items that repeat an id count once; hits of overlapping windows are counted once a word; repeated rows get equal
results; very long texts are read whole; without documents or without items there is nothing to find (an empty result, or
no hits); extra columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, SLOTS, alnum_words, annotate, bytes_of, cut, free_name, in_bitmap, key_bitmap, lower_ascii, pieces, small

FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


class WindowIndex:
    """Windows by their rarest shingle."""

    def __init__(self, items: list[tuple[str, bytes]], width: int, shingle: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, raw in items:
            words = alnum_words(raw)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + width]), set()).add(item)
        self.owners = {w: sorted(x) for w, x in owners.items()}
        spread: dict[tuple[bytes, ...], int] = {}
        parts = {w: [w[i : i + shingle] for i in range(max(1, len(w) - shingle + 1))] for w in owners}
        for mine in parts.values():
            for s in set(mine):
                spread[s] = spread.get(s, 0) + 1
        #: by prefix token: the (place of the token, length) pairs of windows that are found by it
        self.prefix: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for window, mine in parts.items():
            token = min(mine, key=lambda x: (spread[x], x))
            places = self.prefix.setdefault(token, [])
            if (place := (mine.index(token), len(window))) not in places:
                places.append(place)
        self.heads = frozenset(t[0] for t in self.prefix)
        self.lengths = sorted({len(t) for t in self.prefix})

    def find(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Disjoint spans as start, end, start, end ... and the items found."""
        hits: set[tuple[int, int]] = set()
        items: set[str] = set()
        heads, prefix, owners, n = self.heads, self.prefix, self.owners, len(words)
        for at, word in enumerate(words):
            if word in heads:
                for size in self.lengths:
                    for back, length in prefix.get(tuple(words[at : at + size]), ()):
                        start = at - back
                        if start >= 0 and start + length <= n and (window := tuple(words[start : start + length])) in owners:
                            hits.add((start, start + length))
                            items.update(owners[window])
        return merged(hits), items


def merged(spans) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """(item, size, window): the words of each window, joined by spaces."""
    words = items.select("item", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"({ALNUM})"), 1).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    rows = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))).alias("w"))
    return rows.select("item", F.size("w").alias("size"), F.array_join("w", " ").alias("window")).distinct()


#: Bytes of items' texts whose index each Python worker may hold: about 190 times as much memory.
MOST_BYTES = 1 << 20


def prefix_tokens(windows: DataFrame, shingle: int) -> DataFrame:
    """(token, back, size, window): each distinct window by its rarest shingle and the first place of it."""
    each = windows.select("window", "size").distinct()
    words, at = F.split("window", " "), F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("size") - shingle + 1))
    rows = each.select("window", "size", F.explode(F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(shingle)), " ").alias("token"), (i - 1).alias("back")))).alias("s")).select("window", "size", "s.*")
    spread = cut(rows.select("token", "window").distinct().groupBy("token").agg(F.count("*").alias("spread")))
    rows = rows.join(spread, "token")
    best = rows.groupBy("window", "size").agg(F.min(F.struct("spread", F.col("token").cast("binary").alias("t"), "back", "token")).alias("x"))
    return best.select("x.token", "x.back", "size", "window")


def _slot(token: bytes) -> int:
    return zlib.crc32(token) & (SLOTS - 1)


def hits_by_shuffle(docs: DataFrame, text: str, key: Column, items: DataFrame, width: int, shingle: int) -> DataFrame:
    """(key, spans, items) of the texts that hold a window."""
    windows = cut(windows_of(items, width))
    prefix = cut(prefix_tokens(windows, shingle))
    lengths = sorted(r[0] for r in prefix.select((F.size(F.split("token", " "))).alias("n")).distinct().collect())  # at most `shingle` numbers
    slot = F.crc32(F.col("token").cast("binary")).bitwiseAND(SLOTS - 1)
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(prefix.select(slot.alias("slot")), "slot"))
    rows = docs.select(F.col(text).alias("text"), key.alias("key")).where("key is not null")

    def places(batches):
        for whole in batches:
            for batch in pieces(whole, 0, 1 << 20):
                out = []
                for raw, name in zip(bytes_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    words = alnum_words(raw)
                    for size in lengths:
                        tokens = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
                        slots = np.fromiter(map(_slot, tokens), dtype=np.int64, count=len(tokens))
                        for i in np.flatnonzero(in_bitmap(bits.value, slots)).tolist():
                            low = max(0, i - width + 1)
                            out.append((name, tokens[i], i, i - low, b" ".join(words[low : i + width])))
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()).cast(pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()).cast(pa.string())], names=["key", "token", "at", "before", "around"])

    found = rows.mapInArrow(places, "key string, token string, at long, before int, around string").join(prefix, "token")
    around = F.split("around", " ")
    start = F.col("before") - F.col("back")
    fits = (start >= 0) & (start + F.col("size") <= F.size(around))
    same = F.when(fits, F.array_join(F.slice(around, start + 1, F.col("size")), " ") == F.col("window")).otherwise(False)
    hits = found.where(same).select("key", (F.col("at") - F.col("back")).alias("start"), (F.col("at") - F.col("back") + F.col("size")).alias("end"), "window").distinct()
    hits = hits.join(windows.select("window", "item"), "window")
    got = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"), F.array_sort(F.collect_set("item")).alias("items"))
    empty = F.array().cast("array<bigint>")

    def add(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & (s["start"] <= last)
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.greatest(last, s["end"])))).otherwise(F.concat(out, F.array(s["start"], s["end"])))

    return got.select("key", F.aggregate("s", empty, add).alias("spans"), "items")


def find_items(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, width: int = 10, shingle: int = 3, most_bytes: int = MOST_BYTES, out: str = "found") -> DataFrame:
    """docs with the struct column `out`: n_words, spans (starts and ends of hit runs, in words) and the sorted item ids."""
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= most_bytes:
        shared = docs.sparkSession.sparkContext.broadcast([(r.item, r.text.encode()) for r in wanted.toLocalIterator()])

        def make():
            index = WindowIndex(shared.value, width, shingle)

            def one(raw):
                words = alnum_words(raw)
                spans, ids = index.find(words)
                return len(words), spans, sorted(ids)

            return lambda texts: [one(raw) for raw in texts]

        column = free_name(docs, out)
        return annotate(docs, text, column, FOUND, make)
    digest = F.sha2(F.col(f"`{text}`").cast("binary"), 256)
    hits = cut(hits_by_shuffle(docs, text, digest, wanted, width, shingle))
    key, spans, ids = (free_name(docs, x) for x in ("_text_key", "_spans", "_items"))
    got = docs.join(small(hits.select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("items").alias(ids)), hits.count()), digest == F.col(key), "left")
    n = F.coalesce(F.regexp_count(lower_ascii(F.col(f"`{text}`")), F.lit(ALNUM)), F.lit(0)).cast("long")
    none = F.array()
    whole = F.struct(n.alias("n_words"), F.coalesce(F.col(spans), none.cast("array<bigint>")).alias("spans"), F.coalesce(F.col(ids), none.cast("array<string>")).alias("items"))
    return got.select(*(F.col(f"`{c}`") for c in docs.columns), whole.alias(free_name(docs, out)))


def hit_words(found):
    """Words inside the spans of a found column."""
    return F.aggregate(F.transform(found["spans"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def items_digest(found):
    return F.sha2(F.array_join(found["items"], ",").cast("binary"), 256)


def plain_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
