"""Cross-tokenizer alignment by an event sweep over the byte offsets where tokens end.

Each text is encoded by two tokenizers A and B.  Their tokens' end events, (document, offset, side, id), are one union; it is
dealt by document, sorted by offset within partitions, and streamed through a machine that closes a group where tokens of
both sides end, and emits the link of the two tokens that end there.  Events travel in runs: all events of a side whose
offsets lie in one window of 32,768 bytes are one row, packed, so the machine meets the two sides' runs of a window one
after the other and holds these, the tokens of the open group, counters and a running digest, whatever the document's length.

Links are counted by pair of ids over the corpus.  Tokens that end together are equal or one is a suffix of the other, so
the number of such pairs is bounded by the vocabularies (`most_pairs`: some hundred thousand for the two of the query), and the
table of counts is broadcast under that bound.

Encoding is exact for texts of any length: a text is cut only between a letter and a space before a letter, where no token
of either kind can cross (A's pattern ends words there, and a B with pieces that hold a space after another character is not
cut).  A is encoded by ranks where the file's merges are in the order of ids, which is faster, and else by its own library.

Defined results: a text that is null, empty or not UTF-8, or whose joined A or B bytes differ from a space and the text,
has no tokens: zeros, and an empty digest; rows that repeat an id, or have none, are documents of their own; an empty table
gives an empty result; columns other than the key are left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bytes_of, cut, pieces

#: Bytes of a text whose end events are one run; no token may be longer.
WINDOW = 1 << 15
#: Texts are encoded in spans of about so many characters.
SPAN = 1 << 18
#: Fixed value: how byte-level tokenizers cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a text may be cut; the space starts the second part.
_SEAM = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 for itself, then U+0100 on for the rest."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def spans(text: str, size: int = SPAN) -> list[str]:
    """The text in parts of at least `size` characters, each but the first starting with a space."""
    out, start = [], 0
    while len(text) - start > size and (seam := _SEAM.search(text, start + size)):
        out.append(text[start : seam.start()])
        start = seam.start()
    return [*out, text[start:]]


#: Runs of white space that are too long for the fast encoder's pattern, which goes back over them.
LONG_BLANK = 50_000
_LONG_BLANK = regex.compile(rf"\s{{{LONG_BLANK}}}")


class Vocabulary:
    """Ids of texts, and the bytes of ids."""

    parts: list[bytes]

    @cached_property
    def table(self) -> pa.Array:
        return pa.array(self.parts, pa.binary())

    @cached_property
    def lengths(self) -> np.ndarray:
        found = np.array([len(p) for p in self.parts], dtype=np.int64)
        if found.max(initial=0) > WINDOW:
            raise ValueError(f"a token has more than {WINDOW} bytes")
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def tokens(self, texts: list[str], raws: list[bytes]) -> list[np.ndarray | None]:
        """The ids of a space and each text; None where their bytes differ from that."""
        ids = [np.array(x, dtype=np.int64) for x in self.encode(texts)]
        joined = self.table.take(pa.array(np.concatenate([*ids, np.zeros(0, dtype=np.int64)])))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int32, count=len(joined) + 1)
        data, at, out = memoryview(joined.buffers()[2] or b"").cast("B"), 0, []
        for x, raw in zip(ids, raws, strict=True):
            mine = data[ends[at] : ends[at + len(x)]]
            out.append(x if len(mine) == len(raw) + 1 and mine[0] == 32 and mine[1:] == raw else None)
            at += len(x)
        return out


class ByteVocabulary(Vocabulary):
    """A byte-level BPE of a tokenizer file (JSON); special tokens' strings are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, letters, model = path, byte_letters(), file["model"]
        special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        names = {i: n for n, i in (model["vocab"] | special).items()}
        self.parts = [b""] * (max(names) + 1)
        for i, n in names.items():
            self.parts[i] = n.encode() if n in special else bytes(letters[c] for c in n)
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        before = file.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        singles = [i for n, i in model["vocab"].items() if len(n) == 1 and n not in special]
        ordered = all(a < b for a, b in zip([max(singles, default=-1), *merged], merged, strict=False)) and len(singles) == 256
        self.by_rank = bool(plain and ordered and len(merged) + 256 + len(special) >= len(names))
        self.ranks = {self.parts[i]: i for n, i in model["vocab"].items() if n not in special} if self.by_rank else {}

    @cached_property
    def fast(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def one(self, text: str) -> list[int]:
        if self.by_rank and (len(text) < 2 * LONG_BLANK or not _LONG_BLANK.search(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            first, *more = spans(" " + t)
            ids = self.one(first)
            for part in more:
                ids += self.one(part)
            out.append(ids)
        return out


class PieceVocabulary(Vocabulary):
    """A sentence-piece model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.parts = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.cuttable = not any("▁" in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts, owner = [], []
        for i, t in enumerate(texts):
            first, *more = spans(t) if self.cuttable else [t]
            mine = [first, *(x[1:] for x in more)]
            parts += mine
            owner += [i] * len(mine)
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in zip(owner, self.model.encode(parts, num_threads=1), strict=True):
            out[i] = out[i] + ids if out[i] else ids
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """One of each file in a Python process."""
    return ByteVocabulary(path) if path.endswith(".json") else PieceVocabulary(path)


def most_pairs(a: Vocabulary, b: Vocabulary) -> int:
    """How many pairs of ids can end together: those where one's bytes are a suffix of the other's."""
    ids: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
    for known, v in zip(ids, (a, b), strict=True):
        for p in v.parts:
            known[p] = known.get(p, 0) + 1
    longer = sum(ids[1].get(p[i:], 0) for p in a.parts for i in range(len(p)))
    return longer + sum(ids[0].get(p[i:], 0) for p in b.parts for i in range(1, len(p)))


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in arrays))


def unpack(raw: bytes, *types: type) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = len(data) // sum(np.dtype(t).itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(data, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out


def runs(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(offset, events): of each window that ends lie in, its start, and the ends (as gaps) and ids, packed."""
    ends = np.cumsum(lengths[ids])
    window = (ends - 1) // WINDOW
    starts = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
        offset = int(window[i]) * WINDOW
        yield offset, pack(np.diff(ends[i:j], prepend=offset).astype(np.uint16), ids[i:j].astype(np.uint32 if lengths.size > 1 << 16 else np.uint16))


def end_events(docs: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """(row, key, offset, side, events): the union of A's runs (side 1) and B's (side 2), and one row (side 0, offset -1) for
    each document; `row` is a number of its own for each row of docs."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", docs.schema[key].dataType), T.StructField("offset", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("events", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabulary(a), vocabulary(b)
        for whole in batches:
            for batch in pieces(whole, 2, 1 << 20):
                raws, texts = bytes_of(batch.column(2)), []
                for raw in raws:
                    texts.append((raw or b"").decode("utf-8", "replace"))
                some = [i for i, t in enumerate(texts) if t]
                found = [v.tokens([texts[i] for i in some], [raws[i] for i in some]) for v in both]
                at, offset, side, events = list(range(len(raws))), [-1] * len(raws), [0] * len(raws), [None] * len(raws)
                for i, *ids in zip(some, *found, strict=True):
                    if all(x is not None for x in ids):
                        for s, (x, v) in enumerate(zip(ids, both, strict=True), 1):
                            for o, e in runs(x, v.lengths):
                                at.append(i)
                                offset.append(o)
                                side.append(s)
                                events.append(e)
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(offset, pa.int64()), pa.array(side, pa.int32()), pa.array(events, pa.binary())], names=schema.names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return numbered.mapInArrow(run, schema)


class Sweep:
    """The machine: one document at a time, one window at a time."""

    def __init__(self, ids: tuple[int, int], kinds: tuple[type, type]):
        n = max(ids)
        self.sizes, self.kinds = ids, kinds
        # each id after a comma, after a semicolon (a group's first of A, the first group's too) and after a bar (its first of B)
        self.words = pa.array([mark + str(i) for mark in ",;|" for i in range(n)], pa.binary())
        self.comma, self.semicolon, self.bar = 0, n, 2 * n

    def start(self) -> None:
        self.open = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        self.digest, self.begun = hashlib.sha256(), False

    def window(self, events: tuple[bytes | None, bytes | None]) -> tuple[int, int, int, bytes | None]:
        """(tokens of A, of B, groups, links) of a window: links are the distinct pairs, as gaps, and how often each occurs."""
        (a_ends, a), (b_ends, b) = ((np.cumsum(x[0].astype(np.int64)), x[1].astype(np.int64)) for x in (unpack(e, np.uint16, k) if e else (np.zeros(0, np.uint16), np.zeros(0, k)) for e, k in zip(events, self.kinds, strict=True)))
        n = len(a), len(b)
        at = np.searchsorted(b_ends, a_ends)
        both = np.flatnonzero(np.append(b_ends, -1)[at] == a_ends)
        there = at[both]
        a, b = np.concatenate([self.open[0], a]), np.concatenate([self.open[1], b])
        both, there = both + len(a) - n[0], there + len(b) - n[1]
        if not len(both):
            self.open = a, b
            return *n, 0, None
        last_a, last_b = int(both[-1]) + 1, int(there[-1]) + 1
        in_a, in_b = np.diff(both, prepend=-1), np.diff(there, prepend=-1)
        marks = np.zeros(last_a + last_b, dtype=np.int64)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        place_a, place_b = np.arange(last_a) + np.repeat(upto_b - in_b, in_a), np.arange(last_b) + np.repeat(upto_a, in_b)
        marks[place_a], marks[place_b] = a[:last_a] + self.comma, b[:last_b] + self.comma
        marks[place_a[upto_a - in_a]] += self.semicolon
        marks[place_b[upto_b - in_b]] += self.bar
        said = self.words.take(pa.array(marks))
        size = int(np.frombuffer(said.buffers()[1], dtype=np.int32, count=len(said) + 1)[-1])
        self.digest.update(memoryview(said.buffers()[2])[0 if self.begun else 1 : size])
        self.begun, self.open = True, (a[last_a:], b[last_b:])
        pair, often = np.unique(a[both] * self.sizes[1] + b[there], return_counts=True)
        return *n, len(both), pack(np.diff(pair, prepend=0).astype(np.uint64 if self.sizes[0] * self.sizes[1] >> 32 else np.uint32), often.astype(np.uint16))


def sweep(events: DataFrame, a: str, b: str) -> DataFrame:
    """(row, key, n_a, n_b, n_groups, links, digest): one row for each window, the digest at a document's last."""
    schema = T.StructType([events.schema["row"], events.schema["key"], *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")), T.StructField("links", T.BinaryType()), T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema).types
        both = vocabulary(a), vocabulary(b)
        machine = Sweep(tuple(len(v.parts) for v in both), tuple(np.uint32 if len(v.parts) > 1 << 16 else np.uint16 for v in both))
        row, key, held, done = None, None, None, []  # held: (offset, A's run, B's run) of the window at hand

        def close(last: bool) -> None:
            if held is not None:
                got = machine.window((held[1], held[2]))
                done.append((row, key, *got, machine.digest.hexdigest() if last else None))
            elif last and row is not None:
                done.append((row, key, 0, 0, 0, None, ""))

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(types)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            for r, k, offset, side, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if r != row:
                    close(True)
                    row, key, held = r, k, None
                    machine.start()
                if side:
                    if held is not None and held[0] != offset:
                        close(False)
                        held = None
                    held = held or [offset, None, None]
                    held[side] = raw
            yield emit()
        close(True)
        yield emit()

    ordered = events.repartition("row").sortWithinPartitions("row", "offset", "side")
    return ordered.mapInArrow(run, schema)


def _pairs(raw: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    gaps, often = unpack(raw, np.uint64 if wide else np.uint32, np.uint16)
    return np.cumsum(gaps.astype(np.int64)), often.astype(np.int64)


def pair_counts(swept: DataFrame, wide: bool) -> DataFrame:
    """(pair, n): how many links of the corpus have each pair; a task sends each of its pairs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            found = [_pairs(raw, wide) for raw in batch.column(0).to_pylist() if raw]
            every = np.concatenate([pair, *(p for p, _ in found)])
            weights = np.concatenate([n, *(w for _, w in found)])
            pair, where = np.unique(every, return_inverse=True)
            n = np.zeros(len(pair), dtype=np.int64)
            np.add.at(n, where, weights)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    return swept.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs; a and b are paths of a
    byte-level tokenizer file (.json) and of a sentence-piece model, which every machine has."""
    sizes = len(vocabulary(a).parts), len(vocabulary(b).parts)
    wide = bool(sizes[0] * sizes[1] >> 32)
    swept = cut(sweep(end_events(docs, key, text, a, b), a, b))
    bound = most_pairs(vocabulary(a), vocabulary(b))
    table = pair_counts(swept, wide).limit(bound + 1).toPandas()
    if len(table) > bound:
        raise AssertionError("pairs of tokens that cannot end together")
    order = np.argsort(table["pair"].to_numpy(dtype=np.int64))
    pair, n = table["pair"].to_numpy(dtype=np.int64)[order], table["n"].to_numpy(dtype=np.int64)[order]
    highest = np.zeros(sizes[1], dtype=np.int64)
    np.maximum.at(highest, pair % sizes[1], n)
    shared = docs.sparkSession.sparkContext.broadcast((pair, n, n == highest[pair % sizes[1]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            sums = []
            for raw in batch.column(5).to_pylist():
                p, often = _pairs(raw, wide) if raw else (np.zeros(0, np.int64),) * 2
                at = np.searchsorted(known, p)
                sums.append((int(often.sum()), int(often[best[at]].sum()), int((often * count[at]).sum())))
            added = [pa.array(list(x), pa.int64()) for x in zip(*sums, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(6), *added], names=names)

    kept = [f for f in swept.schema.fields if f.name != "links"]
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum"))])
    names = schema.names
    counted = swept.mapInArrow(run, schema)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    got = counted.groupBy("row").agg(F.first("key").alias("key"), *sums, F.max("digest").alias("groups_sha256"))
    return got.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

