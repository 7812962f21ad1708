"""Reference index: targets, k-mer owners, membership classes, exposure (inventory E)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import runs

#: Bases to their two bits; 4 ends a run.
_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _base in enumerate("ACGT"):
    _CODE[[ord(_base), ord(_base.lower())]] = _i


def window_codes(raw: np.ndarray, k: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(start of each valid window, canonical code): two bits a base; for k above 31 two words, high and low."""
    code = _CODE[raw]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), (np.zeros(0, dtype=np.uint64),) * (1 if k <= 31 else 2)
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    at = np.flatnonzero(bad[k:] == bad[:n])
    return at, canonical(code, at, k)


def canonical(code: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The lesser of the k bases from each of some places, two bits each, and of their reverse complement."""
    two = code.astype(np.uint64) & np.uint64(3)

    def pack(values: np.ndarray, places) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for j in places:
            out = (out << np.uint64(2)) | values[at + j]
        return out

    back = np.uint64(3) - two
    if k <= 31:
        return (np.minimum(pack(two, range(k)), pack(back, range(k - 1, -1, -1))),)
    # the low word has the last 32 bases
    f, r = [(pack(v, o[: k - 32]), pack(v, o[k - 32 :])) for v, o in ((two, range(k)), (back, range(k - 1, -1, -1)))]
    first = (f[0] < r[0]) | ((f[0] == r[0]) & (f[1] <= r[1]))
    return tuple(np.where(first, a, b) for a, b in zip(f, r, strict=True))


def blocks(column: pa.Array, k: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, starts of records in them, with their row numbers) of sequences, about `most` bases at a time: short ones
    together, a mark between them; a longer one in pieces that overlap by k - 1 bases, so that each window is in one piece."""
    rows, some, size = [], [], 0
    for i, seq in enumerate(column.cast(pa.binary()).to_pylist()):
        if seq is None:
            continue
        for at in range(0, max(1, len(seq) - k + 1), most) if len(seq) > most else (0,):
            part = seq[at : at + most + k - 1] if len(seq) > most else seq
            rows.append(i)
            some.append(part)
            size += len(part)
            if size >= most:
                yield np.frombuffer(b" ".join(some), dtype=np.uint8), np.repeat(rows, [len(x) + 1 for x in some])[:-1]
                rows, some, size = [], [], 0
    if some:
        yield np.frombuffer(b" ".join(some), dtype=np.uint8), np.repeat(rows, [len(x) + 1 for x in some])[:-1]


def kmer_type(k: int) -> str:
    return "long" if k <= 31 else "binary"


def _column(words: tuple[np.ndarray, ...]) -> pa.Array:
    if len(words) == 1:
        return pa.array(words[0].view(np.int64))
    raw = np.column_stack(words).astype(">u8")
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def kmers(rows: DataFrame, keys: list[str], seq: str, k: int, block: int = 1 << 20) -> DataFrame:
    """keys and one row a window, as canonical k-mer `ck`, packed (BIGINT, above 31 bases 16 bytes; unpacked() gives the
    bases).  Windows never cross ambiguous bases; records of any length are read in blocks."""
    from pyspark.sql import types as T

    got = rows.select(*keys, F.col(seq).alias("_seq"))
    schema = T.StructType([*got.schema.fields[:-1], T.StructField("ck", T.LongType() if k <= 31 else T.BinaryType())])

    def run(batches):
        for batch in batches:
            for raw, owner in blocks(batch.column(batch.num_columns - 1), k, block):
                at, words = window_codes(raw, k)
                take = pa.array(owner[at])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(len(keys))), _column(words)], names=[*keys, "ck"])

    return got.mapInArrow(run, schema)


#: Rows of repeated k-mers that a task holds back to sum them over its blocks.
HELD = 1 << 20
#: Windows from which on a held k-mer is kept for the blocks that follow.
FREQUENT = 64


def _summed(which: np.ndarray, words: tuple[np.ndarray, ...], weights: np.ndarray, many: np.ndarray) -> tuple:
    """Rows of equal (dataset, k-mer) as one, in order."""
    order = np.lexsort((*words[::-1], which))
    which, words = which[order], tuple(w[order] for w in words)
    fresh = np.append(True, which[1:] != which[:-1]) if len(which) else np.zeros(0, dtype=bool)
    for w in words:
        fresh[1:] |= w[1:] != w[:-1]
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return which, words, weights, many
    return which[starts], tuple(w[starts] for w in words), np.add.reduceat(weights[order], starts), np.add.reduceat(many[order], starts)


def kmer_sums(rows: DataFrame, dataset: str, seq: str, weight: str, k: int, block: int = 1 << 20, held_rows: int = HELD) -> DataFrame:
    """(dataset, ck, weight, windows): the k-mers of weighted records, summed within each block before they are shuffled.

    K-mers that a block has more than once are held back and summed over the task's blocks, the frequent ones among them to the
    task's end, so a k-mer that is everywhere (poly-A) is a row or a few for each task and dataset, and not one for each
    block.  What is held has a bound, beyond which it is passed on.
    """
    from pyspark.sql import types as T

    got = rows.select(dataset, F.col(weight).cast("long").alias(weight), F.col(seq).alias("_seq"), *([F.col("records").cast("long")] if "records" in rows.columns else [F.lit(1).cast("long").alias("records")]))
    schema = T.StructType([got.schema[0], T.StructField("ck", T.LongType() if k <= 31 else T.BinaryType()), T.StructField(weight, T.LongType()), T.StructField("windows", T.LongType())])

    def run(batches):
        numbers: dict = {}  # of datasets, in this task
        names: list = []
        held: list[tuple] = []
        kind = None

        def batch_of(which, words, weights, many):
            return pa.RecordBatch.from_arrays([pa.array(names, kind).take(pa.array(which)), _column(words), pa.array(weights), pa.array(many)], names=schema.names)

        def pass_on(last: bool):
            which, words, weights, many = _summed(*(np.concatenate(x) if i != 1 else tuple(np.concatenate(w) for w in zip(*x, strict=True)) for i, x in enumerate(zip(*held, strict=True))))
            stay = (many >= FREQUENT) & (not last)
            if stay.sum() > held_rows // 2:
                stay[:] = False
            held.clear()
            if stay.any():
                held.append((which[stay], tuple(w[stay] for w in words), weights[stay], many[stay]))
            go = ~stay
            return batch_of(which[go], tuple(w[go] for w in words), weights[go], many[go])

        for batch in batches:
            sets = batch.column(0).dictionary_encode(null_encoding="encode")
            kind = batch.column(0).type
            for name in sets.dictionary.to_pylist():
                if name not in numbers:
                    numbers[name] = len(names)
                    names.append(name)
            own = np.array([numbers[x] for x in sets.dictionary.to_pylist()], dtype=np.int64)
            which, weights, many = own[sets.indices.to_numpy(zero_copy_only=False)], batch.column(1).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            for raw, owner in blocks(batch.column(2), k, block):
                at, words = window_codes(raw, k)
                if not len(at):
                    continue
                at = owner[at]
                found = _summed(which[at], words, weights[at], many[at])
                often = found[3] > 1
                if often.any():
                    held.append((found[0][often], tuple(w[often] for w in found[1]), found[2][often], found[3][often]))
                    once = ~often
                    found = found[0][once], tuple(w[once] for w in found[1]), found[2][once], found[3][once]
                if len(found[0]):
                    yield batch_of(*found)
                if sum(len(h[0]) for h in held) >= held_rows:
                    yield pass_on(False)
        if held:
            yield pass_on(True)

    return got.mapInArrow(run, schema)


def targets(records: DataFrame, k: int, name: str, seq: str, junction=None) -> DataFrame:
    """(name, length, kmer_length): summed over the records of a name; junction records count for neither."""
    real = F.lit(True) if junction is None else ~junction
    positions = F.aggregate(F.transform(runs(F.col(seq), k), lambda r: (F.length(r) - k + 1).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return records.groupBy(name).agg(F.sum(F.when(real, F.length(seq)).otherwise(0).cast("long")).alias("length"), F.sum(F.when(real, positions).otherwise(F.lit(0).cast("long"))).alias("kmer_length"))


def owners(kmer_rows: DataFrame, target: str) -> DataFrame:
    """(ck, owner): the only target that has the k-mer, null if several have it.  One aggregation, no distinct count."""
    both = kmer_rows.groupBy("ck").agg(F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    return both.select("ck", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("owner"))


def unique_counts(owner_table: DataFrame, target_table: DataFrame, target: str) -> DataFrame:
    n = owner_table.where("owner is not null").groupBy(F.col("owner").alias(target)).agg(F.count("*").alias("unique_kmers"))
    return target_table.join(n, target, "left").withColumn("unique_kmers", F.coalesce("unique_kmers", F.lit(0)))


@dataclass
class Index:
    k: int
    targets: DataFrame
    owners: DataFrame

    def describe(self) -> dict[str, int]:
        """What was built, as numbers; every k-mer has an owner or is shared."""
        n, shared = self.owners.agg(F.count("*"), F.count(F.when(F.col("owner").isNull(), 1))).first()
        return {"format": 1, "kmer_length": self.k, "targets": self.targets.count(), "indexed_kmers": n, "duplicate_kmers": shared}

    def save(self, path: str) -> None:
        """Tables and metadata.json, all or nothing: into a new folder beside `path`, which is then given its name."""
        from ..sources.results import publish

        with publish(self.targets.sparkSession, path) as stage:
            self.targets.write.parquet(f"{stage.path}/targets")
            self.owners.write.parquet(f"{stage.path}/owners")
            stage.text("metadata.json", json.dumps(self.describe()))


def check_k(k: int) -> int:
    if not 3 <= k <= 63 or k % 2 == 0:
        raise ValueError("k must be odd, from 3 to 63")
    return k


def build(records: DataFrame, k: int, name: str = "name", seq: str = "seq", junction=None) -> Index:
    check_k(k)
    own = owners(kmers(records, [name], seq, k), name)
    return Index(k, unique_counts(own, targets(records, k, name, seq, junction), name), own)


def load(spark, path: str, k: int | None = None, name: str = "name") -> Index:
    """A saved index; metadata of another format, another k than asked for, no targets, and owners that are no targets raise."""
    from ..sources.results import read_text

    meta = json.loads(read_text(spark, f"{path}/metadata.json"))
    if meta.get("format") != 1 or k not in (None, meta["kmer_length"]):
        raise ValueError(f"the index has format {meta.get('format')} and k {meta.get('kmer_length')}")
    found = Index(check_k(meta["kmer_length"]), spark.read.parquet(f"{path}/targets"), spark.read.parquet(f"{path}/owners"))
    if not meta["targets"] or found.targets.count() != meta["targets"]:
        raise ValueError("the index has no targets, or not those it was saved with")
    unknown = found.owners.where("owner is not null").select("owner").distinct().join(found.targets, F.col("owner") == F.col(name), "left_anti")
    if not unknown.isEmpty():
        raise ValueError("the index has owners that are no targets")
    return found


def memberships(kmer_rows: DataFrame, member: str) -> DataFrame:
    """(ck, signature): the sorted (member, multiplicity) pairs of each k-mer."""
    events = kmer_rows.groupBy("ck", member).agg(F.count("*").alias("multiplicity"))
    return events.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct(member, "multiplicity"))).alias("signature"))


def memberships_of_two(exon_kmers: DataFrame, transcript_kmers: DataFrame, member: str = "member") -> DataFrame:
    """(ck, exons, transcripts): both multisets of a k-mer; k-mers of transcripts that no exon has are dropped."""
    events = exon_kmers.select("ck", F.lit(True).alias("exon"), member).unionByName(transcript_kmers.select("ck", F.lit(False).alias("exon"), member))
    counted = events.groupBy("ck", "exon", member).agg(F.count("*").alias("multiplicity"))
    pick = lambda is_exon: F.array_sort(F.collect_list(F.when(F.col("exon") == is_exon, F.struct(member, "multiplicity"))))
    return counted.groupBy("ck").agg(pick(True).alias("exons"), pick(False).alias("transcripts")).where(F.size("exons") > 0)


def classes(member_rows: DataFrame, signature: list[str] | None = None) -> DataFrame:
    """(feature, signature, distinct_kmers): k-mers with equal membership; a feature is named by its least k-mer."""
    return member_rows.groupBy(*(signature or ["signature"])).agg(F.min("ck").alias("feature"), F.count("*").alias("distinct_kmers"))


def feature_of_kmers(member_rows: DataFrame, class_rows: DataFrame, signature: list[str]) -> DataFrame:
    """(ck, feature): the class of each k-mer, the owners by which features are counted."""
    return member_rows.join(class_rows.select("feature", *signature), signature).select("ck", "feature")


def exposure(class_rows: DataFrame, member: str, signature: str = "signature") -> DataFrame:
    rows = class_rows.select("feature", "distinct_kmers", F.explode(signature).alias("_s"))
    return rows.select("feature", F.col(f"_s.{member}").alias(member), (F.col("_s.multiplicity") * F.col("distinct_kmers")).alias("a"))


def check_model(class_rows: DataFrame, transcripts: DataFrame, name: str) -> None:
    """Raises if a model has no features or transcripts, transcripts that share a name or have none, or empty, unsorted or
    repeated members."""
    if class_rows.isEmpty() or transcripts.isEmpty():
        raise ValueError("the model has no features or no transcripts")
    if not transcripts.groupBy(name).count().where(F.col(name).isNull() | (F.col(name) == "") | (F.col("count") > 1)).isEmpty():
        raise ValueError("transcripts need names of their own")
    ids = lambda c: F.transform(c, lambda m: m["member"])
    wrong = lambda c: (F.array_sort(F.array_distinct(ids(c))) != ids(c)) | F.exists(c, lambda m: m["multiplicity"] < 1)
    if not class_rows.where((F.size("exons") == 0) | wrong("exons") | wrong("transcripts") | (F.col("distinct_kmers") < 1)).isEmpty():
        raise ValueError("a feature has empty, unsorted or repeated members")
