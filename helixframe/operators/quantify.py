"""Counting, rounding, filling, global sums and statistics, quantisation (inventory F)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import SCALE, round_ratio, runs, weight_error
from .index import kmer_sums


def collapse(reads: DataFrame, dataset: str, seq: str, weight: str) -> DataFrame:
    """Equal records of a dataset as one with summed weight and multiplicity: counting is linear, so windows are made once.
    Records that were summed before tell by `records` how many they are."""
    many = F.sum("records") if "records" in reads.columns else F.count("*")
    return reads.groupBy(dataset, seq).agg(F.sum(weight).alias(weight), many.alias("records"))


def count_targets(reads: DataFrame, owner_table: DataFrame, dataset: str, seq: str, weight: str, k: int, target: str = "target") -> DataFrame:
    """(dataset, target, raw): summed weights of all windows owned by one target.

    Equal records are summed before their windows are made, a block's equal k-mers, and a task's repeated ones, before they are
    shuffled.  One shuffle by k-mer serves both the sum over a dataset's equal k-mers and the join with owners; a k-mer that
    is everywhere reaches its task as a few rows of each task and dataset.
    """
    return assigned(reads, owner_table, dataset, seq, weight, k, target).groupBy(dataset, target).agg(F.sum("raw").alias("raw"))


def assigned(reads: DataFrame, owner_table: DataFrame, dataset: str, seq: str, weight: str, k: int, target: str = "target") -> DataFrame:
    """(dataset, target, raw, windows) of each owned k-mer of a dataset."""
    seen = kmer_sums(collapse(reads, dataset, seq, weight), dataset, seq, weight, k).repartition("ck")
    seen = seen.groupBy("ck", dataset).agg(F.sum(weight).alias("raw"), F.sum("windows").alias("windows"))
    return seen.join(owner_table.where("owner is not null"), "ck").select(dataset, F.col("owner").alias(target), "raw", "windows")


def dataset_metrics(reads: DataFrame, dataset: str, seq: str, weight: str, k: int, owner_table: DataFrame | None = None) -> DataFrame:
    """records (short ones too), valid_kmers and weighted_kmers of each dataset, without making windows; with owners, also
    assigned_kmers.  Reads with a column `records` are taken as summed already."""
    rows = reads if "records" in reads.columns else collapse(reads, dataset, seq, weight)
    n = F.aggregate(F.transform(runs(F.col(seq), k), lambda r: (F.length(r) - k + 1).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    got = rows.withColumn("_n", n).groupBy(dataset).agg(F.sum("records").alias("records"), F.sum(F.col("_n") * F.col("records")).alias("valid_kmers"), F.sum(F.col("_n") * F.col(weight)).alias("weighted_kmers"))
    if owner_table is None:
        return got
    hits = assigned(reads, owner_table, dataset, seq, weight, k).groupBy(F.col(dataset).alias("_d")).agg(F.sum("windows").alias("assigned_kmers"))
    return got.join(hits, F.col(dataset).eqNullSafe(F.col("_d")), "left").drop("_d").withColumn("assigned_kmers", F.coalesce("assigned_kmers", F.lit(0)))


def pooled_total(metrics: DataFrame, scales: Column) -> DataFrame:
    """(numerator, scale): the k-mer total of all datasets in micro-units; `scales` is a dataset's own scale, 1 or 1,000,000."""
    return metrics.agg(F.sum(F.col("weighted_kmers").cast("decimal(38,0)") * F.call_function("div", F.lit(SCALE), scales)).cast("decimal(38,0)").alias("numerator")).withColumn("scale", F.lit(SCALE))


def count_features(reads: DataFrame, features: DataFrame, dataset: str, seq: str, weight: str, k: int) -> DataFrame:
    """(dataset, feature, value): weights summed over membership classes (ck, feature); nothing is excluded, micro-units stay."""
    got = count_targets(reads, features.select("ck", F.col("feature").alias("owner")), dataset, seq, weight, k, "feature")
    return got.select(dataset, "feature", F.col("raw").cast("decimal(38,0)").alias("value"))


def feature_totals(counts: DataFrame) -> DataFrame:
    """(feature, value) over all datasets, as decimals of 38 digits; beyond that Spark raises."""
    return counts.groupBy("feature").agg(F.sum("value").cast("decimal(38,0)").alias("value"))


def keep_going(datasets: DataFrame, failures: DataFrame, dataset: str, stats: bool = False) -> tuple[DataFrame, dict]:
    """(datasets without those in failures(dataset, error), coverage); all failed, or statistics asked for, raises."""
    failed = failures.select(dataset).distinct()
    left = datasets.join(failed, dataset, "left_anti")
    asked, done = datasets.count(), left.count()
    if not done:
        raise ValueError("all datasets failed")
    if stats and done < asked:
        raise ValueError("statistics need all datasets")
    return left, {"requested_datasets": asked, "completed_datasets": done, "failed_datasets": asked - done, "complete": asked == done}


def failures(reads: DataFrame, dataset: str, header: str, length: Column, assembly_k: int, mode: str) -> DataFrame:
    """(dataset, error) of datasets with a header that has no valid weight, found by a pass that raises nothing."""
    return reads.select(dataset, weight_error(F.col(header), length, assembly_k, mode).alias("error")).where("error is not null").groupBy(dataset).agg(F.min("error").alias("error"))


def finish(raw: DataFrame, scale: int) -> DataFrame:
    """Micro-units to integers after summing, ties up."""
    return raw.withColumn("count", round_ratio(F.col("raw"), F.lit(scale).cast("long"))).drop("raw")


def dense(counts: DataFrame, datasets: DataFrame, target_table: DataFrame, dataset: str, target: str) -> DataFrame:
    """Every (dataset, target) with 0 where nothing was counted: the result is this matrix by definition.  A null dataset is one."""
    frame = datasets.select(dataset).crossJoin(target_table.select(target))
    seen = counts.select(F.col(dataset).alias("_d"), F.col(target).alias("_t"), "count")
    joined = frame.join(seen, F.col(dataset).eqNullSafe(F.col("_d")) & F.col(target).eqNullSafe(F.col("_t")), "left")
    return joined.select(dataset, target, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def global_sum(counts: DataFrame, target: str) -> DataFrame:
    return counts.groupBy(target).agg(F.sum("count").alias("count"))


def cross_dataset(counts: DataFrame, target: str) -> DataFrame:
    """mean (ties up), median (midpoint, ties up), min, max and how many datasets detect a target; zeros take part.
    The middle one or two values are found by rank, so no list of a target's values is collected."""
    order = Window.partitionBy(target).orderBy("count")
    ranked = counts.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(target)))
    lo, hi = F.call_function("div", F.col("_n") + 1, F.lit(2)), F.call_function("div", F.col("_n"), F.lit(2)) + 1
    return ranked.groupBy(target).agg(
        round_ratio(F.sum("count"), F.count("*")).alias("mean"),
        round_ratio(F.sum(F.when(F.col("_r") == lo, F.col("count")).otherwise(0)) + F.sum(F.when(F.col("_r") == hi, F.col("count")).otherwise(0)), F.lit(2).cast("long")).alias("median"),
        F.min("count").alias("min"), F.max("count").alias("max"), F.count_if(F.col("count") > 0).alias("datasets_detected"),
    )


def codebook(maxima: DataFrame, key: str, maximum: str, bits: int) -> DataFrame:
    """(key, code, level): exact to the maximum if it fits; else exact to P = min(15, C / 4), C the last code, then a geometric
    grid from P + 1 to the maximum, rounded, each level at least one above the one before and with room for those after."""
    last = (1 << bits) - 1
    prefix = min(15, last // 4)
    first = prefix + 1
    m, c = F.col(maximum), F.col("code")
    rows = maxima.select(key, maximum, F.explode(F.sequence(F.lit(0).cast("long"), F.least(m, F.lit(last).cast("long")))).alias("code"))
    log_first = F.log(F.lit(float(first)))
    grid = F.floor(F.exp(log_first + (c - first) * ((F.log(m.cast("double")) - log_first) / F.lit(float(last - first)))) + 0.5)
    raw = F.when(c == last, m).otherwise(grid)
    upto = Window.partitionBy(key, maximum).orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_r", F.when((m > last) & (c > prefix), raw - c))
    level = F.when((m <= last) | (c <= prefix), c).otherwise(c + F.least(m - last, F.greatest(F.lit(0), F.max("_r").over(upto))))
    return rows.select(key, "code", level.cast("long").alias("level"))


#: Buckets in a power of two, by which counts and levels meet.
FINE = 10


def _bucket(v: Column) -> Column:
    """Buckets in the order of whole numbers from 0 on: each number below 2^FINE, then 2^FINE for each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - FINE - 1, F.lit(0))
    return (shift.cast("long") * (1 << FINE) + F.call_function("shiftright", v, shift)).cast("long")


def quantise(counts: DataFrame, book: DataFrame, key: str, most: int = 4_000_000) -> DataFrame:
    """counts with the code and level nearest to each value, ties to the lower; null where the count is null or its key has no
    book.  A null key is a key.

    A key's levels are searched by halves in one Arrow map if the books were counted to have `most` levels at most, and are
    broadcast.  Else counts and the spans that belong to levels are joined by narrow buckets (1,024 to a power of two), so a
    count meets a few spans only; both ways give the same rows.
    """
    return _by_search(counts, book, key) if book.count() <= most else _by_spans(counts, book, key)


def _by_search(counts: DataFrame, book: DataFrame, key: str) -> DataFrame:
    from pyspark.sql import types as T

    at, where, plain = counts.columns.index("count"), counts.columns.index(key), list(counts.schema.fields)
    schema = T.StructType([*plain, T.StructField("code", T.LongType()), T.StructField("level", T.LongType())])
    books: dict = {}
    for r in book.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("code", "level"))).alias("x")).select(key, F.transform("x", lambda x: x["level"]).alias("levels")).collect():
        books[r[0]] = np.array(r[1], dtype=np.int64)
    shared = counts.sparkSession.sparkContext.broadcast(books)

    def nearest(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
        high = np.clip(np.searchsorted(levels, values), 0, len(levels) - 1)
        low = np.maximum(high - 1, 0)
        return np.where(values - levels[low] <= levels[high] - values, low, high)

    def run(batches):
        for batch in batches:
            names = batch.column(where).dictionary_encode(null_encoding="encode")
            which, column = names.indices.to_numpy(zero_copy_only=False), batch.column(at).cast(pa.int64())
            known, values = column.is_valid().to_numpy(zero_copy_only=False).copy(), column.fill_null(0).to_numpy(zero_copy_only=False)
            codes, levels = np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=np.int64)
            for i, name in enumerate(names.dictionary.to_pylist()):
                mine = which == i
                if name not in shared.value:
                    known &= ~mine
                    continue
                codes[mine] = nearest(values[mine], shared.value[name])
                levels[mine] = shared.value[name][codes[mine]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(plain))), pa.array(codes, mask=~known), pa.array(levels, mask=~known)], names=schema.names)

    return counts.mapInArrow(run, schema)


def _by_spans(counts: DataFrame, book: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy("_key").orderBy("code")
    spans = book.select(F.col(key).alias("_key"), "code", "level")
    # a level's numbers end at the midpoint with the next, which belongs to the lower; from 0 on, and at the top without end
    middle = F.col("level") + F.call_function("div", F.lead("level").over(w) - F.col("level"), F.lit(2))
    spans = spans.withColumn("_to", F.coalesce(middle, F.col("level")))
    spans = spans.withColumn("_from", F.coalesce(F.lag("_to").over(w) + 1, F.lit(0).cast("long")))
    spans = spans.where("_from <= _to").withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_from")), _bucket(F.col("_to")))))
    tops = book.groupBy(F.col(key).alias("_k")).agg(F.max("level").alias("_top"))
    # nothing is above the last level but by mistake of the caller; such counts have it as the nearest
    placed = counts.join(tops, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("_v", F.greatest(F.least("count", "_top"), F.lit(0).cast("long")))
    placed = placed.withColumn("_v", F.when(F.col("count").isNotNull() & F.col("_top").isNotNull(), F.col("_v"))).withColumn("_b", _bucket(F.col("_v")))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket")) & (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))
    return placed.join(spans, same, "left").select(*counts.columns, "code", "level")


def quantisation_error(encoded: DataFrame, key: str) -> DataFrame:
    gap = F.abs(F.col("count") - F.col("level"))
    rel = F.when(F.col("count") > 0, gap / F.col("count"))
    return encoded.groupBy(key).agg(F.max(gap).alias("max_abs"), F.avg(gap).alias("mean_abs"), F.coalesce(F.max(rel), F.lit(0.0)).alias("max_rel"), F.coalesce(F.avg(rel), F.lit(0.0)).alias("mean_rel"), F.count_if(gap == 0).alias("exact"), F.count_if(F.col("count") > 0).alias("nonzero"))


def normalise(counts: DataFrame, mode: str, count: str = "count", total: str = "total", length: str = "kmer_length"):
    """Column `value`: none, cpm, coverage or length-cpm; 0/0 is 0, a count over nothing raises."""
    v = F.col(count).cast("double")

    def over(x, by):
        d = F.col(by).cast("double")
        return F.when(F.col(by).isNull(), F.raise_error(F.lit(f"{by} is not known")).cast("double")).when(d > 0, F.try_divide(x, d)).when(x == 0, 0.0).otherwise(F.raise_error(F.lit(f"a count over a {by} of zero")).cast("double"))

    value = {"none": lambda: v, "cpm": lambda: over(v, total) * 1e6, "coverage": lambda: over(v, length), "length-cpm": lambda: over(over(v, length), total) * 1e6}[mode]()
    return counts.withColumn("value", value)
