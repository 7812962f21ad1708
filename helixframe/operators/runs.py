"""A whole run: index, counting of dataset files, failures of files, and the result folder, in one call (inventory E12, F13, F14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..sources import results
from ..sources.fastx import read_sequences
from ..sources.files import listed
from ..storage import cut, forget
from . import index, quantify


def dataset_files(spark: SparkSession, datasets: dict[str, list[str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """((dataset, path), failures (dataset, error)): the files of each name's paths, and the names whose paths have none."""
    rows, failed = [], []
    for name, paths in datasets.items():
        try:
            rows += [(name, p) for p in listed(spark, paths)]
        except FileNotFoundError as wrong:
            failed.append((name, f"no such file: {wrong}"))
    return spark.createDataFrame(rows, "dataset string, path string"), failed


def read_datasets(spark: SparkSession, datasets: dict[str, list[str]], assembly_k: int, mode: str, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads (dataset, seq, weight), failures (dataset, error)) of whole and of broken datasets, from one pass over the files.

    Files are read once, with what is wrong as rows beside the records; both sides are read from that table.  A dataset fails if
    one of its files cannot be listed, opened, decompressed or parsed, holds no record, or has a header without a valid weight;
    nothing of it is counted then.
    """
    files, missing = dataset_files(spark, datasets)
    names = files.select("path").distinct()
    paths = [r.path for r in names.collect()]  # as many as files, which the driver has just listed
    kind = "dataset string, error string"
    if not paths:
        return spark.createDataFrame([], "dataset string, seq string, weight long"), spark.createDataFrame(missing, kind)
    raw = read_sequences(spark, paths, **({"split": split} if split else {}), errors=True)
    bad = F.coalesce(F.col("error"), fn.weight_error(F.col("header"), F.length("seq"), assembly_k, mode))
    checked = raw.select("path", "seq", bad.alias("error"), F.when(bad.isNull(), fn.header_weight(F.col("header"), F.length("seq"), assembly_k, mode)).alias("weight"))
    rows = cut(files.join(checked, "path"))
    broken = rows.where("error is not null").groupBy("dataset").agg(F.min(F.concat_ws(": ", "path", "error")).alias("error"))
    empty = files.select("dataset").distinct().join(rows.select("dataset").distinct(), "dataset", "left_anti").withColumn("error", F.lit("no sequences"))
    failures = cut(broken.unionByName(empty).unionByName(spark.createDataFrame(missing, kind)).groupBy("dataset").agg(F.min("error").alias("error")))
    reads = rows.where("error is null").join(failures.select("dataset"), "dataset", "left_anti").select("dataset", "seq", "weight")
    return reads, failures


def run(references: DataFrame, datasets: dict[str, list[str]], k: int, path: str, name: str = "name", seq: str = "seq", mode: str = "unitigs", level: str = "gene", stats: bool = False, keep_going: bool = False, split: int | None = None) -> dict:
    """Builds the index of `references`, counts the datasets' files and writes the result folder `path`; returns its manifest.

    What can be refused is refused before anything is read: k, the mode, dataset names, no datasets, statistics together with
    keep_going.  A dataset that fails ends the run, unless keep_going: then it is in the manifest with its error, and the others
    are whole.  All datasets failed raises.
    """
    from ..sources.lists import check_name

    spark = references.sparkSession
    index.check_k(k)
    if mode not in ("unitigs", "auto", "reads"):
        raise ValueError(f"unknown mode {mode}")
    if not datasets:
        raise ValueError("no datasets")
    if stats and keep_going:
        raise ValueError("statistics need all datasets")
    for x in datasets:
        check_name(x)
    reads, failures = read_datasets(spark, datasets, k, mode, split)
    failed = failures.orderBy("dataset").collect()  # names that the caller gave
    if failed and not keep_going:
        raise ValueError("; ".join(f"{r.dataset}: {r.error}" for r in failed[:10]))
    if len(failed) == len(datasets):
        raise ValueError("all datasets failed: " + "; ".join(f"{r.dataset}: {r.error}" for r in failed[:10]))
    built = index.build(references, k, name, seq)
    owners = cut(built.owners)
    order = [(i, x) for i, x in enumerate((x for x in datasets if x not in {r.dataset for r in failed}), 1)]
    known = spark.createDataFrame(order, "dataset int, name string")
    targets = cut(_numbered_targets(built.targets, references, name))
    rows = cut(reads.join(F.broadcast(known), reads["dataset"] == known["name"]).select(known["dataset"], "seq", "weight"))
    scale = fn.scale(mode)
    raw = quantify.count_targets(rows, owners, "dataset", "seq", "weight", k)
    ids = targets.select(F.col("name").alias("target"), "target_id")
    counts = quantify.finish(raw.join(ids, "target").select("dataset", "target_id", "raw"), scale)
    whole = cut(quantify.dense(counts, known.select("dataset"), targets.select("target_id"), "dataset", "target_id"))
    metrics = quantify.dataset_metrics(rows, "dataset", "seq", "weight", k)
    table = known.join(metrics, "dataset", "left").select("dataset", "name", F.lit("dataset").alias("kind"), F.coalesce("weighted_kmers", F.lit(0)).cast("decimal(38,0)").alias("numerator"), F.lit(scale).cast("long").alias("scale"))
    bad = spark.createDataFrame([(r.dataset, r.error) for r in failed], "name string, error string") if failed else None
    manifest = results.save_results(path, targets, table, whole, level, k, stats, bad)
    forget(owners, targets, rows, whole, failures)
    return manifest


def _numbered_targets(table: DataFrame, references: DataFrame, name: str) -> DataFrame:
    """Targets with target_id from 1, in the order of their names."""
    from .explore import ordered

    got = ordered(table.withColumnRenamed(name, "name"), "name", "name", False)
    return got.select(F.col("position").cast("long").alias("target_id"), "name", "length", "unique_kmers", "kmer_length")
