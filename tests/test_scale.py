"""What queries move and hold as tables grow: bytes shuffled, rows made, times that a table is built."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import index, quantify, spans
from helixframe.plans import catalogue
from helixframe.sources import results
from helixframe.storage import cut, forget

SF = "/root/testdata/sf0.001"


def shuffled(spark, work) -> int:
    """Bytes written to shuffles meanwhile."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = so_far()
    work()
    return sum(b for key, b in so_far().items() if key not in before)


def drained(df):
    df.write.format("noop").mode("overwrite").save()


def bases(rng, n):
    return "".join(rng.choice(list("ACGT"), n))


@pytest.mark.parametrize("k", [3, 7, 15, 31, 33, 63])
def test_spans_count_as_kmers_do(spark, k):
    rng = np.random.default_rng(k)
    back = str.maketrans("ACGT", "TGCA")
    own = [bases(rng, n) for n in (k, 64, 200, 3000)] + ["A" * 500, "acgtn" * 60, "AC" * 300]
    records = [("x", own[0]), ("x", own[1]), ("y", own[2]), (None, own[2][:100]), ("z", own[3]), ("z", own[1][:40]), ("a", own[4]), ("n", own[5]), ("r", own[6]), ("", None), ("s", "ACG"[: k - 1])]
    reads = [(i % 3 if i % 4 else None, x, i + 1) for i, x in enumerate([*own, *(o[::-1].upper().translate(back) for o in own), *own, own[3][:1500] + "N" + own[2], "", None, "AAN"])]
    records = spark.createDataFrame(records, "target string, seq string").repartition(3)
    reads = spark.createDataFrame(reads, "dataset int, seq string, w long").repartition(4)
    want = quantify.count_targets(reads, index.owners(index.kmers(records, ["target"], "seq", k), "target"), "dataset", "seq", "w", k)
    got = spans.count_records(reads, records, "dataset", "seq", "w", k)
    rows = lambda df: sorted(map(repr, df.select("dataset", "target", "raw").collect()))
    assert rows(got) == rows(want) and (k < 15 or got.count() > 5)
    numbered = records.select(F.ascii("target").alias("target"), "seq")
    owners = index.owners(index.kmers(numbered, ["target"], "seq", k), "target")
    assert rows(spans.count_records(reads, numbered, "dataset", "seq", "w", k)) == rows(quantify.count_targets(reads, owners, "dataset", "seq", "w", k))


def test_reads_of_many_datasets_move_their_windows_once(spark):
    # 200 parts of 50 windows in ten datasets: 95,000 k-mers would be over 1 MB
    assert shuffled(spark, lambda: drained(catalogue.queries()["quantify_reads"](spark, SF))) < 400_000


@pytest.mark.parametrize("k", [7, 15, 33])
def test_unique_counts_by_spans(spark, k):
    rng = np.random.default_rng(k)
    own = [bases(rng, n) for n in (64, 200, 300)]
    records = spark.createDataFrame([("x", own[0]), ("y", own[1]), ("z", own[1][20:] + own[2]), (None, own[0]), ("none", "A"), ("r", "A" * 400)], "target string, seq string").repartition(2)
    lengths = index.targets(records, k, "target", "seq")
    want = index.unique_counts(index.owners(index.kmers(records, ["target"], "seq", k), "target"), lengths, "target")
    rows = lambda df: sorted(map(repr, df.select("target", "length", "unique_kmers").collect()))
    assert rows(spans.unique_counts(records, lengths, "target", "seq", k)) == rows(want)


def test_summed_reads_have_the_same_metrics(spark):
    reads = spark.createDataFrame([(1, "ACGTACGT", 2), (1, "ACGTACGT", 3), (1, "AC", 1), (None, "ACGTN", 4)], "d int, s string, w long")
    summed = reads.groupBy("d", "s").agg(F.sum("w").alias("w"), F.count("*").alias("records"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(quantify.dataset_metrics(summed, "d", "s", "w", 3)) == rows(quantify.dataset_metrics(reads, "d", "s", "w", 3))
    assert rows(quantify.collapse(summed, "d", "s", "w")) == rows(quantify.collapse(reads, "d", "s", "w"))


def test_a_result_is_written_from_tables_made_once(spark, tmp_path):
    made = {name: spark.sparkContext.accumulator(0) for name in ("targets", "datasets", "counts")}

    def seen(df, name):
        def run(batches):
            for batch in batches:
                made[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    targets = spark.createDataFrame([(i, f"t{i}", 9, 1, 3) for i in (1, 2, 3)], "target_id long, name string, length long, unique_kmers long, kmer_length long")
    datasets = spark.createDataFrame([(1, "a", "dataset", 5, 1), (2, "b", "dataset", 6, 1)], "dataset long, name string, kind string, numerator long, scale int")
    counts = spark.createDataFrame([(d, t, d * t) for d in (1, 2) for t in (1, 2, 3)], "dataset long, target_id long, count long")
    results.save_results(f"{tmp_path}/r", seen(targets, "targets"), seen(datasets, "datasets"), seen(counts, "counts"), "exon", 3, stats=True)
    assert {name: a.value for name, a in made.items()} == {"targets": 3, "datasets": 2, "counts": 6}
    saved = results.open_results(spark, f"{tmp_path}/r")
    assert sorted(r[1:] for r in saved.counts.where("kind = 'global'").select("kind", "target_id", "count").collect()) == [(1, 3), (2, 6), (3, 9)]


@pytest.mark.parametrize("name", ["export_global", "export_long", "export_normalized", "export_selection", "reference_subset"])
def test_exports_count_once(spark, name):
    # each round of counting of 200 parts by ten datasets would be over 1 MB
    assert shuffled(spark, lambda: drained(catalogue.queries()[name](spark, SF))) < 1_000_000


def test_folds_round_as_their_sql(spark, tmp_path, monkeypatch):
    # ratios whose logarithm, or its ninth decimal, Spark's own log2 and round give otherwise
    con = duckdb.connect()
    con.execute("create table mat as select d as dataset, row_number() over () // 10 as target, 0::BIGINT as count from range(0) r(d)")
    near = "abs(abs({0})*1e9 - floor(abs({0})*1e9) - 0.5) < 1e-6"
    con.execute(f"create table pairs as select row_number() over (order by c, s) as target, c, s from (select c, s, c::DOUBLE / s * 10 as f from range(1, 1500) a(c), range(1500, 12000) b(s)) where {near.format('log2(f)')} or {near.format('f')} and (c * 7 + s) % 50 = 0")
    con.execute("insert into mat select d, target, CASE d WHEN 0 THEN c WHEN 1 THEN s - c ELSE 0 END from pairs, range(10) r(d)")
    con.execute(f"copy mat to '{tmp_path}/mat.parquet'")
    monkeypatch.setattr(catalogue, "matrix", lambda s, _: s.read.parquet(f"{tmp_path}/mat.parquet"))
    want = con.execute("WITH m AS" + catalogue.oracle_sql()["fold_change"].split(", m AS", 1)[1]).fetchall()
    got = [tuple(r) for r in catalogue.queries()["fold_change"](spark, "").collect()]
    assert len(want) > 100 and sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["heatmap_pivot", "heatmap_page", "quantize_encode", "quantize_error", "vector_round_trip", "dense_fill", "sort_modes", "sort_statistic_nulls_last", "sort_total_desc", "exclude_zeros", "pct_approx"])
def test_the_matrix_is_built_once(spark, name):
    # a round of counting as it was would be over 1 MB, as it is about 180 kB
    assert shuffled(spark, lambda: drained(catalogue.queries()[name](spark, SF))) < 400_000


def test_what_a_cut_shuffled_is_deleted_at_the_next(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        found = blocks.getAllBlocks()
        return {x for x in (found.apply(i).name() for i in range(found.size())) if x.startswith("shuffle_")}

    def made():
        return cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).repartition(5))

    before = shuffles()
    one = made()
    first, two = shuffles() - before, made()
    end = time.time() + 15
    while shuffles() & first and time.time() < end:
        time.sleep(0.2)
    assert first and not shuffles() & first and one.count() == two.count() == 7
    forget(one, two)
