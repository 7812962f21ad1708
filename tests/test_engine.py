import gzip

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as fn
from helixframe.operators import explore, intervals, isoforms, quantify
from helixframe.plans import catalogue, explorer, exports
from helixframe.sources import fastx, gtf

SF = "/root/testdata/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """The matrix is built once for all queries on it."""
    path, made = f"{tmp_path_factory.mktemp('m')}/matrix", catalogue.matrix
    made(spark, SF).write.parquet(path)
    modules = (catalogue, explorer, exports)
    for m in modules:
        m.matrix = lambda s, _: s.read.parquet(path)
    yield
    for m in modules:
        m.matrix = made


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, built, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*(f"`{c}`" for c in columns)).collect()))) == sorted(map(repr, want.fetchall()))


def test_scalars(spark):
    row = spark.range(1).select(
        fn.micro_units(F.lit("0.0000005")).alias("half"), fn.micro_units(F.lit("1e3")).alias("bad"), fn.round_ratio(F.lit(35).cast("long"), 10).alias("r"),
        fn.header_weight(F.lit("u KC:i:14"), F.lit(34), 31).alias("kc"), fn.reverse_complement(F.lit("acgr")).alias("rc"),
        fn.percent_escape(F.lit("a~é")).alias("esc"), fn.decimal_text(F.lit(3_500_000)).alias("dec"), fn.runs(F.lit("acgtNNac"), 3).alias("runs"),
    ).first()
    assert (row.half, row.bad, row.r, row.kc, row.rc, row.esc, row.dec, row.runs) == (1, None, 4, 3_500_000, "YCGT", "a%7E%C3%A9", "3.5", ["ACGT"])


def test_merge_is_transitive_and_keeps_adjacent(spark):
    rows = spark.createDataFrame([(1, 1, 10), (1, 5, 20), (1, 20, 22), (1, 23, 30)], "g int, start int, end int")
    assert sorted(map(tuple, intervals.merge(rows, ["g"]).collect())) == [(1, 1, 22), (1, 23, 30)]


def test_percentiles_and_fold(spark):
    rows = spark.createDataFrame([(1, x) for x in (0, 10, 20, 30)], "k int, count long")
    got = explore.summarise(rows, ["k"], percentiles=(25, 50)).first()
    assert (got.p25, got.p50, got["median"]) == (7.5, 15.0, 15.0)
    assert explore.nearest_rank(rows, ["k"], 25).first().q == 0
    fold = explore.fold(spark.createDataFrame([(1, 0.0), (1, 10.0), (2, 0.0)], "t int, value double"), "t").orderBy("t", "value").collect()
    assert [(r.fold, r.log2_fold) for r in fold] == [(0.0, float("-inf")), (2.0, 1.0), (None, None)]


def test_codebook_is_increasing(spark):
    for m in (300, 9_999, 104_949):
        levels = [r.level for r in quantify.codebook(spark.createDataFrame([(1, m)], "k int, m long"), "k", "m", 8).orderBy("code").collect()]
        assert len(levels) == 256 and levels[:16] == list(range(16)) and levels[-1] == m and all(a < b for a, b in zip(levels, levels[1:], strict=False))


def test_em_and_rank():
    a = np.array([[100.0, 100.0], [150.0, 0.0], [0.0, 100.0]])
    theta, assigned, _, done = isoforms.em(a, np.array([1000.0, 900.0, 400.0]), 10_000, 1e-10)
    assert done and np.allclose(theta, [6, 4], atol=1e-6) and np.isclose(assigned.sum(), 2300)
    assert isoforms.rank(np.array([[1.0, 0, 1, 0], [0, 1, 0, 1], [1, 0, 0, 1], [0, 1, 1, 0]])) == 3


def test_readers(spark, tmp_path):
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b">x one\r\nAC\r\nGT\r\n") + gzip.compress(b">y\nTT\n"))
    rows = fastx.read_sequences(spark, [str(tmp_path / "a.fa.gz")]).orderBy("record").collect()
    assert [(r.header, r.seq) for r in rows] == [("x one", "ACGT"), ("y", "TT")]
    with pytest.raises(ValueError):
        list(fastx.parse([b"@r\n", b"ACGT\n", b"+\n", b"II\n"], "r.fq"))
    (tmp_path / "a.gtf").write_text('#x\nc1\ts\texon\t1\t5\t.\t+\t.\tgene_id "a;\\"b"; exon_id e1; exon_id "e0";\nc1\ts\tgene\t1\t5\t.\t+\t.\tgene_id "g"\n')
    got = gtf.read_exons(spark, str(tmp_path / "a.gtf")).collect()
    assert [(r.contig, r.start, r.end, r.exon_ids, r.gene_ids) for r in got] == [("c1", 1, 5, ["e0", "e1"], ['a;"b'])]


def test_components_all_reaches_every_edge(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(o, int(p), n, int(s)) for o in range(60) for n, (p, s) in enumerate(zip(rng.integers(0, 40, 1 + o % 2) + 40 * (o % 5), rng.integers(1, 1000, 2), strict=False), 1)]
    rows += [(100, 1000 + n, n, 500 + n) for n in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    label = {p: p for _, p, *_ in rows}
    while True:
        old = dict(label)
        for o in {r[0] for r in rows}:
            parts = [r[1] for r in rows if r[0] == o]
            label |= dict.fromkeys(parts, min(label[p] for p in parts))
        if old == label:
            break
    got = {r.transcript: r.component for r in catalogue.queries()["components"](spark, str(tmp_path)).collect()}
    assert got == label and len(set(label.values())) > 5 and got[1007] == 1001


def test_features_of_all_bases(spark):
    # every window of 64 - 7 + 1 is in one class
    got = catalogue.queries()["observable_kmers"](spark, SF).agg(F.sum("observable_kmers")).first()[0]
    assert got == 58 * spark.read.parquet(f"{SF}/part.parquet").count()


def test_em_takes_all_rows_and_converges(spark, tmp_path):
    # 1 and 2 share an order whose counts only 1 explains but for one: more than 200 iterations
    rows = [(1, 1, 1, 300.0), (2, 1, 1, 301.0), (2, 2, 2, 1.0), (3, 30, 1, 4.0), (3, 31, 5, 6.0), (4, 31, 7, 5.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.transcript: r for r in catalogue.queries()["em_fit"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 30, 31] and {r.status for r in got.values()} == {"identifiable"} and got[30].component == got[31].component == 30
    a = np.array([[1.0, 0.0], [1.0, 1.0]])
    assert isoforms.em(a, np.array([300.0, 302.0]), 10_000, 1e-8)[2] > 200
    assert [got[k].abundance for k in (1, 2, 30, 31)] == pytest.approx([300, 2, 5, 5], rel=1e-3)


def test_em_of_a_wide_component(spark):
    """As a matrix this component is 20,001 x 20,000."""
    n = 20_000
    ids = spark.range(n).select(F.concat(F.lit("f"), "id").alias("feature"), F.col("id").alias("transcript"), F.lit(1).cast("long").alias("a"))
    x = ids.unionByName(ids.withColumn("feature", F.lit("all")))
    y = ids.select(F.lit(0).alias("dataset"), "feature", (1 + F.col("transcript") % 3).cast("double").alias("y"))
    y = y.unionByName(spark.createDataFrame([(0, "all", 2.0 * n)], "dataset int, feature string, y double"))
    members, fits = isoforms.fit_groups(x, y)
    got = isoforms.with_status(fits, members).groupBy("status").agg(F.count("*"), F.sum("assigned"), F.countDistinct("component")).collect()
    assert [(r[0], r[1], r[3]) for r in got] == [("rank_unchecked", n, 1)] and got[0][2] == pytest.approx(sum(1 + i % 3 for i in range(n)) + 2 * n)
    # what single transcripts are given is not known without the rank
    assert isoforms.fit(x, y).where("assigned is not null or abundance is not null").isEmpty()


def test_junctions_make_pairs_at_every_size(spark, tmp_path):
    n = 3000
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    per = [sum(1 for i in range(1, n + 1) if i // 50 == g) for g in range(n // 50 + 1)]
    assert catalogue.queries()["junction_block_pairs"](spark, str(tmp_path)).count() == sum(x * (x - 1) for x in per)
    assert [tuple(r) for r in catalogue.queries()["junction_gene_report"](spark, str(tmp_path)).collect()] == [("b", n, True)]
