"""Known values, odd inputs and errors of the engine's functions, readers and sinks."""

import gzip
import lzma
import math

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from helixframe.functions import sequence as fn
from helixframe.operators import explore, index, intervals, isoforms, quantify, runs
from helixframe.plans import inference
from helixframe.sources import fastx, files, gtf, lists, results, vectors

#: The largest count, and a header of 32 bytes.
TOP = 18_446_744_073_709_551_615
REF = bytes(range(32))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def fails(df, what):
    with pytest.raises(Exception, match=what):
        df.collect()


def test_header_weights(spark):
    w = lambda text, n, mode="unitigs", k=31: fn.header_weight(F.lit(text), F.lit(n), k, mode)
    got = one(spark, w("u KC:i:14", 34), w("u KC:i:" + "0" * 100 + "5", 34), w("x ka:f:1.5 km:f:1.50 KC:i:3", 10), w("x", 40, "auto"), w("x KC:i:9", 5, "reads"), w("ka:i:2", 40), w("x km:f:0.0000005", 9))
    assert tuple(got) == (3_500_000, 1_250_000, 1_500_000, 1_000_000, 1, 2_000_000, 1)
    assert fn.scale("reads") == 1 and fn.scale("auto") == 1_000_000
    for text, n, mode in (("x KC:i:3", 10, "auto"), ("x KC:i:5.7", 40, "auto"), ("x", 40, "unitigs"), ("x ka:f:1 km:f:2", 40, "auto"), ("x KC:i:1 KC:i:1", 40, "auto"), ("x ka:f:-1", 40, "auto"), ("x ka:f:1e3", 40, "auto"), (f"x KC:i:{TOP + 1}", 40, "auto")):
        fails(spark.range(1).select(w(text, n, mode)), "in header")
        assert one(spark, fn.weight_error(F.lit(text), F.lit(n), 31, mode))[0]


def test_numbers_as_text(spark):
    big = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    got = one(spark, *(fn.short_number(big(v)) for v in (999, 999_499, 999_500, 1_234_567, 1_234_567_890, 1_234_567_890_000, 0)), *(fn.scientific(big(v)) for v in (TOP, 1, 0, 999_500)))
    assert tuple(got) == ("999", "999K", "1.00M", "1.23M", "1.23G", "1.23T", "0", "1.84e+19", "1.00e+0", "0.00e+0", "1.00e+6")
    got = one(spark, fn.percentage(F.lit(0.8392)), fn.percentage(F.lit(0.00001)), fn.percentage(F.lit(None).cast("double")), fn.csv_cell(F.lit('a"b')), fn.six_decimals(F.lit(2), F.lit(3)), fn.six_decimals(big(TOP), F.lit(2)), fn.decimal_text(F.lit(3_500_000)))
    assert (got[0], got[1], got[2], got[3], str(got[4]), str(got[5]), got[6]) == ("83.92%", "1.00e-03%", "–", '"a""b"', "0.666667", "9223372036854775807.500000", "3.5")
    assert fn.percentiles("90, 10;"[:-1] + " 10.0 2.5") == ["2.5", "10", "90"]
    for bad in ("", "101", "-1", "1.1234567", " ".join(str(i) for i in range(33))):
        with pytest.raises(ValueError):
            fn.percentiles(bad)


def test_names_sort_by_their_numbers(spark):
    names = ["g10", "G9", "g09", "g" + "9" * 30, "g1" + "0" * 30, "a"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(fn.natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "G9", "g09", "g10", "g" + "9" * 30, "g1" + "0" * 30]
    rows = [(i, n) for i, n in enumerate(["zebra", "école", "Ecole", "ecole2", "é10", "e9", "b10", "B2", "b02"])]
    table = spark.createDataFrame(rows, "i int, n string")
    order = [r.n for r in table.orderBy(fn.natural_key(F.col("n")), "i").collect()]
    assert order == ["B2", "b02", "b10", "e9", "é10", "école", "Ecole", "ecole2", "zebra"]
    assert [r.n for r in explore.sorted_by(table.withColumnRenamed("n", "name"), "name-asc", "i").orderBy("position").select(F.col("name").alias("n")).collect()] == order


@pytest.mark.parametrize("k", [3, 7, 31, 33, 63])
def test_windows_of_blocks_against_plain_code(spark, k):
    rng = np.random.default_rng(k)
    seqs = ["".join(rng.choice(list("ACGTacgtN"), p=[0.115] * 8 + [0.08], size=n)) if n else "" for n in (0, 2, k, 200, 900)] + ["A" * 300, None, "é" * 70]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, s string")
    swap = str.maketrans("ACGT", "TGCA")

    def plain(s):
        s = "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in s or "")
        w = [s[i : i + k] for i in range(len(s) - k + 1)]
        return sorted(min(x, x.translate(swap)[::-1]) for x in w if set(x) <= set("ACGT"))

    for block in (1 << 20, 97):
        got = index.kmers(df, ["i"], "s", k, block).select("i", fn.unpacked(F.col("ck"), k).alias("w")).collect()
        for i, s in enumerate(seqs):
            assert sorted(r.w for r in got if r.i == i) == plain(s)
    sums = index.kmer_sums(df.withColumn("w", F.col("i") + 1).withColumn("d", F.col("i") % 2), "d", "s", "w", k, 97)
    total = sum((i + 1) * len(plain(s)) for i, s in enumerate(seqs))
    assert sums.agg(F.sum("w")).first()[0] == total and sums.agg(F.sum("windows")).first()[0] == sum(len(plain(s)) for s in seqs)


def test_ownership_and_totals_of_weighted_records(spark):
    """Weights are summed before they are rounded: 56.5 is 57; totals are of all valid windows."""
    seq = "ACGTTGCAAGCTTAGGCATCCGATTACGGATCCAATGCGT"
    owners = index.owners(index.kmers(spark.createDataFrame([("g", seq)], "target string, seq string"), ["target"], "seq", 7), "target")
    rows = [("w", seq, 1_250_000), ("w", "A" * 20, 125_000), ("w", seq[:20] + "N" + seq[20:], 500_000)]
    reads = spark.createDataFrame(rows, "dataset string, seq string, w long")
    metrics = quantify.dataset_metrics(reads, "dataset", "seq", "w", 7, owners).first()
    assert (metrics.records, metrics.valid_kmers, metrics.weighted_kmers, metrics.assigned_kmers) == (3, 76, 58_250_000, 62)
    got = quantify.finish(quantify.count_targets(reads, owners, "dataset", "seq", "w", 7), fn.SCALE).first()
    assert got["count"] == 57
    assert quantify.pooled_total(spark.createDataFrame([(58_250_000, 1_000_000), (34, 1)], "weighted_kmers long, scale long"), F.col("scale")).first().numerator == 92_250_000
    both = spark.createDataFrame([("a", "AAAAAAA"), ("b", "TTTTTTT")], "target string, seq string")
    assert index.owners(index.kmers(both, ["target"], "seq", 7), "target").first().owner is None


def test_keep_going(spark):
    sets = spark.createDataFrame([(1,), (2,)], "dataset int")
    bad = spark.createDataFrame([(2, "broken")], "dataset int, error string")
    left, told = quantify.keep_going(sets, bad, "dataset")
    assert [r[0] for r in left.collect()] == [1] and told == {"requested_datasets": 2, "completed_datasets": 1, "failed_datasets": 1, "complete": False}
    with pytest.raises(ValueError):
        quantify.keep_going(sets, bad, "dataset", stats=True)
    with pytest.raises(ValueError):
        quantify.keep_going(sets, sets.withColumn("error", F.lit("x")), "dataset")


def test_levels_are_nearest_with_either_way_of_searching(spark):
    rng = np.random.default_rng(1)
    counts = spark.createDataFrame([(d, int(v)) for d in (0, 1) for v in [0, 1, 7 * 10**12 * d + 300, *rng.integers(0, 300 + d * 10**9, 300)]], "dataset int, count long")
    book = quantify.codebook(counts.groupBy("dataset").agg(F.max("count").alias("m")), "dataset", "m", 4)
    rows = {(r.dataset, r.code): r.level for r in book.collect()}
    for most in (10**6, 0):
        got = quantify.quantise(counts, book, "dataset", most).collect()
        assert len(got) == counts.count()
        for r in got:
            mine = sorted((abs(r["count"] - level), level, code) for (d, code), level in rows.items() if d == r.dataset)
            assert (r.level, r.code) == mine[0][1:]


def test_exact_statistics(spark):
    rows = spark.createDataFrame([(1, x) for x in (0, 10, 20, 30)], "k int, count long")
    got = explore.summarise(rows, ["k"], percentiles=(25, 50)).first()
    assert [float(got[c]) for c in ("median", "p25", "p50", "mean")] == [15, 7.5, 15, 15]
    near = explore.summarise(rows, ["k"], percentiles=(0, 25, 50, 100), interpolation="nearest-rank").first()
    assert [near[c] for c in ("p0", "p25", "p50", "p100")] == [0, 0, 10, 30] and float(near["median"]) == 15
    top = spark.createDataFrame([(str(TOP - 2),), (str(TOP),), (None,)], "v string").select(F.col("v").cast("decimal(20,0)").alias("count"))
    got = explore.summarise(top, [], threshold=F.lit(str(TOP - 1)).cast("decimal(20,0)"), percentiles=(25,)).first()
    assert (str(got.total), str(got["mean"]), str(got["median"]), str(got.p25)) == ("36893488147419103228", f"{TOP - 1}.000000", f"{TOP - 1}.000000", "18446744073709551613.500000")
    assert (got.above, got.known, got.missing, got.stddev, got.above_percent) == (1, 2, 1, 1.0, 50.0)
    empty = explore.summarise(rows.where("false"), ["k"])
    assert empty.count() == 0
    nulls = explore.summarise(spark.createDataFrame([(None, None), (None, 0)], "k int, count long"), ["k"], exclude_zeros=True).first()
    assert (nulls.k, nulls.known, nulls.missing, nulls.n, nulls["median"], nulls["mean"]) == (None, 1, 1, 0, None, None)
    many = spark.range(100_000).select(F.col("id").alias("count"))
    got = explore.summarise(many, [], percentiles=(37.5,)).first()
    assert (float(got["median"]), float(got.p37_5), got.total) == (49_999.5, 37_499.625, 4_999_950_000)
    doubles = explore.summarise(rows.withColumn("count", F.col("count") / 4), ["k"], percentiles=(25,)).first()
    assert (doubles["median"], doubles.p25) == (3.75, 1.875)


def test_explorer_orders_lists_and_checks(spark):
    t = spark.createDataFrame([(1, "b10"), (2, "B9"), (3, "b10"), (4, "a")], "id long, name string")
    assert [r.id for r in explore.sorted_by(t, "name-desc", "id").orderBy("position").collect()] == [1, 3, 2, 4]
    assert [r.id for r in explore.paste_select(t, "b10\n// x\n#4\n\n", "id", "name").orderBy("id").collect()] == [1, 3, 4]
    with pytest.raises(ValueError):
        explore.paste_select(t, "nobody", "id", "name")
    assert explore.lookup(t, "b10", "id", "name").first().id == 1 and explore.lookup(t, "#2", "id", "name").first().id == 2
    with pytest.raises(ValueError):
        explore.lookup(t, "#9", "id", "name")
    assert explore.page_of(101) == 1 and explore.overview_is_cheap(10_000, 32) and not explore.overview_is_cheap(10_001, 1)
    for bad in ({"mode": "x"}, {"scope": 0}, {"threshold": float("nan")}, {"low": 2, "high": 1}, {"mode": "cpm", "totals_known": False}, {"mode": "coverage", "lengths_known": False}, {"mode": "cpm", "kinds": ("statistic",)}):
        with pytest.raises(ValueError):
            explore.check_request(**bad)
    kinds = spark.createDataFrame([("t", "dataset", 10.0), ("t", "dataset", 0.0), ("t", "global", 10.0), ("u", "dataset", None), ("u", "dataset", 0.0)], "target string, kind string, value double")
    got = {(r.target, r.kind, r.value): (r.fold, r.log2_fold) for r in explore.fold(kinds, "target", "value", "kind").collect()}
    assert got == {("t", "dataset", 10.0): (2.0, 1.0), ("t", "dataset", 0.0): (0.0, float("-inf")), ("t", "global", 10.0): (None, None), ("u", "dataset", None): (None, None), ("u", "dataset", 0.0): (None, None)}


def test_requests_are_computed_once_and_cancelled(spark):
    import threading
    import time

    kept = explore.Requests(spark, 2)
    base = spark.range(100)
    ask = lambda n: base.where(F.col("id") % 7 == n).groupBy("id").count()
    one = kept.get(ask(1))
    assert kept.get(ask(1)) is one and kept.get(ask(2)) is not one and one.count() == 15 and len(kept.kept) == 2
    kept.get(ask(3))
    assert len(kept.kept) == 2 and kept.get(ask(1)) is not one
    slow = spark.range(4).repartition(4).select(F.expr("java_method('java.lang.Thread', 'sleep', id * 0 + 20000)").alias("x"))
    ended = []

    def run():
        try:
            kept.get(slow)
        except Exception as e:
            ended.append(e)

    thread = threading.Thread(target=run)
    began = time.time()
    thread.start()
    while thread.is_alive() and time.time() - began < 18:
        time.sleep(0.5)
        kept.cancel(slow)
    thread.join(25)
    assert ended and time.time() - began < 18 and kept.tag(slow) not in kept.kept


def test_annotation_lines(spark, tmp_path):
    row = lambda attributes, start=1, end=5, strand="+": f"c1\ts\texon\t{start}\t{end}\t.\t{strand}\t.\t{attributes}\n"
    text = "#x\n\n" + row('note "a; gene_id b"; gene_id "g1"; gene_id "g\\"2"; exon_id e1') + row(".") + "c1\ts\tgene\t1\tx\t.\t?\t.\tbroken\n"
    for name, raw in (("a.gtf", text.encode()), ("b.gz", gzip.compress(text.encode())), ("c.xz", lzma.compress(text.encode())), ("d.zst", zstandard.compress(text.encode()))):
        (tmp_path / name).write_bytes(raw)
        got = gtf.read_exons(spark, str(tmp_path / name)).collect()
        assert [(r.gene_ids, r.exon_ids, r.transcript_ids) for r in got] == [(['g"2', "g1"], ["e1"], []), ([], [], [])]
    for bad in (row('gene_id "a'), row("gene_id a b"), row("gene_id"), row('gene_id ""'), row('gene_id "a" exon_id b'), row(".", 0), row(".", 5, 4), row(".", 1, 5, "."), "c1\tx\n"):
        (tmp_path / "bad.gtf").write_text("#x\n" + bad)
        fails(gtf.read_exons(spark, str(tmp_path / "bad.gtf")), "bad attributes|line 2")


def test_sequences_of_joined_members_and_blocks(spark, tmp_path):
    a, b = b">x one\r\nAC\r\nGT \r\n", b">y\nTT\n" + b"acgtn" * 50_000 + b"\n"
    for name, raw in (("a", a + b), ("b", gzip.compress(a) + gzip.compress(b)), ("c", lzma.compress(a) + lzma.compress(b)), ("d", zstandard.compress(a) + zstandard.compress(b))):
        (tmp_path / name).write_bytes(raw)
        got = fastx.read_sequences(spark, [str(tmp_path / name)]).orderBy("record").collect()
        assert [(r.header, len(r.seq), r.seq[:4]) for r in got] == [("x one", 4, "ACGT"), ("y", 250_002, "TTac")]
    (tmp_path / "cut").write_bytes(gzip.compress(a * 1000)[:-9])
    fails(fastx.read_sequences(spark, [str(tmp_path / "cut")]), "end-of-stream|EOF|ended|incomplete")
    (tmp_path / "q").write_bytes(b"@r 1\nACGT\n+\nIIII\n@s\nA\n+\nI\n")
    assert [r.seq for r in fastx.read_sequences(spark, [str(tmp_path / "q")]).collect()] == ["ACGT", "A"]
    (tmp_path / "empty").write_bytes(b"")
    assert fastx.read_sequences(spark, [str(tmp_path / "empty")]).count() == 0
    (tmp_path / "two").write_bytes(b">c x\nA\n>c y\nC\n")
    for bad in ("two", "q", "empty"):
        with pytest.raises(Exception, match="repeat|FASTA|no sequences"):
            fastx.read_genome(spark, [str(tmp_path / bad)]).collect()
    got = fastx.read_genome(spark, [str(tmp_path / "a")]).orderBy("place", "block").collect()
    assert [(r.contig, r.place, r.block, len(r.bases)) for r in got] == [("x", 0, 0, 4), *(("y", 1, i, min(65_536, 250_002 - 65_536 * i)) for i in range(4))]
    assert [(r.line, r.text) for r in files.read_lines(spark, [str(tmp_path / "two")]).collect()][1] == (2, "A")


def test_exons_of_a_genome(spark):
    genome = spark.createDataFrame([("c2", "acgtRYn", 0), ("c1", "AAACCCGGGTTT", 1)], "contig string, bases string, place long")
    rows = spark.createDataFrame([("c1", 1, 3, "+", ["e1"], ["g"]), ("c1", 1, 3, "-", [], ["g"]), ("c1", 1, 3, "+", ["e 0"], ["h"]), ("c2", 4, 7, "-", [], ["g"])], "contig string, start long, end long, strand string, exon_ids array<string>, gene_ids array<string>")
    got = intervals.extract(intervals.numbered_exons(rows, genome), genome).orderBy("exon_id")
    assert [(r.exon_name, r.seq) for r in got.collect()] == [("exon_000001|c2:4-7:- gene_ids=g", "NRYA"), ("exon_000002|c1:1-3:+ exon_ids=e%200,e1 gene_ids=g,h", "AAA"), ("exon_000003|c1:1-3:- gene_ids=g", "TTT")]
    assert intervals.fasta(got, "exon_name").first().value == ">exon_000001|c2:4-7:- gene_ids=g\nNRYA"
    far = rows.withColumn("end", F.lit(99).cast("long"))
    fails(intervals.extract(far, genome), "beyond")
    lost = rows.withColumn("contig", F.lit("c9"))
    fails(intervals.extract(lost, genome), "not in the genome")
    assert intervals.missing_contigs(lost, genome) == ["c9"]
    fails(intervals.gene_union(rows.withColumn("gene", F.lit(None).cast("string"))), "no gene")
    fails(intervals.paths(spark.createDataFrame([("t", 1, 5, "+"), ("t", 5, 9, "+")], "t string, start long, end long, strand string"), ["t"], strict=True).select("path"), "overlapping")
    merged = spark.createDataFrame([(g, 10 * i, 10 * i + 12, "+") for g in (None, 1) for i in range(9000)], "g int, start long, end long, strand string")
    assert sorted(map(tuple, intervals.merge(merged, ["g"], width=50).collect()), key=repr) == [(1, 0, 90_002), (None, 0, 90_002)]
    for bad in ({"level": "x", "annotation": True}, {"level": "exon", "annotation": True, "junctions": "all"}, {"level": "gene", "annotation": False, "junctions": "all"}, {"level": "gene", "annotation": True, "isoforms": True}):
        with pytest.raises(ValueError):
            intervals.check_options(**bad)
    with pytest.raises(ValueError, match="exon without"):
        intervals.check_annotation(rows.withColumn("transcript_ids", F.array().cast("array<string>")))


def test_a_saved_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ACGTTGCAAGCT", False), ("b", "TTTTTTTTT", False), ("a", "GGGGGGGG", True)], "name string, seq string, junction boolean")
    found = index.build(rows, 7, junction=F.col("junction"))
    assert {r.name: (r.length, r.kmer_length, r.unique_kmers) for r in found.targets.collect()} == {"a": (12, 6, 7), "b": (9, 3, 1)}
    path = f"{tmp_path}/index"
    found.save(path)
    again = index.load(spark, path, 7)
    assert again.describe() == found.describe() == {"format": 1, "kmer_length": 7, "targets": 2, "indexed_kmers": 8, "duplicate_kmers": 0}
    with pytest.raises(FileExistsError):
        found.save(path)
    with pytest.raises(ValueError):
        index.load(spark, path, 9)
    for k in (2, 4, 65):
        with pytest.raises(ValueError):
            index.build(rows, k)


def test_inference_toys(spark):
    x, y, genes = inference._states(spark)
    members, fits = isoforms.fit_groups(x, y, genes)
    got = {r.transcript: r for r in isoforms.transcript_report(members, isoforms.global_fit(fits), genes).collect()}
    assert got["T1"].abundance == pytest.approx(12) and got["T1"].within_gene_fraction == pytest.approx(0.6) and got["T2"].model_estimate is None and got["T2"].group == got["T3"].group == "T2"
    assert got["Z1"].status == "unobservable" and got["Z1"].abundance is None and got["R1"].abundance == 0 and got["R1"].relative_abundance_ppm is None
    unchecked = isoforms.fit_groups(x, y, genes, rank_limit=1)[1]
    assert {r.status for r in isoforms.with_status(unchecked, members).where("component = 'Q1'").collect()} == {"rank_unchecked"}
    short = isoforms.fit_groups(*inference._toy(spark)[:2], max_iterations=1)
    assert {r.status for r in isoforms.with_status(short[1], short[0]).collect()} == {"non_converged"}
    # a rate that decays to zero converges by the sum of changes
    decay = isoforms.fit(spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 2, 1)], "feature string, transcript long, a long"), spark.createDataFrame([(0, "a", 10.0)], "dataset int, feature string, y double"))
    assert {r.transcript: r.status for r in decay.collect()} == {1: "identifiable", 2: "identifiable"}
    lone = isoforms.fit(spark.createDataFrame([("a", 1, 2), ("b", 7, 2), ("b", 8, 2)], "feature string, transcript long, a long"), spark.createDataFrame([(0, "a", 10.0)], "dataset int, feature string, y double"))
    assert {r.transcript: (r.abundance, r.status) for r in lone.collect()} == {1: (5.0, "identifiable"), 7: (None, "zero_evidence"), 8: (None, "zero_evidence")}
    for rows in ([(0, "a", -1.0)], [(0, "a", float("nan"))], [(0, "a", 1.0), (0, "a", 2.0)], [(0, "zz", 1.0)]):
        with pytest.raises(ValueError):
            isoforms.check_observed(spark.createDataFrame(rows, "dataset int, feature string, y double"), x)
    for bad in ({"stats": True}, {"viewer": True}, {"max_iterations": 0}, {"tolerance": 0.0}):
        with pytest.raises(ValueError):
            isoforms.check_options(**bad)


def test_models_are_checked(spark):
    schema = "feature string, exons array<struct<member:string,multiplicity:long>>, transcripts array<struct<member:string,multiplicity:long>>, distinct_kmers long"
    names = spark.createDataFrame([("t",), ("u",)], "name string")
    index.check_model(spark.createDataFrame([("a", [("e", 1), ("f", 2)], [], 3)], schema), names, "name")
    for exons in ([], [("f", 1), ("e", 1)], [("e", 1), ("e", 1)], [("e", 0)]):
        with pytest.raises(ValueError):
            index.check_model(spark.createDataFrame([("a", exons, [], 3)], schema), names, "name")
    with pytest.raises(ValueError):
        index.check_model(spark.createDataFrame([("a", [("e", 1)], [], 3)], schema), names.unionByName(names), "name")


def test_packed_vectors():
    assert vectors.pack_bits(np.arange(8), 3).hex() == "88c6fa"
    rng = np.random.default_rng(0)
    for bits in range(2, 17):
        k = min(1 << bits, 50)
        levels = np.array([*range(k - 1), TOP], dtype=np.uint64)
        codes = rng.integers(0, k, 77)
        raw = vectors.encode_codes(codes, levels, bits, REF, b"PACKED01")
        got, book = vectors.decode_codes(raw, 77, REF, b"PACKED01")
        assert (got == codes).all() and (book == levels).all() and int(book[-1]) == TOP
    for at in (0, 8, 12, 20, 24, 32, 40, 72, len(raw) - 1):
        broken = bytearray(raw)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            vectors.decode_codes(bytes(broken), 77, REF, b"PACKED01")
    for wrong in (raw[:-1], raw + b"\0", raw[:50]):
        with pytest.raises(ValueError):
            vectors.decode_codes(wrong, 77, REF, b"PACKED01")
    values = [0.0, None, 1.5, 1e300]
    assert vectors.decode_floats(vectors.encode_floats(values, REF, b"FLOATS01"), 4, REF, b"FLOATS01") == values
    for bad in ([-1.0], [float("inf")], [float("nan")]):
        with pytest.raises(ValueError):
            vectors.encode_floats(bad, REF, b"FLOATS01")
    sparse = [(0, 1), (3, (1 << 128) - 1), (2, 0)]
    raw = vectors.encode_sparse(sparse, 5, 1, REF, b"SPARSE01")
    assert vectors.decode_sparse(raw, 5, REF, b"SPARSE01") == ([(0, 1), (3, (1 << 128) - 1)], 1)
    with pytest.raises(ValueError):
        vectors.decode_sparse(raw, 4, REF, b"SPARSE01")


def test_lists(spark, tmp_path):
    assert [lists.auto_name(n, p) for n, p in ((1, "x/a b.fa.gz"), (2, "c.fastq"), (3, "d.fa.xz.gz"))] == ["000001_a_b", "000002_c", "000003_d"]
    (tmp_path / "s.fa").write_text(">x\nA\n")
    (tmp_path / "l.tsv").write_text("# list\n\ns.fa\none\ts.fa\ntwo\ts.fa\treads\n")
    got = lists.read_datasets(spark, f"{tmp_path}/l.tsv").orderBy("dataset_id").collect()
    assert [(r.name, r.mode) for r in got] == [("000001_s", "auto"), ("one", "auto"), ("two", "reads")]
    for bad in ([], ["a\tb\tc\td"], ["a\tb\tquick"], ["a\tb", "a\tc"], ["a/b\tc"], ["..\tc"], ["a\t\tb"]):
        with pytest.raises(ValueError):
            lists.parse_datasets(bad)
    (tmp_path / "names.gz").write_bytes(gzip.compress(b"# x\na\nb\na\n"))
    assert [r.name for r in lists.read_names(spark, f"{tmp_path}/names.gz", ("c",)).collect()] == ["c", "a", "b"]


def test_results_are_all_or_nothing(spark, tmp_path):
    with pytest.raises(ZeroDivisionError), results.publish(spark, f"{tmp_path}/r") as stage:
        stage.text("x", "y")
        raise ZeroDivisionError
    assert not list(tmp_path.iterdir())
    df = spark.createDataFrame([(i, f'n"{i},é') for i in range(50)], "id long, name string").repartition(3)
    for codec, opened in (("none", lambda b: b), ("gz", gzip.decompress), ("xz", lzma.decompress), ("zstd", lambda b: zstandard.ZstdDecompressor().decompress(b, 1 << 20))):
        n = results.write_csv(df, f"{tmp_path}/{codec}", codec)
        parts = sorted(p for p in (tmp_path / codec).iterdir() if not p.name.startswith("."))
        assert len(parts) == n == 3 and all(p.name.endswith(results.CODECS[codec]) for p in parts)
        lines = [x for p in parts for x in opened(p.read_bytes()).decode().splitlines()]
        assert lines.count('"id","name"') == 3 and '7,"n""7,é"' in lines and len(lines) == 53
    with pytest.raises(FileExistsError):
        results.write_csv(df, f"{tmp_path}/gz", "gz")
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            results.contained(bad, "/r/s")
    assert results.contained("a/b", "/r/s") == "/r/s/a/b"


def test_results_are_checked(spark, tmp_path):
    targets = spark.createDataFrame([(1, "a", 10, 4, 4), (2, "b", 10, 3, None)], "target_id long, name string, length long, unique_kmers long, kmer_length long")
    sets = spark.createDataFrame([(0, "global", "dataset", 100, 1)], "dataset long, name string, kind string, numerator long, scale int")
    counts = spark.createDataFrame([(0, 1, 5), (0, 2, 0)], "dataset long, target_id long, count long")
    told = results.save_results(f"{tmp_path}/r", targets, sets, counts, "exon", 7, failed=spark.createDataFrame([("s", "broken")], "name string, error string"))
    assert told["coverage"] == {"requested_datasets": 2, "completed_datasets": 1, "failed_datasets": 1, "complete": False}
    r = results.open_results(spark, f"{tmp_path}/r")
    assert sorted((x.kind, x["abundance"]) for x in results.export(r).collect()) == [("dataset", 0), ("dataset", 5), ("global", 0), ("global", 5)]
    assert results.export(r).columns == ["dataset", "kind", "abundance"] and results.export(r, ids=[2]).columns == ["dataset", "kind", "target_id", "name", "abundance"]
    assert [x.abundance for x in results.export(r, ids=[1], global_only=True, normalization="cpm", pooled=(100, 1)).collect()] == [50_000.0]
    for bad in ({"ids": [3]}, {"names": spark.createDataFrame([("zz",)], "name string")}, {"datasets": spark.createDataFrame([("zz",)], "name string")}, {"low": 3, "high": 2}, {"normalization": "coverage"}):
        with pytest.raises(ValueError):
            results.export(r, **bad)
    other = targets.withColumn("length", F.lit(11).cast("long"))
    assert results.reference_digest(other) != results.reference_digest(targets) == results.reference_digest(targets.repartition(2))
    for broken in (targets.where("target_id = 2"), targets.withColumn("target_id", F.lit(1).cast("long"))):
        with pytest.raises(ValueError):
            results.check_targets(broken)
    (tmp_path / "t.csv").write_text("status,transcript_id,gene_name,transcript_name,abundance,assigned_observations\nidentifiable,1,g,t,1.5,\nunresolved,2,g,u,,\n")
    got = results.read_transcripts(spark, f"{tmp_path}/t.csv").orderBy("transcript_id").collect()
    assert [(x.transcript_id, x.abundance, x.assigned_observations, x.status) for x in got] == [(1, 1.5, None, "identifiable"), (2, None, None, "unresolved")]
    (tmp_path / "f.csv").write_text("feature_id,abundance\n3,1.5\n1,0\n")
    got = vectors.read_sparse_csv(files.read_lines(spark, [f"{tmp_path}/f.csv"]), 3).collect()
    assert sorted((x.feature_id, x.y) for x in got) == [(1, 0.0), (3, 1.5)]
    for bad in ("x,y\n1,1\n", "feature_id,abundance\n4,1\n", "feature_id,abundance\n1,-1\n", "feature_id,abundance\n1,nan\n", "feature_id,abundance\n1,1\n1,2\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception, match="bad count|unknown columns|twice"):
            vectors.read_sparse_csv(files.read_lines(spark, [f"{tmp_path}/bad.csv"]), 3).collect()
    rows = spark.createDataFrame([(1, 3_500_000), (2, 0), (3, 2_000_000)], "feature_id long, value long")
    assert [tuple(x) for x in vectors.sparse_rows(rows, 1_000_000).orderBy("feature_id").collect()] == [(1, "3.5"), (3, "2")]


def test_samples_are_the_same_for_any_partitioning(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"), (F.col("id") * 7 % 1000).alias("count"))
    few = explore.approximate(rows.where("id < 400"), ["k"], ["i"], (75,)).orderBy("k").collect()
    assert [(r.k, r.sample_n, r.quantiles_approximate) for r in few] == [(0, 200, False), (1, 200, False)]
    true = explore.summarise(rows.where("id < 400"), ["k"], percentiles=(75,)).orderBy("k").collect()
    assert [r.p75 for r in few] == [r.p75 for r in true]
    take = lambda df, **x: {(r.k, r.i) for r in explore.sample(df, ["k"], ["i"], 256, **x).collect()}
    one = take(rows)
    assert one == take(rows.repartition(13)) == take(rows.orderBy(F.desc("i"))) and len(one) == 512 and one != take(rows, seed=2)
    # the sample of a union is the least of the parts' samples
    parts = [explore.sample(rows.where(f"i % 3 = {x}"), ["k"], ["i"], 256) for x in range(3)]
    assert take(parts[0].unionByName(parts[1]).unionByName(parts[2])) == one
    got = explore.approximate(rows, ["k"], ["i"], (50,), 256).first()
    assert got.quantiles_approximate and got.sample_n == 256 and abs(float(got.p50) - 500) < 120
    with pytest.raises(ValueError):
        explore.sample(rows, ["k"], ["i"], 10)


def test_summaries_of_one_scan_are_those_of_three(spark):
    rows = spark.createDataFrame([(d, t, None if (d, t) == (1, 2) else (d * t) % 5) for d in (1, 2, 3) for t in range(7)] + [(None, 1, 4)], "dataset int, target int, count long")
    got = explore.summaries(rows, "dataset", "target", percentiles=(25,))
    plan = got._jdf.queryExecution().toString()
    for level, keys in (("dataset", ["dataset"]), ("target", ["target"]), ("all", [])):
        want = explore.summarise(rows, keys, percentiles=(25,))
        assert sorted(map(repr, got.where(F.col("level") == level).select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    whole = got.where("level = 'all'").first()
    assert (whole.cells, whole.known, whole.missing) == (22, 21, 1) and whole.zeros == whole.known - whole.nonzero and "Scan parquet" in plan


def test_counts_that_were_changed_are_refused(spark, tmp_path):
    import shutil

    targets = spark.createDataFrame([(i, f"t{i}", 10, 1, 5) for i in (1, 2, 3)], "target_id long, name string, length long, unique_kmers long, kmer_length long")
    datasets = spark.createDataFrame([(1, "a", "dataset", 9, 1), (2, "b", "dataset", 9, 1)], "dataset int, name string, kind string, numerator long, scale long")
    counts = spark.createDataFrame([(d, t, d * t) for d in (1, 2) for t in (1, 2, 3)], "dataset int, target_id long, count long")
    results.save_results(str(tmp_path / "r"), targets, datasets, counts, "exon", 5)
    assert results.open_results(spark, str(tmp_path / "r")).counts.count() == 9
    kind = "target_id long, count long"
    for name, rows in {"changed": [(1, 2), (2, 4), (3, 7)], "lost": [(1, 2), (2, 4)], "doubled": [(1, 2), (2, 4), (3, 6), (3, 6)], "swapped": [(1, 4), (2, 2), (3, 6)]}.items():
        path = tmp_path / name
        shutil.copytree(tmp_path / "r", path)
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{path}/counts/dataset=2")
        with pytest.raises(ValueError, match="not those that were saved: 2"):
            results.open_results(spark, str(path))
        assert results.open_results(spark, str(path), verify=False).counts.count() > 0
    shutil.copytree(tmp_path / "r", tmp_path / "out")
    told = (tmp_path / "out" / "manifest.json").read_text()
    (tmp_path / "out" / ".manifest.json.crc").unlink(missing_ok=True)
    (tmp_path / "out" / "manifest.json").write_text(told.replace('"counts": "counts"', '"counts": "../r/counts"'))
    with pytest.raises(ValueError, match="leaves the result"):
        results.open_results(spark, str(tmp_path / "out"))
    shutil.copytree(tmp_path / "r", tmp_path / "gone")
    shutil.rmtree(tmp_path / "gone" / "counts" / "dataset=1")
    with pytest.raises(ValueError, match="saved: 1"):
        results.open_results(spark, str(tmp_path / "gone"))
    shutil.copytree(tmp_path / "r", tmp_path / "sum")
    spark.createDataFrame([(1, 1), (2, 2), (3, 3)], kind).write.mode("overwrite").parquet(f"{tmp_path}/sum/global")
    with pytest.raises(ValueError, match="global"):
        results.open_results(spark, str(tmp_path / "sum"))
    n = results.write_summaries(counts, targets, datasets, str(tmp_path / "s"), "gz", percentiles=(50,))
    back = spark.read.option("header", True).csv(f"{tmp_path}/s/datasets")
    assert n["overview"] == 1 and [(r.name, r.total, r.cells) for r in back.orderBy("dataset").collect()] == [("a", "6", "3"), ("b", "12", "3")]
    assert results.write_matrix_page(counts, targets, datasets, str(tmp_path / "page"), height=2, row_page=0) >= 1
    page = spark.read.option("header", True).csv(f"{tmp_path}/page").orderBy("target_id").collect()
    assert [tuple(r) for r in page] == [("1", "t1", "1", "2"), ("2", "t2", "2", "4")] and page[0].asDict().keys() == {"target_id", "name", "a", "b"}


def test_sheets_of_failed_tasks_leave_nothing(spark, tmp_path):
    bad = spark.range(2000).repartition(4).select("id", F.when(F.col("id") == 1500, F.raise_error(F.lit("stop here")).cast("long")).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="stop here"):
        results.write_csv(bad, str(tmp_path / "out"), "zstd")
    assert not [x for x in tmp_path.iterdir() if not x.name.startswith(".")] and not any((tmp_path / "out").glob("*"))


def levels_of(maximum, bits):
    """The levels by the format's own words, one after the other in plain Python."""
    last = 2**bits - 1
    if maximum <= last:
        return list(range(maximum + 1))
    prefix = min(15, last // 4)
    a, out = prefix + 1, list(range(prefix + 1))
    for c in range(a, last + 1):
        value = maximum if c == last else math.floor(math.exp(math.log(a) + (c - a) * (math.log(maximum) - math.log(a)) / (last - a)) + 0.5)
        out.append(min(max(value, out[-1] + 1), maximum - (last - c)))
    return out


@pytest.mark.parametrize("bits,maxima", [(2, (2, 3, 4, 1000)), (3, (7, 8, 100, 10**6)), (8, (255, 256, 300, 9_999, 104_949, 10**12)), (16, (65_536, 10**9))])
def test_codebooks_by_the_format(spark, bits, maxima):
    df = spark.createDataFrame([(m, m) for m in maxima], "k long, m long")
    got = {m: [] for m in maxima}
    for r in quantify.codebook(df, "k", "m", bits).orderBy("k", "code").collect():
        got[r.k].append(r.level)
    assert got == {m: levels_of(m, bits) for m in maxima}
    if bits == 3:  # worked out by hand: 0 and 1, then 2 * 50^(i/5)
        assert got[100] == [0, 1, 2, 4, 10, 21, 46, 100]
    if bits == 8:
        assert got[104_949][:18] == [*range(16), 16, 17] and got[104_949][-1] == 104_949 and got[300][:20] == list(range(20))


def test_both_ways_of_quantising_are_one(spark):
    top = 2**63 - 1
    rows = [(d, v) for d in (None, 1, 2) for v in (0, 1, 5, 17, 300, 1000, 1001, 2**31, 2**53 + 1, 2**55, top - 1, top)] + [(1, None), (9, 5), (2, -3), (2, 40), (2, 41), (2, 42)]
    counts = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "dataset int, count long, row int")
    maxima = spark.createDataFrame([(None, top), (1, 2**55), (2, 41)], "dataset int, m long")
    book = quantify.codebook(maxima, "dataset", "m", 6)
    levels = {}
    for r in book.orderBy("code").collect():
        levels.setdefault(r.dataset, []).append(r.level)
    want = {}
    for i, (d, v) in enumerate(rows):
        known = levels.get(d)
        near = None if known is None or v is None else min(range(len(known)), key=lambda c: (abs(known[c] - v), c))
        want[i] = (d, v, near, None if near is None else known[near])
    for most in (10**6, 0):
        assert {r.row: (r.dataset, r["count"], r.code, r.level) for r in quantify.quantise(counts, book, "dataset", most).collect()} == want


def test_numbers_as_shown(spark):
    big = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    got = one(spark, *(fn.short_number(big(v)) for v in (999, 1000, 999_499, 10**15, 18_446_744_073_709_551_615, 999_500_000_000_000)))
    assert list(got) == ["999", "1.00K", "999K", "1,000T", "18,400,000T", "1,000T"]
    assert list(one(spark, *(fn.scientific_real(F.lit(v)) for v in (0.125, 0.25, 12345.678, 0.0, 1e-9)))) == ["1.25e-1", "2.50e-1", "1.23e+4", "0.00e+0", "1.00e-9"]
    assert list(one(spark, *(fn.real_number(F.lit(v)) for v in (0.125, 0.25, 1234567.8, 1234.5678, 0.0001234567, 0.0, 100.0)))) == ["0.125", "0.25", "1,234,570", "1,234.57", "0.000123457", "0", "100"]
    assert list(one(spark, *(fn.short_real(F.lit(v)) for v in (0.25, 999.5, 1500.0, 1234.5, 12e6, 1e15, 2.5e16)))) == ["0.25", "999.5", "1.5K", "1.23K", "12M", "1000T", "25000T"]


def test_small_folds_and_null_keys(spark):
    rows = [(1, 0, 5e-320), (1, 1, 1e300), (1, 2, 0.0)]
    got = {r.dataset: r.log2_fold for r in explore.fold(spark.createDataFrame(rows, "target int, dataset int, value double"), "target").collect()}
    assert abs(got[0] - (math.log2(5e-320) + math.log2(3) - math.log2(1e300))) < 1e-6 and got[2] == float("-inf")
    counts = spark.createDataFrame([(None, 1, 3), (0, 2, 4)], "dataset int, target int, count long")
    frame = quantify.dense(counts, counts.select("dataset"), counts.select("target"), "dataset", "target")
    assert {(r.dataset, r.target, r["count"]) for r in frame.collect()} == {(None, 1, 3), (None, 2, 0), (0, 1, 0), (0, 2, 4)}
    assert {(r.dataset, r.target) for r in explore.top(counts, "dataset", "target", 1).collect()} == {(None, 1), (0, 2)}
    with pytest.raises(Exception, match="not negative"):
        explore.summarise(spark.createDataFrame([(1, -1)], "k int, count long"), ["k"]).collect()


def test_every_way_of_fitting_is_one(spark):
    """In one task, in blocks and in tables: equal to plain EM over each component's dense matrix."""
    rng = np.random.default_rng(4)
    exposure = [(f"f{i}", int(t), int(rng.integers(1, 9))) for i in range(60) for t in rng.choice(np.arange(10) + 10 * (i % 2), rng.integers(1, 5), replace=False)]
    exposure += [("only", 100, 5), ("twin", 200, 3), ("twin", 201, 3)]
    observed = [(d, f"f{i}", float(rng.integers(0, 40))) for d in (None, 1) for i in range(60) if rng.random() < 0.7] + [(1, "twin", 9.0)]
    x = spark.createDataFrame(exposure, "feature string, transcript long, a long")
    y = spark.createDataFrame(observed, "dataset int, feature string, y double")
    columns = ("rate", "assigned", "observed_sum", "log_likelihood", "fixed_point_change", "relative_l1_residual")
    whole = ("groups", "features", "rank", "active_features", "iterations", "converged")
    found = {}
    for way, options in {"tasks": {}, "blocks": {"most_entries": 0}, "tables": {"most_entries": 0, "most_groups": 0}}.items():
        members, fits = isoforms.fit_groups(x, y, max_iterations=5, tolerance=0.05, **options)
        found[way] = {(r.dataset, r.group): r for r in fits.collect()}
        assert len(found[way]) == fits.count()
    for way in ("blocks", "tables"):
        assert found[way].keys() == found["tasks"].keys()
        for k, r in found[way].items():
            s = found["tasks"][k]
            assert all(r[c] == s[c] for c in whole), (way, k, r, s)
            assert all(abs(r[c] - s[c]) <= 1e-9 * max(1, abs(s[c])) for c in columns), (way, k, r, s)
    member = {r.transcript: r.group for r in members.collect()}
    component = {r.group: r.component for r in members.collect()}
    for d in (None, 1):
        for c in set(component.values()):
            groups = sorted(g for g in set(member.values()) if component[g] == c)
            features = sorted({f for f, t, _ in exposure if member[t] == t and component[t] == c})
            a = np.zeros((len(features), len(groups)))
            for f, t, n in exposure:
                if t in groups:
                    a[features.index(f), groups.index(t)] = n
            counts = np.array([sum(v for e, g, v in observed if e == d and g == f) for f in features])
            ff, tt = np.nonzero(a)
            theta, assigned, told = isoforms.em_entries(ff, tt, a[ff, tt], len(groups), counts, 5, 0.05)
            for g, rate, part in zip(groups, theta, assigned, strict=True):
                r = found["tasks"][d, g]
                assert abs(r.rate - rate) < 1e-9 * max(1, rate) and abs(r.assigned - part) < 1e-9 * max(1, part)
                assert r.iterations == told["iterations"] and r.active_features == told["active_features"] and r.rank == isoforms.rank(a) and r.features == len(features)
                assert abs(r.log_likelihood - told["log_likelihood"]) < 1e-6 and abs(r.relative_l1_residual - told["relative_l1_residual"]) < 1e-9


def test_ranges_of_files_give_the_same_records(spark, tmp_path):
    rng = np.random.default_rng(2)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(1, 90, 60)]
    (tmp_path / "a.fa").write_text("\n".join(f">r{i} x\n" + "\n".join(s[j : j + 20] for j in range(0, len(s), 20)) + ("\n" if i % 5 == 0 else "") for i, s in enumerate(seqs)) + "\n")
    # qualities that look like headers, and like the line between
    quality = lambda i, n: ("@" if i % 2 else "+") + "@+>I"[i % 4] * (n - 1)
    (tmp_path / "b.fq").write_text("".join(f"@r{i}\n{s}\n+\n{quality(i, len(s))}\n" for i, s in enumerate(seqs)))
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress((tmp_path / "a.fa").read_bytes()))
    for name, split in (("a.fa", 1 << 20), ("a.fa", 100), ("a.fa", 333), ("b.fq", 1 << 20), ("b.fq", 150), ("b.fq", 401), ("c.fa.gz", 200)):
        df = fastx.read_sequences(spark, [str(tmp_path / name)], split)
        got = df.orderBy("record").collect()
        assert [(r.header.split()[0], r.seq) for r in got] == [(f"r{i}", s) for i, s in enumerate(seqs)], (name, split)
        assert df.rdd.getNumPartitions() == -(-(tmp_path / name).stat().st_size // split)
    uri = str(tmp_path / "b.fq")
    whole = [x for x in fastx.records(uri)]
    for split in range(1, 40):
        assert [x for i in range(0, (tmp_path / "b.fq").stat().st_size, split * 7) for x in fastx.records(uri, i, i + split * 7)] == whole


def test_broken_files_are_told_and_the_rest_is_counted(spark, tmp_path):
    text = "".join(f">r{i} ka:f:2\n{'ACGTTGCA' * (1 + i % 3)}{'ACGT'[i % 4]}\n" for i in range(400)).encode()
    (tmp_path / "one.fa").write_bytes(text)
    for name, raw in (("two.fa.gz", gzip.compress(text)[:-40]), ("three.fa.xz", lzma.compress(text)[:-20]), ("four.fa.zst", zstandard.compress(text)[:-5])):
        (tmp_path / name).write_bytes(raw)
        broken = fastx.read_sequences(spark, [str(tmp_path / name)], errors=True).where("error is not null").collect()
        assert len(broken) == 1 and broken[0].record == -1
        with pytest.raises(Exception, match="end|EOF|corrupt"):
            fastx.read_sequences(spark, [str(tmp_path / name)]).collect()
    (tmp_path / "five.fa").write_bytes(b">x\nACGTACGTA\n")
    (tmp_path / "six.fa.zst").write_bytes(zstandard.compress(text))
    references = spark.createDataFrame([("t1", "ACGTTGCAACGTT"), ("t2", "GGGGGCCCCCTTT")], "name string, seq string")
    given = {x: [str(tmp_path / f)] for x, f in (("one", "one.fa"), ("two", "two.fa.gz"), ("five", "five.fa"), ("six", "six.fa.zst"), ("lost", "lost.fa"))}
    with pytest.raises(ValueError, match="two: .*end-of-stream"):
        runs.run(references, given, 7, str(tmp_path / "none"))
    told = runs.run(references, given, 7, str(tmp_path / "out"), keep_going=True, split=1000)
    assert told["coverage"] == {"requested_datasets": 5, "completed_datasets": 2, "failed_datasets": 3, "complete": False}
    errors = {x["name"]: x["error"] for x in told["failed_datasets"]}
    assert set(errors) == {"two", "five", "lost"} and "no abundance" in errors["five"] and "no such file" in errors["lost"]
    found = results.open_results(spark, str(tmp_path / "out"))
    names = {r.dataset: r.name for r in found.datasets.collect()}
    counts = {(names[r.dataset], r.target_id): r["count"] for r in found.counts.where("dataset is not null").collect()}
    assert counts["one", 1] == counts["six", 1] > 0 and counts["one", 2] == counts["six", 2] == 0
    assert runs.run(references, {"one": given["one"]}, 7, str(tmp_path / "all"))["coverage"]["complete"]
    with pytest.raises(ValueError, match="all datasets failed"):
        runs.run(references, {"two": given["two"]}, 7, str(tmp_path / "x"), keep_going=True)
    for wrong in ({"k": 8}, {"mode": "x"}, {"datasets": {}}, {"stats": True, "keep_going": True}):
        with pytest.raises(ValueError):
            runs.run(**({"references": references, "datasets": given, "k": 7, "path": str(tmp_path / "y")} | wrong))


def test_exons_over_the_seams_of_blocks(spark):
    rng = np.random.default_rng(6)
    bases = {c: "".join(rng.choice(list("ACGT"), n)) for c, n in (("a", 1000), ("b", 64), ("c", 1), ("d", 129))}
    whole = spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(bases.items())], "contig string, bases string, place long")
    loci = [(c, int(s), int(e), x) for c in bases for s in rng.integers(1, len(bases[c]) + 1, 25) for e in [rng.integers(s, len(bases[c]) + 1)] for x in "+-"] + [("a", 1, 1000, "+"), ("a", 64, 65, "-"), ("b", 64, 64, "+"), ("b", 64, 64, "+")]
    rows = spark.createDataFrame(loci, "contig string, start long, end long, strand string")
    for width in (64, 1 << 16):
        for genome in (whole, intervals.blocks_of(whole, width)):
            got = intervals.extract(rows, genome, width).collect()
            plain = {(c, s, e, x): (bases[c][s - 1 : e] if x == "+" else bases[c][s - 1 : e].translate(str.maketrans("ACGT", "TGCA"))[::-1]) for c, s, e, x in loci}
            assert len(got) == len(loci) and all(r.seq == plain[r.contig, r.start, r.end, r.strand] for r in got)
    fails(intervals.extract(spark.createDataFrame([("z", 1, 2, "+")], rows.schema), whole), "not in the genome")
    for s, e in ((0, 1), (60, 65), (5, 4)):
        fails(intervals.extract(spark.createDataFrame([("b", s, e, "+")], rows.schema), whole, 64), "beyond its contig")
    holes = intervals.blocks_of(whole, 64).where("not (contig = 'a' and block = 2)")
    fails(intervals.extract(spark.createDataFrame([("a", 100, 200, "+")], rows.schema), holes, 64), "missing")


@pytest.mark.parametrize("k", [15, 33])
def test_a_frequent_kmer_is_few_rows(spark, k):
    """Poly-A in every record of every dataset: some rows for each task and dataset, and sums as without holding back."""
    rng = np.random.default_rng(9)
    rows = [(d, "A" * 60 + "".join(rng.choice(list("ACGT"), 60)), int(w)) for d in (0, 1, None) for w in rng.integers(1, 9, 300)]
    df = spark.createDataFrame(rows, "dataset int, seq string, w long").repartition(3)
    got = index.kmer_sums(df, "dataset", "seq", "w", k, block=500, held_rows=200)
    poly = F.lit(0).cast("long") if k <= 31 else F.lit(bytes(16))
    few = got.where(F.col("ck") == poly)
    assert few.count() <= 3 * 3 * 2
    of = lambda s: sum(s[i : i + k] in ("A" * k, "T" * k) for i in range(len(s) - k + 1))
    plain = {d: (sum(w * of(s) for e, s, w in rows if e == d), sum(of(s) for e, s, _ in rows if e == d)) for d in (0, 1, None)}
    assert {r.dataset: (r.w, r.n) for r in few.groupBy("dataset").agg(F.sum("w").alias("w"), F.sum("windows").alias("n")).collect()} == plain
    total = lambda x: {(r.dataset, bytes(r.ck) if k > 31 else r.ck): (r.w, r.n) for r in x.groupBy("dataset", "ck").agg(F.sum("w").alias("w"), F.sum("windows").alias("n")).collect()}
    assert total(got) == total(index.kmer_sums(df, "dataset", "seq", "w", k))
    assert sum(n for _, n in total(got).values()) == 900 * (121 - k)


@pytest.mark.parametrize("bits", range(2, 17))
def test_codes_are_read_where_they_lie(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 7, 8, 9, 1000):
        codes = rng.integers(0, 1 << bits, n)
        raw = vectors.pack_bits(codes, bits)
        assert (vectors.unpack_bits(raw, bits, n) == codes).all()
        at = rng.integers(0, n, 20)
        assert (vectors.codes_at(raw, bits, at) == codes[at]).all()
        if n * bits % 8:
            with pytest.raises(ValueError, match="padding"):
                vectors.unpack_bits(raw[:-1] + bytes([raw[-1] | 0x80]), bits, n)
