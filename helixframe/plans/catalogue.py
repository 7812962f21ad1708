"""The registered queries of the engine and their SQL, over sequences derived from the tables.

A sequence of 64 bases is the MD5 of a key written in ACGT.  Targets are rows of part (gene: brand), reads are rows of
lineitem with the part's sequence, weighed by quantity, in ten datasets by supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..operators import explore, index, intervals, isoforms, quantify, spans
from ..storage import cut

K = 15
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dna(key: Column) -> Column:
    text = key.cast("string")
    return F.translate(F.concat(F.md5(text.cast("binary")), F.md5(F.concat(F.lit("x"), text).cast("binary"))), "0123456789abcdef", "ACGT" * 4)


def records(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_brand").alias("gene"), dna(F.col("p_partkey")).alias("seq"))


def keyed_reads(spark, d) -> DataFrame:
    """Reads by the key that decides their sequence."""
    li = _t(spark, d, "lineitem")
    return li.select((F.col("l_suppkey") % 10).alias("dataset"), F.col("l_partkey").alias("key"), F.floor("l_quantity").cast("long").alias("w"))


def reads(spark, d) -> DataFrame:
    return keyed_reads(spark, d).select("dataset", dna(F.col("key")).alias("seq"), "w")


def summed_reads(spark, d) -> DataFrame:
    """Reads with one row for all of a dataset with one key, and how many `records` they are."""
    rows = keyed_reads(spark, d).groupBy("dataset", "key").agg(F.sum("w").alias("w"), F.count("*").alias("records"))
    return rows.select("dataset", dna(F.col("key")).alias("seq"), "w", "records")


def owner_table_of(spark, d) -> DataFrame:
    return index.owners(index.kmers(records(spark, d), ["target"], "seq", K), "target")


def counts_of(spark, d) -> DataFrame:
    return spans.count_records(keyed_reads(spark, d), records(spark, d), "dataset", "key", "w", K, bases=dna(F.col("key")))


def matrix(spark, d) -> DataFrame:
    """Written once, as most queries read it several times."""
    counts = quantify.finish(counts_of(spark, d).withColumn("raw", F.col("raw") * 100_000), fn.SCALE)
    return cut(quantify.dense(counts, reads(spark, d).select("dataset").distinct(), records(spark, d), "dataset", "target"))


_DNA = "translate(md5(CAST({0} AS VARCHAR)) || md5('x' || CAST({0} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_CK = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"
_BASE = f"""WITH rec AS (SELECT p_partkey AS target, p_brand AS gene, {_DNA.format('p_partkey')} AS seq FROM part),
rd AS (SELECT l_suppkey % 10 AS dataset, {_DNA.format('l_partkey')} AS seq, CAST(floor(l_quantity) AS BIGINT) AS qty FROM lineitem),
tk AS (SELECT target, gene, {_CK} AS ck FROM (SELECT target, gene, substr(seq, CAST(i AS INTEGER), {K}) AS w FROM rec, range(1, {64 - K + 2}) r(i))),
own AS (SELECT ck, CASE WHEN min(target) = max(target) THEN min(target) END AS owner FROM tk GROUP BY ck),
same AS (SELECT dataset, seq, sum(qty) AS qty, count(*) AS n FROM rd GROUP BY dataset, seq),
rk AS (SELECT dataset, {_CK} AS ck, qty FROM (SELECT dataset, qty, substr(seq, CAST(i AS INTEGER), {K}) AS w FROM same, range(1, {64 - K + 2}) r(i))),
cnt AS (SELECT dataset, owner AS target, CAST(sum(qty) AS BIGINT) AS raw FROM rk JOIN own USING (ck) WHERE owner IS NOT NULL GROUP BY dataset, owner),
mat AS (SELECT d.dataset, rec.target, CAST(coalesce((raw * 100000 + 500000) // 1000000, 0) AS BIGINT) AS count FROM (SELECT DISTINCT dataset FROM rd) d CROSS JOIN rec LEFT JOIN cnt ON cnt.dataset = d.dataset AND cnt.target = rec.target),
tot AS (SELECT dataset, CAST(sum(qty) AS BIGINT) * {64 - K + 1} AS total FROM rd GROUP BY dataset)
"""


@query(_BASE + "SELECT target, ck, count(*) AS n FROM tk GROUP BY target, ck")
def kmer_canonical(spark, d):
    got = index.kmers(records(spark, d), ["target"], "seq", K).groupBy("target", "ck").agg(F.count("*").alias("n"))
    return got.withColumn("ck", fn.unpacked(F.col("ck"), K))


@query(_BASE + "SELECT DISTINCT ck FROM tk")
def kmer_distinct(spark, d):
    return index.kmers(records(spark, d), [], "seq", K).distinct().select(fn.unpacked(F.col("ck"), K).alias("ck"))


@query(_BASE + "SELECT DISTINCT ck, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(translate(ck, 'ACGT', '0123'), ''), lambda x: CAST(x AS BIGINT))), lambda a, x: a * 4 + x) AS BIGINT) AS code FROM tk")
def kmer_packed(spark, d):
    return index.kmers(records(spark, d), [], "seq", K).distinct().select(fn.unpacked(F.col("ck"), K).alias("ck"), F.col("ck").alias("code"))


@query("SELECT doc_id, list_aggregate(list_transform(r, lambda x: len(x) - 2), 'sum')::BIGINT AS positions, len(r)::INTEGER AS runs FROM (SELECT doc_id, list_filter(regexp_extract_all(translate(text, 'acgt', 'ACGT'), '[ACGT]+'), lambda x: len(x) >= 3) AS r FROM documents) WHERE len(r) > 0")
def ambiguity_runs(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", fn.runs(F.col("text"), 3).alias("r")).where(F.size("r") > 0)
    return docs.select("doc_id", F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.length(x) - 2).alias("positions"), F.size("r").alias("runs"))


@query(f"SELECT p_partkey AS target, reverse(translate(translate({_DNA.format('p_partkey')}, 'GA', 'RN'), 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS rc FROM part")
def revcomp_iupac(spark, d):
    return records(spark, d).select("target", fn.reverse_complement(F.translate("seq", "GA", "RN")).alias("rc"))


@query(f"SELECT p_partkey AS target, CASE WHEN p_size % 2 = 0 THEN reverse(translate(substr({_DNA.format('p_partkey')}, 3, 20), 'ACGT', 'TGCA')) ELSE substr({_DNA.format('p_partkey')}, 3, 20) END AS seq FROM part")
def substring_locus(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("target"), dna(F.col("p_partkey")).alias("bases"), F.when(F.col("p_size") % 2 == 0, "-").otherwise("+").alias("strand"))
    return p.select("target", fn.locus_sequence(F.col("bases"), F.lit(3), F.lit(22), F.col("strand")).alias("seq"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity * 1000000 AS BIGINT) + 250000 AS micro, CAST((CAST(l_quantity AS BIGINT) * 1000000 + 25) // 50 AS BIGINT) AS kc FROM lineitem")
def header_weight(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("string").alias("q"))
    mean = F.concat(F.lit("u1 LN:i:64 ka:f:"), "q", F.lit(".25"))
    total = F.concat(F.lit("u1 KC:i:"), "q")
    return li.select("l_orderkey", "l_linenumber", fn.header_weight(mean, F.lit(64), K).alias("micro"), fn.header_weight(total, F.lit(64), K).alias("kc"))


@query("SELECT p_partkey, CAST(floor(p_retailprice * 1000000 + 0.5) AS BIGINT) AS micro FROM (SELECT p_partkey, round(p_retailprice, 2) AS p_retailprice FROM part)")
def decimal_micro(spark, d):
    return _t(spark, d, "part").select("p_partkey", fn.micro_units(F.col("p_retailprice").cast("decimal(20,2)").cast("string")).alias("micro"))


@query(_BASE + "SELECT ck, owner FROM own")
def owner_table(spark, d):
    return owner_table_of(spark, d).withColumn("ck", fn.unpacked(F.col("ck"), K))


@query(_BASE + "SELECT rec.target, coalesce(u.n, 0) AS unique_kmers FROM rec LEFT JOIN (SELECT owner, count(*) AS n FROM own GROUP BY owner) u ON u.owner = rec.target")
def unique_kmers(spark, d):
    return index.unique_counts(owner_table_of(spark, d), records(spark, d), "target").select("target", "unique_kmers")


@query(_BASE + "SELECT ck, CASE WHEN min(gene) = max(gene) THEN min(gene) END AS owner FROM tk GROUP BY ck")
def gene_grouped_owners(spark, d):
    return index.owners(index.kmers(records(spark, d), ["gene"], "seq", K), "gene").withColumn("ck", fn.unpacked(F.col("ck"), K))


@query(_BASE + f"SELECT gene, CAST(sum(64) AS BIGINT) AS length, CAST(sum({64 - K + 1}) AS BIGINT) AS kmer_length FROM rec GROUP BY gene")
def target_lengths(spark, d):
    return index.targets(records(spark, d), K, "gene", "seq")


@query(_BASE + "SELECT dataset, target, raw FROM cnt")
def quantify_reads(spark, d):
    return counts_of(spark, d)


@query(_BASE + f"SELECT dataset, CAST(sum(n) AS BIGINT) AS records, CAST(sum(n) * {64 - K + 1} AS BIGINT) AS valid_kmers, CAST(sum(qty) * {64 - K + 1} AS BIGINT) AS weighted_kmers FROM same GROUP BY dataset")
def dataset_metrics(spark, d):
    return quantify.dataset_metrics(summed_reads(spark, d), "dataset", "seq", "w", K)


@query(_BASE + "SELECT dataset, target, count FROM mat")
def dense_fill(spark, d):
    return matrix(spark, d)


@query(_BASE + "SELECT target, CAST(sum(count) AS BIGINT) AS count FROM mat GROUP BY target")
def global_sum(spark, d):
    return quantify.global_sum(matrix(spark, d), "target")


@query(_BASE + """, r AS (SELECT target, count, row_number() OVER (PARTITION BY target ORDER BY count) AS r, count(*) OVER (PARTITION BY target) AS n FROM mat)
SELECT target, CAST((sum(count) + count(*) // 2) // count(*) AS BIGINT) AS mean, CAST((sum(count) FILTER (r = (n + 1) // 2) + sum(count) FILTER (r = n // 2 + 1) + 1) // 2 AS BIGINT) AS median,
min(count) AS min, max(count) AS max, count(*) FILTER (count > 0) AS datasets_detected FROM r GROUP BY target""")
def cross_dataset_stats(spark, d):
    return quantify.cross_dataset(matrix(spark, d), "target")


_BOOK = """, mx AS (SELECT dataset, max(count) AS m FROM mat GROUP BY dataset),
rw AS (SELECT dataset, m, c AS code, CASE WHEN m > 255 AND c > 15 THEN CASE WHEN c = 255 THEN m::DOUBLE ELSE floor(exp(ln(16::DOUBLE) + (c - 16) * (ln(m::DOUBLE) - ln(16::DOUBLE)) / 239.0::DOUBLE) + 0.5) END - c END AS r FROM mx, LATERAL (SELECT unnest(range(0, least(m, 255) + 1)) AS c)),
book AS (SELECT dataset, code, CAST(CASE WHEN m <= 255 OR code <= 15 THEN code ELSE code + least(m - 255, greatest(0, max(r) OVER (PARTITION BY dataset ORDER BY code))) END AS BIGINT) AS level FROM rw)
"""


@query(_BASE + _BOOK + "SELECT dataset, code, level FROM book")
def codebook_levels(spark, d):
    return quantify.codebook(matrix(spark, d).groupBy("dataset").agg(F.max("count").alias("m")), "dataset", "m", 8)


@query(_BASE + _BOOK + """SELECT dataset, target, count, code, level FROM (
SELECT mat.dataset, target, count, code, level, row_number() OVER (PARTITION BY mat.dataset, target ORDER BY abs(count - level), level) AS r FROM mat JOIN book ON mat.dataset = book.dataset) WHERE r = 1""")
def quantize_encode(spark, d):
    m = matrix(spark, d)
    return quantify.quantise(m, quantify.codebook(m.groupBy("dataset").agg(F.max("count").alias("m")), "dataset", "m", 8), "dataset")


def _normal(mode: str, sql: str):
    def run(spark, d):
        totals = quantify.dataset_metrics(summed_reads(spark, d), "dataset", "seq", "w", K).select("dataset", F.col("weighted_kmers").alias("total"))
        rows = matrix(spark, d).join(totals, "dataset").withColumn("kmer_length", F.lit(64 - K + 1).cast("long"))
        return quantify.normalise(rows, mode).select("dataset", "target", F.round("value", 6).alias("value"))

    run.__name__ = "norm_" + mode.replace("-", "_")
    query(_BASE + f"SELECT mat.dataset, target, round({sql}, 6) AS value FROM mat JOIN tot ON mat.dataset = tot.dataset")(run)


_normal("cpm", "count::DOUBLE / total * 1e6")
_normal("coverage", f"count::DOUBLE / {64 - K + 1}")
_normal("length-cpm", f"count::DOUBLE / {64 - K + 1} / total * 1e6")


def _intervals(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    start = F.col("l_orderkey") * 7 % 100_000 + 1
    return li.select((F.col("l_suppkey") % 20).alias("contig"), F.col("l_returnflag").alias("strand"), start.alias("start"), (start + F.floor("l_quantity")).alias("end"), F.col("l_linenumber").alias("exon_id"))


_IV = "WITH iv AS (SELECT l_suppkey % 20 AS contig, l_returnflag AS strand, l_orderkey * 7 % 100000 + 1 AS start, l_orderkey * 7 % 100000 + 1 + CAST(floor(l_quantity) AS BIGINT) AS e, l_linenumber AS exon_id FROM lineitem)\n"


@query(_IV + """, f AS (SELECT *, CASE WHEN start > coalesce(max(e) OVER (PARTITION BY contig, strand ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT contig, strand, start, e FROM iv)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY contig, strand ORDER BY start, e) AS island FROM f) SELECT contig, strand, min(start) AS start, max(e) AS "end" FROM g GROUP BY contig, strand, island""")
def interval_merge(spark, d):
    return intervals.merge(_intervals(spark, d), ["contig", "strand"])


@query(_IV + """SELECT contig, strand, start, e AS "end", list_sort(list(DISTINCT exon_id)) AS exon_ids FROM iv GROUP BY contig, strand, start, e""")
def exon_dedupe(spark, d):
    return intervals.dedupe(_intervals(spark, d), ["contig", "strand", "start", "end"], ["exon_id"])


@query(_BASE + f"""SELECT DISTINCT l.gene, l.target AS l_start, r.target AS r_start, right(l.seq, {K - 1}) || left(r.seq, {K - 1}) AS context FROM rec l JOIN rec r ON l.gene = r.gene AND l.target <> r.target
WHERE l.gene IN (SELECT gene FROM rec GROUP BY gene HAVING count(*) <= 100)""")
def junction_all_pairs(spark, d):
    exons = records(spark, d).select("gene", F.col("target").alias("start"), F.col("target").alias("end"), "seq")
    return intervals.exon_pairs(exons, K, 100).select("gene", "l_start", "r_start", "context")


#: Exons of 50 neighbouring keys are a gene: within the default limit of exons a gene at every size.
_BLOCK = 50


@query(_BASE + f"""SELECT l.target // {_BLOCK} AS gene, l.target AS l_start, r.target AS r_start, right(l.seq, {K - 1}) || left(r.seq, {K - 1}) AS context FROM rec l JOIN rec r ON l.target // {_BLOCK} = r.target // {_BLOCK} AND l.target <> r.target
WHERE l.target // {_BLOCK} IN (SELECT target // {_BLOCK} FROM rec GROUP BY 1 HAVING count(*) <= 50)""")
def junction_block_pairs(spark, d):
    exons = records(spark, d).select(F.floor(F.col("target") / _BLOCK).alias("gene"), F.col("target").alias("start"), F.col("target").alias("end"), "seq")
    return intervals.exon_pairs(exons, K).select("gene", "l_start", "r_start", "context")


@query(_BASE + "SELECT gene, count(*) AS exons, count(*) > 100 AS above_limit FROM rec GROUP BY gene")
def junction_gene_report(spark, d):
    """The genes of junction_all_pairs: those above its limit have no pairs there."""
    return intervals.exon_counts(records(spark, d), 100)


def _members(spark, d) -> DataFrame:
    return index.memberships(index.kmers(records(spark, d), ["gene"], "seq", 7), "gene")


_FEAT = f"""WITH w AS (SELECT gene, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS ck FROM (SELECT p_brand AS gene, substr({_DNA.format('p_partkey')}, CAST(i AS INTEGER), 7) AS w FROM part, range(1, {64 - 7 + 2}) r(i))),
ev AS (SELECT ck, gene, count(*) AS m FROM w GROUP BY ck, gene),
sg AS (SELECT ck, string_agg(gene || ':' || m, ',' ORDER BY gene) AS s, count(*) AS members FROM ev GROUP BY ck),
fc AS (SELECT min(ck) AS feature, s, any_value(members) AS members, count(*) AS distinct_kmers FROM sg GROUP BY s)
"""


@query(_FEAT + "SELECT feature, distinct_kmers, members::INTEGER AS members FROM fc")
def feature_classes(spark, d):
    return index.classes(_members(spark, d)).select(fn.unpacked(F.col("feature"), 7).alias("feature"), "distinct_kmers", F.size("signature").alias("members"))


@query(_FEAT + "SELECT gene, CAST(sum(m * distinct_kmers) AS BIGINT) AS observable_kmers FROM fc JOIN sg ON sg.ck = fc.feature JOIN ev ON ev.ck = fc.feature GROUP BY gene")
def observable_kmers(spark, d):
    return index.exposure(index.classes(_members(spark, d)), "gene").groupBy("gene").agg(F.sum("a").alias("observable_kmers"))


def _exposure(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return li.select(F.concat(F.lit("f"), "l_orderkey").alias("feature"), F.col("l_partkey").alias("transcript"), F.lit(1).cast("long").alias("a")).distinct()


_COMPONENTS = """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS t FROM lineitem),
r(t, c) USING KEY (t) AS (SELECT DISTINCT t, t FROM e UNION SELECT b.t, min(r.c) FROM r JOIN e a ON a.t = r.t JOIN e b ON a.f = b.f JOIN recurring.r o ON o.t = b.t WHERE r.c < o.c GROUP BY b.t)
SELECT t AS transcript, c AS component FROM r"""


@query(_COMPONENTS)
def components(spark, d):
    li = _t(spark, d, "lineitem")
    return isoforms.components(li.select(F.col("l_orderkey").alias("feature"), F.col("l_partkey").alias("transcript")).distinct())


@query()
def em_fit(spark, d):
    x = _exposure(spark, d)
    y = _t(spark, d, "lineitem").groupBy(F.concat(F.lit("f"), "l_orderkey").alias("feature")).agg(F.sum("l_quantity").alias("y")).withColumn("dataset", F.lit(0))
    return isoforms.fit(x, y)


@query(_BASE + "SELECT dataset, target, count FROM mat WHERE count BETWEEN 100 AND 500 AND target IN (SELECT target FROM rec WHERE gene = 'Brand#11')")
def select_targets(spark, d):
    chosen = records(spark, d).where("gene = 'Brand#11'").select("target")
    return explore.bounds(explore.select(matrix(spark, d), "target", ids=chosen), 100, 500)


def _summary(keys, **options):
    return lambda spark, d: explore.summarise(matrix(spark, d), keys, **options).select(*keys, "known", F.col("total").cast("long").alias("total"), "nonzero", "above", "n", F.round(F.col("mean").cast("double"), 6).alias("mean"), "min", "max", F.round("stddev", 6).alias("stddev"), F.col("median").cast("double").alias("median"))


def _summary_sql(keys, use="count", threshold=100):
    by = "".join(k + ", " for k in keys)
    return _BASE + f"SELECT {by}count(count) AS known, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 0) AS nonzero, count(*) FILTER (count > {threshold}) AS above, count({use}) AS n, round(avg({use}::DOUBLE), 6) AS mean, min({use}) AS min, max({use}) AS max, round(stddev_pop({use}::DOUBLE), 6) AS stddev, median({use})::DOUBLE AS median FROM mat" + (f" GROUP BY {', '.join(keys)}" if keys else "")


for _name, _keys, _zero in (("overview", [], False), ("dataset_list", ["dataset"], False), ("target_list", ["target"], False), ("exclude_zeros", ["dataset"], True)):
    QUERIES[_name] = _summary(_keys, threshold=100, exclude_zeros=_zero)
    ORACLES[_name] = _summary_sql(_keys, "CASE WHEN count > 0 THEN count END" if _zero else "count")


@query(_BASE + "SELECT dataset, round(quantile_cont(count, 0.1), 6) AS p10, round(quantile_cont(count, 0.75), 6) AS p75 FROM mat GROUP BY dataset")
def pct_linear(spark, d):
    got = explore.summarise(matrix(spark, d), ["dataset"], percentiles=(10, 75))
    return got.select("dataset", *(F.round(F.col(p).cast("double"), 6).alias(p) for p in ("p10", "p75")))


@query(_BASE + "SELECT dataset, quantile_disc(count, 0.75)::DOUBLE AS q FROM mat GROUP BY dataset")
def pct_nearest_rank(spark, d):
    return explore.nearest_rank(matrix(spark, d), ["dataset"], 75).withColumn("q", F.col("q").cast("double"))


_HASH = "CAST('0x' || substr(md5('1:' || dataset || ':' || target), 1, 13) AS BIGINT)"


@query(_BASE + f""", s AS (SELECT dataset, count, row_number() OVER (PARTITION BY dataset ORDER BY {_HASH}, target) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM mat)
SELECT dataset, round(quantile_cont(count, 0.75), 6) AS p75, round(quantile_cont(count, 0.5), 6) AS p50, count(*) AS sample_n, any_value(n) > 256 AS quantiles_approximate FROM s WHERE r <= 256 GROUP BY dataset""")
def pct_approx(spark, d):
    """Percentiles of samples of 256 values a dataset."""
    got = explore.approximate(matrix(spark, d), ["dataset"], ["target"], (75, 50), 256)
    return got.withColumns({p: F.round(F.col(p).cast("double"), 6) for p in ("p75", "p50")})


_ONE = """SELECT {0}, CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (count = 0) AS BIGINT) AS zeros, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 100) AS above, round(avg(count::DOUBLE), 6) AS mean, min(count) AS min, max(count) AS max, round(stddev_pop(count::DOUBLE), 6) AS stddev, round(quantile_cont(count, 0.5), 6) AS median, round(quantile_cont(count, 0.9), 6) AS p90 FROM mat"""


@query(_BASE + _ONE.format("'dataset' AS level, dataset, NULL AS target") + " GROUP BY dataset UNION ALL " + _ONE.format("'target', NULL, target") + " GROUP BY target UNION ALL " + _ONE.format("'all', NULL, NULL"))
def summaries_at_once(spark, d):
    """Datasets, targets and the whole matrix from one scan."""
    got = explore.summaries(matrix(spark, d), "dataset", "target", threshold=100, percentiles=(90,))
    return got.select("level", "dataset", "target", "cells", "zeros", F.col("total").cast("long").alias("total"), "above", "min", "max", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "stddev", "median", "p90")))


_TOP = """, tp AS (SELECT dataset, target, count, row_number() OVER (PARTITION BY dataset ORDER BY count DESC, target) AS rank FROM mat WHERE count > 0), gt AS (SELECT dataset, CAST(sum(count) AS BIGINT) AS group_total FROM mat GROUP BY dataset)
"""


@query(_BASE + _TOP + "SELECT dataset, target, count, rank::INTEGER AS rank, group_total, round(count::DOUBLE / group_total, 9) AS share FROM tp JOIN gt USING (dataset) WHERE rank <= 20")
def topn_targets(spark, d):
    return explore.top(matrix(spark, d), "dataset", "target", 20).withColumn("share", F.round("share", 9))


@query(_BASE + _TOP + "SELECT dataset, CAST(max(group_total) - sum(count) AS BIGINT) AS other FROM tp JOIN gt USING (dataset) WHERE rank <= 20 GROUP BY dataset")
def topn_other(spark, d):
    return explore.others(explore.top(matrix(spark, d), "dataset", "target", 20), "dataset")


@query(_BASE + ", m AS (SELECT target, sum(count) AS s, count(*) AS n FROM mat GROUP BY target) SELECT dataset, mat.target, round(CASE WHEN s > 0 THEN count::DOUBLE / s * n END, 9) AS fold, round(CASE WHEN s > 0 AND count > 0 THEN log2(count::DOUBLE / s * n) WHEN s > 0 THEN '-inf'::DOUBLE END, 9) AS log2_fold FROM mat JOIN m ON m.target = mat.target")
def fold_change(spark, d):
    got = explore.fold(matrix(spark, d).withColumn("value", F.col("count").cast("double")), "target")
    return got.select("dataset", "target", fn.places(F.col("fold"), 9).alias("fold"), F.when(F.col("log2_fold") == float("-inf"), F.col("log2_fold")).otherwise(fn.places(F.col("log2_fold"), 9)).alias("log2_fold"))


@query(_BASE + "SELECT target, CAST(sum(count) AS BIGINT) AS total, row_number() OVER (ORDER BY sum(count) DESC, target) AS position FROM mat GROUP BY target")
def sort_total_desc(spark, d):
    return by_total(matrix(spark, d))


def by_total(m: DataFrame) -> DataFrame:
    totals = m.groupBy("target").agg(F.sum("count").alias("total"))
    return explore.ordered(totals, "total", "target").select("target", "total", F.col("position").cast("long").alias("position"))


@query(_BASE + "SELECT dataset, target, count FROM mat WHERE target IN (SELECT target FROM mat GROUP BY target HAVING max(count) > 0)")
def hide_empty(spark, d):
    return explore.hide_empty(matrix(spark, d), "target")


@query(_BASE + ", o AS (SELECT target, row_number() OVER (ORDER BY sum(count) DESC, target) AS position FROM mat GROUP BY target) SELECT dataset, mat.target, count, position, round(log10(count + 1) / (SELECT max(log10(count + 1)) FROM mat JOIN o USING (target) WHERE position <= 100), 9) AS fraction FROM mat JOIN o ON o.target = mat.target WHERE position <= 100")
def heatmap_page(spark, d):
    m = matrix(spark, d)
    shown = explore.page(m, by_total(m), "target", 0)
    return explore.scaled(shown, log=True).select("dataset", "target", "count", "position", F.round("fraction", 9).alias("fraction"))


from . import annotation, explorer, exports, inference  # noqa: E402, F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
