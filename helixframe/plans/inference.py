"""Queries of isoform inference: features are orders, transcripts are parts, counts are summed quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..operators import index, isoforms, quantify
from .catalogue import _DNA, _exposure, _t, query, reads, records

#: The two-isoform toy; exposures, counts, and what they are fitted to.
TOY_EXPOSURE = [("shared_a", "T_SKIP_B", "G", 34), ("only_b", "T_WITH_B", "G", 34), ("shared_c", "T_SKIP_B", "G", 33), ("shared_c", "T_WITH_B", "G", 33), ("edge_c", "T_SKIP_B", "G", 1), ("edge_c", "T_WITH_B", "G", 2), ("shared_a", "T_WITH_B", "G", 34)]
TOY_COUNTS = [(0, "shared_a", 340.0), (0, "only_b", 204.0), (0, "shared_c", 330.0), (0, "edge_c", 16.0)]
#: Transcripts of every status (T1 alone, T2 and T3 alike, Q1 to Q4 of rank 3, Z1 without k-mers, R1 without counts).
STATES_EXPOSURE = [
    ("a", "T1", 10), ("b", "T2", 8), ("b", "T3", 8), ("p", "Q1", 5), ("r", "Q1", 5), ("p", "Q2", 5), ("s", "Q2", 5), ("q", "Q3", 5), ("r", "Q3", 5), ("q", "Q4", 5), ("s", "Q4", 5), ("z", "R1", 7),
]
STATES_COUNTS = [(d, f, y) for d in (0, 1) for f, y in (("a", 60.0), ("b", 32.0), ("p", 20.0), ("q", 20.0), ("r", 20.0), ("s", 20.0))]
STATES_GENES = [(t, "g" + t[0]) for t in ("T1", "T2", "T3", "Q1", "Q2", "Q3", "Q4", "R1", "Z1")]


def _toy(spark):
    x = spark.createDataFrame(TOY_EXPOSURE, "feature string, transcript string, gene string, a long")
    return x.drop("gene"), spark.createDataFrame(TOY_COUNTS, "dataset int, feature string, y double"), x.select("transcript", "gene").distinct()


def _states(spark):
    x = spark.createDataFrame(STATES_EXPOSURE, "feature string, transcript string, a long")
    return x, spark.createDataFrame(STATES_COUNTS, "dataset int, feature string, y double"), spark.createDataFrame(STATES_GENES, "transcript string, gene string")


# -- reports over lineitem: each part is a component whose fit has a closed form ---------------------------------------------------
#
# Datasets are suppliers modulo 3; a part has n lines, y units and o units on odd lines of a dataset.  By part modulo 4:
# 0: T alone on a feature of exposure n.  1: A and B, alike.  2: S on a shared feature (n), W on it and on one of its own (2n).
# 3: four transcripts in a ring of four features, of rank 3, with counts in dataset 0 only.  Parts modulo 10 = 0 also have Z, which
# no feature shows.  Two parts are a gene.

_PARTS = """WITH li AS (SELECT l_suppkey % 3 AS dataset, l_partkey AS p, l_linenumber % 2 = 1 AS odd, l_quantity AS q FROM lineitem),
parts AS (SELECT p, count(*) AS n FROM li GROUP BY p), ds AS (SELECT DISTINCT dataset FROM li),
c AS (SELECT dataset, p, sum(q)::DOUBLE AS y, coalesce(sum(q) FILTER (odd), 0)::DOUBLE AS o FROM li GROUP BY dataset, p),
grid AS (SELECT dataset, p, n, coalesce(y, 0) AS y, coalesce(o, 0) AS o FROM ds CROSS JOIN parts LEFT JOIN c USING (dataset, p)),
tr AS (
  SELECT dataset, p, 'T' || p AS transcript, 'T' || p AS grp, 'T' || p AS component, 1 AS members, 1 AS groups, 1 AS features, 1 AS rank, n AS obs, y / n AS rate, y AS total, CASE WHEN y > 0 THEN 1 ELSE 0 END AS active FROM grid WHERE p % 4 = 0
  UNION ALL SELECT dataset, p, x || p, 'A' || p, 'A' || p, 2, 1, 1, 1, n, y / n, y, CASE WHEN y > 0 THEN 1 ELSE 0 END FROM grid, (VALUES ('A'), ('B')) v(x) WHERE p % 4 = 1
  UNION ALL SELECT dataset, p, 'S' || p, 'S' || p, 'S' || p, 1, 2, 2, 2, n, y / n - o / (2 * n), y + o, CASE WHEN y > 0 THEN 1 ELSE 0 END + CASE WHEN o > 0 THEN 1 ELSE 0 END FROM grid WHERE p % 4 = 2
  UNION ALL SELECT dataset, p, 'W' || p, 'W' || p, 'S' || p, 1, 2, 2, 2, 3 * n, o / (2 * n), y + o, CASE WHEN y > 0 THEN 1 ELSE 0 END + CASE WHEN o > 0 THEN 1 ELSE 0 END FROM grid WHERE p % 4 = 2
  UNION ALL SELECT dataset, p, 'Q' || p || '_' || i, 'Q' || p || '_' || i, 'Q' || p || '_1', 1, 4, 4, 3, 10, CASE dataset WHEN 0 THEN y / 10 ELSE 0 END, CASE dataset WHEN 0 THEN 4 * y ELSE 0 END, CASE WHEN dataset = 0 AND y > 0 THEN 4 ELSE 0 END FROM grid, range(1, 5) r(i) WHERE p % 4 = 3
  UNION ALL SELECT dataset, p, 'Z' || p, 'Z' || p, 'Z' || p, 1, 1, 0, 0, 0, 0, 0, 0 FROM grid WHERE p % 10 = 0),
s AS (
  SELECT *, 'g' || (p // 2) AS gene, CASE WHEN obs = 0 THEN 'unobservable' WHEN total = 0 THEN 'zero_evidence' WHEN rank <> groups THEN 'unresolved' WHEN members > 1 THEN 'group_only' ELSE 'identifiable' END AS state FROM tr),
k AS (SELECT *, state IN ('identifiable', 'group_only', 'zero_evidence') AS known FROM s),
g AS (SELECT dataset, gene, sum(CASE WHEN transcript = grp THEN rate ELSE 0 END) AS gene_rate, bool_and(known) AS gene_known FROM k GROUP BY dataset, gene),
d AS (SELECT dataset, sum(CASE WHEN transcript = grp THEN rate ELSE 0 END) AS every, bool_and(known OR obs = 0) AS all_known FROM k GROUP BY dataset)
"""
#: Keeps closed forms and fits, which differ in their last digits, on one side of a rounding.
_NUDGE = 1.3e-8


def _parts(spark, d):
    """(exposure, observed, genes) of the components described above."""
    li = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 3).alias("dataset"), F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"))
    parts = li.groupBy("p").agg(F.count("*").alias("n"))
    p, n, kind = F.col("p").cast("string"), F.col("n"), F.col("p") % 4
    name = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    entry = lambda feature, transcript, a: F.struct(name(feature, p).alias("feature"), transcript.alias("transcript"), a.cast("long").alias("a"))
    ring = [entry(f, name("Q", p, f"_{i}"), F.lit(5)) for i, fs in enumerate(("pr", "ps", "qr", "qs"), 1) for f in fs]
    of = (
        F.when(kind == 0, F.array(entry("a", name("T", p), n))).when(kind == 1, F.array(entry("a", name("A", p), n), entry("a", name("B", p), n)))
        .when(kind == 2, F.array(entry("a", name("S", p), n), entry("a", name("W", p), n), entry("o", name("W", p), 2 * n))).otherwise(F.array(*ring))
    )
    exposure = parts.select(F.explode(of).alias("x")).select("x.*")
    y = li.groupBy("dataset", "p").agg(F.sum("q").alias("y"), F.coalesce(F.sum(F.when(F.col("line") % 2 == 1, F.col("q"))), F.lit(0.0)).alias("o"))
    count = lambda feature, y: F.struct(name(feature, p).alias("feature"), y.cast("double").alias("y"))
    ring = F.when(F.col("dataset") == 0, F.array(*(count(f, F.col("y")) for f in "pqrs")))
    of = F.when(kind < 2, F.array(count("a", F.col("y")))).when(kind == 2, F.array(count("a", F.col("y")), count("o", F.col("o")))).otherwise(ring)
    observed = y.select("dataset", F.explode(of).alias("x")).select("dataset", "x.*")
    gene = F.concat(F.lit("g"), F.floor(F.col("p") / 2).cast("string")).alias("gene")
    hidden = parts.where("p % 10 = 0").select(name("Z", p).alias("transcript"), gene)
    shown = parts.select(gene, F.explode(of_names(kind, p)).alias("transcript")).select("transcript", "gene")
    return exposure, observed, shown.unionByName(hidden)


def of_names(kind, p):
    """The transcripts of a part that features show."""
    names = [("T",), ("A", "B"), ("S", "W")]
    plain = [F.array(*(F.concat(F.lit(x), p) for x in some)) for some in names]
    return F.when(kind == 0, plain[0]).when(kind == 1, plain[1]).when(kind == 2, plain[2]).otherwise(F.array(*(F.concat(F.lit("Q"), p, F.lit(f"_{i}")) for i in range(1, 5))))


def _part_fits(spark, d):
    exposure, observed, genes = _parts(spark, d)
    return *isoforms.fit_groups(exposure, observed, genes, tolerance=1e-12), genes


_ROUND = ("abundance", "within_gene_fraction", "relative_abundance_ppm", "assigned_observations", "model_estimate", "observed_sum")


def _rounded(df, digits=6, nudge=0.0):
    places = lambda c: digits - 3 if c == "relative_abundance_ppm" else digits
    return df.select(*(F.round(F.col(c) + nudge, places(c)).alias(c) if c in _ROUND else F.col(c) for c in df.columns))


@query(_PARTS + f"""SELECT k.dataset, transcript, k.gene, grp AS "group", component, obs AS observable_kmers, CASE WHEN members = 1 AND known THEN round(rate + {_NUDGE}, 6) END AS abundance,
  CASE WHEN members = 1 AND known AND gene_known THEN round(CASE WHEN gene_rate > 0 THEN rate / gene_rate ELSE 0 END + {_NUDGE}, 6) END AS within_gene_fraction,
  CASE WHEN members = 1 AND known AND all_known THEN round(CASE WHEN every > 0 THEN 1e6 * rate / every ELSE 0 END + {_NUDGE}, 3) END AS relative_abundance_ppm,
  CASE WHEN members = 1 AND known THEN round(rate * obs + {_NUDGE}, 6) END AS assigned_observations, CASE WHEN members = 1 AND obs > 0 THEN round(rate + {_NUDGE}, 6) END AS model_estimate, state AS status
FROM k JOIN g ON g.dataset = k.dataset AND g.gene = k.gene JOIN d ON d.dataset = k.dataset""")
def transcript_report(spark, d):
    members, fits, genes = _part_fits(spark, d)
    return _rounded(isoforms.transcript_report(members, fits, genes), nudge=_NUDGE)


@query(_PARTS + f"SELECT dataset, transcript, CASE WHEN members = 1 AND known THEN round(rate + {_NUDGE}, 6) END AS abundance, state AS status FROM k")
def em_status(spark, d):
    members, fits, genes = _part_fits(spark, d)
    return _rounded(isoforms.transcript_report(members, fits, genes).select("dataset", "transcript", "abundance", "status"), nudge=_NUDGE)


_GLOBAL = _PARTS + """, w AS (SELECT grp, any_value(component) AS component, any_value(gene) AS gene, any_value(members) AS members, any_value(groups) AS groups, any_value(features) AS features, any_value(rank) AS rank, any_value(obs) AS obs,
  sum(rate) AS rate, sum(total) AS total, max(active) AS active FROM k WHERE transcript = grp GROUP BY grp),
ws AS (SELECT *, CASE WHEN obs = 0 THEN 'unobservable' WHEN total = 0 THEN 'zero_evidence' WHEN rank <> groups THEN 'unresolved' WHEN members > 1 THEN 'group_only' ELSE 'identifiable' END AS state FROM w)
"""


@query(_GLOBAL + f"""SELECT grp AS "group", '["' || gene || '"]' AS gene_names, CASE WHEN members = 2 THEN '["' || grp || '","B' || substr(grp, 2) || '"]' ELSE '["' || grp || '"]' END AS transcript_names, obs AS observable_kmers,
  CASE WHEN state IN ('identifiable', 'group_only', 'zero_evidence') THEN round(rate + {_NUDGE}, 6) END AS abundance, round(rate * obs + {_NUDGE}, 6) AS assigned_observations, state AS status FROM ws""")
def group_report_global(spark, d):
    """The sum over all datasets, by groups."""
    members, fits, genes = _part_fits(spark, d)
    got = isoforms.group_report(members, isoforms.global_fit(fits), genes)
    return _rounded(got.select("group", "gene_names", "transcript_names", "observable_kmers", "abundance", "assigned_observations", "status"), nudge=_NUDGE)


@query(_GLOBAL + "SELECT DISTINCT component, groups::BIGINT AS groups, features::BIGINT AS features, rank::BIGINT AS rank, active::BIGINT AS active_features, total::DOUBLE AS observed_sum, true AS converged FROM ws")
def diagnostics_global(spark, d):
    _, fits, _ = _part_fits(spark, d)
    got = isoforms.diagnostics_report(isoforms.global_fit(fits))
    return got.select("component", "groups", "features", "rank", "active_features", "observed_sum", "converged")


_EDGES = "e AS (SELECT DISTINCT 'f' || l_orderkey AS f, l_partkey AS t FROM lineitem)"


@query(f"WITH {_EDGES}, s AS (SELECT t, string_agg(f, ',' ORDER BY f) AS s, count(*) AS n FROM e GROUP BY t) SELECT t AS transcript, min(t) OVER (PARTITION BY s) AS \"group\", n AS observable_kmers FROM s")
def profile_groups(spark, d):
    return isoforms.profile_groups(_exposure(spark, d))


_ROUNDS = 5
_STEPS = "".join(
    f""", p{i} AS (SELECT e.t, y.y * x{i}.r / sum(x{i}.r) OVER (PARTITION BY e.f) AS part FROM g e JOIN x{i} ON x{i}.t = e.t JOIN y ON y.f = e.f),
x{i + 1} AS (SELECT p.t, sum(part) / any_value(n) AS r FROM p{i} p JOIN len ON len.t = p.t GROUP BY p.t)"""
    for i in range(_ROUNDS)
)


@query(
    f"""WITH RECURSIVE {_EDGES}, y AS (SELECT 'f' || l_orderkey AS f, sum(l_quantity) AS y FROM lineitem GROUP BY 1),
k(t, c) USING KEY (t) AS (SELECT DISTINCT t, t FROM e UNION SELECT b.t, min(k.c) FROM k JOIN e a ON a.t = k.t JOIN e b ON a.f = b.f JOIN recurring.k o ON o.t = b.t WHERE k.c < o.c GROUP BY b.t),
s AS (SELECT t, string_agg(f, ',' ORDER BY f) AS s, count(*) AS n FROM e GROUP BY t), grp AS (SELECT t, min(t) OVER (PARTITION BY s) AS grp, n FROM s),
g AS (SELECT e.f, e.t FROM e JOIN grp ON grp.t = e.t AND grp.grp = grp.t), len AS (SELECT t, n FROM grp WHERE t = grp),
seen AS (SELECT DISTINCT k.c, g.f FROM g JOIN k ON k.t = g.t), tot AS (SELECT c, sum(y) AS y FROM seen JOIN y ON y.f = seen.f GROUP BY c), size AS (SELECT c, sum(n) AS n FROM len JOIN k ON k.t = len.t GROUP BY c),
x0 AS (SELECT len.t, tot.y / size.n AS r FROM len JOIN k ON k.t = len.t JOIN tot ON tot.c = k.c JOIN size ON size.c = k.c){_STEPS}
SELECT t AS "group", round(r, 6) AS rate FROM x{_ROUNDS}"""
)
def em_rounds(spark, d):
    """Five steps of EM over all rows of lineitem, as SQL can unroll them."""
    y = _t(spark, d, "lineitem").groupBy(F.concat(F.lit("f"), "l_orderkey").alias("feature")).agg(F.sum("l_quantity").alias("y")).withColumn("dataset", F.lit(0))
    _, fits = isoforms.fit_groups(_exposure(spark, d), y, max_iterations=_ROUNDS, tolerance=1e-300)
    return fits.select("group", F.round("rate", 6).alias("rate"))


# -- membership classes of two kinds: exons are parts, transcripts are brands (their parts' sequences one after the other) -------------

_CLASSES = f"""WITH rec AS (SELECT p_partkey AS exon, p_brand AS tr, {_DNA.format('p_partkey')} AS seq FROM part),
w AS (SELECT exon, tr, substr(seq, CAST(i AS INTEGER), 7) AS w FROM rec, range(1, 59) r(i)), k AS (SELECT exon, tr, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS ck FROM w),
ex AS (SELECT ck, exon, count(*) AS m FROM k GROUP BY ck, exon), tx AS (SELECT ck, tr, count(*) AS m FROM k WHERE exon % 2 = 0 GROUP BY ck, tr),
sg AS (SELECT ck, (SELECT string_agg(exon || ':' || m, ',' ORDER BY exon) FROM ex WHERE ex.ck = d.ck) AS s, coalesce((SELECT string_agg(tr || ':' || m, ',' ORDER BY tr) FROM tx WHERE tx.ck = d.ck), '') AS t,
  (SELECT count(*) FROM ex WHERE ex.ck = d.ck) AS exons, (SELECT count(*) FROM tx WHERE tx.ck = d.ck) AS transcripts FROM (SELECT DISTINCT ck FROM ex) d),
fc AS (SELECT min(ck) AS feature, s, t, count(*) AS distinct_kmers, CAST(any_value(exons) AS INTEGER) AS exons, CAST(any_value(transcripts) AS INTEGER) AS transcripts FROM sg GROUP BY s, t)
"""


def _two_kinds(spark, d):
    # k-mers of every second part are the brand's transcript too
    rows = records(spark, d)
    exon = index.kmers(rows.select(F.col("target").cast("string").alias("member"), "seq"), ["member"], "seq", 7)
    transcript = index.kmers(rows.where(F.col("target") % 2 == 0).select(F.col("gene").alias("member"), "seq"), ["member"], "seq", 7)
    return index.memberships_of_two(exon, transcript)


@query(_CLASSES + "SELECT feature, distinct_kmers, exons, transcripts FROM fc")
def feature_classes_two_kinds(spark, d):
    got = index.classes(_two_kinds(spark, d), ["exons", "transcripts"])
    return got.select(fn.unpacked(F.col("feature"), 7).alias("feature"), "distinct_kmers", F.size("exons").alias("exons"), F.size("transcripts").alias("transcripts"))


@query(_CLASSES + f""", rd AS (SELECT l_suppkey % 10 AS dataset, {_DNA.format('l_partkey')} AS seq, sum(CAST(floor(l_quantity) AS BIGINT)) AS qty FROM lineitem GROUP BY 1, 2),
rk AS (SELECT dataset, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS ck, qty FROM (SELECT dataset, qty, substr(seq, CAST(i AS INTEGER), 7) AS w FROM rd, range(1, 59) r(i)))
SELECT dataset, feature, CAST(sum(qty) AS DECIMAL(38,0)) AS value FROM rk JOIN sg USING (ck) JOIN fc ON fc.s = sg.s AND fc.t = sg.t GROUP BY dataset, feature""")
def feature_counts(spark, d):
    members = _two_kinds(spark, d)
    found = index.classes(members, ["exons", "transcripts"])
    features = index.feature_of_kmers(members, found, ["exons", "transcripts"])
    got = quantify.count_features(reads(spark, d), features, "dataset", "seq", "w", 7)
    return got.select("dataset", fn.unpacked(F.col("feature"), 7).alias("feature"), "value")
