"""Queries of the explorer: profiles, orders, pages, shares, bounds and selections over the derived matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as fn
from ..operators import explore, quantify
from .catalogue import _BASE, K, _t, by_total, matrix, query, reads, records

_NAMES = "nm AS (SELECT p_partkey AS target, p_name AS name FROM part)"


def names(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("name"))


@query(_BASE + ", r AS (SELECT *, row_number() OVER (PARTITION BY count > 0 ORDER BY count DESC, dataset) AS rank, sum(count) OVER () AS s, count(*) OVER () AS n FROM mat WHERE target = 7) SELECT dataset, count, CASE WHEN count > 0 THEN rank::INTEGER END AS rank, count > 0 AND rank <= 5 AS shown, round(CASE WHEN s > 0 THEN count::DOUBLE / s * n END, 9) AS fold FROM r")
def target_focus(spark, d):
    got = explore.target_focus(matrix(spark, d).withColumn("value", F.col("count").cast("double")), "target", "dataset", 7, 5)
    return got.select("dataset", "count", "rank", "shown", F.round("fold", 9).alias("fold"))


@query(_BASE + "SELECT target, CAST(sum(count) AS BIGINT) AS total, max(count) AS max, count(*) FILTER (count > 0) AS detected FROM mat GROUP BY target")
def row_summaries(spark, d):
    return explore.totals(matrix(spark, d), "target", "count")


@query(_BASE + "SELECT dataset, CAST(sum(count) AS BIGINT) AS total, max(count) AS max, count(*) FILTER (count > 0) AS detected FROM mat GROUP BY dataset")
def column_summaries(spark, d):
    return explore.totals(matrix(spark, d), "dataset", "count")


_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(CAST(length(regexp_replace(p, '^0+(.)', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(p, '^0+(.)', '\\1') ELSE p END), '')"


@query(f"WITH {_NAMES} SELECT target, row_number() OVER (ORDER BY {_NATURAL} DESC, target) AS position FROM nm")
def sort_name_desc(spark, d):
    return explore.sorted_by(names(spark, d), "name-desc", "target").select("target", F.col("position").cast("long").alias("position"))


@query(_BASE + ", s AS (SELECT target, max(count) AS m, sum(count) AS total, count(*) FILTER (count > 0) AS detected FROM mat GROUP BY target) SELECT target, row_number() OVER (ORDER BY detected DESC, target) AS by_detected, row_number() OVER (ORDER BY m DESC, target) AS by_max FROM s")
def sort_modes(spark, d):
    t = explore.totals(matrix(spark, d), "target", "count")
    one = explore.sorted_by(t, "detected-desc", "target").select("target", F.col("position").cast("long").alias("by_detected"))
    return one.join(explore.sorted_by(t, "max-desc", "target").select("target", F.col("position").cast("long").alias("by_max")), "target")


@query(_BASE + ", s AS (SELECT target, avg(count) FILTER (count > 20) AS mean FROM mat GROUP BY target) SELECT target, row_number() OVER (ORDER BY mean DESC NULLS LAST, target) AS position FROM s")
def sort_statistic_nulls_last(spark, d):
    s = matrix(spark, d).groupBy("target").agg(F.avg(F.when(F.col("count") > 20, F.col("count"))).alias("mean"))
    return explore.sorted_summary(s, "mean", "target").select("target", F.col("position").cast("long").alias("position"))


@query(_BASE + ", o AS (SELECT target, row_number() OVER (ORDER BY sum(count) DESC, target) AS position FROM mat GROUP BY target) SELECT target, position, " + ", ".join(f"max(count) FILTER (dataset = {i + 4}) AS c{i}" for i in range(1, 6)) + " FROM mat JOIN o USING (target) WHERE position > 20 AND position <= 40 GROUP BY target, position")
def heatmap_pivot(spark, d):
    m = matrix(spark, d)
    columns = m.select("dataset").distinct().withColumn("position", F.col("dataset") + 1)
    return explore.pivot_page(m, "target", "dataset", by_total(m), columns, 1, 1, 20, 5)


@query(_BASE + "SELECT dataset, target, count, CASE WHEN count BETWEEN 10 AND 30 THEN count END AS shown FROM mat")
def display_bounds(spark, d):
    return explore.display_bounds(matrix(spark, d), 10, 30, "count")


@query(_BASE + ", m AS (SELECT target, sum(count) AS s, count(*) AS n FROM mat GROUP BY target), f AS (SELECT dataset, mat.target, CASE WHEN s > 0 AND count > 0 THEN log2(count::DOUBLE / s * n) WHEN s > 0 THEN '-inf'::DOUBLE END AS v FROM mat JOIN m ON m.target = mat.target) SELECT dataset, target, round(greatest(-1.0, least(1.0, v / (SELECT greatest(1.0, max(abs(v)) FILTER (isfinite(v))) FROM f))), 9) AS fraction FROM f WHERE v IS NOT NULL")
def fold_extent(spark, d):
    f = explore.fold(matrix(spark, d).withColumn("value", F.col("count").cast("double")), "target")
    return explore.fold_scaled(f.where("log2_fold is not null")).select("dataset", "target", F.round("fraction", 9).alias("fraction"))


@query(_BASE + ", t AS (SELECT dataset, target, count, row_number() OVER (PARTITION BY dataset ORDER BY count DESC, target) AS rank FROM mat WHERE count > 0) SELECT dataset, target, rank::INTEGER AS rank, round(100.0::DOUBLE * count / total, 9) AS percent FROM t JOIN tot USING (dataset) WHERE rank <= 10")
def share_input(spark, d):
    inputs = quantify.dataset_metrics(reads(spark, d), "dataset", "seq", "w", K).select("dataset", F.col("weighted_kmers").alias("input_total"))
    return explore.shares(explore.top(matrix(spark, d), "dataset", "target", 10), "dataset", "target", inputs).select("dataset", "target", "rank", F.round("percent", 9).alias("percent"))


@query(_BASE + ", z AS (SELECT dataset, target, CASE WHEN dataset = 3 THEN 0 ELSE count END AS count FROM mat), t AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY count DESC, target) AS rank FROM z WHERE count > 0), s AS (SELECT dataset, sum(count) AS s FROM z GROUP BY dataset) SELECT dataset, 'target' AS kind, target, rank::INTEGER AS rank, CAST(count AS BIGINT) AS value, round(100.0::DOUBLE * count / s, 6) AS percent FROM t JOIN s USING (dataset) WHERE rank <= 5 UNION ALL SELECT s.dataset, CASE WHEN n = 0 THEN 'summary' ELSE 'other' END, NULL, NULL, CAST(s.s - x.v AS BIGINT), round(CASE WHEN s.s > 0 THEN 100.0::DOUBLE * (s.s - x.v) / s.s END, 6) FROM s JOIN (SELECT s.dataset, count(rank) AS n, coalesce(sum(count), 0) AS v FROM s LEFT JOIN t ON t.dataset = s.dataset AND rank <= 5 GROUP BY s.dataset) x USING (dataset) WHERE n = 0 OR s.s > x.v")
def ranking_report(spark, d):
    m = matrix(spark, d).withColumn("count", F.when(F.col("dataset") == 3, 0).otherwise(F.col("count")))
    return explore.ranking_report(m, "dataset", "target", 5).withColumn("percent", F.round("percent", 6))


@query(_BASE + ", s AS (SELECT target, sum(count)::DOUBLE AS total, max(count)::DOUBLE AS max FROM mat GROUP BY target) SELECT target, round(coalesce(total / nullif((SELECT max(total) FROM s), 0), 0), 9) AS fraction_total, round(coalesce(max / nullif((SELECT max(max) FROM s), 0), 0), 9) AS fraction_max FROM s")
def list_fractions(spark, d):
    got = explore.list_fractions(explore.totals(matrix(spark, d), "target", "count"), ["total", "max"])
    return got.select("target", F.round("fraction_total", 9).alias("fraction_total"), F.round("fraction_max", 9).alias("fraction_max"))


_LIST = "#3\n// a comment\n\n#11\n#3"


@query(f"WITH {_NAMES} SELECT target, name FROM nm WHERE target IN (3, 11)")
def paste_list(spark, d):
    return explore.paste_select(names(spark, d), _LIST, "target", "name")


@query(f"WITH {_NAMES} SELECT target, name FROM nm WHERE contains(lower(name), 're')")
def search_names(spark, d):
    return explore.search(names(spark, d), "RE", "target", "name")


@query(f"WITH {_NAMES} SELECT target, name, row_number() OVER (ORDER BY target) AS position FROM nm QUALIFY position > 50 AND position <= 100")
def catalogue_page(spark, d):
    return explore.catalogue_page(names(spark, d), "target", 1, 50).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_NAMES} SELECT target, name FROM nm WHERE name = (SELECT name FROM nm WHERE target = 5) ORDER BY target LIMIT 1")
def lookup_name(spark, d):
    name = names(spark, d).where("target = 5").first()["name"]
    return explore.lookup(names(spark, d), name, "target", "name")


@query(_BASE + ", k AS (SELECT dataset, target, count, 'dataset' AS kind FROM mat UNION ALL SELECT -1, target, sum(count), 'global' FROM mat GROUP BY target) SELECT dataset, count(*) AS cells, CAST(sum(count) AS BIGINT) AS total FROM k WHERE kind = 'dataset' AND dataset IN (1, 2, -1) GROUP BY dataset")
def real_scope(spark, d):
    m = matrix(spark, d).withColumn("kind", F.lit("dataset"))
    both = m.unionByName(quantify.global_sum(m, "target").select(F.lit(-1).cast("long").alias("dataset"), "target", "count", F.lit("global").alias("kind")))
    chosen = spark.createDataFrame([(1,), (2,), (-1,)], "dataset long")
    return explore.real_datasets(both, "kind", chosen).groupBy("dataset").agg(F.count("*").alias("cells"), F.sum("count").alias("total"))


@query(_BASE + ", v AS (SELECT dataset, CAST(18446744073709551615 AS DECIMAL(38,0)) - count AS v FROM mat), r AS (SELECT dataset, v, row_number() OVER (PARTITION BY dataset ORDER BY v) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM v) SELECT dataset, CAST((sum(v) FILTER (r = (n + 1) // 2) + sum(v) FILTER (r = n // 2 + 1)) AS DECIMAL(38,0)) AS twice_median, CAST(sum(v) AS DECIMAL(38,0)) AS total FROM r GROUP BY dataset")
def exact_medians(spark, d):
    """Medians of values near 2^64, which a DOUBLE can't hold."""
    v = matrix(spark, d).select("dataset", (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("count")).cast("decimal(20,0)").alias("v"))
    return explore.summarise(v, ["dataset"], "v").select("dataset", (F.col("median") * 2).cast("decimal(38,0)").alias("twice_median"), "total")


@query(_BASE + "SELECT dataset, CAST(sum(n) AS BIGINT) AS windows FROM (SELECT dataset, ck, sum(n) AS n FROM (SELECT dataset, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS ck, n FROM (SELECT dataset, n, substr(seq, CAST(i AS INTEGER), 15) AS w FROM same, range(1, 51) r(i))) GROUP BY dataset, ck) JOIN own USING (ck) WHERE owner IS NOT NULL GROUP BY dataset")
def assigned_kmers(spark, d):
    from .catalogue import owner_table_of

    got = quantify.dataset_metrics(reads(spark, d), "dataset", "seq", "w", K, owner_table_of(spark, d))
    return got.select("dataset", F.col("assigned_kmers").alias("windows"))


@query(_BASE + "SELECT CAST(sum(total) * 1000000 AS DECIMAL(38,0)) AS numerator, 1000000::INTEGER AS scale FROM tot")
def pooled_total(spark, d):
    got = quantify.dataset_metrics(reads(spark, d), "dataset", "seq", "w", K)
    return quantify.pooled_total(got, F.lit(1))


@query(_BASE + "SELECT dataset, target, count, total FROM mat JOIN tot USING (dataset) WHERE dataset <> 4")
def keep_going(spark, d):
    """Dataset 4 has a header without an abundance: it contributes nothing, the others are whole."""
    heads = reads(spark, d).select("dataset", F.when(F.col("dataset") == 4, "u1").otherwise("u1 ka:f:1.5").alias("header"))
    bad = quantify.failures(heads, "dataset", "header", F.lit(64), K, "unitigs")
    left, _ = quantify.keep_going(reads(spark, d).select("dataset").distinct(), bad, "dataset")
    totals = quantify.dataset_metrics(reads(spark, d), "dataset", "seq", "w", K).select("dataset", F.col("weighted_kmers").alias("total"))
    return matrix(spark, d).join(left, "dataset").join(totals, "dataset")


@query(_BASE + _BASE[:0] + ", g AS (SELECT target, sum(count) AS count FROM mat GROUP BY target), pool AS (SELECT sum(total)::DOUBLE AS total FROM tot) SELECT target, round(count::DOUBLE / total * 1e6, 6) AS value FROM g, pool")
def norm_global(spark, d):
    """The global vector over the pooled total."""
    pool = quantify.pooled_total(quantify.dataset_metrics(reads(spark, d), "dataset", "seq", "w", K), F.lit(1)).select((F.col("numerator") / F.col("scale")).cast("double").alias("total"))
    rows = quantify.global_sum(matrix(spark, d), "target").crossJoin(F.broadcast(pool))
    return quantify.normalise(rows, "cpm").select("target", F.round("value", 6).alias("value"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey::HUGEINT * l_partkey * CAST(pow(10, 2 * l_linenumber - 4) AS HUGEINT) AS v FROM lineitem WHERE l_linenumber > 1
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey % 1200)::HUGEINT FROM lineitem WHERE l_linenumber = 1),
d AS (SELECT *, length(v::VARCHAR) AS d, CAST(pow(10, greatest(length(v::VARCHAR) - 3, 0)) AS HUGEINT) AS unit FROM n),
f AS (SELECT *, (v * 2 + unit) // (unit * 2) AS f FROM d WHERE d > 2 UNION ALL SELECT *, v * CAST(pow(10, 3 - d) AS HUGEINT) FROM d WHERE d <= 2),
e AS (SELECT *, lpad(CASE WHEN f >= 1000 THEN '100' ELSE f::VARCHAR END, 3, '0') AS x, d - 1 + CASE WHEN f >= 1000 THEN 1 ELSE 0 END AS e, least(4, (d - 1 + CASE WHEN f >= 1000 THEN 1 ELSE 0 END) // 3) AS g FROM f)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN v < 1000 THEN v::VARCHAR WHEN e - 3 * g + 1 >= 3 THEN format('{:,}', CAST(x || repeat('0', e - 3 * g - 2) AS BIGINT)) || ['', 'K', 'M', 'G', 'T'][g + 1]
    ELSE x[1 : e - 3 * g + 1] || '.' || x[e - 3 * g + 2 :] || ['', 'K', 'M', 'G', 'T'][g + 1] END AS short, x[1] || '.' || x[2:] || 'e+' || e AS scientific FROM e""")
def short_numbers(spark, d):
    """Numbers of 1 to 24 digits as the viewer shows them."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    ten = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(F.col("l_linenumber") * 2 - 4, F.lit(0)).cast("int"))).cast("decimal(11,0)")
    large = (F.col("l_orderkey").cast("decimal(13,0)") * F.col("l_partkey").cast("decimal(13,0)") * ten).cast("decimal(38,0)")
    v = F.when(F.col("l_linenumber") == 1, (F.col("l_orderkey") % 1200).cast("decimal(38,0)")).otherwise(large)
    return li.select("*", fn.short_number(v).alias("short"), fn.scientific(v).alias("scientific"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p IS NULL THEN '–' WHEN p > 0 AND p < 0.01 THEN printf('%.2e%%', p) ELSE printf('%.2f%%', p) END AS share FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_discount / (3 * power(100, l_linenumber - 1)) * 100 END AS p FROM lineitem)")
def percent_texts(spark, d):
    """Shares of all sizes, and missing ones, as text."""
    share = F.when(F.col("l_linenumber") < 7, F.col("l_discount") / (3 * F.pow(F.lit(100.0), F.col("l_linenumber") - 1)))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.percentage(share).alias("share"))


@query("SELECT doc_id, '\"' || replace(coalesce(text, ''), '\"', '\"\"') || '\"' AS cell, regexp_extract(text, '^\\s*(\\S+)', 1) AS first FROM documents")
def text_cells(spark, d):
    """Whole texts as quoted cells, and their first words, as of headers."""
    return _t(spark, d, "documents").select("doc_id", fn.csv_cell(F.col("text")).alias("cell"), fn.first_token(F.col("text")).alias("first"))


@query("SELECT l_orderkey, l_linenumber, (m // 1000000) || CASE WHEN m % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((m % 1000000)::VARCHAR, 6, '0'), '0') END AS text FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) * l_orderkey * 1250 AS m FROM lineitem)")
def decimal_texts(spark, d):
    micro = F.col("l_partkey").cast("long") * F.col("l_orderkey") * 1250
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.decimal_text(micro).alias("text"))


@query(_BASE + "SELECT count(*) AS datasets, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 0) AS nonzero, round(avg(count::DOUBLE), 6) AS mean, round(stddev_pop(count::DOUBLE), 6) AS stddev, round(quantile_cont(count, 0.5), 6) AS median, round(quantile_cont(count, 0.9), 6) AS p90 FROM mat WHERE target = 7")
def focus_summary(spark, d):
    """How one target is spread over its datasets."""
    got = explore.focus_summary(matrix(spark, d), "target", 7, percentiles=(90,))
    return got.select("datasets", F.col("total").cast("long").alias("total"), "nonzero", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("mean", "stddev", "median", "p90")))


@query(_BASE + "SELECT dataset, count FROM mat WHERE target = 7 ORDER BY count DESC, dataset LIMIT 4 OFFSET 4")
def focus_page(spark, d):
    """The second page of four of one target's datasets, the largest first."""
    rows = matrix(spark, d).where("target = 7").withColumn("value", F.col("count").cast("double"))
    return explore.focus_page(explore.target_focus(rows, "target", "dataset", 7), "dataset", 1, 4).select("dataset", "count")


@query(_BASE + "SELECT dataset, 'sample_' || dataset AS name FROM (SELECT DISTINCT dataset FROM rd) WHERE dataset IN (3, 8)")
def lookup_dataset(spark, d):
    """Datasets by exact name, and by position."""
    table = reads(spark, d).select("dataset").distinct().select("dataset", F.concat(F.lit("sample_"), F.col("dataset").cast("string")).alias("name"))
    return explore.lookup(table, "sample_3", "dataset", "name").unionByName(explore.lookup(table, "#8", "dataset", "name"))
