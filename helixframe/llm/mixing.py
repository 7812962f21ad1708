"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the number of copies each of its documents should get.  The whole part is
certain; the rest is the inclusion probability p of one more copy.  Documents are ranked by u/(1-u) divided by p/(1-p)
(u: a fixed hash of the document as a uniform number) and are taken in that order until the source's remaining words
are reached, which fixes the size of the sample.  No source's rows meet in one task: ranks fall into `bins` bins whose
sizes are summed by source, and only rows of the bin where a source's target is crossed are ranked one by one.

Defined results: a null text has size 0; a null source is a source, last in order; a null document id is hashed by
its text, so equal ones go together; documents of equal rank (repeated ids) are all taken or all left; a source whose
words are all 0 has target 0; texts are counted whole; an empty table gives an empty result; extra columns pass through, and
if one has the result's name, the result gets the next free one (`mix_`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACED, cut, free_name, small


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def uniform(key: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of an MD5 that any engine can repeat."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): `share` of all words dealt by the repeating weights in the order of sources, each at most
    `most` times its size and the excess dealt again.  One aggregate over the table of sources a round."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    at = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int"))
    table = cut(sizes.select("source", "source_size", w.cast("double").alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        capped, weight, n = table.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        new = (total - capped) / weight if weight else level
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11, bins: int = 4096, out: str = "mix") -> DataFrame:
    """docs with the struct column `out`: size, source_size, target, copies, taken (copies times size)."""
    size, u = word_count(F.col(text)), uniform(F.col(key), F.col(text), seed)
    base = cut(docs.select(F.col(source).alias("source"), size.alias("size"), u.alias("u")))
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut(
        targets(sums, weights, share, most)
        .withColumn("each", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))
        .withColumn("whole", F.floor("each"))
        .withColumn("p", F.col("each") - F.col("whole"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    rows = plan.count()

    def with_plan(df: DataFrame, name: str, plan: DataFrame) -> DataFrame:
        s = free_name(df, "_source")
        return df.join(small(plan.withColumnRenamed("source", s), rows), F.col(name).eqNullSafe(F.col(s)), "left").drop(s)

    odds = lambda u, p: F.try_divide(u / (1 - u), p / (1 - p))
    rank = F.when(F.col("p") > 0, odds(F.col("u"), F.col("p")))
    ranked = with_plan(base, "source", plan.select("source", "p", "rest")).where("p > 0 and rest > 0 and size > 0").withColumn("rank", rank)
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins))
    upto = Window.partitionBy("source").orderBy("bin")
    summed = ranked.groupBy("source", "bin", "rest").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(upto) - F.col("words"))
    crossing = summed.where("before <= rest and before + words > rest").groupBy("source").agg(F.max_by(F.struct("bin", "before"), "bin").alias("x")).select("source", "x.bin", "x.before")
    hard = with_plan(ranked, "source", crossing.select("source", F.col("bin").alias("_bin"), "before")).where("bin = _bin")
    ties = hard.groupBy("source", "rank", "before", "rest").agg(F.sum("size").alias("words"))
    along = ties.withColumn("mid", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("rank")) - F.col("words") / 2)
    # the last rank whose words bring the sum nearer to the target; below the crossing bin everything is taken
    last = along.groupBy("source").agg(F.max(F.when(F.col("mid") <= F.col("rest"), F.col("rank"))).alias("limit"))
    edge = crossing.select("source", "bin").join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    full = cut(with_plan(plan, "source", edge).select("source", "source_size", "target", "whole", "p", "rest", "bin", "limit"))
    inner = free_name(docs, "_plan")
    got = with_plan(docs, source, full.select("source", F.struct(*[c for c in full.columns if c != "source"]).alias(inner)))
    x = F.col(inner)
    r = odds(u, x["p"])
    more = F.when((x["p"] <= 0) | (x["rest"] <= 0), False).when(x["bin"].isNull(), True).otherwise((F.floor(r / (1 + r) * bins) < x["bin"]) | F.coalesce(r <= x["limit"], F.lit(False)))
    copies = x["whole"] + F.when(more, 1).otherwise(0)
    return got.select(*docs.columns, F.struct(size.alias("size"), x["source_size"].alias("source_size"), x["target"].alias("target"), copies.cast("long").alias("copies"), (copies * size).cast("long").alias("taken")).alias(free_name(docs, out)))
