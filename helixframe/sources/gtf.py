"""Exon rows of GTF annotations, with quoted, escaped and repeated attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_lines

#: One attribute where the last one ended: key, then a quoted value (with escapes) or a bare one.
_VALUE = r'(?:"((?:[^"\\]++|\\.)*+)"|([^";\s][^;\s]*+))'
ATTRIBUTE = r"\G\s*+([^\s]++)\s++" + _VALUE + r"\s*+(?:;|$)"
ALL = r"^(?:\s*+[^\s]++\s++" + _VALUE + r"\s*+(?:;|$))*+\s*+$"


def attributes(text: Column) -> Column:
    """(key, value) pairs in order; `.` alone has none; a broken list, or an empty value, raises."""
    part = lambda k: F.regexp_extract_all(text, F.lit(ATTRIBUTE), k)
    quoted = F.regexp_replace
    pairs = F.transform(F.arrays_zip(part(1).alias("k"), part(2).alias("q"), part(3).alias("b")), lambda x: F.struct(x["k"].alias("key"), F.when(x["b"] != "", x["b"]).otherwise(quoted(x["q"], r"(?s)\\(.)", "$1")).alias("value")))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return F.when(F.trim(text).isin(".", ""), empty).when(text.rlike(ALL) & ~F.exists(pairs, lambda p: p["value"] == ""), pairs).otherwise(F.raise_error(F.concat(F.lit("bad attributes: "), text)).cast("array<struct<key:string,value:string>>"))


def attribute(text: Column, key: str) -> Column:
    """The distinct values of a key, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(attributes(text), lambda p: p["key"] == key), lambda p: p["value"])))


def read_exons(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """contig, start, end, strand, exon_ids, gene_ids, transcript_ids; a bad exon row raises, with its line."""
    lines = read_lines(spark, [path] if isinstance(path, str) else path).where(~F.col("text").rlike(r"^\s*(#.*)?$"))
    c = F.split("text", "\t")
    rows = lines.select(c.alias("c"), "line").where((F.size("c") != 9) | (F.try_element_at("c", F.lit(3)) == "exon"))
    start, end = F.try_element_at("c", F.lit(4)).try_cast("long"), F.try_element_at("c", F.lit(5)).try_cast("long")
    good = (F.size("c") == 9) & (start > 0) & (end >= start) & F.try_element_at("c", F.lit(7)).isin("+", "-") & (F.trim(F.try_element_at("c", F.lit(1))) != "")
    text = F.try_element_at("c", F.lit(9))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("c")[0]).otherwise(F.raise_error(F.concat(F.lit("bad exon row at line "), F.col("line").cast("string"), F.lit(": "), F.array_join("c", " "))))
    rows = rows.select(checked.alias("contig"), start.alias("start"), end.alias("end"), F.try_element_at("c", F.lit(7)).alias("strand"), attributes(text).alias("x"))
    of = lambda key: F.array_sort(F.array_distinct(F.transform(F.filter("x", lambda p: p["key"] == key), lambda p: p["value"])))
    return rows.select("contig", "start", "end", "strand", *(of(f"{k}_id").alias(f"{k}_ids") for k in ("exon", "gene", "transcript")))
