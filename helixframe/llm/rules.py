"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets counts (`measure`) and, from them, whole-number metrics: characters in a hundred words, and symbols, marks,
repeated words (for a thousand words) and repeated lines (for a thousand lines).  Quantiles of each metric in each language
and source come from sketches: counts of logarithmic buckets, exact below 64 and with 32 buckets an octave above, so a
value is known to within 1/32.  Sketches merge by adding counts, in any order, so a group's tasks, groups of a language
and languages of the corpus all merge the same way, and a lost task that is run again changes nothing.  A sketch has some
2,000 rows at most whatever its group holds, and a group of a third of all rows is summed before it is shuffled.

A group's fences stand beside its quartiles, by `spread` times the distance between them and at least `slack`.  Groups of
fewer than `least` documents take the fences of their language, and languages of fewer those of the corpus.  Documents are
then joined with their group's fences.

Defined results: a null text is empty and has no words; a text without words, with fewer than `min_words`, or with more than
`most_repeats` percent of its words in repeated windows fails the base rules, and is in no sketch; null languages and
sources are groups of their own; lines that are equal to an earlier one count whatever their length; texts are read
whole; repeated rows count each; an empty table gives an empty result; extra columns pass through, and a struct takes the
name asked for, so none of its fields can clash.  Windows are compared by 64-bit hashes of three words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACED, cut, forget, free_name, small

#: White space of the word rule.
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Metric:
    """A whole number made of counts, what is too much of it, and whether there can be too little."""

    name: str
    of: str
    per: str
    times: int
    slack: int
    low: bool = False

    def value(self, counts: Column) -> Column:
        return F.call_function("div", counts[self.of] * self.times, F.greatest(counts[self.per], F.lit(1)))


#: Slacks: 2 characters a word; 150 symbols or 100 marks for a thousand words; 500 of a thousand lines or 450 of a thousand words repeated.
METRICS = (
    Metric("word_length", "word_chars", "n_words", 100, 200, low=True),
    Metric("symbols", "n_symbols", "n_words", 1000, 150),
    Metric("marks", "n_marks", "n_words", 1000, 100),
    Metric("dup_lines", "n_dup_lines", "n_lines", 1000, 500),
    Metric("repeats", "n_repeat_words", "n_words", 1000, 450),
)


def measure(docs: DataFrame, text: str, out: str = "counts", window: int = 3) -> DataFrame:
    """docs with the struct column `out`: n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words."""
    given, t = docs.columns, F.coalesce(F.col(text), F.lit(""))
    w, lines, h, s = (free_name(docs, f"_{x}") for x in ("words", "lines", "hashes", "sorted"))
    got = docs.withColumn(w, F.regexp_extract_all(t, F.lit(SPACED), F.lit(0)))
    got = got.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    n = F.size(w)
    # each step uses the one before more than once, so that Spark keeps it as a column of its own
    rows = F.arrays_zip(*(F.slice(F.col(w), F.lit(i + 1), F.greatest(n - (window - 1), F.lit(0))) for i in range(window)))
    got = got.withColumn(h, F.transform(rows, lambda x: F.xxhash64(*(x[str(i)] for i in range(window)))))
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    got = got.withColumn(s, F.when(repeated, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))))
    beside = F.arrays_zip(F.slice(F.col(s), F.lit(1), F.size(s) - 1), F.slice(F.col(s), F.lit(2), F.size(s) - 1))
    twins = F.filter(beside, lambda x: x["0"]["h"] == x["1"]["h"])
    places = F.flatten(F.transform(twins, lambda x: F.array(*(x[side]["at"] + i for side in ("0", "1") for i in range(window)))))
    covered = F.when(F.col(s).isNull(), 0).otherwise(F.size(F.array_distinct(places)))
    counts = {
        "n_words": n, "word_chars": F.length(F.array_join(w, "")), "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")), "n_marks": F.regexp_count(t, F.lit("[!?]")),
        "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": covered,
    }
    return got.select(*given, F.struct(*(c.cast("long").alias(k) for k, c in counts.items())).alias(out))


def base_failed(counts: Column, min_words: int = 50, most_repeats: int = 50) -> Column:
    return (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > most_repeats * counts["n_words"])


def bucket(v: Column) -> Column:
    """The bucket of a whole number from 0 on: itself below 64, then 32 for each power of two."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(32 * shift + F.call_function("shiftright", v, shift)).cast("long")


def low_end(b: Column) -> Column:
    """The least number of a bucket."""
    shift = F.call_function("div", b, F.lit(32)) - 1
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - 32 * shift, shift.cast("int"))).cast("long")


def sketch(measured: DataFrame, counts: str, by: tuple[str, str], metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(lang, source, metric, bucket, n) of the rows of `measured`: one sketch for each group and metric."""
    each = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), bucket(m.value(F.col(counts))).alias("bucket")) for m in metrics)))
    rows = measured.select(F.col(by[0]).alias("lang"), F.col(by[1]).alias("source"), each.alias("x")).select("lang", "source", "x.*")
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: tuple[str, ...], permille: tuple[int, ...]) -> DataFrame:
    """(by, metric, total, q<permille>): the least bucket that has so many of a thousand rows below its end."""
    group = Window.partitionBy(*by, "metric")
    upto = sketches.withColumn("_upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("_all", F.sum("n").over(group))
    ends = [F.min(F.when(1000 * F.col("_upto") >= q * F.col("_all"), F.col("bucket"))).alias(f"q{q}") for q in permille]
    return upto.groupBy(*by, "metric").agg(F.first("_all").alias("total"), *ends)


def fences(sketches: DataFrame, by: tuple[str, ...], spread: int = 3, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(by, total, fences): in the order of metrics, structs (low, high) of what is allowed."""
    q = quantiles(sketches, by, (250, 750))
    low, high = low_end(F.col("q250")), low_end(F.col("q750") + 1) - 1
    slack = reduce(lambda c, m: c.when(F.col("metric") == m.name, m.slack), metrics[1:], F.when(F.col("metric") == metrics[0].name, metrics[0].slack))
    room = F.greatest(spread * (high - low), slack)
    wide = q.withColumn("_low", low - room).withColumn("_high", high + room).groupBy(*by)
    pick = lambda c, m: F.max(F.when(F.col("metric") == m.name, F.col(c)))
    pairs = [F.struct((pick("_low", m) if m.low else F.lit(None).cast("long")).alias("low"), pick("_high", m).alias("high")) for m in metrics]
    return wide.agg(F.max("total").alias("total"), F.array(*pairs).alias("fences"))


def thresholds(sketches: DataFrame, least: int = 100, spread: int = 3, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """(lang, source, fences) of each group of the sketches: its own fences, else its language's, else the corpus's."""
    own = fences(sketches, ("lang", "source"), spread, metrics)
    tongue = fences(merge(sketches, ("lang",)), ("lang",), spread, metrics).select(F.col("lang").alias("_l"), F.col("total").alias("_n"), F.col("fences").alias("_f"))
    world = fences(merge(sketches, ()), (), spread, metrics).select(F.col("fences").alias("_w"))
    got = own.join(tongue, F.col("lang").eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(world))  # one row
    return got.select("lang", "source", F.when(F.col("total") >= least, F.col("fences")).when(F.col("_n") >= least, F.col("_f")).otherwise(F.col("_w")).alias("fences"))


def judge(measured: DataFrame, counts: str, by: tuple[str, str], out: str = "rules", min_words: int = 50, most_repeats: int = 50, least: int = 100, spread: int = 3, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    """measured with the struct column `out`: base_failed, kept, and broken, the metrics that are beyond a fence.

    `measured` is read twice, for the sketches and for the join: give it what `measure` made as a written table.
    """
    failed = base_failed(F.col(counts), min_words, most_repeats)
    sketches = cut(sketch(measured.where(~failed), counts, by, metrics))
    table = cut(thresholds(sketches, least, spread, metrics))
    forget(sketches)
    lang, source, found = (free_name(measured, f"_{x}") for x in ("lang", "source", "fences"))
    right = table.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("fences").alias(found))
    same = F.col(by[0]).eqNullSafe(F.col(lang)) & F.col(by[1]).eqNullSafe(F.col(source))
    joined = measured.join(small(right, table.count()), same, "left")
    tests = []
    for i, m in enumerate(metrics):
        v, fence = m.value(F.col(counts)), F.col(found)[i]
        over = (v > fence["high"]) | (v < fence["low"]) if m.low else v > fence["high"]
        tests.append(F.when(over, F.lit(m.name)))
    broken = F.when(failed, F.array().cast("array<string>")).otherwise(F.filter(F.array(*tests), lambda x: x.isNotNull()))
    verdict = F.struct(failed.alias("base_failed"), (~failed & (F.size(broken) == 0)).alias("kept"), broken.alias("broken"))
    return joined.select(*measured.columns, verdict.alias(out))
