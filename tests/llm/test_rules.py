"""op11: counts and thresholds against plain Python on odd texts; the query's SQL is in test_operators."""

import math
import re

import pytest

from helixframe.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    trios = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(trios) if trios.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[!?]", t)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_counts_against_plain_code(spark):
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "a\na\n\n \n a\na", "é ß\x0b日本 😀 z y", "# * $ % & | < > ! ?", "ab c\na bc\nab c", "a b c d\r\na b c d\r\n", "w " * 500, "the end is near, the end is here. " * 30 + "unique words follow now"]
    df = spark.createDataFrame([(i, t, "q", 3) for i, t in enumerate(texts)], "doc_id int, text string, counts_ string, _words int")
    got = rules.measure(df, "text").collect()
    assert {r.doc_id: tuple(r.counts) for r in got} == {i: plain(t) for i, t in enumerate(texts)}
    long = spark.createDataFrame([(1, "The End of the Story. " * 50_000)], "doc_id int, text string")
    assert tuple(rules.measure(long, "text").first().counts) == (250_000, 850_000, 0, 0, 1, 0, 250_000)


def test_buckets(spark):
    values = [*range(300), 1000, 4095, 4096, 10**6, 2**40 - 1, 2**40, 2**62]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", rules.bucket(rules.F.col("v")).alias("b")).select("v", "b", rules.low_end(rules.F.col("b")).alias("low"), (rules.low_end(rules.F.col("b") + 1) - 1).alias("high"))
    rows = df.orderBy("v").collect()
    assert all(r.low <= r.v <= r.high and r.high - r.low <= max(0, r.low // 32) for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_sketches_merge_and_thresholds_adapt(spark):
    metric = rules.Metric("length", "word_chars", "n_words", 100, 5, low=True)
    count = lambda words, chars: (words, chars, 0, 0, 1, 0, 0)
    rows = [("en", "a", count(100, 400 + i % 7)) for i in range(120)] + [("en", "b", count(100, 900 + i % 5)) for i in range(110)] + [("en", "c", count(100, 405))] + [(None, None, count(100, 700))] * 3
    rows += [("en", "a", count(100, 900)), ("en", "b", count(100, 400)), ("en", "a", count(10, 40)), ("en", "a", (100, 400, 0, 0, 1, 0, 51))]
    kind = "lang string, source string, counts struct<n_words: long, word_chars: long, n_symbols: long, n_marks: long, n_lines: long, n_dup_lines: long, n_repeat_words: long>, rules int, lang_ int"
    df = spark.createDataFrame([(*r, 1, i) for i, r in enumerate(rows)], kind).repartition(7)
    got = {r.lang_: r.out for r in rules.judge(df, "counts", ("lang", "source"), "out", metrics=(metric,)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(120 + 110 + 1 + 3))  # c follows its language, the null group the corpus
    assert [(got[i].base_failed, got[i].kept, got[i].broken) for i in range(234, 238)] == [(False, False, ["length"])] * 2 + [(True, False, [])] * 2
    # quantiles of merged sketches are those of all rows
    parts = rules.sketch(df.where("lang_ < 234"), "counts", ("lang", "source"), (metric,))
    total = rules.quantiles(rules.merge(parts, ()), (), (250, 500, 750)).first()
    values = sorted(100 * c[1] // c[0] for _, _, c in rows[:234])
    for q in (250, 500, 750):
        low = spark.range(1).select(rules.low_end(rules.F.lit(total[f"q{q}"])).alias("x")).first().x
        true = values[math.ceil(q * len(values) / 1000) - 1]
        assert low <= true <= low + low // 32
    assert total.total == 234


@pytest.mark.parametrize("where", ["false", "lang = 'x'"])
def test_empty_tables(spark, where):
    df = spark.createDataFrame([(1, None, None, None)], "doc_id int, text string, lang string, source string").where(where)
    assert rules.judge(rules.measure(df, "text"), "counts", ("lang", "source")).count() == 0
