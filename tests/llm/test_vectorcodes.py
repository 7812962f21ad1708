"""op13: sizes, odd vectors and odd tables against plain loops in Python's integers; the query's SQL is in test_operators."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from helixframe.llm import vectorcodes


def plain(rows, parts, entries, rounds, scale):
    """{row number: (code, error)} and the codebooks' digest; rows: (id, vector) that are usable and of one length."""
    q = [[math.floor(scale * Fraction(x)) for x in v] for _, v in rows]
    width = len(q[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in q]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][1])))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    out = {}
    for k, c in enumerate(cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out[k] = "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("kind,n,parts,entries", [("normal", 300, 4, 16), ("few", 5, 2, 64), ("ties", 200, 4, 8), ("large", 60, 2, 8), ("huge", 30, 2, 4)])
def test_against_plain_loops(spark, kind, n, parts, entries):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 8))
    if kind == "ties":
        x = np.round(x)
        x[:, 0] = -0.001
    x *= {"large": 1e9, "huge": 1e307}.get(kind, 1)
    rows = [(i // 2 if kind == "ties" else i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist())]
    bad = [(-5, None), (-4, []), (-3, [float("nan")] * 8), (-2, [1.0] * 7 + [None]), (-1, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(k, v, i, "x") for i, (k, v) in enumerate(rows + bad)], "vec_id long, embedding array<double>, place int, code string").repartition(5)
    got, book = vectorcodes.compress(df, "vec_id", "embedding", parts=parts, entries=entries)
    want, digest = plain(rows, parts, entries, 2, 256)
    found = {r.place: (r.coded.code, r.coded.error) for r in got.collect()}
    assert found == {k: (c, e if e < 1 << 63 else None) for k, (c, e) in want.items()} and vectorcodes.digest(book) == digest
    assert got.columns == ["vec_id", "embedding", "place", "code", "coded"]


def test_other_lengths_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0]), (2, [1.0] * 4), (3, [0.5, 2.0])], "vec_id long, embedding array<float>")
    got, book = vectorcodes.compress(df, "vec_id", "embedding", parts=2)
    assert {r.vec_id: r.coded.code for r in got.collect()} == {0: None, 1: "0000", 2: None, 3: "0101"} and book.shape == (2, 2, 1) or book[1, 0, 0] == book[1, 1, 0]
    for none in (df.where("false"), df.where("vec_id = 0")):
        got, book = vectorcodes.compress(none, "vec_id", "embedding", parts=2)
        assert [r.coded.code for r in got.collect()] in ([], [None]) and book.size == 0
    whole_numbers = spark.createDataFrame([(0, [1, 2]), (1, [3, -4])], "vec_id long, embedding array<int>")
    assert {r.vec_id: tuple(r.coded) for r in vectorcodes.compress(whole_numbers, "vec_id", "embedding", parts=2)[0].collect()} == {0: ("0000", 0), 1: ("0101", 0)}
    with pytest.raises(ValueError, match="256"):
        vectorcodes.compress(df, "vec_id", "embedding", entries=300)
