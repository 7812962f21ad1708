"""Quality scores by a generalised additive model with pairwise interactions, learned by cyclic boosting.

Features are counted on the bytes of a whole text with numpy; scoring is a sum of table entries by bin.

Defined results: a null or empty text has features of zero and gets the score the tables give it; without labels, or
with labels of one kind, every score is the (smoothed) share of good labels, 0.5 if there are none; labels other than
0 and 1, and labels of an id that disagree, are left out; of documents that repeat an id one is learned from, and every one
is scored; very long texts are read whole; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import AdditiveModel, fit_additive
from .common import annotate, bounded_sample

RESULT = T.StructType([T.StructField("score", T.DoubleType())])
#: Characters whose shares are features of their own.
MARKS = "|!#$%&*+/<=>@[]_{}~\\"
_CLASS = np.zeros(256, dtype=np.uint8)
for _name, _codes in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), (9, 11, 12, 13, 32), (10,), b".,;:?'\"-()"), start=1):
    _CLASS[list(_codes)] = _name


def features(raw: bytes | None) -> list[float]:
    """log length, log words, mean word length, shares of byte classes and marks, lines, repeated lines and words."""
    raw = raw or b""
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 8)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    many = max(1, len(words))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / many, *(kinds[[0, 1, 2, 3, 4, 5, 7]] / n), kinds[2] / max(1.0, kinds[1] + kinds[2]),
        *(counts[[ord(c) for c in MARKS]] / n), np.log1p(len(lines)), len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / many,
    ]


def train(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, usable: Column, max_rows: int = 8_000) -> AdditiveModel:
    """Learn from labelled rows of docs for which `usable` (a condition on docs) holds; beyond `max_rows`, from that many, chosen by a hash of the id."""
    good = labels.where(F.col(label_key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(label_key).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_other")).where("_y = _other").select("_id", "_y")
    ids = docs.where(usable).select(F.col(key).alias("_id")).distinct()
    # the sample is drawn from ids that are both labelled and usable; it is bounded, so it can be broadcast
    few = bounded_sample(good.join(ids, "_id"), [F.col("_id")], max_rows)
    rows = docs.where(usable).select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(few), F.col("_key") == F.col("_id"))
    # one row an id, whatever repeats: the one whose text has the least hash
    rows = rows.select("_key", "_text", "_y", F.xxhash64("_text").alias("_h"))
    got = annotate(rows, "_text", "_x", T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))]), lambda: lambda texts: [(features(t),) for t in texts])
    one = got.groupBy("_key").agg(F.min(F.struct("_h", "_y", F.col("_x.x").alias("x"))).alias("_r"))
    table = one.select("_key", "_r._y", "_r.x").toPandas().sort_values("_key", kind="stable")
    x = np.array(table["x"].tolist(), dtype=float) if len(table) else np.zeros((0, 0))
    return fit_additive(x, table["_y"].to_numpy(dtype=float))


def score(docs: DataFrame, text: str, model: AdditiveModel, out: str = "quality") -> DataFrame:
    """docs with the struct column `out` (score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            if not m.edges:
                return [(0.5 if not m.base else float(1 / (1 + np.exp(-m.base))),) for _ in texts]
            return [(float(s),) for s in m.score(np.array([features(t) for t in texts]))]

        return run

    return annotate(docs, text, out, RESULT, make)
