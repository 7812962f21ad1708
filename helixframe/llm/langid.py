"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters, hashed into a fixed number of buckets, per language.  The matrix of
log probabilities is broadcast sparse: a bucket's row holds only the languages that were seen with it, as what they add to
the log probability of an unseen bucket, so its size is bounded by the n-grams of the training sample (`max_rows` texts)
whatever the number of languages.  Scoring is a product of two sparse matrices in numpy: a batch of texts becomes
(text, bucket, count) entries by one sort, and each meets its bucket's row.  One pass, no shuffle but the counts.

Defined results: a text that is null or has no letter (str.isalpha of a character; numerals and marks are none) is `und`
with score 0; so is every text if there was nothing to learn from; ties go to the language that sorts first; long texts
are read whole, in chunks; repeated rows get the same result; an empty table gives an empty result; extra columns pass
through, and if one has the result's name, the result gets the next free one (`language_`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, bounded_sample, bytes_of, pieces

UND = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
CHUNK = 1 << 18
#: Characters that are scored at once; each takes over a hundred bytes in arrays, and a worker that stays keeps some of them.
BLOCK = 1 << 15
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; what is no letter is a space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[code], code, 32).astype(np.uint64)


def _grams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed 1-, 2- and 3-grams that start at each place."""
    one = code * _K[0]
    two = one[:-1] * _K[1] + code[1:] + np.uint64(1)
    three = two[:-1] * _K[2] + code[2:] + np.uint64(2)
    return one, two, three


def _buckets(grams: np.ndarray, bits: int) -> np.ndarray:
    mixed = grams * _K[0]
    return ((mixed ^ (mixed >> np.uint64(29))) * _K[1] >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(text: str, bits: int, chunk: int = CHUNK) -> np.ndarray:
    """How often each bucket is hit by the grams of one text of any length; runs of anything but letters are one space."""
    counts, tail = np.zeros(1 << bits, dtype=np.int64), np.array([32], dtype=np.uint64)
    for at in range(0, len(text), chunk):
        code = np.concatenate([tail[-2:], _codes(text[at : at + chunk]), [np.uint64(32)] if at + chunk >= len(text) else []]).astype(np.uint64)
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = code[keep]
        fresh = min(len(tail), 2)  # what the previous chunk has counted
        for grams, seen in zip(_grams(code), (fresh, fresh - 1, fresh - 2), strict=True):
            counts += np.bincount(_buckets(grams[max(0, seen) :], bits), minlength=1 << bits)
        tail = code[-2:]
    return counts


def sparse_counts(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, bucket, count) of the grams of many texts, sorted by the first two; equal to gram_counts of each."""
    parts = [np.concatenate([[np.uint64(32)], _codes(t), [np.uint64(32)]]) for t in texts]
    code, owner = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)]), np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    if len(code) < 3:
        return (np.zeros(0, dtype=np.int64),) * 3
    first = np.append(True, owner[1:] != owner[:-1])  # the space before a text is no gram of its own
    keys = []
    for back, (grams, ok) in enumerate(zip(_grams(code), (~first, owner[1:] == owner[:-1], owner[2:] == owner[:-2]), strict=True)):
        keys.append((owner[: len(code) - back][ok] << bits) | _buckets(grams[ok], bits))
    key = np.sort(np.concatenate(keys))
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts] >> bits, key[starts] & ((1 << bits) - 1), np.diff(np.append(starts, len(key)))


def blocks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """Texts with their places, about `most` characters at a time; a longer text is alone."""
    at, some, size = [], [], 0
    for i, t in enumerate(texts):
        if t:
            if some and size + len(t) > most:
                yield at, some
                at, some, size = [], [], 0
            at.append(i)
            some.append(t)
            size += len(t)
    if some:
        yield at, some


def entries(some: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(some) == 1 and len(some[0]) > CHUNK:
        counts = gram_counts(some[0], bits)
        hit = np.flatnonzero(counts)
        return np.zeros(len(hit), dtype=np.int64), hit, counts[hit]
    return sparse_counts(some, bits)


@dataclass(frozen=True)
class LanguageModel:
    """Row b of the matrix is entries starts[b] to starts[b + 1] of (column, gain); unseen is what any bucket has at least."""

    languages: tuple[str, ...]
    starts: np.ndarray
    column: np.ndarray
    gain: np.ndarray
    unseen: np.ndarray
    prior: np.ndarray
    bits: int

    def totals(self, some: list[str], most: int = 1 << 22) -> np.ndarray:
        """Log probabilities, texts x languages."""
        many = len(self.languages)
        doc, bucket, count = entries(some, self.bits)
        out = np.outer(np.bincount(doc, count, len(some)), self.unseen) + self.prior
        width = self.starts[bucket + 1] - self.starts[bucket]
        for part in np.split(np.arange(len(doc)), np.searchsorted(np.cumsum(width), np.arange(most, width.sum(), most))):
            w = width[part]
            at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(self.starts[bucket[part]], w)
            cell = np.repeat(doc[part] * many, w) + self.column[at]
            out += np.bincount(cell, np.repeat(count[part], w) * self.gain[at], len(some) * many).reshape(out.shape)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        got = [(UND, 0.0)] * len(texts)
        if self.languages:
            for at, some in blocks([t if t and any(map(str.isalpha, t)) else None for t in texts], BLOCK):
                total = self.totals(some)
                best = total.argmax(axis=1)
                top = total[np.arange(len(some)), best]
                score = 1 / np.exp(np.clip(total - top[:, None], -700, 0)).sum(axis=1)
                for i, b, s in zip(at, best.tolist(), score.tolist(), strict=True):
                    got[i] = (self.languages[b], s)
        return got


def train(df: DataFrame, text: str, lang: str, key: Column, bits: int = 14, max_rows: int = 20_000, smooth: float = 0.1) -> LanguageModel:
    """Learn from the rows of df whose text and lang are not null: all of them, or `max_rows`, chosen by a hash of
    `key`, text and language.

    Every language among these rows is learned.
    """
    rows = bounded_sample(df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()), [key, F.col(text), F.col(lang)], max_rows).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches):
        for whole in batches:
            for batch in pieces(whole, 0, 1 << 20):
                texts, names = [raw.decode("utf-8", "replace") for raw in bytes_of(batch.column(0))], batch.column(1).to_pylist()
                langs, which = np.unique(np.array(names, dtype=object), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs.tolist(), pa.string()), pa.array(np.full(len(langs), -1)), pa.array(np.bincount(which, minlength=len(langs)))], names=["lang", "bucket", "n"])
                for at, some in blocks(texts):
                    doc, bucket, n = entries(some, bits)
                    own = which[np.array(at)][doc]
                    cell, inverse = np.unique((own << bits) | bucket, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(langs[cell >> bits].tolist(), pa.string()), pa.array(cell & ((1 << bits) - 1)), pa.array(np.bincount(inverse, n, len(cell)).astype(np.int64))], names=["lang", "bucket", "n"])

    # at most as many rows as the sample has n-grams, whatever the corpus
    table = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    docs = table[table["bucket"] < 0].set_index("lang")["n"].to_dict()
    languages = tuple(sorted(docs))
    table = table[table["bucket"] >= 0]
    number = {x: i for i, x in enumerate(languages)}
    column = np.array([number[x] for x in table["lang"]], dtype=np.int64)
    bucket, n = table["bucket"].to_numpy(dtype=np.int64), table["n"].to_numpy(dtype=float)
    order = np.lexsort((column, bucket))
    total = np.bincount(column, n, len(languages)) + smooth * (1 << bits)
    prior = np.log(np.array([docs[x] for x in languages], dtype=float) / max(1, sum(docs.values())))
    starts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    return LanguageModel(languages, starts, column[order], np.log(n[order] / smooth + 1), np.log(smooth / total), prior, bits)


def predict(df: DataFrame, text: str, model: LanguageModel, out: str = "language") -> DataFrame:
    """df with the struct column `out` (lang_pred, score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: m.predict([x.decode("utf-8", "replace") if x is not None else None for x in texts])

    return annotate(df, text, out, RESULT, make)
