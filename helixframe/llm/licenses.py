"""License scans: an exact set-similarity join of word windows with templates, beside exact phrases.

A window starts at a word of a template, in any text and across line breaks, and has the template's own number of words times
`den`/`num`, rounded up (room for other words in between).  It matches if it holds at least `num`/`den` of the template's
distinct words, and all of its telling words: those that it has and a template with another label that could be taken for it
has not.  Words are in one global order, rarest in the corpus first (counted over all documents, for the templates' words
only; ties by the word).  With c words needed of a template's w, one of its first w - c + 1 words must be in the window
(prefix), so only templates with such a word in the text are looked at, and only windows around its places, exactly.

Windows of a template that overlap are one place, as good as its best window.  Where places of templates with other labels
overlap, the better one stays: by the share of the template's words, then by their number; equal ones stay both.

Defined results: a null text is empty; a text without words, and an empty table, have no places and no labels; templates have
words (else an error); a template that is found at several places counts once for labels; line breaks do not matter, nor a
text's length; repeated rows get the same result; extra columns pass through, and if one has the result's name, the result
gets the next free one (`license_`).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, annotate, bytes_of, pieces

FOUND = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    + [T.StructField("base", T.ArrayType(T.StringType())), T.StructField("method", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())]
)
#: The phrases asked for, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Customary license lines and notices; a window that holds most of one's words gets its label.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl-3",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "public-domain",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-3",
}
#: Bytes of a table of templates, which every task holds.
MOST_BYTES = 4 << 20


def template_table(table: DataFrame, text: str = "text", label: str = "label") -> dict[str, str]:
    """Templates from a table, such as whole license texts; null texts and labels are left out, more than MOST_BYTES raise."""
    rows = table.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("l"))
    if (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > MOST_BYTES:
        raise ValueError(f"templates have more than {MOST_BYTES} bytes")
    return {r.t: r.l for r in rows.collect()}


@dataclass(frozen=True)
class Place:
    start: int
    end: int
    words: int
    share: float
    label: str


class TemplateIndex:
    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], num: int, den: int):
        self.sets, self.prefix = [], {}
        order = lambda w: (counts.get(w, 0), w)
        bags = [(frozenset(alnum_words(text.encode())), len(alnum_words(text.encode())), label) for text, label in templates.items()]
        for words_of, length, label in bags:
            if not words_of:
                raise ValueError("a template has no words")
            words = sorted(words_of, key=order)
            need = -(-num * len(words) // den)
            for w in words[: len(words) - need + 1]:
                self.prefix.setdefault(w, []).append(len(self.sets))
            # another label's template that holds enough of this one's words could be taken for it
            telling = frozenset().union(*(words_of - other for other, _, name in bags if name != label and len(words_of & other) >= need))
            self.sets.append((words_of, need, -(-den * length // num), telling, label))
        self.heads = frozenset(self.prefix)
        self.shortest = min((s[1] for s in self.sets), default=0)

    def match(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, share of its words in its best window) of each place of a template that no better place overlaps."""
        if len(words) < self.shortest or self.heads.isdisjoint(words):
            return []
        at: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.heads:
                for t in self.prefix[w]:
                    at.setdefault(t, []).append(i)
        places = [p for t, starts in at.items() for p in self.places(words, starts, *self.sets[t])]
        places.sort(key=lambda p: (p.start, p.end))
        out, reach = [], 0
        group: list[Place] = []
        for p in [*places, Place(1 << 62, 0, 0, 0.0, "")]:
            if p.start >= reach:  # nothing before overlaps what follows
                out += [(x.label, x.share) for x in group if not any(y.label != x.label and y.start < x.end and x.start < y.end and (y.share, y.words) > (x.share, x.words) for y in group)]
                group = []
            group.append(p)
            reach = max(reach, p.end)
        return out

    @staticmethod
    def places(words: list[bytes], at: list[int], words_of: frozenset[bytes], need: int, width: int, telling: frozenset[bytes], label: str) -> list[Place]:
        """Where windows of `width` words hold what is needed: overlapping ones together, with the most words of one."""
        found: list[list[int]] = []
        done = 0
        for lead in at:  # windows that hold a place of a word of the prefix
            low, high = max(done, lead - width + 1), min(len(words), lead + width)
            if low >= high:
                continue
            hits = [i for i in range(low, high) if words[i] in words_of]
            seen: dict[bytes, int] = {}
            end = 0
            for k, start in enumerate(hits):
                while end < len(hits) and hits[end] < start + width:
                    seen[words[hits[end]]] = seen.get(words[hits[end]], 0) + 1
                    end += 1
                if len(seen) >= need and all(w in seen for w in telling):
                    if found and start < found[-1][1]:
                        found[-1][1:] = start + width, max(found[-1][2], len(seen))
                    else:
                        found.append([start, start + width, len(seen)])
                w = words[hits[k]]
                seen[w] -= 1
                if not seen[w]:
                    del seen[w]
            done = max(done, lead + 1)
        return [Place(s, e, n, n / len(words_of), label) for s, e, n in found]


def word_counts(docs: DataFrame, text: str, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary occurs in all documents; the result has no more rows than the vocabulary."""
    wanted = sorted(set(vocabulary))

    def run(batches):
        total: Counter = Counter()
        keep = frozenset(wanted)
        for whole in batches:
            for batch in pieces(whole, 0):
                for raw in bytes_of(batch.column(0)):
                    total.update(w for w in alnum_words(raw) if w in keep)
        yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return {bytes(r.word): r.n for r in docs.select(F.col(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def phrase_places(words: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]], starts: frozenset[bytes]) -> tuple[list[int], set[str]]:
    places, labels = [], set()
    if not starts.isdisjoint(words):
        for at, w in enumerate(words):
            if w in starts:
                for phrase, label in phrases:
                    if w == phrase[0] and tuple(words[at : at + len(phrase)]) == phrase:
                        places.append(at)
                        labels.add(label)
    return places, labels


def scan(docs: DataFrame, text: str, phrases: dict[str, str] | None = None, templates: dict[str, str] | DataFrame | None = None, num: int = 4, den: int = 5, out: str = "license") -> DataFrame:
    """docs with the struct column `out`: n_words, n_base (places of phrases), first_word, last_word, base and method labels, score.

    score: 1 if a phrase occurs, else the highest containment among matching windows, else 0.
    """
    templates = TEMPLATES if templates is None else template_table(templates) if isinstance(templates, DataFrame) else templates
    counts = word_counts(docs, text, [w for t in templates for w in alnum_words(t.encode())])
    shared = docs.sparkSession.sparkContext.broadcast((templates, counts, list((PHRASES if phrases is None else phrases).items())))

    def make():
        known, n, given = shared.value
        index = TemplateIndex(known, n, num, den)
        wanted = [(tuple(alnum_words(p.encode())), label) for p, label in given]
        starts = frozenset(p[0] for p, _ in wanted)

        def one(raw):
            words = alnum_words(raw)
            places, base = phrase_places(words, wanted, starts)
            found = index.match(words)
            score = 1.0 if places else max((c for _, c in found), default=0.0)
            return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted({x for x, _ in found}), float(score)

        return lambda texts: [one(t) for t in texts]

    return annotate(docs, text, out, FOUND, make)
