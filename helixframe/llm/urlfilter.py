"""URL filters: rules of host and path, and gradient-boosted trees on lexical features for what no rule covers.

Labelled URLs are those that a rule decides.  Features: length, depth, digit ratio, entropy, counts of parameters and
of other marks, and statistics of the host's suffixes (smoothed shares of blocked URLs, learned with the trees).  Where the
labels come from rules of hosts, a rule's own suffixes say nothing about other hosts, so they can be left out of these
statistics (`ignore`): else every URL of a top-level label that a block rule has would be blocked.

Defined results: a url that is null or has no `://` has an empty host and path and no rule; the trees judge it by the
features of its text (null: of the empty text); if nothing is labelled, such urls are allowed; equal urls get equal results;
long urls are read whole; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import BoostedTrees, fit_trees
from .common import annotate, bounded_sample, lower_ascii

RESULT = T.StructType([T.StructField("blocked", T.DoubleType())])


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (verdict, host, path) that fits, or null; ties to the rule that sorts first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest), reversed(ordered), F.lit(None).cast("struct<rule:string,verdict:string>"))


def split(url: str | None) -> tuple[str, str, str]:
    """Host, path and the rest, as host_of and path_of see them."""
    if not url or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop], rest[stop:]


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[-k:]) for k in (1, 2, 3) if len(labels) >= k]


def rule_suffixes(rules: list[tuple[str, str, str]]) -> frozenset[str]:
    """Suffixes of the hosts of rules (verdict, host, path)."""
    return frozenset(s for _, host, _ in rules for s in suffixes(host))


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str | None) -> list[float]:
    host, path, query = split(url)
    text = url or ""
    n = max(1, len(text))
    parts = [p for p in path.split("/") if p]
    return [
        len(text), len(host), len(path), len(query), len(parts), host.count("."), sum(c.isdigit() for c in text) / n, sum(c.isdigit() for c in host), _entropy(text), _entropy(host),
        query.count("=") , query.count("&"), "#" in query, "?" in query, host.count("-"), text.count("-"), text.count("_"), text.count("%"), text.startswith("https"),
        path.endswith("/"), "." in (parts[-1] if parts else ""), max(map(len, parts), default=0), max(map(len, host.split(".")), default=0), len(parts[0]) if parts else 0,
    ]


@dataclass
class UrlModel:
    prior: float
    shares: dict[str, tuple[float, int]]  # by suffix: blocked URLs, URLs
    trees: BoostedTrees

    def row(self, url: str | None) -> list[float]:
        known = [self.shares.get(s, (0.0, 0)) for s in suffixes(split(url)[0])]
        known += [(0.0, 0)] * (3 - len(known))
        return [*map(float, lexical(url)), *((b + 4 * self.prior) / (n + 4) for b, n in known), *(math.log1p(n) for _, n in known)]

    def blocked(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.score(np.array([self.row(u) for u in urls], dtype=float)) if urls else np.zeros(0)


def train(labelled: DataFrame, url: str, blocked: str, key: Column, max_rows: int = 6_000, ignore: frozenset[str] = frozenset()) -> UrlModel:
    """Learn from rows whose `blocked` (boolean) is not null; beyond `max_rows`, from that many, chosen by a
    hash of `key`, url and label.
    The suffix statistics hold only suffixes of these rows, but those in `ignore`, so their size is bounded too."""
    rows = bounded_sample(labelled.where(F.col(blocked).isNotNull()), [key, F.col(url), F.col(blocked)], max_rows).select(F.col(url).alias("u"), F.col(blocked).cast("int").alias("y")).collect()
    rows = sorted(((r.u, r.y) for r in rows), key=lambda r: (r[0] or "", r[1]))
    folds = 5

    def statistics(some) -> dict[str, tuple[int, int]]:
        total: dict[str, tuple[int, int]] = {}
        for u, y in some:
            for x in set(suffixes(split(u)[0])) - ignore:
                blocked_, n = total.get(x, (0, 0))
                total[x] = blocked_ + y, n + 1
        return total

    prior = sum(y for _, y in rows) / len(rows) if rows else 0.0
    model = UrlModel(prior, {}, fit_trees(np.zeros((0, 0)), np.zeros(0)))
    if rows:
        # a URL must not see its own label in the statistics that the trees learn from: they come from other folds
        fold = [zlib.crc32((u or "").encode()) % folds for u, _ in rows]
        x: list = [None] * len(rows)
        for k in range(folds):
            model.shares = statistics(r for r, f in zip(rows, fold, strict=True) if f != k)
            for i, (u, _) in enumerate(rows):
                if fold[i] == k:
                    x[i] = model.row(u)
        model.trees = fit_trees(np.array(x, dtype=float), np.array([y for _, y in rows], dtype=float))
        model.shares = statistics(rows)
    return model


def judge(df: DataFrame, url: str, model: UrlModel, out: str = "judged") -> DataFrame:
    """df with the struct column `out` (blocked: a probability)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(urls):
            urls = [u.decode("utf-8", "replace") if u is not None else None for u in urls]
            if not m.trees.edges:
                return [(float(m.prior),) for _ in urls]
            return [(float(p),) for p in m.blocked(urls)]

        return run

    return annotate(df, url, out, RESULT, make)
