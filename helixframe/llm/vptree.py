"""Nearest neighbours by vantage-point trees, one per shard of the candidates.

Inner products become distances by one more coordinate: with M the largest norm, candidates get sqrt(M^2 - |x|^2) and
queries 0, so |q - x|^2 = |q|^2 + M^2 - 2 q.x and the nearest point has the largest product.  A shard's rows are sorted
together, candidates before queries, so its tree is built once, over its distinct vectors, and queries stream past it in
blocks; a task holds one shard and one block.  A branch is left out if the triangle inequality, with its bound multiplied
by `factor`, puts it beyond the k-th best found so far: factor 1 is exact search, larger ones prune more and may miss
(1.1 is held to a recall of 0.9 by a test).  Scores are sums of products from the first component to the last in double
precision, on the original vectors; trees hold vectors divided by a power of two, so that squares neither overflow nor
vanish, and where the products themselves might, nothing is pruned.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
take no part; vectors of different lengths are never compared; of rows that repeat an id the least vector counts; ties
go to the smaller id; a product that is not a number counts as minus infinity; equal vectors are held once with their
smallest k + 1 ids, which is all that ties can return; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAF = 256


class VPTree:
    """Over the rows of `points`; arrays of nodes: vantage point, radius, children; leaves hold row numbers."""

    def __init__(self, points: np.ndarray, seed: int = 1):
        self.points, self.nodes = points, []
        rng = np.random.default_rng(seed)

        def build(rows: np.ndarray) -> int:
            me = len(self.nodes)
            self.nodes.append(None)
            if len(rows) <= LEAF:
                self.nodes[me] = (rows,)
                return me
            vantage = points[rows[rng.integers(len(rows))]]
            far = np.sqrt(((points[rows] - vantage) ** 2).sum(axis=1))
            radius = float(np.median(far))
            inner = far <= radius
            if inner.all():
                self.nodes[me] = (rows,)
                return me
            # the closest and farthest distances on either side bound what a branch can hold
            self.nodes[me] = (vantage, (far[inner].min(), radius), (far[~inner].min(), far.max()), build(rows[inner]), build(rows[~inner]))
            return me

        if len(points):
            build(np.arange(len(points)))

    def visit(self, queries: np.ndarray, limits: np.ndarray, factor: float, leaf) -> None:
        """Calls leaf(active queries, rows) for each leaf not ruled out; leaf lowers limits (a distance for each query)."""

        def go(node: int, active: np.ndarray) -> None:
            x = self.nodes[node]
            if len(x) == 1:
                leaf(active, x[0])
                return
            vantage, near, wide, left, right = x
            d = np.sqrt(np.maximum(((queries[active] - vantage) ** 2).sum(axis=1), 0))
            first = d <= near[1]
            for side in (True, False):  # each query sees its own side first
                for child, (low, high), mine in ((left, near, first == side), (right, wide, first != side)):
                    who = active[mine]
                    gap = np.maximum(0, np.maximum(low - d[mine], d[mine] - high))
                    who = who[factor * gap <= limits[who] + 1e-9]
                    if len(who):
                        go(child, who)

        if self.nodes:
            go(0, np.arange(len(queries)))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


class Shard:
    """The candidates of one shard: distinct vectors, their least ids, the tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float, norm: float, scale: float):
        ids, vectors = least_of_each(ids, vectors)
        self.k, self.norm, self.scale = k, norm, scale
        self.exact = not 1e-280 < scale * scale < 1e280 / max(1, vectors.shape[1])
        self.factor = 0.0 if self.exact else factor
        self.distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        by = np.lexsort((ids, which.ravel()))
        starts = np.searchsorted(which.ravel()[by], np.arange(len(self.distinct) + 1))
        self.owners = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.scaled = self.distinct / scale
        self.tree = VPTree(np.column_stack([self.scaled, np.sqrt(np.maximum(norm * norm - (self.scaled**2).sum(axis=1), 0))]))

    def search(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, candidate id, score) of the k nearest of each query within the shard."""
        k, scaled = self.k, queries / self.scale
        probes = np.column_stack([scaled, np.zeros(len(queries))])
        squares = (scaled**2).sum(axis=1) + self.norm * self.norm
        limits = np.full(len(queries), np.inf)
        best: list[list[tuple[float, int, float]]] = [[] for _ in range(len(queries))]  # (-score, id, score), sorted
        floor = np.full(len(queries), -np.inf)
        slack = 1e-9 * (1 + self.norm * np.sqrt((scaled**2).sum(axis=1)))

        def leaf(active: np.ndarray, rows: np.ndarray) -> None:
            rough = scaled[active] @ self.scaled[rows].T
            a, r = np.nonzero(rough >= (floor[active] - slack[active])[:, None])
            # of each query, only what can enter its best k: the k + 1 roughly best distinct vectors and what ties with them
            if len(rows) > k + 1 and not self.exact:
                top = np.partition(rough, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1]
                fit = rough[a, r] >= top[a] - slack[active][a]
                a, r = a[fit], r[fit]
            if not len(a):
                return
            score = exact_scores(queries[active[a]], self.distinct[rows[r]])
            key = np.where(np.isnan(score), -np.inf, score)
            cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            for lo, hi in zip(cuts, [*cuts[1:], len(a)], strict=True):
                me = int(active[a[lo]])
                mine = best[me]
                mine += [(-s, int(i), x) for s, x, v in zip(key[lo:hi].tolist(), score[lo:hi].tolist(), rows[r[lo:hi]].tolist(), strict=True) for i in self.owners[v] if i != query_ids[me]]
                mine.sort(key=lambda x: x[:2])
                del mine[k:]
                if len(mine) == k and not self.exact:
                    floor[me] = -mine[-1][0] / self.scale / self.scale
                    limits[me] = np.sqrt(max(0.0, squares[me] - 2 * floor[me]) + 1e-9)

        self.tree.visit(probes, limits, self.factor, leaf)
        flat = [(me, i, x) for me, mine in enumerate(best) for _, i, x in mine]
        at, near, score = zip(*flat, strict=True) if flat else ((), (), ())
        return np.array(at, dtype=np.int64), np.array(near, dtype=np.int64), np.array(score)


def least_of_each(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    once = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, bool)
    return ids[once], vectors[once]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(
    df: DataFrame, id_col: str, vector: str, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, block_rows: int = 4096
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product for each row where `is_query` holds.

    Candidates are dealt by a hash of the id into shards of about `shard_rows`; every query visits each shard, `block_rows`
    at a time, and a last step keeps the best k of a query.
    """
    v = F.col(vector)
    good = (
        F.col(id_col).isNotNull() & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    )
    rows = df.where(good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.size(v).alias("dim"))
    largest = F.greatest(F.array_max("vector"), -F.array_min("vector"))
    n, biggest, widest = rows.agg(F.count("*"), F.coalesce(F.max(largest), F.lit(1.0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(1, -(-n // shard_rows))
    scale = 2.0 ** float(np.floor(np.log2(biggest))) if biggest > 1e-300 else 1e-300
    # components are below 2 once scaled, so their squares can't overflow
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.lit(scale)) * (x / F.lit(scale)))
    norm = float(np.sqrt(rows.agg(F.coalesce(F.max(square), F.lit(1.0))).first()[0])) * (1 + 1e-9)
    at = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shards)).cast("int")
    points = rows.select("dim", at.alias("shard"), F.lit(0).alias("asking"), "id", "vector")
    asks = rows.where("asks").groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("x"))
    asks = asks.select("x.dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asking"), "id", "x.vector")
    together = points.unionByName(asks).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asking")

    def run(batches):
        here, held, shard = None, [], None  # key of the current shard, its (ids, vectors) so far, its tree once a query came

        def answers(ids, queries):
            for lo in range(0, len(ids), block_rows):
                some = ids[lo : lo + block_rows]
                pos, near, score = shard.search(some, queries[lo : lo + block_rows])
                yield pa.record_batch([pa.array(some[pos], pa.int64()), pa.array(near, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            dim, part, asking = (batch.column(i).to_numpy() for i in range(3))
            change = np.flatnonzero((dim[1:] != dim[:-1]) | (part[1:] != part[:-1]) | (asking[1:] != asking[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                if here != (dim[lo], part[lo]):
                    here, held, shard = (dim[lo], part[lo]), [], None
                ids, vectors = batch.column(3).to_numpy()[lo:hi], _vectors(batch.column(4).slice(lo, hi - lo), int(dim[lo]))
                if not asking[lo]:
                    held.append((ids, vectors))
                    if sum(len(x) for x, _ in held) > 4 * shard_rows:  # rows that repeat an id
                        held = [least_of_each(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))]
                    continue
                if shard is None:
                    every = held or [(np.zeros(0, dtype=np.int64), np.zeros((0, int(dim[lo]))))]
                    shard = Shard(np.concatenate([x for x, _ in every]), np.concatenate([y for _, y in every]), k, factor, norm, scale)
                yield from answers(ids, vectors)

    found = together.mapInArrow(run, "query_id long, vec_id long, score double")
    best = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    w = Window.partitionBy("query_id").orderBy(best.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
