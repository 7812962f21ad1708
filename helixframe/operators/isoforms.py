"""Isoform inference: profile groups, components, rank, EM, statuses, reports (inventory H).

exposure(feature, transcript, a > 0) and observed(dataset, feature, y) are long tables; so is everything that comes out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import cut, forget

#: What is known of a group's rate, in the order in which it is asked.
RESOLVED = ("identifiable", "group_only", "zero_evidence")
DIAGNOSTICS = "groups long, features long, rank long, active_features long, observed_sum double, iterations long, converged boolean, log_likelihood double, fixed_point_change double, relative_l1_residual double"
_DIAGNOSTIC = [x.split()[0] for x in DIAGNOSTICS.split(", ")]


def components(edges: DataFrame, feature: str = "feature", transcript: str = "transcript") -> DataFrame:
    """(transcript, component): the least transcript that shared features reach, by rounds of minima until nothing changes."""
    state = edges.select(transcript).distinct().withColumn("component", F.col(transcript))
    edges = cut(edges.select(feature, transcript).distinct())
    while True:
        by_feature = edges.join(state, transcript).groupBy(feature).agg(F.min("component").alias("_m"))
        low = edges.join(by_feature, feature).groupBy(transcript).agg(F.min("_m").alias("_m"))
        hop = state.join(low, transcript).select(transcript, F.least("component", "_m").alias("_c"))
        # pointer jumping: the component of one's component
        jump = hop.select(F.col(transcript).alias("_t"), F.col("_c").alias("_d"))
        new = hop.join(jump, F.col("_c") == F.col("_t"), "left").select(transcript, F.least("_c", F.coalesce("_d", "_c")).alias("component"))
        new = cut(new)
        same = new.join(state.withColumnRenamed("component", "_old"), transcript).where("component <> _old").isEmpty()
        forget(state)
        state = new
        if same:
            return state


def rank_of(columns: list[tuple[np.ndarray, np.ndarray]], tolerance: float = 1e-10) -> int:
    """Of sparse columns (rows, values) scaled by their largest entry, by elimination on each column's first row left."""
    basis: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    work = np.zeros(1 + max((int(r.max()) for r, _ in columns if len(r)), default=0))
    for rows, values in columns:
        work[:] = 0
        work[rows] = values / max(float(np.abs(values).max(initial=0.0)), np.finfo(float).tiny)
        at = 0
        while (left := np.abs(work[at:]) > tolerance).any():
            at += int(left.argmax())
            if at not in basis:
                keep = at + np.flatnonzero(left[int(left.argmax()) :])
                basis[at] = keep, work[keep] / work[at]
                break
            by, (places, old) = work[at], basis[at]
            work[places] -= by * old
            at += 1
    return len(basis)


def rank(columns: np.ndarray, tolerance: float = 1e-10) -> int:
    """rank_of the columns of a dense matrix."""
    return rank_of([(np.flatnonzero(c), c[c != 0]) for c in np.asarray(columns, dtype=float).T], tolerance)


def em_entries(f: np.ndarray, t: np.ndarray, a: np.ndarray, groups: int, y: np.ndarray, max_iterations: int, tolerance: float, lengths: np.ndarray | None = None, rest: tuple[int, float] = (0, 0.0)) -> tuple[np.ndarray, np.ndarray, dict]:
    """Poisson EM over the entries (feature, group, exposure > 0) of a component: (rates, assigned, diagnostics).

    Features without counts take no part but by the groups' `lengths` (sums of all their exposures; without them, the entries
    are all there are) and by `rest`: how many groups have no counted feature, and their lengths' sum.  A step's change and
    the test of convergence at the end are sums of changes of rates, relative to the sum of rates.
    """
    lengths, total = np.bincount(t, a, groups) if lengths is None else lengths, float(y.sum())
    start = total / (lengths.sum() + rest[1]) if total else 0.0
    theta, others = np.full(groups, start), start
    seen = y > 0

    def expect(rates, other):
        part = a * rates[t]
        rate = np.bincount(f, part, len(y))
        if not (np.isfinite(rate[seen]) & (rate[seen] > 0)).all():
            raise ValueError("a counted feature has no finite predicted count")
        share = np.divide(y, rate, out=np.zeros(len(y)), where=seen)
        expected = float(rates @ lengths) + other * rest[1]
        # what is predicted for features without counts is all that is predicted for no other
        residual = float(np.abs(rate - y)[seen].sum()) + max(0.0, expected - float(rate[seen].sum()))
        return np.bincount(t, part * share[f], groups), float((y[seen] * np.log(rate[seen])).sum()) - expected, residual

    def change(new, old, gone):
        return float((np.abs(new - old).sum() + gone * rest[0]) / max(old.sum() + gone * rest[0], np.finfo(float).tiny))

    last, n = -np.inf, 0
    for n in range(1, (max_iterations if total else 0) + 1):
        assigned, like, _ = expect(theta, others)
        new = assigned / lengths
        moved, theta, others = change(new, theta, others), new, 0.0
        if moved <= tolerance and abs(like - last) <= tolerance * max(total, 1):
            break
        last = like
    assigned, like, residual = expect(theta, others)
    fixed = change(assigned / lengths, theta, others) if total else 0.0
    return theta, assigned, {"active_features": int(seen.sum()), "observed_sum": total, "iterations": n, "converged": fixed <= tolerance, "log_likelihood": like, "fixed_point_change": fixed, "relative_l1_residual": residual / total if total else 0.0}


def em(exposure: np.ndarray, y: np.ndarray, max_iterations: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """em_entries of a dense matrix of features x groups: (rates, assigned, iterations, converged)."""
    f, t = np.nonzero(exposure)
    theta, assigned, told = em_entries(f, t, exposure[f, t].astype(float), exposure.shape[1], y, max_iterations, tolerance)
    return theta, assigned, told["iterations"], told["converged"]


def profile_groups(exposure: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """(transcript, group, observable_kmers): transcripts with equal entries are one group, named by the least of them; those
    of `transcripts` without entries are groups of their own, with 0 observable k-mers."""
    each = exposure.groupBy("transcript").agg(F.array_sort(F.collect_list(F.struct("feature", "a"))).alias("profile"), F.sum("a").cast("long").alias("observable_kmers"))
    named = each.groupBy("profile").agg(F.min("transcript").alias("group"))
    got = each.join(named, "profile").select("transcript", "group", "observable_kmers")
    if transcripts is None:
        return got
    every = transcripts.select("transcript").distinct().join(got, "transcript", "left")
    return every.select("transcript", F.coalesce("group", "transcript").alias("group"), F.coalesce("observable_kmers", F.lit(0)).alias("observable_kmers"))


#: Entries (feature, group) with counts of a component that one task fits; what has more is fitted by all tasks together.
MOST_ENTRIES = 200_000
#: Groups whose rates are held as arrays while larger components are fitted: 8 bytes each in the driver and in each task.
MOST_GROUPS = 2_000_000
#: Entries of a block of counted features.
BLOCK = 1 << 18


def _rank_table(entries: DataFrame, sizes: DataFrame, rank_limit: int, most_entries: int) -> DataFrame:
    """(component, rank) of the components with at most `rank_limit` groups."""
    asked = entries.join(sizes.where(F.col("groups") <= rank_limit).select("component", "entries"), "component")
    kind = entries.schema["component"].dataType.simpleString()

    def whole(batches):
        for table, starts in _whole_runs(batches, ["component"]):
            fresh = _fresh(table, ["component", "group"])
            group, feature, a = np.cumsum(fresh) - 1, _codes(table.column("feature")), table.column("a").to_numpy()
            ranks = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                _, f = np.unique(feature[i:j], return_inverse=True)
                order = np.lexsort((f, group[i:j]))
                ends = np.searchsorted(group[i:j], np.arange(group[i], group[j - 1] + 2))
                f, values = f[order], a[i:j][order]
                ranks.append(rank_of([(f[u:v], values[u:v]) for u, v in zip(ends[:-1], ends[1:], strict=True)]))
            yield pa.RecordBatch.from_arrays([table.column("component").combine_chunks().take(pa.array(starts)), pa.array(ranks, pa.int64())], names=["component", "rank"])

    def folded(parts):
        """The triangular factors of a task's rows, a block of features at a time: what is below them adds nothing to a rank."""
        kept: dict = {}
        for part in parts:
            for key, rows in part.groupby("component"):
                for _, x in rows.groupby(np.arange(len(rows)) // 2048):
                    dense = np.zeros((len(x), int(x["groups"].iloc[0])))
                    for i, (places, values) in enumerate(zip(x["t"], x["a"], strict=True)):
                        dense[i, places] = values
                    kept[key] = np.linalg.qr(np.vstack([kept[key], dense]) if key in kept else dense, mode="r")
        for key, r in kept.items():
            yield pd.DataFrame({"component": [key], "r": [r.ravel().tolist()], "width": [r.shape[1]]})

    def last(part: pd.DataFrame) -> pd.DataFrame:
        width = int(part["width"].iloc[0])
        r = np.linalg.qr(np.vstack([np.reshape(x, (-1, width)) for x in part["r"]]), mode="r")
        return pd.DataFrame({"component": part["component"].iloc[:1], "rank": [rank(r)]})

    few = _sorted_runs(asked.where(F.col("entries") <= most_entries).select("component", "feature", "group", "a"), ["component"]).mapInArrow(whole, f"component {kind}, rank long")
    many = asked.where(F.col("entries") > most_entries)
    number = many.select("component", "group").distinct().withColumn("t", F.row_number().over(Window.partitionBy("component").orderBy("group")) - 1)
    width = sizes.select("component", "groups")
    rows = many.select("component", "group", "feature", "a").join(number, ["component", "group"]).groupBy("component", "feature").agg(F.collect_list("t").alias("t"), F.collect_list("a").alias("a"))
    factors = rows.join(width, "component").mapInPandas(folded, f"component {kind}, r array<double>, width long")
    return few.unionByName(factors.groupBy("component").applyInPandas(last, f"component {kind}, rank long"))


def fit_groups(exposure: DataFrame, observed: DataFrame, transcripts: DataFrame | None = None, max_iterations: int = 10_000, tolerance: float = 1e-8, rank_limit: int = 512, most_datasets: int = 100_000, most_entries: int = MOST_ENTRIES, most_groups: int = MOST_GROUPS) -> tuple[DataFrame, DataFrame]:
    """(members, fits): members(transcript, group, component, observable_kmers), and for each dataset and group a row
    (dataset, group, component, rate, assigned, the component's diagnostics).

    Only features with counts are met with their entries, so the work follows what a dataset has seen; what it has not seen is
    in sums of lengths.  A component of a dataset with at most `most_entries` such entries is fitted in one task.  A larger
    one is fitted by rounds over all tasks: while its rates fit in arrays (`most_groups`), blocks of features send sums by
    group through a tree; beyond that, rates are a table, and a round is two joins and two aggregates.  Each component stops
    by its own rule.  The rank, which depends on exposures only, is asked once of each component with at most
    `rank_limit` groups.  More than `most_datasets` datasets raise.  A null dataset is one.
    """
    exposure = given = cut(exposure.select("feature", "transcript", "a"))
    members = cut(profile_groups(exposure, transcripts))
    first = members.where(F.col("transcript") == F.col("group")).select(F.col("transcript").alias("_g"))
    entries = exposure.join(first, F.col("transcript") == F.col("_g"), "left_semi").withColumnRenamed("transcript", "group")
    found = components(entries.withColumnRenamed("group", "transcript")).withColumnRenamed("transcript", "_g")
    old, members = members, cut(members.join(found, F.col("group") == F.col("_g"), "left").select("transcript", "group", F.coalesce("component", "group").alias("component"), "observable_kmers"))
    entries = cut(entries.join(found, F.col("group") == F.col("_g")).select("component", "group", "feature", F.col("a").cast("double").alias("a")))
    forget(old, found)
    datasets = cut(observed.select("dataset").distinct())
    if datasets.count() > most_datasets:
        raise ValueError(f"more than {most_datasets} datasets")
    lengths = entries.groupBy("component", "group").agg(F.sum("a").alias("length"))
    per_group = lengths.groupBy("component").agg(F.count("*").alias("groups"), F.sum("length").alias("all_length"))
    per_feature = entries.groupBy("component").agg(F.countDistinct("feature").alias("features"), F.count("*").alias("entries"))
    sizes = cut(per_group.join(per_feature, "component"))
    sizes = cut(sizes.join(_rank_table(entries, sizes, rank_limit, most_entries), "component", "left"))
    y = observed.groupBy("dataset", "feature").agg(F.sum("y").cast("double").alias("y")).where("y > 0")
    seen = entries.join(y, "feature").join(lengths, ["component", "group"])
    seen = cut(seen.select("dataset", "component", "group", "feature", "a", "y", "length"))
    work = cut(seen.groupBy("dataset", "component").agg(F.count("*").alias("seen_entries"), F.countDistinct("group").alias("seen_groups"), F.countDistinct("feature").alias("active_features"))
               .join(sizes.select("component", "groups", "all_length"), "component"))
    fitted = _fit_small(seen, work.where(F.col("seen_entries") <= most_entries), max_iterations, tolerance)
    # as many at most as there are entries for each most_entries
    for job in work.where(F.col("seen_entries") > most_entries).orderBy(F.desc("seen_entries")).collect():
        mine = seen.where(F.col("dataset").eqNullSafe(F.lit(job.dataset)) & (F.col("component") == F.lit(job.component)))
        fit_large = _fit_in_blocks if job.seen_groups <= most_groups else _fit_in_tables
        fitted = fitted.unionByName(fit_large(mine, job, max_iterations, tolerance, seen.schema))
    fitted = cut(fitted)
    # every dataset has every group: what was not fitted has rate 0
    told = fitted.where("`group` is null").select(F.col("dataset").alias("_d"), F.col("component").alias("_c"), *_TOLD)
    rates = fitted.where("`group` is not null").select(F.col("dataset").alias("_d"), F.col("group").alias("_g"), "rate", "assigned")
    every = members.select("group", "component").distinct().join(sizes, "component", "left").crossJoin(F.broadcast(datasets) if datasets.count() <= 100_000 else datasets)
    every = every.join(rates, (F.col("group") == F.col("_g")) & F.col("dataset").eqNullSafe(F.col("_d")), "left").drop("_d", "_g")
    every = every.join(told, (F.col("component") == F.col("_c")) & F.col("dataset").eqNullSafe(F.col("_d")), "left").drop("_d", "_c")
    none = {"rate": 0.0, "assigned": 0.0, "groups": 1, "features": 0, "active_features": 0, "observed_sum": 0.0, "iterations": 0, "converged": True, "log_likelihood": 0.0, "fixed_point_change": 0.0, "relative_l1_residual": 0.0}
    rank_known = F.when(F.col("features").isNull(), F.lit(0)).otherwise(F.col("rank")).cast("long").alias("rank")
    values = {k: F.coalesce(k, F.lit(v)).alias(k) for k, v in none.items()} | {"rank": rank_known}
    fits = cut(every.select("dataset", "group", "component", values["rate"], values["assigned"], *(values[c].cast(_KINDS[c]).alias(c) for c in _DIAGNOSTIC)))
    forget(given, entries, datasets, sizes, seen, work, fitted)
    return members, fits


#: What a fit tells of its component beside what is known of the model.
_KINDS = dict(x.split() for x in DIAGNOSTICS.split(", "))
_TOLD = [c for c in _DIAGNOSTIC if c not in ("groups", "features", "rank")]


def _fitted_schema(seen: T.StructType) -> T.StructType:
    kinds = [seen["dataset"], seen["component"], seen["group"], T.StructField("rate", T.DoubleType()), T.StructField("assigned", T.DoubleType())]
    return T.StructType([*kinds, *T.StructType.fromDDL(", ".join(f"{c} {_KINDS[c]}" for c in _TOLD)).fields])


def _codes(column) -> np.ndarray:
    """Numbers that are equal where values are, nulls too."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _fresh(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row's keys differ from the row's before."""
    out = np.ones(table.num_rows, dtype=bool)
    if len(out):
        out[1:] = False
        for k in keys:
            codes = _codes(table.column(k))
            out[1:] |= codes[1:] != codes[:-1]
    return out


def _whole_runs(batches, keys: list[str]):
    """Sorted rows as tables that end where keys change: (table, starts of runs).  A run is held whole, and nothing else."""
    held: list = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        starts = np.flatnonzero(_fresh(table, keys))
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield table.slice(0, last), starts[:-1]
        held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.flatnonzero(_fresh(table, keys))


def _sorted_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "group", "feature")


def _fit_small(seen: DataFrame, work: DataFrame, max_iterations: int, tolerance: float) -> DataFrame:
    """(dataset, component, group, rate, assigned) of groups with counts, and a row without a group with what the fit tells."""
    schema, keys = _fitted_schema(seen.schema), ["dataset", "component"]
    sizes = work.select(F.col("dataset").alias("_d"), F.col("component").alias("_c"), "groups", "all_length")
    rows = seen.join(sizes, F.col("dataset").eqNullSafe(F.col("_d")) & (F.col("component") == F.col("_c"))).drop("_d", "_c")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema).types
        for table, starts in _whole_runs(batches, keys):
            fresh = _fresh(table, [*keys, "group"])
            firsts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            feature = _codes(table.column("feature"))
            a, y, length, all_length, groups = (table.column(c).to_numpy() for c in ("a", "y", "length", "all_length", "groups"))
            rates, parts, told = [], [], []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                features, f = np.unique(feature[i:j], return_inverse=True)
                t = group[i:j] - group[i]
                obs, lengths = np.zeros(len(features)), np.zeros(int(t[-1]) + 1)
                obs[f], lengths[t] = y[i:j], length[i:j]
                rest = int(groups[i]) - len(lengths), float(all_length[i]) - float(lengths.sum())
                theta, assigned, of = em_entries(f, t, a[i:j], len(lengths), obs, max_iterations, tolerance, lengths, rest if rest[0] else (0, 0.0))
                rates.append(theta)
                parts.append(assigned)
                told.append(of)
            n, m = len(firsts), len(starts)
            take = pa.array(np.concatenate([firsts, starts]))
            columns = [table.column(k).combine_chunks().take(take) for k in keys]
            columns.append(table.column("group").combine_chunks().take(pa.array(np.append(firsts, np.zeros(m, dtype=np.int64)), mask=np.arange(n + m) >= n)))
            columns += [pa.array(np.append(np.concatenate(x), np.zeros(m)), mask=np.arange(n + m) >= n) for x in (rates, parts)]
            columns += [pa.array([None] * n + [of[c] for of in told], kind) for c, kind in zip(_TOLD, types[5:], strict=True)]
            yield pa.RecordBatch.from_arrays([c.cast(kind) for c, kind in zip(columns, types, strict=True)], names=schema.names)

    return _sorted_runs(rows, keys).mapInArrow(run, schema)


def _told_row(job, told: dict, schema: T.StructType, spark) -> DataFrame:
    values = {"dataset": job.dataset, "component": job.component, "group": None, "rate": None, "assigned": None} | told
    return spark.createDataFrame([tuple(values[c] for c in schema.names)], schema)


def _fit_in_blocks(mine: DataFrame, job, max_iterations: int, tolerance: float, kinds: T.StructType) -> DataFrame:
    """A large component whose rates are arrays: each round broadcasts them and gets sums by group through a tree of tasks."""
    spark, schema = mine.sparkSession, _fitted_schema(kinds)
    number = cut(_numbered(mine.select("group", "length").distinct(), "group"))
    n = job.seen_groups
    lengths = np.zeros(n)
    for r in number.select("at", "length").toLocalIterator(prefetchPartitions=True):
        lengths[r["at"]] = r["length"]
    rows = mine.join(number.select("group", "at"), "group").select("feature", "at", "a", "y")
    parts = max(2, -(-job.seen_entries // BLOCK))
    table = cut(rows.repartition(parts, "feature").sortWithinPartitions("feature").mapInArrow(_blocks, "block binary"))
    total = float(mine.groupBy("feature").agg(F.first("y").alias("y")).agg(F.sum("y")).first()[0])
    rest = job.groups - n, max(0.0, job.all_length - float(lengths.sum())) if job.groups > n else 0.0

    def expect(theta, other):
        shared = spark.sparkContext.broadcast(theta)

        def add(sums, row, s=shared):
            got = _expect_block(bytes(row.block), s.value)
            return got if sums is None else tuple(u + v for u, v in zip(sums, got, strict=True))

        both = lambda u, v: u if v is None else v if u is None else tuple(x + z for x, z in zip(u, v, strict=True))
        assigned, like, residual, predicted, bad = table.rdd.treeAggregate(None, add, both)
        shared.unpersist()
        if bad:
            raise ValueError("a counted feature has no finite predicted count")
        expected = float(theta @ lengths) + other * rest[1]
        return assigned, like - expected, residual + max(0.0, expected - predicted)

    def change(new, old, gone):
        return float((np.abs(new - old).sum() + gone * rest[0]) / max(old.sum() + gone * rest[0], np.finfo(float).tiny))

    start = total / (float(lengths.sum()) + rest[1])
    theta, others, last, rounds = np.full(n, start), start, -np.inf, 0
    for rounds in range(1, max_iterations + 1):
        assigned, like, _ = expect(theta, others)
        new = assigned / lengths
        moved, theta, others = change(new, theta, others), new, 0.0
        if moved <= tolerance and abs(like - last) <= tolerance * max(total, 1):
            break
        last = like
    assigned, like, residual = expect(theta, others)
    fixed = change(assigned / lengths, theta, others)
    told = {"active_features": job.active_features, "observed_sum": total, "iterations": rounds, "converged": fixed <= tolerance, "log_likelihood": like, "fixed_point_change": fixed, "relative_l1_residual": residual / total}
    shared = spark.sparkContext.broadcast((theta, assigned))

    def take(batches):
        for batch in batches:
            at = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value[0][at]), pa.array(shared.value[1][at])], names=["group", "rate", "assigned"])

    kind = T.StructType([kinds["group"], T.StructField("rate", T.DoubleType()), T.StructField("assigned", T.DoubleType())])
    rates = number.select("group", "at").mapInArrow(take, kind)
    fixed_columns = [F.lit(job.dataset).cast(kinds["dataset"].dataType).alias("dataset"), F.lit(job.component).cast(kinds["component"].dataType).alias("component")]
    rates = cut(rates.select(*fixed_columns, "group", "rate", "assigned", *(F.lit(None).cast(_KINDS[c]).alias(c) for c in _TOLD)))
    forget(number, table)
    return rates.unionByName(_told_row(job, told, schema, spark))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with a column `at` that counts them from 0."""
    from .explore import ordered

    return ordered(rows, key, key, False).withColumn("at", F.col("position") - 1).drop("position")


def _blocks(batches):
    """Counted features with their entries, sorted by feature: blocks of whole features, as counts, then places, numbers of
    groups, exposures and counts."""
    held, n = [], 0

    def emit(table: pa.Table) -> pa.RecordBatch:
        names = table.column("feature").combine_chunks()
        fresh = np.append(True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) if len(names) else np.zeros(0, dtype=bool)
        f, y = np.cumsum(fresh) - 1, table.column("y").to_numpy()[fresh]
        raw = b"".join([np.array([len(f), len(y)], dtype=np.int64).tobytes(), f.astype(np.int64).tobytes(), table.column("at").to_numpy().astype(np.int64).tobytes(), table.column("a").to_numpy().tobytes(), y.tobytes()])
        return pa.record_batch([pa.array([raw], pa.binary())], names=["block"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            table = pa.Table.from_batches(held)
            names = table.column("feature")
            last = names[-1]
            whole = n - int(pc.sum(pc.equal(names, last)).as_py())  # the last feature may go on
            if whole:
                yield emit(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                n -= whole
    if n:
        yield emit(pa.Table.from_batches(held))


def _expect_block(raw: bytes, theta: np.ndarray) -> tuple:
    n, m = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
    f, at = np.frombuffer(raw, dtype=np.int64, count=n, offset=16), np.frombuffer(raw, dtype=np.int64, count=n, offset=16 + 8 * n)
    a, y = np.frombuffer(raw, dtype=float, count=n, offset=16 + 16 * n), np.frombuffer(raw, dtype=float, count=m, offset=16 + 24 * n)
    part = a * theta[at]
    rate = np.bincount(f, part, m)
    good = np.isfinite(rate) & (rate > 0)
    safe = np.where(good, rate, 1.0)
    return np.bincount(at, part * (y / safe)[f], len(theta)), float((y * np.log(safe)).sum()), float(np.abs(rate - y).sum()), float(rate.sum()), int((~good).sum())


def _fit_in_tables(mine: DataFrame, job, max_iterations: int, tolerance: float, kinds: T.StructType) -> DataFrame:
    """A large component with too many groups for arrays: rates are a table, written each round; two joins, two aggregates."""
    spark, schema = mine.sparkSession, _fitted_schema(kinds)
    entries = cut(mine.select("feature", "group", "a", "y"))
    groups = cut(mine.groupBy("group").agg(F.first("length").alias("length")))
    total = float(entries.groupBy("feature").agg(F.first("y").alias("y")).agg(F.sum("y")).first()[0])
    all_length = float(groups.agg(F.sum("length")).first()[0])
    rest = job.groups - job.seen_groups, max(0.0, job.all_length - all_length) if job.groups > job.seen_groups else 0.0
    start = total / (all_length + rest[1])
    state = cut(groups.withColumn("theta", F.lit(start)))
    others, last, rounds = start, -np.inf, 0

    def expect(state, other):
        """(group, length, theta, assigned) written, likelihood, residual, moved."""
        rate = entries.join(state.select("group", "theta"), "group").groupBy("feature").agg(F.sum(F.col("a") * F.col("theta")).alias("rate"), F.first("y").alias("y"))
        rate = cut(rate)
        good = (F.col("rate") > 0) & (F.col("rate") < float("inf"))
        like, gap, predicted, bad = rate.agg(F.sum(F.when(good, F.col("y") * F.log("rate"))), F.sum(F.abs(F.col("rate") - F.col("y"))), F.sum("rate"), F.count_if(~F.coalesce(good, F.lit(False)))).first()
        if bad:
            raise ValueError("a counted feature has no finite predicted count")
        share = rate.select("feature", (F.col("y") / F.col("rate")).alias("share"))
        sums = entries.join(share, "feature").groupBy("group").agg(F.sum(F.col("a") * F.col("share")).alias("_s"))
        got = cut(state.join(sums, "group").withColumn("assigned", F.col("theta") * F.col("_s")).drop("_s"))
        moved, old, expected = got.agg(F.sum(F.abs(F.col("assigned") / F.col("length") - F.col("theta"))), F.sum("theta"), F.sum(F.col("theta") * F.col("length"))).first()
        forget(rate)
        expected += other * rest[1]
        moved = (moved + other * rest[0]) / max(old + other * rest[0], np.finfo(float).tiny)
        return got, like - expected, gap + max(0.0, expected - predicted), moved

    for rounds in range(1, max_iterations + 1):
        got, like, _, moved = expect(state, others)
        new = cut(got.select("group", "length", (F.col("assigned") / F.col("length")).alias("theta")))
        forget(state, got)
        state, others = new, 0.0
        if moved <= tolerance and abs(like - last) <= tolerance * max(total, 1):
            break
        last = like
    got, like, residual, fixed = expect(state, others)
    forget(state, entries, groups)
    told = {"active_features": job.active_features, "observed_sum": total, "iterations": rounds, "converged": fixed <= tolerance, "log_likelihood": like, "fixed_point_change": fixed, "relative_l1_residual": residual / total}
    fixed_columns = [F.lit(job.dataset).cast(kinds["dataset"].dataType).alias("dataset"), F.lit(job.component).cast(kinds["component"].dataType).alias("component")]
    rates = got.select(*fixed_columns, "group", F.col("theta").alias("rate"), "assigned", *(F.lit(None).cast(_KINDS[c]).alias(c) for c in _TOLD))
    return rates.unionByName(_told_row(job, told, schema, spark))


def global_fit(fits: DataFrame) -> DataFrame:
    """The sum of independent fits, without `dataset`: rates and assigned counts add up, diagnostics are the largest, all of
    them, or sums, and residuals are weighed by what was observed."""
    total = F.sum("observed_sum")
    return fits.groupBy("group", "component").agg(
        F.sum("rate").alias("rate"), F.sum("assigned").alias("assigned"), F.first("groups").alias("groups"), F.first("features").alias("features"), F.max("rank").alias("rank"),
        F.max("active_features").alias("active_features"), total.alias("observed_sum"), F.max("iterations").alias("iterations"), F.bool_and("converged").alias("converged"),
        F.sum("log_likelihood").alias("log_likelihood"), F.max("fixed_point_change").alias("fixed_point_change"), F.coalesce(F.try_divide(F.sum(F.col("relative_l1_residual") * F.col("observed_sum")), total), F.lit(0.0)).alias("relative_l1_residual"),
    )


def with_status(fits: DataFrame, members: DataFrame) -> DataFrame:
    """fits with members, observable_kmers and status of each group."""
    sizes = members.groupBy(F.col("group").alias("_g")).agg(F.count("*").alias("members"), F.max("observable_kmers").alias("observable_kmers"))
    state = (
        F.when(F.col("observable_kmers") == 0, "unobservable").when(~F.col("converged"), "non_converged").when(F.col("observed_sum") == 0, "zero_evidence")
        .when(F.col("rank").isNull(), "rank_unchecked").when(F.col("rank") != F.col("groups"), "unresolved").when(F.col("members") > 1, "group_only").otherwise("identifiable")
    )
    return fits.join(sizes, F.col("group") == F.col("_g")).drop("_g").withColumn("status", state)


def _shares(states: DataFrame, by: list[str]) -> DataFrame:
    """Of each dataset: the sum of rates, and whether every group's rate is known."""
    known = F.col("status").isin(*RESOLVED, "unobservable")
    return states.groupBy(*by).agg(F.sum("rate").alias("_total"), F.bool_and(known).alias("_all"))


def _with_shares(states: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return states.crossJoin(F.broadcast(_shares(states, by)))
    return states.join(_shares(states, by), by)


def _ppm(rate):
    return F.when(F.col("_all"), F.coalesce(F.try_divide(1e6 * rate, F.col("_total")), F.when(rate.isNotNull(), 0.0)))


def transcript_report(members: DataFrame, fits: DataFrame, genes: DataFrame) -> DataFrame:
    """One row a transcript (and dataset, if fits has one).  genes: (transcript, gene), one row each.

    abundance is null unless the transcript is alone in its group and the rate is known; the fraction within the gene is
    null unless all groups of the gene are of it alone and known; parts per million unless all groups are.
    """
    by = ["dataset"] if "dataset" in fits.columns else []
    states = with_status(fits, members)
    rows = _with_shares(states, by).join(members.select("transcript", "group"), "group").join(genes.select("transcript", "gene"), "transcript")
    kinds = members.join(genes, "transcript").groupBy("group").agg(F.countDistinct("gene").alias("_genes"))
    known = F.col("status").isin(*RESOLVED)
    of_gene = members.join(genes, "transcript").select("group", "gene").distinct().join(kinds, "group").join(states.select(*by, "group", "rate", "status"), "group")
    of_gene = of_gene.groupBy(*by, "gene").agg(F.sum(F.when(F.col("_genes") == 1, F.col("rate")).otherwise(0.0)).alias("_gene_rate"), F.bool_and(known & (F.col("_genes") == 1)).alias("_gene_known"))
    single = (F.col("members") == 1) & known
    rate = F.when(single, F.col("rate"))
    fraction = F.when(F.col("_gene_known"), F.coalesce(F.try_divide(rate, F.col("_gene_rate")), F.when(rate.isNotNull(), 0.0)))
    state = F.when((F.col("members") > 1) & known & (F.col("status") != "zero_evidence"), "group_only").otherwise(F.col("status"))
    return rows.join(of_gene, [*by, "gene"]).select(
        *by, "transcript", "gene", "group", "component", "observable_kmers", rate.alias("abundance"), fraction.alias("within_gene_fraction"), _ppm(rate).alias("relative_abundance_ppm"),
        F.when(single, F.col("assigned")).alias("assigned_observations"), F.when((F.col("members") == 1) & (F.col("observable_kmers") > 0), F.col("rate")).alias("model_estimate"), state.alias("status"),
    )


def group_report(members: DataFrame, fits: DataFrame, genes: DataFrame) -> DataFrame:
    """One row a group (and dataset, if fits has one), with the names in it as JSON lists in order."""
    by = ["dataset"] if "dataset" in fits.columns else []
    names = members.join(genes, "transcript").groupBy("group").agg(F.to_json(F.array_sort(F.collect_set("gene"))).alias("gene_names"), F.to_json(F.array_sort(F.collect_list("transcript"))).alias("transcript_names"))
    states = _with_shares(with_status(fits, members), by).join(names, "group")
    rate = F.when(F.col("status").isin(*RESOLVED), F.col("rate"))
    return states.select(
        *by, "group", "component", "gene_names", "transcript_names", "observable_kmers", rate.alias("abundance"), _ppm(rate).alias("relative_abundance_ppm"),
        F.col("assigned").alias("assigned_observations"), F.when(F.col("observable_kmers") > 0, F.col("rate")).alias("model_estimate"), "status",
    )


def diagnostics_report(fits: DataFrame) -> DataFrame:
    """One row a component (and dataset, if fits has one)."""
    by = ["dataset"] if "dataset" in fits.columns else []
    return fits.groupBy(*by, "component").agg(*(F.first(c).alias(c) for c in _DIAGNOSTIC))


def fit(exposure: DataFrame, observed: DataFrame, max_iterations: int = 10_000, tolerance: float = 1e-8, rank_limit: int = 512, transcripts: DataFrame | None = None) -> DataFrame:
    """(dataset, transcript, component, abundance, model_estimate, assigned, status), the report's main columns."""
    members, fits = fit_groups(exposure, observed, transcripts, max_iterations, tolerance, rank_limit)
    every = transcripts if transcripts is not None else exposure
    got = transcript_report(members, fits, every.select("transcript").distinct().withColumn("gene", F.col("transcript")))
    return got.select("dataset", "transcript", "component", "abundance", "model_estimate", F.col("assigned_observations").alias("assigned"), "status")


def check_observed(observed: DataFrame, features: DataFrame) -> None:
    """Raises if counts are negative or no finite numbers, if a dataset has a feature twice, or one that the model has not."""
    y = F.col("y").cast("double")
    if not observed.where(y.isNull() | F.isnan(y) | (y < 0) | (y == float("inf"))).isEmpty():
        raise ValueError("counts must be finite and not negative")
    if not observed.groupBy("dataset", "feature").count().where("count > 1").isEmpty():
        raise ValueError("a dataset has a feature twice")
    if not observed.join(features.select("feature"), "feature", "left_anti").isEmpty():
        raise ValueError("counts of features that the model does not have")


def check_options(stats: bool = False, viewer: bool = False, max_iterations: int = 1, tolerance: float = 1e-8, rank_limit: int = 1) -> None:
    """Inference takes no cross-dataset statistics and no viewer archive; its limits must be positive."""
    if stats or viewer:
        raise ValueError("isoform counts take no statistics and no viewer archive")
    if max_iterations < 1 or rank_limit < 1 or not 0 < tolerance < float("inf"):
        raise ValueError("iterations, tolerance and rank limit must be positive")
