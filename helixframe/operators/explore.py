"""Selections and matrix analytics over the long count table (inventory I and J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.sequence import SCALE, log2, natural_key, six_decimals
from ..storage import cut, forget


def select(counts: DataFrame, key: str, names: DataFrame | None = None, ids: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Rows whose key is in ids or whose name is in names; an unknown one raises."""
    parts = []
    for wanted, column in ((names, name), (ids, key)):
        if wanted is not None:
            unknown = wanted.select(column).distinct().join(counts.select(column).distinct(), column, "left_anti").limit(10).collect()
            if unknown:
                raise ValueError(f"unknown {column}: " + ", ".join(str(r[0]) for r in unknown))
            parts.append(counts.join(wanted.select(column).distinct(), column, "left_semi").select(key).distinct())
    if not parts:
        raise ValueError("nothing selected")
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()
    return counts.join(chosen, key, "left_semi")


def bounds(counts: DataFrame, low=None, high=None, value: str = "count") -> DataFrame:
    out = counts if low is None else counts.where(F.col(value) >= low)
    return out if high is None else out.where(F.col(value) <= high)


def _exact(values: DataFrame, value: str) -> bool:
    return isinstance(values.schema[value].dataType, T.IntegralType | T.DecimalType)


def _checked(values: DataFrame, value: str) -> DataFrame:
    v, exact = F.col(value), _exact(values, value)
    bad = (v < 0) if exact else (v < 0) | F.isnan(v) | (v == float("inf"))
    return values.withColumn(value, F.when(bad, F.raise_error(F.lit("a summary takes finite numbers that are not negative")).cast(values.schema[value].dataType)).otherwise(v))


def summarise(values: DataFrame, keys: list[str], value: str = "count", threshold=0, exclude_zeros: bool = False, percentiles: tuple = (), interpolation: str = "linear", quantiles: bool = True) -> DataFrame:
    """known, missing, total, nonzero, above, above_percent, n, mean, min, max, stddev, median and percentiles (p10, p2_5 ...) of
    each key (of all, without keys).

    One scan counts equal values of a key; all else comes from these counts.  Whole numbers up to DECIMAL(20,0) give exact
    results: means, medians and interpolated percentiles as decimals of six places, halves up.  Order statistics are found by
    rank: counts are summed by narrow ranges (a 1,024th of an octave), and only the ranges that hold a wanted rank are put in
    order; what meets in one task is the distinct values of a key in one such range.  Negative values and values that are no
    finite numbers raise.
    """
    values = _checked(values, value)
    k = F.struct(*[F.col(c) for c in keys]) if keys else F.struct(F.lit(0).alias("_"))
    seen = cut(values.groupBy(k.alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_c")))
    out, columns = _statistics(seen, _exact(values, value), threshold, exclude_zeros, percentiles, interpolation, quantiles)
    return out.select(*(F.col("_k")[c].alias(c) for c in keys), *columns)


#: What a row of summaries() is of.
LEVELS = ("dataset", "target", "all")


def summaries(values: DataFrame, dataset: str, target: str, value: str = "count", **options) -> DataFrame:
    """The summaries of each dataset, of each target and of the whole matrix, from one scan: `level` (dataset, target, all),
    dataset, target (null where they are not the key), cells, zeros, then what summarise() has.

    Equal values are counted for the three groupings by one expansion (grouping sets).
    """
    values = _checked(values.select(dataset, target, value), value)
    d, t, v = F.col(dataset), F.col(target), F.col(value)
    counted = values.groupingSets([[d, v], [t, v], [v]], d, t, v).agg(F.grouping(dataset).alias("_no_dataset"), F.grouping(target).alias("_no_target"), F.count("*").alias("_c"))
    level = F.when(F.col("_no_dataset") == 0, LEVELS[0]).when(F.col("_no_target") == 0, LEVELS[1]).otherwise(LEVELS[2])
    seen = cut(counted.select(F.struct(level.alias("level"), d.alias(dataset), t.alias(target)).alias("_k"), v.alias("_v"), "_c"))
    out, columns = _statistics(seen, _exact(values, value), **options)
    cells = (F.col("known") + F.col("missing")).alias("cells")
    return out.select(*(F.col("_k")[c].alias(c) for c in ("level", dataset, target)), cells, (F.col("known") - F.col("nonzero")).alias("zeros"), *columns)


def _statistics(seen: DataFrame, exact: bool, threshold=0, exclude_zeros: bool = False, percentiles: tuple = (), interpolation: str = "linear", quantiles: bool = True) -> tuple[DataFrame, list[str]]:
    """(_k and statistics, the statistics' names) of a written table of (_k, _v, _c): how often each key has each value."""
    v, c = F.col("_v"), F.col("_c")
    use = F.when(v > 0, v) if exclude_zeros else v
    wide = (lambda x: x.cast("decimal(38,0)")) if exact else (lambda x: x.cast("double"))
    times = (lambda x: (x.cast("decimal(27,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)")) if exact else (lambda x: x.cast("double") * c)
    some = lambda condition: F.coalesce(F.sum(F.when(condition, c)), F.lit(0)).cast("long")
    total = F.sum(times(v))
    base = seen.groupBy("_k").agg(
        some(v.isNotNull()).alias("known"), some(v.isNull()).alias("missing"), total.cast("decimal(38,0)").alias("total") if exact else total.alias("total"), some(v > 0).alias("nonzero"), some(v > threshold).alias("above"),
        some(use.isNotNull()).alias("n"), F.min(use).alias("min"), F.max(use).alias("max"), F.sum(times(use)).alias("_sum"),
    )
    mean = six_decimals(F.col("_sum"), F.col("n")) if exact else F.try_divide("_sum", "n")
    base = base.withColumns({"above_percent": F.try_divide(100.0 * F.col("above"), F.col("known")), "mean": mean}).drop("_sum")
    band = F.floor(F.log2(v.cast("double") + 1) * 1024).cast("int")
    seen = seen.where(use.isNotNull()).withColumn("_b", band)
    gap = (v.cast("decimal(38,6)") - F.col("mean")).cast("double") if exact else v - F.col("mean")
    spread = seen.join(base.select("_k", "mean"), "_k").groupBy("_k").agg(F.sqrt(F.sum(gap * gap * c) / F.sum("_c")).alias("stddev"))
    out = base.join(spread, "_k", "left")
    names = [f"p{str(p).replace('.', '_')}" for p in percentiles]
    if quantiles:
        n = F.col("n")
        micro = [round(float(p) * SCALE) for p in percentiles]
        div = lambda a, b: F.call_function("div", a, F.lit(b))
        linear = interpolation == "linear"
        # places from 0; of a median and of a percentile between two of them
        tags = {"m0": div(n - 1, 2), "m1": div(n, 2)}
        for i, p in enumerate(micro):
            tags[f"a{i}"] = div((n - 1) * p, 100 * SCALE) if linear else F.greatest(F.lit(0), div(n * p + 100 * SCALE - 1, 100 * SCALE) - 1)
            tags[f"b{i}"] = F.least(n - 1, tags[f"a{i}"] + 1) if linear else tags[f"a{i}"]
        wanted = base.where("n > 0").select("_k", F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), at.cast("long").alias("at")) for t, at in tags.items()))).alias("w")).select("_k", "w.*")
        bands = seen.groupBy("_k", "_b").agg(F.sum("_c").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("_k").orderBy("_b")) - F.col("_n"))
        wanted = wanted.join(bands, "_k").where("at >= _before and at < _before + _n").select("_k", "_b", "tag", (F.col("at") - F.col("_before")).alias("at"))
        wanted = wanted.groupBy("_k", "_b").agg(F.collect_list(F.struct("tag", "at")).alias("w"))
        upto = F.sum("_c").over(Window.partitionBy("_k", "_b").orderBy("_v"))
        placed = seen.join(wanted, ["_k", "_b"]).withColumn("_end", upto)
        found = placed.select("_k", "_v", F.explode(F.filter("w", lambda x: (x["at"] < F.col("_end")) & (x["at"] >= F.col("_end") - F.col("_c")))).alias("x"))
        picked = found.groupBy("_k").agg(*(F.max(F.when(F.col("x.tag") == t, F.col("_v"))).alias(f"_{t}") for t in tags))
        out = out.join(picked, "_k", "left")
        both = wide(F.col("_m0")) + wide(F.col("_m1"))
        out = out.withColumn("median", six_decimals(both, F.lit(2)) if exact else both / 2)
        for i, (p, name) in enumerate(zip(micro, names, strict=True)):
            a, b = wide(F.col(f"_a{i}")), wide(F.col(f"_b{i}"))
            rest = (n - 1) * p % (100 * SCALE)
            if not linear:
                out = out.withColumn(name, F.col(f"_a{i}"))
            elif exact:
                out = out.withColumn(name, six_decimals(a * (F.lit(100 * SCALE) - rest) + b * rest, F.lit(100 * SCALE)))
            else:
                out = out.withColumn(name, a + (b - a) * rest / F.lit(100 * SCALE))
        out = out.drop(*(f"_{t}" for t in tags))
    columns = ["known", "missing", "total", "nonzero", "above", "above_percent", "n", "mean", "min", "max", "stddev", *(["median", *names] if quantiles else [])]
    return out.withColumn("total", F.when(F.col("known") > 0, F.col("total"))), columns


def nearest_rank(values: DataFrame, keys: list[str], p: float, value: str = "count") -> DataFrame:
    got = summarise(values, keys, value, percentiles=(p,), interpolation="nearest-rank")
    return got.select(*keys, F.col(got.columns[-1]).alias("q"))


def hashed(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 of a seed and values, which any engine can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def sample(values: DataFrame, keys: list[str], item: list[str], size: int = 4096, seed: int = 1, value: str = "count") -> DataFrame:
    """The `size` known values of each key with the least hashes of (key, item), ties by the item: a uniform sample, the same for
    any partitioning, and of a union the least of the parts' samples.

    Hashes are counted in 4,096 ranges a key; rows of ranges beyond the one that fills the sample are left out before any meet, so
    a key's task gets its sample and one range, whatever the key's rows.
    """
    if not 256 <= size <= 65_536:
        raise ValueError("samples have 256 to 65,536 values")
    rows = values.where(F.col(value).isNotNull()).withColumn("_h", hashed(seed, *(F.col(c) for c in (*keys, *item)))).withColumn("_slot", F.shiftright("_h", 40))
    w = Window.partitionBy(*keys).orderBy("_slot")
    slots = rows.groupBy(*keys, "_slot").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    last = slots.where(F.col("_before") < size).groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys))).agg(F.max("_slot").alias("_last"))
    near = F.col("_slot") <= F.col("_last")
    for i, c in enumerate(keys):
        near = near & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    some = rows.join(last, near).drop(*(f"_k{i}" for i in range(len(keys))), "_last", "_slot")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", *item))
    return some.withColumn("_r", rank).where(F.col("_r") <= size).drop("_r", "_h")


def approximate(values: DataFrame, keys: list[str], item: list[str], percentiles: tuple = (50,), size: int = 4096, seed: int = 1, value: str = "count") -> DataFrame:
    """Percentiles of a sample: keys, a column each (p50 ...), sample_n, and quantiles_approximate: whether there was more."""
    got = summarise(cut(sample(values, keys, item, size, seed, value)), keys, value, percentiles=percentiles)
    names = [c for c in got.columns if c.startswith("p") and c[1:2].isdigit()]
    known = values.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys))).agg(F.count(value).alias("_n"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return got.join(known, same).select(*keys, *names, F.col("n").alias("sample_n"), (F.col("_n") > size).alias("quantiles_approximate"))


def top(counts: DataFrame, group: str, item: str, n: int, value: str = "count") -> DataFrame:
    """The n largest nonzero values of a group with rank and share of the group's total, ties to the smaller item."""
    totals = counts.groupBy(F.col(group).alias("_g")).agg(F.sum(value).alias("group_total"))
    w = Window.partitionBy(group).orderBy(F.desc(value), item)
    best = counts.where(F.col(value) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return best.join(totals, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("share", F.try_divide(F.col(value).cast("double"), F.col("group_total").cast("double")))


def others(ranked: DataFrame, group: str, value: str = "count") -> DataFrame:
    return ranked.groupBy(group).agg((F.max("group_total") - F.sum(value)).alias("other"))


def fold(counts: DataFrame, target: str, value: str = "value", kind: str | None = None) -> DataFrame:
    """fold (value over the target's mean of known values) and log2_fold (-infinity at zero); null if missing or the total is
    not positive.  With a column of kinds, means are of datasets only, and global and statistic columns have no fold."""
    real = F.lit(True) if kind is None else F.col(kind) == "dataset"
    w = Window.partitionBy(target)
    total, known = F.sum(F.when(real, F.col(value))).over(w), F.count(F.when(real, F.col(value))).over(w)
    f = F.when((total > 0) & real, F.col(value) / total * known)
    # where the ratio of a small value to a large total is too small for a double, its logarithm is a sum of logarithms
    apart = F.log2(F.col(value)) + F.log2(known.cast("double")) - F.log2(total.cast("double"))
    log = F.when(F.col(value) == 0, F.lit(float("-inf"))).when(f > 0, log2(f)).when(f == 0, apart)
    return counts.withColumns({"fold": f, "log2_fold": F.when((total > 0) & real, log)})


def ordered(rows: DataFrame, key: str, item: str, descending: bool = True) -> DataFrame:
    """Column `position` from 1: by key, nulls last, ties by item ascending.  Ranges are sorted and numbered where they are, from
    where the ranges before end: one shuffle, and a row for each range in one place."""
    by = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    # written once: what is counted below must be the ranges that were numbered here
    local = cut(rows.repartitionByRange(by, F.col(item)).sortWithinPartitions(by, F.col(item)).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id") % (1 << 33)
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return local.join(F.broadcast(before), part == F.col("_part")).withColumn("position", place + 1 + F.col("_before")).drop("_part", "_id", "_before")


def page(counts: DataFrame, positions: DataFrame, item: str, number: int, size: int = 100) -> DataFrame:
    return counts.join(positions.where((F.col("position") > number * size) & (F.col("position") <= (number + 1) * size)).select(item, "position"), item)


def hide_empty(counts: DataFrame, target: str, value: str = "count") -> DataFrame:
    return counts.join(counts.groupBy(target).agg(F.max(value).alias("_m")).where("_m > 0").select(target), target, "left_semi")


def scaled(counts: DataFrame, value: str = "count", log: bool = False) -> DataFrame:
    """Column `fraction`: value (or log10(value + 1)) over the largest one shown."""
    v = F.log10(F.col(value) + 1) if log else F.col(value).cast("double")
    most = counts.agg(F.max(v).alias("_most"))
    return counts.crossJoin(F.broadcast(most)).withColumn("fraction", F.coalesce(F.try_divide(v, F.col("_most")), F.lit(0.0))).drop("_most")


def search(targets: DataFrame, text: str, item: str, name: str) -> DataFrame:
    """Case-insensitive part of a name, or #ID."""
    if text.startswith("#"):
        return targets.where(F.col(item) == int(text[1:]))
    return targets.where(F.lower(name).contains(text.lower()))


def real_datasets(counts: DataFrame, kind: str = "kind", chosen: DataFrame | None = None, dataset: str = "dataset") -> DataFrame:
    """Rows of datasets proper, all or the chosen ones: global and statistic vectors are in no summary."""
    rows = counts.where(F.col(kind) == "dataset")
    return rows if chosen is None else rows.join(chosen.select(dataset).distinct(), dataset, "left_semi")


def totals(counts: DataFrame, key: str, value: str = "value", raw: str = "count") -> DataFrame:
    """total, max and detected (raw value above 0) of each row or column of a selection."""
    return counts.groupBy(key).agg(F.sum(value).alias("total"), F.max(value).alias("max"), F.count_if(F.col(raw) > 0).alias("detected"))


#: What rows can be sorted by; ties are by the original id, ascending in both directions.
SORTS = ("reference", "name-asc", "name-desc", "total-asc", "total-desc", "max-desc", "detected-desc")


def sorted_by(rows: DataFrame, mode: str, item: str, name: str = "name") -> DataFrame:
    """Column `position` by one of SORTS; rows have the columns that it needs."""
    if mode not in SORTS:
        raise ValueError(f"unknown order {mode}")
    field, _, way = mode.partition("-")
    if field == "reference":
        return ordered(rows.withColumn("_key", F.lit(0)), "_key", item, False).drop("_key")
    key = natural_key(F.col(name)) if field == "name" else F.col(field)
    return ordered(rows.withColumn("_key", key), "_key", item, way == "desc").drop("_key")


def sorted_summary(summaries: DataFrame, field: str, item: str, descending: bool = True, full_scope: bool = True) -> DataFrame:
    """Summaries by a statistic, unknown ones last in both directions; summaries of a part of the list can't be sorted."""
    if not full_scope:
        raise ValueError("only summaries of the full scope can be sorted")
    return ordered(summaries, field, item, descending)


def shares(ranked: DataFrame, group: str, item: str, inputs: DataFrame | None = None, value: str = "count") -> DataFrame:
    """Of top(): percent of the group's signal (`denominator` signal) or of all input k-mers (inputs: group, input_total; raw
    counts only), null over nothing."""
    if inputs is None:
        return ranked.withColumn("denominator", F.lit("signal")).withColumn("percent", F.try_divide(100.0 * F.col(value), F.col("group_total").cast("double")))
    got = ranked.join(inputs.select(group, F.col("input_total").cast("double").alias("_all")), group, "left")
    return got.withColumn("denominator", F.lit("input")).withColumn("percent", F.try_divide(100.0 * F.col(value), F.col("_all"))).drop("_all")


def ranking_report(counts: DataFrame, group: str, item: str, n: int, value: str = "count") -> DataFrame:
    """The top n of each group, then what is left as one row of kind `other`; a group where nothing is ranked has one row of
    kind `summary` with 0.  (group, kind, item, rank, value, percent)."""
    if not 1 <= n <= 1000:
        raise ValueError("from 1 to 1000 rows can be ranked")
    best = top(counts, group, item, n, value)
    sums = counts.groupBy(group).agg(F.sum(value).alias("group_total"))
    shown = best.groupBy(group).agg(F.sum(value).alias("shown"))
    rest = sums.join(shown, group, "left").withColumn("_v", F.when(F.col("shown").isNotNull(), F.col("group_total") - F.col("shown")).otherwise(0))
    percent = lambda v: F.try_divide(100.0 * v, F.col("group_total").cast("double")).alias("percent")
    v = F.col(value).cast("long")
    one = best.select(group, F.lit("target").alias("kind"), F.col(item), F.col("rank"), v.alias("value"), percent(v))
    kind = F.when(F.col("shown").isNull(), "summary").otherwise("other")
    last = rest.where("shown is null or _v > 0").select(group, kind.alias("kind"), F.lit(None).cast(counts.schema[item].dataType).alias(item), F.lit(None).cast("int").alias("rank"), F.col("_v").cast("long").alias("value"), percent(F.col("_v")))
    return one.unionByName(last)


def target_focus(counts: DataFrame, target: str, dataset: str, chosen, n: int = 20, value: str = "value", kind: str | None = None) -> DataFrame:
    """The profile of one target: its datasets with value, fold, log2_fold and rank by value (zeros unranked, ties to the
    smaller dataset).  The rows of one target are as many as datasets."""
    rows = fold(counts.where(F.col(target) == chosen), target, value, kind)
    ranked = F.row_number().over(Window.partitionBy(target, F.col(value) > 0).orderBy(F.desc(value), dataset))
    return rows.withColumn("rank", F.when(F.col(value) > 0, ranked)).withColumn("shown", F.coalesce(F.col("rank") <= n, F.lit(False)))


def focus_summary(counts: DataFrame, target: str, chosen, value: str = "count", kind: str | None = None, **options) -> DataFrame:
    """The distribution of one target over its datasets (global and statistic vectors left out), as summarise() has it, with how many
    datasets there are."""
    rows = counts.where(F.col(target) == chosen)
    rows = rows if kind is None else real_datasets(rows, kind)
    return summarise(rows, [], value, **options).withColumn("datasets", F.col("known") + F.col("missing"))


def focus_page(focus: DataFrame, dataset: str, number: int, size: int = 100) -> DataFrame:
    """A page of target_focus(): ranked datasets by rank, then those without a count, by dataset."""
    last = (1 << 62) + F.row_number().over(Window.partitionBy(F.col("rank").isNull()).orderBy(dataset))
    order = focus.withColumn("_place", F.coalesce("rank", last))
    return order.orderBy("_place").offset(number * size).limit(size).drop("_place")


def display_bounds(counts: DataFrame, low=None, high=None, value: str = "value") -> DataFrame:
    """Column `shown`: the value, null outside the bounds; nothing else changes."""
    inside = (F.lit(True) if low is None else F.col(value) >= low) & (F.lit(True) if high is None else F.col(value) <= high)
    return counts.withColumn("shown", F.when(inside, F.col(value)))


def fold_scaled(counts: DataFrame, value: str = "log2_fold") -> DataFrame:
    """Column `fraction` from -1 to 1: log2 folds over the largest finite one of either sign, at least 1; -infinity is -1."""
    v = F.col(value)
    finite = F.when(F.abs(v) < float("inf"), F.abs(v))
    most = counts.agg(F.greatest(F.coalesce(F.max(finite), F.lit(1.0)), F.lit(1.0)).alias("_most"))
    return counts.crossJoin(F.broadcast(most)).withColumn("fraction", F.greatest(F.least(v / F.col("_most"), F.lit(1.0)), F.lit(-1.0))).drop("_most")


def list_fractions(summaries: DataFrame, statistics: list[str]) -> DataFrame:
    """Columns fraction_X: each statistic over its largest value among all summaries, whatever page is shown."""
    most = summaries.agg(*(F.max(F.col(c).cast("double")).alias(f"_{c}") for c in statistics))
    got = summaries.crossJoin(F.broadcast(most))
    return got.withColumns({f"fraction_{c}": F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_{c}")), F.lit(0.0)) for c in statistics}).drop(*(f"_{c}" for c in statistics))


def pivot_page(counts: DataFrame, item: str, dataset: str, rows: DataFrame, columns: DataFrame, row_page: int = 0, column_page: int = 0, height: int = 100, width: int = 25, value: str = "count") -> DataFrame:
    """One page of the matrix, wide: item, position and a column c1, c2 ... for each dataset position on the page.

    rows and columns are (key, position) tables; a page's columns are `width` numbers at most, so nothing is collected.
    """
    shown = page(counts, rows, item, row_page, height)
    at = columns.where((F.col("position") > column_page * width) & (F.col("position") <= (column_page + 1) * width)).select(dataset, (F.col("position") - column_page * width).alias("_column"))
    return shown.join(F.broadcast(at), dataset).groupBy(item, "position").pivot("_column", list(range(1, width + 1))).agg(F.first(value)).select(item, "position", *(F.col(f"`{c}`").alias(f"c{c}") for c in range(1, width + 1)))


def page_of(position: int, size: int = 100) -> int:
    """The page that shows a position, from 0; positions start at 1."""
    if position < 1:
        raise ValueError("positions start at 1")
    return (position - 1) // size


def pasted(text: str) -> list[str]:
    """Names and #IDs of a pasted list: one a line, blank lines and // comments left out."""
    return list(dict.fromkeys(x for x in map(str.strip, text.splitlines()) if x and not x.startswith("//")))


def paste_select(targets: DataFrame, text: str, item: str, name: str, ids: bool = True) -> DataFrame:
    """Targets named in a pasted list, by exact name (every one that has it) or #ID; what nothing answers to raises."""
    wanted = pasted(text)
    table = targets.sparkSession.createDataFrame([(x,) for x in wanted], "_w string")
    keys = F.array(F.col(name), F.concat(F.lit("#"), F.col(item).cast("string"))) if ids else F.array(F.col(name))
    hit = targets.withColumn("_w", F.explode(keys)).join(F.broadcast(table), "_w")
    unknown = table.join(hit.select("_w").distinct(), "_w", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError("unknown selections: " + ", ".join(r[0] for r in unknown))
    return hit.drop("_w").dropDuplicates([item])


def lookup(targets: DataFrame, wanted: str, item: str, name: str) -> DataFrame:
    """One target, by #ID or as the first that has the exact name; none raises."""
    if wanted.startswith("#") and wanted[1:].isdigit():
        found = targets.where(F.col(item) == int(wanted[1:]))
    else:
        found = targets.where(F.col(name) == wanted).orderBy(item).limit(1)
    if found.isEmpty():
        raise ValueError(f"unknown: {wanted}")
    return found


def catalogue_page(targets: DataFrame, item: str, number: int, size: int = 100) -> DataFrame:
    """A page of the table of targets in its own order, before anything is computed."""
    return page(targets.drop("position"), sorted_by(targets.select(item), "reference", item), item, number, size)


def metric(values: DataFrame, name: str) -> DataFrame:
    """Rows of one metric of a transcript result; these are not normalised further."""
    if name not in ("abundance", "assigned_observations"):
        raise ValueError(f"unknown metric {name}")
    return values.where(F.col("metric") == name)


def overview_is_cheap(cells: int, datasets: int) -> bool:
    """Whether an overview is made without being asked for."""
    return cells <= 10_000 and datasets <= 32


def check_request(mode: str = "none", threshold=0, low=None, high=None, scope: int = 1, kinds: tuple[str, ...] = ("dataset",), lengths_known: bool = True, totals_known: bool = True) -> None:
    """What can be refused before any scan: empty scopes, bad numbers, normalisation that lacks its denominators or is of a
    statistic."""
    if scope < 1:
        raise ValueError("nothing is selected")
    if any(x is not None and (x != x or x < 0 or x == float("inf")) for x in (threshold, low, high)) or (low is not None and high is not None and low > high):
        raise ValueError("thresholds and bounds must be finite, not negative and in order")
    if mode not in ("none", "cpm", "coverage", "length-cpm"):
        raise ValueError(f"unknown normalisation {mode}")
    if mode != "none" and "statistic" in kinds:
        raise ValueError("statistics are not normalised")
    if mode in ("coverage", "length-cpm") and not lengths_known:
        raise ValueError("k-mer lengths are not known: rebuild the index")
    if mode in ("cpm", "length-cpm") and not totals_known:
        raise ValueError("k-mer totals are not known: count again")


class Requests:
    """Results written by what is asked: a plan that is the same to Spark (semanticHash) is computed once and read after that, also by
    other threads.  Running work has a tag of its request, by which it is cancelled; the oldest of more than `most` results go."""

    def __init__(self, spark, most: int = 8):
        self.spark, self.most, self.kept = spark, most, {}

    @staticmethod
    def tag(df: DataFrame) -> str:
        return f"request-{df.semanticHash()}"

    def get(self, df: DataFrame) -> DataFrame:
        tag, sc = self.tag(df), self.spark.sparkContext
        known = self.kept.get(tag)
        if known is None or not known[0].sameSemantics(df):
            sc.addJobTag(tag)
            try:
                known = df, cut(df)
            finally:
                sc.removeJobTag(tag)
            self.kept[tag] = known
            while len(self.kept) > self.most:
                forget(self.kept.pop(next(iter(self.kept)))[1])
        return known[1]

    def cancel(self, df: DataFrame) -> None:
        """Ends the jobs of a request that is running, in whatever thread; its get() raises there and nothing is kept."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag(df))
