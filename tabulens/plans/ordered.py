"""Ordered windows, fills and running sums that stay exact when one key holds most of the rows.

Groups within `HOT_ROWS` use an ordinary window. A larger group is cut into ranges of its own order; the ranges are
written once so their ids are fixed, and only edge facts travel between them: the last `lookback` rows of earlier
ranges, the nearest known values, or the range totals. All of these grow with the number of ranges, not of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tabulens.functions.columns import col
from tabulens.plans.workspace import written

HOT_ROWS = 5_000_000
RANGE_ROWS = 2_000_000
MAX_HOT_GROUPS = 10_000
MAX_RANGES = 20_000
RANGE = "__range"
HALO = "__halo"


def require_order(order_by: list[str]) -> None:
    if not order_by:
        raise ValueError("name the order_by columns (end them with a unique key so that ties cannot reorder rows)")


def split_hot(df: DataFrame, partition_by: list[str], hot_rows: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(rows of ordinary groups, rows of hot groups, number of hot rows); either part may be None."""
    if not partition_by:
        n = df.count()
        return (df, None, 0) if n <= hot_rows else (None, df, n)
    sizes = df.groupBy(*[col(k) for k in partition_by]).count()
    facts = sizes.agg(F.sum("count").alias("n"), F.max("count").alias("biggest")).first()
    if (facts["biggest"] or 0) <= hot_rows:
        return df, None, 0
    # At most MAX_HOT_GROUPS groups can exceed this size, so the hot list may be broadcast.
    limit = max(hot_rows, facts["n"] // MAX_HOT_GROUPS)
    hot_list = sizes.filter(F.col("count") > limit).collect()
    if not hot_list:
        return df, None, 0
    names = [f"__k{i}" for i in range(len(partition_by))]
    keys = df.sparkSession.createDataFrame(
        [tuple(r[: len(names)]) for r in hot_list],
        ", ".join(f"{a} {df.schema[k].dataType.simpleString()}" for a, k in zip(names, partition_by)),
    )
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(a)) for a, k in zip(names, partition_by)])
    cold = df.join(F.broadcast(keys), same, "left_anti")
    hot = df.join(F.broadcast(keys), same, "left_semi")
    return cold, hot, sum(r["count"] for r in hot_list)


def cut_ranges(df: DataFrame, partition_by: list[str], order_by: list[str], rows: int, range_rows: int) -> DataFrame:
    """Rows with a range id that grows along (partition_by, order_by). Written, because range cuts are sampled."""
    per_range = max(range_rows, rows // MAX_RANGES)
    cuts = max(1, math.ceil(rows / per_range))
    ranged = df.repartitionByRange(cuts, *[col(c) for c in partition_by + order_by])
    return written(ranged.withColumn(RANGE, F.spark_partition_id()), "ranges")


def with_windows(
    df: DataFrame,
    partition_by: list[str],
    order_by: list[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    lookback: int,
    hot_rows: int | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Add the window columns `build` makes; they may look back at most `lookback` rows."""
    require_order(order_by)
    hot_rows, range_rows = hot_rows or HOT_ROWS, range_rows or RANGE_ROWS
    cold, hot, n_hot = split_hot(df, partition_by, hot_rows)
    order = [col(c) for c in order_by]
    parts = []
    if cold is not None:
        spec = Window.partitionBy(*[col(c) for c in partition_by]).orderBy(*order)
        parts.append(_add(cold, build(spec)))
    if hot is not None:
        ranges = cut_ranges(hot, partition_by, order_by, n_hot, range_rows)
        inputs = ranges.withColumn(HALO, F.lit(False)).unionByName(_halo_rows(ranges, partition_by, order_by, lookback))
        spec = Window.partitionBy(F.col(RANGE), *[col(c) for c in partition_by]).orderBy(*order)
        parts.append(_add(inputs, build(spec)).filter(~F.col(HALO)).drop(RANGE, HALO))
    return reduce(DataFrame.unionByName, parts)


def _add(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(name) for name, c in new.items()])


def _halo_rows(ranges: DataFrame, keys: list[str], order_by: list[str], lookback: int) -> DataFrame:
    """For each (key, range) the last `lookback` rows before it, tagged with that range."""
    group = [F.col(RANGE), *[col(k) for k in keys]]
    backward = Window.partitionBy(*group).orderBy(*[col(c).desc() for c in order_by])
    forward = Window.partitionBy(*group).orderBy(*[col(c) for c in order_by])
    along = Window.partitionBy(*[col(k) for k in keys]).orderBy(F.col(RANGE), *[col(c) for c in order_by])
    tails = ranges.withColumn("__rn", F.row_number().over(backward)).filter(F.col("__rn") <= lookback).drop("__rn")
    whole = F.struct(*[col(c) for c in ranges.columns if c != RANGE])
    before = tails.select(
        F.col(RANGE),
        F.collect_list(whole).over(along.rowsBetween(-lookback, -1)).alias("__before"),
        F.row_number().over(forward).alias("__first"),
    ).filter(F.col("__first") == 1)
    exploded = before.select(F.col(RANGE), F.explode("__before").alias("__row"))
    return exploded.select("__row.*", RANGE, F.lit(True).alias(HALO)).select(*ranges.columns, HALO)


def fill_ordered(
    df: DataFrame,
    partition_by: list[str],
    order_by: list[str],
    fills: dict[str, tuple[str, bool]],
    hot_rows: int | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Fill nulls along the order. `fills` maps an output name to (input column, look ahead first?)."""
    require_order(order_by)
    hot_rows, range_rows = hot_rows or HOT_ROWS, range_rows or RANGE_ROWS
    cold, hot, n_hot = split_hot(df, partition_by, hot_rows)
    parts = []
    if cold is not None:
        parts.append(_fill(cold, [col(k) for k in partition_by], order_by, fills, {}))
    if hot is not None:
        ranges = cut_ranges(hot, partition_by, order_by, n_hot, range_rows)
        position = F.struct(*[col(c) for c in order_by])
        edge = []
        for i, (name, _) in enumerate(fills.values()):
            known = F.when(col(name).isNotNull(), position)
            edge += [F.max_by(col(name), known).alias(f"__l{i}"), F.min_by(col(name), known).alias(f"__f{i}")]
        edges = ranges.groupBy(F.col(RANGE), *[col(k) for k in partition_by]).agg(*edge)
        along = Window.partitionBy(*[col(k) for k in partition_by]).orderBy(RANGE)
        against = Window.partitionBy(*[col(k) for k in partition_by]).orderBy(F.col(RANGE).desc())
        carried = []
        for i in range(len(fills)):
            carried.append(F.last(f"__l{i}", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__p{i}"))
            carried.append(F.last(f"__f{i}", True).over(against.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__n{i}"))
        names = {k: f"__j{i}" for i, k in enumerate(partition_by)}
        carry = edges.select(F.col(RANGE).alias("__jr"), *[col(k).alias(a) for k, a in names.items()], *carried)
        same = F.col(RANGE) == F.col("__jr")
        for k, a in names.items():
            same = same & col(k).eqNullSafe(F.col(a))
        # One row per (hot group, range): at most MAX_RANGES + MAX_HOT_GROUPS rows.
        joined = ranges.join(F.broadcast(carry), same, "left")
        edges_of = {i: (F.col(f"__p{i}"), F.col(f"__n{i}")) for i in range(len(fills))}
        filled = _fill(joined, [F.col(RANGE), *[col(k) for k in partition_by]], order_by, fills, edges_of)
        keep = list(dict.fromkeys([*df.columns, *fills]))
        parts.append(filled.select(*[col(c) for c in keep]))
    return reduce(DataFrame.unionByName, parts)


def _fill(df, group, order_by, fills, edges):
    # Look ahead by reversing the order: a growing frame costs one step per row, a shrinking one restarts at each row.
    asc = Window.partitionBy(*group).orderBy(*[col(c).asc() for c in order_by])
    desc = Window.partitionBy(*group).orderBy(*[col(c).desc() for c in order_by])
    grow = (Window.unboundedPreceding, Window.currentRow)
    new = {}
    for i, (out, (name, ahead)) in enumerate(fills.items()):
        before, after = edges.get(i, (None, None))
        back = [F.last(col(name), True).over(asc.rowsBetween(*grow))] + ([before] if before is not None else [])
        if ahead:
            front = [F.last(col(name), True).over(desc.rowsBetween(*grow))] + ([after] if after is not None else [])
            new[out] = F.coalesce(*front, *back)
        else:
            new[out] = F.coalesce(*back)
    ordered = [new[c].alias(c) if c in new else col(c) for c in df.columns]
    added = [v.alias(c) for c, v in new.items() if c not in df.columns]
    return df.select(*ordered, *added)


def running_sums(
    df: DataFrame,
    order_by: list[Column],
    sums: dict[str, Column],
    small_rows: int | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums over the whole table in a total order."""
    small_rows, range_rows = small_rows or HOT_ROWS, range_rows or RANGE_ROWS
    keyed = df.select("*", *[o.alias(f"__o{i}") for i, o in enumerate(order_by)],
                      *[s.alias(f"__s{i}") for i, s in enumerate(sums.values())])
    order = [F.col(f"__o{i}") for i in range(len(order_by))]
    extra = [f"__o{i}" for i in range(len(order_by))] + [f"__s{i}" for i in range(len(sums))]
    n = df.count()
    if n <= small_rows:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return _add(keyed, {name: F.sum(f"__s{i}").over(w) for i, name in enumerate(sums)}).drop(*extra)
    ranges = cut_ranges(keyed, [], [f"__o{i}" for i in range(len(order_by))], n, range_rows)
    totals = ranges.groupBy(RANGE).agg(*[F.sum(f"__s{i}").alias(f"__t{i}") for i in range(len(sums))])
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(RANGE).alias("__jr"), *[
        F.coalesce(F.sum(f"__t{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    # One row per range, at most MAX_RANGES rows.
    joined = ranges.join(F.broadcast(offsets), F.col(RANGE) == F.col("__jr"))
    w = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = _add(joined, {name: F.sum(f"__s{i}").over(w) + F.col(f"__b{i}") for i, name in enumerate(sums)})
    return summed.drop(RANGE, "__jr", *extra, *[f"__b{i}" for i in range(len(sums))])


def row_numbers(df: DataFrame, order_by: list[Column], name: str, **sizes) -> DataFrame:
    """1-based position of every row in a total order."""
    return running_sums(df, order_by, {name: F.lit(1).cast("long")}, **sizes)
